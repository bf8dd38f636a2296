"""Every query runs; those with an oracle equal it."""

import duckdb
import pytest

from bitloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "events", "labels", "conversations")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v + 0.0:.5g}"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect(config={"threads": 2})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    got = duck.execute(ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, rows) == rows_of(columns, got.fetchall())


def test_stream_equals_batch(spark):
    from pyspark.sql import functions as F

    from bitloom.operators import audio
    from bitloom.plans import tables
    from bitloom.streaming import runs

    got = runs.dm_of_events(spark, SF).join(spark.read.parquet(f"{SF}/events.parquet"), F.col("seq") == F.col("event_id"))
    bits = {r[0]: r[1] for r in got.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "code"))), lambda s: s.code.cast("string")), "")).collect()}
    want = {r[0]: r[1] for r in tables.event_signals(spark, SF).select("sig_id", audio.dm_bits(F.col("signal"), 0.05)).collect()}
    assert bits == want


def test_arc_source(spark, tmp_path):
    from bitloom.functions import header as H
    from bitloom.sources import arc
    from pyspark.sql import functions as F

    arc.register(spark)
    head = H.serialize(F.lit(1), F.lit(1), F.lit(3), F.lit("png"))
    out = str(tmp_path / "archives")
    spark.range(5).select(F.format_string("a%d", "id").alias("name"), F.concat(head, F.lit(b"xyz")).alias("archive")).write.format("arc").mode("append").save(out)
    got = spark.read.format("arc").load(out)
    assert got.count() == 5
    r = got.orderBy("name").first()
    assert (r.name, r.file_type, r.padding_bits, r.extension, r.header_bytes, r.error, bytes(r.archive).hex()) == ("a0.abc", 1, 3, "png", 11, None, "4152434801010303706e6778797a")


def test_audio_header_golden(spark):
    from bitloom.functions import header as H
    from pyspark.sql import functions as F

    h = H.serialize_audio(F.lit(8), F.lit(3), F.lit("wav"), F.lit(2), F.lit(4), F.lit(0.0), F.lit(0.9), F.lit(44100), F.lit(44100), F.lit(1))
    assert spark.range(1).select(F.hex(h)).first()[0].lower() == "4152434803080303776176" + "020400002328" + "0000ac44" + "0000ac44" + "0001"
    with pytest.raises(Exception, match="invalid header"):
        spark.range(1).select(H.strict(F.lit(1), H.error(F.lit(9), F.lit(1), F.lit(0), F.lit("x")))).collect()


def test_images_are_read_as_rgb(spark, tmp_path):
    import numpy as np

    from bitloom.operators import image, kernels

    p = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    (tmp_path / "x.png").write_bytes(kernels.png(p))
    (tmp_path / "y.png").write_bytes(b"no picture")
    r, broken = image.read_images(spark, str(tmp_path)).orderBy("origin").collect()
    assert (r.h, r.w, r.channels, bytes(r.pixels), r.error) == (2, 4, 3, p.tobytes(), None)
    assert (broken.h, broken.pixels) == (None, None) and broken.error


def test_broken_payloads_give_errors(spark):
    from bitloom.operators import lossless

    rows = spark.createDataFrame([(1, bytearray(b"\x00"), 0), (2, None, 0)], "blob_id bigint, payload binary, padding_bits int")
    got = {r.blob_id: r.error for r in lossless.decode(rows, 1).collect()}
    assert got[1] and got[2] is None


def test_restored_files_keep_their_names(spark, tmp_path):
    from bitloom.sources import arc, media

    arc.register(spark)
    rows = spark.createDataFrame([("a.txt", bytearray(b"a")), ("dir/b", bytearray(b"bb")), ("gone", None), ("", bytearray())], "restored_name string, restored binary")
    rows.write.format("restored").mode("append").save(str(tmp_path / "out"))
    got = {r.name: bytes(r.content) for r in media.read_blobs(spark, str(tmp_path / "out")).collect()}
    assert got == {"a.txt": b"a", "b": b"bb"}  # the reader of uploads has no rows for empty files
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["a.txt", "b", "unnamed"]


def test_lz78_sessions(spark, tmp_path):
    """Any cut of the stream into batches gives the tokens of whole sessions; the last one, not ended, keeps its open phrase."""
    from pyspark.sql import functions as F

    from bitloom.streaming import keyed, runs

    texts = [("a", "abab", False), ("a", "aba", True), ("a", "ab", False), ("b", "xx", True), ("a", "ab", False)]
    for k, (key, text, last) in enumerate(texts):
        spark.createDataFrame([(key, k, k, text, last)], "key string, ts int, seq int, text string, last boolean").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts int, seq int, text string, last boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = runs.run_to_end(spark, keyed.token_stream(stream), keyed.TOKEN_SCHEMA, "t").orderBy("key", "session", "k").collect()
    assert [(r.key, r.session, r.idx, r.ch) for r in got] == [
        ("a", 1, 0, "a"), ("a", 1, 0, "b"), ("a", 1, 1, "b"), ("a", 1, 3, "a"), ("a", 2, 0, "a"), ("a", 2, 0, "b"), ("a", 2, 1, "b"), ("b", 1, 0, "x"), ("b", 1, 1, None),
    ]


def test_lz78_stream_calls_the_state_a_few_times_a_key(monkeypatch):
    """Each call of the state is a message to the JVM: their number follows from keys and batches, not from characters."""
    import pandas as pd

    from bitloom.operators import kernels
    from bitloom.streaming import keyed

    class State:
        def __init__(self):
            self.held, self.calls = None, 0

        def called(self, value=None):
            self.calls += 1
            return value

        exists = lambda self: self.called(bool(self.held))
        get = lambda self: self.called(iter(list(self.held or [])) if isinstance(self.held, list) else self.held)
        clear = lambda self: self.called(setattr(self, "held", None))
        update = lambda self, v: self.called(setattr(self, "held", v))
        appendList = lambda self, v: self.called(setattr(self, "held", [*(self.held or []), *v]))
        containsKey = lambda self, k: self.called(k in (self.held or {}))
        getValue = lambda self, k: self.called(self.held[k])
        updateValue = lambda self, k, v: self.called(setattr(self, "held", {**(self.held or {}), k: v}))

    made = [State(), State()]

    class Handle:
        getValueState = getListState = getMapState = lambda self, *a: made[a[0] != "open"]

    monkeypatch.setattr(keyed, "APPENDED", 50)
    p = keyed.Lz78()
    p.init(Handle())
    text, out = "abracadabra;" * 40, []
    for batch in range(3):
        rows = pd.DataFrame({"ts": [batch], "seq": [batch], "text": [text], "last": [batch == 2]})
        out += [tuple(r) for f in p.handleInputRows(("a",), iter([rows]), None) for r in f[["idx", "ch"]].itertuples(index=False)]
    assert [(i, None if c is None else ord(c)) for i, c in out] == kernels.lz78_tokens((text * 3).encode())
    assert sum(s.calls for s in made) <= 30


def test_numbers_in_print_and_rounded_equal_sql(spark):
    """Values beside a half: the binary value decides, as in C; the sign of zero stays."""
    import numpy as np

    from bitloom.functions import names as N
    from pyspark.sql import functions as F

    r = np.random.default_rng(3)
    near = np.concatenate([(r.integers(0, 10**6, 300) + 0.5) / 10**4, (r.integers(0, 10**9, 300) + 0.5) / 10**5, r.normal(0, 100, 100), [0.0, -0.0, -1e-6, 0.99996, 9999.99995, 2.0**40 + 0.00005, 1e-20, 0.125, 0.375, 1.00625]])
    x = np.concatenate([near, -near, np.nextafter(near, np.inf)]).tolist()
    con = duckdb.connect()
    want = con.execute("SELECT i, printf('%.4f×', x), printf('%+.2f%% y', x), round(x, 5), round(x, 4) FROM (SELECT unnest($1) AS x, generate_subscripts($1, 1) AS i) ORDER BY i", [x]).fetchall()
    v = F.col("x")
    got = spark.createDataFrame([*enumerate(x, 1)], "i int, x double").select("i", N.fixed(v, 4, "%.{n}f×"), N.fixed(v, 2, "%+.{n}f%% y"), N.rounded(v, 5), N.rounded("x", 4)).orderBy("i").collect()
    assert [repr(tuple(g)) for g in got] == [repr(w) for w in want]


@pytest.mark.parametrize("name, kernels", [("codec_report", 2), ("byte_histogram", 1), ("codec_router", 2), ("archive_status", 2)])
def test_kernels_run_once(spark, name, kernels):
    """No kernel stands in a plan a second time, below an inferred filter or in another branch, and nothing is joined."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == kernels and "Join" not in plan


def test_kernels_take_a_batch_in_parts():
    import pyarrow as pa

    from bitloom.functions import udfs

    blobs = pa.array([b"a" * 700_000, None, b"b" * 700_000, b"c" * 3_000_000, b"", *[b"d"] * 600])
    parts = [p.to_pylist() for (p,) in udfs._parts((blobs,))]
    assert [b for p in parts for b in p] == blobs.to_pylist()
    assert max(map(len, parts)) <= udfs.PART_ROWS and all(len(p) == 1 or sum(len(b or b"") for b in p[:-1]) <= udfs.PART for p in parts)


def test_what_is_bound_once_is_named_once(spark):
    """The range of a signal and the total of counts stand once, not in the body of the map or fold that reads them."""
    from bitloom.operators import audio, lossless
    from pyspark.sql import functions as F

    t = spark.createDataFrame([([0.0, 1.0, 0.5], [1, 3, 0])], "x array<float>, h array<bigint>")
    q = t.select(audio.pcm_indices(F.col("x"), 3).alias("k"), audio.pcm_indices(F.col("x").cast("array<float>"), 1, 2).alias("d"), lossless.entropy(F.col("h")).alias("e"))
    assert tuple(q.first()) == ([0, 7, 4], [0, 1], pytest.approx(0.8112781244591328))
    plan = t.select(audio.pcm_indices(F.col("x"), 3))._jdf.queryExecution().optimizedPlan().toString()
    # every mention of the smallest sample is inside the one binding struct
    assert "array_min(x#" not in plan
    assert spark.createDataFrame([(None, None)], "x array<float>, h array<bigint>").select(audio.pcm_indices(F.col("x"), 3).alias("k")).first().k is None


def test_distinct_symbols_of_empty_texts_and_repeated_ids(spark, tmp_path):
    texts = [(1, "abca"), (2, ""), (3, None), (4, "ab"), (4, "cd"), (5, "éé\n"), (6, bytes(range(1, 128)).decode()), (6, "x" * 127)]
    spark.createDataFrame([(i, "en", t) for i, t in texts], "doc_id bigint, lang string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df, want = QUERIES["distinct_symbols"](spark, str(tmp_path)), con.execute(ORACLES["distinct_symbols"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in want.description], want.fetchall())
