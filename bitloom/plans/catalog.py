"""Registered queries, one or more for each operator, with their oracles in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import bits as B
from bitloom.functions import header as H
from bitloom.functions import names as N
from bitloom.functions.constants import ADM, ALGORITHM_LABELS, CHAINED, DM, DPCM, FILE_TYPE_LABELS, HUFFMAN, LZ78, PARAMETERS, PCM
from bitloom.functions.udfs import code_table, histogram, lz78_tokens, nonzero
from bitloom.operators import archive, audio, image, lossless, simulate
from bitloom.plans import tables as T
from bitloom.sources import media

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: SQL fragments that many oracles share.
_BYTES = "unnest(regexp_extract_all(hex(encode(text)), '..')) AS h"
_SIG = "SELECT vec_id AS sig_id, embedding AS s FROM embeddings"
_IMG = "SELECT vec_id AS img_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(floor((CAST(unnest(embedding) AS DOUBLE) + 1) * 127.5) AS INTEGER) AS v FROM embeddings"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# information measures and lossless codecs


@query("byte_histogram", f"SELECT doc_id AS blob_id, CAST(('0x' || h)::INTEGER AS INTEGER) AS sym, count(*) AS cnt FROM (SELECT doc_id, {_BYTES} FROM documents) GROUP BY ALL")
def _(s, d):
    return lossless.byte_counts(T.blobs(s, d))


_ENTROPY = f"""WITH c AS (SELECT doc_id, h, count(*) AS n FROM (SELECT doc_id, {_BYTES} FROM documents) GROUP BY ALL),
t AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id) AS m FROM c), e AS (SELECT doc_id, -sum(n / m * log2(n / m)) AS x FROM t GROUP BY doc_id) """


@query("entropy_by_doc", _ENTROPY + "SELECT d.doc_id AS blob_id, round(coalesce(e.x, 0), 6) + 0.0 AS entropy FROM documents d LEFT JOIN e USING (doc_id)")
def _(s, d):
    return T.blobs(s, d).select("blob_id", histogram("content").alias("h")).select("blob_id", (N.rounded(lossless.entropy(F.col("h")), 6) + 0.0).alias("entropy"))


@query("entropy_by_lang", _ENTROPY + "SELECT lang, count(*) AS n, round(avg(coalesce(e.x, 0)), 6) AS entropy FROM documents d LEFT JOIN e USING (doc_id) GROUP BY lang")
def entropy_by_lang(s, d):
    b = T.blobs(s, d).select("lang", histogram("content").alias("h")).select("lang", lossless.entropy(F.col("h")).alias("e"))
    return b.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), N.rounded(F.avg("e"), 6).alias("entropy"))


@query("distinct_symbols", f"SELECT doc_id AS blob_id, octet_length(encode(any_value(text))) AS n_symbols, count(DISTINCT h) AS n_unique FROM (SELECT doc_id, text, {_BYTES} FROM documents) GROUP BY doc_id")
def _(s, d):
    return lossless.distinct_symbols(T.blobs(s, d))


_TABLE = f"""WITH c AS (SELECT item_id, h, count(*) AS n FROM (SELECT item_id, {_BYTES} FROM benchmark) GROUP BY ALL) """


@query("huffman_freq_table_bytes", _TABLE + "SELECT item_id AS blob_id, printf('%04X', count(*)) || string_agg(h || printf('%08X', n), '' ORDER BY h) AS freq_table FROM c GROUP BY item_id")
def _(s, d):
    return T.items(s, d).select("blob_id", F.hex(lossless.write_counts(nonzero(histogram("content")))).alias("freq_table"))


@query("huffman_freq_table_read", _TABLE + "SELECT item_id AS blob_id, CAST(('0x' || h)::INTEGER AS INTEGER) AS sym, n AS cnt FROM c")
def _(s, d):
    t = T.items(s, d).select("blob_id", lossless.write_counts(nonzero(histogram("content"))).alias("w"))
    return t.select("blob_id", F.explode(lossless.read_counts(F.col("w"))["counts"]).alias("x")).select("blob_id", F.col("x.sym").alias("sym"), F.col("x.cnt").alias("cnt"))


#: Code bits of a Huffman code: the sum of all inner weights; one symbol alone takes a bit each. Counts (item_id, h, n) are in c.
_CODE_BITS = """, {g} AS (SELECT item_id, list_sort(list(n)) AS l, 0::BIGINT AS total, sum(n)::BIGINT AS n, count(*) AS k FROM {c} GROUP BY item_id),
{r} AS (SELECT item_id, l, total FROM {g} UNION ALL
      SELECT item_id, list_sort(list_append(l[3:], l[1] + l[2])), total + l[1] + l[2] FROM {r} WHERE len(l) > 1),
{t} AS (SELECT item_id, any_value({g}.n) AS n, any_value(k) AS k, CASE WHEN any_value(k) = 1 THEN any_value({g}.n) ELSE max({r}.total) END AS bits FROM {r} JOIN {g} USING (item_id) GROUP BY item_id) """
_HUFFMAN = (
    _TABLE.replace("WITH", "WITH RECURSIVE") + _CODE_BITS.format(c="c", g="g", r="r", t="t")
    + """, e AS (SELECT item_id, -sum(c.n / t.n * log2(c.n / t.n)) AS h FROM c JOIN t USING (item_id) GROUP BY item_id) """
)
_FULL_BYTES = "array_to_string(list_transform(regexp_extract_all({bits}, '[01]{{8}}'), lambda x: printf('%02X', list_sum(list_transform(range(8), lambda i: CASE WHEN x[i + 1] = '1' THEN 1 << (7 - i)::INTEGER ELSE 0 END))::BIGINT)), '')"


@query("huffman_total_bits", _HUFFMAN + "SELECT item_id AS blob_id, k AS n_codes, CAST(bits AS BIGINT) AS code_bits FROM t")
def _(s, d):
    b = T.items(s, d).select("blob_id", code_table("content").alias("codes"), nonzero(histogram("content")).alias("h"))
    bits = F.aggregate(F.arrays_zip("codes", "h"), F.lit(0).cast("long"), lambda a, z: a + F.length(z["codes"]["code"]) * z["h"]["cnt"])
    return b.select("blob_id", F.size("codes").cast("long").alias("n_codes"), bits.alias("code_bits"))


@query("huffman_avg_code_length", _HUFFMAN + "SELECT item_id AS blob_id, CAST(2 + 5 * k + ceil(bits / 8) AS BIGINT) AS payload_bytes, round((8 * (2 + 5 * k) + bits) / n, 6) AS avg_code_length FROM t")
def _(s, d):
    e = lossless.encode(T.items(s, d), HUFFMAN)
    n = F.octet_length("payload").cast("long")
    return e.select("blob_id", n.alias("payload_bytes"), N.rounded(lossless.average_code_length(F.octet_length("content"), n, F.col("padding_bits")), 6).alias("avg_code_length"))


@query(
    "coding_efficiency",
    _HUFFMAN + """, m AS (SELECT item_id, h, (8 * (2 + 5 * k) + bits) / n AS l, n, k FROM t JOIN e USING (item_id))
SELECT item_id AS blob_id, round(h, 6) AS entropy, round(h / l * 100, 6) AS efficiency, round(l - h, 6) AS gap, CAST(n AS BIGINT) AS n_symbols, k AS n_unique,
CASE WHEN h / l >= 0.95 THEN 'Near-optimal.' WHEN h / l >= 0.8 THEN 'Good efficiency; moderate redundancy.' WHEN h / l >= 0.6 THEN 'Moderate efficiency.' ELSE 'Low efficiency; significant redundancy.' END AS band FROM m""",
)
def _(s, d):
    a = lossless.analyze(lossless.encode(T.items(s, d), HUFFMAN))
    return a.select(
        "blob_id", N.rounded("entropy", 6).alias("entropy"), N.rounded("efficiency", 6).alias("efficiency"), N.rounded(F.col("avg_code_length") - F.col("entropy"), 6).alias("gap"),
        "n_symbols", F.col("n_unique").cast("long").alias("n_unique"), N.efficiency_band(F.least(F.col("efficiency"), F.lit(100.0))).alias("band"),
    )


@query("huffman_payload_hex", _TABLE.replace("WITH", "WITH RECURSIVE") + f""", g AS (SELECT item_id, list(h ORDER BY h) AS hs, list(n ORDER BY h) AS ns FROM c GROUP BY item_id),
r AS (SELECT item_id, 0 AS step, list_sort(list_transform(range(1, len(hs) + 1), lambda i: {{'n': ns[i], 'o': i, 'm': [hs[i]]}})) AS l, []::VARCHAR[] AS zero, []::VARCHAR[] AS one, len(hs) AS k FROM g
 UNION ALL SELECT item_id, step + 1, list_sort(list_append(l[3:], {{'n': l[1].n + l[2].n, 'o': k + step + 1, 'm': list_concat(l[1].m, l[2].m)}})), l[1].m, l[2].m, k FROM r WHERE len(l) > 1),
u AS (SELECT item_id, step, unnest(zero) AS h, '0' AS bit FROM r UNION ALL SELECT item_id, step, unnest(one), '1' FROM r),
code AS (SELECT item_id, h, string_agg(bit, '' ORDER BY step DESC) AS code FROM u GROUP BY ALL),
b AS (SELECT item_id, generate_subscripts(l, 1) AS i, unnest(l) AS h FROM (SELECT item_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM benchmark)),
s AS (SELECT item_id, string_agg(code, '' ORDER BY i) AS bits FROM b JOIN code USING (item_id, h) GROUP BY item_id),
p AS (SELECT item_id, bits || repeat('0', CAST((8 - length(bits) % 8) % 8 AS INTEGER)) AS full_bits, CAST((8 - length(bits) % 8) % 8 AS INTEGER) AS pad FROM s),
w AS (SELECT item_id, printf('%04X', count(*)) || string_agg(h || printf('%08X', n), '' ORDER BY h) AS head FROM c GROUP BY item_id)
SELECT item_id AS blob_id, head || {_FULL_BYTES.format(bits="full_bits")} AS payload, pad AS padding_bits FROM p JOIN w USING (item_id)""")
def _(s, d):
    return lossless.encode(T.items(s, d), HUFFMAN).select("blob_id", F.hex("payload").alias("payload"), "padding_bits")


_ROUND_TRIP = "SELECT doc_id AS blob_id, md5(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents"


def _round_trip(algorithm):
    def run(s, d):
        r = lossless.decode(lossless.encode(T.blobs(s, d).select("blob_id", "content"), algorithm, strict=True).select("blob_id", "payload", "padding_bits"), algorithm, strict=True)
        return r.select("blob_id", F.md5("restored").alias("digest"), F.octet_length("restored").cast("long").alias("n_bytes"))

    return run


for _name, _algorithm in (("huffman_roundtrip", HUFFMAN), ("lz78_roundtrip", LZ78), ("chained_roundtrip", CHAINED)):
    query(_name, _ROUND_TRIP)(_round_trip(_algorithm))


#: LZ78 parsing: the open phrase grows by one byte until it is new.
_LZ = """WITH RECURSIVE b AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark),
r AS (SELECT item_id, h, 0 AS pos, '' AS open, []::VARCHAR[] AS known, 0 AS idx, 0 AS num, '' AS ch, FALSE AS said FROM b
 UNION ALL SELECT item_id, h, pos + 1,
   CASE WHEN list_contains(known, open || h[2 * pos + 1:2 * pos + 2]) THEN open || h[2 * pos + 1:2 * pos + 2] ELSE '' END,
   CASE WHEN list_contains(known, open || h[2 * pos + 1:2 * pos + 2]) THEN known ELSE list_append(known, open || h[2 * pos + 1:2 * pos + 2]) END,
   coalesce(list_position(known, open), 0), len(known) + 1, h[2 * pos + 1:2 * pos + 2], NOT list_contains(known, open || h[2 * pos + 1:2 * pos + 2])
 FROM r WHERE 2 * pos < length(h)),
t AS (SELECT item_id, num AS k, idx, CAST(('0x' || ch)::INTEGER AS INTEGER) AS ch FROM r WHERE said
 UNION ALL SELECT item_id, len(known) + 1, list_position(known, open), NULL FROM r WHERE 2 * pos = length(h) AND open <> '') """


@query("lz78_tokens", _LZ + "SELECT item_id AS blob_id, CAST(k AS BIGINT) AS k, CAST(idx AS BIGINT) AS idx, ch FROM t")
def _(s, d):
    t = T.items(s, d).select("blob_id", F.posexplode(lz78_tokens("content")).alias("k", "t"))
    return t.select("blob_id", (F.col("k") + 1).cast("long").alias("k"), F.col("t.idx").alias("idx"), F.col("t.ch").cast("int").alias("ch"))


_WIDTH = "CASE WHEN k <= 2 THEN 1 ELSE length(bin(k - 1)) END"


@query("lz78_payload_bits", _LZ + f"SELECT item_id AS blob_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(5 + ceil(sum({_WIDTH} + CASE WHEN ch IS NULL THEN 1 ELSE 9 END) / 8) AS BIGINT) AS payload_bytes FROM t GROUP BY item_id")
def _(s, d):
    e = lossless.encode(T.items(s, d), LZ78)
    return e.select("blob_id", B.unsigned(F.col("payload"), 0, 4).alias("n_tokens"), F.octet_length("payload").cast("long").alias("payload_bytes"))


_LZ_HEX = _LZ + f""", w AS (SELECT item_id, k, {_WIDTH} AS w, idx, ch FROM t),
s AS (SELECT item_id, count(*) AS n, string_agg(right(lpad(bin(idx), 64, '0'), CAST(w AS INTEGER)) || CASE WHEN ch IS NULL THEN '0' ELSE '1' || lpad(bin(ch), 8, '0') END, '' ORDER BY k) AS bits FROM w GROUP BY item_id),
p AS (SELECT item_id, n, bits || repeat('0', CAST((8 - length(bits) % 8) % 8 AS INTEGER)) AS full_bits, (8 - length(bits) % 8) % 8 AS pad FROM s),
x AS (SELECT item_id, printf('%08X', n) || printf('%02X', pad) || {_FULL_BYTES.format(bits="full_bits")} AS payload FROM p) """


@query("lz78_payload_hex", _LZ_HEX + "SELECT item_id AS blob_id, payload FROM x")
def _(s, d):
    return lossless.encode(T.items(s, d), LZ78).select("blob_id", F.hex("payload").alias("payload"))


_SIZE = "SELECT item_id AS blob_id, {a} AS algorithm_id, CAST(2 + 5 * k + ceil(bits / 8) AS BIGINT) AS payload_bytes, CAST((8 - bits % 8) % 8 AS INTEGER) AS padding_bits FROM {t}"


@query("codec_sizes", _LZ_HEX + f", c1 AS (SELECT item_id, h, count(*) AS n FROM (SELECT item_id, {_BYTES} FROM benchmark) GROUP BY ALL)" + _CODE_BITS.format(c="c1", g="g1", r="r1", t="t1")
    + ", c3 AS (SELECT item_id, h, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(payload, '..')) AS h FROM x) GROUP BY ALL)" + _CODE_BITS.format(c="c3", g="g3", r="r3", t="t3")
    + _SIZE.format(a=1, t="t1") + " UNION ALL SELECT item_id, 2, CAST(length(payload) // 2 AS BIGINT), 0 FROM x UNION ALL " + _SIZE.format(a=3, t="t3"))
def _(s, d):
    return lossless.compare(T.items(s, d)).select("blob_id", "algorithm_id", "payload_bytes", "padding_bits")


@query("lz78_index_width", f"SELECT k, CAST({_WIDTH} AS INTEGER) AS width FROM range(1, 5000) t(k)")
def _(s, d):
    return s.range(1, 5000).select(F.col("id").alias("k"), lossless.index_width(F.col("id")).cast("int").alias("width"))


@query("codec_router", """SELECT doc_id AS blob_id, CAST(doc_id % 5 AS INTEGER) AS algorithm_id, CASE WHEN doc_id % 5 IN (1, 2, 3) THEN md5(text) END AS digest,
CASE WHEN doc_id % 5 NOT IN (1, 2, 3) THEN 'no byte codec ' || (doc_id % 5) END AS error FROM documents""")
def _(s, d):
    c = lossless.compress(T.blobs(s, d).select("blob_id", "content", (F.col("blob_id") % 5).cast("int").alias("algorithm_id")))
    r = lossless.decompress(c.select("blob_id", "algorithm_id", "payload", "padding_bits"))
    return r.select("blob_id", "algorithm_id", F.md5("restored").alias("digest"), "error")


@query("codec_report")
def flagship(s, d):
    """Codec by language: sizes, lengths and efficiency, each blob coded once by every codec."""
    out = lossless.compare(T.blobs(s, d).select("blob_id", "lang", "content")).withColumn("algorithm", H.algorithm_label(F.col("algorithm_id")))
    size = F.sum("payload_bytes")
    return out.groupBy("algorithm", "lang").agg(
        F.count(F.lit(1)).alias("blobs"), F.sum("n_symbols").alias("raw_bytes"), size.alias("payload_bytes"), N.rounded(size / F.sum("n_symbols"), 6).alias("ratio"),
        N.rounded(F.avg("entropy"), 6).alias("entropy"), N.rounded(F.avg("avg_code_length"), 6).alias("avg_code_length"), N.rounded(F.avg("efficiency"), 4).alias("efficiency"),
    )


@query("information_panel", _HUFFMAN + """, m AS (SELECT item_id, h, (8 * (2 + 5 * k) + bits) / n AS l, n, k FROM t JOIN e USING (item_id))
SELECT item_id AS blob_id, printf('%.4f bits/sym', h) AS entropy, printf('%.4f bits/sym', l) AS avg_code_length, printf('%.2f %%', least(h / l * 100, 100)) AS efficiency, k || '/256 unique values' AS alphabet FROM m""")
def _(s, d):
    a = lossless.analyze(lossless.encode(T.items(s, d), HUFFMAN))
    return a.select(
        "blob_id", N.fixed(F.col("entropy"), 4, "%.{n}f bits/sym").alias("entropy"), N.fixed(F.col("avg_code_length"), 4, "%.{n}f bits/sym").alias("avg_code_length"),
        N.fixed(F.least(F.col("efficiency"), F.lit(100.0)), 2, "%.{n}f %%").alias("efficiency"), F.concat(F.col("n_unique").cast("string"), F.lit("/256 unique values")).alias("alphabet"),
    )


# bits


@query("bits_pack", """WITH b AS (SELECT item_id, left(string_agg(lpad(bin(('0x' || h)::INTEGER), 8, '0'), '' ORDER BY i), CAST(8 * octet_length(encode(any_value(text))) - item_id % 8 AS INTEGER)) AS bits
 FROM (SELECT item_id, text, generate_subscripts(l, 1) AS i, unnest(l) AS h FROM (SELECT item_id, text, regexp_extract_all(hex(encode(text)), '..') AS l FROM benchmark)) GROUP BY item_id)
SELECT item_id, CAST(length(bits) AS BIGINT) AS n_bits, CAST((8 - length(bits) % 8) % 8 AS INTEGER) AS padding,
 array_to_string(list_transform(regexp_extract_all(bits || repeat('0', CAST((8 - length(bits) % 8) % 8 AS INTEGER)), '[01]{8}'), lambda x: printf('%02X', list_sum(list_transform(range(8), lambda i: CASE WHEN x[i + 1] = '1' THEN 1 << (7 - i)::INTEGER ELSE 0 END))::BIGINT)), '') AS packed FROM b""")
def _(s, d):
    b = T.items(s, d).select(F.col("blob_id").alias("item_id"), B.unpack(F.col("content"), (F.col("blob_id") % 8).cast("int")).alias("bits"))
    return b.select("item_id", F.length("bits").cast("long").alias("n_bits"), B.padding_bits(F.col("bits")).alias("padding"), F.hex(B.pack(F.col("bits"))).alias("packed"))


@query("bits_unpack", """SELECT item_id, md5(string_agg(lpad(bin(('0x' || h)::INTEGER), 8, '0'), '' ORDER BY i)) AS bits
 FROM (SELECT item_id, generate_subscripts(l, 1) AS i, unnest(l) AS h FROM (SELECT item_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM benchmark)) GROUP BY item_id""")
def _(s, d):
    return T.items(s, d).select(F.col("blob_id").alias("item_id"), F.md5(B.unpack(F.col("content"), F.lit(0)).cast("binary")).alias("bits"))


@query("bits_passthrough", "SELECT item_id, hex(encode(text)) AS packed, CAST(8 * octet_length(encode(text)) AS BIGINT) AS n_bits FROM benchmark")
def _(s, d):
    return T.items(s, d).select(F.col("blob_id").alias("item_id"), F.hex(B.repack(F.col("content"), F.lit(0))).alias("packed"), B.bit_count(F.col("content"), F.lit(0)).alias("n_bits"))


@query("fixed_width_rw", "SELECT v, w, right(lpad(bin(v), 64, '0'), CAST(w AS INTEGER)) AS bits, v % (1 << w::INTEGER) AS back FROM range(0, 300) a(v), range(1, 13) b(w)")
def _(s, d):
    t = s.range(300).select(F.col("id").alias("v")).crossJoin(F.broadcast(s.range(1, 13).select(F.col("id").alias("w"))))
    bits = B.fixed_width(F.col("v"), F.col("w").cast("int"))
    return t.select("v", "w", bits.alias("bits"), B.read_fixed(bits, 0, F.col("w").cast("int")).alias("back"))


# header


def _headers(s, d):
    n = F.col("blob_id")
    return T.items(s, d).select("blob_id", (n % 3 + 1).cast("int").alias("ft"), (n % 8 + 1).cast("int").alias("algo"), (n % 8).cast("int").alias("pad"), F.concat(F.lit("x"), (n % 7).cast("string")).alias("ext"))


@query("header_serialize", "SELECT item_id AS blob_id, '41524348' || printf('%02X%02X%02X02', item_id % 3 + 1, item_id % 8 + 1, item_id % 8) || hex(encode('x' || (item_id % 7))) AS header, 10 AS total_size FROM benchmark")
def _(s, d):
    h = _headers(s, d)
    return h.select("blob_id", F.hex(H.serialize(F.col("ft"), F.col("algo"), F.col("pad"), F.col("ext"))).alias("header"), H.total_size(F.col("ext")).alias("total_size"))


@query("header_parse", "SELECT item_id AS blob_id, CAST(item_id % 3 + 1 AS INTEGER) AS file_type, CAST(item_id % 8 + 1 AS INTEGER) AS algorithm_id, CAST(item_id % 8 AS INTEGER) AS padding_bits, 'x' || (item_id % 7) AS extension, 10 AS total_size, printf('Header(file_type=0x%02X, algorithm_id=0x%02X, padding_bits=%d, extension=''%s'')', item_id % 3 + 1, item_id % 8 + 1, item_id % 8, 'x' || (item_id % 7)) AS shown FROM benchmark")
def _(s, d):
    h = _headers(s, d).select("blob_id", H.parse(H.serialize(F.col("ft"), F.col("algo"), F.col("pad"), F.col("ext"))).alias("h"))
    return h.select("blob_id", "h.file_type", "h.algorithm_id", "h.padding_bits", "h.extension", "h.total_size", H.describe(F.col("h.file_type"), F.col("h.algorithm_id"), F.col("h.padding_bits"), F.col("h.extension")).alias("shown"))


@query("audio_header_serialize", """SELECT item_id, '41524348' || printf('03%02X%02X03776176', item_id % 4 + 5, item_id % 8) || printf('%02X%02X%04X%04X%08X%08X%04X', 1 << (item_id % 3)::INTEGER, item_id % 8 + 1,
 CAST(item_id * 10 AS BIGINT), CAST(item_id * 100 AS BIGINT), 44100 + item_id, 8000, 1) AS header FROM benchmark""")
def _(s, d):
    n = F.col("blob_id")
    h = H.serialize_audio(n % 4 + 5, n % 8, F.lit("wav"), F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), n % 3).cast("int"), n % 8 + 1, n / 100.0, n / 100.0, n + 44100, F.lit(8000), F.lit(1))
    return T.items(s, d).select(n.alias("item_id"), F.hex(h).alias("header"))


@query("audio_header_parse", """SELECT item_id, CAST(item_id % 4 + 5 AS INTEGER) AS algorithm_id, CAST(1 << (item_id % 3)::INTEGER AS INTEGER) AS sampling_factor, CAST(item_id % 8 + 1 AS INTEGER) AS bits,
 round(item_id / 100, 4) AS delta_step, round(item_id / 100, 4) AS alpha, CAST(44100 + item_id AS BIGINT) AS original_length, CAST(8000 AS BIGINT) AS sample_rate, 27 AS total_size FROM benchmark""")
def _(s, d):
    n = F.col("blob_id")
    h = H.serialize_audio(n % 4 + 5, n % 8, F.lit("wav"), F.pow(F.lit(2), n % 3).cast("int"), n % 8 + 1, n / 100.0, n / 100.0, n + 44100, F.lit(8000), F.lit(1))
    p = T.items(s, d).select(n.alias("item_id"), H.parse_audio(h).alias("h"))
    return p.select("item_id", "h.algorithm_id", "h.sampling_factor", "h.bits", N.rounded("h.delta_step", 4).alias("delta_step"), N.rounded("h.alpha", 4).alias("alpha"), "h.original_length", "h.sample_rate", "h.total_size")


_BROKEN = ["", "41524348010103", "41524349010103006E", "4152434809010300", "4152434801090300", "4152434801010800", "41524348010103036E67", "4152434801010302C3A9", "4152434801010303706E67"]


@query("header_errors", "SELECT * FROM (VALUES " + ", ".join(f"('{h}', {e})" for h, e in zip(_BROKEN, ["'short'", "'short'", "'magic'", "'file_type'", "'algorithm_id'", "'padding_bits'", "'extension_truncated'", "'extension_ascii'", "NULL"], strict=True)) + ") t(data, error)")
def _(s, d):
    t = s.range(1).select(F.explode(F.array(*map(F.lit, _BROKEN))).alias("data"))
    return t.select("data", H.parse(F.unhex("data"))["error"].alias("error"))


@query("header_validation", """SELECT ft, pad, CASE WHEN pad > 7 THEN 'padding_bits' WHEN ft NOT BETWEEN 1 AND 3 THEN 'file_type' END AS error,
 CASE WHEN pad NOT IN (1, 2, 4) THEN 'sampling_factor' WHEN ft NOT BETWEEN 1 AND 8 THEN 'bits' WHEN ft = 3 THEN 'original_length' END AS audio_error FROM range(0, 6) a(ft), range(0, 10) b(pad)""")
def _(s, d):
    t = s.range(6).select(F.col("id").alias("ft")).crossJoin(F.broadcast(s.range(10).select(F.col("id").alias("pad"))))
    length = F.when(F.col("ft") == 3, -1).otherwise(5)
    return t.select("ft", "pad", H.error(F.col("ft"), F.lit(1), F.col("pad"), F.lit("txt")).alias("error"), H.audio_error(F.col("pad"), F.col("ft"), length, F.lit(8000), F.lit(1)).alias("audio_error"))


@query("algorithm_labels", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in ALGORITHM_LABELS.items()) + ", (99, NULL)) t(id, label)")
def _(s, d):
    t = s.range(1).select(F.explode(F.array(*map(F.lit, [*ALGORITHM_LABELS, 99]))).alias("id"))
    return t.select("id", H.algorithm_label(F.col("id")).alias("label")).where(H.algorithm_id(F.col("label")).eqNullSafe(F.when(F.col("id") < 99, F.col("id"))))


@query("file_type_labels", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in FILE_TYPE_LABELS.items()) + ") t(id, label)")
def _(s, d):
    t = s.range(1).select(F.explode(F.array(*map(F.lit, FILE_TYPE_LABELS))).alias("id"))
    return t.select(H.file_type_id(H.file_type_label(F.col("id"))).alias("id"), H.file_type_label(F.col("id")).alias("label"))


@query("router_counts", "SELECT CASE WHEN doc_id % 3 + 1 = 3 THEN 'audio' WHEN doc_id % 8 + 1 = 4 THEN 'image' ELSE 'bytes' END AS kind, count(*) AS n FROM documents GROUP BY ALL")
def _(s, d):
    n = F.col("blob_id")
    return T.blobs(s, d).groupBy(H.route(n % 3 + 1, n % 8 + 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("parameter_blanking", """SELECT algo, CASE WHEN algo = 5 THEN 4 ELSE 1 END AS sampling_factor, CASE WHEN algo IN (6, 7) THEN 0.05 ELSE 0.0 END::DOUBLE AS delta_step, CASE WHEN algo = 8 THEN 0.9 ELSE 0.0 END::DOUBLE AS alpha FROM range(5, 9) t(algo)""")
def _(s, d):
    return s.range(5, 9).select(F.col("id").alias("algo"), H.blanked(F.col("id"), F.lit(4), F.lit(0.05), F.lit(0.9)).alias("p")).select("algo", "p.*")


@query("archive_status", """SELECT doc_id AS blob_id, 'bytes' AS kind, 'LZ78' AS algorithm, 'Binary File / PDF' AS file_type_label, 'txt' AS extension, 11 AS header_bytes, md5(text) AS digest, 'doc' || doc_id || '_restored.txt' AS restored_name FROM documents""")
def _(s, d):
    b = T.blobs(s, d).select("blob_id", "name", "content")
    a = archive.pack(lossless.encode(b, LZ78), LZ78).select("blob_id", F.concat(N.stem(F.col("name")), F.lit(".abc")).alias("name"), "archive")
    return archive.restore(a, also=("file_type_label", "header_bytes")).select("blob_id", "kind", "algorithm", "file_type_label", "extension", "header_bytes", F.md5("restored").alias("digest"), "restored_name")


@query("archive_internals", _LZ_HEX + """SELECT item_id AS blob_id, '0x02' AS algorithm, 'Binary File / PDF' AS file_type, 11 AS header_bytes, CAST(length(payload) // 2 AS BIGINT) AS payload_bytes,
 CAST(4 * length(payload) AS BIGINT) AS logical_bits, 0 AS padding_bits FROM x""")
def _(s, d):
    st = archive.status(archive.pack(lossless.encode(T.items(s, d), LZ78), LZ78).select("blob_id", "archive"))
    return st.select(
        "blob_id", F.concat(F.lit("0x"), F.lpad(F.hex(F.col("algorithm_id").cast("long")), 2, "0")).alias("algorithm"), F.col("file_type_label").alias("file_type"), "header_bytes",
        F.col("payload_bytes").cast("long").alias("payload_bytes"), F.col("logical_bits").cast("long").alias("logical_bits"), "padding_bits",
    )


@query("audio_archive_status", """SELECT vec_id AS id, 4 AS bits, 2 AS sampling_factor, 8000::BIGINT AS sample_rate, 64::BIGINT AS original_length, 1 AS n_channels, 24::BIGINT AS payload_bytes, 192::BIGINT AS logical_bits FROM embeddings""")
def _(s, d):
    sig = T.signals(s, d).select(F.col("sig_id").alias("id"), F.format_string("sig%d.wav", "sig_id").alias("name"), "sample_rate", "signal", F.size("signal").alias("original_length"))
    st = archive.status(archive.pack_audio(audio.encode(sig, PCM, sampling_factor=2, bits=4), PCM, sampling_factor=2, bits=4).select("id", "archive"))
    return st.select("id", "bits", "sampling_factor", "sample_rate", "original_length", "n_channels", F.col("payload_bytes").cast("long").alias("payload_bytes"), F.col("logical_bits").cast("long").alias("logical_bits"))


# files


def _item_archives(s, d):
    b = T.items(s, d).select("blob_id", "name", "content")
    return archive.pack(lossless.encode(b, HUFFMAN), HUFFMAN).select("name", "archive")


@query("archive_files", "SELECT 'item' || item_id || '.txt.abc' AS name, 1 AS file_type, 1 AS algorithm_id, 'txt' AS extension, 11 AS header_bytes, md5(text) AS digest, CAST(NULL AS VARCHAR) AS error FROM benchmark".replace("1 AS file_type", "2 AS file_type"))
def _(s, d):
    """Archives written as files, scanned again and decoded."""
    from bitloom.sources import arc
    from bitloom.streaming.runs import shared_folder

    arc.register(s)
    out = shared_folder(s, "archives")
    _item_archives(s, d).write.format("arc").mode("append").save(out)
    a = s.read.format("arc").load(out)
    r = archive.restore(a.select("name", "archive")).select("name", F.md5("restored").alias("digest"))
    return a.join(r, "name").select("name", "file_type", "algorithm_id", "extension", "header_bytes", "digest", "error")


@query("restored_files", "SELECT 'item' || item_id || '_restored.txt' AS name, CAST(octet_length(encode(text)) AS BIGINT) AS length, md5(text) AS digest FROM benchmark")
def _(s, d):
    """Restored files in a folder under their own names, read again as uploads."""
    from bitloom.sources import arc
    from bitloom.streaming.runs import shared_folder

    arc.register(s)
    out = shared_folder(s, "restored")
    archives = _item_archives(s, d).withColumn("name", F.concat(N.stem(F.col("name")), F.lit(".abc")))
    archive.restore(archives).select("restored_name", "restored").write.format("restored").mode("append").save(out)
    return media.read_blobs(s, out).select("name", "length", F.md5("content").alias("digest"))


@query("png_files", "SELECT 'item' || item_id || '_restored.png' AS name, 1 AS h, CAST(octet_length(encode(text)) // 3 AS INTEGER) AS w, 3 AS channels, left(hex(encode(text)), CAST(octet_length(encode(text)) // 3 * 6 AS INTEGER)) AS pixels, CAST(NULL AS VARCHAR) AS error FROM benchmark")
def _(s, d):
    """RGB pictures coded at 8 bits, restored as PNG files and read by the JVM's picture reader."""
    from bitloom.sources import arc
    from bitloom.streaming.runs import shared_folder

    arc.register(s)
    out = shared_folder(s, "pictures")
    flat, shapes = T.rgb_samples(s, d)
    packed = archive.pack_image(image.encode(flat, shapes, 8).withColumn("name", F.format_string("item%d.png", "img_id")))
    archives = packed.select(F.concat(N.stem(F.col("name")), F.lit(".abc")).alias("name"), "archive")
    archive.restore(archives).select("restored_name", "restored").write.format("restored").mode("append").save(out)
    return image.read_images(s, out).select(F.substring_index("origin", "/", -1).alias("name"), "h", "w", "channels", F.hex("pixels").alias("pixels"), "error")


@query("archive_restore_mixed", """SELECT vec_id AS id, 'audio' AS kind, 'sig' || vec_id || '_restored.wav' AS restored_name, CAST(44 + 2 * 64 AS BIGINT) AS n_bytes FROM embeddings
 UNION ALL SELECT item_id, 'bytes', 'item' || item_id || '_restored.txt', octet_length(encode(text)) FROM benchmark""")
def _(s, d):
    sig = T.signals(s, d).select(F.col("sig_id").alias("id"), F.format_string("sig%d.wav", "sig_id").alias("name"), "sample_rate", "signal", F.size("signal").alias("original_length"))
    w = archive.pack_audio(audio.encode(sig, PCM, sampling_factor=2, bits=4), PCM, sampling_factor=2, bits=4)
    i = T.items(s, d).select(F.col("blob_id").alias("id"), "name", "content")
    b = archive.pack(lossless.encode(i, HUFFMAN), HUFFMAN)
    both = w.select("id", "name", "archive").unionByName(b.select("id", "name", "archive"))
    return archive.restore(both).select("id", "kind", "restored_name", F.octet_length("restored").cast("long").alias("n_bytes"))


# pictures


_RGB = """SELECT item_id AS img_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS x FROM (SELECT item_id, regexp_extract_all(hex(encode(text)), '......') AS l FROM benchmark)"""
_R, _G, _B = (f"('0x' || x[{k}:{k + 1}])::INTEGER" for k in (1, 3, 5))
_Y32 = f"0.299::FLOAT * ({_R})::FLOAT + 0.587::FLOAT * ({_G})::FLOAT + 0.114::FLOAT * ({_B})::FLOAT"


@query("gray_luma", f"SELECT img_id, CAST(pos AS INTEGER) AS pos, CAST(floor(least(greatest({_Y32}, 0), 255)) AS INTEGER) AS y FROM ({_RGB})")
def _(s, d):
    return T.rgb(s, d).select("img_id", "pos", image.luma(F.col("r"), F.col("g"), F.col("b")).alias("y"))


@query("quantize_image", f"SELECT img_id, CAST(pos AS INTEGER) AS pos, q, CAST((v >> (8 - q)::INTEGER) << (8 - q)::INTEGER AS INTEGER) AS v FROM ({_IMG}), range(1, 9) t(q)")
def _(s, d):
    p = T.pictures(s, d)
    return p.select("img_id", "pos", F.explode(F.array(*[F.struct(F.lit(q).cast("long").alias("q"), image.quantize(F.col("v"), q).alias("v")) for q in range(1, 9)])).alias("x")).select("img_id", "pos", "x.q", "x.v")


def _runs_sql(value: str) -> str:
    return f"""WITH p AS (SELECT img_id, pos, {value} AS v FROM ({_IMG})), f AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS fresh FROM p WINDOW w AS (PARTITION BY img_id ORDER BY pos)),
n AS (SELECT img_id, v, sum(fresh) OVER (PARTITION BY img_id ORDER BY pos) - 1 AS run FROM f), r AS (SELECT img_id, CAST(run AS BIGINT) AS run, any_value(v) AS v, count(*) AS n FROM n GROUP BY img_id, run) """


@query("rle_tokens", _runs_sql("(v >> 4) << 4") + "SELECT img_id, run, CAST(v AS INTEGER) AS v, n FROM r")
def _(s, d):
    return image.runs(T.pictures(s, d).withColumn("v", image.quantize(F.col("v"), 4)), ["img_id"])


@query("rle_payload", _runs_sql("(v >> 4) << 4") + "SELECT img_id, '000000080000000801' || '04' || '00000040' || printf('%08X', count(*)) || '00' || string_agg(printf('%02X%04X', v, n), '' ORDER BY run) AS payload FROM r GROUP BY img_id")
def _(s, d):
    p = T.pictures(s, d)
    return image.encode(p, T.shapes(p), 4).select("img_id", F.hex("payload").alias("payload"))


@query("rle_payload_rgb", f"""WITH q AS (SELECT img_id, 3 * pos + c AS pos, (CASE c WHEN 0 THEN {_R} WHEN 1 THEN {_G} ELSE {_B} END >> 4) << 4 AS v FROM ({_RGB}), range(3) u(c)),
f AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS fresh FROM q WINDOW w AS (PARTITION BY img_id ORDER BY pos)),
n AS (SELECT img_id, v, sum(fresh) OVER (PARTITION BY img_id ORDER BY pos) - 1 AS run FROM f), r AS (SELECT img_id, run, any_value(v) AS v, count(*) AS n FROM n GROUP BY img_id, run)
SELECT img_id, printf('%08X%08X', 1, CAST(sum(n) // 3 AS BIGINT)) || '0304' || printf('%08X%08X', CAST(sum(n) AS BIGINT), count(*)) || '00' || string_agg(printf('%02X%04X', CAST(v AS BIGINT), n), '' ORDER BY run) AS payload FROM r GROUP BY img_id""")
def _(s, d):
    flat, shapes = T.rgb_samples(s, d)
    return image.encode(flat, shapes, 4).select("img_id", F.hex("payload").alias("payload"))


@query("rle_roundtrip_rgb", f"SELECT img_id, array_to_string(list(printf('%02X%02X%02X', CAST(({_R} >> 3) << 3 AS BIGINT), CAST(({_G} >> 3) << 3 AS BIGINT), CAST(({_B} >> 3) << 3 AS BIGINT)) ORDER BY pos), '') AS pixels, 3 AS channels FROM ({_RGB}) GROUP BY img_id")
def _(s, d):
    flat, shapes = T.rgb_samples(s, d)
    r = image.decode(image.encode(flat, shapes, 5))
    return r.select("img_id", F.array_join(F.transform("v", lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "").alias("pixels"), F.col("channels").cast("int").alias("channels"))


@query("rle_roundtrip", f"SELECT img_id, array_to_string(list(printf('%02X', (v >> 3) << 3) ORDER BY pos), '') AS pixels FROM ({_IMG}) GROUP BY img_id")
def _(s, d):
    p = T.pictures(s, d)
    r = image.decode(image.encode(p, T.shapes(p), 5))
    return r.select("img_id", F.array_join(F.transform("v", lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "").alias("pixels"))


@query("rle_long_runs", "SELECT * FROM (VALUES (65534, 1, 65534), (65535, 1, 65535), (65536, 2, 1), (131071, 3, 1)) t(n, runs, last)")
def _(s, d):
    t = s.range(1).select(F.explode(F.array(*map(F.lit, (65534, 65535, 65536, 131071)))).alias("size")).select("size", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("pos"), F.lit(7).alias("v"))
    r = image.runs(t, ["size"])
    return r.groupBy("size").agg(F.count(F.lit(1)).alias("runs"), F.max_by("n", "run").alias("last")).select(F.col("size").alias("n"), "runs", "last")


@query("image_info", _runs_sql("(v >> 4) << 4") + "SELECT img_id, 8 AS height, 8 AS width, 1 AS channels, 4 AS quantize_bits, 64 AS total_pixels, count(*) AS n_runs FROM r GROUP BY img_id")
def _(s, d):
    p = T.pictures(s, d)
    return image.encode(p, T.shapes(p), 4).select("img_id", image.get_info(F.col("payload")).alias("i")).select("img_id", "i.*")


def _mse_sql(q: int) -> str:
    return f"""WITH m AS (SELECT img_id, sum((v - ((v >> {8 - q}) << {8 - q}))::DOUBLE ** 2) / count(*) AS mse, count(*) AS n_pixels FROM ({_IMG}) GROUP BY img_id),
p AS (SELECT *, CASE WHEN mse > 0 THEN 10 * log10(65025 / CASE WHEN mse > 0 THEN mse END) END AS psnr FROM m) """


def _image_errors(s, d, q):
    p = T.pictures(s, d)
    e = image.encode(p, T.shapes(p), q).select("img_id", F.octet_length("payload").alias("payload_bytes"), F.lit(64).alias("raw_bytes"))
    return image.errors(p, p.withColumn("v", image.quantize(F.col("v"), q)), e)


@query("image_mse_psnr", _mse_sql(5) + "SELECT img_id, round(mse, 4) AS mse, round(psnr, 4) AS psnr, coalesce(printf('%.4f dB', psnr), 'Infinity') AS psnr_str, n_pixels, mse = 0 AS is_lossless FROM p")
def _(s, d):
    return _image_errors(s, d, 5).select("img_id", N.rounded("mse", 4).alias("mse"), N.rounded("psnr", 4).alias("psnr"), "psnr_str", "n_pixels", "is_lossless")


_PSNR = "CASE WHEN psnr IS NULL THEN 'Lossless (∞)' WHEN psnr >= 40 THEN 'Excellent' WHEN psnr >= 35 THEN 'Very Good' WHEN psnr >= 30 THEN 'Good' WHEN psnr >= 25 THEN 'Acceptable' ELSE 'Distorted' END"
_CSS = "CASE WHEN psnr IS NULL THEN 'psnr-inf' WHEN psnr >= 40 THEN 'psnr-exc' WHEN psnr >= 35 THEN 'psnr-good' WHEN psnr >= 30 THEN 'psnr-fair' WHEN psnr >= 25 THEN 'psnr-poor' ELSE 'psnr-bad' END"


@query("psnr_bands", _mse_sql(4) + f"SELECT {_PSNR} AS label, {_CSS} AS css, count(*) AS n FROM p GROUP BY ALL")
def _(s, d):
    e = _image_errors(s, d, 4)
    return e.groupBy(N.psnr_label(F.col("psnr")).alias("label"), N.psnr_css(F.col("psnr")).alias("css")).agg(F.count(F.lit(1)).alias("n"))


@query("image_panel", _runs_sql("(v >> 3) << 3") + """SELECT img_id, printf('%.4f×', (19 + 3 * count(*)) / 64) AS compression_ratio, CASE WHEN (1 - (19 + 3 * count(*)) / 64) > 0 THEN printf('%+.2f%% reduction', (1 - (19 + 3 * count(*)) / 64) * 100) ELSE printf('%.2f%% increase', -(1 - (19 + 3 * count(*)) / 64) * 100) END AS change FROM r GROUP BY img_id""")
def _(s, d):
    pct = (1.0 - F.col("compression_ratio")) * 100.0
    return _image_errors(s, d, 5).select("img_id", N.fixed(F.col("compression_ratio"), 4, "%.{n}f×").alias("compression_ratio"), F.when(pct > 0, N.fixed(pct, 2, "%+.{n}f%% reduction")).otherwise(N.fixed(-pct, 2, "%.{n}f%% increase")).alias("change"))


@query("image_kernel_agrees", f"SELECT img_id, TRUE AS same FROM (SELECT DISTINCT img_id FROM ({_IMG}))")
def _(s, d):
    """The picture kernel and the relational coder write the same bytes."""
    from bitloom.functions.udfs import image_encoder

    p = T.pictures(s, d)
    flat = p.groupBy("img_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: F.lpad(F.hex(x.v.cast("long")), 2, "0")), "").alias("h"))
    k = flat.select("img_id", image_encoder(False, 3)(F.lit(8), F.lit(8), F.lit(1), F.unhex("h")).alias("kernel"))
    return image.encode(p, T.shapes(p), 3).join(k, "img_id").select("img_id", (F.col("payload") == F.col("kernel")).alias("same"))


# waveforms


_PCM = """list_transform(s, lambda v: least({m}, CAST(trunc((v::DOUBLE - list_min(s)::DOUBLE) / (list_max(s)::DOUBLE - list_min(s)::DOUBLE) * {l}) AS INTEGER)))"""


def _pcm_sql(b: int, k: int = 1) -> str:
    keep = "s" if k == 1 else f"list_filter(s, lambda v, i: (i - 1) % {k} = 0)"
    return f"WITH g AS ({_SIG}), x AS (SELECT sig_id, {keep} AS s FROM g), p AS (SELECT sig_id, s, {_PCM.format(m=(1 << b) - 1, l=1 << b)} AS k FROM x) "


for _b in range(1, 9):

    @query(f"pcm_indices_b{_b}", _pcm_sql(_b) + "SELECT sig_id, array_to_string(k, ',') AS indices FROM p")
    def _(s, d, b=_b):
        return T.signals(s, d).select("sig_id", F.array_join(audio.pcm_indices(F.col("signal"), b), ",").alias("indices"))


for _k in (2, 4):

    @query(f"pcm_downsample_{_k}", _pcm_sql(4, _k) + "SELECT sig_id, len(s)::INTEGER AS n, array_to_string(k, ',') AS indices FROM p")
    def _(s, d, k=_k):
        i = audio.pcm_indices(F.col("signal"), 4, k)
        return T.signals(s, d).select("sig_id", F.size(i).alias("n"), F.array_join(i, ",").alias("indices"))


_LEVEL = "CAST(list_min(s)::DOUBLE + (i + 0.5) * ((list_max(s)::DOUBLE - list_min(s)::DOUBLE) / {l}) AS FLOAT)"


@query("pcm_roundtrip", _pcm_sql(4, 2) + f"SELECT sig_id, list_transform(range(64), lambda j: round(list_transform(k, lambda i: {_LEVEL.format(l=16)})[j // 2 + 1]::DOUBLE, 5)) AS x FROM p")
def _(s, d):
    sig = T.signals(s, d).withColumn("original_length", F.size("signal"))
    r = audio.decode(audio.encode(sig, PCM, sampling_factor=2, bits=4), PCM, sampling_factor=2, bits=4)
    return r.select("sig_id", F.transform("restored", lambda v: N.rounded(v.cast("double"), 5)).alias("x"))


@query("upsample", "SELECT vec_id AS sig_id, list_transform(range(66), lambda j: CASE WHEN j < 64 THEN embedding[j // 2 * 2 + 1] ELSE 0 END) AS x FROM embeddings")
def _(s, d):
    return T.signals(s, d).select("sig_id", audio.upsample(audio.downsample(F.col("signal"), 2), 2, F.lit(66)).alias("x"))


def _sqnr_sql(y: str) -> str:
    return f"10 * log10(list_sum(list_transform(s, lambda v: v::DOUBLE * v::DOUBLE)) / list_sum(list_transform(range(1, len(s) + 1), lambda j: (s[j]::DOUBLE - {y}::DOUBLE) ** 2)))"


@query("pcm_sqnr", _pcm_sql(6) + f", y AS (SELECT sig_id, s, list_transform(k, lambda i: {_LEVEL.format(l=64)}) AS y FROM p) SELECT sig_id, round({_sqnr_sql('y[j]')}, 4) AS sqnr FROM y")
def _(s, d):
    x = T.signals(s, d).withColumn("k", audio.pcm_indices(F.col("signal"), 6)).withColumn("r", audio.value_range(F.col("signal")))
    return x.select("sig_id", N.rounded(audio.sqnr(F.col("signal"), audio.pcm_values(F.col("k"), 6, F.col("r.low"), F.col("r.high"))), 4).alias("sqnr"))


_EVENTS = "SELECT user_id AS sig_id, list(CAST(value / 500 AS FLOAT) ORDER BY ts, event_id) AS s FROM events GROUP BY user_id"


@query("pcm_event_sqnr", _pcm_sql(8).replace(_SIG, _EVENTS) + f", y AS (SELECT sig_id, s, list_transform(k, lambda i: {_LEVEL.format(l=256)}) AS y FROM p) SELECT sig_id, len(s) AS n, round({_sqnr_sql('y[j]')}, 4) AS sqnr FROM y")
def _(s, d):
    """Kernel path over the longer event signals."""
    sig = T.event_signals(s, d).withColumn("original_length", F.size("signal"))
    r = audio.decode(audio.encode(sig, PCM, bits=8), PCM, bits=8)
    return r.select("sig_id", F.col("original_length").cast("long").alias("n"), N.rounded(audio.sqnr(F.col("signal"), F.col("restored")), 4).alias("sqnr"))


@query("audio_panel", _pcm_sql(4) + f""", y AS (SELECT sig_id, s, list_transform(k, lambda i: {_LEVEL.format(l=16)}) AS y FROM p), q AS (SELECT sig_id, {_sqnr_sql('y[j]')} AS q FROM y)
SELECT sig_id, printf('%.2f dB', q) AS sqnr, 'Quality: ' || CASE WHEN q >= 40 THEN 'Excellent' WHEN q >= 30 THEN 'Good' WHEN q >= 20 THEN 'Acceptable' ELSE 'Distorted' END AS quality, '25.84 dB' AS theory, printf('%+.2f dB vs theory', q - 25.84) AS against_theory,
 printf('%.4f×', 40 / 172) AS ratio, '-' || printf('%.2f%%', (1 - 40 / 172) * 100) || ' saved' AS savings,
 CASE WHEN q >= 40 THEN 'Excellent quality — indistinguishable from original.' WHEN q >= 30 THEN 'Good quality — minor quantization noise.' WHEN q >= 20 THEN 'Acceptable — noticeable distortion.' ELSE 'Low quality — heavy quantization distortion.' END AS band, 64::BIGINT AS n_samples FROM q""")
def _(s, d):
    sig = T.signals(s, d).select("sig_id", "sample_rate", "signal", F.size("signal").alias("original_length"), F.octet_length(media.export_audio("signal", "sample_rate")).alias("original_bytes"))
    e = audio.encode(sig, PCM, bits=4).withColumn("payload_bytes", F.octet_length("payload"))
    r = audio.decode(e, PCM, bits=4)
    return audio.panel(r.select("sig_id", F.lit(PCM).alias("algorithm_id"), F.lit(4).alias("bits"), audio.sqnr(F.col("signal"), F.col("restored")).alias("sqnr"), F.col("original_length").alias("n_samples"), "original_bytes", "payload_bytes"))


@query("theoretical_sqnr", "SELECT b AS bits, round(6.02 * b + 1.76, 2)::DOUBLE AS sqnr FROM range(1, 25) t(b)")
def _(s, d):
    return s.range(1, 25).select(F.col("id").alias("bits"), N.rounded(audio.theoretical_sqnr(F.col("id")), 2).alias("sqnr"))


_DM = """WITH RECURSIVE g AS ({sig}), r AS (SELECT sig_id, s, 0 AS i, 0::DOUBLE AS y, '' AS bits, []::FLOAT[] AS ys FROM g
 UNION ALL SELECT sig_id, s, i + 1, CASE WHEN s[i + 1]::DOUBLE > y THEN least(1, y + {delta}) ELSE greatest(-1, y - {delta}) END, bits || CASE WHEN s[i + 1]::DOUBLE > y THEN '1' ELSE '0' END,
  list_append(ys, CAST(CASE WHEN s[i + 1]::DOUBLE > y THEN least(1, y + {delta}) ELSE greatest(-1, y - {delta}) END AS FLOAT)) FROM r WHERE i < len(s)),
z AS (SELECT sig_id, s, bits, ys FROM r WHERE i = len(s)) """.replace("{sig}", _SIG).replace("{delta}", "0.05::DOUBLE")
_ADM = """WITH RECURSIVE g AS ({sig}), r AS (SELECT sig_id, s, 0 AS i, 0::DOUBLE AS y, 0.05::DOUBLE AS d, -1 AS prev, '' AS bits, []::FLOAT[] AS ys FROM g
 UNION ALL SELECT sig_id, s, i + 1, CASE WHEN up = 1 THEN least(1, y + d) ELSE greatest(-1, y - d) END,
  CASE WHEN prev < 0 THEN d WHEN prev = up THEN least(1::DOUBLE, d * 1.5::DOUBLE) ELSE greatest(0.00001::DOUBLE, d / 1.5::DOUBLE) END, up, bits || up, list_append(ys, CAST(CASE WHEN up = 1 THEN least(1, y + d) ELSE greatest(-1, y - d) END AS FLOAT))
  FROM (SELECT *, CASE WHEN s[i + 1]::DOUBLE > y THEN 1 ELSE 0 END AS up FROM r WHERE i < len(s))),
z AS (SELECT sig_id, s, bits, ys FROM r WHERE i = len(s)) """.replace("{sig}", _SIG)
_DPCM = """WITH RECURSIVE g AS ({sig}), r AS (SELECT sig_id, s, 0 AS i, 0::DOUBLE AS y, []::INTEGER[] AS ks, []::FLOAT[] AS ys FROM g
 UNION ALL SELECT sig_id, s, i + 1, least(greatest(0.9::DOUBLE * y + (-2 + (k + 0.5::DOUBLE) * 0.25::DOUBLE), -1), 1), list_append(ks, k), list_append(ys, CAST(least(greatest(0.9::DOUBLE * y + (-2 + (k + 0.5::DOUBLE) * 0.25::DOUBLE), -1), 1) AS FLOAT))
  FROM (SELECT *, least(15, CAST(trunc((least(greatest(s[i + 1]::DOUBLE - 0.9::DOUBLE * y, -2), 2) + 2) / 4 * 16) AS INTEGER)) AS k FROM r WHERE i < len(s))),
z AS (SELECT sig_id, s, ks, ys FROM r WHERE i = len(s)) """.replace("{sig}", _SIG)
_YS = "SELECT sig_id, list_transform(ys, lambda v: round(v::DOUBLE, 5) + 0::DOUBLE) AS y FROM z"


def _rounded(s, d, values):
    return T.signals(s, d).select("sig_id", F.transform(values, lambda v: N.rounded(v.cast("double"), 5) + 0.0).alias("y"))


@query("dm_bits", _DM + "SELECT sig_id, bits FROM z")
def _(s, d):
    return T.signals(s, d).select("sig_id", audio.dm_bits(F.col("signal"), 0.05).alias("bits"))


@query("dm_decode", _DM + _YS)
def _(s, d):
    return _rounded(s, d, audio.dm_values(audio.dm_bits(F.col("signal"), 0.05), 0.05))


@query("adm_bits", _ADM + "SELECT sig_id, bits FROM z")
def _(s, d):
    return T.signals(s, d).select("sig_id", audio.adm_bits(F.col("signal"), 0.05).alias("bits"))


@query("adm_decode", _ADM + _YS)
def _(s, d):
    return _rounded(s, d, audio.adm_values(audio.adm_bits(F.col("signal"), 0.05), 0.05))


@query("dpcm_codes", _DPCM + "SELECT sig_id, array_to_string(ks, ',') AS codes FROM z")
def _(s, d):
    return T.signals(s, d).select("sig_id", F.array_join(audio.dpcm_codes(F.col("signal"), 4, 0.9), ",").alias("codes"))


@query("dpcm_decode", _DPCM + _YS)
def _(s, d):
    return _rounded(s, d, audio.dpcm_values(audio.dpcm_codes(F.col("signal"), 4, 0.9), 4, 0.9))


@query("wave_kernels_agree", "SELECT vec_id AS sig_id, TRUE AS dm, TRUE AS adm, TRUE AS dpcm FROM embeddings")
def _(s, d):
    """Kernels and folds write the same bits."""
    x = T.signals(s, d)
    x = audio.encode(x, DM, delta=0.05).withColumnsRenamed({"payload": "dm", "padding_bits": "dm_pad"}).drop("error")
    x = audio.encode(x, ADM, delta=0.05).withColumnsRenamed({"payload": "adm", "padding_bits": "adm_pad"}).drop("error")
    x = audio.encode(x, DPCM, bits=4, alpha=0.9)
    body = lambda c: B.unpack(F.substring(F.col(c), F.lit(5), F.octet_length(c)), F.col(f"{c}_pad"))
    codes = audio.index_bits(audio.dpcm_codes(F.col("signal"), 4, 0.9), 4)
    return x.select("sig_id", (body("dm") == audio.dm_bits(F.col("signal"), 0.05)).alias("dm"), (body("adm") == audio.adm_bits(F.col("signal"), 0.05)).alias("adm"), (B.unpack(F.col("payload"), F.col("padding_bits")) == codes).alias("dpcm"))


@query("sqnr_by_codec", _DM.replace("z AS", "zd AS") + _ADM.replace("WITH RECURSIVE g AS (" + _SIG + "),", ",").replace("r AS", "ra AS").replace("FROM r ", "FROM ra ").replace("z AS", "za AS")
    + _DPCM.replace("WITH RECURSIVE g AS (" + _SIG + "),", ",").replace("r AS", "rp AS").replace("FROM r ", "FROM rp ").replace("z AS", "zp AS")
    + f", u AS (SELECT 'ADM' AS codec, sig_id, s, ys FROM za UNION ALL SELECT 'DM', sig_id, s, ys FROM zd UNION ALL SELECT 'DPCM', sig_id, s, ys FROM zp), q AS (SELECT codec, {_sqnr_sql('ys[j]')} AS x FROM u) SELECT codec, count(*) AS n, round(avg(x), 4) AS sqnr, round(min(x), 4) AS least, round(max(x), 4) AS most FROM q GROUP BY codec")
def _(s, d):
    x = F.col("signal")
    ys = {"ADM": audio.adm_values(audio.adm_bits(x, 0.05), 0.05), "DM": audio.dm_values(audio.dm_bits(x, 0.05), 0.05), "DPCM": audio.dpcm_values(audio.dpcm_codes(x, 4, 0.9), 4, 0.9)}
    t = T.signals(s, d).select(F.explode(F.array(*[F.struct(F.lit(k).alias("codec"), audio.sqnr(x, y).alias("q")) for k, y in ys.items()])).alias("c"))
    return t.groupBy("c.codec").agg(F.count(F.lit(1)).alias("n"), N.rounded(F.avg("c.q"), 4).alias("sqnr"), N.rounded(F.min("c.q"), 4).alias("least"), N.rounded(F.max("c.q"), 4).alias("most"))


@query("sqnr_vs_theory", _pcm_sql(4) + f", y AS (SELECT sig_id, s, list_transform(k, lambda i: {_LEVEL.format(l=16)}) AS y FROM p) SELECT sig_id, round({_sqnr_sql('y[j]')} - 25.84, 4) AS against_theory FROM y")
def _(s, d):
    x = T.signals(s, d).withColumn("k", audio.pcm_indices(F.col("signal"), 4)).withColumn("r", audio.value_range(F.col("signal")))
    q = audio.sqnr(F.col("signal"), audio.pcm_values(F.col("k"), 4, F.col("r.low"), F.col("r.high")))
    return x.select("sig_id", N.rounded(audio.against_theory(F.lit(PCM), F.lit(4), q), 4).alias("against_theory"))


@query("sqnr_bands", _DM + f", q AS (SELECT {_sqnr_sql('ys[j]')} AS x FROM z) SELECT CASE WHEN x >= 40 THEN 'Excellent' WHEN x >= 30 THEN 'Good' WHEN x >= 20 THEN 'Acceptable' ELSE 'Distorted' END AS label, count(*) AS n FROM q GROUP BY ALL")
def _(s, d):
    q = audio.sqnr(F.col("signal"), audio.dm_values(audio.dm_bits(F.col("signal"), 0.05), 0.05))
    return T.signals(s, d).select(N.sqnr_label(q).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("mono_mix", "SELECT a.vec_id AS sig_id, list_transform(range(1, 65), lambda j: CAST((a.embedding[j]::DOUBLE + b.embedding[j]::DOUBLE) / 2 AS FLOAT)) AS x FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(s, d):
    a = T.signals(s, d)
    b = a.select((F.col("sig_id") - 1).alias("sig_id"), F.col("signal").alias("other"))
    return a.join(b, "sig_id").select("sig_id", audio.mono(F.zip_with("signal", "other", lambda x, y: F.array(x, y))).alias("x"))


@query("wav_roundtrip", "SELECT vec_id AS sig_id, 8000 AS sample_rate, list_transform(embedding, lambda v: round(trunc((v * 32767::FLOAT)::DOUBLE) / 32768, 5) + 0::DOUBLE) AS x, CAST(NULL AS VARCHAR) AS error FROM embeddings")
def _(s, d):
    w = T.signals(s, d).select("sig_id", media.load_audio(media.export_audio("signal", "sample_rate"), F.lit("wav")).alias("w"))
    return w.select("sig_id", "w.sample_rate", F.transform("w.signal", lambda v: N.rounded(v.cast("double"), 5) + 0.0).alias("x"), "w.error")


# names, sizes, labels


_EXT = "CASE WHEN instr(url, '.') = 0 THEN '' ELSE lower(regexp_extract(url, '\\.([^.]*)$', 1)) END"


@query("ext_stem_route", f"SELECT page_id, {_EXT} AS ext, regexp_replace(url, '\\.[^.]*$', '') AS stem, CASE WHEN {_EXT} IN ('wav','mp3','flac','m4a','ogg') THEN 'audio' WHEN {_EXT} IN ('jpg','jpeg','png','bmp','gif','tiff','tif','webp','avif') THEN 'image' ELSE 'bytes' END AS route FROM pages")
def _(s, d):
    ext = N.extension(F.col("url"))
    return T.read(s, d, "pages").select("page_id", ext.alias("ext"), N.stem(F.col("url")).alias("stem"), N.pipeline(ext).alias("route"))


_NAMES = ["a.PNG", "x.tar.gz", "noext", "trail.", ".bashrc", "song.M4A", "voice.mp3", "w.wav", "old.ABC", "deep.name.abc", ""]


@query("restored_name", """SELECT name, CASE WHEN lower(name) LIKE '%.abc' THEN name[:length(name) - 4] ELSE regexp_replace(name, '\\.[^.]*$', '') END || '_restored.' || CASE WHEN e IN ('wav','mp3','m4a') THEN e WHEN e = 'png' THEN 'png' WHEN e <> '' THEN e ELSE 'bin' END AS restored,
 regexp_replace(name, '\\.[^.]*$', '') || '_compressed.abc' AS download, 'audio/' || CASE e WHEN 'm4a' THEN 'mp4' WHEN 'mp3' THEN 'mpeg' ELSE e END AS mime
 FROM (SELECT name, CASE WHEN instr(name, '.') = 0 THEN '' ELSE lower(regexp_extract(name, '\\.([^.]*)$', 1)) END AS e FROM (VALUES """ + ", ".join(f"('{n}')" for n in _NAMES) + ") t(name))")
def _(s, d):
    t = s.range(1).select(F.explode(F.array(*map(F.lit, _NAMES))).alias("name"))
    ext = N.extension(F.col("name"))
    return t.select("name", N.restored_name(F.col("name"), N.pipeline(ext), ext).alias("restored"), N.download_name(F.col("name")).alias("download"), N.mime(ext).alias("mime"))


@query("ratio_format", """SELECT doc_id, CASE WHEN a = 0 THEN 'N/A' ELSE printf('%.4f×', b / a) END AS ratio, CASE WHEN a = 0 THEN 'N/A' ELSE CASE WHEN 1 - b / a >= 0 THEN '-' ELSE '+' END || printf('%.2f%%', abs(1 - b / a) * 100) END AS savings,
 CASE WHEN a = 0 THEN '' WHEN b / a < 1 THEN 'ratio-good' ELSE 'ratio-bad' END AS css FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE n_chars END AS a, 1000 + doc_id AS b FROM documents)""")
def _(s, d):
    t = T.read(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, 0).otherwise(F.col("n_chars")).alias("a"), (F.col("doc_id") + 1000).alias("b"))
    return t.select("doc_id", N.ratio(F.col("a"), F.col("b")).alias("r")).select("doc_id", "r.*")


@query("size_metrics", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, round(octet_length(encode(text)) / 1024, 6) AS kb, round(octet_length(encode(text)) / 1048576, 6) AS mb FROM documents")
def _(s, d):
    t = T.read(s, d, "documents").select("doc_id", N.size_metrics(F.col("text").cast("binary")).alias("m"))
    return t.select("doc_id", "m.bytes", N.rounded("m.kb", 6).alias("kb"), N.rounded("m.mb", 6).alias("mb"))


@query("hex_dump", "SELECT item_id, array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: '0x' || x), ' ') AS dump FROM benchmark")
def _(s, d):
    return T.items(s, d).select(F.col("blob_id").alias("item_id"), N.hex_dump(F.col("content")).alias("dump"))


@query("parameter_grid", "SELECT CAST(b AS INTEGER) AS bits, round(x * 0.05, 2)::DOUBLE AS delta_step, CAST(f AS INTEGER) AS sampling_factor FROM range(1, 9) t(b), range(1, 5) u(x), (VALUES (1), (2), (4)) v(f)")
def _(s, d):
    low, high, _ = PARAMETERS["bits"]
    b = s.range(int(low), int(high) + 1).select(F.col("id").cast("int").alias("bits"))
    step = F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda x: N.rounded(x * 0.05, 2)))
    return b.select("bits", step.alias("delta_step")).select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("sampling_factor"))


# simulators


def _sim_texts(s, d):
    return T.read(s, d, "benchmark").select(F.col("item_id").alias("sim_id"), F.substring("text", 1, 64).alias("text"))


_SIM = """WITH RECURSIVE b AS (SELECT item_id AS sim_id, upper(replace(left(text, 64), 'ß', 'ss')) AS t FROM benchmark),
r AS (SELECT sim_id, t, 0 AS pos, '' AS open, []::VARCHAR[] AS known, 0 AS step, 0 AS ref, '' AS ch, FALSE AS said, FALSE AS fresh FROM b
 UNION ALL SELECT sim_id, t, pos + 1, CASE WHEN list_contains(known, p) AND pos + 1 < length(t) THEN p ELSE '' END, CASE WHEN list_contains(known, p) THEN known ELSE list_append(known, p) END,
  step + CASE WHEN list_contains(known, p) AND pos + 1 < length(t) THEN 0 ELSE 1 END, coalesce(list_position(known, open), 0), t[pos + 1], NOT (list_contains(known, p) AND pos + 1 < length(t)), NOT list_contains(known, p)
  FROM (SELECT *, open || t[pos + 1] AS p FROM r WHERE pos < length(t))) """


@query("sim_lz78_steps", _SIM + "SELECT sim_id, CAST(step AS INTEGER) AS step, CAST(ref AS INTEGER) AS dict_ref, ch AS new_char, CASE WHEN fresh THEN CAST(len(known) AS INTEGER) END AS index, CASE WHEN fresh THEN known[len(known)] END AS pattern, CAST(pos AS INTEGER) AS position FROM r WHERE said")
def _(s, d):
    return simulate.lz78_steps(_sim_texts(s, d))


@query("sim_lz78_consumed", _SIM + ", z AS (SELECT sim_id, max(step) AS steps, any_value(length(t)) AS n FROM r GROUP BY sim_id) SELECT sim_id, CAST(n AS BIGINT) AS consumed, CAST(steps AS BIGINT) AS steps, 1.0::DOUBLE AS progress FROM z")
def _(s, d):
    st = simulate.lz78_steps(_sim_texts(s, d))
    c = simulate.lz78_consumed(st, simulate.lz78_dictionary(st))
    n = _sim_texts(s, d).select("sim_id", F.length(F.upper("text")).alias("n"))
    return c.join(n, "sim_id").select("sim_id", "consumed", "steps", simulate.progress(F.col("consumed"), F.col("n")).alias("progress"))


@query("sim_rle_rows", """WITH p AS (SELECT i // 8 AS r, i % 8 AS c, (CAST(trunc(255 * i / 63) AS INTEGER) >> 4) << 4 AS v FROM range(64) t(i)), f AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY r ORDER BY c) = v THEN 0 ELSE 1 END AS fresh FROM p),
n AS (SELECT r, v, sum(fresh) OVER (PARTITION BY r ORDER BY c) - 1 AS run FROM f) SELECT CAST(r AS INTEGER) AS row, CAST(run AS BIGINT) AS run, CAST(any_value(v) AS INTEGER) AS v, count(*) AS n FROM n GROUP BY r, run""")
def _(s, d):
    return simulate.rle_rows(simulate.gradient(s).withColumn("v", simulate.quantize(F.col("v"), 4)))


@query("sim_quantization", "SELECT bits, levels, step, tokens, against_raw, saving_pct::DOUBLE AS saving_pct FROM (VALUES (1, 2, 128, 8, -56, 87.5), (2, 4, 64, 8, -56, 87.5), (3, 8, 32, 8, -56, 87.5), (4, 16, 16, 16, -48, 75.0), (5, 32, 8, 32, -32, 50.0), (6, 64, 4, 64, 0, 0.0), (7, 128, 2, 64, 0, 0.0), (8, 256, 1, 64, 0, 0.0)) t(bits, levels, step, tokens, against_raw, saving_pct)")
def _(s, d):
    return simulate.quantization_report(s)


@query("sim_upscale", f"SELECT img_id, CAST(((pos // 8) * 3 + i) * 24 + (pos % 8) * 3 + j AS BIGINT) AS pos, v FROM ({_IMG}), range(3) a(i), range(3) b(j)")
def _(s, d):
    return image.upscale(T.pictures(s, d), 8, 3)


@query("sim_sine", "SELECT CAST(i AS INTEGER) AS n, round(sin(i * (2 * 3.141592653589793 / 49)), 5) + 0.0 AS x FROM range(50) t(i)")
def _(s, d):
    return simulate.sine(s).select("n", (N.rounded(F.col("x").cast("double"), 5) + 0.0).alias("x"))


_SIM_DM = """WITH RECURSIVE g AS ({sig}), r AS (SELECT sig_id, s, 0 AS i, 0::DOUBLE AS y, []::FLOAT[] AS ys FROM g
 UNION ALL SELECT sig_id, s, i + 1, CASE WHEN s[i + 1]::DOUBLE > y THEN y + 0.1::DOUBLE ELSE y - 0.1::DOUBLE END, list_append(ys, CAST(CASE WHEN s[i + 1]::DOUBLE > y THEN y + 0.1::DOUBLE ELSE y - 0.1::DOUBLE END AS FLOAT)) FROM r WHERE i < len(s)),
z AS (SELECT sig_id, s, ys FROM r WHERE i = len(s)) """.replace("{sig}", _SIG)
_SIM_DPCM = """WITH RECURSIVE g AS ({sig}), r AS (SELECT sig_id, s, 0 AS i, 0::DOUBLE AS y, []::FLOAT[] AS ys FROM g
 UNION ALL SELECT sig_id, s, i + 1, 0.9::DOUBLE * y + k * 0.125::DOUBLE, list_append(ys, CAST(0.9::DOUBLE * y + k * 0.125::DOUBLE AS FLOAT)) FROM (SELECT *, least(greatest(floor((s[i + 1]::DOUBLE - 0.9::DOUBLE * y) / 0.125::DOUBLE), -8), 7) AS k FROM r WHERE i < len(s))),
z AS (SELECT sig_id, s, ys FROM r WHERE i = len(s)) """.replace("{sig}", _SIG)


@query("sim_dm", _SIM_DM + _YS)
def _(s, d):
    return _rounded(s, d, simulate.dm_staircase(F.col("signal"), 0.1))


@query("sim_dpcm", _SIM_DPCM + _YS)
def _(s, d):
    return _rounded(s, d, simulate.dpcm(F.col("signal"), 0.9))


@query("sim_sqnr_flags", _SIM_DM + ", e AS (SELECT sig_id, list_max(list_transform(range(1, len(s) + 1), lambda j: abs(s[j] - ys[j])))::DOUBLE AS m FROM z) SELECT sig_id, round(m, 5) AS max_error, m <= 0.1 AS within_delta, m > 0.2 AS slope_overload FROM e")
def _(s, d):
    w = simulate.waveform(T.signals(s, d), 0.1, 0.9)
    return w.select("sig_id", N.rounded("max_error", 5).alias("max_error"), "within_delta", "slope_overload")


_SINE = "SELECT 0 AS sig_id, list(CAST(sin(i * (2 * 3.141592653589793 / 49)) AS FLOAT) ORDER BY i) AS s FROM range(50) t(i)"
_SIM_SQNR = "10 * log10(list_sum(list_transform(s, lambda v: (v * v)::DOUBLE)) / list_sum(list_transform(range(1, len(s) + 1), lambda j: ((s[j] - {y}[j]) * (s[j] - {y}[j]))::DOUBLE)))"


def _sine_sql(delta: str) -> str:
    dm, dpcm = (x.replace(_SIG, _SINE).replace("WITH RECURSIVE ", "") for x in (_SIM_DM.replace("0.1::DOUBLE", f"{delta}::DOUBLE"), _SIM_DPCM))
    dpcm = dpcm.replace("g AS (" + _SINE + "),", "").replace("r AS", "r2 AS").replace("FROM r ", "FROM r2 ").replace("z AS", "z2 AS")
    return f"WITH RECURSIVE {dm}, {dpcm}, w AS (SELECT z.s, z.ys AS dm, z2.ys AS dpcm FROM z JOIN z2 USING (sig_id)) "


_SINE_ROW = "SELECT * FROM ({w} SELECT {d}::DOUBLE AS delta, round({a}, 4) AS dm_sqnr, round({b}, 4) AS dpcm_sqnr, round(m, 4) AS max_error, m <= {d} AS within_delta, m > 2 * {d} AS slope_overload FROM (SELECT *, list_max(list_transform(range(1, 51), lambda j: abs(s[j] - dm[j])))::DOUBLE AS m FROM w))"


@query("sim_sine_report", " UNION ALL ".join(_SINE_ROW.format(w=_sine_sql(x), d=x, a=_SIM_SQNR.format(y="dm"), b=_SIM_SQNR.format(y="dpcm")) for x in ("0.01", "0.1", "0.4")))
def _(s, d):
    """The sine under several step sizes: SQNR of both coders, largest error and flags."""
    one = simulate.signal_of(simulate.sine(s))
    out = None
    for delta in (0.01, 0.1, 0.4):
        w = simulate.waveform(one, delta, 0.9).select(F.lit(delta).alias("delta"), N.rounded("dm_sqnr", 4).alias("dm_sqnr"), N.rounded("dpcm_sqnr", 4).alias("dpcm_sqnr"), N.rounded("max_error", 4).alias("max_error"), "within_delta", "slope_overload")
        out = w if out is None else out.unionByName(w)
    return out


@query("sim_waveform_table", _sine_sql("0.1") + "SELECT 0 AS sig_id, CAST(j - 1 AS INTEGER) AS n, round(s[j]::DOUBLE, 5) + 0.0::DOUBLE AS signal, round(dm[j]::DOUBLE, 5) + 0.0::DOUBLE AS dm, round(dpcm[j]::DOUBLE, 5) + 0.0::DOUBLE AS dpcm FROM w, range(1, 51) t(j)")
def _(s, d):
    t = simulate.waveform_table(simulate.waveform(simulate.signal_of(simulate.sine(s)), 0.1, 0.9))
    return t.select("sig_id", "n", *((F.col(c) + 0.0).alias(c) for c in ("signal", "dm", "dpcm")))


@query("sim_sqnr", _SIM_DM + f"SELECT sig_id, round({_SIM_SQNR.format(y='ys')}, 4) AS sqnr FROM z")
def _(s, d):
    return simulate.waveform(T.signals(s, d), 0.1, 0.9).select("sig_id", N.rounded("dm_sqnr", 4).alias("sqnr"))


# streams


@query("stream_dm", f"""WITH RECURSIVE g AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids, list(CAST(CAST(value / 500 AS FLOAT) AS DOUBLE) ORDER BY ts, event_id) AS s FROM events GROUP BY user_id),
r AS (SELECT user_id, ids, s, 0 AS i, 0::BIGINT AS seq, 0 AS code, 0::DOUBLE AS y FROM g
 UNION ALL SELECT user_id, ids, s, i + 1, ids[i + 1], CASE WHEN s[i + 1] > y THEN 1 ELSE 0 END, CASE WHEN s[i + 1] > y THEN least(1, y + 0.05::DOUBLE) ELSE greatest(-1, y - 0.05::DOUBLE) END FROM r WHERE i < len(s))
SELECT user_id AS key, seq, code, y FROM r WHERE i > 0""")
def _(s, d):
    from bitloom.streaming import runs

    return runs.dm_of_events(s, d)


#: Events of one session, up to a purchase; the session of a user that has not ended keeps its open phrase.
@query("stream_lz78", """WITH RECURSIVE o AS (SELECT user_id, ts, event_id, event_type, 1 + coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session FROM events),
g AS (SELECT user_id, CAST(session AS BIGINT) AS session, string_agg(event_type || ';', '' ORDER BY ts, event_id) AS t, bool_or(event_type = 'purchase') AS ended FROM o GROUP BY user_id, session),
r AS (SELECT user_id, session, t, ended, 0 AS pos, '' AS open, []::VARCHAR[] AS known, 0 AS idx, 0 AS num, '' AS ch, FALSE AS said FROM g
 UNION ALL SELECT user_id, session, t, ended, pos + 1, CASE WHEN list_contains(known, p) THEN p ELSE '' END, CASE WHEN list_contains(known, p) THEN known ELSE list_append(known, p) END,
  coalesce(list_position(known, open), 0), len(known) + 1, t[pos + 1], NOT list_contains(known, p) FROM (SELECT *, open || t[pos + 1] AS p FROM r WHERE pos < length(t)))
SELECT CAST(user_id AS VARCHAR) AS key, session, CAST(num AS BIGINT) AS k, CAST(idx AS BIGINT) AS idx, ch FROM r WHERE said
UNION ALL SELECT CAST(user_id AS VARCHAR), session, CAST(len(known) + 1 AS BIGINT), CAST(list_position(known, open) AS BIGINT), NULL FROM r WHERE pos = length(t) AND open <> '' AND ended""")
def _(s, d):
    from bitloom.streaming import runs

    return runs.lz78_of_events(s, d)


