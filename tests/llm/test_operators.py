"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.llm import chat, common, decontam, exact_dedup, html_extract, jaccard_join, langid, sentencepiece_fst, sharding, suffix_dedup, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_crc32 string, id string, shard int"


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text or ""), "clash", "clash", 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["the", "of", "and", "river", "stone", "cloud", "winter", "letter", "garden", "silver", "engine", "morning"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "ed"]) for _ in range(n))
    a, b, long = prose(80), prose(60), prose(4000)
    near = a.split()
    near[40] = "changed"
    passage = prose(30)
    out = [doc(1, a), doc(2, a), doc(3, " ".join(near)), doc(4, b, "fr"), doc(5, None, None, None), doc(6, ""), doc(7, " \t\n"), doc(8, "one two"), doc(9, "One two"), doc(10, long), doc(11, long + " tail"), doc(12, prose(20) + " " + passage), doc(13, passage + " " + prose(25)), doc(14, "x" * 300), doc(15, "été " * 40), doc(15, "été " * 40), doc(16, b)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_suffix_dedup(docs, none, rows):
    first, want = {}, []
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.append((i, len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert sorted(tuple(r) for r in suffix_dedup.op1(docs).collect()) == sorted(want)
    assert suffix_dedup.op1(none).count() == 0


def test_repeat_groups():
    rng = random.Random(1)
    for _ in range(60):
        s = bytes(rng.choice(b"ab") for _ in range(rng.randrange(24)))
        want = set()
        for i in range(len(s)):
            for n in range(2, len(s) - i + 1):
                at = [k for k in range(len(s) - n + 1) if s[k : k + n] == s[i : i + n]]
                left, right = {s[k - 1] if k else -1 - k for k in at}, {s[k + n] if k + n < len(s) else -1 for k in at}
                if len(at) > 1 and len(left) > 1 and len(right) > 1:
                    want.add((n, tuple(at)))
        assert {(n, tuple(p)) for n, p in suffix_dedup.repeat_groups(s, 2)} == want


def test_covered_equals_brute_force():
    """Surroundings with common and diverse sides, cut ones too: the windows that a smaller document also has."""
    left, length, width = suffix_dedup.LEFT, suffix_dedup.LENGTH, suffix_dedup.CONTEXT
    rng = np.random.default_rng(1)
    for _ in range(120):
        n = int(rng.integers(1, 40))
        ctx = rng.integers(0, 3, (3, width)).astype(np.uint8)[rng.integers(0, 3, n)].copy()
        for i in range(n):
            if rng.random() < 0.7:
                ctx[i, : rng.integers(0, left)] = rng.integers(0, 3)
            if rng.random() < 0.7:
                ctx[i, rng.integers(left + 10, width) :] = rng.integers(0, 3)
        la, ra = np.where(rng.random(n) < 0.7, left, rng.integers(0, left + 1, n)), np.where(rng.random(n) < 0.7, length, rng.integers(16, length + 1, n))
        at = np.arange(width)
        ctx[(at < left - la[:, None]) | (at >= left + ra[:, None])] = 0
        doc = rng.integers(0, 6, n)
        want = [[] for _ in range(n)]
        for l in range(left + 1):
            fit = [i for i in range(n) if la[i] >= l and ra[i] >= length - l]
            least = {}
            for i in fit:
                key = ctx[i, left - l : left + length - l].tobytes()
                least[key] = min(least.get(key, 99), doc[i])
            for i in fit:
                if least[ctx[i, left - l : left + length - l].tobytes()] < doc[i]:
                    want[i].append(l)
        lo, hi = suffix_dedup.covered(ctx, la, ra, doc)
        assert [(a, b) if a <= b else None for a, b in zip(lo.tolist(), hi.tolist())] == [(min(w), max(w)) if w else None for w in want]


@pytest.mark.parametrize("part_bytes", [16 << 20, 1000])
def test_suffix_dedup_of_a_common_passage(spark, monkeypatch, part_bytes):
    """One passage in all documents, null ids, one id with several texts; many parts in a partition too."""
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", part_bytes)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(60), prose(14)
    rows = [(k, f"{prose(rng.randrange(12))} {passage if rng.random() < 0.8 else passage[rng.randrange(200):]} {prose(rng.randrange(12))} {other if k % 3 else ''}") for k in range(120)]
    rows += [(5, prose(20) + other), (5, passage[20:200]), (None, passage), (None, None)]
    first, want = {}, []
    named = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for i, text in named:
        for p in range(len(text) - 49):
            first.setdefault(text[p : p + 50], i)
    for i, text in named:
        gone = bytearray(len(text))
        for p in range(len(text) - 49):
            if first[text[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(text.encode(), gone) if not g)
        want.append((i, len(text), len(text) - len(kept), hashlib.sha256(kept).hexdigest()))
    want += [(None, len(t or ""), 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows if i is None]
    got = suffix_dedup.op1(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], x[3])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got), key=order) == sorted(want, key=order)


def test_jaccard_join(docs, none, rows):
    sets = {}
    for i, text, *_ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.op6(docs).collect()}
    assert got == {(i, len(s), comp[i]) for i, s in sets.items()}
    assert jaccard_join.op6(none).count() == 0
    assert jaccard_join.one_per_group(docs).columns == docs.columns


@pytest.mark.parametrize("block", [250_000, 600])
def test_jaccard_join_of_large_groups(spark, monkeypatch, block):
    """More near copies than a dense column has rows, chains of them, and one passage in all documents; blocks and pivots too."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "PART_BYTES", 40 * block)
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(12)]
    texts = []
    for size, n in ((150, 60), (40, 90), (8, 30)):
        base = [word() for _ in range(n)]
        for k in range(size):
            copy = base + passage if size == 8 else list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    drift = [word() for _ in range(80)]
    for k in range(70):  # each is a near copy of the one before
        drift = drift[1:] + [word()] if k % 3 else drift[2:] + [word(), word()]
        texts.append(list(drift))
    texts += [[word() for _ in range(rng.randrange(60))] + passage for _ in range(90)]
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in texts]
    comp = list(range(len(sets)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op6(d).collect()}
    assert got == {k: (len(s), find(k)) for k, s in enumerate(sets)}


def test_jaccard_bounds():
    for a in range(1, 120):
        for b in range(a, 120):
            least = min(o for o in range(b + 1) if 100 * o >= 85 * (a + b - o))
            assert jaccard_join.needed(a, b) == least


def test_near_stage_rate(spark, rows):
    import corpus_pipeline as P

    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    more = [f"w{rng.randrange(10**6)}" for _ in range(20)]
    texts = {1: base, 2: base + more, 3: base + more * 2}  # 1 and 2: 96 of 116 shingles; 2 and 3: 116 of 136
    d = spark.createDataFrame([doc(i, " ".join(w)) for i, w in texts.items()], DOCS)
    assert {r.doc_id for r in P.near(spark, d.where("doc_id < 3"), SF).collect()} == {1}
    assert {r.doc_id for r in P.near(spark, d, SF).collect()} == {1}
    assert {(r.doc_id, r.component_id) for r in jaccard_join.op6(d.where("doc_id < 3")).collect()} == {(1, 1), (2, 2)}
    for a in range(1, 90):
        for b in range(a, 90):
            assert jaccard_join.needed(a, b, (80, 100)) == min(o for o in range(b + 1) if 100 * o >= 80 * (a + b - o))


def test_near_stage_keeps_null_ids(spark, rows):
    d = spark.createDataFrame([doc(None, rows[0][1]), doc(None, None), *rows[:4]], DOCS)
    kept = jaccard_join.one_per_group(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(0, ""), (0, rows[0][1]), (1, rows[0][1]), (4, rows[3][1])])


def test_exact_dedup(spark, docs, none, rows):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(text or "", []).append(i)
    got = exact_dedup.op10(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        members = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert (r.keep_id, r.group_size) == (max(members), len(members)) and (not r.kept or r.doc_id == r.keep_id)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.op10(none).count() == 0


def test_state_lasts(spark, tmp_path):
    one = spark.createDataFrame([(1, "d1", "f"), (2, "d2", "f")], "id bigint, digest string, locator string")
    state = str(tmp_path / "state")
    assert {(r.digest, r.n) for r in exact_dedup.update_state(one, state).collect()} == {("d1", 1), ("d2", 1)}


def _over_runs(spark, state, *runs):
    return [sorted((r.id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(spark.createDataFrame(run, "doc_id bigint, text string"), state_dir=state).collect()) for run in runs]


def test_hits_on_earlier_runs(spark, tmp_path):
    got = _over_runs(spark, str(tmp_path / "state"), [(5, "same"), (1, "one")], [(3, "same"), (2, "two")], [(5, "same"), (7, "one"), (6, "one")])
    assert got[0] == [(1, 1, 1, True), (5, 5, 1, True)]
    assert got[1] == [(2, 2, 1, True), (3, 5, 2, False)]
    assert got[2] == [(5, 5, 3, False), (6, 7, 3, False), (7, 7, 3, True)]


def test_collisions_over_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_digest", lambda text: F.lit("equal"))
    state = str(tmp_path / "state")
    assert _over_runs(spark, state, [(5, "a")], [(3, "b"), (2, "a")]) == [[(5, 5, 1, True)], [(2, 5, 2, False), (3, 3, 1, True)]]
    d = spark.createDataFrame([(1, "b"), (4, "c")], "doc_id bigint, text string")
    assert [tuple(r) for r in exact_dedup.deduplicate(d, state_dir=state).collect()] == [(4, "c")]


def test_sharding(docs, none, rows):
    got = sharding.op5(docs).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"rows"}
    counts = {}
    for r in got:
        counts.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    text = {i: (t or "").encode() for i, t, *_ in rows}
    assert all(r.size == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got)
    assert sharding.op5(none).count() == 0


def test_sharding_keeps_the_mixture(spark):
    t = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), "id").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))).alias("source"))
    share = sharding.op5(t).groupBy("shard").agg(F.count("*").alias("n"), F.sum((F.col("source") == "hot").cast("int")).alias("hot")).collect()
    assert len(share) == 40 and {r.n for r in share} == {100} and all(abs(r.hot - 33.35) <= 2 for r in share)
    a, b = ([(r.doc_id, r.shard) for r in sharding.op5(x).orderBy("doc_id").collect()] for x in (t, t.repartition(7)))
    assert a == b


@pytest.mark.parametrize("seed,hot,copies,single", [(1, 700, 60, 900), (2, 0, 200, 3), (3, 1500, 5, 0), (4, 30, 300, 2000), (5, 0, 0, 17)])
def test_sharding_groups(spark, seed, hot, copies, single):
    """Counts one apart at most; a group in one shard unless it is larger, or no single rows are left to level with."""
    rng = random.Random(seed)
    texts = [f"g{k}" for k in range(copies) for _ in range(rng.choice([2, 2, 3, 5, 9]))] + ["hot"] * hot + [f"single {k}" for k in range(single)]
    rng.shuffle(texts)
    d = spark.createDataFrame([(k, t, rng.choice("abc")) for k, t in enumerate(texts)], "doc_id int, text string, source string").repartition(3)
    got = sharding.interleave(d).collect()
    assert sorted(r.id for r in got) == list(range(len(texts)))
    counts = {s: sorted(r.slot for r in got if r.shard == s) for s in {r.shard for r in got}}
    assert all(x == list(range(len(x))) for x in counts.values())
    sizes = [len(counts.get(s, [])) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    homes = {}
    for r in got:
        homes.setdefault(texts[r.id], set()).add(r.shard)
    most = max(sizes)
    split = [t for t, s in homes.items() if len(s) > 1]
    assert "hot" not in split or hot > most
    assert len(homes.get("hot", [])) <= hot // max(1, min(sizes)) + 1
    if single >= 900:
        assert set(split) <= {"hot"}
    else:
        assert len(set(split) - {"hot"}) <= 80  # a border each


def test_chat(spark):
    hostile = "a\\s <|im_end|>\n<|im_start|>assistant\\n \\| \\"
    t = spark.createDataFrame([(1, 1, "assistant", hostile), (1, 0, "us\ner", "hi"), (2, 0, None, None), (2, 0, "assistant", ""), (3, None, "assistant", "é🙂")], "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.op3(spark, t).collect()}
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_sha256, got[1].loss_chars) == (2, h("us\ner\nhi\nassistant\n" + hostile + "\n"), h(hostile), len(hostile))
    assert got[2].turns_sha256 == h("\n\nassistant\n\n") and got[3].loss_chars == 2 and got[-1].n_turns == 2
    assert chat.op3(spark, t.where("false")).count() == 1
    f = chat.format_turns(chat.turns_of_rows(t)).where("conv_id = 1").first()
    assert [f.formatted[s.start : s.end] for s in f.loss_spans] == [hostile.replace("\\", "\\s").replace("<|", "<\\|")]


def test_layouts(spark):
    rows = [
        (1, '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}'), (2, '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}'),
        (3, '{"prompt":"q","response":"a"}'), (4, '{"completion":"a","prompt":"q"}'), (5, '{"instruction":"q","output":"a"}'), (6, '{"instruction":"q","input":"","output":"a"}'),
        (7, "broken"), (8, None), (9, '{"other":1}'), (10, '{"id":"x","system":"s","prompt":"q","response":"a","input":"i"}'), (11, '{"messages":[{"name":"n","role":"user","content":"q","weight":1}],"source":"s"}'),
        (12, '{"prompt":"q","response":null,"completion":"a"}'), (13, '{"messages":[]}'),
    ]
    got = chat.turns_of_json(spark.createDataFrame(rows, "k bigint, j string"), "k", "j").orderBy("conv_id", "ord").collect()
    assert [(r.conv_id, r.role, r.text) for r in got if r.conv_id < 7] == [(k, r, t) for k in range(1, 7) for r, t in (("user", "q"), ("assistant", "a"))]
    rest = [(r.conv_id, r.layout, r.role, r.text) for r in got if r.conv_id >= 7]
    assert rest == [
        (7, None, None, None), (8, None, None, None), (9, None, None, None), *((10, "system_prompt_response", r, t) for r, t in (("system", "s"), ("user", "q"), ("assistant", "a"))),
        (11, "messages", "user", "q"), (12, "prompt_response", "user", "q"), (12, "prompt_response", "assistant", None), (13, None, None, None),
    ]


def test_row_layouts(spark):
    both = spark.createDataFrame([("c", 0, "user", "t", "content", 7, 3)], "conv_id string, turn int, role string, text string, content string, conversation_id int, index int")
    assert [tuple(r) for r in chat.turns_of_rows(both).collect()] == [("c", 0, "user", "t", "rows")]
    assert [tuple(r) for r in chat.turns_of_rows(both.drop("turn")).collect()] == [(7, 3, "user", "content", "indexed_rows")]
    with pytest.raises(ValueError):
        chat.turns_of_rows(both.drop("role"))


def test_url_filter(spark):
    urls = ["http://A.Example.ORG/es/1", "https://x.org", "http://x.com/fr/a?b", "http://y.com/de/", "https://example.org/en/12#t", "nothing", None, "http://bad.net/p/1", "http://good.net/p/2"]
    pages = [(i, u, "x") for i, u in enumerate(urls)] + [(100 + i, f"http://{'bad' if i % 2 else 'good'}.net/p/{i}", "x") for i in range(40)]
    p = spark.createDataFrame(pages, "page_id bigint, url string, confidence string")
    labels = spark.createDataFrame([(100 + i, 0 if i % 2 else 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.op4(p, labels).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("x.org", "", None, "allow") and got[2] == ("x.com", "/fr/a", "com/fr/", "allow") and got[3][2:] == ("com/de/", "block")
    assert got[4][2:] == ("example.org/en/1", "block") and got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[7][3] == "block" and got[8][3] == "allow"
    assert url_filter.op4(p.where("false"), labels.where("false")).count() == 0


def test_url_filter_repeated_ids(spark):
    pages = [(i, f"http://{'bad' if i % 2 else 'good'}.net/p/{i}") for i in range(40)] + [(7, "http://good.net/p/9"), (50, "http://bad.net/" + "/".join(f"s{k}" for k in range(300)))]
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(40) if i != 7], "doc_id bigint, quality int, toxic int")
    got = url_filter.op4(spark.createDataFrame(pages, "page_id bigint, url string"), labels).collect()
    assert sorted((r.page_id, r.host, r.verdict) for r in got) == sorted((i, u.split("/")[2], "block" if "bad" in u else "allow") for i, u in pages)


def test_rules_equal_brute_force(spark):
    rng = random.Random(2)
    data = [([t for t in "abcde" if rng.random() < 0.5], rng.random() < 0.4) for _ in range(200)]
    got = url_filter.mine(spark.createDataFrame([(t, b) for t, b in data], "tokens array<string>, bad boolean"), 0.05, 0.45)
    used = [(set(t), b) for t, b in data if t]
    from itertools import combinations

    conf = {}
    for n in range(1, 6):
        for c in combinations("abcde", n):
            has = [b for t, b in used if set(c) <= t]
            if has and sum(has) / len(used) >= 0.05 and sum(has) / len(has) >= 0.45:
                conf[c] = sum(has) / len(has)
    want = {c for c, x in conf.items() if not any(conf.get(s, -1) >= x for n in range(1, len(c)) for s in combinations(c, n))}
    assert want and {tuple(r.antecedent): round(r.confidence, 9) for r in got.collect()} == {c: round(conf[c], 9) for c in want}


def test_language(spark, docs, none):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op9(d).join(d, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 !!", "en"), (3, "the river and the stone", "en"), (3, "the river and the stone", "en")], "doc_id bigint, text string, lang string")
    model = langid.train(d)
    r = {x.doc_id: (x.lang_pred, x.score) for x in langid.identify(odd, model).collect()}
    assert r[1] == ("und", 0.0) and r[2] == ("und", 0.0) and r[3][0] in model.langs
    assert langid.op9(none).count() == 0
    nobody = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {(x.lang_pred, x.score) for x in langid.op9(nobody).collect()} == {("und", 0.0)}
    other = spark.createDataFrame([(1, "Здравствуй мир")], "doc_id bigint, text string")  # a script that was never learnt
    assert [(x.lang_pred, x.score) for x in langid.identify(other, model).collect()] == [(model.fallback, 0.0)]
    twins = langid.train(spark.createDataFrame([(1, "same words here", "b"), (2, "same words here", "a")], "doc_id bigint, text string, lang string"))
    assert langid.identify(other.withColumn("text", F.lit("same words")), twins).first().lang_pred == "a"
    mixed = spark.createDataFrame([(1, "the of and that with from " * 30 + "der die und nicht eine einer " * 20)], "doc_id bigint, text string")
    spans = langid.identify(mixed, model, spans=True).first().spans
    assert {s.lang for s in spans} >= {"en", "de"}


def test_viterbi_equals_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    e = rng.normal(size=(6, 3)).astype(np.float32) * 5
    label = langid.viterbi(e, np.array([0]), np.array([6]), 4.0)
    score = lambda path: sum(e[i, k] for i, k in enumerate(path)) - 4.0 * sum(a != b for a, b in itertools.pairwise(path))
    assert abs(score(label) - max(map(score, itertools.product(range(3), repeat=6)))) < 1e-4


def test_sentencepiece(docs, none, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_fst.model_file())
    got = sentencepiece_fst.op7(docs).collect()
    assert all(r.round_trip for r in got) and len(got) == len(rows)
    text = {i: t or "" for i, t, *_ in rows}
    assert all(r.ids == sp.encode(text[r.doc_id]) for r in got)
    machine = sentencepiece_fst.Transducer(sentencepiece_fst.model_file())
    rng = random.Random(4)
    for _ in range(400):
        s = "".join(rng.choice("ab the▁ \n\té日<s>🙂ing") for _ in range(rng.randrange(30)))
        assert machine.encode(s) == sp.encode(s) and machine.decode(machine.encode(s)) == s.replace("▁", " ")
    for s in ("x" * 3000, "ing" * 30 + "é" * 200, "the" * 300 + " a" * 300, "ab" * 20000, " " * 3000):
        assert machine.encode(s) == sp.encode(s)
    assert sentencepiece_fst.op7(none).count() == 0


def test_sentencepiece_batches(monkeypatch):
    model = sentencepiece_fst.model_file()
    rng = random.Random(5)
    texts = ["".join(rng.choice(["the", "ing", " ", "  ", "a", "é", "x.", "\n"]) for _ in range(rng.randrange(120))) for _ in range(200)] + ["", "word" * 90 + " end"]
    whole = sentencepiece_fst.Transducer(model)
    want = [whole.encode(t) for t in texts]
    monkeypatch.setattr(sentencepiece_fst, "BATCH", 40)  # texts longer than a batch are cut, the memory overflows
    monkeypatch.setattr(sentencepiece_fst, "REMEMBERED", 100)
    machine = sentencepiece_fst.Transducer(model)
    ids, heads = machine.encode_texts(texts)
    assert [ids[a:b].tolist() for a, b in zip(heads, heads[1:])] == want
    monkeypatch.setattr(np, "cumprod", lambda x: np.zeros_like(x))  # all hashes equal: contents decide
    ids, heads = machine.encode_texts(texts)
    assert [ids[a:b].tolist() for a, b in zip(heads, heads[1:])] == want


def test_path_is_the_least():
    machine = sentencepiece_fst.Transducer(sentencepiece_fst.model_file())

    def paths(s):
        if not s:
            yield []
        for w in range(1, len(s) + 1):
            if w == 1 or s[:w] in machine.id:
                for rest in paths(s[w:]):
                    yield [machine.symbol(s[0]) if w == 1 else machine.id[s[:w]], *rest]

    for s in ("▁there", "ations", "▁▁▁▁▁", "windows", "éation"):
        cost = {tuple(p): sum(machine.weights(np.array([-1, *p[:-1]]), np.array(p)).tolist()) for p in paths(s)}
        least = [p for p, c in cost.items() if c == min(cost.values())]
        assert least == [tuple(machine.shortest_long(s))] and cost[least[0]] == 0 and len(cost) > 1
        assert [made[0] for made in machine.merged(s)] == list(least[0])


def _model(pieces, kind, fallback):
    """A model file: pieces as (text, score, type), unigram (1) or BPE (2), with byte pieces or not."""
    import struct

    def part(n, data):
        return bytes([n << 3 | 2]) + (bytes([len(data)]) if len(data) < 128 else bytes([len(data) & 127 | 128, len(data) >> 7])) + data

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *([(f"<0x{v:02X}>", 0.0, 6) for v in range(256)] if fallback else []), *pieces]
    out = b"".join(part(1, part(1, p.encode()) + b"\x15" + struct.pack("<f", score) + bytes([0x18, t])) for p, score, t in pieces)
    out += part(2, bytes([3 << 3, kind]) + (bytes([0x98, 0x02, 1]) if fallback else b""))  # model_type, byte_fallback
    return out + part(3, part(1, b"identity") + bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("fallback", [True, False])
def test_other_models(kind, fallback):
    import sentencepiece

    rng = random.Random(kind)
    chars = "▁abcd"
    longer = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(2, 5))) for _ in range(40)} | {"▁a", "▁ab", "▁b", "éa"})
    if kind == 2:  # each piece ranks behind the two that it is made of
        known = set(chars) | {"é"}
        longer = [p for p in sorted(longer, key=len) if any(p[:k] in known and p[k:] in known and not known.add(p) for k in range(1, len(p)))]
        scored = [(p, -float(k), 1) for k, p in enumerate(longer)] + [(c, -1000.0, 1) for c in chars]
    else:
        scored = [(p, -rng.random() * 9, 1) for p in [*longer, *chars]]
    model = _model(scored, kind, fallback)
    sp, machine = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_fst.Transducer(model)
    for _ in range(300):
        s = "".join(rng.choice("aabbccdd éx\n") for _ in range(rng.randrange(90)))
        assert machine.encode(s) == sp.encode(s), s
        assert machine.decode(machine.encode(s)) == sp.decode(sp.encode(s))


def _distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(t, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_edit_distance():
    rng = random.Random(8)
    for _ in range(200):
        p, t = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(k, 25))) for k in (1, 0))
        assert decontam.best_match(p, t)[0] == _distance(p, t)


def test_decontamination(spark, none):
    rng = random.Random(9)
    words = ["river", "stone", "cloud", "winter", "letter", "garden", "silver", "engine", "morning", "of", "the", "and", "thunder", "paper"]
    items = [" ".join(rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(30)) for _ in range(20)]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "tiny item")], "item_id bigint, text string")
    rows = []
    for k in range(60):
        s = list(items[k % 20])
        for _ in range(k % 12):
            s[rng.randrange(len(s))] = rng.choice("abcdefg")
        rows.append((k, "Some words before. " + "".join(s).upper() + " and after"))
    rows += [(100, None), (101, ""), (102, " ".join(rng.choice(words) for _ in range(3000))), (103, "a TINY item here")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.op8(d, bench).collect()}
    fold = lambda s: s.lower().encode()
    want = {(k, k % 20): _distance(fold(items[k % 20]), fold(rows[k][1])) for k in range(60)}
    assert len(set(want) - set(got)) <= 1 and all(got[x] == want[x] for x in set(want) & set(got))
    assert (103, 92) in got and not any(i in (100, 101, 102) for i, _ in got)
    assert {r.doc_id for r in decontam.remove(d, bench).collect()} == {i for i, _ in rows} - {i for i, _ in got}
    assert decontam.op8(none, bench).count() == 0


def _edited(s, n, rng):
    for _ in range(n):
        i = rng.randrange(len(s))
        s = s[:i] + rng.choice(["", rng.choice("abcdefgh"), s[i] + rng.choice("abcdefgh")]) + s[i + 1 :]
    return s


def _found(items, text):
    data = np.frombuffer(text.encode(), np.uint8)
    return {k for _, k, *_ in items.search(data, np.array([0, len(data)]))}


def test_decontamination_recall():
    rng = random.Random(4)
    words = ["river", "stone", "cloud", "winter", "letter", "garden", "silver", "engine", "morning", "of", "the", "and", "thunder", "paper"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(15)[:81].strip() for _ in range(60)]
    items = decontam.Items(list(enumerate(texts)), 0.8)
    for share in (0.1, 0.15, 0.2):
        caught = [k in _found(items, f"{prose(9)} {_edited(t, int(share * len(t)), rng)} {prose(9)}") for k, t in enumerate(texts)]
        assert sum(caught) >= 0.95 * len(caught)
    tiny = decontam.Items([(1, "tiny item"), (2, "seventeen letters")], 0.8)
    assert _found(tiny, "a tinny item here") == {0} and _found(tiny, "a tiinny items here") == set() and _found(tiny, "such sevenxeen lettrs") == {1}


def test_decontamination_without_spaces():
    rng = random.Random(6)
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    token = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    texts = [han(60), token(90), "\u00a0".join(token(6) for _ in range(12)), "\u3000".join(han(3) for _ in range(9))]
    items = decontam.Items(list(enumerate(texts)), 0.8)
    for k, t in enumerate(texts):
        assert _found(items, (han if k in (0, 3) else token)(200) + t + (han if k in (0, 3) else token)(200)) == {k}


def test_html(spark):
    page = (
        '<html><head><title>t</title><script>var a="</p>"</script></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">Ok?</div><nav>menu</nav>'
        '<main><article><h1>He<b>ad</b></h1><p>One &amp; two&nbsp;<br>three<aside>side</aside><div class="ad">buy</div><p>four<form><input>f</form><section class="comments"><article>bad</article></section></article></main><footer>f</footer>'
    )
    shared = "same words stand on each page of this host again"
    rows = [(1, "http://a.b/1", page), (2, "http://a.b/2", None), (3, None, ""), (4, "http://h.x/1", f"<p>{shared}</p><p>only here</p>"), (5, "http://h.x/2", f"<div>{shared}</div>other text"), (6, "http://i.x/2", f"<p>{shared}</p>"), (1, "http://a.b/1", page), (7, "http://j.x/", f"<p>{shared}</p>"), (7, "http://j.x/", f"<p>{shared}</p>")]
    p = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit("clash"), "key": F.lit("clash"), "page": F.lit("clash"), "places": F.lit("clash")})
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.op2(p).collect())
    one = "Head One & two three four"
    assert got == [(1, one, len(one)), (1, one, len(one)), (2, "", 0), (3, "", 0), (4, "only here", 9), (5, "other text", 10), (6, shared, len(shared)), (7, shared, len(shared)), (7, shared, len(shared))]
    assert html_extract.op2(p.where("false")).count() == 0
    assert {r.page_id: r.text for r in html_extract.extract(p, array=False).collect()}[4] == f"{shared} only here"  # the array decides it


def test_host_array_equals_brute_force(spark):
    """A host of many pages, most of them without structure: repeats of LEAST tokens over distinct pages, the marked pages' menus included."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    run = lambda n: [rng.choice(words) for _ in range(n)]
    common = [run(rng.randrange(8, 20)) for _ in range(12)]
    pages = []
    for k in range(1500):
        parts = [x for _ in range(3) for x in (run(rng.randrange(12)), rng.choice(common) if rng.random() < 0.6 else [])]
        pages.append((k, [w for x in parts for w in x], k % 10 == 0))
    rows = [(k, f"http://{'h' if k % 3 else 'g'}.x/{k}", (f"<article>text {k}</article><nav>" if marked else "<div>") + " ".join(w)) for k, w, marked in pages]
    got = {r.page_id: r.text for r in html_extract.op2(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)).collect()}
    at = {}
    for k, w, _ in pages:
        for i in range(len(w) - 7):
            at.setdefault((k % 3 > 0, *w[i : i + 8]), set()).add(k)
    for k, w, marked in pages:
        gone = {i + j for i in range(len(w) - 7) if len(at[(k % 3 > 0, *w[i : i + 8])]) > 1 for j in range(8)}
        assert got[k] == (f"text {k}" if marked else " ".join(x for i, x in enumerate(w) if i not in gone)), k


def test_hostile_html():
    import time

    began = time.time()
    for page in ('<a "' * 50000, "<a " * 50000, "<div>" * 20000 + "</p>" * 20000, "<!--" * 50000, "<script>" * 20000, "<a x=\"<a x='" * 20000, "<p>" + "y" * 3_000_000):
        html_extract.regions(page)
    assert time.time() - began < 20
    assert html_extract.regions("<article>one</article><article>two</article>")[0] == ["one"]
    assert html_extract.regions("<article>a<!-- open</article>")[0] == ["a"] and html_extract.regions("<p title='a>b'>c")[1] == ["c"]
    assert html_extract.regions("<div class=ad>x<p>y")[2] == ["x", "y"] and html_extract.regions("<article></article>z") == ([], ["z"], [])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    before = spark.read.parquet(f"{SF}/documents.parquet")
    docs = before
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        if k < len(P.STAGES) - 1:
            assert out.columns == before.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    ids = {r.doc_id for r in docs.collect()}
    texts = {r.doc_id: r.text for r in before.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert len({texts[i] for i in ids}) == len(ids) and not any(x in texts[i] for i in ids for x in items)
    assert {r.doc_id for r in P.run(spark, SF).select("doc_id").collect()} == ids


def test_pipeline_equals_brute_force(spark):
    """Rows of the last stage: each stage's decision by plain Python, over whole texts."""
    import sentencepiece

    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.text or "" for r in P.language(spark, docs, SF).collect()}
    told = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, langid.train(docs.where(~langid.held_out()))).collect()}
    assert set(kept) == {i for i, (lang, score) in told.items() if lang != "und" and score >= P.LEAST_SHARE}
    best = {}
    for i, t in kept.items():
        best[t] = max(i, best.get(t, i))
    kept = {i: t for t, i in best.items()}
    sets = {}
    for i, t in kept.items():
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    kept = {i: t for i, t in kept.items() if find(i) == i}
    items = decontam.Items([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], decontam.SIMILARITY)
    fold = lambda t: decontam.fold(np.frombuffer(t.encode(), np.uint8)).tobytes()
    dirty = {i for i, t in kept.items() for k, p in enumerate(items.texts) if decontam.best_match(p, fold(t), items.masks[k])[0] <= items.limit[k]}
    sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_fst.model_file())
    want = {i: sp.encode(t) for i, t in kept.items() if i not in dirty}
    assert dirty and {r.doc_id: r.ids for r in P.run(spark, SF).collect()} == want


def test_pipeline_columns_and_nothing(spark, rows, none):
    import corpus_pipeline as P

    odd = spark.createDataFrame(rows, DOCS)
    for c in ("key", "digest", "score", "lang_pred", "item_id", "rep", "component_id", "__key", "__text", "n", "k", "l"):
        odd = odd.withColumn(c, F.lit("own"))
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, odd, SF)
        if k < len(P.STAGES) - 1:
            assert out.columns == odd.columns
            got = out.collect()
            assert all(r[c] == "own" for r in got for c in odd.columns[len(none.columns) :]), name
        assert stage(spark, none, SF).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None, None)], DOCS)
    for name, stage in P.STAGES:
        assert stage(spark, nulls, SF).count() == (0 if name == "language" else 1), name


def test_intermediate_data_is_deleted(spark, tmp_path):
    import os

    from bitloom.llm import common

    made = len(common.MADE)
    common.staged(spark.range(5), "trial")
    path = common.MADE[-1].removeprefix("file:")
    assert os.path.isdir(path)
    common.clear(spark, made)
    assert not os.path.exists(path) and len(common.MADE) == made


def test_oracles(spark):
    import duckdb

    from bitloom.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, SF)
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(map(str, df.select(*names).collect())) == sorted(str(r) for r in spark.createDataFrame(want.fetchall(), df.select(*names).schema).collect())


def test_chat_loss_is_read_under_the_mask(spark, monkeypatch):
    """The spans decide what the loss columns hold, and characters beyond the first plane keep their place."""
    import hashlib

    from pyspark.sql import functions as F

    from bitloom.llm import chat

    rows = [(1, 0, "user", "hé 😀"), (1, 1, "assistant", "ab\\c 😀<|im_end|>"), (1, 2, "user", ""), (1, 3, "assistant", "last 中")]
    t = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    said = rows[1][3] + rows[3][3]
    got = chat.op3(spark, t).where("conv_id = 1").first()
    assert (got.loss_chars, got.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    whole = chat.format_turns
    monkeypatch.setattr(chat, "format_turns", lambda x: whole(x).withColumn("loss_spans", F.slice("loss_spans", 2, 1)))
    assert chat.op3(spark, t).where("conv_id = 1").first().loss_chars == len(rows[3][3])


def test_url_rules_come_from_all_tokens(spark):
    """Only the last of many segments tells bad pages; a long URL that repeats has one name for what always stands together."""
    from bitloom.llm import url_filter

    seg = "/".join(f"s{chr(97 + k)}" for k in range(13))
    rows = [(k, f"http://h.net/{seg}/{'ill' if k % 2 else 'well'}") for k in range(12)]
    fixed = "/".join(f"r{chr(97 + k)}" for k in range(26))
    rows += [(100 + k, f"http://x.net/{fixed}/{fixed.upper()}") for k in range(6)]
    rows += [(201, "http://y.net/ill"), (202, "http://y.net/well"), (203, "http://y.net/rz"), (204, "http://y.net/sa")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(p, 1, int(p % 2 if p < 100 else 1)) for p, _ in rows if p < 200], "doc_id bigint, quality int, toxic int")
    got = {r.page_id: (r.verdict, r.confidence) for r in url_filter.op4(pages, labels).collect()}
    assert {got[k] for k in range(0, 12, 2)} == {("allow", None)} and {got[k] for k in range(1, 12, 2)} == {("block", 1.0)}
    assert got[201] == ("block", 1.0) and got[202] == ("allow", None) and got[203] == ("block", 1.0) and got[204] == ("allow", None)
    assert {got[100 + k] for k in range(6)} == {("block", 1.0)}


def test_jaccard_bitmaps_rule_out_no_link():
    rng, ruled_out, far = np.random.default_rng(5), 0, 0
    for k in range(600):
        n = int(rng.integers(1, 700))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        kept = a[rng.random(len(a)) > (k % 12) / 20]
        b = np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 6))).astype(np.uint64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        link = 100 * both >= 85 * (len(a) + len(b) - both)
        may = jaccard_join.may_link(len(a), len(b), jaccard_join.bitmap(a), jaccard_join.bitmap(b))
        assert may or not link
        assert may == jaccard_join.may_link(len(b), len(a), jaccard_join.bitmap(b), jaccard_join.bitmap(a))
        if 2 * both < len(a) + len(b) - both:
            far, ruled_out = far + 1, ruled_out + (not may)
    assert far > 100 and ruled_out > 0.8 * far


def test_among(spark):
    rows = spark.range(-3000, 3000).select(F.when(F.col("id") != 7, F.col("id")).alias("id"), F.lit("x").alias("text"))
    for ids in ([], [-2999], [*range(-3000, 3000, 50), 1 << 40, -(1 << 62)]):
        got = [r.id for r in common.among(rows, spark.createDataFrame([(i,) for i in ids], "id bigint")).collect()]
        assert len(got) == len(set(got)) and set(got) >= {i for i in ids if -3000 <= i < 3000} and len(got) <= len(ids) + 1000
    assert common.among(rows, rows.where("id between -3000 and 2999").select("id")).where("id is not null").count() == 5999


def test_jaccard_join_shuffles_only_texts_that_are_asked_for(spark):
    """Two in a hundred texts are near copies, but no join is small enough to be broadcast by itself."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(400)) for _ in range(1000)]
    d = spark.createDataFrame([doc(i, t) for i, t in enumerate([*texts, *(t + " end" for t in texts[:20])])], DOCS)

    def written():
        store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = store.stageList(None, False, False, none, None)
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    try:
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.set(k, "-1")
        before = written()
        got = {r.doc_id: r.component_id for r in jaccard_join.op6(d).collect()}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        largest = max(v for k, v in written().items() if k not in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known[0])
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        if known[1] is not None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", known[1])
    assert got == {i: i if i < 1000 else i - 1000 for i in range(1020)}
    assert largest < sum(map(len, texts)) / 2


def test_jaccard_join_finds_common_passages_that_no_batch_sees_twice(spark, monkeypatch):
    """Passages in more documents than a dense column has rows, one document a batch: they chain nobody, and links are found."""
    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    short, long = prose(9), prose(45)
    texts = [prose(40) + short for _ in range(120)] + [prose(15) + long + prose(10) for _ in range(80)]
    texts += [[*t[:-1], "other"] for t in texts[:200:9]]
    sets = [{tuple(t[i : i + 4]) for i in range(len(t) - 3)} for t in texts]
    least = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                least = [least[a] if x == least[b] else x for x in least]
    assert len(set(least)) < len(least)
    count, staged = {}, jaccard_join.staged

    def counted(df, tag):
        out = staged(df, tag)
        count[tag] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "staged", counted)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        d = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
        got = {r.doc_id: r.component_id for r in jaccard_join.op6(d).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == dict(enumerate(least))
    assert not count["homes"]


@pytest.mark.parametrize("small", [0, 4 << 20])
def test_html_extraction_broadcasts_by_size_in_memory(spark, monkeypatch, small):
    """The salted repeats never go through the driver, whatever the session's threshold, and covers only if they are small."""
    plans, staged = {}, html_extract.staged
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def seen(df, tag):
        plans[tag] = plan(df)
        return staged(df, tag)

    monkeypatch.setattr(html_extract, "staged", seen)
    monkeypatch.setattr(html_extract, "_SMALL", small, raising=False)
    menu = "one two three four five six seven eight nine ten"
    pages = spark.createDataFrame([(k, "http://a.org/", f"<div>{menu}</div><div>{k} is new</div>") for k in range(3)], "page_id bigint, url string, html string")
    out = html_extract.op2(pages)
    assert {(r.page_id, r.text) for r in out.collect()} == {(k, f"{k} is new") for k in range(3)}
    assert "BroadcastHashJoin" not in plans["covers"]
    assert ("BroadcastHashJoin" in plan(html_extract.extract(pages))) == bool(small)
