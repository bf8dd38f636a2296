"""Language identification of mixed-language text.

Script ranges narrow the languages a word can be of; per-word scores of byte n-grams (2 to 4 bytes, word
boundaries included) rate the rest; a Viterbi pass with a penalty for switching labels every word, so that
runs of words in one language become spans. The language of a text is the one whose spans hold most bytes,
and the score is their share.

The model is a table of n-gram log probabilities for each language and is learnt from a sample of labelled
texts whose size has the bound ``TRAIN_DOCS`` per language (whole texts, chosen by a hash of the id).

Defined results: null text, or text without a letter, gives ``und`` and score 0; a text whose scripts were
never learnt gives the language with most labelled rows and score 0; with no labelled rows at all everything
is ``und``; ties go to the language first in alphabetical order; repeated rows get equal results; an empty
table gives an empty result; columns beside the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.packed import pieces, text_bytes, tidy

TRAIN_DOCS = 1500
#: Languages that are learnt, those with most labelled rows: a bound on the model (0.2 MB each).
MOST_LANGS = 256
SWITCH_PENALTY = 12.0
SLOTS = 1 << 14
UNKNOWN = "und"
#: Bytes of text that take the Viterbi steps side by side.
PIECE_BYTES = 1_000_000
#: A language can be written in a script if so large a share of its learnt words is.
SCRIPT_SHARE = 0.005
_ORDERS = (2, 3, 4)
LABEL = "struct<lang_pred: string, score: double, spans: array<struct<start: bigint, end: bigint, lang: string>>>"


def _script_table() -> np.ndarray:
    """Script number by the lead byte of a UTF-8 character: 0 none, 1 Latin, 2 Greek, 3 Cyrillic, 4 Armenian and
    Hebrew, 5 Arabic, 6 Indic and Thai, 7 other syllabaries, 8 kana and CJK signs, 9 Han, 10 Hangul, 11 supplementary."""
    t = np.zeros(256, np.uint8)
    for lo, hi, script in ((0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC3, 0xCA, 1), (0xCD, 0xCF, 2), (0xD0, 0xD4, 3), (0xD5, 0xD7, 4), (0xD8, 0xDD, 5), (0xE0, 0xE0, 6), (0xE1, 0xE1, 7), (0xE3, 0xE3, 8), (0xE4, 0xE9, 9), (0xEA, 0xED, 10), (0xF0, 0xF4, 11)):
        t[lo : hi + 1] = script
    return t


SCRIPT = _script_table()
N_SCRIPTS = 12


def clean(data: np.ndarray) -> np.ndarray:
    """Lower-cased letters and other bytes of words; everything else is a space."""
    d = data.copy()
    prev = np.empty_like(d)
    prev[:1], prev[1:] = 0x20, d[:-1]
    upper = (d >= 0x41) & (d <= 0x5A)
    upper |= (prev == 0xC3) & (d >= 0x80) & (d <= 0x9E) & (d != 0x97)
    d[upper] += 0x20
    word = ((d >= 0x61) & (d <= 0x7A)) | (d >= 0x80)
    two = (d == 0xC2) | (prev == 0xC2)  # signs from U+0080 to U+00BF
    three = (d == 0xE2)
    three[1:] |= d[:-1] == 0xE2
    three[2:] |= d[:-2] == 0xE2
    d[~word | two | (three & (d >= 0x80))] = 0x20
    return d


def slots(d: np.ndarray) -> list[np.ndarray]:
    """Table slots of the n-grams that begin just before, or at, every byte; one array per order."""
    x = np.empty(len(d) + 4, np.uint32)
    x[0], x[-3:], x[1:-3] = 0x20, 0x20, d
    n, out = len(d), []
    for order in _ORDERS:
        h = np.full(n, 0x811C9DC5 + order, np.uint32)
        for k in range(order):
            h = (h ^ x[k : k + n]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        out.append(((h * np.uint32(0x2C1B3C6D)) >> np.uint32(18)).astype(np.int64))
    return out


def words(d: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; bounds are the offsets of texts, over which no word reaches."""
    inside = np.zeros(len(d) + 2, np.int8)
    inside[1:-1] = d != 0x20
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = bounds[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(d))])
    cuts = cuts[(d[cuts] != 0x20) & (d[cuts - 1] != 0x20)]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends


@dataclass
class Model:
    langs: list[str]
    tables: list[np.ndarray]  # for each order: SLOTS x languages, float32
    allowed: np.ndarray  # scripts x languages
    fallback: str

    def emissions(self, d: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros((0, len(self.langs)), np.float32)
        per = self.tables[0][(s := slots(d))[0]]
        per += self.tables[1][s[1]]
        per += self.tables[2][s[2]]
        both = np.empty(2 * len(starts), np.int64)
        both[0::2], both[1::2] = starts, ends
        if both[-1] == len(d):
            per = np.concatenate([per, np.zeros((1, per.shape[1]), np.float32)])
        return np.add.reduceat(per, both, axis=0)[0::2]


def viterbi(e: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Labels of all words: e holds their scores, first and count give the words of each text. The texts go
    through the recurrence side by side, longest first, so one step serves all that still have words."""
    label = np.zeros(len(e), np.int16)
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    if not len(order):
        return label
    n, start = count[order], first[order]
    alive = np.searchsorted(-n, -np.arange(n[0]), "left")  # texts with more than t words
    stay = np.zeros(e.shape, bool)
    came = np.zeros(len(e), np.int16)
    score = e[start].astype(np.float64)
    for t in range(1, int(n[0])):
        k = alive[t]
        at = start[:k] + t
        s = score[:k]
        best = s.argmax(1)
        switched = s[np.arange(k), best] - penalty
        keep = s >= switched[:, None]
        stay[at], came[at] = keep, best
        score[:k] = np.where(keep, s, switched[:, None]) + e[at]
    last = score.argmax(1).astype(np.int16)
    for t in range(int(n[0]) - 1, -1, -1):
        k = alive[t]
        at = start[:k] + t
        label[at] = last[:k]
        if t:
            last[:k] = np.where(stay[at, last[:k]], last[:k], came[at])
    return label


def predict(model: Model, data: np.ndarray, offsets: np.ndarray, texts, spans: bool = False) -> list[tuple]:
    """(language, score, spans) of each text."""
    n = len(offsets) - 1
    d = clean(data)
    starts, ends = words(d, offsets)
    doc = np.searchsorted(offsets, starts, "right") - 1
    e = model.emissions(d, starts, ends)
    script = np.maximum.reduceat(SCRIPT[d], starts) if len(starts) else np.empty(0, np.uint8)
    known = model.allowed.any(1)[script] if len(script) else np.empty(0, bool)
    e[~known] = 0
    e[(~model.allowed[script]) & known[:, None]] = -1e6
    first = np.searchsorted(doc, np.arange(n), "left")
    count = np.searchsorted(doc, np.arange(n), "right") - first
    label = viterbi(e, first, count)
    size = np.where(known, ends - starts, 0)
    n_langs = len(model.langs)
    share = np.bincount(doc * n_langs + label, weights=size, minlength=n * n_langs).reshape(n, n_langs) if len(doc) else np.zeros((n, n_langs))
    total, best = share.sum(1), share.argmax(1)
    ascii_letter = np.zeros(n, bool)
    ascii_letter[doc[((d[starts] >= 0x61) & (d[starts] <= 0x7A))]] = True
    out = []
    for i in range(n):
        if not ascii_letter[i] and not _has_letter(texts[i]):
            out.append((UNKNOWN, 0.0, []))
            continue
        if total[i] <= 0:
            out.append((model.fallback, 0.0, []))
            continue
        runs = []
        if spans:
            w = slice(first[i], first[i] + count[i])
            lab = label[w]
            cut = np.flatnonzero(np.diff(lab)) + 1
            a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(lab)]])
            runs = [{"start": int(starts[w][p] - offsets[i]), "end": int(ends[w][q - 1] - offsets[i]), "lang": model.langs[lab[p]]} for p, q in zip(a, b, strict=True)]
        out.append((model.langs[best[i]], float(share[i, best[i]] / total[i]), runs))
    return out


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most: int = TRAIN_DOCS) -> Model | None:
    """Learn from labelled rows of docs; None if there are none."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("x"))
    counted = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(MOST_LANGS)
    per = {r["l"]: r["n"] for r in counted.collect()}  # one row per language
    langs = sorted(per)
    if not langs:
        return None
    top = {k: min((1 << 63) - 1, (1 << 64) * most // v - (1 << 63)) for k, v in per.items()}  # hashes are even over 64 bits
    least = F.element_at(F.create_map(*[F.lit(x) for pair in top.items() for x in pair]), F.col("l"))
    # every split is filtered by its own task; only the sample, about `most` texts a language, moves on
    sample = rows.where(F.xxhash64(F.coalesce("i", F.lit("")), F.lit("train")) <= least).select("l", "x").repartition(8)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            data, offsets = text_bytes(b.column("x"))
            for i, l in enumerate(b.column("l").to_pylist()):
                d = clean(data[offsets[i] : offsets[i + 1]])
                acc = seen.setdefault(l, np.zeros(3 * SLOTS + N_SCRIPTS, np.int64))
                inside = d != 0x20
                for k, s in enumerate(slots(d)):
                    acc[k * SLOTS : (k + 1) * SLOTS] += np.bincount(s[inside], minlength=SLOTS)
                starts, _ = words(d, np.array([0, len(d)]))
                if len(starts):
                    acc[3 * SLOTS :] += np.bincount(np.maximum.reduceat(SCRIPT[d], starts), minlength=N_SCRIPTS)
        for l, acc in seen.items():
            at = np.flatnonzero(acc)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(acc[at], pa.int64())], ["l", "slot", "n"])

    counts = sample.mapInArrow(count, "l string, slot int, n bigint").groupBy("l", "slot").agg(F.sum("n").alias("n"))
    table = np.zeros((3 * SLOTS + N_SCRIPTS, len(langs)))
    at = {l: k for k, l in enumerate(langs)}
    got = counts.toArrow()  # at most languages x (3 SLOTS + scripts) rows
    if got.num_rows:
        table[got.column("slot").to_numpy(), [at[l] for l in got.column("l").to_pylist()]] = got.column("n").to_numpy()
    tables = []
    for k in range(3):
        c = table[k * SLOTS : (k + 1) * SLOTS] + 0.1
        logp = np.log(c / c.sum(0))
        # the n-grams of one byte overlap: a third of each; what all languages share says nothing
        tables.append(np.ascontiguousarray(((logp - logp.mean(1, keepdims=True)) / 3).astype(np.float32)))
    words_by_script = table[3 * SLOTS :]
    allowed = words_by_script >= SCRIPT_SHARE * np.maximum(words_by_script.sum(0), 1)
    allowed[0] = False
    return Model(langs, tables, allowed, max(langs, key=lambda l: (per[l], l)))


def labels(spark: SparkSession, model: Model | None, text: Column, spans: bool = False) -> Column:
    """struct(lang_pred, score, spans) of a text column. Only the text goes through Python, whatever the row holds."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.array().alias("spans")).cast(LABEL)
    shared = spark.sparkContext.broadcast(model)  # MOST_LANGS x 3 SLOTS floats at most
    run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def label(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for column in columns:
            data, offsets = text_bytes(column)
            out = []
            for i, j in pieces(offsets, PIECE_BYTES):
                out += predict(m, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _Lazy(column, i), spans)
            lang, score, found = zip(*out) if out else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(found, run)], ["lang_pred", "score", "spans"])

    return F.arrow_udf(tidy(label), LABEL, F.ArrowUDFType.SCALAR_ITER)(text)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), spans: bool = False) -> DataFrame:
    """keep columns, lang_pred, score and, if asked for, the labelled spans (byte offsets) of every whole text."""
    found = docs.select(F.struct(*keep).alias("k"), labels(docs.sparkSession, model, F.col(text_col), spans).alias("l"))
    return found.select("k.*", "l.lang_pred", "l.score", *(["l.spans"] if spans else []))


class _Lazy:
    """Texts of a column from row i on, made only when asked for."""

    def __init__(self, column: pa.Array, i: int):
        self.column, self.i = column, i

    def __getitem__(self, k: int) -> str | None:
        return self.column[self.i + k].as_py()


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op9(docs: DataFrame) -> DataFrame:
    model = train(docs.where(~held_out()))
    out = identify(docs, model, spans=True)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_lang_spans"))
