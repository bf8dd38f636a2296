"""N-gram Jaccard self-join as a blocked sparse matrix product.

The document by shingle incidence matrix is multiplied with its transpose in blocks, and what cannot reach the
similarity is left out by bounds that follow from set sizes alone. Nothing is estimated: every link counts.

1. Documents with equal shingle sets are one class; its smallest id stands for it. Only classes go on.
2. Shingles are ordered by their hash, but those that are met often come last (any order is right, this one keeps common passages out of
   the posted part): first those that map batches met often (``HOT`` of them at most), then, for what single batches can't see, those that
   more than ``FEW`` classes have among the first shingles of this order (and of those for which that leaves too few, among all),
   counted over all classes and known to the tasks as a bitmap of hashes. Two sets with Jaccard t or more share one of the first n - ceil(t n) + 1
   shingles of either (size bound), so only those are posted; each set keeps ``SPARE`` more of them, so that few texts have to be read again
   for the second order. The product of the posted columns is accumulated
   per pair; a pair goes on only if the shingles before and behind each shared one, and its overlap so far plus what is left behind the last
   shared shingle of both can reach t / (1 + t) of the two sizes. Columns with more than ``DENSE`` rows aren't multiplied out: their rows
   are chained, which keeps every pair connected and makes one edge per row. Map tasks chain dense columns of
   their own batch already, so a shingle of a third of all documents never meets in one place.
3. Each set has a bitmap of one to two bits a shingle. A bit that only one of two sets has stands for a shingle at least that the other lacks,
   so pairs whose bitmaps leave too small an overlap go. The other candidate pairs are counted exactly with whole sets, by the smaller id. Of the
   texts only those that are asked for are shuffled, whatever the size of the table. Components of the chains are cut into homes, by
   size (sets in a ratio of t or more are in the same band or the next). Only pairs that no links connect so far have to be
   counted: while a home has more than ``BLOCK`` shingles outside its largest connected part, a pivot from there is counted
   exactly with all of the home, in parts of about BLOCK shingles (``PIVOTS`` at once, ``ROUNDS`` times at most; one group of near copies is
   connected by a few pivots). What is still outside is multiplied exactly with whole sets, in blocks, with the whole home.
   Within a task pairs that are already connected need no count. Output: links that connect.
4. Components of the links give component_id.

Words: maximal runs of bytes other than space and U+0009 to U+000D, A-Z lower-cased; a set's shingles are hashes of
64 bits. Defined results: null, empty or blank text has an empty set and links with nothing; fewer words than a shingle's
make one shingle of all; rows with a null id get their set size and themselves (null) as component; rows with one
id are one document of several texts; an empty table gives an empty result; columns beside the named ones are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import BITMAP, BITS_EACH, MOST_BITS, among, partitions_for, shuffle_partitions, staged
from bitloom.llm.graph import components
from bitloom.llm.packed import by_part, mix64, pieces, starts_to_ranges, text_bytes, tidy

WORDS = 4
#: Similarity as a fraction, so that bounds are exact.
NUM, DEN = 85, 100
Rate = tuple[int, int]
DENSE = 48
#: Shingles in a block of sets, about: it bounds what a task holds.
BLOCK = 250_000
#: Bytes of prefixes for a shuffle partition of postings, and for a part of it: a partition is sorted by parts, and a task holds one at a time.
PARTITION_BYTES, PART_BYTES = 256 << 20, 16 << 20
#: Pivots of a home in one round, and rounds; each round takes one pass over the home.
PIVOTS, ROUNDS = 4, 3
#: The members of a pivot meet its label in so many places.
SALT = 16
#: Shingles that are put last: a bound on what is broadcast, 8 bytes each.
HOT = 400_000
#: A shingle that more classes have among their first ones comes later in the order.
FEW = 4
#: Shingles behind the posted part that a set keeps: so many, and a quarter of the posted part.
SPARE = 8
#: A batch calls shingles common that two of its documents have or more, the most frequent ones up to this number.
COMMON_MOST = 20_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_VALUE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 19)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            _POWERS[name] = p
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words before each text (one more entry than texts)."""
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[~_SPACE[data[cuts]] & ~_SPACE[data[cuts - 1]]] if len(cuts) else cuts
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[_LOWER[data]] * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets, "left")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, first = word_hashes(data, offsets)
    m = len(h) - words + 1
    every = np.zeros(max(m, 0), np.uint64)
    for k in range(words if m > 0 else 0):
        every = mix64(every * np.uint64(_BASE) + h[k : k + m])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(every[a : b - words + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = mix64(x * np.uint64(_BASE) + h[k])
            out.append(x)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def needed(n_a, n_b, rate: Rate = (NUM, DEN)):
    """Least overlap of two sets of these sizes with den * overlap >= num * union."""
    num, den = rate
    return -((-num * (n_a + n_b)) // (num + den))


def prefix_length(n: int, rate: Rate = (NUM, DEN)) -> int:
    num, den = rate
    return n - -(-num * n // den) + 1 if n else 0


def bitmap(s: np.ndarray) -> bytes:
    """The low bits of the shingles as places in a bitmap, whose length is a power of two of at least their number."""
    marks = np.zeros(max(64, 1 << (len(s) - 1).bit_length()), bool)
    marks[(s & np.uint64(len(marks) - 1)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def may_link(n_a: int, n_b: int, bits_a: bytes, bits_b: bytes, rate: Rate = (NUM, DEN)) -> bool:
    """False if the bitmaps of two sets rule a link out."""
    a, b = np.frombuffer(bits_a, np.uint64), np.frombuffer(bits_b, np.uint64)
    if len(a) != len(b):  # folding the longer one gives what it would be at the other's length
        size = min(len(a), len(b))
        a, b = (np.bitwise_or.reduce(x.reshape(-1, size), axis=0) for x in (a, b))
    only_a, only_b = int(np.bitwise_count(a & ~b).sum()), int(np.bitwise_count(b & ~a).sum())
    return min(n_a - only_a, n_b - only_b) >= needed(n_a, n_b, rate)


def _may_link(rate: Rate):
    """a, b of the pairs that their bitmaps don't rule out."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_a, n_b = b.column("n_a").to_pylist(), b.column("n_b").to_pylist()
            keep = [may_link(x, y, s.as_buffer(), t.as_buffer(), rate) for x, y, s, t in zip(n_a, n_b, b.column("bits_a"), b.column("bits_b"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _common(words: int):
    """Shingles that many documents of a batch have."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(0))
            sets = [s for i, j in pieces(offsets) for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)]
            token, count = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
            use = np.flatnonzero(count > 1)
            if len(use) > COMMON_MOST:
                use = use[np.argsort(-count[use], kind="stable")[:COMMON_MOST]]
            yield pa.RecordBatch.from_arrays([pa.array(token[use].view(np.int64)), pa.array(count[use])], ["token", "n"])

    return run


def common_shingles(rows: DataFrame, words: int = WORDS) -> np.ndarray:
    """The shingles of rows (text) that come last in the order, sorted."""
    counted = rows.select("text").mapInArrow(_common(words), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(HOT).select("token").toArrow()  # HOT rows at most
    return np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64))


def kept_length(n: int, rate: Rate = (NUM, DEN)) -> int:
    p = prefix_length(n, rate)
    return min(n, p + p // 4 + SPARE) if n else 0


def is_marked(marks: bytes | None, s: np.ndarray) -> np.ndarray:
    """Which of the shingles the bitmap holds; there may be a few others."""
    if not marks:
        return np.zeros(len(s), bool)
    held = np.frombuffer(marks, np.uint8)
    slot = (s & np.uint64(8 * len(held) - 1)).astype(np.int64)
    return (held[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _sketch(common, words: int, rate: Rate, marks=None):
    """Size, fingerprint, bitmap and the first shingles in the order of each set, the common ones and those of marks last. early: how many
    of them are neither."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, marked = common.value, marks.value if marks else None
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            n, sums, mixes, prefixes, bits, early = [], [], [], [], [], []
            for i, j in pieces(offsets):
                for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words):
                    n.append(len(s))
                    sums.append(int(s.sum(dtype=np.uint64)) if len(s) else 0)
                    mixes.append(int(mix64(s ^ np.uint64(_BASE)).sum(dtype=np.uint64)) if len(s) else 0)
                    bits.append(bitmap(s) if len(s) else b"")
                    is_late = is_marked(marked, s)
                    if len(late) and len(s):
                        is_late |= late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
                    kept = kept_length(len(s), rate)
                    early.append(min(kept, len(s) - int(is_late.sum())))
                    prefixes.append(np.concatenate([s[~is_late], s[is_late]])[:kept].tobytes())
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(n, pa.int32()), pa.array(np.array(sums, np.uint64).view(np.int64)), pa.array(np.array(mixes, np.uint64).view(np.int64)), pa.array(prefixes, pa.binary()), pa.array(bits, pa.binary()), pa.array(early, pa.int32()),
            ], ["id", "n", "fp1", "fp2", "prefix", "bits", "early"])

    return run


_SKETCH = "id bigint, n int, fp1 bigint, fp2 bigint, prefix binary, bits binary, early int"


def _deal(parts: int, words: int = 0):
    """(part, blob) rows: the low halves of first shingles (prefix), dealt by the high ones. With words those of whole texts."""

    def dealt(token: np.ndarray) -> pa.RecordBatch:
        part = (token >> np.uint64(32)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        at, low = np.searchsorted(part[order], np.arange(parts + 1)), token[order].astype(np.uint32)
        full = np.flatnonzero(np.diff(at)).tolist()
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([low[at[p] : at[p + 1]].tobytes() for p in full], pa.binary())], ["part", "blob"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(0))
            if not words:
                yield dealt(np.frombuffer(data.tobytes(), np.uint64))
                continue
            for i, j in pieces(offsets):
                yield dealt(np.concatenate(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)))

    return run


@tidy
def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The low halves that a part has more than FEW times."""
    for held in by_part(batches):
        low, count = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for b in held for x in b.column(1)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(low[count > FEW].astype(np.int64))], ["low"])


def frequent(sets: DataFrame, partitions: int, parts: int, words: int = 0) -> DataFrame:
    """Low halves of the shingles that more than FEW rows of sets have (see _deal)."""
    dealt = sets.mapInArrow(_deal(parts, words), "part int, blob binary").repartition(partitions, "part").sortWithinPartitions("part")
    return staged(dealt.mapInArrow(_frequent, "low bigint"), "frequent")


def marks_of(low: DataFrame) -> bytes:
    """A bitmap of shingles, empty if there are none. It is put together in the cluster and has MOST_BITS bits at most: with more shingles
    it puts others last too, which is right as well."""
    n = low.count()
    if not n:
        return b""
    bits = min(max(BITMAP, 1 << (BITS_EACH * n).bit_length()), MOST_BITS)
    slot = F.col("low").bitwiseAND(bits - 1)
    pages = low.groupBy(F.shiftright(slot, BITMAP.bit_length() - 1).alias("page")).agg(F.bitmap_construct_agg(slot.bitwiseAND(BITMAP - 1)).alias("marks")).toArrow()
    out = np.zeros((bits // BITMAP, BITMAP // 8), np.uint8)
    for page, marks in zip(pages.column("page").to_pylist(), pages.column("marks").to_pylist(), strict=True):
        out[page] = np.frombuffer(marks, np.uint8)
    return out.tobytes()


def _choose(marks, rate: Rate):
    """The posted part of each class under the order in which marks come late; null where the kept shingles don't tell."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prefixes = []
            for n, early, kept in zip(b.column("n").to_pylist(), b.column("early").to_pylist(), b.column("prefix"), strict=True):
                s, p = np.frombuffer(kept.as_buffer(), np.uint64), prefix_length(n, rate)
                late = is_marked(marks.value, s)
                late[early:] = True
                if len(s) - int(late.sum()) >= p or len(s) == n:
                    prefixes.append(np.concatenate([s[~late], np.sort(s[late])])[:p].tobytes())
                else:
                    prefixes.append(None)
            i = b.schema.get_field_index("prefix")
            yield b.set_column(i, "prefix", pa.array(prefixes, pa.binary())).select(["id", "n", "fp1", "fp2", "prefix"])

    return run


def posted(rows: DataFrame, classes: DataFrame, common, partitions: int, parts: int, words: int, rate: Rate) -> DataFrame:
    """id, n and posted part (prefix) of classes (id, n, fp1, fp2, prefix, early). The texts of those whose kept shingles don't tell are
    read again: all their shingles are counted, and then their posted part is taken."""
    share = classes.sparkSession.sparkContext.broadcast
    kept = classes.select("id", "n", "fp1", "fp2", "prefix", "early")
    choose = lambda marks: kept.mapInArrow(_choose(marks, rate), "id bigint, n int, fp1 bigint, fp2 bigint, prefix binary")
    unsure_of = lambda told: staged(told.where("prefix is null").select("id", "n", "fp1", "fp2").distinct(), "unsure")
    low = frequent(classes.select("prefix"), partitions, parts)
    marks = share(marks_of(low))
    told = choose(marks)
    unsure = unsure_of(told)
    if unsure.isEmpty():
        return told.select("id", "n", "prefix")
    more = frequent(among(rows, unsure).select("text"), partitions, parts, words)
    marks = share(marks_of(low.unionByName(more)))
    told = choose(marks)
    unsure = unsure_of(told)
    again = among(rows, unsure).mapInArrow(_sketch(common, words, rate, marks), _SKETCH).join(unsure, ["id", "n", "fp1", "fp2"], "left_semi")
    length = F.expr(f"cast(8 * (n - ({rate[0]}L * n + {rate[1] - 1}L) div {rate[1]}L + 1) as int)")
    again = again.select("id", "n", F.substring("prefix", F.lit(1), length).alias("prefix"))
    return told.where("prefix is not null").select("id", "n", "prefix").unionByName(again)


def _posting(parts: int):
    """(part, blob) rows: postings sorted by shingle, and chains of the columns that are dense in a batch."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, offsets = text_bytes(b.column(2))
            length = np.diff(offsets) // 8
            token = np.frombuffer(data.tobytes(), np.uint64)
            doc = np.repeat(np.arange(len(ids)), length)
            pos = starts_to_ranges(np.zeros(len(ids), np.int64), length).astype(np.int32)
            order = np.argsort(token, kind="stable")
            token, doc, pos = token[order], doc[order], pos[order]
            dense = np.zeros(len(token), bool)
            edges = np.empty((0, 2), np.int64)
            if len(token):
                begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
                count = np.diff(np.concatenate([begin, [len(token)]]))
                full = count > DENSE
                rows = starts_to_ranges(begin[full], count[full])
                head = np.repeat(doc[begin[full]], count[full])
                edges = np.unique(np.stack([ids[head], ids[doc[rows]]], 1), axis=0)
                edges = edges[edges[:, 0] != edges[:, 1]]
                dense[begin[full]] = True
                keep = np.ones(len(token), bool)
                keep[rows] = False
                keep[begin[full]] = True
                token, doc, pos, dense = token[keep], doc[keep], pos[keep], dense[keep]
            part = (token >> np.uint64(32)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            at = np.searchsorted(part[order], np.arange(parts + 1))
            out_part, kind, blobs = [], [], []
            for p in np.flatnonzero(np.diff(at)).tolist():
                o = order[at[p] : at[p + 1]]
                out_part.append(p)
                kind.append(0)
                blobs.append(b"".join((np.int64(len(o)).tobytes(), token[o].tobytes(), ids[doc[o]].tobytes(), n[doc[o]].astype(np.int32).tobytes(), pos[o].tobytes(), dense[o].tobytes())))
            if len(edges):
                out_part.append(int(edges[0, 0] % parts))
                kind.append(1)
                blobs.append(edges.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_part, pa.int32()), pa.array(kind, pa.int32()), pa.array(blobs, pa.binary())], ["part", "kind", "blob"])

    return run


_ALWAYS = 1 << 40


def _multiply(rate: Rate):
    """Overlaps of pairs over the columns of each part: a < b, overlap, last shared place in either, sizes."""
    num, den = rate

    def columns(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        chains = []
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                buf = blob.as_buffer()
                if kind:
                    chains.append(np.frombuffer(buf, np.int64).reshape(-1, 2))
                    continue
                k, at = int(np.frombuffer(buf, np.int64, 1)[0]), 8
                for c, kind_of in zip(cols, (np.uint64, np.int64, np.int32, np.int32, np.bool_), strict=True):
                    c.append(np.frombuffer(buf, kind_of, k, at))
                    at += k * np.dtype(kind_of).itemsize
        edges = np.unique(np.concatenate(chains), axis=0) if chains else np.empty((0, 2), np.int64)
        if cols[0]:
            token, doc, n, pos, dense = (np.concatenate(c) for c in cols)
            order = np.lexsort((doc, n, token))
            token, doc, n, pos, dense = token[order], doc[order], n[order], pos[order], dense[order]
            begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            count = np.diff(np.concatenate([begin, [len(token)]]))
            full = (count > DENSE) | (np.add.reduceat(dense, begin) > 0)
            full &= count > 1
            rows = starts_to_ranges(begin[full], count[full])
            chain = np.stack([np.repeat(doc[begin[full]], count[full]), doc[rows]], 1)
            edges = np.unique(np.concatenate([edges, chain]), axis=0)
            few = (count > 1) & ~full
            found = []
            at, c = begin[few], count[few]
            for gap in range(1, int(c.max()) if len(c) else 0):  # rows so far apart in their column, which is sorted by size
                more = c > gap
                left = starts_to_ranges(at[more], c[more] - gap)
                right = left + gap
                ok = n[left].astype(np.int64) * den >= n[right].astype(np.int64) * num
                ok &= doc[left] != doc[right]
                left, right = left[ok], right[ok]
                # other shared shingles are before this one in both sets or behind it in both
                most = np.minimum(pos[left], pos[right]) + np.minimum(n[left] - pos[left], n[right] - pos[right])
                ok = most >= needed(n[left].astype(np.int64), n[right].astype(np.int64), rate)
                found.append(np.stack([left[ok], right[ok]], 1))
            if found and sum(map(len, found)):
                left, right = np.concatenate(found).T
                swap = doc[left] > doc[right]
                left, right = np.where(swap, right, left), np.where(swap, left, right)
                order = np.lexsort((doc[right], doc[left]))
                left, right = left[order], right[order]
                a, b = doc[left], doc[right]
                new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                yield _pairs(a[new], b[new], np.diff(np.concatenate([new, [len(a)]])), np.maximum.reduceat(pos[left], new), np.maximum.reduceat(pos[right], new), n[left[new]], n[right[new]])
        edges = edges[edges[:, 0] != edges[:, 1]]
        if len(edges):
            none = np.zeros(len(edges), np.int64)
            lo, hi = edges.min(1), edges.max(1)
            yield _pairs(lo, hi, none + _ALWAYS, none, none, none, none)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_part(batches):
            yield from columns(held)

    return run


def _pairs(a, b, overlap, pos_a, pos_b, n_a, n_b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(x, np.int64)) for x in (a, b, overlap, pos_a, pos_b, n_a, n_b)], ["a", "b", "overlap", "pos_a", "pos_b", "n_a", "n_b"]
    )


def candidates(classes: DataFrame, partitions: int, parts: int, rate: Rate = (NUM, DEN)) -> DataFrame:
    """a, b, dense from classes (id, n, prefix). Every similar pair is either a row that isn't dense or connected by dense rows."""
    blobs = classes.mapInArrow(_posting(parts), "part int, kind int, blob binary").repartition(partitions, "part").sortWithinPartitions("part")
    pairs = blobs.mapInArrow(_multiply(rate), "a bigint, b bigint, overlap bigint, pos_a bigint, pos_b bigint, n_a bigint, n_b bigint")
    whole = pairs.groupBy("a", "b").agg(F.sum("overlap").alias("o"), F.max("pos_a").alias("pa"), F.max("pos_b").alias("pb"), F.max("n_a").alias("na"), F.max("n_b").alias("nb"))
    most = F.col("o") + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)
    dense = F.col("o") >= _ALWAYS
    return whole.where(dense | (most * sum(rate) >= rate[0] * (F.col("na") + F.col("nb")))).select("a", "b", dense.alias("dense"))


def possible(pairs: DataFrame, sketches: DataFrame, rate: Rate = (NUM, DEN)) -> DataFrame:
    """The pairs (a, b) that the bitmaps of their sets (id, n, bits) don't rule out. An id may have several sets."""
    known = among(sketches, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    for c in ("a", "b"):
        pairs = pairs.join(known.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")), c)
    return pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_may_link(rate), "a bigint, b bigint").distinct()


def link_block(ids: list[int], sets: list[np.ndarray], labels: list[int], rate: Rate = (NUM, DEN)) -> list[tuple[int, int]]:
    """Links that connect the sets of one block pair; sets with one label are connected already."""
    n = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((np.array(ids), n))
    flat = np.concatenate([sets[i] for i in order])
    size = n[order]
    first = np.concatenate([[0], np.cumsum(size)])
    _, token = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(order)), size)
    by_token = np.argsort(token, kind="stable")
    owner_of = owner[by_token]
    start = np.concatenate([[0], np.cumsum(np.bincount(token))])
    part = np.unique(np.array(labels)[order], return_inverse=True)[1]
    out: list[tuple[int, int]] = []

    def union(a: int, b: int) -> None:
        if part[a] != part[b]:
            part[part == part[a]] = part[b]
            out.append((a, b))

    lowest = np.searchsorted(size * rate[1], size * rate[0], "left")  # sets from there on are large enough
    for i in range(1, len(order)):
        lo = int(lowest[i])
        if not (part[lo:i] != part[i]).any():
            continue
        # neighbours first: in a group of near copies the set before is one of them
        mine = flat[first[i] : first[i + 1]]
        if part[i - 1] != part[i] and _similar(mine, flat[first[i - 1] : first[i]], rate):
            union(i, i - 1)
            if not (part[lo:i] != part[i]).any():
                continue
        t = token[first[i] : first[i + 1]]
        rows = owner_of[starts_to_ranges(start[t], start[t + 1] - start[t])]
        rows = rows[(rows < i) & (rows >= lo)]
        rows = rows[part[rows] != part[i]]
        if not len(rows):
            continue
        overlap = np.bincount(rows - lo, minlength=i - lo)
        hits = np.flatnonzero(overlap >= needed(size[i], size[lo:i], rate)) + lo
        for k in hits.tolist():
            union(i, k)
    return [(ids[order[a]], ids[order[b]]) for a, b in out]


def _similar(a: np.ndarray, b: np.ndarray, rate: Rate = (NUM, DEN)) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return rate[1] * both >= rate[0] * (len(a) + len(b) - both)


def link_star(centers: set[int], ids: list[int], sets: list[np.ndarray], rate: Rate = (NUM, DEN)) -> list[tuple[int, int]]:
    """Links of some classes with all others."""
    mine = [(i, s) for i, s in zip(ids, sets, strict=True) if i in centers]
    return [(c, i) for i, s in zip(ids, sets, strict=True) for c, m in mine if i != c and _similar(m, s, rate)]


def _verify(words: int, rate: Rate):
    """Rows sorted by key: id, label, text. A key is a block pair, or holds the ids of classes that are compared with all others of
    the key ("star:id", "star:id,id:part"). One key is in memory at a time."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, labels = None, [], [], []

        def done():
            links = link_star({int(c) for c in key.split(":")[1].split(",")}, ids, sets, rate) if key.startswith("star:") else link_block(ids, sets, labels, rate) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            keys, own, known = b.column("key").to_pylist(), b.column("id").to_pylist(), b.column("label").to_pylist()
            for i, j in pieces(offsets):
                for k, s in zip(range(i, j), shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words), strict=True):
                    if keys[k] != key:
                        if key is not None:
                            yield done()
                        key, ids, sets, labels = keys[k], [], [], []
                    ids.append(own[k])
                    labels.append(known[k])
                    sets.append(s)
        if key is not None:
            yield done()

    return run


def _labels(found: DataFrame) -> DataFrame:
    """node, least: a label for every node of the pivots' links (a: pivot, b). Nodes of one label are connected; not all that are
    connected get one label, which costs a count but no link."""
    of_member = found.groupBy("b").agg(F.min("a").alias("m"))
    of_pivot = found.join(of_member, "b").groupBy("a").agg(F.least(F.min("m"), F.col("a")).alias("m"))
    spread = of_pivot.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    again = found.withColumn("place", F.pmod(F.xxhash64("b"), F.lit(SALT))).join(spread, ["a", "place"]).select(F.col("b").alias("node"), "m")
    return again.unionByName(of_pivot.select(F.col("a").alias("node"), "m")).groupBy("node").agg(F.min("m").alias("least"))


def _inside(homes: DataFrame, links: DataFrame, verified) -> DataFrame:
    """More links, so that all similar pairs within a home (id, n, home) are connected."""
    found = links.where("false")
    labels = homes.select("id", F.col("id").alias("label"))
    for turn in range(ROUNDS + 1):
        labelled = homes.join(labels.distinct(), "id")
        sums = labelled.groupBy("home", "label").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("m"))
        sums = sums.groupBy("home").agg(F.sum("w").alias("w"), F.sum("m").alias("m"), F.max(F.struct("w", "label")).alias("largest"))
        # where all is connected, nothing is left to count
        sums = sums.select("home", "w", (F.col("w") - F.col("largest.w")).alias("outside"), F.col("largest.label").alias("largest")).where("outside > 0")
        state = staged(labelled.join(sums, "home").withColumn("out", F.col("label") != F.col("largest")), "labelled")
        wide = state.where(F.col("outside") > BLOCK)
        parts = F.ceil(F.col("w") / BLOCK)
        if turn == ROUNDS or wide.isEmpty():
            break
        lot = F.xxhash64("id", F.lit(turn))
        chosen = wide.where("out").groupBy("home", F.pmod(lot, F.lit(PIVOTS))).agg(F.min(F.struct(lot, "id")).alias("p"), F.max(parts).alias("parts"))
        chosen = chosen.groupBy("home").agg(F.sort_array(F.collect_set("p.id")).alias("pivots"), F.max("parts").alias("parts"))
        part = lambda c: F.concat_ws(":", F.lit("star"), F.array_join(F.col("pivots").cast("array<string>"), ","), c)
        all_of = wide.join(chosen, "home").where(~F.array_contains("pivots", F.col("id"))).select("id", part(F.pmod(F.xxhash64("id"), F.col("parts"))).alias("key"))
        pivots = chosen.select("pivots", F.explode("pivots").alias("id"), "parts").select("id", "pivots", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k")).select("id", part("k").alias("key"))
        found = found.unionByName(verified(all_of.unionByName(pivots).distinct().withColumn("label", F.col("id")), "pivots"))
        labels = homes.select("id").distinct().join(_labels(found), F.col("id") == F.col("node"), "left").select("id", F.coalesce("least", "id").alias("label"))
    # what is outside, in blocks, with the whole home, in blocks
    first = F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("outside") / BLOCK))
    second = F.pmod(F.xxhash64("id", F.lit(2)), parts)
    key = lambda i, j: F.concat_ws(":", F.lit("block"), "home", i, j).alias("key")
    asked = state.where("out").select("id", "label", "home", first.alias("i"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("j")).select("id", "label", key("i", "j"))
    against = state.select("id", "label", "home", F.explode(F.sequence(F.lit(0), F.ceil(F.col("outside") / BLOCK) - 1)).alias("i"), second.alias("j")).select("id", "label", key("i", "j"))
    return found.unionByName(verified(asked.unionByName(against).distinct(), "blocks"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, rate: Rate = (NUM, DEN)) -> DataFrame:
    """id, n_shingles, component_id for each row of docs; shingles of so many words, similarity as a fraction (numerator, denominator)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(rows, words))
    sketches = staged(rows.mapInArrow(_sketch(common, words, rate), _SKETCH), "sketches")
    named = sketches.where("n > 0 and id is not null")
    reps = staged(named.groupBy("n", "fp1", "fp2").agg(F.min("id").alias("rep")), "classes")
    # a few rows that don't stand for their class may pass: they are linked with the one that does
    classes = among(named, reps.select(F.col("rep").alias("id")))
    # a task holds its postings: 25 bytes for each 8 of a prefix
    n_bytes = sketches.agg(F.sum(F.octet_length("prefix").cast("long"))).first()[0]
    partitions, parts = (partitions_for(docs.sparkSession, n_bytes, each) for each in (PARTITION_BYTES, PART_BYTES))
    edges = staged(candidates(posted(rows, classes, common, partitions, parts, words, rate), partitions, parts, rate), "candidates")

    def verified(keyed: DataFrame, tag: str) -> DataFrame:
        asked = staged(keyed.select("id", "key", "label"), "asked")
        dealt = among(rows, asked).join(asked, "id").repartition(shuffle_partitions(docs.sparkSession), "key").sortWithinPartitions("key")
        return staged(dealt.select("key", "id", "label", "text").mapInArrow(_verify(words, rate), "a bigint, b bigint"), tag)

    # pairs by themselves: each smaller id with its partners
    pairs = staged(possible(edges.where("not dense").select("a", "b"), named, rate), "pairs")
    star = F.concat(F.lit("star:"), F.col("a").cast("string")).alias("key")
    stars = pairs.select(F.col("b").alias("id"), star).unionByName(pairs.select("a").distinct().select(F.col("a").alias("id"), star))
    links = verified(stars.withColumn("label", F.col("id")), "links")
    # dense columns: size bands of their components, each with the one below
    near = components(edges.where("dense"))
    sized = near.join(reps.select(F.col("rep").alias("id"), "n"), near.node == F.col("id")).select("id", "n", "comp")
    band = F.floor(F.ln(F.col("n")) / math.log(rate[1] / rate[0]) + F.lit(1e-9)).cast("long")
    homes = staged(sized.select("id", "n", F.explode(F.array(*[F.concat_ws(":", F.col("comp"), band + k) for k in (0, 1)])).alias("home")), "homes")
    links = links.unionByName(_inside(homes, links, verified))
    comps = components(links)
    labelled = reps.join(comps, reps.rep == comps.node, "left").select("n", "fp1", "fp2", F.coalesce("comp", "rep").alias("component_id"))
    linked = named.select("id", "n", "fp1", "fp2").join(labelled, ["n", "fp1", "fp2"]).select("id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = sketches.where("n = 0 or id is null").select("id", F.col("n").cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    return linked.unionByName(alone)


def op6(docs: DataFrame) -> DataFrame:
    return join(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, rate: Rate = (NUM, DEN)) -> DataFrame:
    """The rows of docs of which no other with a smaller id is reachable by links, with all their columns. Rows with a null id all stay."""
    groups = join(docs, id_col, text_col, words, rate).where("component_id = id").select("id")
    named = docs.join(groups, docs[id_col].cast("long") == groups.id, "left_semi")
    return named.unionByName(docs.where(F.col(id_col).cast("long").isNull()))


#: Word lists, distinct shingles, overlaps of all pairs that share one, and what links reach.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce(c.least, t.doc_id)) AS component_id FROM t LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
