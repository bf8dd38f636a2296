"""Benchmark decontamination by edit distance.

The CGK embedding walks over a text with shared random bits: each step writes the current byte and moves on or
stays, as the bit for (step, byte) says. Windows start at every character of the documents and of the items, whatever
the script; LSH compares the first steps of a window's walk with those of the items' windows (a hit at offset o of an
item proposes the item-sized window that begins o bytes earlier). How many steps are compared follows from the item's
length and the similarity, see Recall. A proposed window goes on if the ``PART`` bytes of the item around the hit are
there with ``PART_EDITS`` of edits at most, and is verified exactly with a bit-parallel edit distance. Texts are folded
first: A-Z to lower case, every ASCII white-space byte to a space.

A document holds an item if some substring is within ``floor((1 - similarity) * len(item))`` edits, counted in
bytes of the folded UTF-8 texts.

Recall: a walk of K steps reads (K + 1) / 2 bytes on average, and a window is proposed where so many bytes are left
alone. ``DEPTHS`` has the K to choose from; an item takes the largest one for which as many edits as the limit allows,
at random places, leave such a run with probability ``RECALL`` or more. Items for which none does, and items under
``TINY`` bytes, are cut into one piece more than the edits allowed: one piece is always left alone, so they are found
exactly.

Defined results: null and empty texts and items match nothing; equal items match the same documents under their
own ids; repeated rows are each matched; empty tables give empty results; columns beside the named ones are not
read by ``leaks`` and are kept by ``remove``.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.packed import mix64, pieces, starts_to_ranges, text_bytes, tidy

SIMILARITY = 0.8
TINY = 16
#: Least recall at the similarity limit, for edits at random places.
RECALL = 0.95
#: Numbers of steps that are compared.
DEPTHS = (22, 18, 14, 10)
#: Bytes of the item around a hit that are compared before the whole, the share of edits there and the drift of the places.
PART, PART_EDITS, DRIFT = 64, 0.3, 10
#: Items go to the workers in blocks of so many bytes at most, each in a scan of its own; compiled they take about 70 times as much.
BLOCK_BYTES = 2_000_000
_CHUNK = 1 << 14
SCHEMA = "item_id bigint, start bigint, n_bytes bigint, distance int, similarity double"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[[9, 10, 11, 12, 13]] = 0x20


def fold(data: np.ndarray) -> np.ndarray:
    return _FOLD[data]


@functools.lru_cache(None)
def recall(m: int, d: int, span: int) -> float:
    """Probability that d edited bytes of m, at random places, leave a run of so many bytes."""
    none = sum((-1) ** k * math.comb(d + 1, k) * math.comb(m - k * span, d) for k in range(min(d + 1, (m - d) // span) + 1))
    return 1 - none / math.comb(m, d)


def depth(m: int, d: int) -> int | None:
    """Steps that are compared for an item of m bytes of which d may be edited; None: no walk has the recall."""
    if m > 500:  # a longer item has more runs: its recall is larger
        m, d = 500, -(-500 * d // m)
    return next((k for k in DEPTHS if m >= TINY and recall(m, d, k // 2 + 1) >= RECALL), None)


class Walk:
    """One CGK embedding."""

    def __init__(self, seed: int):
        self.move = np.random.default_rng(seed).integers(0, 2, (max(DEPTHS), 256), dtype=np.int64)

    def keys(self, buf: np.ndarray, at: np.ndarray, depths: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each depth the keys of the windows that begin at the given places, and where each walk ended.
        buf reaches over the last place by the number of steps."""
        out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if not len(at):
            return {n: (np.empty(0, np.uint64), at) for n in depths}
        text = buf[at[0] : at[-1] + max(depths) + 1].astype(np.int64)  # as wide as an index, so nothing is converted below
        ptr = at - at[0]
        h = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
        for j in range(max(depths)):
            c = text.take(ptr, mode="clip")
            h ^= c.view(np.uint64)
            h *= np.uint64(0x100000001B3)
            if j + 1 in depths:
                out[j + 1] = mix64(h), ptr + (at[0] + 1)
            ptr += self.move[j].take(c, mode="clip")
        return out


def char_starts(data: np.ndarray) -> np.ndarray:
    return np.flatnonzero((data & 0xC0) != 0x80)


def best_match(pattern: bytes, text: bytes, masks: dict[int, int] | None = None) -> tuple[int, int]:
    """(distance, end) of the substring of text that is nearest to pattern; the first of equals."""
    m = len(pattern)
    if masks is None:
        masks = pattern_masks(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best, end


def pattern_masks(pattern: bytes) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Items:
    """The compiled benchmark."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float):
        self.ids = [i for i, _ in rows]
        self.texts = [fold(np.frombuffer(t.strip().encode(), np.uint8)).tobytes() for _, t in rows]
        self.limit = [int((1 - similarity) * len(t) + 1e-9) for t in self.texts]
        self.masks = [pattern_masks(t) for t in self.texts]
        depths = [depth(len(t), d) for t, d in zip(self.texts, self.limit, strict=True)]
        self.short = [k for k, t in enumerate(self.texts) if t and depths[k] is None]
        self.walk = Walk(0)
        self.tables = {}
        for n in sorted({x for x in depths if x is not None}):
            here = [k for k, x in enumerate(depths) if x == n]
            table = []
            for k in here:
                data = np.frombuffer(self.texts[k], np.uint8)
                starts = char_starts(data)
                key, end = self.walk.keys(np.concatenate([data, np.zeros(n + 1, np.uint8)]), starts, [n])[n]
                table.append((key[end <= len(data)], np.full((end <= len(data)).sum(), k), starts[end <= len(data)]))
            self.tables[n] = self._sorted(*(np.concatenate(x) for x in zip(*table, strict=True)))
        self._parts()

    def _parts(self) -> None:
        """Bit masks of the parts of every item, PART // 2 apart: a hit at offset o takes the part that has it nearest its middle."""
        self.first_part = np.concatenate([[0], np.cumsum([max(1, -(-(len(t) - PART) // (PART // 2)) + 1) for t in self.texts])]).astype(np.int64)
        n = int(self.first_part[-1])
        self.part_at, self.part_size, self.part_limit = np.zeros(n, np.int64), np.ones(n, np.int64), np.zeros(n, np.int64)
        self.part_mask = np.zeros((n, 256), np.uint64)
        for k, t in enumerate(self.texts):
            for p in range(int(self.first_part[k]), int(self.first_part[k + 1])):
                at = max(0, min((p - int(self.first_part[k])) * (PART // 2), len(t) - PART))
                part = np.frombuffer(t[at : at + PART], np.uint8)
                self.part_at[p], self.part_size[p] = at, max(1, len(part))
                self.part_limit[p] = min(self.limit[k], int(PART_EDITS * len(part)) if len(t) > PART else self.limit[k])
                np.bitwise_or.at(self.part_mask[p], part, np.uint64(1) << np.arange(len(part), dtype=np.uint64))

    @staticmethod
    def _sorted(keys, items, offsets):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        maybe = np.zeros(1 << 22, bool)
        maybe[(keys >> np.uint64(42)).astype(np.int64)] = True
        return keys, items[order], offsets[order], maybe

    def _near(self, buf: np.ndarray, at: np.ndarray, item: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Whether the part of the item around each hit is there with its limit of edits. buf begins PART + DRIFT bytes before the texts."""
        nth = np.clip((offset - PART // 4) // (PART // 2), 0, self.first_part[item + 1] - self.first_part[item] - 1)
        part = self.first_part[item] + nth
        ok = np.empty(len(at), bool)
        for lo in range(0, len(at), 1 << 13):
            p = part[lo : lo + (1 << 13)]
            ptr = at[lo : lo + (1 << 13)] - offset[lo : lo + (1 << 13)] + self.part_at[p] + PART
            top = self.part_size[p].astype(np.uint64) - np.uint64(1)
            base = p * 256
            flat = self.part_mask.reshape(-1)
            pv, mv = np.full(len(p), 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(len(p), np.uint64)
            score = self.part_size[p].astype(np.uint64)
            best = score.copy()
            bits, new = np.empty_like(pv), np.empty_like(pv)
            one = np.uint64(1)
            for j in range(int(self.part_size[p].max(initial=0)) + 2 * DRIFT):
                eq = flat.take(base + buf.take(ptr, mode="clip"))
                ptr += 1
                np.bitwise_and(eq, pv, out=bits)
                bits += pv
                bits ^= pv
                bits |= eq  # xh
                eq |= mv  # xv
                np.bitwise_or(bits, pv, out=new)
                np.invert(new, out=new)
                new |= mv  # ph
                pv &= bits  # mh
                np.right_shift(new, top, out=bits)
                bits &= one
                score += bits
                np.right_shift(pv, top, out=bits)
                bits &= one
                score -= bits
                np.minimum(best, score, out=best)
                new <<= one
                pv <<= one
                np.bitwise_and(new, eq, out=mv)
                eq |= new
                np.invert(eq, out=eq)
                pv |= eq
            ok[lo : lo + (1 << 13)] = best <= self.part_limit[p].astype(np.uint64)
        return ok

    def propose(self, data: np.ndarray) -> np.ndarray:
        """(window start, item, place of the hit), windows given by the place where the item would begin."""
        found = [np.empty((0, 3), np.int64)]
        if not self.tables:
            return found[0]
        starts = char_starts(data)
        buf = np.concatenate([data, np.zeros(max(self.tables) + 1, np.uint8)])
        wide = np.concatenate([np.zeros(PART + DRIFT, np.uint8), data, np.zeros(2 * (PART + DRIFT), np.uint8)])
        pending, waiting = [], 0

        def judge() -> None:
            p, k, o = (np.concatenate(x) for x in zip(*pending, strict=True))
            # hits of one window and part count once
            _, once = np.unique((k * (len(data) + (1 << 32)) + (p - o + (1 << 31))) * 64 + np.minimum(o // (PART // 2), 63), return_index=True)
            p, k, o = p[once], k[once], o[once]
            near = self._near(wide, p, k, o)
            found.append(np.stack([p - o, k, p], 1)[near])
            pending.clear()

        for lo in range(0, len(starts), _CHUNK):
            at = starts[lo : lo + _CHUNK]
            for steps, (key, _) in self.walk.keys(buf, at, list(self.tables)).items():
                sorted_keys, items, offsets, maybe = self.tables[steps]
                hit = np.flatnonzero(maybe.take((key >> np.uint64(42)).astype(np.int64)))
                a, b = np.searchsorted(sorted_keys, key[hit], "left"), np.searchsorted(sorted_keys, key[hit], "right")
                total = np.cumsum(b - a)
                i = 0
                while i < len(hit):  # about a million pairs at a time
                    j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + (1 << 20), "right")))
                    n = b[i:j] - a[i:j]
                    which = starts_to_ranges(a[i:j], n)
                    pending.append((np.repeat(at[hit[i:j]], n), items[which], offsets[which]))
                    waiting += len(which)
                    i = j
                    if waiting > 1 << 20:
                        judge()
                        waiting = 0
        if pending:
            judge()
        return np.concatenate(found)

    def find_short(self, text: bytes, item: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best window of an item, by the pieces of which one is left alone."""
        t, d = self.texts[item], self.limit[item]
        starts = []
        for n in range(d + 1):
            lo, hi = len(t) * n // (d + 1), len(t) * (n + 1) // (d + 1)
            at = text.find(t[lo:hi])
            while at >= 0:
                starts.append(at - lo)
                at = text.find(t[lo:hi], at + 1)
        return self.verify(text, item, np.array(starts)) if starts else None

    def verify(self, text: bytes, item: int, starts: np.ndarray) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best verified window of one item in one text; starts: where windows are proposed."""
        m, d = len(self.texts[item]), self.limit[item]
        best, done = None, -1
        for s in np.unique(starts):
            lo, hi = max(0, int(s) - d), min(len(text), int(s) + m + d)
            if hi <= done or best and best[0] == 0:
                continue
            if lo < done and s + m <= done:
                continue
            dist, end = best_match(self.texts[item], text[lo:hi], self.masks[item])
            done = hi
            if dist <= d and (best is None or dist < best[0]):
                back, length = best_match(self.texts[item][::-1], text[max(0, lo + end - m - d) : lo + end][::-1])
                best = (dist, lo + end - length, lo + end)
        return best

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text number, item, start, end, distance) for the texts of a piece: the best window of each pair."""
        d = fold(data)
        out = []
        hits = self.propose(d)
        if len(hits):
            doc = np.searchsorted(offsets, hits[:, 2], "right") - 1
            order = np.lexsort((hits[:, 0], hits[:, 1], doc))
            doc, hits = doc[order], hits[order]
            cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(hits[:, 1]) != 0)) + 1
            for a, b in zip([0, *cut], [*cut, len(hits)], strict=True):
                i, k = int(doc[a]), int(hits[a, 1])
                text = d[offsets[i] : offsets[i + 1]].tobytes()
                if (m := self.verify(text, k, hits[a:b, 0] - offsets[i])) is not None:
                    out.append((i, k, m[1], m[2], m[0]))
        for i in range(len(offsets) - 1) if self.short else ():
            text = d[offsets[i] : offsets[i + 1]].tobytes()
            out += [(i, k, m[1], m[2], m[0]) for k in self.short if (m := self.find_short(text, k)) is not None]
        return out


class Block:
    """A block of the benchmark; a worker compiles it once and keeps it as long as the broadcast."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float):
        self.rows, self.similarity = rows, similarity

    @functools.cached_property
    def items(self) -> Items:
        return Items(self.rows, self.similarity)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, similarity: float) -> Iterator[Broadcast]:
    """The query set in broadcast blocks of bounded size; it is read as a stream, and the driver's Python holds one block."""
    rows, size, context = [], 0, benchmark.sparkSession.sparkContext
    for r in benchmark.where(F.trim(F.coalesce(text_col, F.lit(""))) != "").select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        if size > BLOCK_BYTES:
            yield context.broadcast(Block(rows, similarity))
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += len(r[1].encode())
    if rows:
        yield context.broadcast(Block(rows, similarity))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc id, item_id, start and n_bytes of the best window, its distance and similarity: one row for each document and item that it holds."""
    rows = docs.select(id_col, F.col(text_col).alias("__text"))
    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, {SCHEMA}"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark, item_id, item_text, similarity):

        @tidy
        def find(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = block.value.items
            for b in batches:
                data, offsets = text_bytes(b.column(1))
                for i, j in pieces(offsets):
                    got = [(i + n, *x) for n, *x in items.search(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
                    ids = b.column(0).take(pa.array([x[0] for x in got], pa.int64()))
                    yield pa.RecordBatch.from_arrays([
                        ids, pa.array([items.ids[x[1]] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64()), pa.array([x[3] - x[2] for x in got], pa.int64()),
                        pa.array([x[4] for x in got], pa.int32()), pa.array([1 - x[4] / len(items.texts[x[1]]) for x in got], pa.float64()),
                    ], [id_col, "item_id", "start", "n_bytes", "distance", "similarity"])

        out = out.unionByName(rows.mapInArrow(find, schema))
    return out


def remove(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with all their columns. Only the text goes through Python."""
    for block in _blocks(benchmark, item_id, item_text, similarity):

        def clean(columns: Iterator[pa.Array], block=block) -> Iterator[pa.Array]:
            items = block.value.items
            for column in columns:
                keep = np.ones(len(column), bool)
                data, offsets = text_bytes(column)
                for i, j in pieces(offsets):
                    for n, *_ in items.search(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                        keep[i + n] = False
                yield pa.array(keep)

        docs = docs.where(F.arrow_udf(tidy(clean), "boolean", F.ArrowUDFType.SCALAR_ITER)(F.col(text_col)))
    return docs


def op8(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)
