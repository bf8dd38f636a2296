"""Substring deduplication over an enhanced suffix array.

Every byte is removed that a string of ``LENGTH`` bytes covers which also starts in a document with a smaller id.

A suffix array of the whole corpus does not fit one machine, so it is kept sparse and cut by content. Every window
of LENGTH bytes holds a minimiser: the least of its ``GRAM``-byte hashes. Equal windows have equal minimisers at equal
offsets, so only suffixes that begin at minimisers (1 position in 18) are sorted, and only those whose GRAM bytes
occur in several documents. They are dealt out by these bytes; each task sorts its suffixes, has the lengths of
common prefixes of neighbours (the LCP array) and the same for the bytes in front of each suffix, read backwards. A stack
scan of the LCP array gives the nodes of the common-prefix tree. A node of depth b whose occurrences share exactly a bytes
on the left (they are diverse in front of them) is a maximal repeat of a + b bytes, and all its occurrences but those in
its smallest document are covered, if that is LENGTH or more. Where they are diverse sooner, the node is split by the left
sides. ``repeat_groups`` gives the maximal repeats of a single text by the same scan.

Equal whole texts are settled by their digest before all this: only the smallest document of each goes on. What is
decided within a map batch (a gram that meets itself there, a surrounding that equals that of a smaller document)
is not dealt out again; of such a group one row leaves the batch.

Defined results: null and empty texts have no bytes; texts shorter than LENGTH lose nothing; rows with a null id take no
part; rows with one id are one document of several texts, which don't cover each other; repeated rows get equal
results; an empty table gives an empty result; columns beside the named ones are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import partitions_for
from bitloom.llm.packed import by_part, mix64, pieces, starts_to_ranges, text_bytes, tidy

LENGTH, GRAM = 50, 16
LEFT = LENGTH - GRAM  # bytes in front of a minimiser that a window can have
CONTEXT = LEFT + LENGTH
#: Texts of one id get places this far apart.
TEXT_SPAN = 1 << 40
_PIECE = 1 << 20
#: Bytes of text for a shuffle partition, and for a part of it: a partition is sorted by parts, and a task holds one of them at a
#: time. Its minimisers take a tenth more than that, the surroundings of repeats up to five times.
PARTITION_BYTES, PART_BYTES = 1 << 30, 16 << 20
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_ROW = np.random.default_rng(8).integers(1, 1 << 63, CONTEXT // 4, dtype=np.uint64) | np.uint64(1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


# suffix arrays of one text


def suffix_array(data: bytes) -> np.ndarray:
    """Suffix array by prefix doubling."""
    n = len(data)
    rank = np.frombuffer(data, np.uint8).astype(np.int64)
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:] if step < n else []
        order = np.lexsort((after, rank))
        new = np.empty(n, np.int64)
        if n:
            change = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
            new[order] = np.concatenate([[0], np.cumsum(change)])
        rank, step = new, step * 2
        if n == 0 or rank.max() == n - 1 or step >= 2 * n:
            return order


def lcp_array(data: bytes, sa: np.ndarray) -> np.ndarray:
    """lcp[i]: common prefix of the suffixes i - 1 and i in sorted order; lcp[0] = 0."""
    n = len(data)
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    lcp, h = np.zeros(n, np.int64), 0
    for i in range(n):
        if rank[i]:
            j = int(sa[rank[i] - 1])
            while i + h < n and j + h < n and data[i + h] == data[j + h]:
                h += 1
            lcp[rank[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return lcp


def repeat_groups(data: bytes, least: int = LENGTH, stops: frozenset[int] = frozenset()) -> list[tuple[int, list[int]]]:
    """(length, all starts) of the maximal repeats of at least so many bytes: intervals of the common-prefix tree, found by a
    stack scan, whose occurrences have different bytes in front (or stand at the beginning, or behind one of ``stops``,
    places over which no repeat reaches to the left)."""
    n = len(data)
    if not n:
        return []
    sa = suffix_array(data)
    lcp = np.append(lcp_array(data, sa), -1)
    # the byte in front where all occurrences below a node have the same one, else -1
    front = [-1 if i == 0 or i in stops else data[i - 1] for i in sa.tolist()]
    out, stack = [], [[0, 0, None]]  # [depth, left end, front byte of all below: None nothing yet, -1 diverse]
    join = lambda a, b: b if a is None else a if b is None else a if a == b else -1
    for i in range(1, n + 1):
        left, below = i - 1, front[i - 1]
        while stack and lcp[i] < stack[-1][0]:
            depth, left, f = stack.pop()
            f = below = join(f, below)
            if depth >= least and f == -1:
                out.append((int(depth), sorted(sa[left:i].tolist())))
        if not stack or lcp[i] > stack[-1][0]:
            stack.append([int(lcp[i]), left, below])
        else:
            stack[-1][2] = join(stack[-1][2], below)
    return out


# minimisers


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every place on; none where fewer follow."""
    h = _VALUE[data]
    for mult, gap in zip(_MULT, (1, 2, 4, 8), strict=True):
        h = h[:-gap] * mult + h[gap:]
    return mix64(h)


def minimisers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, and hashes, of the minimisers of all windows of LENGTH bytes of each text."""
    n, w = len(data), LEFT + 1
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.full(n + w, _NONE, np.uint64)
    h[: n - GRAM + 1] = grams(data)
    over = starts_to_ranges(np.maximum(offsets[1:] - GRAM + 1, offsets[:-1]), np.minimum(GRAM - 1, np.diff(offsets)))
    h[over] = _NONE
    m = h
    for gap in (1, 2, 4, 8, 16):
        m = np.minimum(m[:-gap], m[gap:])
    m = np.minimum(m[: -(w - 32)], m[w - 32 :])  # m[i]: least of the w hashes from i on
    m = np.concatenate([np.zeros(w - 1, np.uint64), m])
    for gap in (1, 2, 4, 8, 16):
        m = np.maximum(m[:-gap], m[gap:])
    m = np.maximum(m[: -(w - 32)], m[w - 32 :])  # the greatest least of all windows that hold a place
    at = np.flatnonzero((h[: len(m)] == m) & (h[: len(m)] != _NONE))
    return at, h[at]


def _planes(values: np.ndarray, width: int) -> bytes:
    """Byte planes, most significant first: zero planes cost nothing once compressed."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T).tobytes()


def _unplanes(buf, n: int, width: int, at: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    out[:, 8 - width :] = np.frombuffer(buf, np.uint8, n * width, at).reshape(width, n).T
    return out.view(">u8").ravel().astype(np.uint64), at + n * width


def _by_text(doc: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(document, text, places within the text) of sorted places."""
    text = place // TEXT_SPAN
    order = np.lexsort((place, doc))
    doc, text, place = doc[order], text[order], place[order]
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (text[1:] != text[:-1])) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(doc)], strict=True):
        if b > a:
            yield int(doc[a]), int(text[a]), order[a:b]


def _dealt(rows: np.ndarray, parts: int) -> pa.RecordBatch:
    """(part, blob): rows of numbers, the first of which is a document, dealt by document."""
    part = rows[:, 0] % parts
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([zlib.compress(rows[order[cut[p] : cut[p + 1]]].tobytes(), 1) for p in full.tolist()], pa.binary())], ["part", "blob"])


def _by_document(width: int):
    """Dealt rows (document, text, numbers ...) -> one row for each text: doc, text, blob of its numbers."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_part(batches):
            rows = np.concatenate([np.frombuffer(zlib.decompress(x.as_py()), np.int64).reshape(-1, width) for b in held for x in b.column(1)])
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            cut = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
            begin = np.concatenate([[0], cut])
            ends = [*cut.tolist(), len(rows)]
            body = np.ascontiguousarray(rows[:, 2:])
            for lo in range(0, len(begin), 5000):
                at = begin[lo : lo + 5000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[at, 0]), pa.array(rows[at, 1].astype(np.int32)), pa.array([body[x:y].tobytes() for x, y in zip(at.tolist(), ends[lo : lo + 5000], strict=True)], pa.binary())], ["doc", "text", "blob"]
                )

    return run


_OUT = "part int, doc bigint, text int, blob binary"


def _out(part, doc, text, blob) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(doc, pa.int64()), pa.array(text, pa.int32()), pa.array(blob, pa.binary())], ["part", "doc", "text", "blob"])


def _post(parts: int):
    """Minimisers by hash. Rows (part, null, null, blob) are to be matched; rows with a document are settled."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ords = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, offsets = text_bytes(b.column(2))
            docs, places, keys = [], [], []
            for i, j in pieces(offsets, _PIECE):
                off = offsets[i : j + 1] - offsets[i]
                at, h = minimisers(data[offsets[i] : offsets[j]], off)
                t = np.searchsorted(off, at, "right") - 1
                docs.append(ids[i + t])
                places.append(at - off[t] + ords[i + t].astype(np.int64) * TEXT_SPAN)
                keys.append(h)
            if not docs:
                continue
            doc, place, key = np.concatenate(docs), np.concatenate(places), np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            doc, place, key = doc[order], place[order], key[order]
            settled, lead, shared = _repeated(key, doc)
            out = [[], [], [], []]
            own, places_of = doc[settled], place[settled]
            for d, t, rows in _by_text(own, places_of):
                for c, x in zip(out, (d % parts, d, t, (places_of[rows] % TEXT_SPAN).astype(np.int64).tobytes()), strict=True):
                    c.append(x)
            doc, place, key, shared = doc[lead], place[lead], key[lead], shared[lead]
            part = (key % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cut)).tolist():
                o = order[cut[p] : cut[p + 1]]
                k = key[o] >> np.uint64(16)
                blob = np.int64(len(o)).tobytes() + _planes(np.diff(k, prepend=np.uint64(0)), 6) + _planes(doc[o].view(np.uint64), 8) + _planes(place[o].astype(np.uint64), 8) + shared[o].tobytes()
                for c, x in zip(out, (p, None, None, blob), strict=True):
                    c.append(x)
            yield _out(*out)

    return run


def _repeated(key: np.ndarray, doc: np.ndarray, shared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by key: which have a key of several documents (or one that was shared before), which rows still have to be
    matched elsewhere - for such a key the first alone -, and whether each row's key is shared."""
    n = len(key)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, bool)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.concatenate([begin, [n]]))
    several = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
    if shared is not None:
        several |= np.logical_or.reduceat(shared, begin)
    rows = np.repeat(several, count)
    lead = ~rows
    lead[begin] = True
    return rows, lead, rows


def _match(parts: int):
    """Places whose gram occurs in several documents, dealt by document: (document, text, place)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_part(batches):
            found = list(_matches(held))
            if found:
                yield _dealt(np.concatenate(found), parts)

    return run


def _settled(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """Rows (document, text, numbers ...) that are known before the exchange."""
    for d, t, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
        if d is not None:
            numbers = np.frombuffer(x.as_buffer(), np.int64).reshape(-1, width)
            yield np.concatenate([np.full((len(numbers), 1), d), np.full((len(numbers), 1), t), numbers], 1)


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    docs, places, keys, shareds = [], [], [], []
    for b in batches:
        parts, owners = b.column(0).to_pylist(), b.column(1).to_pylist()
        yield from _settled(b, 1)
        for i, blob in enumerate(b.column(3)):
            if owners[i] is not None:
                continue
            buf = blob.as_buffer()
            n = int(np.frombuffer(buf, np.int64, 1)[0])
            k, at = _unplanes(buf, n, 6, 8)
            d, at = _unplanes(buf, n, 8, at)
            p, at = _unplanes(buf, n, 8, at)
            keys.append(np.cumsum(k, dtype=np.uint64) * np.uint64(1 << 8) + np.uint64(parts[i] % 256))
            docs.append(d.view(np.int64))
            places.append(p.astype(np.int64))
            shareds.append(np.frombuffer(buf, np.bool_, n, at))
    if not keys:
        return
    key, doc, place, shared = (np.concatenate(x) for x in (keys, docs, places, shareds))
    order = np.argsort(key, kind="stable")
    key, doc, place, shared = key[order], doc[order], place[order], shared[order]
    # the first row of a batch stands for its whole group there, which is settled; it is met again here and told once more
    rows, _, _ = _repeated(key, doc, shared)
    doc, place = doc[rows], place[rows]
    yield np.stack([doc, place // TEXT_SPAN, place % TEXT_SPAN], 1)


# surroundings of minimisers


def _surround(parts: int):
    """Rows (id, text number, text, places) -> surroundings by gram, or spans where a smaller document of the batch settles it."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ords = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, offsets = text_bytes(b.column(2))
            lists = b.column(3)
            for lo, hi in pieces(offsets, 8 * _PIECE):
                flat = data[offsets[lo] : offsets[hi]]
                buf = np.concatenate([np.zeros(LEFT, np.uint8), flat, np.zeros(LENGTH, np.uint8)])
                at, own = [], []
                for i in range(lo, hi):
                    places = np.unique(np.frombuffer(lists[i].as_py(), np.int64))
                    at.append(places + (offsets[i] - offsets[lo]))
                    own.append(np.full(len(places), i))
                at, own = np.concatenate(at), np.concatenate(own)
                begin, end = offsets[own] - offsets[lo], offsets[own + 1] - offsets[lo]
                la, ra = np.minimum(LEFT, at - begin), np.minimum(LENGTH, end - at)
                ctx = buf[at[:, None] + np.arange(CONTEXT)]
                ctx[np.arange(CONTEXT) < LEFT - la[:, None]] = 0
                ctx[np.arange(CONTEXT) >= LEFT + ra[:, None]] = 0
                doc, place = ids[own], (at - begin) + ords[own].astype(np.int64) * TEXT_SPAN
                out = [[], [], [], []]
                gone, keep = _same(ctx, la, ra, doc)
                if gone.any():
                    _tell(out, doc[gone], place[gone], place[gone] - la[gone], place[gone] + ra[gone], la[gone] + ra[gone] >= LENGTH)
                ctx, la, ra, doc, place = ctx[keep], la[keep], ra[keep], doc[keep], place[keep]
                if len(ctx):
                    key = grams(ctx[:, LEFT : LEFT + GRAM].reshape(-1))[::GRAM]
                    part = (key % np.uint64(parts)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    cut = np.searchsorted(part[order], np.arange(parts + 1))
                    for p in np.flatnonzero(np.diff(cut)).tolist():
                        o = order[cut[p] : cut[p + 1]]
                        o = o[np.argsort(key[o], kind="stable")]
                        blob = np.int64(len(o)).tobytes() + zlib.compress(b"".join((ctx[o].tobytes(), doc[o].tobytes(), place[o].tobytes(), la[o].astype(np.uint8).tobytes(), ra[o].astype(np.uint8).tobytes())), 1)
                        for c, x in zip(out, (p, None, None, blob), strict=True):
                            c.append(x)
                yield _out(*out)

    return run


def _same(ctx: np.ndarray, la: np.ndarray, ra: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose whole surrounding equals that of a row of a smaller document, and the others."""
    h = mix64((ctx.view(np.uint32).astype(np.uint64) * _ROW).sum(1, dtype=np.uint64) + (la * 256 + ra).astype(np.uint64))
    order = np.lexsort((doc, h))
    new = np.ones(len(h), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (h[a] != h[b]) | (la[a] != la[b]) | (ra[a] != ra[b]) | (ctx[a] != ctx[b]).any(1)
    begin = np.flatnonzero(new)
    least = np.repeat(doc[order][begin], np.diff(np.concatenate([begin, [len(h)]])))
    gone = np.zeros(len(h), bool)
    gone[order] = doc[order] > least
    return gone, ~gone


def _tell(out: list[list], doc: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray, use: np.ndarray) -> None:
    """Add rows (document, text, spans) to out."""
    doc, place, start, end = doc[use], place[use], start[use], end[use]
    for d, t, o in _by_text(doc, place):
        for c, x in zip(out, (d % 1009, d, t, np.stack([start[o] % TEXT_SPAN, end[o] % TEXT_SPAN], 1).astype(np.int64).tobytes()), strict=True):
            c.append(x)


def interval_nodes(lcp: list[int], facts: list[list[int]], least: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the common-prefix tree of sorted suffixes that are at least so deep, by a stack scan of the LCP array: rows
    (first, end, depth, depth of the parent or least - 1), and for each the least of every list of facts over its suffixes."""
    n, width = len(lcp) - 1, len(facts)
    nodes: list[int] = []
    lows: list[int] = []
    stack: list[list] = []  # depth, first, the least facts below
    for i, own in enumerate(zip(*facts), 1):
        now, first, below = lcp[i] if i < n else -1, i - 1, own
        while stack and now < stack[-1][0]:
            depth, first, low = stack.pop()
            below = tuple(map(min, low, below))
            nodes += (first, i, depth, max(now, stack[-1][0] if stack else -1, least - 1))
            lows += below
        if stack and now == stack[-1][0]:
            stack[-1][2] = tuple(map(min, stack[-1][2], below))
        elif now >= least:
            stack.append([now, first, below])
    return np.array(nodes, np.int64).reshape(-1, 4), np.array(lows, np.int64).reshape(-1, width)


def _range_least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo:hi] for each pair, none of them empty."""
    table, step = [values], 1
    while 2 * step <= len(values):
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
        step *= 2
    level = np.floor(np.log2(np.maximum(hi - lo, 1))).astype(np.int64)
    out = np.empty(len(lo), values.dtype)
    for k in np.unique(level).tolist():
        rows = np.flatnonzero(level == k)
        out[rows] = np.minimum(table[k][lo[rows]], table[k][hi[rows] - (1 << k)])
    return out


def covered(ctx: np.ndarray, la: np.ndarray, ra: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each surrounding the least and greatest l whose window (l bytes before the minimiser, LENGTH - l from it on) also
    occurs around a minimiser of a smaller document; least > greatest where there is none.

    A node of the tree of right sides, of depth b, whose occurrences share a bytes on the left and differ in front of them
    is a maximal repeat of a + b bytes: with LENGTH or more of them it is told as one group with all its occurrences. Where
    the left sides differ sooner, the node's occurrences are split by their l bytes on the left, for every l that is left."""
    n = len(ctx)
    lo, hi = np.full(n, LENGTH, np.int64), np.full(n, -1, np.int64)

    def tree(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted order and LCP array of rows of bytes."""
        block = np.ascontiguousarray(block)
        order = np.argsort(block.view(f"S{block.shape[1]}").ravel(), kind="stable")
        lcp = np.zeros(n + 1, np.int64)
        for s in range(1, n, 1 << 16):
            a, b = block[order[s : s + (1 << 16)]], block[order[s - 1 : s - 1 + min(1 << 16, n - s)]]
            differ = a != b
            lcp[s : s + len(a)] = np.where(differ.any(1), differ.argmax(1), block.shape[1])
        return order, lcp

    right, right_lcp = tree(ctx[:, LEFT:])
    left, left_lcp = tree(ctx[:, :LEFT][:, ::-1])
    at_left = np.empty(n, np.int64)
    at_left[left] = np.arange(n)
    by_right = doc[right]
    ranks = np.unique(by_right, return_inverse=True)[1]
    facts = (ranks, -ranks, at_left[right], -at_left[right], la[right], ra[right])
    nodes, low = interval_nodes(right_lcp.tolist(), [x.tolist() for x in facts])
    several = low[:, 0] < -low[:, 1]
    nodes, low = nodes[several], low[several]
    if not len(nodes):
        return lo, hi
    first, end, depth, above = nodes.T
    shared = np.minimum(_range_least(left_lcp, low[:, 2] + 1, np.maximum(1 - low[:, 3], low[:, 2] + 2)), low[:, 4])
    reach = np.minimum(depth, low[:, 5])
    whole = np.flatnonzero(shared + reach >= LENGTH)
    spread = np.cumsum(end[whole] - first[whole])
    for part in np.split(whole, np.searchsorted(spread, np.arange(1 << 20, int(spread[-1]) if len(whole) else 0, 1 << 20))):
        size = end[part] - first[part]
        rows, node = starts_to_ranges(first[part], size), np.repeat(part, size)
        later = ranks[rows] > low[node, 0]
        rows, node = right[rows[later]], node[later]
        np.minimum.at(lo, rows, LENGTH - reach[node])
        np.maximum.at(hi, rows, shared[node])
    # windows of nodes that are no group as a whole: their l and the places of their suffixes
    ranges = ((LENGTH - depth, np.minimum(LENGTH - reach, LENGTH - above)), (np.maximum(shared + 1, LENGTH - depth), LENGTH - above))
    front = np.empty(n, np.int64)
    for l in range(LEFT + 1):
        open_ = np.zeros(n + 1, np.int64)
        for start, stop in ranges:
            here = np.flatnonzero((start <= l) & (l < stop))
            np.add.at(open_, first[here], 1)
            np.add.at(open_, end[here], -1)
        use = right[np.flatnonzero(np.cumsum(open_[:-1]) > 0)]
        use = use[(la[use] >= l) & (ra[use] >= LENGTH - l)]
        if len(use) < 2:
            continue
        front[left] = np.cumsum(left_lcp[:-1] < l) if l else 0
        interval = np.empty(n, np.int64)
        interval[right] = np.cumsum(right_lcp[:-1] < LENGTH - l)
        group = interval[use] * (n + 1) + front[use]
        order = np.argsort(group, kind="stable")
        use, group = use[order], group[order]
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least = np.repeat(np.minimum.reduceat(doc[use], begin), np.diff(np.concatenate([begin, [len(use)]])))
        hit = use[doc[use] > least]
        lo[hit] = np.minimum(lo[hit], l)
        hi[hit] = np.maximum(hi[hit], l)
    return lo, hi


def _sorted_task(parts: int):
    """Surroundings of a task -> spans of covered bytes, dealt by document: (document, text, start, end)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_part(batches):
            found = list(_covered_spans(held))
            if found:
                yield _dealt(np.concatenate(found), parts)

    return run


def _covered_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    found = [[] for _ in range(5)]
    for b in batches:
        owners = b.column(1).to_pylist()
        yield from _settled(b, 2)
        for i, blob in enumerate(b.column(3)):
            if owners[i] is not None:
                continue
            buf = blob.as_py()
            n = int(np.frombuffer(buf, np.int64, 1)[0])
            buf, at = zlib.decompress(buf[8:]), 0
            for f, kind, width in zip(found, (np.uint8, np.int64, np.int64, np.uint8, np.uint8), (CONTEXT, 1, 1, 1, 1), strict=True):
                x = np.frombuffer(buf, kind, n * width, at)
                f.append(x.reshape(n, width) if width > 1 else x)
                at += x.nbytes
    if not found[0]:
        return
    ctx, doc, place, la, ra = (np.concatenate(f) for f in found)
    lo, hi = covered(ctx, la.astype(np.int64), ra.astype(np.int64), doc)
    use = hi >= lo
    doc, place, lo, hi = doc[use], place[use], lo[use], hi[use]
    text, place = place // TEXT_SPAN, place % TEXT_SPAN
    yield np.stack([doc, text, place - hi, place - lo + LENGTH], 1)


def _merge(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of [start, end) rows."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    begin = np.flatnonzero(new)
    return np.stack([spans[begin, 0], reach[np.concatenate([begin[1:] - 1, [len(spans) - 1]])]], 1)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and removed (array of [start, end) byte runs, flattened) for each row of docs."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0]
    partitions, parts = (partitions_for(spark, n_bytes, each) for each in (PARTITION_BYTES, PART_BYTES))
    deal = lambda df: df.repartition(partitions, "part").sortWithinPartitions("part")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = rows.withColumn("tk", F.substring(F.unhex(F.sha2(F.col("body"), 256)), 1, 16))
    nameless = rows.where("id is null")
    # what every join below would ask for is asked for here, so that all of them share one exchange of the texts
    rows = rows.where("id is not null and tk is not null and body is not null")
    known = rows.where(F.octet_length("body") >= LENGTH).select("id", "tk")
    least = known.groupBy("tk").agg(F.min("id").alias("first"))
    named = known.groupBy("id", "tk").agg(F.count(F.lit(1)).alias("m")).join(least, "tk").select("id", "tk", (F.col("id") > F.col("first")).alias("copy"))
    firsts = named.where(~F.col("copy")).select("id", "tk", (F.row_number().over(Window.partitionBy("id").orderBy("tk")) - 1).cast("int").alias("text"))
    texts = rows.join(firsts, ["id", "tk"])
    posted = deal(texts.select("id", "text", "body").mapInArrow(_post(parts), _OUT))
    dealt, texts_of = "part int, blob binary", "doc bigint, text int, blob binary"
    places = deal(posted.mapInArrow(_match(parts), dealt)).mapInArrow(_by_document(3), texts_of)
    keyed = places.withColumnRenamed("doc", "id").join(firsts, ["id", "text"])
    around = deal(rows.join(keyed, ["id", "tk"]).select("id", "text", "body", "blob").mapInArrow(_surround(parts), _OUT))
    found = deal(around.mapInArrow(_sorted_task(parts), dealt)).mapInArrow(_by_document(4), texts_of)
    found = found.withColumnRenamed("doc", "id").join(firsts, ["id", "text"]).select("id", "tk", F.lit(False).alias("copy"), "blob")
    copies = named.where("copy").select("id", "tk", "copy", F.lit(None).cast("binary").alias("blob"))
    settled = found.unionByName(copies)
    out = rows.join(settled, ["id", "tk"], "left").select("id", "body", F.coalesce("copy", F.lit(False)).alias("copy"), "blob")
    return out.unionByName(nameless.select("id", "body", F.lit(False).alias("copy"), F.lit(None).cast("binary").alias("blob")))


@tidy
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        copies, lists = b.column(2).to_pylist(), b.column(3)
        data, offsets = text_bytes(b.column(1))
        out = [[], [], [], [], []]
        for i in range(b.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            if copies[i]:
                runs = np.array([[0, len(text)]], np.int64)
            elif lists[i].is_valid:
                runs = _merge(np.frombuffer(lists[i].as_py(), np.int64).reshape(-1, 2))
            else:
                runs = np.empty((0, 2), np.int64)
            left, last = hashlib.sha256(), 0
            kept = []
            for s, e in runs.tolist():
                kept.append(text[last:s])
                last = e
            kept.append(text[last:])
            rest = b"".join(x.tobytes() for x in kept)
            left.update(rest)
            for c, x in zip(out, (len(text), len(text) - len(rest), len(runs), left.hexdigest(), rest), strict=True):
                c.append(x)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())],
            ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) for each row of docs."""
    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return spans(docs, id_col, text_col).mapInArrow(_cut, schema)


def op1(docs: DataFrame) -> DataFrame:
    return deduplicate(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Every 50-byte string of each document (hex, taken from slices of 1,000 places), the least document that has it, runs of what it covers elsewhere.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, 1000 * b AS base, h[2000 * b + 1:2000 * b + 2098] AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2000 + 1)) AS b FROM d)),
w AS (SELECT doc_id, base + i AS p, part[2 * i + 1:2 * i + 100] AS g FROM c, range(0, 1000) t(i) WHERE length(part) >= 2 * i + 100),
f AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g),
hit AS (SELECT doc_id, p FROM w JOIN f USING (g) WHERE doc_id > least),
o AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
n AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM o),
s AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM n GROUP BY doc_id, k),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(h[2 * before + 1:2 * a], '' ORDER BY a) AS head FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head || h[2 * last + 1:], h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
