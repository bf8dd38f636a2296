"""SentencePiece encoding and decoding as a weighted transducer.

The model file is compiled into three machines, all of them integer tables:

* the normaliser: an arc for the space in front, space to meta sign, all else to itself;
* the piece acceptor: a trie of all pieces, whose arcs are looked up by (state, character class), with the weight of
  an arc given by the piece and the piece before it;
* byte fallback: a character that is no piece becomes its UTF-8 bytes (or the unknown piece, if the model has none).

A batch of texts is composed with them at once. Between two characters that stand side by side in no piece every path
has a state, so there the lattice is cut into segments; equal segments are solved once a batch, and each one's path is
the shortest in the tropical semiring (min, +), taken level by level over the positions.

A unigram piece weighs minus its score. For a BPE model the weight is 0 where the merge order leaves the two adjacent
pieces apart, and infinite otherwise: a sequence of pieces is the model's own encoding exactly if all of its adjacent
pairs are, and every prefix has exactly one such sequence, so the shortest path (weight 0) is the library's result.

Defined results: null and empty texts have no tokens and decode to the empty text; meta signs in a text count as
spaces, as in the library; texts are taken whole, however long; repeated rows get equal results; an empty table gives
an empty result; columns beside the named ones are not read. Unknown characters side by side are one unknown piece in
models without byte pieces, as in the library; such texts don't decode to themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.packed import tidy

META = "▁"
#: Characters that are composed at once; a longer text is cut before a word.
BATCH = 1 << 19
#: Characters of solved segments that a worker remembers over its batches (about 12 bytes each).
REMEMBERED = 2_000_000
#: Segments of more characters than this are solved one by one, not side by side; the path is the same.
LONG = 64
INF = float("inf")
#: Key of one more than any code point, for symbols that are pieces or characters.
_CODES = 0x110000
SCHEMA = "ids array<int>, n_tokens bigint, n_byte_tokens bigint, decoded string, round_trip boolean"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            c = data[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[i : i + n]
        i += n


class Arcs:
    """Values (under 2^20) by non-negative integer keys (under 2^43), looked up many at a time."""

    def __init__(self, found: dict[int, int]):
        keys, values = np.array([*found], np.int64), np.array([*found.values()], np.int64)
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while left.size:
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = keys[free] << 20 | values[free]
            left = left[self.slots[at[left]] >> 20 != keys[left]]
            at[left] = at[left] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        at = self._slot(keys)
        met = self.slots[at]
        hit = met >> 20 == keys
        out = np.where(hit, met & 0xFFFFF, default)
        left = np.flatnonzero(~hit & (met >= 0))
        at, keys = at[left], keys[left]
        while left.size:
            at = at + 1 & self.mask
            met = self.slots[at]
            hit = met >> 20 == keys
            out[left[hit]] = met[hit] & 0xFFFFF
            on = ~hit & (met >= 0)
            left, at, keys = left[on], at[on], keys[on]
        return out


class Solved:
    """Segments solved before, by hash and content: at most so many characters, the ones met most often."""

    def __init__(self, most: int):
        self.most = most
        self.key = np.empty(0, np.uint64)
        self.start, self.n, self.at, self.count, self.met = (np.empty(0, np.int64) for _ in range(5))
        self.codes, self.symbols = np.empty(0, np.uint32), np.empty(0, np.int64)

    def find(self, key: np.ndarray, codes: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each segment is known, and the number of those that are."""
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        known = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
        known[known] = self.n[at[known]] == n[known]
        at = at[known]
        if at.size:
            same = np.logical_and.reduceat(codes[_spread(start[known], n[known])] == self.codes[_spread(self.start[at], n[known])], np.cumsum(n[known]) - n[known])
            known[known], at = same, at[same]
            self.met[at] += 1
        return known, at

    def add(self, key: np.ndarray, codes: np.ndarray, n: np.ndarray, symbols: np.ndarray, count: np.ndarray) -> None:
        self.key = np.append(self.key, key)
        self.start = np.append(self.start, len(self.codes) + np.cumsum(n) - n)
        self.at = np.append(self.at, len(self.symbols) + np.cumsum(count) - count)
        self.n, self.count, self.met = np.append(self.n, n), np.append(self.count, count), np.append(self.met, np.ones_like(n))
        self.codes, self.symbols = np.append(self.codes, codes), np.append(self.symbols, symbols)
        full = len(self.codes) > self.most
        order = np.argsort(-self.met, kind="stable") if full else np.arange(len(self.key))
        order = order[: np.searchsorted(np.cumsum(self.n[order]), self.most // 2)] if full else order
        order = order[np.argsort(self.key[order], kind="stable")]
        self.key, self.start, self.n, self.at, self.count, self.met = (x[order] for x in (self.key, self.start, self.n, self.at, self.count, self.met))
        if full:
            self.codes, self.symbols = self.codes[_spread(self.start, self.n)], self.symbols[_spread(self.at, self.count)]
            self.start, self.at, self.met = np.cumsum(self.n) - self.n, np.cumsum(self.count) - self.count, self.met + 1 >> 1


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] places, then the same of start[1] and so on."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


class Transducer:
    """A compiled model."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        score, kinds = [], []
        self.prefix, self.unigram, self.unknown = True, False, 0
        surface = " ⁇ "
        for field, value in _fields(model):
            if field == 1:
                part = dict(_fields(value))
                self.pieces.append(part.get(1, b"").decode())
                kinds.append(part.get(3, 1))
                score.append(float(np.frombuffer(part.get(2, b"\0\0\0\0"), "<f4")[0]))
            elif field == 2:
                part = dict(_fields(value))
                self.unigram = part.get(3, 1) == 1
                surface = part[44].decode() if 44 in part else surface
                if part.get(3, 1) > 2:
                    raise ValueError("only unigram and BPE models are compiled")
            elif field == 3:
                norm = dict(_fields(value))
                if norm.get(1, b"identity") != b"identity" or norm.get(2):
                    raise ValueError("only the identity normaliser is compiled")
                if norm.get(4, 1) or not norm.get(5, 1):
                    raise ValueError("only models that keep white space and escape it are compiled")
                self.prefix = bool(norm.get(3, 1))
        if 4 in kinds:
            raise ValueError("models with user-defined pieces are not compiled")
        self.size = len(self.pieces)
        self.id = {p: k for k, p in enumerate(self.pieces) if kinds[k] == 1}
        self.unknown = kinds.index(2) if 2 in kinds else 0
        byte = {int(p[1:-1], 16): k for k, p in enumerate(self.pieces) if kinds[k] == 6}
        self.byte_id = np.array([byte[v] for v in range(256)], np.int64) if byte else None
        self.is_byte = np.zeros(self.size, bool)
        self.is_byte[list(byte.values())] = True
        text = [p.replace(META, " ").encode() for p in self.pieces]
        for v, k in byte.items():
            text[k] = bytes([v])
        text[self.unknown] = surface.encode()
        self.out_size = np.array([len(t) for t in text], np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.out = np.frombuffer(b"".join(text), np.uint8)
        self._compile_order(score)
        self._compile_trie()
        self.solved = Solved(REMEMBERED)
        if self.prefix and META not in self.id:
            raise ValueError("the meta sign is no piece")

    def symbol(self, c: str) -> int:
        """Number of a character: its piece, or one beyond all pieces."""
        return self.id.get(c, self.size + ord(c))

    def _compile_order(self, score: list[float]) -> None:
        """Ranks of the pieces, which two symbols a piece is made of last, and which adjacent symbols can be joined."""
        order = {s: k for k, s in enumerate(sorted(set(score), reverse=True))}
        self.cost = -np.array(score, np.float32)
        self.least = float(min((score[k] for k in self.id.values()), default=0.0)) - 10.0
        self.rank = np.full(self.size, -1, np.int32)
        self.parts = np.full((2, self.size), -1, np.int64)
        joined: dict[int, int] = {}
        if not self.unigram:
            for p, k in self.id.items():
                if len(p) > 1:
                    self.rank[k] = order[score[k]]
            reached = {}
            for p, k in self.id.items():
                made = self.merged(p)
                if len(made) == 1:
                    reached[p] = k
                    if len(p) > 1:
                        self.parts[:, k] = made[0][1:]
                        if max(self._rank(x) for x in made[0][1:]) > self.rank[k]:
                            raise ValueError("only BPE models whose pieces rank behind their parts are compiled")
                for w in range(1, len(p)):
                    a, b = p[:w], p[w:]
                    if (w == 1 or a in self.id) and (w == len(p) - 1 or b in self.id):
                        joined[self._key(self._of(a), self._of(b))] = int(self.rank[k])
            self.id = reached
        self.joined = Arcs(joined)

    def _of(self, s: str) -> int:
        return self.symbol(s) if len(s) == 1 else self.id[s]

    def _rank(self, symbol: int) -> int:
        return int(self.rank[symbol]) if symbol < self.size else -1

    def _key(self, a, b):
        return a * (self.size + _CODES) + b

    def _compile_trie(self) -> None:
        """Character classes, the class pairs that some piece holds, and the arcs of the piece acceptor."""
        longer = [p for p in self.id if len(p) > 1]
        self.longest = max(map(len, longer), default=1)
        chars = sorted({c for p in longer for c in p})
        number = {c: k + 1 for k, c in enumerate(chars)}
        self.char_class = np.zeros(_CODES, np.uint16)
        self.char_class[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.char_symbol = np.arange(self.size, self.size + _CODES, dtype=np.int64)
        for p, k in self.id.items():
            if len(p) == 1:
                self.char_symbol[ord(p)] = k
        self.touch = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        state: dict[str, int] = {}
        arcs: dict[int, int] = {}
        self.classes = len(chars) + 1
        for p in longer:
            for w in range(1, len(p) + 1):
                if p[:w] not in state:
                    state[p[:w]] = len(state)
                    if w > 1:
                        arcs[state[p[: w - 1]] * self.classes + number[p[w - 1]]] = state[p[:w]]
                        self.touch[number[p[w - 2]], number[p[w - 1]]] = True
        self.first = np.full(self.classes, -1, np.int64)
        for c, k in number.items():
            self.first[k] = state.get(c, -1)
        self.accepts = np.full(len(state) + 1, -1, np.int64)
        for p in longer:
            self.accepts[state[p]] = self.id[p]
        self.arcs = Arcs(arcs)

    def merged(self, chars: str) -> list[tuple[int, int, int]]:
        """What the merge order makes of a short string: the best-ranked adjacent pair first, leftmost of equals.
        Each symbol with the two that it is made of."""
        s = [(c, (self.symbol(c), -1, -1)) for c in chars]
        while len(s) > 1:
            ranks = [int(self.rank[k]) if (k := self.id.get(a[0] + b[0])) is not None else _CODES for a, b in zip(s, s[1:])]
            at = ranks.index(min(ranks))
            if ranks[at] == _CODES:
                break
            text = s[at][0] + s[at + 1][0]
            s[at : at + 2] = [(text, (self.id[text], s[at][1][0], s[at + 1][1][0]))]
        return [made for _, made in s]

    # arc weights

    def weights(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Weights of arcs by their piece and the one before it (-1 at a segment's start)."""
        if self.unigram:
            return np.where(piece < self.size, self.cost[np.minimum(piece, self.size - 1)], np.float32(-self.least))
        out = np.zeros(len(piece), np.float32)
        live = np.flatnonzero(before >= 0)
        left, right, limit = before[live], piece[live], np.full(live.size, _CODES, np.int32)
        last = self.size - 1
        while live.size:  # undo the latest merge of either side: a join over the border that ranks before it would have come first
            apart = self.joined.get(self._key(left, right), _CODES) >= limit
            out[live[~apart]] = INF
            a = np.where(left < self.size, self.rank[np.minimum(left, last)], -1)
            b = np.where(right < self.size, self.rank[np.minimum(right, last)], -1)
            on = apart & (np.maximum(a, b) >= 0)
            live, left, right, a, b = live[on], left[on], right[on], a[on], b[on]
            undo = a > b
            limit = np.where(undo, a, b + 1)
            left = np.where(undo, self.parts[1, np.minimum(left, last)], left)
            right = np.where(undo, right, self.parts[0, np.minimum(right, last)])
        return out

    # shortest paths

    def shortest(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols on the shortest paths over segments that lie one behind the other, and how many each has."""
        n, segs = len(codes), len(size)
        seg = np.repeat(np.arange(segs), size)
        node_of = np.arange(n) + seg  # states: the places between characters, one more than characters in each segment
        classes = self.char_class[codes]
        rest = np.repeat(start + size, size) - np.arange(n)
        begin, end, piece = [np.arange(n)], [np.arange(n) + 1], [self.char_symbol[codes]]
        at = np.flatnonzero((rest > 1) & (self.first[classes] >= 0))
        state, w = self.first[classes[at]], 1
        while at.size:
            state = self.arcs.get(state * self.classes + classes[at + w], -1).astype(np.int64)
            w += 1
            known = state >= 0
            at, state = at[known], state[known]
            done = self.accepts[state] >= 0
            begin.append(at[done])
            end.append(at[done] + w)
            piece.append(self.accepts[state[done]])
            more = rest[at] > w
            at, state = at[more], state[more]
        begin, end, piece = map(np.concatenate, (begin, end, piece))
        level = (end - start[seg[begin]]).astype(np.uint16)
        order = np.argsort(begin, kind="stable")
        order = order[np.argsort(end[order], kind="stable")]
        order = order[np.argsort(level[order], kind="stable")]
        begin, end, piece, level = begin[order], end[order], piece[order], level[order]
        source = node_of[begin]
        target = source + end - begin
        dist, last, back = np.full(n + segs, INF, np.float32), np.full(n + segs, -1, np.int64), np.full(n + segs, -1, np.int64)
        first = start + np.arange(segs)
        dist[first] = 0
        bounds = np.searchsorted(level, np.arange(1, int(size.max(initial=0)) + 2))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if lo == hi:
                continue
            src, to = source[lo:hi], target[lo:hi]
            w = dist[src] + self.weights(last[src], piece[lo:hi])
            head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            least = np.minimum.reduceat(w, head)
            hits = np.flatnonzero(w == np.repeat(least, np.diff(np.append(head, hi - lo))))
            best = hits[np.searchsorted(hits, head)]
            node = to[best]
            dist[node], last[node], back[node] = w[best], piece[lo:hi][best], src[best]
        used = np.zeros(n + segs, bool)
        node = first + size
        if not np.isfinite(dist[node]).all():
            raise ValueError("a segment has no path")
        while node.size:
            used[node] = True
            node = back[node]
            node = node[back[node] >= 0]
        return last[used], np.bincount(np.repeat(np.arange(segs), size + 1)[used], minlength=segs)

    def shortest_long(self, text: str) -> list[int]:
        """The same for one segment of any length, place by place; longer pieces stand first among equals."""
        dist, last, back, known = [0.0], [-1], [-1], {}
        for j in range(1, len(text) + 1):
            best = (INF, -1, -1)
            for i in range(max(0, j - self.longest), j):
                piece = self.symbol(text[i]) if i == j - 1 else self.id.get(text[i:j])
                if piece is None or dist[i] == INF:
                    continue
                pair = (last[i], piece)
                if pair not in known:
                    known[pair] = float(self.weights(np.array([pair[0]]), np.array([piece]))[0])
                w = float(np.float32(dist[i] + known[pair]))
                if w < best[0]:
                    best = (w, piece, i)
            dist.append(best[0])
            last.append(best[1])
            back.append(best[2])
        out, j = [], len(text)
        while j:
            out.append(last[j])
            j = back[j]
        return out[::-1]

    # composition with texts

    def _distinct(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """One segment of each content, for every segment the place of its like in that list, and their hashes if no two are equal."""
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(size.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64))
            mixed = (codes[_spread(start, size)].astype(np.uint64) + np.uint64(1)) * power[_spread(np.zeros_like(size), size)]
            key = np.add.reduceat(mixed, np.cumsum(size) - size) if size.size else mixed
            key ^= key >> np.uint64(29)
        known, pick, like = np.unique(key, return_index=True, return_inverse=True)
        same = size == size[pick[like]]
        if same.all():
            same = codes[_spread(start, size)] == codes[_spread(start[pick[like]], size)]
        if not same.all():  # two contents of one hash
            _, pick, like = np.unique(np.array([codes[s : s + n].tobytes() for s, n in zip(start, size)], object), return_index=True, return_inverse=True)
            known = None
        return pick, like, known

    def _solve(self, codes: np.ndarray, start: np.ndarray, n: np.ndarray, key: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of distinct segments, and how many each has; those of earlier batches are not solved again."""
        if key is None:
            return self.shortest(codes[_spread(start, n)], np.cumsum(n) - n, n)
        known, at = self.solved.find(key, codes, start, n)
        old, old_count = self.solved.symbols[_spread(self.solved.at[at], self.solved.count[at])], self.solved.count[at]
        m = n[~known]
        text = codes[_spread(start[~known], m)]
        new, new_count = self.shortest(text, np.cumsum(m) - m, m)
        self.solved.add(key[~known], text, m, new, new_count)
        counts = np.empty(len(n), np.int64)
        counts[known], counts[~known] = old_count, new_count
        pool, place = np.empty(len(old) + len(new), np.int64), np.cumsum(counts) - counts
        pool[_spread(place[known], old_count)], pool[_spread(place[~known], new_count)] = old, new
        return pool, counts

    def symbols(self, codes: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of normalised texts that lie one behind the other (heads: where they begin), and where each text's begin."""
        classes = self.char_class[codes]
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.touch[classes[:-1], classes[1:]]
        cut[heads[heads < len(codes)]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, len(codes)))
        count = np.ones(len(start), np.int64)
        multi = np.flatnonzero((size > 1) & (size <= LONG))
        pick, like, key = self._distinct(codes, start[multi], size[multi])
        pool, counts = self._solve(codes, start[multi][pick], size[multi][pick], key)
        pools, place = [self.char_symbol[codes[start]], pool], np.arange(len(start))
        place[multi] = len(start) + (np.cumsum(counts) - counts)[like]
        count[multi] = counts[like]
        used = len(start) + len(pool)
        for k in np.flatnonzero(size > LONG).tolist():
            path = self.shortest_long(codes[start[k] : start[k] + size[k]].astype("<u4").tobytes().decode("utf-32-le"))
            pools.append(np.array(path, np.int64))
            place[k], count[k] = used, len(path)
            used += len(path)
        ends = np.append(0, np.cumsum(count))
        return np.concatenate(pools)[_spread(place, count)], ends[np.searchsorted(start, heads)]

    def fall_back(self, symbols: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids: characters that are no piece as bytes or as the unknown piece."""
        odd = symbols >= self.size
        if not odd.any():
            return symbols, heads
        if self.byte_id is None:
            again = odd & np.append(False, odd[:-1])
            again[heads[heads < len(again)]] = False
            ids = np.where(odd, self.unknown, symbols)[~again]
            return ids, heads - np.append(0, np.cumsum(again))[heads]
        code = np.where(odd, symbols - self.size, 0)
        n = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        at = np.repeat(np.arange(len(symbols)), n)
        nth = _spread(np.zeros_like(n), n)
        code, width = code[at], n[at]
        shifted = code >> 6 * (width - 1 - nth)
        lead = np.where(width == 1, code, np.array([0, 0, 0xC0, 0xE0, 0xF0])[width] | shifted)
        value = np.where(nth == 0, lead, 0x80 | shifted & 63)
        return np.where(odd[at], self.byte_id[value], symbols[at]), np.append(0, np.cumsum(n))[heads]

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and where each text's begin (and the last one's end)."""
        found, sizes = [], []
        for parts, rows in _parts(texts, BATCH):
            joined = "".join((META if self.prefix and x and row >= 0 else "") + x for x, row in zip(parts, rows))
            codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            codes = np.where(codes == 32, np.uint32(ord(META)), codes)
            length = np.array([len(x) + (self.prefix and x != "" and row >= 0) for x, row in zip(parts, rows)], np.int64)
            heads = np.append(0, np.cumsum(length))
            ids, heads = self.fall_back(*self.symbols(codes, heads)) if len(codes) else (np.empty(0, np.int64), heads)
            found.append(ids)
            for row, n in zip(rows, np.diff(heads).tolist()):
                if row >= 0:
                    sizes.append(n)
                else:
                    sizes[-1] += n
        return np.concatenate([np.empty(0, np.int64), *found]), np.append(0, np.cumsum(np.array(sizes, np.int64)))

    def decode_ids(self, ids: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of sequences of ids, and where each begins."""
        n = self.out_size[ids]
        data = self.out[_spread(self.out_start[ids], n)]
        bounds = np.append(0, np.cumsum(n))[heads]
        if self.prefix:
            some = bounds[:-1] < bounds[1:]
            front = bounds[:-1][some]
            spaced = data[front] == 32
            data = np.delete(data, front[spaced])
            dropped = some.copy()
            dropped[some] = spaced
            bounds = bounds - np.append(0, np.cumsum(dropped))
        return data, bounds

    def encode(self, text: str | None) -> list[int]:
        return self.encode_texts([text or ""])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        data, _ = self.decode_ids(np.array(ids, np.int64), np.array([0, len(ids)]))
        return data.tobytes().decode("utf-8", "replace")


def _parts(texts: list[str], most: int) -> Iterator[tuple[list[str], list[int]]]:
    """Texts in batches of at most so many characters. A longer text comes in parts, cut before a space that follows
    another character, where no piece reaches over; all but the first part have row -1."""
    parts, rows, held = [], [], 0
    for row, text in enumerate(texts):
        lo = 0
        while True:
            hi = len(text)
            if hi - lo > most:
                hi = text.find(" ", lo + most)
                while hi > 0 and text[hi - 1] in (" ", META):
                    hi = text.find(" ", hi + 1)
                hi = hi if hi > 0 else len(text)
            if held and held + hi - lo > most:
                yield parts, rows
                parts, rows, held = [], [], 0
            parts.append(text[lo:hi])
            rows.append(-1 if lo else row)
            held += hi - lo
            lo = hi
            if lo >= len(text):
                break
    if parts:
        yield parts, rows


def encode_decode(docs: DataFrame, model: bytes, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, ids, n_tokens, n_byte_tokens, the text decoded from the ids, and whether that is the text (with
    meta signs as spaces)."""
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(Transducer(model))  # tables of a vocabulary file: their size doesn't depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for b in batches:
            size = np.append(0, np.cumsum(pa.compute.fill_null(pa.compute.binary_length(b.column(b.num_columns - 1)), 0).to_numpy(zero_copy_only=False)))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, size[lo] + BATCH, "right")) - 1)
                part = b.slice(lo, hi - lo)
                lo = hi
                texts = [x or "" for x in part.column(part.num_columns - 1).to_pylist()]
                ids, heads = machine.encode_texts(texts)
                data, bounds = machine.decode_ids(ids, heads)
                decoded = pa.StringArray.from_buffers(len(texts), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data.tobytes()))
                same = pa.compute.equal(decoded, pa.array([x.replace(META, " ") for x in texts], pa.string()))
                n_bytes = np.diff(np.append(0, np.cumsum(machine.is_byte[ids]))[heads])
                lists = pa.ListArray.from_arrays(pa.array(heads, pa.int32()), pa.array(ids, pa.int32()))
                cols = [part.column(k) for k in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, lists, pa.array(np.diff(heads)), pa.array(n_bytes, pa.int64()), decoded, same], [*keep, "ids", "n_tokens", "n_byte_tokens", "decoded", "round_trip"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(tidy(run), f"{schema}, {SCHEMA}")


def model_file(path: str | None = None) -> bytes:
    """The bytes of a model; by default the public model that is installed with the tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op7(docs: DataFrame, path: str | None = None) -> DataFrame:
    coded = encode_decode(docs, model_file(path))
    return coded.select("doc_id", "ids", "n_tokens", "n_byte_tokens", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")
