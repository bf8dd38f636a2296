"""Codec kernels on single blobs and signals: bytes and arrays, no Spark."""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np

from bitloom.functions.constants import ADM_MULTIPLIER, ADM_STEP_MAX, ADM_STEP_MIN, DPCM_HIGH, DPCM_LOW, MAX_RUN


class CodecError(ValueError):
    """A payload or parameter that the format does not allow."""


# bits


def expand(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The low bits of each value, most significant first, one after the other."""
    total = int(widths.sum())
    if not total:
        return np.empty(0, np.uint8)
    ends = np.cumsum(widths)
    down = np.repeat(ends, widths) - np.arange(total) - 1
    return (np.repeat(values, widths) >> down & 1).astype(np.uint8)


def pack(bits: np.ndarray) -> tuple[bytes, int]:
    return np.packbits(bits).tobytes(), -len(bits) % 8


def unpack(payload: bytes, padding: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(payload, np.uint8))
    return bits[: max(0, len(bits) - padding)]


def collect(bits: np.ndarray, width: int) -> np.ndarray:
    """Values of whole groups of so many bits; an incomplete last group is dropped."""
    n = len(bits) // width
    weights = 1 << np.arange(width - 1, -1, -1, dtype=np.int64)
    return bits[: n * width].reshape(n, width).astype(np.int64) @ weights


# Huffman


def histogram(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def huffman_codes(counts: dict[int, int]) -> dict[int, str]:
    """Code of each symbol. Leaves enter in symbol order and parents after them; of equal weights the older node is taken first."""
    if len(counts) == 1:
        return {next(iter(counts)): "0"}
    heap = [(counts[s], k, s) for k, s in enumerate(sorted(counts))]
    heapq.heapify(heap)
    born = len(heap)
    while len(heap) > 1:
        zero, one = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (zero[0] + one[0], born, (zero[2], one[2])))
        born += 1
    codes: dict[int, str] = {}
    todo = [(heap[0][2], "")] if heap else []
    while todo:
        node, code = todo.pop()
        if isinstance(node, tuple):
            todo += [(node[0], code + "0"), (node[1], code + "1")]
        else:
            codes[node] = code
    return codes


def counts_of(data: bytes) -> dict[int, int]:
    h = histogram(data)
    return {int(s): int(h[s]) for s in np.flatnonzero(h)}


def write_counts(counts: dict[int, int]) -> bytes:
    return struct.pack(">H", len(counts)) + b"".join(struct.pack(">BI", s, counts[s]) for s in sorted(counts))


def read_counts(payload: bytes) -> tuple[dict[int, int], int]:
    if len(payload) < 2:
        raise CodecError("frequency table: no size")
    n = int.from_bytes(payload[:2], "big")
    if len(payload) < 2 + 5 * n:
        raise CodecError("frequency table: truncated")
    return dict(struct.iter_unpack(">BI", payload[2 : 2 + 5 * n])), 2 + 5 * n


def huffman_encode(data: bytes) -> tuple[bytes, int]:
    if not data:
        return b"\0\0", 0
    counts = counts_of(data)
    codes = huffman_codes(counts)
    table = write_counts(counts)
    if max(map(len, codes.values())) > 60:  # a blob of Fibonacci-like counts
        bits = np.frombuffer("".join(map({s: c for s, c in codes.items()}.__getitem__, data)).encode(), np.uint8) - 48
    else:
        value, width = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for s, c in codes.items():
            value[s], width[s] = int(c, 2), len(c)
        sym = np.frombuffer(data, np.uint8)
        bits = expand(value[sym], width[sym])
    body, padding = pack(bits)
    return table + body, padding


def huffman_decode(payload: bytes, padding: int) -> bytes:
    if not payload:
        return b""
    counts, at = read_counts(payload)
    if not counts:
        return b""
    if len(counts) == 1:
        ((symbol, n),) = counts.items()
        if 8 * (len(payload) - at) < n:  # a bit for each; a blob can't claim more than it holds
            raise CodecError(f"{n} symbols in {len(payload) - at} bytes")
        return bytes([symbol]) * n
    total = sum(counts.values())
    codes = huffman_codes(counts)
    children: list[list[int]] = [[0, 0]]  # > 0: node, <= 0: minus symbol less one
    for s, code in codes.items():
        node = 0
        for k, c in enumerate(code):
            if k == len(code) - 1:
                children[node][int(c)] = -s - 1
            elif children[node][int(c)] == 0:
                children.append([0, 0])
                children[node][int(c)] = len(children) - 1
                node = len(children) - 1
            else:
                node = children[node][int(c)]

    def walk(node: int, byte: int, n: int = 8) -> tuple[bytes, int]:
        out = bytearray()
        for k in range(7, 7 - n, -1):
            node = children[node][byte >> k & 1]
            if node < 0:
                out.append(-node - 1)
                node = 0
        return bytes(out), node

    known: dict[int, tuple[bytes, int]] = {}  # what a whole byte does from a node
    out, node, body = [], 0, payload[at:]
    if body:
        for byte in body[:-1]:
            key = node << 8 | byte
            step = known.get(key)
            if step is None:
                step = known[key] = walk(node, byte)
            out.append(step[0])
            node = step[1]
        out.append(walk(node, body[-1], 8 - padding)[0])
    data = b"".join(out)[:total]
    if len(data) != total:
        raise CodecError(f"decoded {len(data)} symbols of {total}")
    return data


# LZ78


def lz78_tokens(data: bytes) -> list[tuple[int, int | None]]:
    """(phrase, next byte); the byte is None where the data ends inside a known phrase."""
    tokens: list[tuple[int, int | None]] = []
    known: dict[int, int] = {}
    at = 0
    for byte in data:
        key = at << 8 | byte
        nxt = known.get(key)
        if nxt is None:
            tokens.append((at, byte))
            known[key] = len(tokens)
            at = 0
        else:
            at = nxt
    if at:
        tokens.append((at, None))
    return tokens


def index_width(k: int) -> int:
    """Bits of the phrase number in token k, counted from 1."""
    return 1 if k <= 2 else (k - 1).bit_length()


def _widths(n: int) -> np.ndarray:
    k = np.arange(1, n + 1, dtype=np.int64)
    return np.where(k <= 2, 1, np.floor(np.log2(np.maximum(k - 1, 1))).astype(np.int64) + 1)


def lz78_encode(data: bytes) -> tuple[bytes, int]:
    tokens = lz78_tokens(data)
    if not tokens:
        return bytes(5), 0
    index = np.array([t[0] for t in tokens], np.int64)
    byte = np.array([-1 if t[1] is None else t[1] for t in tokens], np.int64)
    open_ = byte < 0
    body, padding = pack(expand(np.where(open_, index << 1, index << 9 | 256 | byte), _widths(len(tokens)) + np.where(open_, 1, 9)))
    return struct.pack(">IB", len(tokens), padding) + body, 0


def lz78_read(payload: bytes) -> list[tuple[int, int | None]]:
    """Tokens of a payload; bits past its end are zeros."""
    if len(payload) < 5:
        raise CodecError("payload too short")
    n, padding = struct.unpack(">IB", payload[:5])
    bits = unpack(payload[5:], padding if padding < 8 else 0)
    if n > len(bits) + 1:
        raise CodecError("more tokens than bits")
    widths = _widths(n)
    start = np.concatenate([[0], np.cumsum(widths + 9)])
    bits = np.concatenate([bits, np.zeros(max(0, int(start[-1]) - len(bits)) + 64, np.uint8)])
    flags = bits[start[:-1] + widths] if n else np.empty(0, np.uint8)
    if n and flags[:-1].all():  # only the last token can be open in what the encoder writes
        index, byte = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for w in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == w)
            for j in range(w):
                index[rows] = index[rows] << 1 | bits[start[rows] + j]
        for j in range(8):
            byte = byte << 1 | bits[start[:-1] + widths + 1 + j]
        out: list[tuple[int, int | None]] = list(zip(index.tolist(), byte.tolist(), strict=True))
        if not flags[-1]:
            out[-1] = (out[-1][0], None)
        return out
    out, at, flat = [], 0, bits.tolist()
    for k in range(1, n + 1):
        index = 0
        for _ in range(index_width(k)):
            index = index << 1 | flat[at]
            at += 1
        at += 1
        if flat[at - 1]:
            byte = 0
            for b in flat[at : at + 8]:
                byte = byte << 1 | b
            at += 8
            out.append((index, byte))
        else:
            out.append((index, None))
    return out


def lz78_decode(payload: bytes, padding: int = 0) -> bytes:
    if not payload:
        return b""
    phrases, out = [b""], []
    for index, byte in lz78_read(payload):
        if index >= len(phrases):
            raise CodecError(f"unknown phrase {index}")
        phrase = phrases[index] if byte is None else phrases[index] + bytes([byte])
        phrases.append(phrase)
        out.append(phrase)
    return b"".join(out)


def chained_encode(data: bytes) -> tuple[bytes, int]:
    return huffman_encode(lz78_encode(data)[0])


def chained_decode(payload: bytes, padding: int) -> bytes:
    return lz78_decode(huffman_decode(payload, padding)) if payload else b""


ENCODERS = {1: huffman_encode, 2: lz78_encode, 3: chained_encode}
DECODERS = {1: huffman_decode, 2: lz78_decode, 3: chained_decode}


def compress(data: bytes, algorithm: int) -> tuple[bytes, int]:
    if algorithm not in ENCODERS:
        raise CodecError(f"no byte codec 0x{algorithm:02X}")
    return ENCODERS[algorithm](data)


def decompress(payload: bytes, algorithm: int, padding: int) -> bytes:
    if algorithm not in DECODERS:
        raise CodecError(f"no byte codec 0x{algorithm:02X}")
    return DECODERS[algorithm](payload, padding)


# pictures


def luma(rgb: np.ndarray) -> np.ndarray:
    """Gray values of an H x W x 3 picture, in 32-bit arithmetic, cut to whole numbers."""
    f = rgb.astype(np.float32)
    y = np.float32(0.299) * f[..., 0] + np.float32(0.587) * f[..., 1] + np.float32(0.114) * f[..., 2]
    return np.clip(y, 0, 255).astype(np.uint8)


def quantize(pixels: np.ndarray, bits: int) -> np.ndarray:
    shift = 8 - min(8, max(1, bits))
    return (pixels >> shift << shift).astype(np.uint8)


def runs(flat: np.ndarray, most: int | None = MAX_RUN) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of runs, cut at the greatest length."""
    if not len(flat):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    value, length = flat[begin].astype(np.int64), np.diff(np.concatenate([begin, [len(flat)]]))
    if most is None:
        return value, length
    parts = -(-length // most)
    value = np.repeat(value, parts)
    out = np.full(len(value), most, np.int64)
    out[np.cumsum(parts) - 1] = length - (parts - 1) * most
    return value, out


def rle_encode(flat: np.ndarray) -> bytes:
    value, length = runs(flat)
    body = np.empty((len(value), 3), np.uint8)
    body[:, 0], body[:, 1], body[:, 2] = value, length >> 8, length & 255
    return struct.pack(">IIB", len(flat), len(value), 0) + body.tobytes()


def rle_decode(block: bytes, most: int | None = None) -> np.ndarray:
    """Pixels of a block; runs that are too long are cut, pixels that are missing are 0. most: a bound on the size that the block may claim."""
    if len(block) < 9:
        raise CodecError("run-length block too short")
    total, n, _ = struct.unpack(">IIB", block[:9])
    if most is not None and total > most:
        raise CodecError(f"{total} pixels claimed, {most} expected at most")
    body = np.frombuffer(block, np.uint8, min(n, (len(block) - 9) // 3) * 3, 9).reshape(-1, 3).astype(np.int64)
    flat = np.repeat(body[:, 0], body[:, 1] << 8 | body[:, 2])[:total].astype(np.uint8)
    return np.concatenate([flat, np.zeros(total - len(flat), np.uint8)])


def image_encode(pixels: np.ndarray, gray: bool = False, bits: int = 8) -> bytes:
    """Payload of an H x W x 3 (or H x W) picture."""
    bits = min(8, max(1, bits))
    if gray and pixels.ndim == 3:
        pixels = luma(pixels)
    pixels = quantize(pixels, bits)
    h, w = pixels.shape[:2]
    return struct.pack(">IIBB", h, w, pixels.shape[2] if pixels.ndim == 3 else 1, bits) + rle_encode(pixels.ravel())


def image_decode(payload: bytes) -> np.ndarray:
    """The picture of a payload: H x W x 3 or H x W."""
    if len(payload) < 10:
        raise CodecError("picture payload too short")
    h, w, channels, _ = struct.unpack(">IIBB", payload[:10])
    if channels not in (1, 3):
        raise CodecError(f"{channels} channels")
    need = h * w * channels
    flat = rle_decode(payload[10:], most=max(need, 1 << 28))
    if len(flat) < need:
        raise CodecError(f"{len(flat)} pixels of {need}")
    flat = flat[:need]
    return flat.reshape(h, w) if channels == 1 else flat.reshape(h, w, 3)


def bgr_to_rgb(data: bytes, h: int, w: int, channels: int) -> bytes:
    """Pixels of the JVM's pictures (gray, BGR or BGRA) as RGB."""
    if h < 0 or w < 0 or channels not in (1, 3, 4) or len(data) != h * w * channels:
        raise CodecError("no picture")
    p = np.frombuffer(data, np.uint8).reshape(h, w, channels)
    return (np.repeat(p, 3, 2) if channels == 1 else p[..., 2::-1]).tobytes()


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of an H x W or H x W x 3 picture."""
    h, w = pixels.shape[:2]
    rows = np.zeros((h, 1 + pixels[0].size if h else 1), np.uint8)
    if h:
        rows[:, 1:] = pixels.reshape(h, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


# waveforms


def uniform_index(x, levels: int, low: float, high: float):
    """Level of each value (64-bit floats); all are 0 where the range is empty."""
    x = np.asarray(x, np.float64)
    if high - low == 0:
        return np.zeros(x.shape, np.int64)
    return np.minimum(((np.clip(x, low, high) - low) / (high - low) * levels).astype(np.int64), levels - 1)


def uniform_value(index, levels: int, low: float, high: float):
    return low + (np.asarray(index) + 0.5) * ((high - low) / levels)


def _fit(x: np.ndarray, length: int) -> np.ndarray:
    x = np.asarray(x, np.float32)[:length]
    return np.concatenate([x, np.zeros(length - len(x), np.float32)])


def _bits_ok(bits: int) -> None:
    if not 1 <= bits <= 8:
        raise CodecError(f"{bits} bits")


def pcm_encode(signal: np.ndarray, sampling_factor: int = 1, bits: int = 8) -> tuple[bytes, int]:
    if sampling_factor < 1:
        raise CodecError(f"sampling factor {sampling_factor}")
    _bits_ok(bits)
    x = np.asarray(signal, np.float32)[::sampling_factor].astype(np.float64)
    if not len(x):
        return struct.pack(">ff", 0.0, 0.0), 0
    low, high = float(x.min()), float(x.max())
    if low == high:
        low, high = low - 1e-6, high + 1e-6
    body, padding = pack(expand(uniform_index(x, 1 << bits, low, high), np.full(len(x), bits)))
    return struct.pack(">ff", low, high) + body, padding


def pcm_decode(payload: bytes, padding: int, bits: int, length: int, sampling_factor: int = 1) -> np.ndarray:
    if len(payload) < 8:
        raise CodecError("PCM payload too short")
    low, high = struct.unpack(">ff", payload[:8])
    x = uniform_value(collect(unpack(payload[8:], padding), bits), 1 << bits, low, high).astype(np.float32)
    return _fit(np.repeat(x, sampling_factor), length)


def _clamp(x: float) -> float:
    return -1.0 if x < -1.0 else 1.0 if x > 1.0 else x


def _move(s: float, up: int, delta: float) -> float:
    """The staircase after one bit."""
    return min(1.0, s + delta) if up else max(-1.0, s - delta)


def dm_encode(signal: np.ndarray, delta: float) -> tuple[bytes, int]:
    if delta <= 0:
        raise CodecError(f"step {delta}")
    s, bits = 0.0, []
    for x in np.asarray(signal, np.float32).tolist():
        up = x > s
        bits.append(up)
        s = _move(s, up, delta)
    body, padding = pack(np.array(bits, np.uint8))
    return struct.pack(">f", 0.0) + body, padding


def dm_decode(payload: bytes, padding: int, delta: float, length: int) -> np.ndarray:
    if len(payload) < 4:
        raise CodecError("DM payload too short")
    (s,) = struct.unpack(">f", payload[:4])
    out = []
    for up in unpack(payload[4:], padding)[:length].tolist():
        s = _move(s, up, delta)
        out.append(s)
    return _fit(np.array(out, np.float32), length)


class _Step:
    """The step size of adaptive delta modulation; it changes after each bit but the first."""

    def __init__(self, first: float, multiplier: float):
        self.size, self.multiplier, self.before = first, multiplier, None

    def adapt(self, up: int) -> None:
        if self.before is not None:
            self.size = min(self.size * self.multiplier, ADM_STEP_MAX) if up == self.before else max(self.size / self.multiplier, ADM_STEP_MIN)
        self.before = up


def adm_encode(signal: np.ndarray, delta: float, multiplier: float = ADM_MULTIPLIER) -> tuple[bytes, int]:
    if delta <= 0 or multiplier <= 1:
        raise CodecError(f"step {delta}, multiplier {multiplier}")
    s, bits, step = 0.0, [], _Step(delta, multiplier)
    for x in np.asarray(signal, np.float32).tolist():
        up = int(x > s)
        bits.append(up)
        s = _move(s, up, step.size)
        step.adapt(up)
    body, padding = pack(np.array(bits, np.uint8))
    return struct.pack(">f", 0.0) + body, padding


def adm_decode(payload: bytes, padding: int, delta: float, length: int, multiplier: float = ADM_MULTIPLIER) -> np.ndarray:
    if len(payload) < 4:
        raise CodecError("ADM payload too short")
    (s,) = struct.unpack(">f", payload[:4])
    out, step = [], _Step(delta, multiplier)
    for up in unpack(payload[4:], padding)[:length].tolist():
        s = _move(s, up, step.size)
        step.adapt(up)
        out.append(s)
    return _fit(np.array(out, np.float32), length)


def dpcm_encode(signal: np.ndarray, bits: int, alpha: float) -> tuple[bytes, int]:
    _bits_ok(bits)
    if not 0 < alpha <= 1:
        raise CodecError(f"predictor {alpha}")
    levels, span, x_rec, codes = 1 << bits, DPCM_HIGH - DPCM_LOW, 0.0, []
    for x in np.asarray(signal, np.float32).tolist():
        guess = alpha * x_rec
        e = min(max(x - guess, DPCM_LOW), DPCM_HIGH)
        k = min(int((e - DPCM_LOW) / span * levels), levels - 1)
        codes.append(k)
        x_rec = _clamp(guess + (DPCM_LOW + (k + 0.5) * (span / levels)))
    return pack(expand(np.array(codes, np.int64), np.full(len(codes), bits)))


def dpcm_decode(payload: bytes, padding: int, bits: int, alpha: float, length: int) -> np.ndarray:
    _bits_ok(bits)
    levels, span, x_rec, out = 1 << bits, DPCM_HIGH - DPCM_LOW, 0.0, []
    for k in collect(unpack(payload, padding), bits)[:length].tolist():
        x_rec = _clamp(alpha * x_rec + (DPCM_LOW + (k + 0.5) * (span / levels)))
        out.append(x_rec)
    return _fit(np.array(out, np.float32), length)


def audio_encode(signal, algorithm: int, sampling_factor: int = 1, bits: int = 8, delta: float = 0.05, multiplier: float = ADM_MULTIPLIER, alpha: float = 0.9) -> tuple[bytes, int]:
    if algorithm == 5:
        return pcm_encode(signal, sampling_factor, bits)
    if algorithm == 6:
        return dm_encode(signal, delta)
    if algorithm == 7:
        return adm_encode(signal, delta, multiplier)
    if algorithm == 8:
        return dpcm_encode(signal, bits, alpha)
    raise CodecError(f"no waveform codec 0x{algorithm:02X}")


def audio_decode(payload, padding: int, algorithm: int, length: int, sampling_factor: int = 1, bits: int = 8, delta: float = 0.05, multiplier: float = ADM_MULTIPLIER, alpha: float = 0.9) -> np.ndarray:
    if algorithm == 5:
        return pcm_decode(payload, padding, bits, length, sampling_factor)
    if algorithm == 6:
        return dm_decode(payload, padding, delta, length)
    if algorithm == 7:
        return adm_decode(payload, padding, delta, length, multiplier)
    if algorithm == 8:
        return dpcm_decode(payload, padding, bits, alpha, length)
    raise CodecError(f"no waveform codec 0x{algorithm:02X}")


# simulators


def sim_lz78(text: str) -> tuple[list[tuple[int, str]], list[tuple[int, int, str]]]:
    """Dictionary rows (index, pattern) and token rows (step, phrase, character); a known phrase at the end is told by its own prefix."""
    known: dict[str, int] = {}
    tokens, phrase = [], ""
    for k, c in enumerate(text):
        phrase += c
        new = phrase not in known
        if new or k == len(text) - 1:
            tokens.append((len(tokens) + 1, known.get(phrase[:-1], 0), c))
            if new:
                known[phrase] = len(known) + 1
            phrase = ""
    return [(i, p) for p, i in known.items()], tokens
