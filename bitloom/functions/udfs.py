"""Arrow kernels as column functions, and their names in SQL.

A kernel takes Arrow batches; those on blobs hold and return about PART bytes of a batch at a time. A blob that the format doesn't allow gives an error text beside a null result
instead of failing the job. ``strict=True`` raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from bitloom.operators import kernels as K



def struct(**fields: T.DataType) -> T.StructType:
    """Types as objects: workers import this module, and a type in words needs a session to be read."""
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_TEXT, _BIN, _INT, _LONG, _SHORT = T.StringType(), T.BinaryType(), T.IntegerType(), T.LongType(), T.ShortType()
ENCODED = struct(payload=_BIN, padding_bits=_INT, error=_TEXT)
DECODED = struct(content=_BIN, error=_TEXT)
SIGNAL = struct(signal=T.ArrayType(T.FloatType()), error=_TEXT)


def _each(kernel, columns, out: list[str], strict: bool = False) -> pd.DataFrame:
    """Apply a kernel row by row within one Arrow batch; null inputs give nulls."""
    rows = []
    for args in zip(*columns, strict=True):
        if any(a is None or (isinstance(a, float) and a != a) for a in args):
            rows.append((*[None] * len(out), None))
            continue
        try:
            got = kernel(*args)
            rows.append((*(got if len(out) > 1 else (got,)), None))
        except K.CodecError as e:
            if strict:
                raise
            rows.append((*[None] * len(out), str(e)))
    frame = pd.DataFrame(rows, columns=[*out, "error"])
    for c in out:
        frame[c] = frame[c].astype(object).where(frame[c].notna() if c == "padding_bits" else frame[c].map(lambda x: x is not None), None)
    if "padding_bits" in out:
        frame["padding_bits"] = frame["padding_bits"].astype("Int32")
    return frame


#: Bytes of blobs, and rows, that a kernel works on at a time.
PART, PART_ROWS = 1 << 20, 256


def _parts(columns: tuple[pa.Array, ...]) -> Iterator[list[pa.Array]]:
    """One Arrow batch in slices; the first column has the blobs."""
    blobs = columns[0]
    n = np.asarray(pc.fill_null(pc.binary_length(blobs), 0), np.int64)
    group = (np.cumsum(n) - n) // PART
    cuts = {0, len(blobs), *range(0, len(blobs), PART_ROWS), *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist()}
    at = sorted(cuts)
    for i, j in zip(at, at[1:], strict=False):
        yield [c.slice(i, j - i) for c in columns]


def on_blobs(part: Callable[..., pa.Array], returns: T.DataType):
    """A column function from one on slices of columns."""

    def run(batches):
        for columns in batches:
            for x in _parts(columns if isinstance(columns, tuple) else (columns,)):
                yield part(*x)

    return F.arrow_udf(run, returns, F.ArrowUDFType.SCALAR_ITER)


def on_each(kernel: Callable[..., tuple], returns: T.StructType, strict: bool = False):
    """A column function from a kernel on the values of one row that gives all fields but the last, the error of a blob that the format
    does not allow."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, names, nothing = to_arrow_type(returns), returns.names, [None] * (len(returns) - 1)

    def part(*columns: pa.Array) -> pa.Array:
        rows = []
        for args in zip(*(c.to_pylist() for c in columns), strict=True):
            try:
                rows.append(dict(zip(names, (*kernel(*args), None), strict=True)))
            except K.CodecError as e:
                if strict:
                    raise
                rows.append(dict(zip(names, (*nothing, str(e)), strict=True)))
        return pa.array(rows, kind)

    return on_blobs(part, returns)


def encoder(algorithm: int, strict: bool = False):
    return on_each(lambda b: (None, None) if b is None else K.compress(b, algorithm), ENCODED, strict)


def decoder(algorithm: int, strict: bool = False):
    return on_each(lambda b, p: (None,) if b is None or p is None else (K.decompress(b, algorithm, p),), DECODED, strict)


def _known(algorithm: int | None) -> int:
    if algorithm not in K.ENCODERS:
        raise K.CodecError(f"no byte codec {'null' if algorithm is None else algorithm}")
    return algorithm


def any_encoder():
    """Of (content, algorithm): each row by the codec that it names."""
    return on_each(lambda b, a: K.compress(b, a) if _known(a) and b is not None else (None, None), ENCODED)


def any_decoder():
    """Of (payload, algorithm, padding)."""
    return on_each(lambda b, a, p: (K.decompress(b, a, p),) if _known(a) and b is not None and p is not None else (None,), DECODED)


def _counts(content: pa.Array) -> pa.Array:
    blobs = content.to_pylist()
    held = [K.histogram(b) for b in blobs if b is not None]
    ends = np.cumsum([0, *(256 * (b is not None) for b in blobs)]).astype(np.int32)
    values = pa.array(np.concatenate(held) if held else np.empty(0, np.int64), pa.int64())
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([b is None for b in blobs]))


#: Counts of the 256 byte values.
histogram = on_blobs(_counts, T.ArrayType(_LONG))


def _listed(kernel: Callable[[bytes], list[dict]], element: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(T.ArrayType(element))
    return on_blobs(lambda c: pa.array([None if b is None else kernel(b) for b in c.to_pylist()], kind), T.ArrayType(element))


#: Huffman code of each byte value that occurs.
code_table = _listed(lambda b: [{"sym": s, "code": c} for s, c in sorted(K.huffman_codes(K.counts_of(b)).items())], struct(sym=_SHORT, code=_TEXT))
lz78_tokens = _listed(lambda b: [{"idx": i, "ch": c} for i, c in K.lz78_tokens(b)], struct(idx=_LONG, ch=_SHORT))


def _sizes(b: bytes) -> list[dict]:
    phrases = K.lz78_encode(b)
    coded = {1: K.huffman_encode(b), 2: phrases, 3: K.huffman_encode(phrases[0])}
    return [{"algorithm_id": a, "payload_bytes": len(p), "padding_bits": pad} for a, (p, pad) in coded.items()]


#: Payload size and padding of a blob under each byte codec, the chained one from the LZ78 payload at hand.
coded_sizes = _listed(_sizes, struct(algorithm_id=_INT, payload_bytes=_LONG, padding_bits=_INT))


def audio_encoder(algorithm: int, strict: bool = False, **params):
    @pandas_udf(ENCODED)
    def encode(signal: pd.Series) -> pd.DataFrame:
        return _each(lambda x: K.audio_encode(np.asarray(x, np.float32), algorithm, **params), [signal], ["payload", "padding_bits"], strict)

    return encode


def audio_decoder(algorithm: int, strict: bool = False, **params):
    @pandas_udf(SIGNAL)
    def decode(payload: pd.Series, padding: pd.Series, length: pd.Series) -> pd.DataFrame:
        return _each(lambda b, p, n: K.audio_decode(b, int(p), algorithm, int(n), **params), [payload, padding, length], ["signal"], strict)

    return decode


def image_encoder(gray: bool = False, bits: int = 8):
    @pandas_udf(_BIN)
    def encode(h: pd.Series, w: pd.Series, channels: pd.Series, pixels: pd.Series) -> pd.Series:
        out = []
        for a, b, c, p in zip(h, w, channels, pixels, strict=True):
            flat = np.frombuffer(p, np.uint8)
            out.append(K.image_encode(flat.reshape((a, b) if c == 1 else (a, b, c)), gray, bits))
        return pd.Series(out)

    return encode


@pandas_udf(struct(h=_INT, w=_INT, channels=_INT, pixels=_BIN, png=_BIN, error=_TEXT))
def image_decoder(payload: pd.Series) -> pd.DataFrame:
    def decode(b):
        p = K.image_decode(b)
        return p.shape[0], p.shape[1], 1 if p.ndim == 2 else 3, p.tobytes(), K.png(p)

    rows = []
    for b in payload:
        try:
            rows.append((*(decode(b) if b is not None else [None] * 5), None))
        except K.CodecError as e:
            rows.append((None, None, None, None, None, str(e)))
    frame = pd.DataFrame(rows, columns=["h", "w", "channels", "pixels", "png", "error"])
    for c in ("h", "w", "channels"):
        frame[c] = frame[c].astype("Int32")
    return frame


@pandas_udf(struct(pixels=_BIN, error=_TEXT))
def rgb_pixels(data: pd.Series, h: pd.Series, w: pd.Series, channels: pd.Series) -> pd.DataFrame:
    """RGB bytes of what the JVM's picture reader gives."""
    return _each(K.bgr_to_rgb, [data, h, w, channels], ["pixels"])


@udtf(returnType=struct(k=_INT, idx=_LONG, ch=_SHORT))
class Lz78Tokens:
    """Tokens of one blob as rows: SELECT * FROM t, LATERAL lz78_token_rows(content)."""

    def eval(self, content: bytes) -> Iterator[tuple[int, int, int | None]]:
        for k, (idx, ch) in enumerate(K.lz78_tokens(content or b""), 1):
            yield k, idx, ch


@udtf(returnType=struct(step=_INT, dict_ref=_INT, new_char=_TEXT, index=_INT, pattern=_TEXT, position=_INT))
class SimLz78:
    """Steps of the LZ78 simulator: the token of each, the dictionary row it adds (null at a known end) and how far it got."""

    def eval(self, text: str) -> Iterator[tuple]:
        rows, tokens = K.sim_lz78((text or "")[:64].upper())
        size = {i: len(p) for i, p in rows}
        at = 0
        for step, ref, ch in tokens:
            at += size.get(ref, 0) + 1
            index = step if step <= len(rows) else None
            yield step, ref, ch, index, dict(rows).get(index), at


NAMES = {
    "byte_histogram": histogram, "huffman_code_table": code_table, "lz78_token_list": lz78_tokens, "image_decode": image_decoder,
    "huffman_encode": encoder(1), "lz78_encode": encoder(2), "chained_encode": encoder(3),
    "huffman_decode": decoder(1), "lz78_decode": decoder(2), "chained_decode": decoder(3),
}


def register(spark: SparkSession) -> None:
    """Make the kernels known to SQL."""
    for name, f in NAMES.items():
        spark.udf.register(name, f)
    spark.udtf.register("lz78_token_rows", Lz78Tokens)
    spark.udtf.register("sim_lz78_rows", SimLz78)


def nonzero(counts):
    """array<struct<sym, cnt>> of the byte values that occur, in order."""
    return F.filter(F.transform(counts, lambda c, i: F.struct(i.cast("smallint").alias("sym"), c.alias("cnt"))), lambda x: x.cnt > 0)
