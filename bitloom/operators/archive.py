"""Archives: header and payload in one blob, written and restored by table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions import header as H
from bitloom.functions import names as N
from bitloom.functions.constants import ADM, AUDIO, BINARY_FILE, BYTE_ALGORITHMS, DM, DPCM, PCM, PICTURE, RLE_QUANT
from bitloom.functions.udfs import DECODED, on_each
from bitloom.operators import kernels as K
from bitloom.sources.media import wav_bytes


def pack(encoded: DataFrame, algorithm: int | None = None) -> DataFrame:
    """(…, name, payload, padding_bits [, algorithm_id]) with archive: the byte codecs' container."""
    algo = F.lit(algorithm) if algorithm is not None else F.col("algorithm_id")
    head = H.serialize(F.lit(BINARY_FILE), algo, F.col("padding_bits"), N.extension(F.col("name")))
    return encoded.withColumn("archive", F.concat(head, "payload"))


def pack_image(encoded: DataFrame) -> DataFrame:
    head = H.serialize(F.lit(PICTURE), F.lit(RLE_QUANT), F.lit(0), N.extension(F.col("name")))
    return encoded.withColumn("archive", F.concat(head, "payload"))


def pack_audio(encoded: DataFrame, algorithm: int, sampling_factor: int = 1, bits: int = 8, delta: float = 0.05, alpha: float = 0.9) -> DataFrame:
    """(…, name, payload, padding_bits, original_length, sample_rate) with archive."""
    p = H.blanked(F.lit(algorithm), F.lit(sampling_factor), F.lit(delta), F.lit(alpha))
    head = H.serialize_audio(
        F.lit(algorithm), F.col("padding_bits"), N.extension(F.col("name")), p["sampling_factor"], F.lit(bits), p["delta_step"], p["alpha"],
        F.col("original_length"), F.col("sample_rate"), F.lit(1),
    )
    return encoded.withColumn("archive", F.concat(head, "payload"))


def status(archives: DataFrame, content: str = "archive") -> DataFrame:
    """archives with the status record: kind, labels, sizes and waveform parameters, or the error of the header."""
    c = F.col(content)
    h = F.when(F.substring(c, 5, 1) == F.lit(bytes([AUDIO])), H.parse_audio(c)).otherwise(_widen(H.parse(c)))
    # generated, not projected: what follows then reads the parsed fields instead of parsing again for each of them
    out = archives.select("*", F.explode(F.array(h)).alias("__h"))
    g = lambda n: F.col("__h")[n]
    return out.select(
        *archives.columns, g("error").alias("header_error"), H.route(g("file_type"), g("algorithm_id")).alias("kind"), g("file_type").alias("file_type"),
        g("algorithm_id").alias("algorithm_id"), H.algorithm_label(g("algorithm_id")).alias("algorithm"), H.file_type_label(g("file_type")).alias("file_type_label"),
        g("extension").alias("extension"), g("padding_bits").alias("padding_bits"), g("total_size").alias("header_bytes"),
        H.payload_size(c, g("total_size")).alias("payload_bytes"), H.logical_bits(c, g("total_size"), g("padding_bits")).alias("logical_bits"),
        *(g(x).alias(x) for x in ("sampling_factor", "bits", "delta_step", "alpha", "original_length", "sample_rate", "n_channels")),
    )


def _widen(h):
    """The base header in the shape of the waveform header."""
    extra = {"sampling_factor": "int", "bits": "int", "delta_step": "double", "alpha": "double", "original_length": "bigint", "sample_rate": "bigint", "n_channels": "int"}
    return F.struct(*(h[c].alias(c) for c in ("file_type", "algorithm_id", "padding_bits", "extension", "total_size")), *(F.lit(None).cast(t).alias(c) for c, t in extra.items()), h["error"].alias("error"))


def _restored(b, header_error, kind, a, padding, factor, bits, delta, alpha, n, rate) -> tuple[bytes | None]:
    if header_error is None and kind == "bytes" and a in BYTE_ALGORITHMS:
        return (None if b is None else K.decompress(b, a, padding),)
    if header_error is None and kind == "image":
        return (None if b is None else K.png(K.image_decode(b)),)
    if header_error is None and kind == "audio" and a in (PCM, DM, ADM, DPCM):
        return (None if b is None else wav_bytes(K.audio_decode(b, padding, a, n, factor, bits, delta, alpha=alpha), rate),)
    raise K.CodecError(header_error or "no decoder")


def restore(archives: DataFrame, content: str = "archive", name: str = "name", also: tuple[str, ...] = ()) -> DataFrame:
    """Every archive through its own decoder: archives with kind, restored (bytes; pictures as PNG, waveforms as WAV), error, the columns of
    the status record in also, and restored_name. One pass: the kernel takes the decoder that a row's header names."""
    read = status(archives, content).withColumn("__p", F.expr(f"substring({content}, header_bytes + 1)"))
    given = ("header_error", "kind", "algorithm_id", "padding_bits", "sampling_factor", "bits", "delta_step", "alpha", "original_length", "sample_rate")
    out = read.withColumn("__d", on_each(_restored, DECODED)("__p", *given))
    kept = [*archives.columns, "kind", "extension", "algorithm", *also]
    out = out.select(*kept, F.col("__d.content").alias("restored"), F.col("__d.error").alias("error"))
    return out.withColumn("restored_name", F.when(F.col("error").isNull(), N.restored_name(F.col(name), F.col("kind"), F.col("extension"))))
