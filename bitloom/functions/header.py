"""The archive header: 8 bytes and an extension; for waveforms 16 bytes more."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.functions.bits import big_endian, unsigned
from bitloom.functions.constants import ALGORITHM_LABELS, AUDIO, AUDIO_BLOCK_BYTES, CHANNEL_COUNTS, DM, ADM, DPCM, FILE_TYPE_LABELS, HEADER_BYTES, MAGIC, PCM, RLE_QUANT, SAMPLING_FACTORS


def label_map(labels: dict[int, str]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in labels.items() for x in (k, v)])


def algorithm_label(algorithm: Column) -> Column:
    return F.try_element_at(label_map(ALGORITHM_LABELS), algorithm.cast("int"))


def file_type_label(file_type: Column) -> Column:
    return F.try_element_at(label_map(FILE_TYPE_LABELS), file_type.cast("int"))


def algorithm_id(label: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in ALGORITHM_LABELS.items() for x in (v, k)]), label)


def file_type_id(label: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in FILE_TYPE_LABELS.items() for x in (v, k)]), label)


def error(file_type: Column, algorithm: Column, padding: Column, extension: Column) -> Column:
    """What is wrong with header fields; null if nothing is."""
    return (
        F.when(~padding.between(0, 7), "padding_bits")
        .when(~file_type.isin(*FILE_TYPE_LABELS), "file_type")
        .when(~algorithm.isin(*ALGORITHM_LABELS), "algorithm_id")
        .when(F.length(extension) > 255, "extension_length")
        .when(~extension.rlike(r"^[\x00-\x7F]*$"), "extension_ascii")
    )


def audio_error(sampling_factor: Column, bits: Column, length: Column, rate: Column, channels: Column) -> Column:
    return (
        F.when(~sampling_factor.isin(*SAMPLING_FACTORS), "sampling_factor")
        .when(~bits.between(1, 8), "bits")
        .when(length < 0, "original_length")
        .when(rate <= 0, "sample_rate")
        .when(~channels.isin(*CHANNEL_COUNTS), "n_channels")
    )


def strict(value: Column, problem: Column) -> Column:
    """The value, or an exception that names the problem."""
    return F.when(problem.isNull(), value).otherwise(F.raise_error(F.concat(F.lit("invalid header: "), problem)))


def total_size(extension: Column, audio: bool = False) -> Column:
    return F.length(extension) + HEADER_BYTES + (AUDIO_BLOCK_BYTES if audio else 0)


def serialize(file_type: Column, algorithm: Column, padding: Column, extension: Column) -> Column:
    return F.concat(F.lit(MAGIC), *(big_endian(x, 1) for x in (file_type, algorithm, padding, F.length(extension))), F.encode(extension, "US-ASCII"))


def serialize_audio(algorithm: Column, padding: Column, extension: Column, sampling_factor: Column, bits: Column, delta_step: Column, alpha: Column, length: Column, rate: Column, channels: Column) -> Column:
    fixed = lambda x, scale: F.least(F.greatest(F.bround(x.cast("double") * scale, 0).cast("long"), F.lit(0).cast("long")), F.lit(65535).cast("long"))
    return F.concat(
        serialize(F.lit(AUDIO), algorithm, padding, extension),
        big_endian(sampling_factor, 1), big_endian(bits, 1), big_endian(fixed(delta_step, 1000), 2), big_endian(fixed(alpha, 10000), 2),
        big_endian(length, 4), big_endian(rate, 4), big_endian(channels, 2),
    )


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once: expressions that name a value often would grow with every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _base_error(r: Column) -> Column:
    return (
        F.when(F.coalesce(r["size"], F.lit(0)) < HEADER_BYTES, "short")
        .when(r["magic"] != F.lit(MAGIC), "magic")
        .when(~r["file_type"].isin(*FILE_TYPE_LABELS), "file_type")
        .when(~r["algorithm_id"].isin(*ALGORITHM_LABELS), "algorithm_id")
        .when(r["padding_bits"] > 7, "padding_bits")
        .when(r["size"] < r["n"] + HEADER_BYTES, "extension_truncated")
        .when(F.hex(r["ext"]).rlike("^(..)*[89A-F]."), "extension_ascii")
    )


def _raw(content: Column) -> Column:
    ft, algo, pad, n = (unsigned(content, k, 1).cast("int") for k in (4, 5, 6, 7))
    return F.struct(
        F.octet_length(content).alias("size"), F.substring(content, 1, 4).alias("magic"), ft.alias("file_type"), algo.alias("algorithm_id"),
        pad.alias("padding_bits"), n.alias("n"), F.substring(content, F.lit(HEADER_BYTES + 1), n).alias("ext"), content.alias("content"),
    )


def _fields(r: Column, ok: Column) -> list[Column]:
    return [*(F.when(ok, r[c]).alias(c) for c in ("file_type", "algorithm_id", "padding_bits")), F.when(ok, r["ext"].cast("string")).alias("extension")]


def parse(content: Column) -> Column:
    """struct(file_type, algorithm_id, padding_bits, extension, total_size, error); the first error found, in reading order."""

    def body(r):
        return _let(_base_error(r), lambda e: F.struct(*_fields(r, e.isNull()), F.when(e.isNull(), r["n"] + HEADER_BYTES).alias("total_size"), e.alias("error")))

    return _let(_raw(content), body)


def parse_audio(content: Column) -> Column:
    """The same with the waveform fields; the file type is not looked at."""
    places = (("sampling_factor", 0, 1), ("bits", 1, 1), ("delta", 2, 2), ("alpha", 4, 2), ("original_length", 6, 4), ("sample_rate", 10, 4), ("n_channels", 14, 2))

    def more(r):
        at = r["n"] + HEADER_BYTES
        return F.struct(at.alias("at"), *(unsigned(r["content"], at + o, k).alias(c) for c, o, k in places))

    def problem(r, x):
        return F.coalesce(
            _base_error(r),
            F.when(r["size"] < x["at"] + AUDIO_BLOCK_BYTES, "audio_truncated"),
            audio_error(x["sampling_factor"], x["bits"], x["original_length"], x["sample_rate"], x["n_channels"]),
        )

    def shape(r, x, e):
        ok = e.isNull()
        return F.struct(
            *_fields(r, ok), F.when(ok, x["at"] + AUDIO_BLOCK_BYTES).alias("total_size"), F.when(ok, x["sampling_factor"].cast("int")).alias("sampling_factor"),
            F.when(ok, x["bits"].cast("int")).alias("bits"), F.when(ok, x["delta"] / 1000.0).alias("delta_step"), F.when(ok, x["alpha"] / 10000.0).alias("alpha"),
            F.when(ok, x["original_length"]).alias("original_length"), F.when(ok, x["sample_rate"]).alias("sample_rate"), F.when(ok, x["n_channels"].cast("int")).alias("n_channels"), e.alias("error"),
        )

    return _let(_raw(content), lambda r: _let(more(r), lambda x: _let(problem(r, x), lambda e: shape(r, x, e))))


def describe(file_type: Column, algorithm: Column, padding: Column, extension: Column) -> Column:
    """Debug text of a header."""
    return F.format_string("Header(file_type=0x%02X, algorithm_id=0x%02X, padding_bits=%d, extension='%s')", file_type, algorithm, padding, extension)


def route(file_type: Column, algorithm: Column) -> Column:
    """Which decoder an archive goes to."""
    return F.when(file_type == AUDIO, "audio").when(algorithm == RLE_QUANT, "image").otherwise("bytes")


def blanked(algorithm: Column, sampling_factor: Column, delta_step: Column, alpha: Column) -> Column:
    """Waveform parameters as the header holds them: those the algorithm doesn't use are neutral."""
    return F.struct(
        F.when(algorithm == PCM, sampling_factor).otherwise(1).alias("sampling_factor"),
        F.when(algorithm.isin(DM, ADM), delta_step.cast("double")).otherwise(0.0).alias("delta_step"),
        F.when(algorithm == DPCM, alpha.cast("double")).otherwise(0.0).alias("alpha"),
    )


def payload_size(content: Column, size: Column) -> Column:
    return F.octet_length(content).cast("long") - size


def logical_bits(content: Column, size: Column, padding: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), payload_size(content, size) * 8 - padding)
