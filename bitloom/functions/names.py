"""File names, sizes, ratios and quality labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.functions.bits import byte_list
from bitloom.functions.constants import AUDIO_EXTENSIONS, IMAGE_EXTENSIONS


def _past_half(x: Column, n: Column, scale: int) -> Column:
    """Sign of x * scale - (n + 1/2), exactly, for 0 <= x < 2^53 and a scale below 2^26: x is split in halves whose products are exact."""
    t = x * F.lit(134217729.0)
    high = t - (t - x)
    return (high * F.lit(float(scale)) - (n + 0.5)) + (x - high) * F.lit(float(scale))


def fixed(x: Column, places: int, form: str = "%.{n}f") -> Column:
    """A number in print with so many places, as C's printf: the binary value is rounded, exact ties go to the even digit. Places: 7 at most."""
    head, flag, tail = re.fullmatch(r"([^%]*)%(\+?)\.\{n\}f(.*)", form).groups()
    scale, big = 10**places, 2.0**53

    def shown(b: Column) -> Column:
        whole = F.when(b["x"] < big, F.floor(b["x"])).otherwise(F.lit(0))
        part = F.when(b["x"] < big, b["x"] - whole.cast("double")).otherwise(F.lit(0.0))
        return F.struct(whole.alias("whole"), part.alias("part"), F.floor(part * float(scale)).alias("n"), b["x"].alias("x"), b["sign"].alias("sign"))

    def printed(b: Column) -> Column:
        past = _past_half(b["part"], b["n"].cast("double"), scale)
        n = b["n"] + F.when((past > 0) | ((past == 0) & (b["n"] % 2 == 1)), 1).otherwise(0)
        carried = F.when(n >= scale, 1).otherwise(0)
        digits = F.concat((b["whole"] + carried).cast("string"), F.lit("."), F.lpad((n - carried * scale).cast("string"), places, "0"))
        return F.concat(b["sign"], F.when(b["x"] < big, digits).otherwise(F.format_string(f"%.{places}f", b["x"])))

    value = x.cast("double")
    sign = F.when(value.cast("string").startswith("-"), "-").otherwise(F.lit(flag))
    # each step is bound by an array of one, so that what follows reads its result instead of working it out again
    one = F.transform(F.transform(F.array(F.struct(F.abs(value).alias("x"), sign.alias("sign"))), shown), printed)[0]
    odd = F.concat(sign, F.when(F.isnan(value), "nan").otherwise("inf"))
    text = F.when(F.isnan(value) | (F.abs(value) == float("inf")), odd).otherwise(one)
    return F.when(value.isNotNull(), F.concat(F.lit(head), text, F.lit(tail.replace("%%", "%"))))


def rounded(x: Column | str, places: int) -> Column:
    """A double rounded as SQL engines in C do: scaled, halves away from zero, scaled back; the sign of zero stays."""
    scale = float(10**places)

    def back(v: Column) -> Column:
        size = F.abs(v) * scale
        low = F.floor(size).cast("double")
        near = F.when(size < 2.0**52, low + F.when(size - low >= 0.5, 1.0).otherwise(0.0)).otherwise(size) / scale
        return F.when(v.cast("string").startswith("-"), -near).otherwise(near)

    value = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.when(F.isnan(value) | (F.abs(value) * scale == float("inf")), value).otherwise(F.transform(F.array(value), back)[0])


def size_metrics(content: Column) -> Column:
    n = F.octet_length(content).cast("long")
    return F.struct(n.alias("bytes"), (n / 1024.0).alias("kb"), (n / 1048576.0).alias("mb"))


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without one or if nothing follows."""
    return F.when(F.locate(".", name) > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)\.[^.]*$", "")


def archive_stem(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".abc"), F.substring(name, F.lit(1), F.length(name) - 4)).otherwise(stem(name))


def is_image(ext: Column) -> Column:
    return ext.isin(*IMAGE_EXTENSIONS)


def is_audio(ext: Column) -> Column:
    return ext.isin(*AUDIO_EXTENSIONS)


def pipeline(ext: Column) -> Column:
    return F.when(is_audio(ext), "audio").when(is_image(ext), "image").otherwise("bytes")


def ratio(original: Column, compressed: Column) -> Column:
    """struct(ratio, savings, css) of two sizes; N/A without an original."""
    none = original == 0
    r = compressed.cast("double") / F.nullif(original, F.lit(0))
    saved = (1.0 - r) * 100.0
    return F.struct(
        F.when(none, "N/A").otherwise(fixed(r, 4, "%.{n}f×")).alias("ratio"),
        F.when(none, "N/A").otherwise(F.concat(F.when(saved >= 0, "-").otherwise("+"), fixed(F.abs(saved), 2, "%.{n}f%%"))).alias("savings"),
        F.when(none, "").when(r < 1.0, "ratio-good").otherwise("ratio-bad").alias("css"),
    )


def psnr_css(psnr: Column) -> Column:
    return F.when(psnr.isNull(), "psnr-inf").when(psnr >= 40, "psnr-exc").when(psnr >= 35, "psnr-good").when(psnr >= 30, "psnr-fair").when(psnr >= 25, "psnr-poor").otherwise("psnr-bad")


def psnr_label(psnr: Column) -> Column:
    return F.when(psnr.isNull(), "Lossless (∞)").when(psnr >= 40, "Excellent").when(psnr >= 35, "Very Good").when(psnr >= 30, "Good").when(psnr >= 25, "Acceptable").otherwise("Distorted")


def sqnr_label(sqnr: Column) -> Column:
    return F.when(sqnr == float("inf"), "Lossless").when(sqnr >= 40, "Excellent").when(sqnr >= 30, "Good").when(sqnr >= 20, "Acceptable").otherwise("Distorted")


def sqnr_band(sqnr: Column) -> Column:
    return (
        F.when(sqnr == float("inf"), "Lossless reconstruction.")
        .when(sqnr >= 40, "Excellent quality — indistinguishable from original.")
        .when(sqnr >= 30, "Good quality — minor quantization noise.")
        .when(sqnr >= 20, "Acceptable — noticeable distortion.")
        .otherwise("Low quality — heavy quantization distortion.")
    )


def efficiency_band(shown: Column) -> Column:
    return (
        F.when(shown >= 95, "Near-optimal.").when(shown >= 80, "Good efficiency; moderate redundancy.")
        .when(shown >= 60, "Moderate efficiency.").otherwise("Low efficiency; significant redundancy.")
    )


def restored_name(name: Column, kind: Column, ext: Column) -> Column:
    """Name of a restored file: by its extension, png for pictures, bin without one."""
    tail = F.when(kind == "audio", F.when(ext == "", "(none)").otherwise(ext)).when(kind == "image", "png").when(ext != "", ext).otherwise("bin")
    return F.concat(archive_stem(name), F.lit("_restored."), tail)


def download_name(name: Column) -> Column:
    return F.concat(stem(name), F.lit("_compressed.abc"))


def mime(ext: Column) -> Column:
    return F.concat(F.lit("audio/"), F.when(ext == "m4a", "mp4").when(ext == "mp3", "mpeg").otherwise(ext))


def hex_dump(content: Column) -> Column:
    return F.array_join(F.transform(byte_list(content), lambda h: F.concat(F.lit("0x"), h)), " ")
