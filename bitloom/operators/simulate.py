"""Step-by-step simulators as tables. They differ from the codecs on purpose: no clamps, other rounding, runs by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import names as N
from bitloom.functions.udfs import SimLz78
from bitloom.operators.image import runs

LEVELS_STEP = 2.0


def lz78_steps(texts: DataFrame, id_col: str = "sim_id", text_col: str = "text") -> DataFrame:
    """id, step, dict_ref, new_char, index, pattern, position: all steps over the first 64 characters, upper-cased."""
    return texts.select(id_col, text_col).lateralJoin(SimLz78(F.col(text_col).outer())).drop(text_col)


def lz78_dictionary(steps: DataFrame, id_col: str = "sim_id") -> DataFrame:
    return steps.where("index is not null").select(id_col, "index", "pattern")


def lz78_consumed(tokens: DataFrame, dictionary: DataFrame, id_col: str = "sim_id") -> DataFrame:
    """Characters that the tokens (step, dict_ref) stand for: the length of each one's phrase and one more."""
    d = dictionary.select(id_col, F.col("index").alias("dict_ref"), "pattern")
    joined = tokens.select(id_col, "dict_ref").join(d, [id_col, "dict_ref"], "left")
    return joined.groupBy(id_col).agg(F.sum(F.coalesce(F.length("pattern"), F.lit(0)) + 1).alias("consumed"), F.count(F.lit(1)).alias("steps"))


def progress(position: Column, length: Column) -> Column:
    return F.least(position / F.greatest(length, F.lit(1)), F.lit(1.0))


def gradient(spark: SparkSession) -> DataFrame:
    """The 8 x 8 gradient: r, c, v."""
    return spark.range(64).select((F.col("id").cast("int") / 8).cast("int").alias("r"), (F.col("id") % 8).cast("int").alias("c"), (F.lit(255) * F.col("id") / 63.0).cast("int").alias("v"))


def sine(spark: SparkSession, n: int = 50) -> DataFrame:
    """One period: n, x (32-bit)."""
    return spark.range(n).select(F.col("id").cast("int").alias("n"), F.sin(F.col("id") * F.lit(2 * 3.141592653589793 / (n - 1))).cast("float").alias("x"))


def quantize(v: Column, bits: int) -> Column:
    return v if bits >= 8 else F.shiftleft(F.shiftright(v.cast("int"), 8 - bits), 8 - bits)


def rle_rows(pixels: DataFrame) -> DataFrame:
    """Runs of each row, never cut: row, run, v, n."""
    return runs(pixels.select(F.col("r").alias("row"), F.col("c").alias("pos"), "v"), ["row"], most=None)


def quantization_report(spark: SparkSession) -> DataFrame:
    """bits, levels, step, tokens, delta to raw and saving in percent for bit depths 1 to 8 over the gradient."""
    g = gradient(spark)
    out = None
    for bits in range(1, 9):
        r = rle_rows(g.withColumn("v", quantize(F.col("v"), bits))).agg(F.count(F.lit(1)).alias("tokens"))
        r = r.select(F.lit(bits).alias("bits"), F.lit(2**bits).alias("levels"), F.lit(256 // 2**bits).alias("step"), "tokens", (F.col("tokens") - 64).alias("against_raw"), ((1 - F.col("tokens") / 64.0) * 100).alias("saving_pct"))
        out = r if out is None else out.unionByName(r)
    return out


def dm_staircase(signal: Column, delta: float) -> Column:
    """Staircase without a clamp."""

    def step(a, x):
        s = F.when(x.cast("double") > a.s, a.s + delta).otherwise(a.s - delta)
        return F.struct(s.alias("s"), F.concat(a.out, F.array(s.cast("float"))).alias("out"))

    return F.aggregate(signal, F.struct(F.lit(0.0).alias("s"), F.array().cast("array<float>").alias("out")), step, lambda a: a.out)


def dpcm(signal: Column, alpha: float, bits: int = 4) -> Column:
    """Reconstruction at the left edge of each level, residuals in [-1, 1), no clamp."""
    half, width = 2 ** (bits - 1), LEVELS_STEP / 2**bits

    def step(a, x):
        guess = F.lit(alpha) * a.x
        k = F.least(F.greatest(F.floor((x.cast("double") - guess) / width), F.lit(-half)), F.lit(half - 1))
        y = guess + k * F.lit(width)
        return F.struct(y.alias("x"), F.concat(a.out, F.array(y.cast("float"))).alias("out"))

    return F.aggregate(signal, F.struct(F.lit(0.0).alias("x"), F.array().cast("array<float>").alias("out")), step, lambda a: a.out)


def sqnr(original: Column, restored: Column) -> Column:
    """Signal to noise ratio in dB; infinite where the noise is under 1e-12."""

    def add(a, p):
        x, y = p["x"], p["y"]
        return F.struct((a.s + (x * x).cast("double")).alias("s"), (a.e + ((x - y) * (x - y)).cast("double")).alias("e"))

    ratio = lambda a: F.when(a.e < 1e-12, float("inf")).otherwise(10.0 * F.log10(a.s / F.nullif(a.e, F.lit(0.0))))
    return F.aggregate(F.arrays_zip(original.alias("x"), restored.alias("y")), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("e")), add, ratio)


def waveform(signals: DataFrame, delta: float, alpha: float) -> DataFrame:
    """signals (signal) with dm, dpcm, both SQNR, the largest DM error and its flags."""
    s = signals.withColumn("dm", dm_staircase(F.col("signal"), delta)).withColumn("dpcm", dpcm(F.col("signal"), alpha))
    err = F.array_max(F.zip_with("signal", "dm", lambda x, y: F.abs(x - y)))
    s = s.withColumns({"dm_sqnr": sqnr(F.col("signal"), F.col("dm")), "dpcm_sqnr": sqnr(F.col("signal"), F.col("dpcm")), "max_error": err.cast("double")})
    return s.withColumns({"within_delta": F.col("max_error") <= delta, "slope_overload": F.col("max_error") > 2 * delta})


def waveform_table(signals: DataFrame, id_col: str = "sig_id") -> DataFrame:
    """One row per sample, values to five places."""
    z = signals.select(id_col, F.posexplode(F.arrays_zip("signal", "dm", "dpcm")).alias("n", "z"))
    return z.select(id_col, "n", *(N.rounded(F.col(f"z.{c}").cast("double"), 5).alias(c) for c in ("signal", "dm", "dpcm")))


def signal_of(samples: DataFrame) -> DataFrame:
    """One signal from rows (n, x)."""
    return samples.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s.x).alias("signal")).select(F.lit(0).alias("sig_id"), "signal")


