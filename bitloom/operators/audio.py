"""Waveform operators on (sig_id, signal ARRAY<FLOAT>).

Short signals go through ordered folds that Catalyst sees; their concatenations grow with the square of the length,
so for long signals use the kernels of ``functions.udfs`` (``encode`` and ``decode`` here), which give the same bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions import names as N
from bitloom.functions.bits import fixed_width
from bitloom.functions.constants import ADM, ADM_MULTIPLIER, ADM_STEP_MAX, ADM_STEP_MIN, DM, DPCM, DPCM_HIGH, DPCM_LOW, PCM
from bitloom.functions.udfs import audio_decoder, audio_encoder


def mono(channels: Column) -> Column:
    """Mean over the channels of array<array<float>>, sample by sample."""
    return F.transform(channels, lambda c: (F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(c)).cast("float"))


def quantize(x: Column, levels: int, low: Column, high: Column) -> Column:
    v = F.least(F.greatest(x.cast("double"), low), high)
    return F.when(high - low == 0, 0).otherwise(F.least(F.lit(levels - 1), (((v - low) / F.nullif(high - low, F.lit(0.0))) * levels).cast("int")))


def reconstruct(index: Column, levels: int, low: Column, high: Column) -> Column:
    return low + (index + 0.5) * ((high - low) / levels)


def downsample(signal: Column, k: int) -> Column:
    return F.filter(signal, lambda x, i: i % k == 0)


def upsample(signal: Column, k: int, length: Column) -> Column:
    long = F.flatten(F.transform(signal, lambda x: F.array_repeat(x, k)))
    return fit(long, length)


def fit(signal: Column, length: Column) -> Column:
    """Cut or filled with zeros to a length."""
    n = length.cast("int")
    return F.concat(F.slice(signal, F.lit(1), F.least(F.size(signal), n)), F.array_repeat(F.lit(0.0).cast("float"), F.greatest(n - F.size(signal), F.lit(0))))


def value_range(signal: Column) -> Column:
    """struct(low, high) of a signal; a constant one is widened, an empty one is (0, 0)."""
    low, high = F.array_min(signal).cast("double"), F.array_max(signal).cast("double")
    flat = low == high
    return F.struct(
        F.coalesce(F.when(flat, low - 1e-6).otherwise(low), F.lit(0.0)).alias("low"), F.coalesce(F.when(flat, high + 1e-6).otherwise(high), F.lit(0.0)).alias("high")
    )


def pcm_indices(signal: Column, bits: int, k: int = 1) -> Column:
    """Level of each kept sample."""
    x = signal if k == 1 else downsample(signal, k)
    # signal and range are bound by arrays of one: named inside the map they would be worked out again for every sample
    ranged = F.transform(F.array(x), lambda y: F.struct(y.alias("y"), value_range(y).alias("r")))
    return F.transform(ranged, lambda b: F.transform(b["y"], lambda v: quantize(v, 1 << bits, b["r"]["low"], b["r"]["high"])))[0]


def pcm_values(indices: Column, bits: int, low: Column, high: Column) -> Column:
    return F.transform(indices, lambda i: reconstruct(i, 1 << bits, low, high).cast("float"))


def index_bits(indices: Column, bits: int) -> Column:
    return F.array_join(F.transform(indices, lambda i: fixed_width(i, bits)), "")


def _clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))


def dm_bits(signal: Column, delta: float) -> Column:
    """Bit string of delta modulation."""

    def step(a, x):
        up = x.cast("double") > a.s
        return F.struct(_clamp(F.when(up, a.s + delta).otherwise(a.s - delta)).alias("s"), F.concat(a.bits, F.when(up, "1").otherwise("0")).alias("bits"))

    return F.aggregate(signal, F.struct(F.lit(0.0).alias("s"), F.lit("").alias("bits")), step, lambda a: a.bits)


def _bit_array(bits: Column) -> Column:
    return F.filter(F.split(bits, ""), lambda c: c != "")


def dm_values(bits: Column, delta: float) -> Column:
    """Staircase of a bit string."""

    def step(a, c):
        s = _clamp(F.when(c == "1", a.s + delta).otherwise(a.s - delta))
        return F.struct(s.alias("s"), F.concat(a.out, F.array(s.cast("float"))).alias("out"))

    return F.aggregate(_bit_array(bits), F.struct(F.lit(0.0).alias("s"), F.array().cast("array<float>").alias("out")), step, lambda a: a.out)


def _adapted(a: Column, up: Column, multiplier: float) -> Column:
    grown, shrunk = F.least(a.d * multiplier, F.lit(ADM_STEP_MAX)), F.greatest(a.d / multiplier, F.lit(ADM_STEP_MIN))
    return F.when(a.prev < 0, a.d).when(a.prev == up, grown).otherwise(shrunk)


def adm_bits(signal: Column, delta: float, multiplier: float = ADM_MULTIPLIER) -> Column:
    start = F.struct(F.lit(0.0).alias("s"), F.lit(float(delta)).alias("d"), F.lit(-1).alias("prev"), F.lit("").alias("bits"))

    def step(a, x):
        up = F.when(x.cast("double") > a.s, 1).otherwise(0)
        d = _adapted(a, up, multiplier)
        return F.struct(_clamp(F.when(up == 1, a.s + a.d).otherwise(a.s - a.d)).alias("s"), d.alias("d"), up.alias("prev"), F.concat(a.bits, up.cast("string")).alias("bits"))

    return F.aggregate(signal, start, step, lambda a: a.bits)


def adm_values(bits: Column, delta: float, multiplier: float = ADM_MULTIPLIER) -> Column:
    start = F.struct(F.lit(0.0).alias("s"), F.lit(float(delta)).alias("d"), F.lit(-1).alias("prev"), F.array().cast("array<float>").alias("out"))

    def step(a, c):
        up = c.cast("int")
        d = _adapted(a, up, multiplier)
        s = _clamp(F.when(up == 1, a.s + a.d).otherwise(a.s - a.d))
        return F.struct(s.alias("s"), d.alias("d"), up.alias("prev"), F.concat(a.out, F.array(s.cast("float"))).alias("out"))

    return F.aggregate(_bit_array(bits), start, step, lambda a: a.out)


def _dpcm_next(x_rec: Column, k: Column, bits: int, alpha: float) -> Column:
    return _clamp(F.lit(alpha) * x_rec + reconstruct(k, 1 << bits, F.lit(DPCM_LOW), F.lit(DPCM_HIGH)))


def dpcm_codes(signal: Column, bits: int, alpha: float) -> Column:
    """Level of each residual."""

    def step(a, x):
        k = quantize(x.cast("double") - F.lit(alpha) * a.x, 1 << bits, F.lit(DPCM_LOW), F.lit(DPCM_HIGH))
        return F.struct(_dpcm_next(a.x, k, bits, alpha).alias("x"), F.concat(a.out, F.array(k)).alias("out"))

    return F.aggregate(signal, F.struct(F.lit(0.0).alias("x"), F.array().cast("array<int>").alias("out")), step, lambda a: a.out)


def dpcm_values(codes: Column, bits: int, alpha: float) -> Column:
    def step(a, k):
        x = _dpcm_next(a.x, k, bits, alpha)
        return F.struct(x.alias("x"), F.concat(a.out, F.array(x.cast("float"))).alias("out"))

    return F.aggregate(codes, F.struct(F.lit(0.0).alias("x"), F.array().cast("array<float>").alias("out")), step, lambda a: a.out)


def sqnr(original: Column, restored: Column) -> Column:
    """Signal to noise ratio in dB over the samples that both have: 0 without any, infinite without noise, 0 without signal."""

    def add(a, p):
        x, y = p["x"].cast("double"), p["y"].cast("double")
        both = x.isNotNull() & y.isNotNull()  # the shorter array is filled with nulls
        return F.struct((a.n + both.cast("int")).alias("n"), (a.s + F.when(both, x * x).otherwise(0.0)).alias("s"), (a.e + F.when(both, (x - y) * (x - y)).otherwise(0.0)).alias("e"))

    def ratio(a):
        return F.when(a.n == 0, 0.0).when(a.e == 0, float("inf")).when(a.s == 0, 0.0).otherwise(10.0 * F.log10(a.s / F.nullif(a.e, F.lit(0.0))))

    # one fold, so that neither array is worked out twice
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("e"))
    return F.aggregate(F.arrays_zip(original.alias("x"), restored.alias("y")), start, add, ratio)


def theoretical_sqnr(bits: Column) -> Column:
    return 6.02 * bits + 1.76


def against_theory(algorithm: Column, bits: Column, measured: Column) -> Column:
    """dB over the theory of uniform PCM; null for other codecs and without noise."""
    return F.when((algorithm == PCM) & (measured != float("inf")), measured - theoretical_sqnr(bits))


def panel(report: DataFrame) -> DataFrame:
    """The audio panel as text, from sig_id, algorithm_id, bits, sqnr, n_samples, original_bytes and payload_bytes."""
    q, theory = F.col("sqnr"), F.col("algorithm_id").isin(PCM, DPCM)
    size = N.ratio(F.col("original_bytes"), F.col("payload_bytes"))
    lossless, expected = q == float("inf"), theoretical_sqnr(F.col("bits"))
    return report.select(
        "sig_id", F.when(lossless, "∞ (Lossless)").otherwise(N.fixed(q, 2, "%.{n}f dB")).alias("sqnr"), F.concat(F.lit("Quality: "), N.sqnr_label(q)).alias("quality"),
        F.when(theory, N.fixed(expected, 2, "%.{n}f dB")).otherwise("N/A (DM / ADM)").alias("theory"),
        F.when(theory, F.when(lossless, "N/A").otherwise(N.fixed(q - expected, 2, "%+.{n}f dB vs theory"))).alias("against_theory"),
        size["ratio"].alias("ratio"), F.concat(size["savings"], F.lit(" saved")).alias("savings"), N.sqnr_band(q).alias("band"), F.col("n_samples").cast("long").alias("n_samples"),
    )


def encode(signals: DataFrame, algorithm: int, **params) -> DataFrame:
    """signals with payload, padding_bits and error."""
    out = signals.withColumn("e", audio_encoder(algorithm, **params)("signal"))
    return out.select(*signals.columns, "e.payload", "e.padding_bits", "e.error")


def decode(payloads: DataFrame, algorithm: int, length_col: str = "original_length", **params) -> DataFrame:
    kept = [c for c in payloads.columns if c != "error"]
    out = payloads.withColumn("d", audio_decoder(algorithm, **params)("payload", "padding_bits", length_col))
    return out.select(*kept, F.col("d.signal").alias("restored"), "d.error")


CODECS = (PCM, DM, ADM, DPCM)
