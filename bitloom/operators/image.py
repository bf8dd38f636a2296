"""Picture operators. A picture is a row (h, w, channels, pixels BINARY), or rows (img_id, pos, v) of flat samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.functions import names as N
from bitloom.functions.bits import big_endian, byte_list, unsigned
from bitloom.functions.constants import MAX_RUN
from bitloom.functions.udfs import rgb_pixels


def luma(r: Column, g: Column, b: Column) -> Column:
    """Gray value in 32-bit arithmetic, cut to a whole number."""
    f = lambda x: x.cast("float")
    c = lambda x: F.lit(x).cast("float")
    y = c(0.299) * f(r) + c(0.587) * f(g) + c(0.114) * f(b)
    return F.floor(F.least(F.greatest(y, c(0.0)), c(255.0))).cast("int")


def luma_exact(r: Column, g: Column, b: Column) -> Column:
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


def quantize(v: Column, bits: int) -> Column:
    shift = 8 - min(8, max(1, bits))
    return F.shiftleft(F.shiftright(v.cast("int"), shift), shift)


def position(r: Column, c: Column, ch: Column, width: Column, channels: Column) -> Column:
    return (r * width + c) * channels + ch


def samples(pictures: DataFrame) -> DataFrame:
    """(img_id, pos, v) of pictures."""
    return pictures.select("img_id", F.posexplode(byte_list(F.col("pixels"))).alias("pos", "x")).select("img_id", "pos", F.conv("x", 16, 10).cast("int").alias("v"))


def runs(flat: DataFrame, keys: list[str], order: str = "pos", value: str = "v", most: int | None = MAX_RUN) -> DataFrame:
    """Runs of equal samples: keys, run (from 0), v, n; longer ones are cut at ``most``."""
    w = Window.partitionBy(*keys).orderBy(order)
    fresh = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    numbered = flat.withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(w))
    out = numbered.groupBy(*keys, "__run").agg(F.first(value).alias("v"), F.count(F.lit(1)).alias("n"))
    if most is None:
        return out.select(*keys, (F.col("__run") - 1).alias("run"), "v", "n")
    cut = out.select(*keys, "__run", "v", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most))).alias("k"))
    cut = cut.select(*keys, "__run", "k", "v", F.least(F.lit(most), F.col("n") - F.col("k") * most).alias("n"))
    return cut.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("__run", "k")) - 1).cast("long").alias("run"), "v", "n")


def rle_block(run_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Run-length block on the wire: keys, block, n_runs, total."""
    g = run_rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("run", "v", "n"))).alias("r"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_runs"))
    body = F.array_join(F.transform("r", lambda x: F.concat(F.lpad(F.hex(x.v.cast("long")), 2, "0"), F.lpad(F.hex(x.n.cast("long")), 4, "0"))), "")
    return g.select(*keys, F.concat(big_endian(F.col("total"), 4), big_endian(F.col("n_runs"), 4), F.lit(b"\x00"), F.unhex(body)).alias("block"), "n_runs", "total")


def encode(flat: DataFrame, shapes: DataFrame, bits: int = 8) -> DataFrame:
    """Payload of pictures from samples (img_id, pos, v) and shapes (img_id, h, w, channels)."""
    bits = min(8, max(1, bits))
    block = rle_block(runs(flat.select("img_id", "pos", quantize(F.col("v"), bits).alias("v")), ["img_id"]), ["img_id"])
    meta = F.concat(big_endian(F.col("h"), 4), big_endian(F.col("w"), 4), big_endian(F.col("channels"), 1), F.lit(bytes([bits])))
    empty = F.lit(bytes(9))
    return shapes.join(block, "img_id", "left").select("img_id", F.concat(meta, F.coalesce("block", empty)).alias("payload"), F.lit(0).alias("padding_bits"))


def decode(payloads: DataFrame, most: int = 1 << 24) -> DataFrame:
    """(img_id, h, w, channels, v ARRAY, error) from (img_id, payload): runs repeated, cut or filled with zeros to the total."""
    p = F.col("payload")
    info = get_info(p)
    body = F.regexp_extract_all(F.hex(F.substring(p, F.lit(20), F.octet_length(p))), F.lit("......"), F.lit(0))
    seen = F.slice(body, F.lit(1), F.least(F.size(body), info["n_runs"].cast("int")))
    value = lambda x: F.conv(F.substring(x, 1, 2), 16, 10).cast("int")
    count = lambda x: F.conv(F.substring(x, 3, 4), 16, 10).cast("int")
    flat = F.flatten(F.transform(seen, lambda x: F.array_repeat(value(x), count(x))))
    need = (info["height"] * info["width"] * info["channels"]).cast("int")
    total = info["total_pixels"].cast("int")
    problem = (
        F.when(F.octet_length(p) < 10, "payload").when(F.octet_length(p) < 19, "block").when(~info["channels"].isin(1, 3), "channels")
        .when((info["total_pixels"] > most) | (info["height"] * info["width"] > most), "size").when(total < need, "pixels")
    )
    read = payloads.select("img_id", info.alias("i"), problem.alias("error"), F.when(problem.isNull(), flat).alias("f"), need.alias("need"))
    full = F.slice(F.concat("f", F.array_repeat(F.lit(0), F.greatest(F.col("need") - F.size("f"), F.lit(0)))), F.lit(1), F.col("need"))
    return read.select("img_id", F.col("i.height").alias("h"), F.col("i.width").alias("w"), F.col("i.channels").alias("channels"), F.when(F.col("error").isNull(), full).alias("v"), "error")


def get_info(payload: Column) -> Column:
    """Header of a payload, no pixels read: null if too short; what is missing is told from the rest."""
    h, w, c, q = unsigned(payload, 0, 4), unsigned(payload, 4, 4), unsigned(payload, 8, 1), unsigned(payload, 9, 1)
    return F.when(
        F.octet_length(payload) >= 10,
        F.struct(
            h.alias("height"), w.alias("width"), c.alias("channels"), q.alias("quantize_bits"),
            F.coalesce(unsigned(payload, 10, 4), h * w * c).alias("total_pixels"), F.coalesce(unsigned(payload, 14, 4), F.lit(0).cast("long")).alias("n_runs"),
        ),
    )


def errors(original: DataFrame, restored: DataFrame, payload_bytes: DataFrame) -> DataFrame:
    """img_id, mse, psnr, psnr_str, compression_ratio, n_pixels, is_lossless from samples (img_id, pos, v) of both and (img_id, payload_bytes, raw_bytes)."""
    both = original.join(restored.select("img_id", "pos", F.col("v").alias("u")), ["img_id", "pos"])
    d = F.col("v").cast("double") - F.col("u").cast("double")
    m = both.groupBy("img_id").agg((F.sum(d * d) / F.count(F.lit(1))).alias("mse"), F.count(F.lit(1)).alias("n_pixels"))
    psnr = F.when(F.col("mse") > 0, 10.0 * F.log10(F.lit(65025.0) / F.col("mse")))
    out = m.join(payload_bytes, "img_id").withColumn("psnr", psnr)
    return out.select(
        "img_id", "mse", "psnr", F.coalesce(N.fixed(F.col("psnr"), 4, "%.{n}f dB"), F.lit("Infinity")).alias("psnr_str"),
        F.when((F.col("raw_bytes") > 0) & (F.col("payload_bytes") > 0), F.col("payload_bytes") / F.col("raw_bytes")).otherwise(0.0).alias("compression_ratio"),
        "n_pixels", (F.col("mse") == 0).alias("is_lossless"),
    ).withColumn("psnr_str", F.when(F.col("mse") > 0, F.col("psnr_str")).otherwise("Infinity"))


def upscale(flat: DataFrame, width: int, scale: int) -> DataFrame:
    """Every sample of a one-channel picture as a square of scale x scale."""
    s = F.sequence(F.lit(0), F.lit(scale - 1))
    r, c = F.floor(F.col("pos") / width), F.col("pos") % width
    out = flat.select("img_id", r.alias("r"), c.alias("c"), "v", F.explode(s).alias("i")).select("*", F.explode(s).alias("j"))
    return out.select("img_id", ((F.col("r") * scale + F.col("i")) * (width * scale) + F.col("c") * scale + F.col("j")).cast("long").alias("pos"), "v")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pictures of any format the JVM reads, as (origin, h, w, channels, pixels, error) with channels in the order R, G, B.
    Files that can't be read have null pixels and an error."""
    i = spark.read.format("image").load(path).select("image.*").withColumn("p", rgb_pixels("data", "height", "width", "nChannels"))
    good = F.col("p.error").isNull() & F.col("p.pixels").isNotNull()
    shape = lambda c: F.when(good, c)
    return i.select(
        "origin", shape(F.col("height")).alias("h"), shape(F.col("width")).alias("w"), shape(F.lit(3)).alias("channels"), F.col("p.pixels").alias("pixels"),
        F.when(~good, F.coalesce("p.error", F.lit("no picture"))).alias("error"),
    )
