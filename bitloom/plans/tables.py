"""Tables that the queries derive from the driver's Parquet files: blobs, signals, pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 8000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files have fewer splits than there are (kernels work row by row); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One blob per document."""
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return d.select(F.col("doc_id").alias("blob_id"), F.format_string("doc%d.txt", "doc_id").alias("name"), "lang", F.col("text").cast("binary").alias("content"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small blob per benchmark item."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("blob_id"), F.format_string("item%d.txt", "item_id").alias("name"), F.col("text").cast("binary").alias("content"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signal of 64 samples per vector."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sig_id"), F.lit(RATE).alias("sample_rate"), F.col("embedding").alias("signal"))


def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signal per user, in the order of its events."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.col("value") / 500).cast("float").alias("x")))), lambda s: s.x)
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sig_id")).agg(rows.alias("signal"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples (img_id, pos, v) of one 8 x 8 gray picture per vector."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.posexplode("embedding").alias("pos", "x"))
    return e.select("img_id", "pos", F.floor((F.col("x").cast("double") + 1) * 127.5).cast("int").alias("v"))


def shapes(flat: DataFrame) -> DataFrame:
    return flat.select("img_id").distinct().select("img_id", F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(1).alias("channels"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (img_id, pos, r, g, b) from the byte triples of benchmark items."""
    h = F.regexp_extract_all(F.hex(F.col("text").cast("binary")), F.lit("......"), F.lit(0))
    t = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("img_id"), F.posexplode(h).alias("pos", "x"))
    part = lambda k: F.conv(F.substring("x", 2 * k + 1, 2), 16, 10).cast("int")
    return t.select("img_id", "pos", part(0).alias("r"), part(1).alias("g"), part(2).alias("b"))


def rgb_samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same pixels as flat samples (img_id, pos, v) of pictures one pixel high, and their shapes."""
    p = rgb(spark, sf_dir)
    flat = p.select("img_id", (3 * F.col("pos")).alias("at"), F.posexplode(F.array("r", "g", "b")).alias("c", "v")).select("img_id", (F.col("at") + F.col("c")).alias("pos"), "v")
    shapes = p.groupBy("img_id").agg(F.lit(1).alias("h"), F.count(F.lit(1)).cast("int").alias("w"), F.lit(3).alias("channels"))
    return flat, shapes
