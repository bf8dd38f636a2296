"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this process has made for intermediate data, in order.
MADE: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and there is only this machine, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    spark.sparkContext.setCheckpointDir(f"{tempfile.gettempdir()}/bitloom-shared-{os.getpid()}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, tag: str, lasting: bool = False) -> str:
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    if not lasting:
        MADE.append(path)
    return path


def clear(spark: SparkSession, since: int = 0) -> None:
    """Delete the intermediate data made since MADE had that length. For when the results that read it are written."""
    while len(MADE) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(MADE.pop())
        for p in (path, path.suffix("-entries")):
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends there, and lost executors cost nothing."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, n_bytes: int | None, each: int) -> int:
    """Shuffle partitions for so many bytes, of which a task that holds its partition should get `each` at most; the session's number at least."""
    return max(shuffle_partitions(spark), -(-(n_bytes or 0) // each))


#: Bits of a filter for each id, bits of a Spark bitmap, and most bits of a filter (32 MB). With more ids it lets more others through, and that is all.
BITS_EACH, BITMAP, MOST_BITS = 16, 1 << 15, 1 << 28


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id (bigint) is one of ids, and a few others: what a join by id has to shuffle of rows. The filter is a bitmap of
    hashed ids, which is broadcast."""
    bits = min(max(BITMAP, 1 << (BITS_EACH * ids.count()).bit_length()), MOST_BITS)
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    bucket, at = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    marks = ids.select(bucket.alias("_bucket"), at.alias("_at")).groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_marks"))
    byte = F.conv(F.hex(F.substring("_marks", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.join(F.broadcast(marks), (bucket == F.col("_bucket")) & marked, "left_semi")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that clashes with none in df, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
