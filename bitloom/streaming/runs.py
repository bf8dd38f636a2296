"""Streams over the driver's tables, run to the end of what is there."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.streaming.keyed import TOKEN_SCHEMA, WAVE_SCHEMA, Dm, code_stream, token_stream

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir, or one of this machine where that is unset and nobody else needs it (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = f"{tempfile.gettempdir()}/bitloom-streams-{os.getpid()}"
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def run_to_end(spark: SparkSession, stream: DataFrame, schema: str, tag: str) -> DataFrame:
    """Run a stream over everything its source has; its output as a table."""
    out, key = shared_folder(spark, tag), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        q = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(schema).parquet(f"{out}/data")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():  # a stream reads folders
        return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return reader.parquet(path)


def dm_of_events(spark: SparkSession, sf_dir: str, delta: float = 0.05) -> DataFrame:
    """Delta modulation of each user's values."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), (F.col("value") / 500).cast("float").cast("double").alias("x"))
    return run_to_end(spark, code_stream(e, Dm(delta)), WAVE_SCHEMA, "stream-dm")


def lz78_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LZ78 tokens of each user's event types; a purchase ends a session."""
    e = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("seq"), F.concat("event_type", F.lit(";")).alias("text"), (F.col("event_type") == "purchase").alias("last"))
    return run_to_end(spark, token_stream(e), TOKEN_SCHEMA, "stream-lz78")
