"""Exact deduplication over a keyed streaming state on disk.

Each row becomes an entry (digest, stable id, content locator). The entries are read as a stream and
aggregated by digest in RocksDB state without watermark or expiry, so a later run with the same
``state_dir`` meets the digests of all earlier ones. A digest is only a hint: wherever it was met more
than once the full bytes are compared with those of the row the state points to, and rows that differ in
spite of one digest fall into groups of their own.

A ``state_dir`` of the caller's has two folders beside it: ``-entries``, the stream's source, and ``-texts``, to which
each run adds its distinct texts (digest, text, largest id, number); the locator of its entries is that part. A digest
that an earlier run met is looked up there and compared in full, so every row of a run gets its row, with keep_id and
group_size over all runs. A row stays if its id is larger than those of all earlier rows of its text; what earlier runs
gave out is not taken back.

Defined results: a null text counts as empty; the empty text is a text like any other; of rows with one
text the largest id stays and, if that id occurs more than once, exactly one of those rows; an empty
table gives an empty result; columns of the input with clashing names are left alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.llm.common import fresh, shared_path, staged

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    # else every partition of the state takes megabytes of disk in advance
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


#: Groups of more than one row in so many are broadcast: their number can't be larger.
HOT_GROUPS = 10_000


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _entries(docs: DataFrame, id_col: str, text_col: str, part: str | None = None) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the locator tells rows of one id apart: file and row, as they are read here
    own = F.concat(F.substring_index(F.input_file_name(), "/", -1), F.lit("#"), F.monotonically_increasing_id().cast("string"))
    return docs.select(F.col(id_col).alias("id"), _digest(text).alias("digest"), (own if part is None else F.lit(part)).alias("locator"))


def update_state(entries: DataFrame, state_dir: str) -> DataFrame:
    """Feed entries (id, digest, locator) to the state in state_dir; one row for each digest that they hold:
    digest, keep_id, keep_locator, n (over everything the state has seen)."""
    spark: SparkSession = entries.sparkSession
    # a stream goes on only over the folder that it began with
    staging, out = f"{state_dir.rstrip('/')}-entries", shared_path(spark, "dedup-seen")
    entries.write.mode("append").parquet(staging)
    before = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        seen = (
            spark.readStream.schema(entries.schema).parquet(staging)
            .groupBy("digest")
            .agg(F.max(F.struct("id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n"))
        )
        query = (
            seen.writeStream.outputMode("update")
            .option("checkpointLocation", state_dir)
            .foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "digest string, keep struct<id: %s, locator: string>, n bigint" % entries.schema["id"].dataType.simpleString()
    if not _exists(spark, out):
        return spark.createDataFrame([], schema).select("digest", F.col("keep.id").alias("keep_id"), F.col("keep.locator").alias("keep_locator"), "n")
    # one run has one batch as all of its entries were there when it began
    return spark.read.schema(schema).parquet(out).select("digest", F.col("keep.id").alias("keep_id"), F.col("keep.locator").alias("keep_locator"), "n")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None) -> DataFrame:
    """One row per row of docs: id, digest, keep_id, group_size, kept."""
    if state_dir:
        return _groups_over_runs(docs, id_col, text_col, state_dir.rstrip("/"))
    spark = docs.sparkSession
    state_dir = shared_path(spark, "dedup-state")
    state = update_state(_entries(docs, id_col, text_col), state_dir)
    entries = spark.read.parquet(f"{state_dir}-entries")
    rows = docs.select(F.col(id_col).alias("id"), _digest(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # full bytes: equal texts become one row in their own task before anything is exchanged, so no group meets in one place
    texts = rows.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    collided = staged(texts.where("texts > 1").select("digest"), "dedup-collided")
    plain = entries.join(collided, "digest", "left_anti")
    # a group of more than one row in HOT_GROUPS: there are at most so many of those, and they are broadcast
    least = (state.agg(F.sum("n")).first()[0] or 0) // HOT_GROUPS
    hot = state.where(F.col("n") > least).select(F.col("digest").alias("hot"), F.col("keep_id").alias("hot_id"), F.col("keep_locator").alias("hot_locator"), F.col("n").alias("hot_n"))
    marked = plain.join(F.broadcast(hot), F.col("digest") == F.col("hot"), "left")
    in_hot = marked.where("hot is not null").select("id", "digest", "locator", F.col("hot_id").alias("keep_id"), F.col("hot_locator").alias("keep_locator"), F.col("hot_n").alias("n"))
    others = marked.where("hot is null").select("id", "digest", "locator").join(state.where(F.col("n") <= least), "digest")
    found = in_hot.unionByName(others.select(*in_hot.columns))
    # one digest, several texts: the text joins the key
    odd = staged(rows.join(collided, "digest", "left_semi").withColumn("locator", F.monotonically_increasing_id().cast("string")), "dedup-odd")
    sizes = odd.groupBy("digest", "text").agg(F.max(F.struct("id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n"))
    odd = odd.join(sizes, ["digest", "text"]).select("id", "digest", "locator", F.col("keep.id").alias("keep_id"), F.col("keep.locator").alias("keep_locator"), "n")
    return found.unionByName(odd).select("id", "digest", "keep_id", F.col("n").alias("group_size"), (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("locator") == F.col("keep_locator"))).alias("kept"))


def _groups_over_runs(docs: DataFrame, id_col: str, text_col: str, state_dir: str) -> DataFrame:
    spark = docs.sparkSession
    earlier = _parts(spark, f"{state_dir}-texts")
    part = f"{state_dir}-texts/part-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), _digest(text).alias("digest"), text.alias("text"))
    rows.groupBy("digest", "text").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n")).write.parquet(part)
    now = spark.read.parquet(part)
    state = update_state(_entries(docs, id_col, text_col, part), state_dir)
    met = state.where("n > 1").select("digest")
    past = spark.read.schema(now.schema).parquet(*earlier) if earlier else now.where("false")
    both = now.withColumn("old", F.lit(False)).unionByName(past.join(met, "digest", "left_semi").withColumn("old", F.lit(True)))
    # the text is part of the key: a group has equal bytes, not only equal digests
    sizes = both.groupBy("digest", "text").agg(
        F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.max("old").alias("met"), F.max(F.when(F.col("old"), F.col("id"))).alias("old_id")
    )
    first = F.row_number().over(Window.partitionBy("digest", "text", "id").orderBy(F.lit(1)))
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & ~(F.col("met") & F.col("old_id").eqNullSafe(F.col("keep_id"))) & (first == 1)
    return rows.join(sizes, ["digest", "text"]).select("id", "digest", "keep_id", "group_size", stays.alias("kept"))


def _parts(spark: SparkSession, path: str) -> list[str]:
    """Finished parts of earlier runs."""
    if not _exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = [x.getPath().toString() for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(x for x in found if _exists(spark, f"{x}/_SUCCESS"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    key, digest = fresh(docs, "key"), fresh(docs, "digest")
    name = lambda c: F.coalesce(F.concat(F.lit("i"), F.col(c).cast("string")), F.lit(""))
    kept = groups(docs, id_col, text_col, state_dir).where("kept").select(name("id").alias(key), F.col("digest").alias(digest))
    names = docs.columns
    marked = docs.withColumns({key: name(id_col), digest: _digest(F.coalesce(F.col(text_col), F.lit("")))})
    # rows of one id and text are the same to this operator: one of them stays; join and choice share one exchange
    return marked.join(kept, [key, digest], "left_semi").dropDuplicates([key, digest]).select(*names)


def op10(docs: DataFrame) -> DataFrame:
    return groups(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
