"""Proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and get the fractional rank (r - o) / n of their rank r among the
n rows of the source; o, between 0 and 1, is a hash of the source, so that many small sources don't meet in the middle. Sorted by it, every stretch of the whole order holds the sources in the mixture's
proportion, so cutting the order into shards gives each shard the mixture. Law: ``rows`` (counts differ by one at most).

Equal texts form groups, and a group goes to one shard as far as the law allows:

1. A group larger than a shard is cut into pieces of a shard's size and one rest.
2. Pieces of at least a hundredth of a shard (at most 100 a shard, whatever the input) are packed by the driver, the
   largest first, each into the emptiest shard; one that fits nowhere fills the emptiest and its rest goes on.
3. Smaller groups follow the interleaved order of their representatives (the least id); the order is cut in proportion to
   the room that is left, and a group goes where its first row falls.
4. Single rows are interleaved and cut to what every shard lacks. Only if there are too few of them to level the counts
   is the order of step 3 cut by rows instead, which splits one group at each border.

Ranks are global, yet no task sorts a whole source: rows fall into buckets by the leading digits of the hash (or by the
fractional rank), a small table of counts per bucket gives every bucket its offset, and row numbers are taken within
buckets only. A source that holds a third of all rows is spread like any other, and so is a group, by the hash of its rows.

Defined results: null text has no bytes and equals the empty text; null source is a source of its own; rows with the
same id and text are interchangeable; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import staged

SEED = 17
N_SHARDS = 40
#: Rows that one bucket of a rank should hold at most; the number of buckets grows with the rows.
BUCKET_ROWS = 100_000
#: A group of at least one in so many rows of a shard is packed by the driver.
PIECES = 100


def _digits(n_rows: int) -> int:
    digits = 2
    while n_rows > BUCKET_ROWS * 16**digits and digits < 8:
        digits += 1
    return digits


def _numbered(rows: DataFrame, bucket: Column, order: list[str], keys: tuple[str, ...] = (), weight: Column | None = None, name: str = "p") -> DataFrame:
    """rows with name: the weights (rows, without one) before each row in the order (bucket, then order), by itself for
    every value of keys; and name_n, their sum."""
    weight = F.lit(1) if weight is None else weight
    rows = rows.withColumns({"__b": bucket, "__w": weight.cast("long")})
    # one row per bucket: BUCKET_ROWS bounds this table to rows / BUCKET_ROWS, a few hundred at least
    counts = rows.groupBy(*keys, "__b").agg(F.sum("__w").alias("m"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    starts = counts.select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("__b").alias("__bb"),
        F.coalesce(F.sum("m").over(whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("m").over(whole).alias(f"{name}_n"),
    )
    within = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("__b") == F.col("__bb")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = rows.withColumn(name, F.sum("__w").over(within) - F.col("__w")).join(starts, same)
    return out.withColumn(name, F.col(name) + F.col("__before")).drop("__b", "__w", "__bb", "__before", *[f"__{k}" for k in keys])


def interleaved(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """rows (h, source, k, ...) with frac and p: the weights before each row in the interleaved order, and p_n, their sum."""
    digits = _digits(rows.count())
    parts = 16**digits
    ranked = _numbered(rows, F.substring("h", 1, digits), ["h", "text_key", "k"], ("source",), name="r")
    digits_of = F.substring(F.md5(F.concat(F.lit("offset:"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 5)
    offset = (F.conv(digits_of, 16, 10).cast("long") + 0.5) / (1 << 20)
    ranked = ranked.withColumn("frac", (F.col("r") + offset) / F.col("r_n")).drop("r", "r_n")
    return _numbered(ranked, F.least(F.floor(F.col("frac") * parts), F.lit(parts - 1)).cast("long"), ["frac", "source", "h", "text_key", "k"], weight=weight)


def pack(pieces: list[tuple[str, int, int]], room: list[int]) -> list[tuple[str, int, int, int]]:
    """(group, first row, rows) into shards: (group, first row, rows, shard). room is used up."""
    free = [(-r, s) for s, r in enumerate(room)]
    heapq.heapify(free)
    out, todo = [], [(-n, g, at) for g, at, n in pieces]
    heapq.heapify(todo)
    while todo:
        n, g, at = heapq.heappop(todo)
        r, s = heapq.heappop(free)
        put = min(-n, -r)
        out.append((g, at, put, s))
        heapq.heappush(free, (r + put, s))
        if put < -n:
            heapq.heappush(todo, (n + put, g, at + put))
    for r, s in free:
        room[s] = -r
    return out


def _cut(place: Column, room: list[int]) -> Column:
    """The shard in whose room a place falls."""
    out, end = F.lit(len(room) - 1), 0
    for s, r in enumerate(room):
        end += r
        if r:
            out = F.when(place < end, s) if end == r else out.when(place < end, s)
    return out


def interleave(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, text_crc32, shard, slot for each row of docs."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    read = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("text_key"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), name).cast("binary")).alias("h"), F.monotonically_increasing_id().alias("k"),
    )
    # digests, not texts, from here on; written, so that the numbers of rows stay as they are
    rows = staged(read, "shard-rows")
    groups = rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("g"), F.min(F.struct("id", "h", "k", "source")).alias("rep"))
    groups = staged(groups.where("g > 1").select("text_key", "g", "rep.h", "rep.k", "rep.source"), "shard-groups")
    n = rows.count()
    room = [n * (s + 1) // n_shards - n * s // n_shards for s in range(n_shards)]
    least = max(2, -(-n // (n_shards * PIECES)))
    large = [(r.text_key, r.g) for r in groups.where(F.col("g") >= least).select("text_key", "g").collect()]  # PIECES a shard at most
    top = max(1, n // n_shards)
    packed = pack([(t, at, min(top, g - at)) for t, g in large for at in range(0, g, top)], room) if n else []
    spark = docs.sparkSession
    placed = spark.createDataFrame(packed, "text_key string, first long, put long, s int")

    in_large = F.broadcast(placed.select("text_key").distinct())
    of_large = _numbered(rows.join(in_large, "text_key", "left_semi"), F.substring("h", 1, _digits(n)), ["h", "text_key", "k"], ("text_key",))
    near = (of_large.text_key == F.col("t")) & (F.col("p") >= F.col("first")) & (F.col("p") < F.col("first") + F.col("put"))
    out = of_large.join(F.broadcast(placed.withColumnRenamed("text_key", "t")), near).select("id", "source", "size", "text_crc32", "text_key", "h", "k", F.col("s").alias("shard"))

    small = staged(interleaved(groups.where(F.col("g") < least), F.col("g")), "shard-small")
    total, left = small.agg(F.sum("g")).first()[0] or 0, sum(room)
    share = [total * (sum(room[: s + 1])) // left - total * sum(room[:s]) // left for s in range(n_shards)] if left else [0] * n_shards
    home = small.withColumn("shard", _cut(F.col("p"), share))
    took = {r.shard: r.n for r in home.groupBy("shard").agg(F.sum("g").alias("n")).collect()}  # a row a shard
    rest = rows.join(in_large, "text_key", "left_anti")
    of_small = rest.join(home.select("text_key", "g", F.col("p").alias("first"), "shard"), "text_key")
    if any(took.get(s, 0) > room[s] for s in range(n_shards)):
        of_small = _numbered(of_small, F.substring("h", 1, 1), ["h", "text_key", "k"], ("text_key",)).withColumn("shard", _cut(F.col("first") + F.col("p"), share))
        took = dict(enumerate(share))
    out = out.unionByName(of_small.select(*out.columns))
    room = [room[s] - took.get(s, 0) for s in range(n_shards)]
    singles = interleaved(staged(rest.join(groups.select("text_key"), "text_key", "left_anti"), "shard-single"))
    out = staged(out.unionByName(singles.withColumn("shard", _cut(F.col("p"), room)).select(*out.columns)), "shard-out")
    # the slots of a shard: by the hash, so that its sources are mixed
    slots = _numbered(out, F.substring("h", 1, _digits(n)), ["h", "text_key", "k"], ("shard",))
    return slots.select("id", "source", "size", "text_crc32", "shard", F.col("p").cast("long").alias("slot"))


def op5(docs: DataFrame) -> DataFrame:
    return interleave(docs).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


#: The same placement where every group is packed (up to 100 rows a shard) and every piece fits where it is put: groups one by one
#: into the emptiest shard, then single rows in the interleaved order. CRC-32 by its table.
ORACLE = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc_of),
d AS (SELECT doc_id, source, coalesce(text, '') AS body, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size, sha256(coalesce(text, '')) AS t, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
n AS (SELECT count(*) AS n, greatest(1, count(*) // {N_SHARDS}) AS most FROM d),
g AS (SELECT t, count(*) AS g FROM d GROUP BY t HAVING count(*) > 1),
q AS (SELECT row_number() OVER (ORDER BY size DESC, t, start) AS k, * FROM (SELECT t, start, least(most, g - start) AS size FROM (SELECT t, g, most, unnest(range(0, g, most)) AS start FROM g, n))),
r AS (SELECT 0::BIGINT AS k, list_transform(range(0, {N_SHARDS}), lambda s: n * (s + 1) // {N_SHARDS} - n * s // {N_SHARDS}) AS room, -1::BIGINT AS shard FROM n
 UNION ALL SELECT q.k, list_transform(range(0, {N_SHARDS}), lambda s: room[s + 1] - CASE WHEN s = best THEN q.size ELSE 0 END), best FROM (SELECT *, list_position(room, list_max(room)) - 1 AS best FROM r) r JOIN q ON q.k = r.k + 1),
packed AS (SELECT d.*, r.shard FROM (SELECT d.*, row_number() OVER (PARTITION BY t ORDER BY h) - 1 AS pos FROM d JOIN g USING (t)) d JOIN q ON q.t = d.t AND pos >= q.start AND pos < q.start + q.size JOIN r ON r.k = q.k),
ends AS (SELECT list_transform(range(1, {N_SHARDS} + 1), lambda s: list_sum(room[1:s])) AS ends FROM r ORDER BY k DESC LIMIT 1),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, t) - 1 + (('0x' || md5('offset:' || coalesce(source, ''))[1:5])::INTEGER + 0.5::DOUBLE) / 1048576) / count(*) OVER (PARTITION BY source) AS frac FROM d WHERE t NOT IN (SELECT t FROM g)),
single AS (SELECT *, row_number() OVER (ORDER BY frac, source NULLS FIRST, h, t) - 1 AS p FROM ranked),
placed AS (SELECT doc_id, source, body, size, t, h, shard FROM packed UNION ALL SELECT doc_id, source, body, size, t, h, len(list_filter(ends, lambda e: e <= p)) FROM single, ends)
SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, crc_of[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32,
 'rows' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY h, t) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM placed, crc
"""
