"""Connected components of a distributed edge list.

Large-star and small-star rounds (every node hands its larger neighbours to its least one, then its smaller ones)
halve the diameter until only stars are left. Nodes with many neighbours only take part in a minimum, which is
combined before the shuffle, and in a join whose skewed side can be split. Every round ends in a table in the
shared folder, so a lost executor costs no more than one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import staged


class UnionFind:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of edges becomes stars: at most one edge per node."""
    for b in batches:
        u, v = b.column(0).to_numpy(), b.column(1).to_numpy()
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        uf = UnionFind(len(nodes))
        for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
            uf.union(x, y)
        root = np.array([uf.find(i) for i in range(len(nodes))], np.int64)
        far = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp (the least node of its component) for every node that has an edge to another one."""
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = staged(e.mapInArrow(_contract, "u bigint, v bigint").distinct(), "stars")
    before = _signature(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        after = _signature(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
