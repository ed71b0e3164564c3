"""Connected components of a distributed edge list, by hooking and pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): component is the smallest node reachable. Nulls are ignored.

    Each node points at a smaller one. In each round a node, and what it points at, move to the smallest
    that its neighbours' pointers point at, and pointers are followed once more; so distances double, and
    a chain of n nodes takes about log n rounds. Neighbours are pre-aggregated by map tasks, so that a node
    of many edges is no hot key. Each round is stored in the shared folder.
    """
    pairs = edges.where("a <> b")
    both = cut(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    pointers = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("to")))
    total = None
    while True:
        now = pointers.agg(F.sum(F.col("to").cast("decimal(38,0)"))).first()[0]
        if now == total:  # pointers only fall, so their sum stands still when they do
            return pointers.select(F.col("u").alias("node"), F.col("to").alias("component"))
        total = now
        mid = pointers.select(F.col("u").alias("mid"), F.col("to").alias("far"))
        doubled = pointers.join(mid, F.col("to") == F.col("mid")).select("u", "to", "far")
        seen = doubled.select(F.col("u").alias("v"), F.col("far").alias("near"))
        best = both.join(seen, "v").groupBy("u").agg(F.min("near").alias("best"))
        moved = doubled.join(best, "u").select(F.explode(F.array(F.struct("u", F.least("to", "far", "best").alias("to")), F.struct(F.col("to").alias("u"), F.col("best").alias("to")))).alias("x"))
        pointers = cut(moved.groupBy("x.u").agg(F.min("x.to").alias("to")))
