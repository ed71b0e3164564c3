"""A k-d partitioning of points: median splits give leaves, leaf boxes prune exact searches.

The tree is a heap of split values, 2^levels doubles; medians are exact (the lower one of an even number). Nodes
of many different points are split by counts of the bits of their values, the others each in one task. A batch
search first finds each query's k-th distance within its own leaf, then offers the rows of a leaf, in the task that
has them, only to the queries that its box comes that near.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import vector
from tessera.session import cut

#: Coordinates are single, distances double precision.
SLACK = 1e-6
LEAF_ROWS = 4096
#: Different points of a node that one task splits further.
TASK_ROWS = 1 << 17
#: Bits of a value that are counted at once.
COUNT_BITS = 16


def _leaves_of(rows: np.ndarray, medians: np.ndarray, levels: int) -> np.ndarray:
    """The heap numbers of the leaves of points, from 2^levels."""
    node = np.ones(len(rows), np.int64)
    for d in range(levels):
        node = node * 2 + (rows[:, d % rows.shape[1]] > medians[node])
    return node


def _with_leaf(points: DataFrame, medians: np.ndarray, levels: int) -> DataFrame:
    @F.arrow_udf("int")
    def leaf(vec: pa.Array) -> pa.Array:
        return pa.array(_leaves_of(vector.matrix(vec), medians, levels), pa.int32())

    return points.withColumn("leaf", leaf(F.col("vec").cast("array<double>")))


def _keys(values: np.ndarray) -> np.ndarray:
    """Integers in the order of doubles."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _values(keys: np.ndarray) -> np.ndarray:
    return (keys ^ ((keys >> 63) & np.int64(2**63 - 1))).view(np.float64)


def _lower_medians(node: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, and the smallest key of each up to which half of its points lie. n: points of each row."""
    order = np.lexsort((key, node))
    node, key, sums = node[order], key[order], np.cumsum(n[order])
    nodes, first, count = np.unique(node, return_index=True, return_counts=True)
    before, through = sums[first] - n[order][first], sums[first + count - 1]
    return nodes, key[np.searchsorted(sums, before + (through - before + 1) // 2)]


def _split(key: Column, node: Column, medians: dict[int, int]) -> Column:
    """The child of a node that a point goes to; a node without a median keeps its points."""
    least = min(medians)
    held = F.array(*[F.lit(medians.get(i)).cast("long") for i in range(least, max(medians) + 1)])
    return node * 2 + F.coalesce(key > F.get(held, (node - least).cast("int")), F.lit(False)).cast("long")


def _middle(rows: DataFrame, key: str) -> dict[int, int]:
    """The lower median of each node, by counts of ever more leading bits. rows: node, n and the key; nodes are few."""
    half = {r["node"]: (r["n"] + 1) // 2 for r in rows.groupBy("node").agg(F.sum("n").alias("n")).collect()}
    least = min(half)
    held = lambda x: F.get(F.array(*[F.lit(x.get(i)).cast("long") for i in range(least, max(half) + 1)]), (F.col("node") - least).cast("int"))
    below, prefix = dict.fromkeys(half, 0), {}
    for shift in range(64 - COUNT_BITS, -1, -COUNT_BITS):
        here = rows if not prefix else rows.where(F.shiftright(key, shift + COUNT_BITS) == held(prefix))
        counts = here.groupBy("node", F.shiftright(key, shift).alias("bits")).agg(F.sum("n").alias("n"))
        order = Window.partitionBy("node").orderBy("bits")
        through = counts.withColumn("through", F.sum("n").over(order) + held(below))
        for r in through.where(F.col("through") >= held(half)).groupBy("node").agg(F.min(F.struct("bits", F.col("through") - F.col("n"))).alias("at")).collect():
            prefix[r["node"]], below[r["node"]] = r["at"]
    return prefix


@dataclass
class KDTreeIndex:
    """Exact search with pruning; an index never built finds nothing."""

    leaf_rows: int = LEAF_ROWS
    points: DataFrame | None = None
    dim: int | None = None
    levels: int = 0
    medians: np.ndarray | None = None
    boxes: list | None = None

    def build(self, points: DataFrame) -> KDTreeIndex:
        """points: (id, vec). ValueError without points or of mixed dimensions; then nothing changes."""
        dim = vector.dimension(points)
        if dim is None:
            raise ValueError("no points")
        levels = max(0, math.ceil(math.log2(points.count() / self.leaf_rows)))
        medians = self._medians(points, dim, levels)
        self.points, self.dim, self.levels, self.medians, self.boxes = _with_leaf(points, medians, levels), dim, levels, medians, None
        return self

    def _medians(self, points: DataFrame, dim: int, levels: int) -> np.ndarray:
        medians, used = np.zeros(1 << levels), min(dim, levels)
        if not levels:
            return medians
        names = [f"k{j}" for j in range(used)]

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = vector.matrix(batch.column(0)).reshape(-1, used)
                yield pa.RecordBatch.from_arrays([pa.array(_keys(np.ascontiguousarray(x))) for x in rows.T], names=names)

        keys = points.select(F.slice(F.col("vec").cast("array<double>"), 1, used).alias("vec")).mapInArrow(keyed, ", ".join(f"{x} long" for x in names))
        rows = cut(keys.groupBy(*names).agg(F.count("*").alias("n"))).withColumn("node", F.lit(1).cast("long"))
        d = 0
        while d < levels and rows.groupBy("node").count().agg(F.max("count")).first()[0] > TASK_ROWS:
            found = _middle(rows, names[d % used])
            medians[list(found)] = _values(np.array(list(found.values()), np.int64))
            rows = rows.withColumn("node", _split(F.col(names[d % used]), F.col("node"), found))
            d += 1

        def below(table: pa.Table) -> pa.Table:
            node, n, *own = (table.column(x).to_numpy() for x in ("node", "n", *names))
            out = [np.zeros((2, 0), np.int64)]
            for level in range(d, levels):
                key = own[level % used]
                nodes, middle = _lower_medians(node, key, n)
                out.append(np.stack([nodes, middle]))
                node = node * 2 + (key > middle[np.searchsorted(nodes, node)])
            return pa.table([pa.array(x) for x in np.concatenate(out, axis=1)], names=["node", "middle"])

        if d < levels:
            found = rows.groupBy("node").applyInArrow(below, "node long, middle long").toPandas()
            medians[found["node"].to_numpy()] = _values(found["middle"].to_numpy(np.int64))
        return medians

    def leaves(self) -> DataFrame:
        """(leaf, n, lo, hi)"""
        lo, hi = (F.array(*[f(F.get("vec", F.lit(j)).cast("double")) for j in range(self.dim)]).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi")))
        return self.points.groupBy("leaf").agg(F.count("*").alias("n"), lo, hi)

    def _boxed(self) -> list:
        """(leaf, n, lo, hi) of each leaf, for searches of one query."""
        if self.boxes is None:
            self.boxes = [tuple(r) for r in self.leaves().collect()]
        return self.boxes

    def insert(self, points: DataFrame) -> KDTreeIndex:
        """New points go to the leaves of the tree as it is; a first insert builds."""
        if self.points is None:
            return self.build(points)
        if vector.dimension(points) != self.dim:
            raise ValueError(f"the index has {self.dim} dimensions")
        self.points, self.boxes = self.points.unionByName(_with_leaf(points, self.medians, self.levels)), None
        return self

    def _reach(self, query: Sequence[float], lo: list[float], hi: list[float]) -> float:
        return math.sqrt(sum(max(a - q, 0.0, q - b) ** 2 for q, a, b in zip(query, lo, hi, strict=True)))

    def _check(self, query: Sequence[float]) -> None:
        if len(query) != self.dim:
            raise ValueError(f"the index has {self.dim} dimensions")

    def _nothing(self, spark) -> DataFrame:  # noqa: ANN001
        return spark.createDataFrame([], "id long, dist double")

    def nearest_neighbors(self, query: Sequence[float], k: int, spark=None) -> DataFrame:  # noqa: ANN001
        if self.points is None:
            return self._nothing(spark)
        self._check(query)
        by = sorted((self._reach(query, lo, hi), n, leaf) for leaf, n, lo, hi in self._boxed())
        radius, held, first = math.inf, 0, []
        for _, n, leaf in by:  # the nearest leaves that hold k points
            first.append(leaf)
            held += n
            if held >= k:
                break
        if k > 0 and held >= k and len(first) < len(by):
            near = vector.knn(self._of(first), query, k).agg(F.max("dist")).first()[0]
            radius = near if near is not None else math.inf
        leaves = [leaf for reach, _, leaf in by if reach <= radius + SLACK]
        return vector.knn(self._of(leaves), query, k)

    def range_search(self, query: Sequence[float], radius: float, spark=None) -> DataFrame:  # noqa: ANN001
        if self.points is None:
            return self._nothing(spark)
        self._check(query)
        leaves = [leaf for leaf, _, lo, hi in self._boxed() if self._reach(query, lo, hi) <= radius + SLACK]
        return vector.within(self._of(leaves), query, radius)

    def _of(self, leaves: list[int]) -> DataFrame:
        return self.points if len(leaves) == len(self._boxed()) else self.points.where(F.col("leaf").isin(leaves))

    def knn_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, id, dist, rank) for a stated set of queries (id, vec), in blocks."""
        spark, schema, found = self.points.sparkSession, "qid long, id long, dist double", None
        if k <= 0:
            return spark.createDataFrame([], f"{schema}, rank long")
        # Rows of a leaf stand together; a leaf of very many rows is several tasks.
        rows = cut(self.points.select(F.col("id").cast("long").alias("id"), "vec", "leaf").repartitionByRange("leaf", "id").sortWithinPartitions("leaf"))
        for ids, vectors in vector._blocks(queries, "id", "vec"):
            if vectors.shape[1] != self.dim:
                raise ValueError(f"the index has {self.dim} dimensions")
            own = _leaves_of(vectors, self.medians, self.levels)
            near = self._ranked(rows.mapInArrow(_offered(vectors, k, np.arange(len(ids)), own=own), schema), k)
            radius = np.full(len(ids), np.inf)
            for r in near.where(F.col("rank") == k).select("qid", "dist").collect():
                radius[r["qid"]] = r["dist"]
            part = rows.mapInArrow(_offered(vectors, k, ids, radius=radius), schema)
            found = part if found is None else found.unionByName(part)
        return self._ranked(found, k) if found is not None else spark.createDataFrame([], f"{schema}, rank long")

    def _ranked(self, rows: DataFrame, k: int) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id")).cast("long")).where(F.col("rank") <= k)


def _offered(vectors: np.ndarray, k: int, qids: np.ndarray, own: np.ndarray | None = None, radius: np.ndarray | None = None):  # noqa: ANN202
    """The k nearest rows of a task for each query: those of its own leaf, or of the leaves whose rows' box comes within its radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = vector.Nearest(vectors, k, radius)
        for batch in batches:
            ids, rows, leaves = batch.column(0).to_numpy(), vector.matrix(batch.column(1)), batch.column(2).to_numpy()
            found, first = np.unique(leaves, return_index=True)
            for leaf, a, b in zip(found.tolist(), first, [*first[1:], len(leaves)], strict=True):
                if own is not None:
                    wanted = np.flatnonzero(own == leaf)
                else:
                    apart = np.maximum(np.maximum(rows[a:b].min(axis=0) - vectors, vectors - rows[a:b].max(axis=0)), 0.0)
                    wanted = np.flatnonzero(~(np.sqrt((apart * apart).sum(axis=1)) > best.bound + SLACK))
                if len(wanted):
                    best.offer(ids[a:b], rows[a:b], wanted)
        yield best.found(qids)

    return run
