"""Exact search over float vectors: k nearest neighbours and radius, by Euclidean distance.

Distances are sums of squares in double precision; ties go to the smaller id; a radius is inclusive. One
query is a column expression (a bounded top-k, no full sort). Many queries are a stated set, taken in
blocks against all rows: each task keeps k rows for each query of a block (``Nearest``), and only those are
shuffled. The other searches of blocks offer it their own rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries sent to the tasks at once (each block reads the points once), and rows compared at once.
QUERY_BLOCK = 8192
ROWS_AT_ONCE = 4096
#: Pairs in one product of matrices, and pairs whose distances are computed together.
PAIRS_AT_ONCE = 1 << 22
DISTANCES_AT_ONCE = 1 << 16


def distance(vector: Column, query: Sequence[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    squares = F.zip_with(vector.cast("array<double>"), q, lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def column_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def dimension(points: DataFrame, vec_col: str = "vec") -> int | None:
    """The common dimension, None without points; ValueError if they differ."""
    r = points.agg(F.min(F.size(vec_col)).alias("a"), F.max(F.size(vec_col)).alias("b")).first()
    if r["a"] != r["b"]:
        raise ValueError(f"points of {r['a']} and of {r['b']} dimensions")
    return r["a"]


def knn(points: DataFrame, query: Sequence[float], k: int, *, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(id, dist) of the k nearest, nearest first."""
    found = points.select(F.col(id_col).alias("id"), distance(F.col(vec_col), query).alias("dist"))
    return found.orderBy("dist", "id").limit(max(0, k))


def within(points: DataFrame, query: Sequence[float], radius: float, *, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(id, dist) of the points at most radius away; none for a negative radius."""
    return points.select(F.col(id_col).alias("id"), distance(F.col(vec_col), query).alias("dist")).where((F.col("dist") <= float(radius)) & F.lit(radius >= 0))


def _blocks(queries: DataFrame, id_col: str, vec_col: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, vectors = [], []
    for r in queries.select(id_col, vec_col).toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids, np.int64), np.array(vectors, np.float64)
            ids, vectors = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(vectors, np.float64)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows; ValueError for others."""
    if not len(column):
        return np.zeros((0, 0))
    sizes = pc.list_value_length(column)
    if column.null_count or pc.min(sizes).as_py() != pc.max(sizes).as_py():
        raise ValueError("points without a vector, or of several dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _pairs(vectors: np.ndarray, rows: np.ndarray, bound: np.ndarray, k: int | None, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the pairs of the mask that can be within a query's bound, and among its k nearest rows if it has none.

    One product of matrices leaves few pairs, with room for its rounding; their distances are computed apart.
    """
    own, other = (vectors * vectors).sum(axis=1), (rows * rows).sum(axis=1)
    near = own[:, None] - 2 * (vectors @ rows.T) + other[None, :]
    if mask is not None:
        near[~mask] = np.inf
    limit = bound * bound
    if k is not None and len(rows) > k and len(free := np.flatnonzero(~np.isfinite(bound))):
        limit[free] = np.partition(near[free], k - 1, axis=1)[:, k - 1]
    hit = ~(near > (limit + 1e-9 * (own + other.max(initial=0)) + 1e-300)[:, None])
    q, r = np.nonzero(hit if mask is None else hit & mask)
    dist = np.empty(len(q))
    for a in range(0, len(q), DISTANCES_AT_ONCE):
        d = rows[r[a : a + DISTANCES_AT_ONCE]] - vectors[q[a : a + DISTANCES_AT_ONCE]]
        dist[a : a + DISTANCES_AT_ONCE] = np.sqrt((d * d).sum(axis=1))
    return q, r, dist


def _steps(n: int, queries: int) -> Iterator[slice]:
    step = max(1, min(ROWS_AT_ONCE, PAIRS_AT_ONCE // max(1, queries)))
    return (slice(a, a + step) for a in range(0, n, step))


class Nearest:
    """The k nearest of the rows offered so far to each query of a block; of one distance the smaller ids."""

    def __init__(self, vectors: np.ndarray, k: int, bound: np.ndarray | None = None):
        """bound: distances beyond which a query looks for nothing."""
        self.vectors, self.k = vectors, k
        self.bound = np.full(len(vectors), np.inf) if bound is None else bound.astype(np.float64)
        self.q, self.ids, self.dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def offer(self, ids: np.ndarray, rows: np.ndarray, own: np.ndarray | None = None, mask: np.ndarray | None = None) -> None:
        """own: numbers of the queries that look at these rows; mask: which of them at which row."""
        vectors = self.vectors if own is None else self.vectors[own]
        for part in _steps(len(rows), len(vectors)):
            q, r, dist = _pairs(vectors, rows[part], self.bound if own is None else self.bound[own], self.k, None if mask is None else mask[:, part])
            if not len(q):
                continue
            q = q if own is None else own[q]
            changed = np.zeros(len(self.vectors), bool)
            changed[q] = True
            old = changed[self.q]
            q, near, dist = np.concatenate([self.q[old], q]), np.concatenate([self.ids[old], ids[part][r]]), np.concatenate([self.dist[old], dist])
            order = np.lexsort((near, dist, q))
            q, near, dist = q[order], near[order], dist[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            last = rank == self.k - 1
            self.bound[q[last]] = np.fmin(self.bound[q[last]], dist[last])
            keep = rank < self.k
            self.q, self.ids, self.dist = (np.concatenate([x[~old], y[keep]]) for x, y in ((self.q, q), (self.ids, near), (self.dist, dist)))

    def found(self, qids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(qids[self.q]), pa.array(self.ids), pa.array(self.dist)], names=["qid", "id", "dist"])


def _near(points: DataFrame, block: tuple[np.ndarray, np.ndarray], id_col: str, vec_col: str, k: int | None, radius: float | None) -> DataFrame:
    """(qid, id, dist): from each task, for each query, the k nearest of its rows or those within the radius."""
    qids, vectors = block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(vectors, k or 0)
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
            if k is not None:
                best.offer(ids, rows)
                continue
            for part in _steps(len(rows), len(qids)):
                q, r, dist = _pairs(vectors, rows[part], np.full(len(qids), radius), None, None)
                at = dist <= radius
                yield pa.RecordBatch.from_arrays([pa.array(qids[q[at]]), pa.array(ids[part][r[at]]), pa.array(dist[at])], names=["qid", "id", "dist"])
        if k is not None:
            yield best.found(qids)

    return points.select(F.col(id_col).cast("long"), F.col(vec_col)).mapInArrow(run, "qid long, id long, dist double")


def knn_batch(points: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(qid, id, dist, rank) of the k nearest points of each query."""
    schema = "qid long, id long, dist double, rank long"
    if k <= 0:
        return points.sparkSession.createDataFrame([], schema)
    found = None
    for block in _blocks(queries, id_col, vec_col):
        near = _near(points, block, id_col, vec_col, k, None)
        found = near if found is None else found.unionByName(near)
    if found is None:
        return points.sparkSession.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def within_batch(points: DataFrame, queries: DataFrame, radius: float, *, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(qid, id, dist) of the points at most radius away from each query."""
    found = points.sparkSession.createDataFrame([], "qid long, id long, dist double")
    if radius >= 0:
        for block in _blocks(queries, id_col, vec_col):
            found = found.unionByName(_near(points, block, id_col, vec_col, None, float(radius)))
    return found


@dataclass
class FlatIndex:
    """Exact search without a structure; searching before ``build`` is an error."""

    points: DataFrame | None = None
    size: int | None = None

    def build(self, points: DataFrame) -> FlatIndex:
        """points: (id, vec). ValueError without points or of mixed dimensions; then nothing changes."""
        n = dimension(points)
        if n is None:
            raise ValueError("no points")
        self.points, self.size = points, n
        return self

    def insert(self, points: DataFrame) -> FlatIndex:
        if self.points is None:
            raise RuntimeError("insert before build")
        if dimension(points) != self.size:
            raise ValueError(f"the index has {self.size} dimensions")
        self.points = self.points.unionByName(points)
        return self

    def _ready(self, query: Sequence[float]) -> DataFrame:
        if self.points is None:
            raise RuntimeError("search before build")
        if len(query) != self.size:
            raise ValueError(f"the index has {self.size} dimensions")
        return self.points

    def nearest_neighbors(self, query: Sequence[float], k: int) -> DataFrame:
        return knn(self._ready(query), query, k)

    def range_search(self, query: Sequence[float], radius: float) -> DataFrame:
        return within(self._ready(query), query, radius).orderBy("dist", "id")
