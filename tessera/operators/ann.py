"""Approximate nearest neighbours: inverted file, product quantisation, navigable graphs, random projections.

Training takes a bounded sample of rows (``TRAIN_ROWS``, those of the smallest hashes of their ids); every
row is indexed. Centroids, codebooks and queries are small and travel in closures; codes and graphs stay
with the rows. Indexes are built once, searched as often as wanted, and can be saved and loaded.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import vector
from tessera.session import cut

TRAIN_ROWS = 20_000


def training_sample(points: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    found = points.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(rows).collect()
    return np.array([r["vec"] for r in found], np.float64)


def kmeans(rows: np.ndarray, k: int, *, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds from a random choice of rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(rows))
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(axis=1)[None, :]


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.int64)
    for a in range(0, len(rows), 4096):
        out[a : a + 4096] = squared(rows[a : a + 4096], centres).argmin(axis=1)
    return out


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id")).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _rows(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return vector.matrix(batch.column(i))


@dataclass
class IVFIndex:
    """Lists of the points nearest to each centroid; searches read the nearest few lists."""

    centres: np.ndarray
    points: DataFrame

    @staticmethod
    def build(points: DataFrame, nlist: int = 100) -> IVFIndex:
        centres = kmeans(training_sample(points), nlist)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = nearest(_rows(batch, 1), centres) if batch.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.int64())], names=["id", "vec", "list"])

        return IVFIndex(centres, points.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(assign, "id long, vec array<float>, list long"))

    def save(self, path: str) -> None:
        """Points in a folder for each list, so that a search's lists are known, and the centroids."""
        self.points.write.mode("overwrite").partitionBy("list").parquet(f"{path}/points")
        _save_arrays(self.points.sparkSession, f"{path}/centres", [self.centres])

    @staticmethod
    def load(spark: SparkSession, path: str) -> IVFIndex:
        return IVFIndex(_load_arrays(spark, f"{path}/centres")[0], spark.read.parquet(f"{path}/points").withColumn("list", F.col("list").cast("long")))

    def search(self, queries: DataFrame, k: int, nprobe: int = 8) -> DataFrame:
        """(qid, id, dist, rank): each task offers the rows of a list to the queries that probe it."""
        found, nlist = None, len(self.centres)
        for ids, vectors in vector._blocks(queries, "id", "vec"):
            probes = np.zeros((len(ids), nlist), bool)
            np.put_along_axis(probes, np.argsort(squared(vectors, self.centres), axis=1)[:, :nprobe], True, axis=1)

            def near(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, vectors: np.ndarray = vectors, probes: np.ndarray = probes) -> Iterator[pa.RecordBatch]:
                best = vector.Nearest(vectors, k)
                for batch in batches:
                    own, rows, lists = batch.column(0).to_numpy(), _rows(batch, 1), batch.column(2).to_numpy()
                    for c in np.unique(lists):
                        best.offer(own[lists == c], rows[lists == c], np.flatnonzero(probes[:, c]))
                yield best.found(ids)

            part = self.points.select("id", "vec", "list").mapInArrow(near, "qid long, id long, dist double")
            found = part if found is None else found.unionByName(part)
        return _found(self.points.sparkSession, found, k)


@dataclass
class PQIndex:
    """m codes of a byte for each point; distances are sums of table entries, the best are computed exactly."""

    books: list[np.ndarray]
    points: DataFrame

    @staticmethod
    def build(points: DataFrame, m: int = 16, bits: int = 8) -> PQIndex:
        parts = np.array_split(training_sample(points), m, axis=1)
        books = [kmeans(p, 1 << bits) for p in parts]

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = np.stack([nearest(p, b) for p, b in zip(np.array_split(_rows(batch, 1), m, axis=1), books, strict=True)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "vec", "code"])

        return PQIndex(books, points.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(code, "id long, vec array<float>, code binary"))

    def save(self, path: str) -> None:
        self.points.write.mode("overwrite").parquet(f"{path}/points")
        _save_arrays(self.points.sparkSession, f"{path}/books", self.books)

    @staticmethod
    def load(spark: SparkSession, path: str) -> PQIndex:
        return PQIndex(_load_arrays(spark, f"{path}/books"), spark.read.parquet(f"{path}/points"))

    def search(self, queries: DataFrame, k: int, rerank: int = 20) -> DataFrame:
        """(qid, id, dist, rank): the rerank * k best by codes, ranked by exact distance."""
        found, books, m = None, self.books, len(self.books)
        for ids, vectors in vector._blocks(queries, "id", "vec"):

            def near(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, vectors: np.ndarray = vectors) -> Iterator[pa.RecordBatch]:
                tables = [squared(p, b) for p, b in zip(np.array_split(vectors, m, axis=1), books, strict=True)]
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, m)
                    rows, own = _rows(batch, 1), batch.column(0).to_numpy()
                    for j, qid in enumerate(ids):
                        d = sum(tables[i][j][codes[:, i]] for i in range(m))
                        at = np.argpartition(d, min(rerank * k, len(d)) - 1)[: rerank * k]
                        exact = np.sqrt(((rows[at] - vectors[j]) ** 2).sum(axis=1))
                        at, exact = at[np.argsort(exact)[:k]], np.sort(exact)[:k]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), qid)), pa.array(own[at]), pa.array(exact)], names=["qid", "id", "dist"])

            part = self.points.mapInArrow(near, "qid long, id long, dist double")
            found = part if found is None else found.unionByName(part)
        return _found(self.points.sparkSession, found, k)


class Graph:
    """A hierarchical navigable small-world graph over rows held in memory."""

    def __init__(self, rows: np.ndarray, m: int = 32, ef: int = 40, seed: int = 5):
        self.rows, self.m, self.ef = rows, m, ef
        rng = np.random.default_rng(seed)
        self.heights = np.minimum((-np.log(np.maximum(rng.random(len(rows)), 1e-12)) / np.log(m)).astype(int), 8)
        self.layers: list[dict[int, list[int]]] = [{} for _ in range(int(self.heights.max(initial=0)) + 1)]
        self.entry = -1
        for i in range(len(rows)):
            self._add(i)

    @staticmethod
    def restored(rows: np.ndarray, held: bytes) -> Graph:
        graph = Graph.__new__(Graph)
        graph.rows = rows
        graph.heights, graph.layers, graph.entry, graph.m, graph.ef = pickle.loads(held)
        return graph

    def _far(self, q: np.ndarray, at: list[int]) -> np.ndarray:
        d = self.rows[at] - q
        return (d * d).sum(axis=1)

    def _walk(self, q: np.ndarray, start: list[int], layer: int, ef: int) -> list[tuple[float, int]]:
        """The ef nearest of what a best-first walk from the start reaches."""
        links, seen = self.layers[layer], set(start)
        d = self._far(q, start).tolist()
        open_, best = list(zip(d, start, strict=True)), [(-x, i) for x, i in zip(d, start, strict=True)]
        heapq.heapify(open_)
        heapq.heapify(best)
        while open_:
            x, i = heapq.heappop(open_)
            if len(best) >= ef and x > -best[0][0]:
                break
            new = [j for j in links[i] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for y, j in zip(self._far(q, new).tolist(), new, strict=True):
                if len(best) < ef or y < -best[0][0]:
                    heapq.heappush(open_, (y, j))
                    heapq.heappush(best, (-y, j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-x, i) for x, i in best)

    def _add(self, i: int) -> None:
        q, height = self.rows[i], int(self.heights[i])
        if self.entry < 0:
            self.entry = i
            for layer in range(height + 1):
                self.layers[layer][i] = []
            return
        top, start = int(self.heights[self.entry]), [self.entry]
        for layer in range(top, height, -1):
            start = [self._walk(q, start, layer, 1)[0][1]]
        for layer in range(min(top, height), -1, -1):
            found = self._walk(q, start, layer, self.ef)
            own = [j for _, j in found[: self.m]]
            self.layers[layer][i] = own
            for j in own:
                links = self.layers[layer][j]
                links.append(i)
                if len(links) > 2 * self.m:
                    order = np.argsort(self._far(self.rows[j], links), kind="stable")[: self.m]
                    self.layers[layer][j] = [links[t] for t in order]
            start = [j for _, j in found]
        for layer in range(top + 1, height + 1):
            self.layers[layer][i] = []
        if height > top:
            self.entry = i

    def search(self, q: np.ndarray, k: int, ef: int = 20) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        start = [self.entry]
        for layer in range(int(self.heights[self.entry]), 0, -1):
            start = [self._walk(q, start, layer, 1)[0][1]]
        return self._walk(q, start, 0, max(ef, k))[:k]


@dataclass
class HNSWIndex:
    """A graph for each shard of rows, built once and stored: (shard, ids, vectors, graph), a row for each shard."""

    shards: DataFrame
    dim: int | None

    @staticmethod
    def build(points: DataFrame, *, m: int = 32, ef_build: int = 40, shard_rows: int = 20_000) -> HNSWIndex:
        dim = vector.dimension(points)
        n = max(1, points.count() // shard_rows)

        def link(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            rows = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            graph = Graph(rows, m, ef_build)
            held = pickle.dumps((graph.heights, graph.layers, graph.entry, m, ef_build))
            return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "vectors": [rows.tobytes()], "graph": [held]})

        rows = points.select(F.col("id").cast("long").alias("id"), "vec", F.pmod(F.xxhash64("id"), F.lit(n)).alias("shard"))
        return HNSWIndex(cut(rows.groupBy("shard").applyInPandas(link, "shard long, ids binary, vectors binary, graph binary")), dim)

    def search(self, queries: DataFrame, k: int, ef_search: int = 64) -> DataFrame:
        """(qid, id, dist, rank): each shard's graph is searched, and the shards' best are merged."""
        found, dim = None, self.dim
        for qids, vectors in vector._blocks(queries, "id", "vec"):

            def near(batches: Iterator[pa.RecordBatch], qids: np.ndarray = qids, vectors: np.ndarray = vectors) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for ids, rows, held in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                        own = np.frombuffer(ids, np.int64)
                        graph = Graph.restored(np.frombuffer(rows, np.float64).reshape(len(own), dim), held)
                        out = [(int(qid), int(own[i]), float(np.sqrt(d))) for qid, q in zip(qids, vectors, strict=True) for d, i in graph.search(q, k, ef_search)]
                        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], names=["qid", "id", "dist"])

            part = self.shards.select("ids", "vectors", "graph").mapInArrow(near, "qid long, id long, dist double")
            found = part if found is None else found.unionByName(part)
        return _found(self.shards.sparkSession, found, k)

    def save(self, path: str) -> None:
        self.shards.withColumn("dim", F.lit(self.dim)).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> HNSWIndex:
        shards = spark.read.parquet(path)
        first = shards.select("dim").first()
        return HNSWIndex(shards.drop("dim"), first["dim"] if first else None)


@dataclass
class LSHIndex:
    """Rows with their buckets in tables of random projections; rows that share a bucket with a query are ranked exactly."""

    points: DataFrame
    planes: np.ndarray
    offsets: np.ndarray
    width: float

    @staticmethod
    def build(points: DataFrame, *, tables: int = 24, width: float = 1.6, hashes: int = 4, seed: int = 3) -> LSHIndex:
        dim = vector.dimension(points) or 1
        rng = np.random.default_rng(seed)
        planes, offsets = rng.normal(size=(tables, hashes, dim)), rng.uniform(0, width, (tables, hashes))

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    keys = _cells(_rows(batch, 1), planes, offsets, width)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["id", "vec", "buckets"])

        rows = points.select(F.col("id").cast("long").alias("id"), "vec")
        return LSHIndex(rows.mapInArrow(keyed, "id long, vec array<float>, buckets array<long>"), planes, offsets, width)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, id, dist, rank)"""
        found = None
        for ids, vectors in vector._blocks(queries, "id", "vec"):
            keys = _cells(vectors, self.planes, self.offsets, self.width)

            def near(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, vectors: np.ndarray = vectors, keys: np.ndarray = keys) -> Iterator[pa.RecordBatch]:
                best, held = vector.Nearest(vectors, k), [_by_value(x) for x in keys.T]
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    own, rows, buckets = batch.column(0).to_numpy(), _rows(batch, 1), batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
                    for part in vector._steps(len(rows), len(ids)):
                        mask = _shared(held, buckets[part], len(ids))
                        best.offer(own[part], rows[part], mask=mask)
                yield best.found(ids)

            part = self.points.select("id", "vec", "buckets").mapInArrow(near, "qid long, id long, dist double")
            found = part if found is None else found.unionByName(part)
        return _found(self.points.sparkSession, found, k)

    def save(self, path: str) -> None:
        self.points.write.mode("overwrite").parquet(f"{path}/points")
        _save_arrays(self.points.sparkSession, f"{path}/planes", [self.planes, self.offsets, np.array(self.width)])

    @staticmethod
    def load(spark: SparkSession, path: str) -> LSHIndex:
        planes, offsets, width = _load_arrays(spark, f"{path}/planes")
        return LSHIndex(spark.read.parquet(f"{path}/points"), planes, offsets, float(width))


def _by_value(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys, sorted, and the places of each."""
    values, n = np.unique(keys, return_counts=True)
    return values, np.split(np.argsort(keys, kind="stable"), np.cumsum(n)[:-1])


def _shared(held: list[tuple[np.ndarray, list[np.ndarray]]], buckets: np.ndarray, queries: int) -> np.ndarray:
    """Which query shares a bucket with which row, in any table. held: each table's buckets of the queries."""
    mask = np.zeros((queries, len(buckets)), bool)
    for t, (values, places) in enumerate(held):
        own, rows = _by_value(buckets[:, t])
        _, here, there = np.intersect1d(values, own, assume_unique=True, return_indices=True)
        for i, j in zip(here.tolist(), there.tolist(), strict=True):
            mask[places[i][:, None], rows[j]] = True
    return mask


def _cells(rows: np.ndarray, planes: np.ndarray, offsets: np.ndarray, width: float) -> np.ndarray:
    """The bucket of each row in each table."""
    cells = np.floor((np.einsum("thd,nd->nth", planes, rows) + offsets) / width).astype(np.int64)
    key = np.zeros(cells.shape[:2], np.int64)
    for h in range(cells.shape[2]):
        key = key * 1_000_003 + cells[:, :, h]
    return key * len(planes) + np.arange(len(planes))


def _found(spark: SparkSession, found: DataFrame | None, k: int) -> DataFrame:
    return _top(found, k) if found is not None else spark.createDataFrame([], "qid long, id long, dist double, rank long")


def _save_arrays(spark: SparkSession, path: str, arrays: list[np.ndarray]) -> None:
    rows = [(i, str(a.dtype), list(a.shape), a.tobytes()) for i, a in enumerate(arrays)]
    spark.createDataFrame(rows, "i int, kind string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)


def _load_arrays(spark: SparkSession, path: str) -> list[np.ndarray]:
    rows = spark.read.parquet(path).orderBy("i").collect()
    return [np.frombuffer(bytes(r["data"]), r["kind"]).reshape(r["shape"]) for r in rows]
