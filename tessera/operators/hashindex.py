"""A keyed table with the bucket directory of an extendible hash, derived from the data.

Without deletes, a bucket of suffix s at depth d splits if and only if the entries whose hashes end in s
outgrow its capacity, in whatever order they came. So the directory is a query: entries are summed by hash,
rolled up over depths, and the leaves are the children of overflowing nodes that don't overflow themselves.
Depths up to TOP_BITS are small; those below are rolled up apart for each suffix, and only where it overflows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import cut

HASH_BITS = 28
#: Depth up to which the driver has the directory: 2^12 sums.
TOP_BITS = 12
ENTRY_OVERHEAD = 4


def capacity(requested: int, block: int = 4096) -> int:
    """A bucket's bytes: the next multiple of the block above what is asked for."""
    return (requested // block + 1) * block


def key_text(columns: Sequence[str]) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])


def key_hash(key: Column) -> Column:
    """28 bits of the key's MD5, the same in every SQL engine."""
    return F.conv(F.right(F.md5(key.cast("binary")), F.lit(7)), 16, 10).cast("long")


def suffix(hash_: Column, depth: int | Column) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return hash_.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), depth.cast("int")) - 1)


def _buckets(rows: list[np.ndarray], nodes: np.ndarray, depth: int, last: int, max_bytes: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(depth, suffix, bytes, n) of the leaves at and below sorted nodes of one depth, and the nodes that overflow at the last one.

    rows: hashes, bytes and counts.
    """
    out, (h, size, n) = [np.zeros((4, 0), np.int64)], rows
    while len(nodes):
        own = h & ((1 << depth) - 1)
        at = np.minimum(np.searchsorted(nodes, own), len(nodes) - 1)
        here = nodes[at] == own
        h, size, n, at = h[here], size[here], n[here], at[here]
        sums = np.zeros((2, len(nodes)), np.int64)
        np.add.at(sums[0], at, size)
        np.add.at(sums[1], at, n)
        over = (sums[0] > max_bytes) & (depth < HASH_BITS)
        out.append(np.stack([np.full((~over).sum(), depth), nodes[~over], *sums[:, ~over]]))
        if depth == last:
            return list(np.concatenate(out, axis=1)), nodes[over]
        h, size, n = h[over[at]], size[over[at]], n[over[at]]
        nodes = np.concatenate([nodes[over], nodes[over] + (1 << depth)])  # sorted: the added bit is above all others
        depth += 1
    return list(np.concatenate(out, axis=1)), nodes


def directory(entries: DataFrame, max_bytes: int, *, initial_depth: int = 1) -> DataFrame:
    """(depth, suffix, bytes, n) of every bucket, empty ones too. entries: (h, bytes).

    ValueError if an entry alone outgrows a bucket. Entries of equal hash stay together at the last depth.
    The sums by hash are stored. The driver rolls up those by the low TOP_BITS only; what is below a suffix of
    that depth has at most 2^(HASH_BITS - TOP_BITS) hashes and is split in one task.
    """
    top = max(TOP_BITS, initial_depth)
    by_hash = cut(entries.groupBy("h").agg(F.sum("bytes").cast("long").alias("bytes"), F.count("*").alias("n"), F.max("bytes").cast("long").alias("largest")))
    sums = by_hash.groupBy(suffix(F.col("h"), top).alias("g")).agg(F.sum("bytes"), F.sum("n"), F.max("largest")).collect()
    g, size, n, largest = np.array([list(r) for r in sums], np.int64).reshape(-1, 4).T
    if largest.max(initial=0) > max_bytes:
        raise ValueError(f"an entry of {largest.max()} bytes is larger than a bucket of {max_bytes}")
    upper, split = _buckets([g, size, n], np.arange(1 << initial_depth), initial_depth, top, max_bytes)
    spark, schema = entries.sparkSession, "depth int, suffix long, bytes long, n long"
    found = spark.createDataFrame(list(zip(*[x.tolist() for x in upper], strict=True)), schema)
    if not len(split):
        return found

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)  # rows whose suffix may go on in the next batch
        for batch in chain(batches, [None]):
            last = held.shape[1]
            if batch is not None:
                held = np.concatenate([held, [batch.column(i).to_numpy() for i in range(3)]], axis=1)
                last = held.shape[1] and np.searchsorted(held[0] & mask, held[0, -1] & mask)
            whole, held = held[:, :last], held[:, last:]
            parents = np.intersect1d(whole[0] & mask, split)
            leaves, _ = _buckets(list(whole), np.concatenate([parents, parents + (1 << top)]), top + 1, HASH_BITS, max_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(leaves[0], pa.int32()), *map(pa.array, leaves[1:])], names=["depth", "suffix", "bytes", "n"])

    mask = (1 << top) - 1
    rows = by_hash.select("h", "bytes", "n", suffix(F.col("h"), top).alias("g")).repartition("g").sortWithinPartitions("g")
    return found.unionByName(rows.select("h", "bytes", "n").mapInArrow(below, schema))


@dataclass
class HashTable:
    """Rows by key; upserts give a new table. The key is all columns unless named."""

    rows: DataFrame
    keys: tuple[str, ...]
    max_bytes: int = 4096
    initial_depth: int = 1

    @staticmethod
    def create(rows: DataFrame, *, keys: Sequence[str] | None = None, max_bytes: int = 4096, initial_depth: int = 1, order_by: str | None = None) -> HashTable:
        """Of several rows of a key the last by ``order_by`` stays (by a hash of the row where none is named)."""
        keys = tuple(keys or rows.columns)
        if set(keys) == set(rows.columns):
            return HashTable(rows.dropDuplicates(list(keys)), keys, max_bytes, initial_depth)
        last = Window.partitionBy(*keys).orderBy(*([F.col(order_by).desc()] if order_by else []), F.xxhash64(*rows.columns).desc())
        return HashTable(rows.withColumn("__row", F.row_number().over(last)).where("__row = 1").drop("__row"), keys, max_bytes, initial_depth)

    @staticmethod
    def load(spark: SparkSession, path: str, *, keys: Sequence[str], max_bytes: int = 4096, initial_depth: int = 1) -> HashTable:
        """A saved table; a lookup by hash or by record reads one of its parts."""
        return HashTable(spark.read.parquet(path).drop("part"), tuple(keys), max_bytes, initial_depth)

    def upsert(self, more: DataFrame, *, order_by: str | None = None) -> HashTable:
        """Rows of a known key are replaced; of several new ones of a key the last by ``order_by`` stays."""
        if set(self.keys) == set(self.rows.columns):
            merged = self.rows.unionByName(more.select(self.rows.columns)).dropDuplicates(list(self.keys))
            return HashTable(merged, self.keys, self.max_bytes, self.initial_depth)
        names = self.rows.columns
        last = Window.partitionBy(*self.keys).orderBy(F.col("__new").desc(), F.col("__at").desc())
        order = F.col(order_by) if order_by else F.xxhash64(*names)
        both = self.rows.select(*names, F.lit(0).alias("__new"), order.alias("__at")) if not order_by or order_by in names else self.rows.select(*names, F.lit(0).alias("__new"), F.lit(None).alias("__at"))
        both = both.unionByName(more.select(*names, F.lit(1).alias("__new"), order.alias("__at")))
        merged = both.withColumn("__row", F.row_number().over(last)).where("__row = 1").select(*names)
        return HashTable(merged, self.keys, self.max_bytes, self.initial_depth)

    def lookup(self, **key: object) -> DataFrame:
        """Rows of a key, by a filter that reaches the scan."""
        out = self.rows
        for name, value in key.items():
            out = out.where(F.col(name).eqNullSafe(F.lit(value)))
        return out

    def lookup_hash(self, hash_: int) -> DataFrame:
        """Rows whose keys have this very hash."""
        return self.hashed().where(F.col("h") == hash_).select(*self.rows.columns)

    def bucket_scan_of(self, **key: object) -> DataFrame:
        """All rows that share the bucket of a record's key; the key's columns are named and all given."""
        types = {f.name: f.dataType for f in self.rows.schema}
        one = self.rows.sparkSession.range(1).select(*[F.lit(key[k]).cast(types[k]).alias(k) for k in self.keys])
        return self.bucket_scan(one.select(key_hash(key_text(self.keys))).first()[0])

    def contains(self, wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted`` whose keys the table has."""
        return wanted.join(self.rows.select(*self.keys), list(self.keys), "left_semi")

    def hashed(self) -> DataFrame:
        text = key_text(self.keys)
        return self.rows.withColumn("h", key_hash(text)).withColumn("bytes", F.octet_length(text).cast("long") + ENTRY_OVERHEAD)

    def directory(self) -> DataFrame:
        return directory(self.hashed().select("h", "bytes"), self.max_bytes, initial_depth=self.initial_depth)

    def fullness(self, size: int = 0) -> DataFrame:
        """(depth, suffix, bytes, free, full, fits) of every bucket; fits: an entry whose record has ``size`` bytes can be added."""
        free = F.lit(self.max_bytes).cast("long") - F.col("bytes")
        return self.directory().select("depth", "suffix", "bytes", free.alias("free"), (free <= 0).alias("full"), (free >= size + ENTRY_OVERHEAD).alias("fits"))

    def clear(self) -> HashTable:
        """A table of the same keys and capacity without rows."""
        return HashTable(self.rows.limit(0), self.keys, self.max_bytes, self.initial_depth)

    def bucket_scan(self, hash_: int) -> DataFrame:
        """All rows that share the bucket of a hash, not only those of equal hash."""
        leaf = self.directory().where(F.col("suffix") == suffix(F.lit(hash_).cast("long"), F.col("depth")))
        return self.hashed().join(F.broadcast(leaf.select("depth", "suffix")), suffix(F.col("h"), F.col("depth")) == F.col("suffix")).select(*self.rows.columns)

    def stats(self) -> DataFrame:
        """(global_depth, directory_slots, leaf_buckets, entries)"""
        top = F.max("depth")
        return self.directory().agg(top.cast("long").alias("global_depth"), F.call_function("shiftleft", F.lit(1).cast("long"), top).alias("directory_slots"), F.count("*").alias("leaf_buckets"), F.sum("n").cast("long").alias("entries"))

    def save(self, path: str, *, partitions: int = 64) -> None:
        """Rows dealt to files by the low bits of their hashes, so that a key's files are known."""
        part = F.pmod("h", F.lit(partitions)).alias("part")
        self.hashed().select(*self.rows.columns, part).repartition("part").write.partitionBy("part").mode("overwrite").parquet(path)
