"""Binary file formats as Python data sources: record buckets and index files.

A bucket file holds records, each after its length (4 bytes, little-endian), then zeros. An index file
begins with ``SAPJ`` and version 1, then has for each term its encoded list and its skip pointers. Each
task reads or writes whole files; a written folder has one self-contained file for each task.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessera.operators.codec import decode_lists, encode_lists

#: Fixed values of the index file format.
MAGIC = b"SAPJ"
VERSION = 1
INDEX_SCHEMA = "term string, posting binary, skips array<struct<doc_id: int, byte_offset: bigint>>"


def read_records(data: bytes) -> Iterator[bytes]:
    """Records up to the first length of zero, where the padding begins."""
    at = 0
    while at + 4 <= len(data):
        (n,) = struct.unpack_from("<I", data, at)
        if n == 0:
            return
        if at + 4 + n > len(data):
            raise ValueError("truncated record")
        yield data[at + 4 : at + 4 + n]
        at += 4 + n


def write_records(records: list[bytes], size: int) -> bytes:
    out = b"".join(struct.pack("<I", len(r)) + r for r in records)
    if len(out) > size:
        raise ValueError(f"{len(out)} bytes of records for a bucket of {size}")
    return out.ljust(size, b"\0")


def read_index(data: bytes) -> Iterator[tuple[str, bytes, list[tuple[int, int]]]]:
    """(term, encoded list, skip pointers) of an index file; ValueError for anything else."""
    at = 0

    def take(layout: str) -> int:
        nonlocal at
        if at + struct.calcsize(layout) > len(data):
            raise ValueError("truncated index file")
        (value,) = struct.unpack_from(layout, data, at)
        at += struct.calcsize(layout)
        return value

    def chunk() -> bytes:
        nonlocal at
        n = take("<I")
        if at + n > len(data):
            raise ValueError("truncated index file")
        at += n
        return data[at - n : at]

    if data[:4] != MAGIC:
        raise ValueError("not an index file")
    at = 4
    if (version := take("<I")) != VERSION:
        raise ValueError(f"index file of version {version}")
    for _ in range(take("<I")):
        term, posting = chunk().decode("utf-8", "replace"), chunk()
        yield term, posting, [(take("<i"), take("<Q")) for _ in range(take("<I"))]


def write_index(rows: list[tuple[str, bytes, list[tuple[int, int]]]]) -> bytes:
    out = [MAGIC, struct.pack("<II", VERSION, len(rows))]
    for term, posting, skips in rows:
        name = term.encode()
        out += [struct.pack("<I", len(name)), name, struct.pack("<I", len(posting)), posting, struct.pack("<I", len(skips))]
        out += [struct.pack("<iQ", doc_id, offset) for doc_id, offset in skips]
    return b"".join(out)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, hdfs, ...), and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> list[str]:
    store, at = _place(path)
    found = store.get_file_info(at)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == fs.FileType.File:
        return [at]
    inside = store.get_file_info(fs.FileSelector(at))
    return sorted(x.path for x in inside if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")))


class _Reader(DataSourceReader):
    def __init__(self, path: str, index: bool):
        self.path, self.index = path, index

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in _files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with _place(self.path)[0].open_input_stream(partition.value) as f:
            data = f.read()
        if self.index:
            for term, posting, skips in read_index(data):
                yield term, posting, skips
        else:
            for i, record in enumerate(read_records(data)):
                yield posixpath.basename(partition.value), i, record


@dataclass
class _Written(WriterCommitMessage):
    part: str | None


class _Writer(DataSourceWriter):
    """Tasks write hidden part files; the driver gives those of successful tasks their names, and drops the others.

    A task that is run twice so leaves one file, as only one of its messages is committed.
    """

    def __init__(self, path: str, index: bool, size: int, overwrite: bool):
        self.path, self.index, self.size = path, index, size
        self.job = uuid.uuid4().hex
        store, at = _place(path)
        store.create_dir(at, recursive=True)
        self.old = _files(path) if overwrite else []

    def _parts(self) -> list[str]:
        store, at = _place(self.path)
        return [x.path for x in store.get_file_info(fs.FileSelector(at)) if x.base_name.startswith(f".{self.job}")]

    def write(self, iterator: Iterator) -> _Written:
        rows = list(iterator)
        if not rows:
            return _Written(None)
        if self.index:
            data = write_index([(r["term"], bytes(r["posting"]), [(s["doc_id"], s["byte_offset"]) for s in r["skips"]]) for r in rows])
        else:
            data = write_records([bytes(r["record"]) for r in rows], self.size)
        store, at = _place(self.path)
        part = posixpath.join(at, f".{self.job}_{uuid.uuid4().hex}")
        with store.open_output_stream(part) as f:
            f.write(data)
        return _Written(part)

    def commit(self, messages: list) -> None:
        store, at = _place(self.path)
        for old in self.old:
            store.delete_file(old)
        for m in messages:
            if m is not None and m.part:
                name = posixpath.basename(m.part).rsplit("_", 1)[1]
                store.move(m.part, posixpath.join(at, f"index_{name}.idx" if self.index else f"bucket_{name}.dat"))
        for part in self._parts():
            store.delete_file(part)

    def abort(self, messages: list) -> None:
        for part in self._parts():
            _place(self.path)[0].delete_file(part)


class IndexFileSource(DataSource):
    """``index_file``: (term, posting, skips)."""

    @classmethod
    def name(cls) -> str:
        return "index_file"

    def schema(self) -> str:
        return INDEX_SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"], True)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return _Writer(self.options["path"], True, 0, overwrite)


class BucketFileSource(DataSource):
    """``bucket_file``: (file, position, record); option ``size`` is a written file's size."""

    @classmethod
    def name(cls) -> str:
        return "bucket_file"

    def schema(self) -> str:
        return "file string, position int, record binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"], False)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return _Writer(self.options["path"], False, int(self.options.get("size", 4096)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IndexFileSource)
    spark.dataSource.register(BucketFileSource)


def export_index(postings: DataFrame, path: str) -> None:
    """Postings, single ones or in runs, as index files. A term's list is one value there, so it meets in one task; native saving has no such limit."""
    register(postings.sparkSession)

    @F.pandas_udf("posting binary, skips array<struct<doc_id: int, byte_offset: bigint>>")
    def encoded(lists: pd.Series) -> pd.DataFrame:
        data, skips = encode_lists([np.sort(x) for x in lists])
        return pd.DataFrame({"posting": data, "skips": [[{"doc_id": d, "byte_offset": o} for d, o in own] for own in skips]})

    ids = F.flatten(F.collect_list("ids")) if "ids" in postings.columns else F.collect_list("doc_id")
    lists = postings.groupBy("term").agg(ids.alias("ids")).select("term", encoded("ids").alias("list"))
    lists.select("term", "list.posting", "list.skips").write.format("index_file").mode("append").save(path)


def import_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, term) of index files."""
    register(spark)

    @F.pandas_udf("array<long>")
    def decoded(lists):  # noqa: ANN001, ANN202
        return pd.Series(decode_lists([bytes(b) for b in lists]), dtype=object)

    return spark.read.format("index_file").load(path).select(F.explode(decoded("posting")).alias("doc_id"), "term")
