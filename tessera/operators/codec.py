"""The posting codec: gaps in blocks of 128, each packed at the width of its largest gap.

Block layout: a byte for the width p, a byte for the count n, then ceil(p n / 8) bytes of values, lowest
bits first. Sizes, widths and skip pointers are relational; only the bytes themselves are made and read by
Arrow functions, all blocks of one width and count at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import cut

BLOCK = 128
#: Blocks of a term whose sizes one task sums in a row.
RUN_BLOCKS = 4096


def pack_block(gaps: np.ndarray) -> bytes:
    """One block's bytes."""
    width = max(1, int(gaps.max()).bit_length())
    bits = (gaps[:, None] >> np.arange(width)) & 1
    return bytes([width, len(gaps)]) + np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_block(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """A block's gaps, and where the next block begins."""
    if len(data) - at < 2:
        raise ValueError("truncated block header")
    width, n = data[at], data[at + 1]
    if width == 0:
        raise ValueError("block of width 0")
    end = at + 2 + -(-width * n // 8)
    if end > len(data):
        raise ValueError("truncated block")
    bits = np.unpackbits(np.frombuffer(data, np.uint8, end - at - 2, at + 2), count=width * n, bitorder="little").reshape(n, width)
    return (bits.astype(np.int64) << np.arange(width)).sum(axis=1), end


def encode(ids: list[int]) -> bytes:
    """A whole strictly increasing list of ids from 0 to 2^31 - 1; ValueError for others."""
    if not len(ids):
        return b""
    x = np.asarray(ids, np.int64)
    gaps = np.diff(x, prepend=0)
    if x[0] < 0 or x[-1] > 2**31 - 1 or (gaps[1:] <= 0).any():
        raise ValueError("ids must be strictly increasing, from 0 to 2^31 - 1")
    return b"".join(pack_block(gaps[i : i + BLOCK]) for i in range(0, len(gaps), BLOCK))


def decode(data: bytes) -> list[int]:
    out, at = [np.zeros(0, np.int64)], 0
    while at < len(data):
        gaps, at = unpack_block(data, at)
        out.append(gaps)
    return np.cumsum(np.concatenate(out)).tolist()


def skip_pointers_of(data: bytes) -> list[tuple[int, int]]:
    """(first doc id, byte offset) of each block of an encoded list."""
    out, at, last = [], 0, 0
    while at < len(data):
        gaps, end = unpack_block(data, at)
        out.append((last + int(gaps[0]), at))
        last += int(gaps.sum())
        at = end
    return out


def pack_blocks(gaps: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of many blocks, whose gaps lie one after the other; blocks of one width and count are packed together."""
    begins = np.concatenate([[0], ends[:-1]])
    counts = ends - begins
    widths = np.maximum(1, np.frexp(np.maximum.reduceat(gaps, begins).astype(np.float64))[1]) if len(ends) else counts
    out: list[bytes] = [b""] * len(ends)
    for kind in np.unique(widths * 256 + counts):
        width, n = divmod(int(kind), 256)
        own = np.flatnonzero((widths == width) & (counts == n))
        values = gaps[begins[own][:, None] + np.arange(n)]
        bits = (values[:, :, None] >> np.arange(width) & 1).astype(np.uint8).reshape(len(own), n * width)
        packed = np.packbits(bits, axis=1, bitorder="little")
        head = np.tile(np.array([width, n], np.uint8), (len(own), 1))
        raw, size = np.concatenate([head, packed], axis=1).tobytes(), 2 + packed.shape[1]
        for j, k in enumerate(own.tolist()):
            out[k] = raw[j * size : (j + 1) * size]
    return out


def unpack_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The gaps of many blocks of one list each; blocks of one width and count are read together."""
    by: dict[tuple[int, int, int], list[int]] = {}
    for k, b in enumerate(blocks):
        by.setdefault((len(b), b[0], b[1]) if len(b) > 1 else (len(b), 0, 0), []).append(k)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(blocks)
    for (size, width, n), own in by.items():
        if width == 0 or size != 2 + -(-width * n // 8):
            raise ValueError("truncated block")
        rows = np.frombuffer(b"".join([blocks[k] for k in own]), np.uint8).reshape(len(own), size)
        bits = np.unpackbits(rows[:, 2:], axis=1, count=width * n, bitorder="little").reshape(len(own), n, width)
        for k, gaps in zip(own, (bits.astype(np.int64) << np.arange(width)).sum(axis=2), strict=True):
            out[k] = gaps
    return out


def encode_lists(lists: list[np.ndarray]) -> tuple[list[bytes], list[list[tuple[int, int]]]]:
    """The same as ``encode`` and ``skip_pointers_of`` of many lists that aren't empty; their blocks are packed together."""
    sizes = np.array([len(x) for x in lists], np.int64)
    ids, first = np.concatenate([np.asarray(x, np.int64) for x in lists] or [np.zeros(0, np.int64)]), np.cumsum(sizes) - sizes
    gaps = np.diff(ids, prepend=0)
    later = np.ones(len(ids), bool)
    later[first] = False
    if (gaps[later] <= 0).any() or (ids < 0).any() or (ids > 2**31 - 1).any():
        raise ValueError("ids must be strictly increasing, from 0 to 2^31 - 1")
    gaps[first] = ids[first]
    many = -(-sizes // BLOCK)
    number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begins = np.repeat(first, many) + number * BLOCK
    blocks = pack_blocks(gaps, np.append(begins[1:], len(ids))[: len(begins)])
    heads, out, at = ids[begins].tolist(), ([], []), 0
    for n in many.tolist():
        own, offset, skips = blocks[at : at + n], 0, []
        for doc_id, block in zip(heads[at : at + n], own, strict=True):
            skips.append((doc_id, offset))
            offset += len(block)
        out[0].append(b"".join(own))
        out[1].append(skips)
        at += n
    return out


def decode_lists(lists: list[bytes]) -> list[np.ndarray]:
    """The same as ``decode`` of many lists; their blocks are read together."""
    blocks, many = [], []
    for data in lists:
        at, before = 0, len(blocks)
        while at < len(data):
            end = at + 2 + -(-data[at] * data[at + 1] // 8) if at + 1 < len(data) else len(data)
            blocks.append(data[at:end])
            at = end
        many.append(len(blocks) - before)
    gaps, out, at = unpack_blocks(blocks), [], 0
    for n in many:
        out.append(np.cumsum(gaps[at] if n == 1 else np.concatenate([np.zeros(0, np.int64), *gaps[at : at + n]])))
        at += n
    return out


def _pieces(ranked: DataFrame) -> DataFrame:
    """(term, block, rank, first_doc, gaps): runs (or single postings) of ranked postings, cut at the borders of blocks."""
    if "ids" not in ranked.columns:
        return ranked.select("term", F.floor(F.col("rank") / BLOCK).cast("long").alias("block"), "rank", F.col("doc_id").alias("first_doc"), F.array("gap").alias("gaps"))
    start, end = F.col("start"), F.col("start") + F.size("ids")

    def piece(block: Column) -> Column:
        a = F.greatest(start, block * BLOCK)
        n = F.least(end, (block + 1) * BLOCK) - a
        at = (a - start).cast("int")
        return F.struct(block.alias("block"), a.alias("rank"), F.get("ids", at).alias("first_doc"), F.slice("gaps", at + 1, n.cast("int")).alias("gaps"))

    blocks = F.sequence(F.floor(start / BLOCK), F.floor((end - 1) / BLOCK))
    return ranked.select("term", F.inline(F.transform(blocks, piece)))


def block_stats(ranked: DataFrame) -> DataFrame:
    """(term, block, n, first_doc, width, bytes) of ranked postings, single ones or in runs."""
    pieces = _pieces(ranked).select("term", "block", F.size("gaps").cast("long").alias("n"), "first_doc", F.array_max("gaps").alias("gap"))
    blocks = pieces.groupBy("term", "block").agg(F.sum("n").alias("n"), F.min("first_doc").alias("first_doc"), F.max("gap").alias("__gap"))
    width = F.length(F.bin("__gap")).cast("long")
    return blocks.select("term", "block", "n", "first_doc", width.alias("width"), (2 + F.ceil(width * F.col("n") / 8)).cast("long").alias("bytes"))


def _with_offsets(blocks: DataFrame, size: Column) -> DataFrame:
    """Blocks with the bytes before each in its term's list: sums within runs of blocks, and over the runs before.

    The blocks are stored first, so that they are made once.
    """
    rows = cut(blocks).withColumn("__run", F.floor(F.col("block") / RUN_BLOCKS))
    runs = rows.groupBy("term", "__run").agg(F.sum(size).alias("__size"))
    earlier = Window.partitionBy("term").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("term", "__run", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy("term", "__run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__within", F.coalesce(F.sum(size).over(within), F.lit(0))).join(runs, ["term", "__run"])
    return rows.withColumn("byte_offset", (F.col("__before") + F.col("__within")).cast("long"))


def skip_pointers(ranked: DataFrame) -> DataFrame:
    """(term, block, first_doc, byte_offset)."""
    return _with_offsets(block_stats(ranked), F.col("bytes")).select("term", "block", "first_doc", "byte_offset")


def sizes(ranked: DataFrame) -> DataFrame:
    """(term, df, bytes) of the encoded lists."""
    return block_stats(ranked).groupBy("term").agg(F.sum("n").alias("df"), F.sum("bytes").alias("bytes"))


@F.pandas_udf(T.BinaryType())
def _packed(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in blocks:
        lists = list(series)
        flat = np.concatenate([np.asarray(x, np.int64) for x in lists] or [np.zeros(0, np.int64)])
        yield pd.Series(pack_blocks(flat, np.cumsum([len(x) for x in lists], dtype=np.int64)), dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _ids(blocks: pd.Series, first: pd.Series) -> pd.Series:
    return pd.Series([f + np.cumsum(g) - g[0] for g, f in zip(unpack_blocks([bytes(b) for b in blocks]), first, strict=True)], dtype=object)


def pack(ranked: DataFrame) -> DataFrame:
    """(term, block, n, first_doc, byte_offset, bytes): at most 128 values meet in one cell."""
    gaps = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rank", "gaps"))), lambda x: x["gaps"]))
    blocks = _pieces(ranked).groupBy("term", "block").agg(F.sum(F.size("gaps")).cast("int").alias("n"), F.min("first_doc").alias("first_doc"), gaps.alias("gaps"))
    packed = blocks.select("term", "block", "n", "first_doc", _packed("gaps").alias("bytes"))
    return _with_offsets(packed, F.length("bytes")).select("term", "block", "n", "first_doc", "byte_offset", "bytes")


def unpack(blocks: DataFrame) -> DataFrame:
    """(doc_id, term) of packed blocks; each block decodes by itself from its first id."""
    return blocks.select(F.explode(_ids("bytes", "first_doc")).alias("doc_id"), "term")
