"""Substring dedup with difference-cover anchors.

A window is ``window`` consecutive words. Take a perfect difference cover D of a period v (each residue
modulo v is a difference of two members of D). Two equal windows, wherever they start, then share at
least one offset below v at which both documents stand at a cover position; an anchor is the run of
``window - v + 1`` words from a cover position, and lies inside the window at that offset. So:

1. only anchors (|D| of v positions) are hashed and compared over the corpus; those that occur twice
   are shared;
2. shared anchors are extended: of the windows that hold one at its offset, the words themselves are
   digested (128 bits of BLAKE2b, a cryptographic hash), equal digests are equal windows, and the earliest
   place of each is found;
3. every window that is not its digest's earliest place covers words, and covered words go.

Anchors are only compared by a fast polynomial hash: one that collides costs a digest, never a word.

Documents are dealt into blocks by their ids, and hashes into buckets by their values. A block sends
each bucket one sorted array of its distinct hashes (so a passage in a third of all documents costs a
bucket one entry for each block, not for each document), and the bucket answers with one bit for each.
No text leaves its block, nothing goes to the driver but three totals.

Defined cases: a null text has no words and stays null; texts shorter than a window lose nothing; rows
of one id count as documents of their own, in a fixed order (of a hash of their texts, then of the texts),
and are dealt to blocks by both; a null id comes after all others (with the id 2^63 - 1); ids are integers;
a text longer than a block is a block; an empty table gives an empty result. Other columns pass through;
those named like an output column are replaced by it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.tokens import Words, mix, split_words, window_hashes

#: Perfect difference covers by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Characters of text to a block, and to a bucket.
BLOCK_CHARS = 4_000_000
BUCKET_CHARS = 16_000_000
_LAST = np.iinfo(np.int64).max

REQUEST = "bucket int, block int, n int, first binary, more binary, ids binary, places binary"
ANSWER = "block int, phase int, bucket int, bits binary"


def period_for(window: int) -> int:
    """The longest period that leaves anchors of at least a third of the window."""
    return max(v for v in COVERS if window - v + 1 >= max(1, -(-window // 3)))


class _Block:
    """The windows and anchors of one block's documents, in the order of (id, text)."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, window: int):
        ids = table[id_col].combine_chunks()
        keys = np.asarray(pc.fill_null(ids.cast(pa.int64()), _LAST))
        order = np.argsort(keys, kind="stable")
        if len(np.unique(keys)) < len(keys):
            texts = table[text_col].to_pylist()
            order = np.array(sorted(range(len(keys)), key=lambda i: (keys[i], texts[i] or "")), dtype=np.int64)
        self.table = table.take(pa.array(order))
        self.ids = keys[order]
        self.words: Words = split_words(self.table[text_col])
        self.window = window
        self.rows, self.positions = self.words.rows(), self.words.positions()
        self.room = np.repeat(self.words.counts, self.words.counts) - self.positions  # words from here to the end

    def anchors(self, period: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchor hashes, whether each occurs twice here, the anchors' places, and each place's hash."""
        size = self.window - period + 1
        cover = np.zeros(period, bool)
        cover[list(COVERS[period])] = True
        at = np.flatnonzero(cover[self.positions % period] & (self.room >= size)) if len(self.words) else np.zeros(0, np.int64)
        values, which, count = np.unique(window_hashes(hashes, size)[at], return_inverse=True, return_counts=True)
        return values, count > 1, at, which

    def candidates(self, period: int, at: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of the anchors at its offset."""
        n = len(self.words)
        sums = np.zeros(n + period + 1, np.int32)
        marks = np.zeros(n, np.int32)
        marks[at] = 1
        np.cumsum(marks, out=sums[1 : n + 1])
        sums[n + 1 :] = sums[n]
        return np.flatnonzero((self.room >= self.window) & (sums[period : period + n] > sums[:n])) if n else np.zeros(0, np.int64)

    def windows(self, period: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Candidate windows' starts, their distinct digests (two halves), the first place of each, and each window's digest."""
        starts = self.candidates(period, shared)
        digests = b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in self.words.spans(starts, self.window)])
        one, two = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
        order = np.lexsort((starts, two, one))
        one_s, two_s = one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = (one_s[1:] != one_s[:-1]) | (two_s[1:] != two_s[:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        return starts, np.stack([one_s[new], two_s[new]]), starts[order[new]], group


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the hash, so that sorted hashes lie in the order of their buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _bits(answers: pa.Table, phase: int, n: int) -> np.ndarray:
    """The answers of all buckets, one bit for each hash that was sent, in the hashes' order."""
    t = answers.filter(pc.equal(answers["phase"], phase)).sort_by("bucket")
    got = [np.frombuffer(b, np.uint8) for b in t["bits"].to_pylist()]
    out = np.concatenate(got).astype(bool) if got else np.zeros(0, bool)
    if len(out) != n:
        raise ValueError(f"{len(out)} answers to {n} hashes: the block's rows changed between its passes")
    return out


def _requests(block: int, buckets: int, first: np.ndarray, more: np.ndarray, ids: np.ndarray | None = None, places: np.ndarray | None = None) -> pa.RecordBatch:
    edges = np.searchsorted(_bucket_of(first, buckets), np.arange(buckets + 1))
    filled = [b for b in range(buckets) if edges[b] < edges[b + 1]]
    part = lambda x: [None if x is None else x[edges[b] : edges[b + 1]].tobytes() for b in filled]
    return pa.RecordBatch.from_arrays(
        [pa.array(filled, pa.int32()), pa.array([block] * len(filled), pa.int32()), pa.array([int(edges[b + 1] - edges[b]) for b in filled], pa.int32())]
        + [pa.array(part(x), pa.binary()) for x in (first, more, ids, places)],
        names=["bucket", "block", "n", "first", "more", "ids", "places"],
    )


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, kind) for b in table[name].to_pylist()])


def _answers(table: pa.Table, phase: int, flags: np.ndarray) -> pa.Table:
    cuts = np.cumsum(table["n"].to_numpy())[:-1]
    k = len(table)
    return pa.table(
        {"block": table["block"], "phase": pa.array([phase] * k, pa.int32()), "bucket": table["bucket"], "bits": pa.array([x.astype(np.uint8).tobytes() for x in np.split(flags, cuts)], pa.binary())}
    )


def _shared_anchors(table: pa.Table) -> pa.Table:
    """For each hash of each block: does it occur twice in the corpus?"""
    table = table.sort_by("block")
    h, twice = _joined(table, "first", np.uint64), _joined(table, "more", bool)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    flags = np.zeros(len(h), bool)
    flags[order[1:]] |= same
    flags[order[:-1]] |= same
    return _answers(table, 1, flags | twice)


def _earliest_windows(table: pa.Table) -> pa.Table:
    """For each window hash of each block: is the block's place of it the earliest of all?"""
    table = table.sort_by("block")
    one, two = _joined(table, "first", np.uint64), _joined(table, "more", np.uint64)
    ids, places = _joined(table, "ids", np.int64), _joined(table, "places", np.int64)
    blocks = np.repeat(table["block"].to_numpy(), table["n"].to_numpy())
    order = np.lexsort((places, blocks, ids, two, one))
    first = np.ones(len(order), bool)
    first[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    flags = np.zeros(len(one), bool)
    flags[order] = first
    return _answers(table, 2, flags)


def _removed(block: _Block, period: int, answers: pa.Table) -> np.ndarray:
    """A mark for each word of the block that goes."""
    values, _, at, which = block.anchors(period, block.words.hashes())
    shared = _bits(answers, 1, len(values))
    starts, rows, firsts, group = block.windows(period, at[shared[which]])
    earliest = _bits(answers, 2, rows.shape[1])
    later = starts[~((firsts[group] == starts) & earliest[group])]
    marks = np.zeros(len(block.words) + 1, np.int64)
    np.add.at(marks, later, 1)
    np.add.at(marks, later + block.window, -1)
    return np.cumsum(marks)[:-1] > 0


def _finished(block: _Block, gone: np.ndarray, text_col: str, cut_text: bool) -> pa.Table:
    w = block.words
    sums = np.concatenate([[0], np.cumsum(gone)])
    n_removed = sums[w.first[1:]] - sums[w.first[:-1]]
    digests, texts = [], []
    source = block.table[text_col].combine_chunks() if cut_text else None
    for i, n in enumerate(n_removed):
        a, b = int(w.first[i]), int(w.first[i + 1])
        words = w.list(i)
        if n:
            words = [x for x, g in zip(words, gone[a:b], strict=True) if not g]
        digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        if cut_text and n:
            texts.append(_without(source[i].as_py().encode(), w, a, b, gone).decode())
        elif cut_text:
            texts.append(source[i].as_py())
    out = block.table
    if cut_text:
        out = out.set_column(out.schema.get_field_index(text_col), text_col, pa.array(texts, pa.string()))
    for name, column in (("n_words", pa.array(w.counts, pa.int64())), ("n_removed", pa.array(n_removed, pa.int64())), ("kept_sha256", pa.array(digests, pa.string()))):
        at = out.schema.get_field_index(name)
        out = out.append_column(name, column) if at < 0 else out.set_column(at, name, column)
    return out


def _without(text: bytes, w: Words, a: int, b: int, gone: np.ndarray) -> bytes:
    """The text without its removed words; what stands between kept words stays as it is."""
    lead = len(text) - len(text.lstrip())
    base = int(w.starts[a]) - lead
    out, at, k = [], 0, a
    while k < b:
        if gone[k]:
            out.append(text[at : int(w.starts[k]) - base])
            while k < b and gone[k]:
                k += 1
            at = int(w.starts[k]) - base if k < b else len(text)
        else:
            k += 1
    return b"".join([*out, text[at:]])


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, cut_text: bool = True) -> DataFrame:
    """The input with n_words, n_removed and kept_sha256, its texts without the repeated words.

    Each word that a window covers whose words also start earlier (in a document of smaller id, or
    earlier in the same one) goes; windows are judged on the input. kept_sha256 is of the kept words
    joined by single spaces. With ``cut_text`` false the texts stay as they are.
    """
    period = period_for(window)
    total = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    blocks, buckets = int(total // BLOCK_CHARS) + 1, int(total // BUCKET_CHARS) + 1
    dealt = docs.withColumn("__block", F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int"))
    names = docs.columns

    def ask_anchors(table: pa.Table) -> pa.Table:
        block = _Block(table, id_col, text_col, window)
        values, twice, _, _ = block.anchors(period, block.words.hashes())
        return pa.Table.from_batches([_requests(table["__block"][0].as_py(), buckets, values, twice)])

    def ask_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return pa.Table.from_batches([], schema=_requests(0, 1, np.zeros(0, np.uint64), np.zeros(0, bool)).schema)
        block = _Block(table, id_col, text_col, window)
        values, _, at, which = block.anchors(period, block.words.hashes())
        shared = at[_bits(answers, 1, len(values))[which]]
        _, rows, firsts, _ = block.windows(period, shared)
        return pa.Table.from_batches([_requests(table["__block"][0].as_py(), buckets, rows[0], rows[1], block.ids[block.rows[firsts]], firsts)])

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(table, id_col, text_col, window)
        gone = _removed(block, period, answers) if len(table) else np.zeros(0, bool)
        done = _finished(block, gone, text_col, cut_text)
        return done.select(out_schema.names).cast(arrow_schema)

    added = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType()}
    out_schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema if f.name not in added] + [T.StructField(k, v) for k, v in added.items()])
    arrow_schema = to_arrow_schema(out_schema)
    by_block = dealt.select(*names, "__block").groupBy("__block")
    first = by_block.applyInArrow(ask_anchors, REQUEST).groupBy("bucket").applyInArrow(_shared_anchors, ANSWER)
    second = by_block.cogroup(first.groupBy("block")).applyInArrow(ask_windows, REQUEST).groupBy("bucket").applyInArrow(_earliest_windows, ANSWER)
    return by_block.cogroup(first.unionByName(second).groupBy("block")).applyInArrow(finish, out_schema)
