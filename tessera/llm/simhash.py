"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints of 64 bits link at ``distance`` or fewer differing bits. The bits are grouped into m
partitions of correlated bits, with thresholds t_i (-1: not probed) whose t_i + 1 sum to distance + 1.
Two linked fingerprints then differ in at most t_i bits of some partition i. A dynamic program over the
estimated numbers of candidates gives the thresholds of least cost, for each m, and the best m is taken.
Each fingerprint is entered under its own bits of every partition and probes under all values within
t_i of them; entries of one value meet in one bucket and are verified there.

A bucket returns a spanning forest of the links that it finds, never the pairs: a group of thousands of
near copies costs a row for each copy. Runs of many entries are searched breadth first, where each
fingerprint is compared only with those not yet reached. Equal fingerprints form one class before, so
exact copies are never compared.

``near_duplicates`` with ``similarity`` links by exact Jaccard similarity of shingle sets. No pigeonhole over a
distance that such sets keep is selective (at 0.8 they differ in 15 % of the bits on average), so the partitions
are bands of ``WIDE_BITS`` bits, as wide as the number of texts allows and as many as a stated recall needs
(``plan_bands``); probing is by equal bands, and a candidate differs in few of the first 128 bits. Candidates make
groups, each text's set of shingles travels to its group, and sets are compared there; what is linked already
isn't compared again. Groups larger than a block are compared block by block: first each block, then the blocks'
classes by their smallest members, then, of what is still apart, all pairs of blocks.

Defined cases: a null text or one without words has fingerprint zero, linked like any other (with ``similarity``:
linked to each other); a text of fewer words than a shingle has one shingle, all its words; rows of one id count
separately; a null id is never a component's id; ids are integers; texts may be of any length; no column but the
id and the text is looked at, so clashing names don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.tokens import mix
from tessera.session import cut

BITS = 64
SEED = 42
#: Fingerprints that the costs of partitions are estimated from; the estimate never changes results.
COST_SAMPLE = 2048
#: Entries to a bucket; pairs compared at once; entries times entries of a run from which it is searched breadth first.
BUCKET_ENTRIES = 2_000_000
CHUNK_PAIRS = 2_000_000
#: Pairs of a run from which it is compared as one matrix, and not gathered with others.
WIDE_RUN = 4_000
LARGE_RUN = 4_000_000
#: Sets of Jaccard similarity s have a cosine of 2s / (1 + s); their fingerprints differ in acos of it / pi of the bits,
#: at 0.8 in 19.4 of 128 with a deviation of 4.1, and in 9.7 of 64 with one of 2.9. All but 1 in 10,000 stay within these.
WIDE_128, WIDE_64 = 36, 21
SIMILARITY = 0.8
#: Bits that bands are taken from; the share of pairs of just the similarity that share a band; comparisons that a
#: class costs in a band, about, as a power of two.
LANES = 8
WIDE_BITS = 64 * LANES
RECALL = 0.95
RUN_POWER = 10
#: Classes of a block, and shingles: what one task compares.
BLOCK, BLOCK_SHINGLES = 32_768, 8_000_000
_LANE = np.arange(LANES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def text_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``size`` words, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Each bit is set if more than half the hashes have it."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[a : a + 65536]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``LANES`` independent fingerprints of a set of hashes; the first one is ``fingerprint``'s."""
    counts = np.zeros(WIDE_BITS, np.int64)
    for a in range(0, len(hashes), 8192):
        part = hashes[a : a + 8192, None] + _LANE
        part[:, 1:] = mix(part[:, 1:])
        counts += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, wide: bool = False) -> DataFrame:
    """(id, fp, fp2, size, digest, wide) of every row.

    With ``wide``, the fingerprints are of the set of shingles, fp2 is a second one, ``wide`` holds all, and size and
    digest are that set's; else fp counts repeats and the others are 0 and null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, size, digest, lanes = [], [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                h = text_hashes(text or b"", shingle)
                if wide:
                    h = np.unique(h)
                    w = wide_fingerprint(h)
                    one.append(w[0])
                    two.append(w[1])
                    lanes.append(w.tobytes())
                else:
                    one.append(fingerprint(h))
                    two.append(0)
                    lanes.append(None)
                size.append(len(h) if wide else 0)
                digest.append(xxhash.xxh64_intdigest(h.tobytes(), SEED) if wide else 0)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), signed(one), signed(two), pa.array(size, pa.int64()), signed(digest), pa.array(lanes, pa.binary())], names=["id", "fp", "fp2", "size", "digest", "wide"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, fp long, fp2 long, size long, digest long, wide binary")


@dataclass(frozen=True)
class Probe:
    """A partition's bits and the flips under which its fingerprints probe; none: only the own value."""

    mask: int
    flips: tuple[int, ...]


def _ball(width: int, t: int) -> int:
    return sum(np.prod([width - j for j in range(k)], dtype=object) // int(np.prod(range(1, k + 1))) if k else 1 for k in range(t + 1)) if t >= 0 else 0


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups; each is filled up with what correlates most with it.

    ``together[i][j]`` counts fingerprints that have both bits.
    """
    ones = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-9))
    related = np.abs((together / max(n, 1) - np.outer(ones, ones)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        own = [max(left, key=lambda b: (related[b, list(left)].sum(), -b))]
        left.remove(own[0])
        while len(own) < width:
            nxt = max(left, key=lambda b: (related[b, own].sum(), -b))
            own.append(nxt)
            left.remove(nxt)
        out.append(sorted(own))
    return out


def allocate(groups: list[list[int]], sample: np.ndarray, n: int, distance: int) -> tuple[float, list[int]]:
    """The thresholds of least estimated cost, by dynamic programming over the partitions."""
    costs = []
    for own in groups:
        mask = np.uint64(sum(1 << b for b in own))
        part = sample & mask
        differ = np.bitwise_count(part[:, None] ^ part[None, :])
        near = [max(0, int((differ <= t).sum()) - len(part)) / max(1, len(part) * (len(part) - 1)) for t in range(4)]
        near = [max(x, _ball(len(own), t) / 2 ** len(own)) for t, x in enumerate(near)]
        # Entries are shuffled and sorted, candidates only compared: an entry costs some 50 comparisons.
        costs.append([0.0] + [near[t] * n * n + 50.0 * n * _ball(len(own), t) for t in range(4)])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, 4):
                at = used + t + 1
                if at <= distance + 1 and (at not in step or cost + c[t + 1] < step[at][0]):
                    step[at] = (cost + c[t + 1], [*ts, t])
        best = step
    return best.get(distance + 1, (float("inf"), []))


def plan_probes(classes: DataFrame, n: int, distance: int) -> list[Probe]:
    """The partitions and thresholds for these fingerprints."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            h = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(h, axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(BITS), BITS), pa.int32()), pa.array(np.tile(np.arange(BITS), BITS), pa.int32()), pa.array(total.ravel(), pa.int64())], names=["i", "j", "n"])

    together = np.zeros((BITS, BITS), np.int64)
    for r in classes.select("fp").mapInArrow(counted, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        together[r["i"], r["j"]] = r["n"]
    sample = np.array([r[0] for r in classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(COST_SAMPLE).collect()], np.int64).view(np.uint64)
    options = []
    for parts in range(1, distance + 2):
        groups = group_bits(together, n, parts)
        options.append((*allocate(groups, sample, n, distance), groups))
    _, thresholds, groups = min(options, key=lambda o: o[0])
    out = []
    for own, t in zip(groups, thresholds, strict=True):
        if t >= 0:
            flips = [sum(1 << b for b in c) for k in range(1, t + 1) for c in itertools.combinations(own, k)]
            out.append(Probe(sum(1 << b for b in own), tuple(flips)))
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, node): trees that connect the same as the edges.

    Each is the Cartesian tree of its nodes in order under a hash, so that no node is a hub, paths are short, and
    trees over nearly the same nodes have nearly the same edges.
    """
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y, label[x], label[y]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    order = np.argsort(label, kind="stable")
    rank = mix(nodes.astype(np.uint64)).tolist()
    above = [-1] * len(nodes)
    stack: list[int] = []
    of = -1
    for i, group in zip(order.tolist(), label[order].tolist(), strict=True):
        if group != of:
            stack, of = [], group
        last = -1
        while stack and rank[stack[-1]] < rank[i]:
            last = stack.pop()
        if last >= 0:
            above[last] = i
        if stack:
            above[i] = stack[-1]
        stack.append(i)
    above = np.array(above, np.int64)
    child = np.flatnonzero(above >= 0)
    return nodes[child], nodes[above[child]]


def _reached(fp: np.ndarray, fp2: np.ndarray, node: np.ndarray, distance: int, both: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect one run's linked entries, found breadth first."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left = np.arange(len(node))
    while len(left) > 1:
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = _linked(fp[left] ^ fp[x], fp2[left] ^ fp2[x], distance, both)
            hit = left[near]
            if len(hit):
                a.append(np.full(len(hit), node[x]))
                b.append(node[hit])
                stack.extend(hit.tolist())
                left = left[~near]
    return np.concatenate(a), np.concatenate(b)


def _linked(one: np.ndarray, two: np.ndarray, distance: int, both: int | None) -> np.ndarray:
    d = np.bitwise_count(one)
    out = d <= distance
    if both is not None:
        out &= d.astype(np.int16) + np.bitwise_count(two) <= both
    return out


def link_run(keys: np.ndarray, own: np.ndarray, fp: np.ndarray, fp2: np.ndarray, node: np.ndarray, distance: int, both: int | None) -> tuple[np.ndarray, np.ndarray]:
    """A forest over entries whose keys are equal, one of them an own entry, and that link."""
    order = np.lexsort((~own, keys))
    keys, own, fp, fp2, node = (x[order] for x in (keys, own, fp, fp2, node))
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(keys)))
    owns = np.add.reduceat(own.astype(np.int64), begin) if len(begin) else size
    a, b = [], []
    keep = (owns > 0) & (size > 1)
    begin, size, owns = begin[keep], size[keep], owns[keep]
    large = owns * size > LARGE_RUN
    for s, n in zip(begin[large], size[large], strict=True):
        x, y = _reached(fp[s : s + n], fp2[s : s + n], node[s : s + n], distance, both)
        a.append(x)
        b.append(y)
    begin, size, owns = begin[~large], size[~large], owns[~large]
    wide = owns * size > WIDE_RUN
    for s, n, o in zip(begin[wide], size[wide], owns[wide], strict=True):
        i, j = np.nonzero(np.bitwise_count(fp[s : s + o, None] ^ fp[None, s : s + n]) <= distance)
        i, j = i[i < j] + s, j[i < j] + s
        near = _linked(fp[i] ^ fp[j], fp2[i] ^ fp2[j], distance, both) & (node[i] != node[j])
        a.append(node[i[near]])
        b.append(node[j[near]])
    begin, size, owns = begin[~wide], size[~wide], owns[~wide]
    sums = np.cumsum(owns * size)
    lo = 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + CHUNK_PAIRS, side="right")))
        s, n, o = begin[lo:hi], size[lo:hi], owns[lo:hi]
        pairs = o * n
        run = np.repeat(np.arange(len(s)), pairs)
        k = np.arange(len(run)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        i, j = s[run] + k // n[run], s[run] + k % n[run]
        near = (i < j) & _linked(fp[i] ^ fp[j], fp2[i] ^ fp2[j], distance, both)
        x, y = node[i[near]], node[j[near]]
        far = x != y
        a.append(x[far])
        b.append(y[far])
        lo = hi
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(np.concatenate(a), np.concatenate(b))


def _cells(bucket: np.ndarray, buckets: int, *columns: np.ndarray) -> tuple[list[int], list[list[bytes]]]:
    """The buckets that have entries, and for each column the bytes of each of them."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(edges[:-1] < edges[1:]).tolist()
    return full, [[x[order[edges[b] : edges[b + 1]]].tobytes() for b in full] for x in columns]


_ENTRIES = "bucket int, part int, keys binary, owns binary, nodes binary, fps binary, fps2 binary"


def _meet_entries(entries: DataFrame, distance: int, both: int | None) -> DataFrame:
    """(a, b): forests of the links among entries of equal keys.

    Buckets of more than four times ``BUCKET_ENTRIES`` entries, as a hot key makes, are split: their cells are dealt
    into blocks, and blocks meet in pairs.
    """
    entries = cut(entries)
    n = F.sum(F.length("nodes") / 8)
    hot = {r["bucket"]: -(-int(r["n"]) // BUCKET_ENTRIES) for r in entries.groupBy("bucket").agg(n.alias("n")).where(F.col("n") > 4 * BUCKET_ENTRIES).collect()}
    columns = ["part", "keys", "owns", "nodes", "fps", "fps2"]

    def meet(table: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        parts = table["part"].to_numpy()
        for part in np.unique(parts):
            t = table.filter(pa.array(parts == part))
            read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in t[name].to_pylist()])  # noqa: E731, B023
            fp = read("fps", np.uint64)
            x, y = link_run(read("keys", np.uint64), read("owns", bool), fp, read("fps2", np.uint64) if both is not None else np.zeros(len(fp), np.uint64), read("nodes", np.int64), distance, both)
            a.append(x)
            b.append(y)
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    if not hot:
        return entries.select("bucket", *columns).groupBy("bucket").applyInArrow(meet, "a long, b long")
    blocks = F.coalesce(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])[F.col("bucket")], F.lit(1))
    dealt = entries.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("nodes", "keys"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *columns)
    return dealt.groupBy("bucket", "i", "j").applyInArrow(lambda t: meet(t.drop_columns(["bucket", "i", "j"])), "a long, b long")


def links(classes: DataFrame, probes: list[Probe], n: int, distance: int, both: int | None = None) -> DataFrame:
    """(a, b) edges over the classes' nodes, connecting what links; a few for each node."""
    entries = n * sum(1 + len(p.flips) for p in probes)
    width = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(width, entries // BUCKET_ENTRIES + 1)
    flips = [np.array((0, *p.flips), np.uint64) for p in probes]

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, fp2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for part, p in enumerate(probes):
                keys = (fp.view(np.uint64) & np.uint64(p.mask))[:, None] ^ flips[part][None, :]
                row, variant = np.divmod(np.arange(keys.size), keys.shape[1])
                bucket = (mix(keys.ravel() + np.uint64(part)) % np.uint64(buckets)).astype(np.int64)
                full, cells = _cells(bucket, buckets, keys.ravel(), variant == 0, node[row], fp[row], fp2[row])
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([part] * len(full), pa.int32()), *(pa.array(c, pa.binary()) for c in cells)], names=["bucket", "part", "keys", "owns", "nodes", "fps", "fps2"])

    return _meet_entries(classes.select("node", "fp", "fp2").mapInArrow(enter, _ENTRIES), distance, both)


def band_recall(width: int, bands: int, similarity: float = SIMILARITY) -> float:
    """The share of pairs of sets of this similarity that agree in one of the bands."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    out = 0.0
    for d in range(WIDE_BITS - width + 1):
        weight = math.exp(math.lgamma(WIDE_BITS + 1) - math.lgamma(d + 1) - math.lgamma(WIDE_BITS - d + 1) + d * math.log(p) + (WIDE_BITS - d) * math.log1p(-p))
        clean = math.exp(sum(math.log((WIDE_BITS - d - i) / (WIDE_BITS - i)) for i in range(width)))
        out += weight * (1 - (1 - clean) ** bands)
    return out


def plan_bands(n: int, similarity: float = SIMILARITY) -> np.ndarray:
    """The bits of each band: wide enough that some 2 ** ``RUN_POWER`` of n classes share a band by chance, and as many as ``RECALL`` needs.

    Comparisons so grow with n times the number of bands, which grows with n to the power of some 0.24.
    """
    width = max(6, min(48, math.ceil(math.log2(max(n, 2))) - RUN_POWER))
    low, high = 0, 1
    while band_recall(width, high, similarity) < RECALL:
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if band_recall(width, mid, similarity) >= RECALL else (mid, high)
    r, out = np.random.default_rng(7), []
    while len(out) < high:
        order = r.permutation(WIDE_BITS)
        out += [order[a : a + width] for a in range(0, WIDE_BITS - width + 1, width)]
    return np.array(out[:high])


def candidates(classes: DataFrame, n: int, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): a forest, or one for each ``BUCKET_ENTRIES`` entries, that connects the classes that share a band and differ in few bits."""
    bands = plan_bands(n, similarity)
    width = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(width, n * len(bands) // BUCKET_ENTRIES + 1)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 10_000):
                batch = whole.slice(a, 10_000)
                node, fp, fp2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                lanes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, WIDE_BITS // 8)
                bits = np.unpackbits(lanes, axis=1, bitorder="little")
                keys = np.stack([mix((bits[:, own].astype(np.uint64) << np.arange(len(own), dtype=np.uint64)).sum(axis=1, dtype=np.uint64) + np.uint64(k << 48)) for k, own in enumerate(bands)], axis=1).ravel()
                row = np.arange(len(keys)) // len(bands)
                full, cells = _cells((mix(keys) % np.uint64(buckets)).astype(np.int64), buckets, keys, np.ones(len(keys), bool), node[row], fp[row], fp2[row])
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([0] * len(full), pa.int32()), *(pa.array(c, pa.binary()) for c in cells)], names=["bucket", "part", "keys", "owns", "nodes", "fps", "fps2"])

    def thin(table: pa.Table) -> pa.Table:
        a, b = _forest(table["a"].to_numpy(), table["b"].to_numpy())
        return pa.table({"a": a, "b": b})

    found = _meet_entries(classes.select("node", "fp", "fp2", "wide").mapInArrow(enter, _ENTRIES), WIDE_64, WIDE_128)
    # Each band has a forest of its own over a group; one forest over all of them connects the same.
    places = n * len(bands) // BUCKET_ENTRIES + 1
    return found.withColumn("place", F.pmod(F.xxhash64("a"), F.lit(places))).groupBy("place").applyInArrow(thin, "a long, b long")


_PLACE = "place long, group long, side int, node long, size long, label long, shingles binary"


def _numbered(values: np.ndarray) -> np.ndarray:
    """The rank of each value among the different values, in half the memory of ``np.unique`` with its inverse."""
    order = np.argsort(values)
    values = values[order]
    steps = np.ones(len(values), np.int32)
    np.not_equal(values[1:], values[:-1], out=steps[1:], casting="unsafe")
    del values
    np.cumsum(steps, out=steps)
    out = np.empty(len(order), np.int32)
    out[order] = steps - 1
    return out


def _compared(table: pa.Table, similarity: float) -> pa.Table:
    """(a, b): a forest of the exact links of a place's groups; sides 0 and 1 are compared with each other, side 2 with itself."""
    order = np.lexsort((table["size"].to_numpy(), table["group"].to_numpy()))
    group, side, node, size, label = (table[c].to_numpy()[order] for c in ("group", "side", "node", "size", "label"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
    flat = _numbered(np.concatenate([sets[i] for i in order]))
    del sets
    edges = np.concatenate([[0], np.cumsum(size)])
    held = np.zeros(len(flat) + 1, bool)
    now = label.copy()
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(group)], strict=True):
        for x in range(lo, hi):
            # Sizes of similar sets differ by the similarity at most; only larger ones are looked at.
            y = np.arange(x + 1, lo + np.searchsorted(size[lo:hi], size[x] / similarity, side="right"))
            y = y[(now[y] != now[x]) & ((side[y] != side[x]) | (side[x] == 2))]
            if not len(y):
                continue
            own = flat[edges[x] : edges[x + 1]]
            held[own] = True
            for part in range(0, len(y), 512):
                z = y[part : part + 512]
                lengths = size[z]
                places = np.concatenate([flat[edges[v] : edges[v + 1]] for v in z])
                shared = np.add.reduceat(held[places], np.cumsum(lengths) - lengths, dtype=np.int64)
                z = z[shared >= similarity * (size[x] + lengths - shared)]
                if len(z):
                    joined, at = np.unique(now[z], return_index=True)
                    now[lo:hi][np.isin(now[lo:hi], joined)] = now[x]
                    a.append(np.full(len(at), node[x]))
                    b.append(node[z[at]])
            held[own] = False
    x, y = _forest(np.concatenate(a), np.concatenate(b))
    return pa.table({"a": x, "b": y})


def similar(classes: DataFrame, groups: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): exact links, connecting what is similar within each candidate group.

    classes are (node, digest, size), groups (node, group), texts (id, text).
    """
    spark = classes.sparkSession

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(text_hashes(x or b"", shingle)).tobytes() for x in batch.column(1).cast(pa.binary()).to_pylist()]
            digest = np.array([xxhash.xxh64_intdigest(x, SEED) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest), pa.array(sets, pa.binary())], names=["node", "digest", "shingles"])

    members = classes.join(groups, "node")
    # An id may have rows in several classes, so the digest names the set.
    sets = texts.join(groups.select(F.col("node").alias("id")), "id", "left_semi").select("id", "text").mapInArrow(gather, "node long, digest long, shingles binary")
    members = cut(members.join(sets.dropDuplicates(["node", "digest"]), ["node", "digest"]).select("node", "size", "group", "shingles"))
    sizes = members.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    # Of n classes and t shingles no more than n / BLOCK + t / BLOCK_SHINGLES groups are larger than a block.
    large = cut(sizes.select(F.col("group").alias("large"), blocks.alias("blocks")).where("blocks > 1"))
    total = members.agg(F.sum("size")).first()[0] or 0
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = max(width, int(total // BLOCK_SHINGLES) + 1)

    def meet(rows: DataFrame) -> DataFrame:
        return rows.select("place", "group", "side", "node", "size", "label", "shingles").groupBy("place").applyInArrow(lambda t: _compared(t, similarity), "a long, b long")

    def spread(rows: DataFrame) -> DataFrame:
        joined = rows.join(F.broadcast(large), F.col("group") == F.col("large"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        return joined.withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))

    one = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(places))).otherwise(F.xxhash64("group", "own"))
    found = cut(meet(spread(members).withColumn("label", F.col("node")).select("*", one.alias("place"), F.lit(2).alias("side"))))
    if not large.take(1):
        return found
    big = members.join(F.broadcast(large), F.col("group") == F.col("large"), "left_semi")

    def labelled(edges: DataFrame) -> DataFrame:
        known = components(edges).select(F.col("node").alias("known"), "component")
        return big.join(known, F.col("node") == F.col("known"), "left").withColumn("label", F.coalesce("component", "node")).drop("known", "component")

    # The smallest member stands for each class of a block: most classes of a large group are one, and meet here.
    least = labelled(found).where("label = node")
    ranked = least.withColumn("place", F.xxhash64("group", F.pmod(F.xxhash64("node", F.lit("least")), F.greatest(F.lit(1), F.lit(int(least.count() // BLOCK))))))
    found = cut(found.unionByName(meet(ranked.withColumn("side", F.lit(2)))))
    apart = cut(labelled(found))
    open_ = apart.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("group")
    rest = spread(apart.join(open_, "group", "left_semi")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> other")
    rest = rest.withColumn("place", F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other"))).withColumn("side", (F.col("own") < F.col("other")).cast("int"))
    return found.unionByName(meet(rest))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 4, similarity: float | None = SIMILARITY) -> DataFrame:
    """(id, fp, component_id) of every row.

    With ``similarity``, texts link whose shingle sets have at least that Jaccard similarity; without it,
    fingerprints (that count repeats) of ``distance`` or fewer differing bits.
    """
    marks = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, wide=similarity is not None))
    same = ["fp", "fp2", "size", "digest"]
    classes = cut(marks.groupBy(*same).agg(F.min("id").alias("node"), F.first("wide").alias("wide")))
    nodes = classes.where("node IS NOT NULL")
    n = nodes.count()
    if n < 2:
        return marks.join(classes, same).select("id", "fp", F.col("node").alias("component_id"))
    if similarity is None:
        forest = links(nodes, plan_probes(nodes, n, distance), n, distance)
    else:
        groups = cut(components(candidates(nodes.where("size > 0"), n, similarity)).withColumnRenamed("component", "group"))
        forest = similar(nodes.select("node", "digest", "size"), groups, docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), shingle, similarity)
    found = components(forest).withColumnRenamed("node", "__node")
    classes = classes.join(found, classes["node"] == found["__node"], "left").select(*same, F.coalesce("component", "node").alias("component_id"))
    return marks.join(classes, same).select("id", "fp", "component_id")


def fingerprint_hex(column: str) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")
