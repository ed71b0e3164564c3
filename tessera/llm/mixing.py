"""Mixing sources to target weights by Pfair scheduling.

A source's documents, shuffled, form blocks. With integer weights w_i of sum Q, the k-th block of source i
(k from 0) is released at slot floor(k Q / w_i) and due before slot ceil((k + 1) Q / w_i). Filling each slot
with the released block of the earliest deadline keeps every source within less than one block of its exact
share at every slot. The schedule repeats after Q slots, so one period of it, a table of Q slots, gives the
slot of any block in closed form. Where a source has no block left, a new phase starts with the others;
within each phase the bound holds. No document is dropped or repeated.

Sources, weights and periods are planned on the driver from one count for each source: a phase for each source
that ends, with a period of each that is live. That state grows with the square of the number of sources (200
of different sizes give 12,461 rows; it is meant for hundreds). Beyond ``BROADCAST_BYTES`` it is joined by a
salted shuffle. The documents are numbered and placed by DataFrame operations. A source is numbered in hash
buckets of bounded size, whose first numbers come from their counts, summed in two levels, so a source with a
third of all rows is no single task.

Defined cases: a null source is a source of its own; sources without a weight get weight 1; rows of one id
are ordered by a hash of all their columns (rows that are equal in all of them are the same row wherever they
go), so a task that runs again gives the same places, and keep a place each; texts and other columns of any
length pass through; an empty table gives an empty result. A column that is named like an output column is
replaced by it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

#: Documents to a block, and at most about so many to a numbering bucket.
BLOCK = 32
BUCKET_ROWS = 500
#: A plan of up to so many bytes is broadcast.
BROADCAST_BYTES = 32_000_000
SALTS = 32
#: The largest weight that the default rule gives.
TOP_WEIGHT = 100


def default_weights(counts: Mapping[str | None, int]) -> dict[str | None, int]:
    """Weights in proportion to the square roots of the sources' sizes, the largest 100."""
    top = math.sqrt(max(counts.values(), default=1))
    return {s: max(1, int(TOP_WEIGHT * math.sqrt(n) / top)) for s, n in counts.items()}


def period(weights: list[int]) -> list[int]:
    """The source of each slot of one period, by earliest deadline first over released blocks."""
    total = sum(weights)
    waiting = [(0, i, 0) for i in range(len(weights))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[i]), -weights[i], i, k))
        _, _, i, k = heapq.heappop(ready)
        out.append(i)
        heapq.heappush(waiting, ((k + 1) * total // weights[i], i, k + 1))
    return out


def plan(blocks: list[int], weights: list[int]) -> list[dict]:
    """Rows (source, phase, first, last, start, total, slots): blocks first..last of a source are placed in a phase.

    Block k's slot is start + (k - first) // len(slots) * total + slots[(k - first) % len(slots)].
    """
    done, left = [0] * len(blocks), list(blocks)
    start, phase, out = 0, 0, []
    while live := [i for i, n in enumerate(left) if n]:
        shared = math.gcd(*[weights[i] for i in live])
        own = [weights[i] // shared for i in live]
        total = sum(own)
        slots: list[list[int]] = [[] for _ in live]
        for at, j in enumerate(period(own)):
            slots[j].append(at)
        end = min((left[i] - 1) // own[j] * total + slots[j][(left[i] - 1) % own[j]] for j, i in enumerate(live))
        for j, i in enumerate(live):
            n = (end + 1) // total * own[j] + sum(s < (end + 1) % total for s in slots[j])
            if n:
                out.append({"source": i, "phase": phase, "first": done[i], "last": done[i] + n - 1, "start": start, "total": total, "slots": slots[j]})
            done[i] += n
            left[i] -= n
        start += end + 1
        phase += 1
    return out


def _hashable(kind: DataType) -> bool:
    return not isinstance(kind, MapType | VariantType) and all(map(_hashable, [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind.elementType] if isinstance(kind, ArrayType) else []))


def mix_sources(docs: DataFrame, *, weights: Mapping[str | None, int] | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """The input with block (of its source), phase, slot and position; positions give the mixed order."""
    counts = {r[0]: r[1] for r in docs.groupBy(source_col).count().collect()}
    added = ("block", "phase", "slot", "position")
    names = [c for c in docs.columns if c not in added]
    if not counts:
        return docs.select(*names, *[F.lit(None).cast("long").alias(c) for c in added])
    given = default_weights(counts) if weights is None else {s: int(weights.get(s, 1)) for s in counts}
    if min(given.values()) < 1:
        raise ValueError("weights are integers from 1")
    sources = sorted(counts, key=lambda s: (s is not None, s))
    planned = plan([-(-counts[s] // block) for s in sources], [given[s] for s in sources])

    number = F.coalesce(*[F.when(F.col(source_col).eqNullSafe(F.lit(s)), F.lit(i)) for i, s in enumerate(sources)]) if len(sources) <= 64 else None
    spark = docs.sparkSession
    if number is None:
        named = spark.createDataFrame([(s, i) for i, s in enumerate(sources)], f"__name {docs.schema[source_col].dataType.simpleString()}, __source int")
        rows = docs.join(F.broadcast(named), docs[source_col].eqNullSafe(named["__name"])).drop("__name")
    else:
        rows = docs.withColumn("__source", number)
    # Buckets are ranges of a hash in hexadecimal, so that their order is the hash's order.
    digits = max(0, math.ceil(math.log(max(1, max(counts.values()) / BUCKET_ROWS), 16)))
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = rows.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, digits) if digits else F.lit(""))
    head = F.substring("__bucket", 1, digits // 2) if digits > 1 else F.lit("")
    sizes = rows.groupBy("__source", "__bucket").agg(F.count("*").alias("__n")).withColumn("__head", head)
    heads = sizes.groupBy("__source", "__head").agg(F.sum("__n").alias("__size"))
    heads = heads.withColumn("__earlier", F.sum("__size").over(Window.partitionBy("__source").orderBy("__head")) - F.col("__size"))
    inside = F.sum("__n").over(Window.partitionBy("__source", "__head").orderBy("__bucket")) - F.col("__n")
    before = sizes.withColumn("__inside", inside).join(heads, ["__source", "__head"])
    before = before.select(F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), (F.col("__earlier") + F.col("__inside")).alias("__before"))
    hashed = [c for c in names if _hashable(docs.schema[c].dataType)]
    within = F.row_number().over(Window.partitionBy("__source", "__bucket").orderBy("__key", id_col, F.xxhash64(*hashed)))
    rows = rows.withColumn("__row", within).join(before, (F.col("__source") == F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    index = F.col("__before") + F.col("__row") - 1
    rows = rows.withColumn("__index", index).withColumn("__block", F.floor(F.col("__index") / block).cast("long"))

    placed = [F.struct(*[F.lit(r[c]).cast(t).alias(f"__{c}") for c, t in (("phase", "int"), ("first", "long"), ("last", "long"), ("start", "long"), ("total", "long"))], F.lit(r["source"]).alias("__of"), F.array(*[F.lit(x) for x in r["slots"]]).alias("__slots")) for r in planned]
    table = spark.range(1).select(F.inline(F.array(*placed))) if len(placed) <= 512 else spark.createDataFrame([(r["phase"], r["first"], r["last"], r["start"], r["total"], r["source"], r["slots"]) for r in planned], "__phase int, __first long, __last long, __start long, __total long, __of int, __slots array<int>")
    placed_in = (F.col("__source") == F.col("__of")) & F.col("__block").between(F.col("__first"), F.col("__last"))
    if sum(60 + 4 * len(r["slots"]) for r in planned) <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(table), placed_in)
    else:
        table = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__own", F.pmod(F.xxhash64("__key"), F.lit(SALTS)).cast("int")).join(table.hint("shuffle_hash"), placed_in & (F.col("__own") == F.col("__salt")))
    k, per = F.col("__block") - F.col("__first"), F.size("__slots")
    slot = F.col("__start") + F.floor(k / per).cast("long") * F.col("__total") + F.get("__slots", (k % per).cast("int"))
    return rows.select(*names, F.col("__block").alias("block"), F.col("__phase").cast("long").alias("phase"), slot.alias("slot"), (slot * block + F.col("__index") % block).alias("position"))


def in_order(mixed: DataFrame) -> DataFrame:
    """Mixed rows dealt to partitions by ranges of their positions, in order, without the added columns."""
    width = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(width, "position").sortWithinPartitions("position").drop("block", "phase", "slot", "position")
