"""Quality rules: decision lists learned by sequential covering, run as Spark conditional expressions.

Statistics of each text are array and string expressions inside one scan, without a shuffle. Rules are
learned from labelled documents: a rule is grown, one threshold condition at a time, by the information
gain of its conjunction on two thirds of the labelled rows; pruned from its end on the other third; kept
if precise enough there; and the rows that it covers leave before the next one is grown. Where good rows are
among those that a rule rejects, a rule that keeps is grown in the same way on these rows alone, and stands
before it: the first rule that covers a row decides. Every step is one aggregation of (statistic, bin, label)
counts. The list becomes one ``CASE WHEN``.

Defined cases: a null text has no words; a text without words fails the base rules; an empty labels
table, or labels of one kind, give an empty list (the base rules alone decide); labels may be null (not
used); an id with labels of both kinds counts as bad, once; of conditions of one gain the first in the order
of statistics and thresholds is taken; texts of any length are counted whole; repeated ids each keep their
row; an empty table gives an empty result. The input's other columns pass through; one that is named like an
output column is replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

#: Labelled rows that rules are learned from, at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
BINS = [i / 32 for i in range(1, 32)] + [0.98, 0.99, 0.995]
SPACE = "[ \\t\\n\\x0B\\f\\r]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = ["s_words", "s_word_chars", "s_symbols", "s_dup_lines", "s_repeats", "s_upper", "s_shouts", "s_digits", "s_short", "s_line_words"]


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c > self.threshold if self.above else c <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    keep: bool = False

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once: a column named in a lambda may otherwise be computed per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """The number of words that lie in a 3-word window whose words occur twice or more in the array."""

    def covered(h: Column) -> Column:
        def positions(s: Column) -> Column:
            n = F.size(s)
            at = lambda i: F.get(s, i).getField("h")
            twice = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(at(i) == at(i - 1), F.lit(False)) | F.coalesce(at(i) == at(i + 1), F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.get(s, i).getField("p") + k)))))

        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, positions))

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes(w), covered)))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with the base counts (long) and the statistics that rules look at (double)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in docs.columns if c not in {*BASE, *STATISTICS}]

    def counted(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.length(x) <= 3)).alias("short"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    per = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    found = docs.select(
        *kept,
        let(words_of(F.col(text_col)), counted).alias("__w"),
        line_counts.alias("__l"),
        count("[#*$%&|<>]").cast("long").alias("n_symbols"),
        count("[A-Z]").alias("__upper"),
        count("!").alias("__shouts"),
        count("[0-9]").alias("__digits"),
    )
    n = F.col("__w.n_words")
    return found.select(
        *kept,
        n.alias("n_words"),
        F.col("__w.word_chars").alias("word_chars"),
        "n_symbols",
        F.col("__l.dup").alias("n_dup_lines"),
        F.col("__w.n_repeat_words").alias("n_repeat_words"),
        n.cast("double").alias("s_words"),
        per(F.col("__w.word_chars"), n).alias("s_word_chars"),
        per(F.col("n_symbols"), n).alias("s_symbols"),
        per(F.col("__l.dup"), F.col("__l.n")).alias("s_dup_lines"),
        per(F.col("__w.n_repeat_words"), n).alias("s_repeats"),
        per(F.col("__upper"), F.col("__w.word_chars")).alias("s_upper"),
        per(F.col("__shouts"), n).alias("s_shouts"),
        per(F.col("__digits"), F.col("__w.word_chars")).alias("s_digits"),
        per(F.col("__w.short"), n).alias("s_short"),
        per(n, F.col("__l.n")).alias("s_line_words"),
    )


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int], list[int]]:
    """(statistic, number of thresholds below its value) to the numbers of [good, bad] rows."""

    def below(s: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(t) for t in cuts[s]]), lambda t: F.col(s) > t))

    bins = [F.struct(F.lit(s).alias("s"), below(s).alias("b")) for s in cuts]
    got = rows.select("__bad", F.explode(F.array(*bins)).alias("x")).groupBy("x.s", "x.b").agg(F.sum("__bad").alias("bad"), F.count("*").alias("n")).collect()
    return {(r["s"], r["b"]): [r["n"] - r["bad"], r["bad"]] for r in got}


def _best(counts: dict[tuple[str, int], list[int]], cuts: dict[str, list[float]], least: int) -> tuple[Condition, int, int] | None:
    """The condition of the largest information gain, with the [bad, good] rows that it leaves."""
    best, top = None, 0.0
    for s, ts in cuts.items():
        by = [counts.get((s, b), [0, 0]) for b in range(len(ts) + 1)]
        good, bad = sum(x[0] for x in by), sum(x[1] for x in by)
        if not bad:
            continue
        start = math.log2(bad / (bad + good))
        for k, t in enumerate(ts):
            below = [sum(x[j] for x in by[: k + 1]) for j in (0, 1)]
            for above, (g, p) in ((False, below), (True, [good - below[0], bad - below[1]])):
                if p >= least and (gain := p * (math.log2(p / (p + g)) - start)) > top + 1e-9:
                    best, top = (Condition(s, above, t), p, g), gain
    return best


def _hits(rows: DataFrame, conditions: Sequence[Condition]) -> list[tuple[int, int]]:
    """(bad, good) rows that each prefix of the conditions covers."""
    aggs, so_far = [], F.lit(True)
    for i, c in enumerate(conditions):
        so_far = so_far & c.column()
        aggs += [F.sum(F.when(so_far, F.col("__bad")).otherwise(0)).alias(f"p{i}"), F.sum(F.when(so_far, 1 - F.col("__bad")).otherwise(0)).alias(f"n{i}")]
    r = rows.agg(*aggs).first()
    return [(r[f"p{i}"] or 0, r[f"n{i}"] or 0) for i in range(len(conditions))]


def _covering(grow: DataFrame, prune: DataFrame, cuts: dict[str, list[float]], least: int, max_conditions: int) -> tuple[tuple[Condition, ...], int, int] | None:
    """A conjunction grown for bad rows and pruned, with the (bad, good) rows that it covers of those it was pruned on."""
    conditions: list[Condition] = []
    left = grow
    while len(conditions) < max_conditions:
        found = _best(_counts(left, cuts), cuts, least)
        if not found:
            break
        conditions.append(found[0])
        left = left.where(found[0].column())
        if found[2] <= 0.01 * found[1]:
            break
    if not conditions:
        return None
    hits = _hits(prune, conditions)
    worth = [(p - n) / max(1, p + n) for p, n in hits]
    at = max(range(len(worth)), key=lambda i: (round(worth[i], 3), -i))
    return tuple(conditions[: at + 1]), *hits[at]


def learn(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    train_rows: int = TRAIN_ROWS,
    max_rules: int = 8,
    max_conditions: int = 4,
    min_precision: float = 0.85,
    min_share: float = 0.002,
) -> list[Rule]:
    """An ordered list of rules: at most ``max_rules`` that reject what they cover, each after the exception it may have.

    ``labels`` has the id and a label of 1 (good) or 0 (bad). At most ``train_rows`` labelled rows are
    used, those with the smallest hashes of their ids; the bound keeps the broadcast ids and the stored
    statistics small, whatever the size of either table.
    """
    chosen = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("__id"), F.when(F.col(label_col) == 0, 1).otherwise(0).alias("__bad"))
        .groupBy("__id")
        .agg(F.max("__bad").alias("__bad"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(train_rows)
    )
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    rows = statistics(rows, "__text").drop("__text", "__doc").withColumn("__part", F.pmod(F.xxhash64("__id", F.lit("part")), F.lit(3)))
    rows = cut(rows)
    if not rows.take(1):
        return []
    quantiles = rows.agg(*[F.percentile_approx(s, BINS, 10_000).alias(s) for s in STATISTICS]).first()
    cuts = {s: sorted(set(quantiles[s])) for s in STATISTICS}
    grow, prune = rows.where("__part <> 0"), rows.where("__part = 0")
    n_grow, n_prune = grow.count(), prune.count()
    least, least_pruned = max(2, int(min_share * n_grow)), max(1, min_share * n_prune)
    rules: list[Rule] = []
    rejecting = 0
    while rejecting < max_rules and n_grow and n_prune:
        found = _covering(grow, prune, cuts, least, max_conditions)
        if not found or found[1] < least_pruned:
            break
        conditions, p, n = found
        exception = None
        if n:
            covers = Rule(conditions, 0.0).column()
            flipped = [x.where(covers).withColumn("__bad", 1 - F.col("__bad")) for x in (grow, prune)]
            exception = _covering(*flipped, cuts, least, max_conditions)
        if exception and exception[1] >= max(least_pruned, min_precision * (exception[1] + exception[2])):
            inner, good, bad = exception
            first = [Rule(conditions + inner, good / (good + bad), keep=True)]
            p, n = p - bad, n - good
        else:
            first = []
        rule = Rule(conditions, p / max(1, p + n))
        if p < least_pruned or rule.precision < min_precision:
            break
        rules += [*first, rule]
        rejecting += 1
        grow, prune = grow.where(~rule.column()), prune.where(~rule.column())
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """What the first rule that covers the row says, else true: an ordered conditional expression over its statistics."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), F.lit(rules[0].keep))
    for r in rules[1:]:
        out = out.when(r.column(), F.lit(r.keep))
    return out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: Sequence[Rule], *, text_col: str = "text") -> DataFrame:
    """The input with the base counts, base_failed and kept."""
    kept = [c for c in docs.columns if c not in {*BASE, *STATISTICS, "base_failed", "kept"}]
    return statistics(docs, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules)).select(*kept, *BASE, "base_failed", "kept")
