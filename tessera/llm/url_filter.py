"""URL filters: host-suffix and path-prefix expressions joined to rules by hash prefix.

Every URL is expanded into the suffixes of its host (label by label) times the prefixes of its path
(at the lengths that rules have, since a rule's path may end anywhere inside a segment). Each
expression is hashed; an equi-join on the first bytes of the digest finds candidate rules, the whole
digest confirms them, and the longest confirmed rule decides. All of it is DataFrame code.

Defined cases: a null url, or one without ``://``, has an empty host and path and matches nothing; an
empty rule table leaves every verdict to the second list or the default; repeated urls each keep their
row; of two fitting rules of one length the longer host wins, then block. Urls of any length are read
whole: an expansion is as large as the rules' labels and path lengths, not as the url. Urls without ``://``
are dealt by the row's other columns, so that a mass of them is no hot key. The input's other columns
pass through; one that is named like an output column is replaced by it. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

Rule = tuple[str, str, str]

PREFIX_HEX = 8
#: Rule lists of up to so many bytes are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 20_000_000
#: The rules of the contract (host, path, verdict).
CONTRACT_RULES: list[Rule] = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Hosts that the method itself blocks where no rule of the caller fits.
REPUTATION: list[Rule] = [(f"{name}.example.{top}", "/", "block") for name in ("casino-win", "cheap-pills", "spam-farm") for top in ("com", "net", "org")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null and for urls without it."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(url_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url_rest(url), "^[^/?#]*([^?#]*)", 1)


def digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The rules as a table of literals."""
    if not rules:
        return spark.createDataFrame([], "host string, path string, verdict string")
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _prepared(rules: DataFrame, rank: int) -> DataFrame:
    whole = F.concat(F.col("host"), F.col("path"))
    return rules.select(
        F.lit(rank).alias("__rank"),
        digest(whole).alias("__digest"),
        F.substring(digest(whole), 1, PREFIX_HEX).alias("__prefix"),
        whole.alias("__whole"),
        F.length(whole).alias("__length"),
        F.length("host").alias("__host_length"),
        F.col("host").alias("__rule_host"),
        F.col("path").alias("__rule_path"),
        F.col("verdict").alias("__verdict"),
    ).where(F.col("__whole").isNotNull())


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    url_col: str = "url",
    second: DataFrame | None = None,
    default: str = "allow",
) -> DataFrame:
    """The input with host, path, rule and verdict.

    ``rules`` and ``second`` have (host, path, verdict). The longest fitting row of ``rules`` gives
    rule and verdict; where none fits, the longest of ``second`` gives the verdict alone, else
    ``default`` does.
    """
    held = _prepared(rules, 1)
    if second is not None:
        held = held.unionByName(_prepared(second, 0))
    # The numbers of labels and the path lengths that rules have bound the expansion of each url.
    shape = held.select(
        F.count("*").alias("n"),
        F.sum(200 + 2 * F.octet_length("__whole")).alias("bytes"),
        F.collect_set(F.length("__rule_path")).alias("lengths"),
        F.max(F.size(F.split("__rule_host", "\\."))).alias("labels"),
    ).first()
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    outputs = {"host", "path", "rule", "verdict"}
    kept = [c for c in pages.columns if c not in outputs]
    if not shape["n"]:
        return pages.select(*kept, host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    held = F.broadcast(held) if shape["bytes"] <= BROADCAST_BYTES else held

    distinct = pages.select(F.col(url_col).alias("__url")).where(F.col("__url").contains("://")).distinct()
    labels = F.split(url_host(F.col("__url")), "\\.")
    count = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(count, F.lit(shape["labels"]))), lambda k: F.concat_ws(".", F.slice(labels, count - k + 1, k)))
    fitting = F.filter(F.array(*[F.lit(n) for n in sorted(shape["lengths"])]), lambda n: n <= F.length("__path"))
    prefixes = F.transform(fitting, lambda n: F.substr(F.col("__path"), F.lit(1), n))
    expressions = (
        distinct.withColumn("__path", url_path(F.col("__url")))
        .select("__url", F.explode(suffixes).alias("__suffix"), prefixes.alias("__prefixes"))
        .select("__url", "__suffix", F.explode("__prefixes").alias("__start"))
        .select("__url", "__suffix", "__start", digest(F.concat("__suffix", "__start")).alias("__own"))
        .withColumn("__prefix", F.substring("__own", 1, PREFIX_HEX))
    )
    confirmed = (F.col("__own") == F.col("__digest")) & (F.col("__suffix") == F.col("__rule_host")) & (F.col("__start") == F.col("__rule_path"))
    best = F.max(F.struct("__rank", "__length", "__host_length", F.col("__verdict"), F.col("__whole")))
    matched = (
        expressions.join(held, "__prefix")
        .where(confirmed)
        .groupBy("__url")
        .agg(best.alias("__best"))
        .select(F.col("__url").alias("__matched_url"), "__best")
    )
    rule = F.when(F.col("__best.__rank") == 1, F.col("__best.__whole"))
    plain = [f.name for f in pages.schema if isinstance(f.dataType, AtomicType) and f.name != url_col]
    spread = F.concat(F.lit("-"), F.pmod(F.xxhash64(*plain), F.lit(4096)).cast("string")) if plain else F.lit("-")
    key = F.when(F.col(url_col).contains("://"), F.col(url_col)).otherwise(spread)  # no matched url is without it
    return pages.withColumn("__key", key).join(matched, F.col("__key") == F.col("__matched_url"), "left").select(
        *kept,
        host.alias("host"),
        path.alias("path"),
        rule.alias("rule"),
        F.coalesce(F.col("__best.__verdict"), F.lit(default)).alias("verdict"),
    )
