"""Generated inputs: random query points and scaled corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_queries(spark: SparkSession, n: int, dim: int, seed: int = 11) -> DataFrame:
    """(id, vec): n points, uniform in the unit cube, the same for each seed."""
    coordinate = lambda j: (F.pmod(F.xxhash64(F.col("id"), j, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)).cast("float")
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(dim)), coordinate).alias("vec"))


def scaled_corpus(docs: DataFrame, copies: int, *, step: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """The rows ``copies`` times over, the i-th copy's ids raised by i * step (by default i * the row count)."""
    step = docs.count() if step is None else step
    return docs.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")).withColumn(id_col, F.col(id_col) + F.col("copy") * step)
