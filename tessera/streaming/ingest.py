"""Incremental indexing with Structured Streaming.

Each micro-batch appends the runs of its postings and its ids to the index's tables, partitioned by batch; what
was there is not read. Files of a batch are overwritten if it is replayed, so a lost executor or a restart
changes nothing. Duplicates across batches go when the index is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.postings import InvertedIndex, build_runs, build_universe, merged, spread


def start(stream: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", trigger: dict | None = None) -> StreamingQuery:
    """Indexes a stream of documents into ``path``; by default what is there now, then it ends."""

    def add(batch: DataFrame, number: int) -> None:
        build_runs(batch, id_col=id_col, text_col=text_col).write.mode("overwrite").parquet(f"{path}/runs/batch={number}")
        build_universe(batch, id_col=id_col, text_col=text_col).write.mode("overwrite").parquet(f"{path}/universe/batch={number}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/progress")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str) -> InvertedIndex:
    """The index as of the batches written so far."""
    runs = merged(spark.read.parquet(f"{path}/runs").select("term", "range", "ids"))
    return InvertedIndex(spread(runs), spark.read.parquet(f"{path}/universe").select("doc_id").distinct(), runs)


def compact(spark: SparkSession, path: str, to: str) -> None:
    """One deduplicated, packed index of all batches."""
    current(spark, path).save(to)
