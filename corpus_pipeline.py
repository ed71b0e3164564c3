"""The corpus pipeline: quality rules, near dedup, substring dedup, mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of documents. Ids are expected to be unique: where rows share one, a near duplicate among them
takes all of them along. Null texts fail the base rules; texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decision_list, mixing, pieces, simhash, substring_dedup
from tessera.llm.catalogue import PIECE_MODEL
from tessera.session import fresh_path, remove, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    rules = decision_list.learn(docs, table(spark, sf_dir, "labels"))
    return decision_list.judge(docs, rules).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles are linked at a similarity of 0.8 or more the smallest id stays."""
    found = simhash.near_duplicates(docs)
    gone = found.where("component_id IS NOT NULL AND component_id <> id").select(F.col("id").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that start earlier in the corpus are cut from the texts; every document stays."""
    cut = substring_dedup.dedup_substrings(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves sources at their target weights."""
    return mixing.in_order(mixing.mix_sources(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids, round_trip."""
    return pieces.encode_documents(docs.select("doc_id", "source", "text"), pieces.PieceModel.load(PIECE_MODEL))


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_cut),
    ("mixing sources", mix),
    ("SentencePiece encoding", encode),
]

#: Learned rules, fingerprints and piece lattices aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; a stage's files go once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
