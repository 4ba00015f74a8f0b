"""The text pipeline: quality rules, toxicity, near copies, benchmark decontamination, SentencePiece encoding.

Each stage works on what its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from navloom.llm import contamination, near_join, pieces, quality_rules, toxicity
from navloom.llm.common import materialize, read
from navloom.llm.queries import model_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the risk-controlled cutoffs keep."""
    return quality_rules.keep_documents(docs, read(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.keep_documents(docs, read(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_join.keep_documents(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contamination.keep_documents(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and digests of the ids and of the decoded text."""
    return pieces.token_digests(pieces.encode_documents(docs, model_path()))


STAGES = [
    ("quality_rules", quality),
    ("toxicity", not_toxic),
    ("near_copies", one_of_each),
    ("decontamination", decontaminated),
    ("piece_encoding", encoded),
]

#: Proven cutoffs, the trained toxicity model and the merge encoding can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read back."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
