"""The corpus pipeline: stages that each call one operator of tidemark.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Staged, fresh, table
from tidemark.llm.decontaminate import with_leaks
from tidemark.llm.jaccard_join import one_of_each
from tidemark.llm.pieces import encoded_documents
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.secrets import redact


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the quality rules."""
    into = fresh(docs, "_quality")
    ruled = quality_rules(docs, table(spark, sf_dir, "labels"), into=into)
    return ruled.filter(F.col(f"{into}.kept")).drop(into)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies: five words, similarity 0.8 or more."""
    return one_of_each(docs, words=5, num=80, den=100)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without test items."""
    into = fresh(docs, "_leaks")
    return with_leaks(docs, table(spark, sf_dir, "benchmark"), into).filter(F.size(into) == 0).drop(into)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; secrets in their texts are replaced by a mark."""
    return redact(docs)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids and round_trip of each document."""
    return encoded_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", join_stage),
    ("decontamination", leak_stage),
    ("secret_scans", secret_stage),
    ("sentencepiece", piece_stage),
]
#: Randomness tests and the Viterbi search have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each result is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), Staged()
    for name, stage in STAGES:
        own = Staged()
        docs = own.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        before.drop()
        before = own
    return docs
