"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.brown import brown_scores
from tidemark.llm.common import table
from tidemark.llm.decontaminate import leaks
from tidemark.llm.dialogue import damaged, repair_report
from tidemark.llm.jaccard_join import jaccard_components
from tidemark.llm.lexical import search
from tidemark.llm.main_text import page_texts
from tidemark.llm.oracle import SQL
from tidemark.llm.pieces import encoded_documents
from tidemark.llm.quality_pu import quality_scores
from tidemark.llm.quality_rules import quality_report
from tidemark.llm.records import token_report
from tidemark.llm.repeats import repeat_report
from tidemark.llm.secrets import secret_report
from tidemark.llm.toxicity import toxicity_scores


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_scores(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(table(spark, sf_dir, "conversations")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scans, op2_suffix_dedup, op3_html_extraction, op4_quality_classifier, op5_sentencepiece, op6_jaccard_join, op7_quality_rules, op8_toxicity, op9_brown_lm, op10_decontamination, op11_token_records, op12_conversation_repair, op13_ranked_search)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
