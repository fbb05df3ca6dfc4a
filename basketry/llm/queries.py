"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.common import spread
from basketry.llm import ann_permutation, best_fit_packing, byte_bpe, chat_format, language_id, license_scan, ngram_join, quality_classifier, quality_rules, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


#: What both turns of the added conversation say.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"))
    return chat_format.read_back(chat_format.windows(turns.unionByName(hard)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.text_model(_table(spark, sf_dir, "documents"))
    return language_id.identify(language_id.page_rows(_table(spark, sf_dir, "pages")), model).withColumnRenamed("id", "page_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.packing(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_permutation.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_chat_format": op3_chat_format,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_permutation_index": op9_permutation_index,
    "op10_token_counts": op10_token_counts,
}

_HARD_SQL = "SELECT -7, {turn}, '{role}', '\\### Assistant: </turn> ok'"

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": license_scan.oracle("documents"),
    "op5_quality_rules": quality_rules.oracle("documents"),
    "op2_ngram_jaccard_join": ngram_join.oracle("documents"),
    "op3_chat_format": chat_format.oracle("(SELECT conv_id, turn, role, text FROM conversations UNION ALL " + _HARD_SQL.format(turn=0, role="user") + " UNION ALL " + _HARD_SQL.format(turn=1, role="assistant") + ")"),
}
