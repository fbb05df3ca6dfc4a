"""Baskets and ratings derived from ordinary tables in a directory of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.text import words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line_parts(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col(column).alias("item"))
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))


def baskets_of_parts(spark: SparkSession, sf_dir: str, column: str = "p_brand", distinct: bool = True) -> DataFrame:
    """tid, item: each order's parts by brand or type."""
    rows = _line_parts(spark, sf_dir, column).select(F.col("l_orderkey").alias("tid"), "item")
    return rows.distinct() if distinct else rows


def baskets_of_words(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """tid, item: each document's words of four letters or more; of one language if ``lang`` is given."""
    docs = table(spark, sf_dir, "documents")
    docs = docs if lang is None else docs.filter(F.col("lang") == lang)
    return docs.select(F.col("doc_id").alias("tid"), F.explode(F.array_distinct(words(F.col("text")))).alias("item"))


def ratings_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id (brand), score: a supplier's mean quantity of a brand."""
    rows = _line_parts(spark, sf_dir, "p_brand")
    return rows.groupBy(F.col("l_suppkey").alias("user_id"), F.col("item").alias("item_id")).agg(F.avg("l_quantity").alias("score"))


def ratings_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id (brand), score: a customer's mean quantity of a brand."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    rows = _line_parts(spark, sf_dir, "p_brand").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("user_id", F.col("item").alias("item_id")).agg(F.avg("l_quantity").alias("score"))


def ratings_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id (event type), score: a user's mean value."""
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("user_id", F.col("event_type").alias("item_id")).agg(F.avg("value").alias("score"))


def baskets_of_ratings(ratings: DataFrame) -> DataFrame:
    """tid (the user), item: what each user rated."""
    return ratings.select(F.col("user_id").alias("tid"), F.col("item_id").alias("item")).distinct()
