"""Baskets given as Python lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def memory_baskets(spark: SparkSession, baskets: list[list[str]], tids: list[int] | None = None) -> DataFrame:
    """tid, item; tids count from 0 unless given."""
    tids = list(range(len(baskets))) if tids is None else tids
    if len(tids) != len(baskets):
        raise ValueError("as many tids as baskets are needed")
    return spark.createDataFrame([(t, i) for t, items in zip(tids, baskets) for i in items], "tid long, item string")


def memory_ratings(spark: SparkSession, ratings: dict[int, dict[int, float]]) -> DataFrame:
    """user_id, item_id, score."""
    return spark.createDataFrame([(u, i, float(s)) for u, row in ratings.items() for i, s in row.items()], "user_id long, item_id long, score double")
