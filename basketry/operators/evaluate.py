"""Errors of predictions against held-out ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def errors(predicted: DataFrame, test: DataFrame, train: DataFrame, value: str = "raw") -> DataFrame:
    """mae, rmse, n over test ratings of users that ``train`` has; a missing prediction counts as 0."""
    known = test.join(train.select("user_id").distinct(), "user_id", "left_semi")
    both = known.join(predicted.select("user_id", "item_id", F.col(value).alias("p")), ["user_id", "item_id"], "left")
    off = F.coalesce("p", F.lit(0.0)) - F.col("score")
    return both.agg(F.round(F.avg(F.abs(off)), 6).alias("mae"), F.round(F.sqrt(F.avg(off * off)), 6).alias("rmse"), F.count("*").alias("n"))


def best_of(grid: DataFrame) -> DataFrame:
    """The row of grid_search() of least mae; ties go to the smallest thresholds and alpha."""
    return grid.orderBy("mae", "user_threshold", "item_threshold", "alpha").limit(1)


def grid_search(by_users: DataFrame, by_items: DataFrame, test: DataFrame, train: DataFrame, alphas: list[float], thresholds: list[float] | None = None) -> DataFrame:
    """user_threshold, item_threshold, alpha, mae of every combination.

    ``by_users`` and ``by_items`` hold predictions with a threshold column each; all combinations
    are one join on (user, item) and one aggregate. ``thresholds`` are those of both; without them,
    a threshold that leaves no prediction at all has no row.
    """
    known = test.join(train.select("user_id").distinct(), "user_id", "left_semi")
    spark = test.sparkSession
    u = by_users.select("user_id", "item_id", "user_threshold", F.col("raw").alias("u"))
    i = by_items.select("user_id", "item_id", "item_threshold", F.col("raw").alias("i"))
    hit = known.join(u, ["user_id", "item_id"]).join(i, ["user_id", "item_id"]).withColumn("alpha", F.explode(F.array(*map(F.lit, map(float, alphas)))))
    gain = F.abs(F.col("u") * (1 - F.col("alpha")) + F.col("i") * F.col("alpha") - F.col("score")) - F.abs("score")
    found = hit.groupBy("user_threshold", "item_threshold", "alpha").agg(F.sum(gain).alias("gain"))
    # without a prediction a rating is wrong by itself: start from there and add what predictions change
    base = known.agg(F.sum(F.abs("score")).alias("all"), F.count("*").alias("n")).first()
    # the grid is as large as its parameters
    first, second = (thresholds or sorted(r[0] for r in rows.select(c).distinct().collect()) for rows, c in ((u, "user_threshold"), (i, "item_threshold")))
    grid = spark.createDataFrame([(float(x), float(y), float(a)) for x in first for y in second for a in alphas], "user_threshold double, item_threshold double, alpha double")
    out = grid.join(found, ["user_threshold", "item_threshold", "alpha"], "left")
    return out.select("user_threshold", "item_threshold", "alpha", F.round((F.lit(base["all"] or 0.0) + F.coalesce("gain", F.lit(0.0))) / max(1, base["n"]), 6).alias("mae"))
