"""Neighbourhood recommenders: user_id, item_id, raw, score (raw rounded) for items a user has not rated.

Of a user's repeated ratings of an item the first one counts, as one_score() says.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.similarity import IN_TILES, both_ways, item_similarities, one_score, pearson, stored, user_rows, user_similarities
from basketry.operators.strips import lay_out
from basketry.params import CFParams, rounded
from basketry.storage import materialize

#: Rules' parts that are sent to all tasks; beyond that, joins are shuffled.
FEW = 200_000


def _finish(weighted: DataFrame, ratings: DataFrame, params: CFParams) -> DataFrame:
    """Weighted means of (user_id, item_id, weight, value), for items not rated, and the best of each user."""
    sums = weighted.groupBy("user_id", "item_id").agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("raw"))
    return _scored(sums.join(ratings.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti"), params)


def _scored(sums: DataFrame, params: CFParams) -> DataFrame:
    # six digits first, so that the order of summation can't tip a half
    out = sums.withColumn("raw", F.round("raw", 6)).withColumn("score", rounded(F.col("raw"), params.rounding).cast("double"))
    return top_n(out, params.top_n)


def top_n(predicted: DataFrame, n: int) -> DataFrame:
    """Each user's n best by raw value, ties by item; all for 0."""
    if not n:
        return predicted
    best = Window.partitionBy("user_id").orderBy(F.desc("raw"), "item_id")
    return predicted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).drop("rank")


def _others(ratings: DataFrame, measure: Callable[[], Column], thresholds: list[float], centred: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """``ratings`` of one_score(), stored, and user_id, item_id, step, top, bottom of items not rated: see Layout.weighted(). None for those where users are better joined."""
    rows = stored(user_rows(ratings))
    laid = lay_out(rows) if measure in IN_TILES else None
    found = laid and laid.weighted(IN_TILES[measure], thresholds, centred).withColumnsRenamed({"thing": "user_id", "key": "item_id"})
    return rows.select(F.col("thing").alias("user_id"), F.col("key").alias("item_id"), "score"), found


def user_based(ratings: DataFrame, params: CFParams = CFParams(), measure: Callable[[], Column] = pearson, target=None, sims: DataFrame | None = None) -> DataFrame:
    """Mean of similar users' scores, weighted by similarity; of one user if ``target`` is given."""
    ratings = one_score(ratings)
    if target is None and sims is None:
        ratings, sums = _others(ratings, measure, [params.threshold])
        if sums is not None:
            return _scored(sums.select("user_id", "item_id", (F.col("top") / F.col("bottom")).alias("raw")), params)
    near = both_ways(user_similarities(ratings, measure, target) if sims is None else sims).filter(F.col("sim") > params.threshold)
    if target is not None:
        near = near.filter(F.col("thing") == target)
    theirs = near.join(ratings.withColumnRenamed("user_id", "other"), "other")
    return _finish(theirs.select(F.col("thing").alias("user_id"), "item_id", F.col("sim").alias("weight"), F.col("score").alias("value")), ratings, params)


def item_neighbours(ratings: DataFrame, threshold: float, sims: DataFrame | None = None) -> DataFrame:
    """item_id, other_id, sim, rnk: an item's most similar ones, a share 1 - threshold of all items, above the threshold."""
    ratings = one_score(ratings)
    items = ratings.select("item_id").distinct().count()
    k = min(max(items - 1, 0), math.floor(items * (1 - threshold) + 1e-9))
    order = Window.partitionBy("item_id").orderBy(F.desc(F.round("sim", 9)), "other_id")
    near = both_ways(item_similarities(ratings) if sims is None else sims).select(F.col("thing").alias("item_id"), F.col("other").alias("other_id"), "sim")
    # those above the threshold come first in the order, so the others need not be ranked
    return near.filter(F.col("sim") > threshold).withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= k)


def item_based(ratings: DataFrame, params: CFParams = CFParams(), target=None, neighbours: DataFrame | None = None) -> DataFrame:
    """Mean of a user's own scores of an item's neighbours, weighted by similarity."""
    ratings = one_score(ratings)
    near = item_neighbours(ratings, params.threshold) if neighbours is None else neighbours
    mine = ratings if target is None else ratings.filter(F.col("user_id") == target)
    rows = mine.join(near, "item_id").select("user_id", F.col("other_id").alias("item_id"), F.col("sim").alias("weight"), F.col("score").alias("value"))
    return _finish(rows, mine, params)


def _at_thresholds(rows: DataFrame, column: str) -> DataFrame:
    """user_id, item_id, ``column``, raw from (user_id, item_id, weight, value, holds): weighted means at each threshold that a row holds for."""
    each = rows.withColumn(column, F.explode("holds")).groupBy("user_id", "item_id", column)
    return each.agg(F.round(F.sum(F.col("weight") * F.col("value")) / F.sum("weight"), 6).alias("raw"))


def user_based_at(ratings: DataFrame, thresholds: list[float], wanted: DataFrame) -> DataFrame:
    """user_id, item_id, user_threshold, raw of user_based() at each threshold, for the (user, item) pairs in ``wanted``; similarities are taken once."""
    ratings, sums = _others(one_score(ratings), pearson, thresholds)
    steps = F.array(*map(F.lit, thresholds))
    if sums is not None:
        found = sums.join(wanted.select("user_id", "item_id"), ["user_id", "item_id"])
        return found.select("user_id", "item_id", F.element_at(steps, F.col("step") + 1).alias("user_threshold"), F.round(F.col("top") / F.col("bottom"), 6).alias("raw"))
    near = both_ways(user_similarities(ratings)).filter(F.col("sim") > min(thresholds))
    theirs = near.join(ratings.withColumnRenamed("user_id", "other"), "other").withColumnRenamed("thing", "user_id")
    pairs = wanted.select("user_id", "item_id").join(ratings.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    rows = theirs.join(pairs, ["user_id", "item_id"]).withColumn("holds", F.filter(steps, lambda t: F.col("sim") > t))
    return _at_thresholds(rows.select("user_id", "item_id", F.col("sim").alias("weight"), F.col("score").alias("value"), "holds"), "user_threshold")


def item_based_at(ratings: DataFrame, thresholds: list[float], wanted: DataFrame) -> DataFrame:
    """user_id, item_id, item_threshold, raw of item_based() at each threshold, for the (user, item) pairs in ``wanted``; similarities are taken once."""
    ratings = one_score(ratings)
    items = ratings.select("item_id").distinct().count()
    steps = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(min(max(items - 1, 0), math.floor(items * (1 - t) + 1e-9))).alias("k")) for t in thresholds))
    near = item_neighbours(ratings, min(thresholds))
    holds = F.transform(F.filter(steps, lambda s: (F.col("sim") > s["t"]) & (F.col("rnk") <= s["k"])), lambda s: s["t"])
    near = near.withColumn("holds", holds).withColumnsRenamed({"item_id": "mine", "other_id": "item_id"})
    pairs = wanted.select("user_id", "item_id").join(ratings.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    rows = ratings.withColumnRenamed("item_id", "mine").join(near, "mine").join(pairs, ["user_id", "item_id"])
    return _at_thresholds(rows.select("user_id", "item_id", F.col("sim").alias("weight"), F.col("score").alias("value"), "holds"), "item_threshold")


def mean_centred(ratings: DataFrame, params: CFParams = CFParams(), measure: Callable[[], Column] = pearson) -> DataFrame:
    """A user's mean, plus similar users' deviations from theirs, weighted by the similarity's size."""
    ratings, sums = _others(one_score(ratings), measure, [params.threshold], centred=True)
    means = ratings.groupBy("user_id").agg(F.avg("score").alias("mean"))
    if sums is None:
        near = both_ways(user_similarities(ratings, measure)).filter(F.abs("sim") > params.threshold)
        theirs = ratings.join(means, "user_id").select(F.col("user_id").alias("other"), "item_id", (F.col("score") - F.col("mean")).alias("value"))
        rows = near.join(theirs, "other").select(F.col("thing").alias("user_id"), "item_id", F.col("sim"), "value")
        sums = rows.groupBy("user_id", "item_id").agg((F.sum(F.col("sim") * F.col("value")) / F.sum(F.abs("sim"))).alias("above"))
        sums = sums.join(ratings.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    else:
        sums = sums.select("user_id", "item_id", (F.col("top") / F.col("bottom")).alias("above"))
    out = sums.join(means, "user_id").select("user_id", "item_id", F.round(F.col("mean") + F.col("above"), 6).alias("raw"))
    return top_n(out.withColumn("score", rounded(F.col("raw"), params.rounding).cast("double")), params.top_n)


def hybrid(by_users: DataFrame, by_items: DataFrame, alpha: float) -> DataFrame:
    """user_id, item_id, raw: (1 - alpha) of the user-based and alpha of the item-based value, where both exist."""
    u, i = by_users.select("user_id", "item_id", F.col("raw").alias("u")), by_items.select("user_id", "item_id", F.col("raw").alias("i"))
    return u.join(i, ["user_id", "item_id"]).select("user_id", "item_id", F.round(F.col("u") * (1 - alpha) + F.col("i") * alpha, 6).alias("raw"))


def rule_based(ratings: DataFrame, rules: DataFrame) -> DataFrame:
    """user_id, item_id, raw: scores of antecedents' items, weighted by confidence, over the rules whose antecedent a user has rated whole.

    Items already rated are predicted too, and nothing is rounded to a whole score.
    """
    ratings = one_score(ratings)
    # rules of one antecedent hold for the same users, and their confidences for an item add up
    gives = rules.select("antecedent", "confidence", F.explode("consequent").alias("item_id")).groupBy("antecedent", "item_id").agg(F.sum("confidence").alias("confidence"))
    gives = materialize(gives.withColumn("rule", F.xxhash64(F.size("antecedent"), "antecedent")), "gives")
    small = gives.count() <= FEW
    few = F.broadcast if small else lambda rows: rows
    antecedents = gives.select("rule", "antecedent").distinct()
    needs = antecedents.select("rule", F.size("antecedent").alias("needed"), F.explode("antecedent").alias("item_id"))
    if small:
        # where rules are sent to all tasks, a user stays in one from here on, and what the rules give isn't shuffled
        ratings = ratings.repartition(int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions")), "user_id")
    held = ratings.join(few(needs), "item_id").groupBy("user_id", "rule", "needed").agg(F.count("*").alias("n"), F.sum("score").alias("scores"))
    held = held.filter(F.col("n") == F.col("needed"))
    rows = held.join(few(gives.select("rule", "item_id", "confidence")), "rule")
    return rows.groupBy("user_id", "item_id").agg(F.round(F.sum(F.col("confidence") * F.col("scores")) / F.sum(F.col("confidence") * F.col("n")), 6).alias("raw"))
