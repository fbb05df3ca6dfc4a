"""Similarities of users or items from co-rated scores.

Where most pairs share a key, sums over shared keys are matrix products of strips of things: see
strips.py. Elsewhere it is one self-join on the shared key, one aggregate of n and sums, and the
measure is an expression of those. Pairs without a common key have similarity 0 and no row. A key
that many things share is cut into blocks of things, and its pairs of blocks are joined apart, so
that no task makes all pairs of a popular key. A thing has one score for a key: see one_score().
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.strips import Measure, lay_out
from basketry.storage import HOT_PARTS, materialize

#: Things of a block of a popular key.
BLOCK = 1024
#: What is summed up over the common keys of two things.
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "sdd")
#: Denominators nearer to zero count as zero.
EPSILON = 1e-9


def euclidean() -> Column:
    """1 / (1 + root of the summed squared differences)."""
    return 1 / (1 + F.sqrt(F.greatest(F.lit(0.0), F.col("sdd"))))


def pearson() -> Column:
    """Over common keys alone; 1 where it is undefined."""
    top = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    spread = F.greatest(F.lit(0.0), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) * F.greatest(F.lit(0.0), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))
    bottom = F.sqrt(spread)
    return F.when(bottom < EPSILON, F.lit(1.0)).otherwise(top / F.greatest(bottom, F.lit(EPSILON)))


def cosine() -> Column:
    """Of scores as they are given; 1 where it is undefined."""
    bottom = F.sqrt(F.col("sxx")) * F.sqrt(F.col("syy"))
    return F.when(bottom < EPSILON, F.lit(1.0)).otherwise(F.col("sxy") / F.greatest(bottom, F.lit(EPSILON)))


def _over(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    return np.where(bottom < EPSILON, 1.0, top / np.maximum(bottom, EPSILON))


def _pearson_of(s: dict[str, np.ndarray]) -> np.ndarray:
    n = np.maximum(s["n"], 1.0)
    spread = np.maximum(0.0, s["sxx"] - s["sx"] * s["sx"] / n) * np.maximum(0.0, s["syy"] - s["sy"] * s["sy"] / n)
    return _over(s["sxy"] - s["sx"] * s["sy"] / n, np.sqrt(spread))


#: The same measures over sums of a tile.
IN_TILES: dict[Callable[[], Column], Measure] = {
    euclidean: (("sdd",), lambda s: 1 / (1 + np.sqrt(s["sdd"]))),
    pearson: (("n", "sx", "sy", "sxx", "syy", "sxy"), _pearson_of),
    cosine: (("sxx", "syy", "sxy"), lambda s: _over(s["sxy"], np.sqrt(s["sxx"]) * np.sqrt(s["syy"]))),
}


def one_score(ratings: DataFrame) -> DataFrame:
    """user_id, item_id, score of the first rating (by ``ts``, if there is one) of each user and item; ties go to the least score."""
    first = F.struct("ts", "score") if "ts" in ratings.columns else F.struct("score")
    return ratings.groupBy("user_id", "item_id").agg(F.min(first).alias("first")).select("user_id", "item_id", F.col("first.score").alias("score"))


def stored(rows: DataFrame) -> DataFrame:
    """thing, key, score, written unless they are."""
    return rows if getattr(rows, "_stored_at", None) else materialize(rows.select("thing", "key", "score"), "rated")


def pair_sums(rows: DataFrame, block: int = BLOCK, only: tuple[str, ...] = SUMS) -> DataFrame:
    """a, b (a < b), n, sx, sy, sxx, syy, sxy, sdd, or those of them in ``only``, over (thing, key, score) rows that share a key."""
    rows = stored(rows)
    laid = lay_out(rows)
    return _joined_sums(rows, block).select("a", "b", *only) if laid is None else laid.pairs(only)


def _joined_sums(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # keys of more than a HOT_PARTS-th of all rows, so there are no more than HOT_PARTS
    popular = sizes.filter((F.col("n") > block) & (F.col("n") * HOT_PARTS > total)).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    cut = rows.join(F.broadcast(popular), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("thing"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("thing", "key", "score", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") - F.col("other")).alias("side"))
    a, b = cut.alias("a"), cut.alias("b")
    # within a block every pair, between two blocks those across
    here = (F.col("a.key") == F.col("b.key")) & (F.col("a.low") == F.col("b.low")) & (F.col("a.high") == F.col("b.high"))
    both = a.join(b, here & (F.col("a.thing") < F.col("b.thing")) & ((F.col("a.side") == 0) | (F.col("a.side") != F.col("b.side"))))
    x, y = F.col("a.score"), F.col("b.score")
    return both.groupBy(F.col("a.thing").alias("a"), F.col("b.thing").alias("b")).agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"), F.sum((x - y) * (x - y)).alias("sdd")
    )


def similarities(rows: DataFrame, measure: Callable[[], Column], target=None) -> DataFrame:
    """a, b (a < b), sim of all pairs with a common key; of those with ``target`` if it is given."""
    rows = stored(rows)
    laid = lay_out(rows) if target is None and measure in IN_TILES else None
    if laid is not None:
        return laid.pairs((), IN_TILES[measure])
    sums = _joined_sums(rows)
    sums = sums if target is None else sums.filter((F.col("a") == target) | (F.col("b") == target))
    return sums.select("a", "b", measure().alias("sim"))


def user_rows(ratings: DataFrame) -> DataFrame:
    return ratings.select(F.col("user_id").alias("thing"), F.col("item_id").alias("key"), "score")


def item_rows(ratings: DataFrame) -> DataFrame:
    """The transposed matrix."""
    return ratings.select(F.col("item_id").alias("thing"), F.col("user_id").alias("key"), "score")


def user_similarities(ratings: DataFrame, measure: Callable[[], Column] = pearson, target=None) -> DataFrame:
    return similarities(user_rows(one_score(ratings)), measure, target)


def item_similarities(ratings: DataFrame) -> DataFrame:
    """Adjusted cosine: scores less the mean of all of their user's."""
    mean = F.avg("score").over(Window.partitionBy("user_id"))
    return similarities(item_rows(one_score(ratings).withColumn("score", F.col("score") - mean)), cosine)


def both_ways(sims: DataFrame) -> DataFrame:
    """thing, other, sim."""
    return sims.select(F.col("a").alias("thing"), F.col("b").alias("other"), "sim").union(sims.select("b", "a", "sim"))


def top_matches(sims: DataFrame, target, k: int) -> DataFrame:
    """other, sim: the k things most similar to ``target``, ties by id."""
    return both_ways(sims).filter(F.col("thing") == target).select("other", "sim").orderBy(F.desc(F.round("sim", 9)), "other").limit(k)
