"""Counters of items, of pairs and of k-tuples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_supports(occ: DataFrame, mode: str = "distinct") -> DataFrame:
    """item, support: baskets with the item, or (mode ``occurrence``) its occurrences."""
    if mode not in ("distinct", "occurrence"):
        raise ValueError("mode is distinct or occurrence")
    rows = occ.select("tid", "item")
    return (rows.distinct() if mode == "distinct" else rows).groupBy("item").agg(F.count("*").alias("support"))


def multiplicities(occ: DataFrame) -> DataFrame:
    """tid, item, cnt: how often a basket repeats an item."""
    return occ.groupBy("tid", "item").agg(F.count("*").alias("cnt"))


def pair_counter(tuples: DataFrame) -> DataFrame:
    """i, j, n: sums over (i, j, n) without regard to order; pairs of one id are not counted."""
    low, high = F.least("i", "j"), F.greatest("i", "j")
    return tuples.filter(F.col("i") != F.col("j")).groupBy(low.alias("i"), high.alias("j")).agg(F.sum("n").alias("n"))


def tuple_counter(tuples: DataFrame, k: int) -> DataFrame:
    """key (ascending), n: sums over (key, n); keys that repeat an id, or are not of k ids, are not counted."""
    sound = (F.size("key") == k) & (F.size(F.array_distinct("key")) == k)
    return tuples.filter(sound).groupBy(F.array_sort("key").alias("key")).agg(F.sum("n").alias("n"))


def pair_buckets(occ_ids: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: pairs of a basket's items (tid, item_id) by a hash of the pair; collisions add up."""
    a, b = occ_ids.alias("a"), occ_ids.alias("b")
    pairs = a.join(b, (F.col("a.tid") == F.col("b.tid")) & (F.col("a.item_id") < F.col("b.item_id")))
    bucket = (F.col("a.item_id") * 31 + F.col("b.item_id")) % buckets
    return pairs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
