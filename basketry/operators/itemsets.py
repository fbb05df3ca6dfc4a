"""Frequent itemsets, level by level.

All strategies return k, itemset (ascending array), support, and agree. Items that can't be frequent
go before any basket is put together; what is left of a basket is one array, so pairs and longer
itemsets are made inside rows, without a join on the basket, and counted by aggregates that combine
on the map side. Where many baskets are equal, they are one row with their number. Levels loop on the
driver, at most ``max_k`` times, and each makes its itemsets from the baskets anew: what baskets hold
is never written itemset by itemset. Rows without a basket or an item don't count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.sets import subsets_of_size_less_one
from basketry.params import MiningParams
from basketry.storage import discard, materialize

#: Items or itemsets that are sent to all tasks; beyond that, joins are shuffled.
FEW = 200_000
#: Equal baskets are put together if there are so many times fewer different ones.
ALIKE = 2


@dataclass
class Frequent:
    """Itemsets (k, itemset, support), the number of baskets, and the support asked for."""

    itemsets: DataFrame
    baskets: int
    least: int


def _few(rows: DataFrame) -> DataFrame:
    """``rows``, to be broadcast if they are counted as few."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


@dataclass
class Start:
    """What every miner begins with; given to several, it is made once.

    ``base`` holds tid, items (ascending) of baskets, reduced to items that may be frequent; in
    ``kinds``, with n, equal baskets are one row. ``items`` are the frequent ones.
    """

    base: DataFrame
    kinds: DataFrame
    items: DataFrame
    baskets: int
    least: int

    def end(self) -> None:
        discard(self.base)
        discard(self.kinds)


def start(occ: DataFrame, params: MiningParams) -> Start:
    rows = occ.select("tid", "item").filter(F.col("tid").isNotNull() & F.col("item").isNotNull())
    no_tid, no_item = (F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("tid", "item"))
    # one scan gives the baskets and how often each item occurs, which is no less than in how many baskets
    each = rows.select(F.inline(F.array(F.struct(F.col("tid"), no_item), F.struct(no_tid, F.col("item")))))
    seen = materialize(each.groupBy("tid", "item").agg(F.count("*").alias("n")), "seen")
    baskets = seen.filter(F.col("item").isNull()).count()
    least = params.least_count(baskets)
    often = seen.filter(F.col("item").isNotNull() & (F.col("n") >= least)).select("item")
    base = materialize(rows.join(_few(often), "item", "left_semi").groupBy("tid").agg(F.array_sort(F.collect_set("item")).alias("items")), "baskets")
    discard(seen)
    kinds = _together(base)
    items = kinds.select(F.explode("items").alias("item"), "n").groupBy("item").agg(F.sum("n").alias("support"))
    return Start(base, kinds, materialize(items.filter(F.col("support") >= least), "items"), baskets, least)


def _together(base: DataFrame) -> DataFrame:
    """``base`` with n, the number of equal baskets, each of which is there once if that saves much."""
    told = base.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64("items")).alias("kinds")).first()
    if told["kinds"] * ALIKE > told["rows"]:
        return base.withColumn("n", F.lit(1).cast("long"))
    return materialize(base.groupBy("items").agg(F.min("tid").alias("tid"), F.count("*").alias("n")).select("tid", "items", "n"), "kinds")


def candidates(level: DataFrame) -> DataFrame:
    """itemset: unions of two of a level's itemsets that differ in the last item, all of whose subsets are in the level."""
    sets = level.select("itemset", F.slice("itemset", 1, F.size("itemset") - 1).alias("prefix"), F.element_at("itemset", -1).alias("last"))
    a, b = sets.alias("a"), sets.alias("b")
    joined = a.join(b, (F.col("a.prefix") == F.col("b.prefix")) & (F.col("a.last") < F.col("b.last")))
    joined = joined.select(F.concat(F.col("a.itemset"), F.array(F.col("b.last"))).alias("itemset"))
    parts = joined.withColumn("part", F.explode(subsets_of_size_less_one(F.col("itemset"))))
    held = parts.join(level.select(F.col("itemset").alias("part")), "part", "left_semi")
    return held.groupBy("itemset").agg(F.count("*").alias("n")).filter(F.col("n") == F.size("itemset")).select("itemset")


def _pairs(base: DataFrame) -> DataFrame:
    """items, n, itemset of every two items of a basket; made one after the other, never all of a basket at once."""
    first = base.select("items", "n", F.posexplode("items").alias("at", "first"))
    later = F.slice("items", F.col("at") + 2, F.greatest(F.size("items") - F.col("at") - 1, F.lit(0)))
    return first.select("items", "n", "first", F.explode(later).alias("second")).select("items", "n", F.array("first", "second").alias("itemset"))


def _longer(rows: DataFrame) -> DataFrame:
    """``rows`` (items, n, itemset) with each later item of the basket added."""
    more = F.explode(F.filter("items", lambda x: x > F.element_at("itemset", -1)))
    return rows.select("items", "n", "itemset", more.alias("more")).select("items", "n", F.concat("itemset", F.array("more")).alias("itemset"))


def _levels(occ: DataFrame | Start, params: MiningParams, pair_filter=None) -> Frequent:
    begun = occ if isinstance(occ, Start) else start(occ, params)
    base, least = begun.kinds, begun.least
    level = begun.items.select(F.lit(1).alias("k"), F.array("item").alias("itemset"), "support")
    found, rows = level, None
    for k in range(2, params.max_k + 1):
        if k == 2:
            rows = _pairs(base) if pair_filter is None else pair_filter(_pairs(base), least)
        else:
            # the rows of the level before, of which those that are frequent go on
            before = rows.join(_few(level.select("itemset")), "itemset", "left_semi")
            rows = _longer(before).join(_few(materialize(candidates(level), "candidates")), "itemset", "left_semi")
        level = rows.groupBy("itemset").agg(F.sum("n").alias("support")).filter(F.col("support") >= least)
        level = materialize(level.select(F.lit(k).alias("k"), "itemset", "support"), "level")
        if level.isEmpty():
            break
        found = found.union(level)
    if begun is not occ:
        begun.end()
    return Frequent(found, begun.baskets, least)


def apriori(occ: DataFrame | Start, params: MiningParams) -> Frequent:
    """Levels of candidates that are closed under subsets, each counted by a join on the basket."""
    return _levels(occ, params)


def dhp(occ: DataFrame | Start, params: MiningParams, buckets: int = 1 << 16) -> Frequent:
    """As apriori(), with pairs first counted in hash buckets: only pairs of a heavy bucket are counted exactly."""

    def heavy(rows: DataFrame, least: int) -> DataFrame:
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("itemset"), F.lit(buckets)))
        kept = rows.groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("bucket")
        # no more rows than buckets
        return rows.join(_few(materialize(kept, "buckets")), "bucket", "left_semi").drop("bucket")

    return _levels(occ, params, heavy)


def fp_growth(occ: DataFrame | Start, params: MiningParams) -> Frequent:
    """Prefix trees over frequency-ordered baskets, grown in parallel by Spark's own miner."""
    from pyspark.ml.fpm import FPGrowth

    begun = occ if isinstance(occ, Start) else start(occ, params)
    base, baskets, least = begun.base, begun.baskets, begun.least
    # half a basket below the count: the miner rounds its threshold up. It counts the rows it is given, which are those with a frequent item
    rows = base.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, rows))).fit(base)
    sets = model.freqItemsets.filter((F.size("items") <= params.max_k) & (F.col("freq") >= least))
    return Frequent(sets.select(F.size("items").alias("k"), F.array_sort("items").alias("itemset"), F.col("freq").alias("support")), baskets, least)


def _postings(kinds: DataFrame, chunk_baskets: int) -> DataFrame:
    """item, chunk, tids: posting lists cut by a hash of the basket into chunks of bounded length.

    A basket that stands for n is in the lists of each bit of n, where it counts as much as the bit.
    """
    chunks = max(1, -(-kinds.count() // chunk_baskets))
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda b: F.getbit("n", b) == 1)).alias("bit")
    rows = kinds.select("tid", "items", bit).select("tid", "bit", F.explode("items").alias("item"))
    return rows.groupBy("item", F.struct(F.pmod(F.xxhash64("tid"), F.lit(chunks)).alias("part"), "bit").alias("chunk")).agg(F.collect_list("tid").alias("tids"))


def vertical(occ: DataFrame | Start, params: MiningParams, chunk_baskets: int = 1 << 14) -> Frequent:
    """One scan builds an inverted index; a support is the size of the intersection of posting lists.

    Lists are intersected chunk by chunk, so neither a list nor an intersection is ever whole in
    one task, and the chunks' counts are summed.
    """
    begun = occ if isinstance(occ, Start) else start(occ, params)
    least = begun.least
    lists = materialize(_postings(begun.kinds, chunk_baskets), "postings")
    level = begun.items.select(F.lit(1).alias("k"), F.array("item").alias("itemset"), "support")
    found, held = level, lists.select(F.array("item").alias("itemset"), "chunk", "tids")
    for k in range(2, params.max_k + 1):
        wanted = candidates(level).withColumn("prefix", F.slice("itemset", 1, k - 1)).withColumn("item", F.element_at("itemset", -1))
        rows = wanted.join(held.withColumnRenamed("itemset", "prefix"), "prefix").join(lists.withColumnRenamed("tids", "more"), ["item", "chunk"])
        rows = rows.select("itemset", "chunk", F.array_intersect("tids", "more").alias("tids")).filter(F.size("tids") > 0)
        rows = materialize(rows, "intersections")
        level = rows.groupBy("itemset").agg(F.sum(F.call_function("shiftleft", F.size("tids").cast("long"), F.col("chunk.bit"))).alias("support")).filter(F.col("support") >= least)
        level = materialize(level.select(F.lit(k).alias("k"), "itemset", "support"), "level")
        if level.isEmpty():
            break
        found = found.union(level)
        held = rows.join(level.select("itemset"), "itemset", "left_semi")
    if begun is not occ:
        begun.end()
    return Frequent(found, begun.baskets, least)


def push(found: DataFrame, more: DataFrame) -> DataFrame:
    """``found`` with the itemsets of ``more`` that it does not have; those it has keep their support."""
    return found.unionByName(more.join(found.select("itemset"), "itemset", "left_anti").select(*found.columns))


def support_of(found: DataFrame, itemset: Column) -> DataFrame:
    """Rows of ``found`` with that itemset."""
    return found.filter(F.col("itemset") == itemset)


MINERS = {"apriori": apriori, "dhp": dhp, "fp_growth": fp_growth, "vertical": vertical}


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """k, itemset, problem: missing (in left only), redundant (in right only), differing (in support)."""
    a, b = left.select("itemset", F.col("k").alias("ka"), F.col("support").alias("a")), right.select("itemset", F.col("k").alias("kb"), F.col("support").alias("b"))
    both = a.join(b, "itemset", "full")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "redundant").when(F.col("a") != F.col("b"), "differing")
    return both.select(F.coalesce("ka", "kb").alias("k"), "itemset", problem.alias("problem")).filter(F.col("problem").isNotNull())
