"""Item dictionaries: dense ids that depend on the items alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.storage import materialize


def placed(rows: DataFrame, *by: Column) -> tuple[DataFrame, dict[int, int]]:
    """``rows`` in the order of ``by``, with _part and _row (from 0 in its part), and where each part begins.

    Rows are range-partitioned and numbered where they lie; only the parts' sizes, a number each, go
    through the driver, so no task numbers all rows and nothing is shuffled twice.
    """
    number = F.monotonically_increasing_id()  # the partition, times 2^33, and the row in it
    sorted_ = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_number", number)
    out = materialize(sorted_.withColumn("_part", F.shiftright("_number", 33).cast("int")).withColumn("_row", F.col("_number").bitwiseAND(F.lit((1 << 33) - 1))).drop("_number"), "placed")
    begin, at = {}, 0
    for part, size in sorted((r["_part"], r["count"]) for r in out.groupBy("_part").count().collect()):
        begin[part], at = at, at + size
    return out, begin


def _begin(begin: dict[int, int]) -> Column:
    return F.create_map(*(F.lit(x) for pair in begin.items() for x in pair))[F.col("_part")] if begin else F.lit(0)


def with_dense_ids(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` with a column of ids from 0, ascending in ``by``, whose values are all different."""
    out, begin = placed(rows, F.col(by).asc())
    return out.withColumn(name, (F.col("_row") + _begin(begin)).cast("long")).drop("_part", "_row")


def with_places(rows: DataFrame, key: str, by: Column, name: str) -> DataFrame:
    """``rows`` with each one's place, from 1, among those of its key in the order of ``by``.

    A key's rows lie in a run of parts, so that a hot key is never whole in one task: its first row
    in each part, of which there are no more than keys and parts together, says how many come before.
    """
    out, begin = placed(rows, F.col(key).asc(), by)
    at = F.col("_row") + _begin(begin)
    first = out.groupBy(key).agg(F.min(at).alias("_first"))
    edge = out.groupBy("_part").agg(F.min(key).alias("_low"), F.max(key).alias("_high")).select(F.inline(F.array(F.struct("_part", F.col("_low").alias(key)), F.struct("_part", F.col("_high").alias(key)))))
    # keys that may lie in several parts are the first or last of one: at most two a part
    wide = materialize(first.join(F.broadcast(edge.select(key).distinct()), key, "left_semi"), "wide-keys")
    rest = out.join(F.broadcast(wide.select(key)), key, "left_anti")
    inner = rest.join(rest.groupBy("_part", key).agg(F.min("_row").alias("_least")), ["_part", key]).withColumn(name, F.col("_row") - F.col("_least") + 1).drop("_least")
    outer = out.join(F.broadcast(wide), key).withColumn(name, at - F.col("_first") + 1).drop("_first")
    return inner.unionByName(outer).withColumn(name, F.col(name).cast("long")).drop("_part", "_row")


def item_dictionary(occ: DataFrame) -> DataFrame:
    """item_id, item: the distinct items in ascending order."""
    return with_dense_ids(occ.select("item").distinct(), "item", "item_id").select("item_id", "item")


def frequency_order(occ: DataFrame) -> DataFrame:
    """item, support, rank: the most frequent item first, ties by item."""
    counts = occ.distinct().groupBy("item").agg(F.count("*").alias("support"))
    counts = counts.withColumn("_key", F.struct((-F.col("support")).alias("s"), F.col("item").alias("i")))
    return with_dense_ids(counts, "_key", "rank").select("item", "support", (F.col("rank") + 1).alias("rank"))
