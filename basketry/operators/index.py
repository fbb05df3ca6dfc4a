"""Inverted indexes over (item, record_id[, key_info]) rows.

The index is a table of postings, one row per item and record; lookups and intersections are
filters and aggregates on it, and lists stay rows, so that a frequent item's list is never whole in
one place. Written with write(), it is bucketed by item: lookups and joins on the item need no
shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.dictionary import with_places
from basketry.storage import join_hot, materialize

#: Ids that are sent to all tasks; beyond that, joins are shuffled.
FEW = 1_000_000


def build(rows: DataFrame) -> DataFrame:
    """item, key_info, record_id: each item and record once.

    An item's key_info is the one it came with first: that of its least ``seq`` if there is such a
    column, else of its least record; ties go to the least key_info.
    """
    if "key_info" not in rows.columns:
        return rows.select("item", F.lit(None).cast("string").alias("key_info"), "record_id").distinct()
    seq = F.col("seq") if "seq" in rows.columns else F.col("record_id")
    told = rows.select("item", "record_id", F.struct(seq.alias("seq"), F.col("key_info").alias("info")).alias("came"))
    first = told.groupBy("item").agg(F.min("came").alias("first"), F.count("*").alias("n"))
    postings = told.select("item", "record_id").distinct()
    total = rows.count()
    return join_hot(postings, first.select("item", F.col("first.info").alias("key_info"), "n"), ["item"], "n", total).select("item", "key_info", "record_id")


def write(index: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> None:
    """Save an index as a table bucketed and sorted by item, under ``path`` if it is given."""
    writer = index.write.mode("overwrite").bucketBy(buckets, "item").sortBy("item", "record_id")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def local_catalogs(index: DataFrame, parts: int) -> DataFrame:
    """part, item, df: what each of ``parts`` shares of the records holds of an item."""
    return index.groupBy(F.pmod(F.xxhash64("record_id"), F.lit(parts)).cast("int").alias("part"), "item").agg(F.count("*").alias("df"))


def consolidate(catalogs: DataFrame) -> DataFrame:
    """item, df over all parts of local_catalogs()."""
    return catalogs.groupBy("item").agg(F.sum("df").alias("df"))


def document_frequencies(index: DataFrame) -> DataFrame:
    """item, df."""
    return index.groupBy("item").agg(F.count("*").alias("df"))


def frequencies_of_words(docs: DataFrame, words: Callable[[DataFrame], DataFrame], id_col: str = "doc_id") -> DataFrame:
    """item, df: in how many records each item is, where ``words`` gives tid, item of ``docs``, each item of a row once.

    Only words of ids that several rows have are told apart by id before they are counted, so that
    those of all others are summed up where they are found.
    """
    repeated = materialize(docs.groupBy(id_col).agg(F.count("*").alias("n")).filter(F.col("n") > 1).select(id_col), "repeated-ids")
    how_many = repeated.count()
    if not how_many:
        return words(docs).groupBy("item").agg(F.count("*").alias("df"))
    few = F.broadcast if how_many <= FEW else lambda rows: rows
    same = docs[id_col].eqNullSafe(repeated[id_col])
    once, often = words(docs.join(few(repeated), same, "left_anti")), words(docs.join(few(repeated), same, "left_semi"))
    found = once.groupBy("item").agg(F.count("*").alias("df")).unionByName(often.select("tid", "item").distinct().groupBy("item").agg(F.count("*").alias("df")))
    return found.groupBy("item").agg(F.sum("df").alias("df"))


def find_records(index: DataFrame, item: str) -> DataFrame:
    """record_id, descending, of one item."""
    return index.filter(F.col("item") == item).select("record_id").orderBy(F.desc("record_id"))


def ranked_postings(index: DataFrame) -> DataFrame:
    """item, record_id, place: an item's records from the last one down."""
    return with_places(index.select("item", "record_id"), "item", F.col("record_id").desc(), "place")


def intersect(index: DataFrame, items: list[str]) -> DataFrame:
    """record_id of records with every one of ``items``; a missing item leaves none."""
    wanted = sorted(set(items))
    if not wanted:
        raise ValueError("at least one item is needed")
    hits = index.filter(F.col("item").isin(wanted))
    return hits.groupBy("record_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("record_id")


def key_info(index: DataFrame, item: str) -> DataFrame:
    """key_info of one item."""
    return index.filter(F.col("item") == item).agg(F.min("key_info").alias("key_info"))


def change_key_info(index: DataFrame, item: str, info: str) -> DataFrame:
    """The index with another key_info for one item."""
    return index.withColumn("key_info", F.when(F.col("item") == item, F.lit(info)).otherwise(F.col("key_info")))


def size_of(index: DataFrame) -> DataFrame:
    """terms, postings, longest: how large the index is."""
    return document_frequencies(index).agg(F.count("*").alias("terms"), F.sum("df").alias("postings"), F.max("df").alias("longest"))
