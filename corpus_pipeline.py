"""The corpus pipeline: quality classifier, language identification, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return rows of
``docs`` with its columns. A stage decides on keys of rows alone, and fetches whole rows by one
semi or anti join: the keys to drop are broadcast while they are few, else the join is shuffled.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import best_fit_packing, language_id, ngram_join, quality_classifier
from basketry.llm.common import discard, materialize

#: Keys (8 bytes each) that may be broadcast.
FEW_KEYS = 2_000_000


def _without(docs: DataFrame, key: Column, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is not in ``dropped`` (one column, key)."""
    dropped = materialize(dropped.distinct(), "dropped")
    if dropped.count() <= FEW_KEYS:
        dropped = F.broadcast(dropped)
    named = dropped.withColumnRenamed("key", "_dropped_key")
    return docs.join(named, key == named["_dropped_key"], "left_anti")


def _new_name(docs: DataFrame) -> str:
    """A name that no column has."""
    name = "row_key"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above the score quantile."""
    model, _ = quality_classifier.fit_whole(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.accepted(docs, model)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    # nulls are hashed by flags of their own, as the hash itself skips them
    key = F.xxhash64(*(x for c in ("doc_id", "text", "lang", "source") for x in (F.col(c), F.col(c).isNull())))
    name = _new_name(docs)
    rows = language_id.document_rows(docs.withColumn(name, key), id_col=name)
    found = language_id.identify(rows, language_id.text_model(docs))
    return _without(docs, key, found.filter(~F.col("accepted")).select(F.col("id").alias("key")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one of least id."""
    classes = materialize(ngram_join.ngram_classes(docs), "classes")
    key = ngram_join.row_key()
    kept = _without(docs, key, classes.filter(F.col("pick") != F.col("class_pick")).select(F.col("pick").alias("key")))
    # rows that repeat an id and a text share a key, and all of them are still there
    twice = materialize(classes.groupBy(F.col("pick").alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select("key"), "repeated")
    if not twice.take(1):
        return kept
    once = _without(kept, key, twice)
    # of rows that differ in other columns alone, the first one in the order of their JSON stands
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    several = kept.select(key.alias("key"), row.alias("row")).join(twice, "key", "left_semi")
    again = several.groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return once.unionByName(again)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of the remaining documents, in sequences."""
    # a worker still holds what earlier stages left in it, so its cache is smaller than by default
    return best_fit_packing.packing(docs, public_tokenizers.path("word_bpe_49k.json"), cache_entries=300_000)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, rows = rows, stage(spark, rows, sf_dir)
        if k < len(STAGES) - 1:
            rows = materialize(rows, name.replace(" ", "-"))
        discard(before)  # the last stage has written its pieces by now
    return rows
