"""Registered queries, their SQL, and the pipeline."""

import os
import shutil

import pytest

import corpus_pipeline
from basketry.llm import ngram_join
from basketry.llm.queries import ORACLE_SQL, QUERIES
from tests.oracles import SF, same_rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_names():
    import __spark_entry__

    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())


def test_other_queries_without_what_the_corpus_operators_need(monkeypatch):
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("basketry.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    assert "rules_brand" in __spark_entry__.queries() and "pipeline" not in __spark_entry__.queries()
    assert not any(n.startswith("op") for n in __spark_entry__.oracle_sql())


def test_rows_that_differ_in_other_columns_alone(spark):
    text = "The same words stand here again and again, for as long as a text of its own needs them to be. " * 4
    schema = "doc_id long, text string, lang string, source string, row_key int, _row_key int"
    rows = [(1, text, "en", None, 1, 5), (1, text, None, "en", 2, 4), (1, text, "en", "b", 3, 3), (2, None, "en", "x", 0, 0)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, schema).repartition(3)
        kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect())) == [(1, text, "en", None, 1, 5), (2, None, "en", "x", 0, 0)]
        assert corpus_pipeline.language_stage(spark, docs, SF).columns == docs.columns


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    same_rows(spark, QUERIES[name], ORACLE_SQL[name])


def test_stages(spark, tmp_path):
    """Each stage on what the one before wrote, with rows that test the edges."""
    for name in os.listdir(SF):
        shutil.copy(f"{SF}/{name}", tmp_path / name)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9003, "the house and all of that " * 60_000 + "x" * 50_000, "en", "long", 1), (9001, None, "en", "src1", 0), (9002, "", None, None, None), (None, "The and of it in that the house. " * 20, "en", "src1", 5)], docs.schema)
    rows = docs.unionByName(odd).unionByName(docs.limit(20))
    before = None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        after = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 3:
            assert after.columns == docs.columns
            assert after.exceptAll(rows).count() == 0  # rows as they were
            before = after.count()
            assert 0 < before <= rows.count()
        rows_before, rows = rows, after
    kept = spark.read.parquet(f"{tmp_path}/stage2")
    assert ngram_join.ngram_join(kept).filter("n_links > 0").count() == 0
    classes = ngram_join.ngram_classes(spark.read.parquet(f"{tmp_path}/stage1"))
    assert kept.count() == classes.select("class_pick").distinct().count()
    assert rows.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    assert rows.agg({"length": "max"}).first()[0] <= 4096


def test_stages_of_nothing(spark, tmp_path):
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.count() == 0
