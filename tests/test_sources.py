import pytest
from pyspark.sql import functions as F

from basketry.functions import sets
from basketry.functions.text import basket_items, polynomial_hash
from basketry.operators import index
from basketry.sources import files
from basketry.sources.memory import memory_baskets


def test_xml_baskets(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<dataroot><records><record><tid>1</tid><data> a , b,c</data></record><record><tid>2</tid><data>a,,b,a</data></record></records></dataroot>")
    (tmp_path / "b.xml").write_text("<dataroot><records><record><tid>3</tid><data>x</data></record></records></dataroot>")
    rows = sorted(map(tuple, files.xml_baskets(spark, str(tmp_path)).collect()))
    assert rows == [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "a"), (2, "b"), (3, "x")]


def test_text_documents_decode(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes("数据 mining".encode("gb2312"))
    (tmp_path / "a.txt").write_bytes("plain text".encode("gb2312"))
    rows = files.text_documents(spark, str(tmp_path), "GBK").orderBy("tid").collect()
    assert [tuple(r) for r in rows] == [(0, "a.txt", "plain text"), (1, "b.txt", "数据 mining")]


def test_document_words(spark):
    docs = spark.createDataFrame([(1, "Dogs bark. dogs RUN far"), (2, None)], "doc_id long, text string")
    rows = {r["item"]: (r["cnt"], r["positions"], r["length"]) for r in files.document_words(docs).collect()}
    assert rows == {"dogs": (2, [0, 11], 4), "bark": (1, [5], 4)}
    rows = {r["item"]: (r["positions"], r["length"]) for r in files.document_words(spark.createDataFrame([(1, "日本語 Größe, größe 語語語語")], "doc_id long, text string")).collect()}
    assert rows == {"größe": ([10, 19], 7), "語語語語": ([27], 12)}


def test_word_classes(spark):
    rows = spark.createDataFrame([(1, "Ann", "nr", 5), (1, "run", "vn", 2), (1, "of", "p", 3), (1, "big", "a", 0)], "tid long, item string, pos_tag string, word_id long")
    assert sorted(r["item"] for r in files.tagged_words(rows).collect()) == ["Ann", "run"]


def test_ratings_and_config_and_sink(spark, tmp_path):
    (tmp_path / "r.txt").write_text("1\t7\t3.5\t99\n2\t8\t4\t98\n1\t7\t1.0\t100\n2\t8\t5\t98\n")
    rows = files.tsv_ratings(spark, str(tmp_path / "r.txt"))
    assert sorted(map(tuple, rows.collect())) == [(1, 7, 3.5, 99), (2, 8, 4.0, 98)]
    files.write_result(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (tmp_path / "c.conf").write_text("# note\nA=1\nB = two # rest\nA=3\n\nbroken\n")
    assert files.read_config(str(tmp_path / "c.conf")) == {"A": "1", "B": "two"} == files.read_config(str(tmp_path / "c.conf"), spark)


def test_memory_baskets_want_as_many_tids(spark):
    with pytest.raises(ValueError):
        memory_baskets(spark, [["a"]], [1, 2])


def test_set_functions(spark):
    row = spark.createDataFrame([([0, 1, 2], [0, 1], [0, 2], [1, 2], [])], "s array<long>, a array<long>, b array<long>, c array<long>, e array<long>")
    value = lambda column: row.select(column.alias("v")).first()["v"]
    col = F.col
    assert [value(sets.subtract_set(col("s"), col(x))) for x in "abc"] == [[2], [1], [0]]
    assert value(sets.union_set(col("a"), col("b"))) == [0, 1, 2]
    assert value(sets.union_equal_prefix(col("a"), col("b"))) == [0, 1, 2]
    assert value(sets.union_equal_prefix(col("a"), col("c"))) is None
    assert value(sets.union_equal_prefix(col("a"), col("a"))) is None
    assert value(sets.is_subset(col("s"), col("b"))) and not value(sets.is_subset(col("s"), col("e"))) and not value(sets.is_subset(col("a"), col("s")))
    assert tuple(value(sets.search(col("s"), F.lit(1)))) == (1, True) and tuple(value(sets.search(col("b"), F.lit(1)))) == (1, False)
    assert len(value(sets.proper_splits(col("s")))) == 6
    assert value(basket_items(F.lit(" a , b,c,,"))) == ["a", "b", "c"]
    assert value(polynomial_hash(F.lit("ab"), 1000)) == (97 * 37 + 98) % 1000


def test_index(spark):
    rows = [(r, w) for r, ws in enumerate([["chicken", "dog"], ["dog"], ["cat", "chicken", "dog"], ["sheldon"]]) for w in ws]
    data = spark.createDataFrame([*rows, (0, "dog")], "record_id long, item string").withColumn("key_info", F.concat(F.lit("k"), "item"))
    built = index.build(data)
    ids = lambda df: [r["record_id"] for r in df.collect()]
    assert ids(index.find_records(built, "dog")) == [2, 1, 0]
    assert sorted(ids(index.intersect(built, ["chicken", "dog"]))) == [0, 2]
    assert ids(index.intersect(built, ["dog", "penny"])) == []
    assert sorted(ids(index.intersect(built, ["dog"]))) == [0, 1, 2]
    assert index.key_info(index.change_key_info(built, "cat", "new"), "cat").first()[0] == "new"
    assert tuple(index.size_of(built).first()) == (4, 7, 3)
    with pytest.raises(ValueError):
        index.intersect(built, [])
    index.write(built, "postings", 4)
    assert ids(index.find_records(spark.table("postings"), "cat")) == [2]
    spark.sql("DROP TABLE postings")


def test_first_key_info_stays(spark):
    rows = spark.createDataFrame([(5, "dog", "b", 1), (2, "dog", "z", 2), (9, "dog", "a", 3), (1, "cat", "c", 9)], "record_id long, item string, key_info string, seq long")
    info = lambda built: {r["item"]: r["key_info"] for r in built.collect()}
    assert info(index.build(rows)) == {"dog": "b", "cat": "c"} and info(index.build(rows.drop("seq"))) == {"dog": "z", "cat": "c"}


def test_places_within_hot_items(spark):
    """A frequent item's list spans parts, others share one."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(r, "hot") for r in range(500)] + [(r, f"w{r % 7}") for r in range(60)] + [(1, "a"), (2, "z")]
        placed = index.ranked_postings(spark.createDataFrame(rows, "record_id long, item string")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    lists = {}
    for record, item in rows:
        lists.setdefault(item, []).append(record)
    assert sorted((r["item"], r["record_id"], r["place"]) for r in placed) == sorted((i, r, k + 1) for i, own in lists.items() for k, r in enumerate(sorted(own, reverse=True)))


def test_words_of_all_documents(spark, tmp_path):
    from basketry.sources import tables

    rows = [(1, "some words here", "en"), (2, "andere Worte", "de"), (3, "nulle langue", None), (4, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r["tid"], r["item"]) for r in tables.baskets_of_words(spark, str(tmp_path)).collect()}
    assert found == {(1, "some"), (1, "words"), (1, "here"), (2, "andere"), (2, "worte"), (3, "nulle"), (3, "langue")}
    assert {t for t, _ in ((r["tid"], r["item"]) for r in tables.baskets_of_words(spark, str(tmp_path), "de").collect())} == {2}


#: Texts without words between others, in one file; letters whose small forms differ in length or by place.
ODD_TEXTS = [(1, "some words here, some WORDS"), (2, ""), (3, None), (4, "a b, c 1234"), (5, "GROẞE große ὈΔΥΣΣΕΎΣ ὀδυσσεύς İSTANBUL istanbul ΣΑΣΑΣ"), (6, "..."), (7, "日本語日本 words")]


def _same_as_sql(spark, folder, name):
    import duckdb

    from basketry.plans.oracle import ORACLE_SQL
    from basketry.plans.queries import QUERIES

    spark.createDataFrame(ODD_TEXTS, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = QUERIES[name](spark, str(folder))
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(con.sql(ORACLE_SQL[name]).select(*found.columns).fetchall())
    return rows


def test_words_where_some_documents_have_none(spark, tmp_path):
    rows = _same_as_sql(spark, tmp_path, "source_document_words")
    assert {r[0] for r in rows} == {1, 5, 7}
    assert (1, "some", 2, 0, 17, 4) in rows and (5, "große", 2, 0, 8, 6) in rows


def test_word_frequency_where_some_documents_have_none(spark, tmp_path):
    rows = _same_as_sql(spark, tmp_path, "index_word_frequency")
    assert {("some", 1), ("words", 2), ("große", 1), ("istanbul", 1), ("σασασ", 1)} <= set(rows)


def test_words_of_single_ids_are_not_told_apart(spark):
    """Counts are those of the index, and only ids that come twice are shuffled with their words."""
    texts = [(1, "Alpha beta ALPHA gamma"), (1, "beta delta"), (2, "alpha"), (None, "alpha omega"), (None, "Omega"), (3, None), (4, "ΣΟΦΟΣ İzmir")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    words = files.document_words(docs).select("item", F.col("tid").alias("record_id"))
    wanted = {tuple(r) for r in index.document_frequencies(index.build(words)).collect()}
    seen = []

    def told(rows):
        seen.append(sorted((r["doc_id"] or 0) for r in rows.collect()))
        return files.distinct_words(rows)

    assert {tuple(r) for r in index.frequencies_of_words(docs, told).collect()} == wanted
    assert seen == [[2, 3, 4], [0, 0, 1, 1]]
    seen.clear()
    assert "tid" not in index.frequencies_of_words(docs.filter("doc_id > 1"), told)._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
