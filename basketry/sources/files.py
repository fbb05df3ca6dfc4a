"""Baskets, documents and ratings from files, and results to files."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.text import WORD, basket_items, pos_kept
from basketry.operators.dictionary import with_dense_ids
from basketry.operators.index import build

RATINGS = "user_id long, item_id long, score double, ts long"


def xml_baskets(spark: SparkSession, path: str, row_tag: str = "record") -> DataFrame:
    """tid, item, one row per item of every record of a directory of XML files.

    Records are ``<record><tid>1</tid><data>a, b</data></record>``; an item that a record repeats
    comes as often as it stands there. A record counts wherever it stands, whatever the root is.
    """
    rows = spark.read.format("xml").option("rowTag", row_tag).schema("tid long, data string").load(path)
    return rows.select("tid", F.explode(basket_items(F.col("data"))).alias("item"))


def index_of_baskets(baskets: DataFrame) -> DataFrame:
    """The inverted index of (tid, item) rows, from any source; an item's key_info is its first basket."""
    return build(baskets.select("item", F.col("tid").alias("record_id"), F.col("tid").cast("string").alias("key_info")))


def text_documents(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """tid (dense, by path), doc_name, text: one row per file of a directory, decoded and read whole.

    Only names are sorted to be numbered; texts are joined to their numbers. Charsets beyond
    Spark's own (GBK, GB2312) are decoded in Python, batch by batch.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    numbers = with_dense_ids(files.select("path"), "path", "tid")
    if charset.upper() in ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"):
        texts = files.select("path", F.decode("content", charset).alias("text"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                told = [x.decode(charset, "replace") for x in batch.column("content").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(told, pa.string())], ["path", "text"])

        texts = files.mapInArrow(run, "path string, text string")
    return texts.join(numbers, "path").select("tid", F.element_at(F.split("path", "/"), -1).alias("doc_name"), "text")


def document_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = WORD) -> DataFrame:
    """tid, item, cnt, positions, length of every word of every row: where it begins, ascending, and how long it is, in bytes of UTF-8.

    A row is a document, so its words are put together where it lies, without a shuffle. Letters
    are made small one by one, as SQL does, whatever stands beside them; where a word's forms differ
    in length, the least counts. A document without words has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern, regex.IGNORECASE).finditer
        for batch in batches:
            for tid, text in zip(batch.column("tid"), batch.column("text").to_pylist()):
                found: dict[str, list[int]] = {}
                size: dict[str, int] = {}
                ends = None if text.isascii() else np.concatenate([[0], np.cumsum(_utf8_sizes(text))])
                for m in find(text):
                    item, (at, end) = m[0].replace("İ", "i").replace("Σ", "σ").lower(), m.span()
                    if ends is not None:
                        at, end = int(ends[at]), int(ends[end])
                    found.setdefault(item, []).append(at)
                    size[item] = min(size.get(item, end - at), end - at)
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([tid.as_py()] * n, batch.schema.field("tid").type), pa.array(list(found), pa.string()), pa.array([len(x) for x in found.values()], pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64())), pa.array([size[x] for x in found], pa.int64())], ["tid", "item", "cnt", "positions", "length"])

    rows = docs.select(F.col(id_col).alias("tid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"tid {rows.schema['tid'].dataType.simpleString()}, item string, cnt long, positions array<long>, length long")


#: Rows of a batch of words.
WORDS_A_BATCH = 100_000


def distinct_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = WORD) -> DataFrame:
    """tid, item of document_words(), without places and counts: what an index of words needs. A row's words come once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern, regex.IGNORECASE).findall
        for batch in batches:
            kind, tids, sizes, items = batch.schema.field("tid").type, [], [], []

            def told() -> pa.RecordBatch:
                at = np.repeat(np.array(tids, np.int64), sizes)
                return pa.RecordBatch.from_arrays([batch.column("tid").cast(kind).take(pa.array(at)), pa.array(items, pa.string())], ["tid", "item"])

            for k, text in enumerate(batch.column("text")):
                found = {x.replace("İ", "i").replace("Σ", "σ").lower() for x in set(find(text.as_py()))}
                tids.append(k)
                sizes.append(len(found))
                items.extend(found)
                if len(items) >= WORDS_A_BATCH:
                    yield told()
                    tids, sizes, items = [], [], []
            if items:
                yield told()

    rows = docs.select(F.col(id_col).alias("tid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"tid {rows.schema['tid'].dataType.simpleString()}, item string")


def _utf8_sizes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)


def tagged_words(rows: DataFrame) -> DataFrame:
    """tid, item of rows (tid, item, pos_tag, word_id) whose word class describes documents."""
    return rows.filter(pos_kept(F.col("pos_tag"), F.col("word_id"))).select("tid", "item")


def tsv_ratings(spark: SparkSession, path: str) -> DataFrame:
    """user_id, item_id, score, ts from tab-separated text without a header: of repeated ratings the first one, by ts and then score."""
    rows = spark.read.csv(path, sep="\t", schema=RATINGS)
    first = rows.groupBy("user_id", "item_id").agg(F.min(F.struct("ts", "score")).alias("first"))
    return first.select("user_id", "item_id", F.col("first.score").alias("score"), F.col("first.ts").alias("ts"))


def read_config(path: str, spark: SparkSession | None = None) -> dict[str, str]:
    """key=value lines; # starts a comment; a key's first value counts. With ``spark``, from any store that it reads."""
    text = Path(path).read_text(encoding="utf-8") if spark is None else "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    found: dict[str, str] = {}
    for line in text.splitlines():
        key, equals, value = line.partition("#")[0].partition("=")
        if equals and key.strip():
            found.setdefault(key.strip(), value.strip())
    return found


def write_result(df: DataFrame, path: str, mode: str = "error") -> None:
    """Any result as Parquet."""
    df.write.mode(mode).parquet(path)
