"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of the lengths (in tokens) of frequent pre-tokens, counted on a sample
of about ``sample_rows`` rows from all partitions, built once and broadcast. Tier two is each worker's own cache, filled by
encoding in one call all pre-tokens of a slice of rows that neither tier knows. Pre-tokens never
cross a pre-token boundary in this family of vocabularies, so a text's count is the sum over its
pre-tokens, and no pre-token is ever shuffled: the only stage is the scan.

A vocabulary file that normalises or splits texts in another way is applied to whole texts.

Defined results: null text counts as empty (0 bytes, 0 tokens); a null id stays null; rows that
repeat give repeated results; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import bounded_batches, slices, text_of

#: How pre-tokens are found in byte-level vocabularies (a fixed value of the public format).
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The settings of a vocabulary file that splits texts so.
SPLITS = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}

_cache: dict[tuple, _Counter] = {}


def settings_of(path: str) -> dict:
    """How a vocabulary file normalises and splits texts."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    return {"normalizer": told.get("normalizer"), "pre_tokenizer": told.get("pre_tokenizer")}


class _Counter:
    def __init__(self, path: str, frequent: dict[str, int], cache_entries: int) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.splits = settings_of(path) == SPLITS
        self.find = regex.compile(PRE_TOKENS).findall
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.frequent, self.room = frequent, cache_entries
        self.lengths = dict(frequent)

    def learn(self, words: set[str]) -> None:
        missing = list(words.difference(self.lengths))
        if len(self.lengths) + len(missing) > self.room + len(self.frequent):
            self.lengths = dict(self.frequent)
            missing = list(words.difference(self.lengths))
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            self.lengths.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return list(map(len, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)))
        words, extra = [], []
        for text in texts:
            parts = self.special.split(text) if self.special is not None and self.special.search(text) else [text]
            extra.append(len(parts) - 1)
            words.append(self.find(text) if len(parts) == 1 else [w for p in parts for w in self.find(p)])
        self.learn(set().union(*words))
        length = self.lengths.__getitem__
        return [n + sum(map(length, w)) for n, w in zip(extra, words)]


def frequent_lengths(docs: DataFrame, path: str, text_col: str, sample_rows: int, table_entries: int) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of about ``sample_rows`` rows, drawn from all partitions.

    Pre-tokens are counted where the rows are, and only counts are shuffled; the sample affects speed only.
    """
    some = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).sample(min(1.0, sample_rows / max(1, docs.count())), seed=3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, seen = regex.compile(PRE_TOKENS).findall, Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    seen.update(find(text))
                if len(seen) > 8 * table_entries:
                    seen = Counter(dict(seen.most_common(4 * table_entries)))
        words, n = zip(*seen.most_common(table_entries)) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    counted = some.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counter = _Counter(path, {}, table_entries + 1)
    counter.learn({r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(table_entries).collect()})
    return counter.lengths


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, sample_rows: int = 2000, table_entries: int = 32768, cache_entries: int = 600_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``, by the vocabulary file ``path``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    build = uuid.uuid4().hex
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path, text_col, sample_rows, table_entries))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, build, cache_entries)
        if key not in _cache:
            _cache.clear()
            _cache[key] = _Counter(path, table.value, cache_entries)
        for batch in batches:
            for part in slices(batch, "text"):
                column = part.column("text")
                tokens = _cache[key].count(column.to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _bytes(column), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = text_of(docs, id_col, text_col)
    kind = out.schema["doc_id"].dataType.simpleString()
    return out.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def _bytes(column: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.binary_length(column).cast(pa.int64())
