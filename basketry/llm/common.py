"""Shared pieces of the corpus operators: Arrow streaming and word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.storage import discard, join_hot, materialize  # noqa: F401

#: Bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_BREAKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[list(WORD_BREAKS)] = False
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STRETCH = 1 << 18
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files or row groups than there are cores is dealt to all cores; any other is read as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small enough for a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that a per-document operator reads, under fixed names; null text is empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, text: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice has at most ``limit`` bytes of text, or one row."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start, done = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        done, start = int(sizes[stop - 1]), stop


def column_parts(column: pa.Array, limit: int = 1 << 18) -> Iterator[pa.Array]:
    """Cut a column of texts likewise, at least into one part: work on bytes takes many times a part's size."""
    if not len(column):
        yield column
    for part in slices(pa.RecordBatch.from_arrays([column], ["text"]), "text", limit):
        yield part.column("text")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column end to end, and where each begins (one more than rows)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) >= n:
        return _powers[kind][:n]
    steps = np.full(max(n, 1), _BASE if kind == "up" else _BASE_INVERSE, dtype=np.uint64)
    steps[0] = 1
    steps = np.multiply.accumulate(steps)
    if n <= _STRETCH:  # longer ones are rare, and not kept
        _powers[kind] = steps
    return steps


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words (runs of other than ASCII white space) of many texts at once.

    ``start``/``end``: byte positions; ``first``: where each text's words begin in them
    (one more than texts); ``hash``: 64 bits of each word, equal for equal words.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        inside = _IN_WORD[raw]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[edges] = inside[edges]
        lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[lasts] = inside[lasts]
        self.raw, self.offsets = raw, offsets
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hash(self) -> np.ndarray:
        return span_hash(self.raw, self.start, self.end)


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans (ascending, apart), the same wherever the span stands.

    Works on stretches of about ``_STRETCH`` bytes, so that what it allocates does not grow with
    the text, unless one span is longer.
    """
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        lo = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, lo + _STRETCH, side="right")))
        out[i:j] = _hash_stretch(raw[lo : int(end[j - 1])], start[i:j] - lo, end[i:j] - lo)
        i = j
    return out


def _hash_stretch(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(raw)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power("up", n), out=total[1:])
    return mix((total[end] - total[start]) * _power("down", n)[start] + (end - start).astype(np.uint64))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words within each text, and where each text's runs begin.

    A text of fewer words, but at least one, has one run: all its words.
    """
    h, first = words.hash, words.first
    n = len(h)
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], runs) + np.repeat(first[:-1], runs)
    last = np.repeat(first[1:], runs)
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        here = at + k
        there = here < last
        out = out * np.uint64(0x9FB21C651E98DF25) + np.where(there, h[np.minimum(here, max(n - 1, 0))] if n else 0, np.uint64(k + 1))
    return mix(out), bounds
