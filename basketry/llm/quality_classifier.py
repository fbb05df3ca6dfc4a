"""A quality score learned from preference pairs by the Bradley-Terry model.

A labelled document of quality 1 is preferred to one of quality 0. The model gives each document
a linear score of its features, and says that a preference holds with the logistic function of
the score difference, so that the loss is logistic on feature differences and has no intercept.
The threshold is a quantile of the scores of all labelled documents: the share of label 0. Scores are
mapped to 0..1 by a logistic curve that puts this quantile at ``cut``.

Fitting reads at most ``max_labelled`` labelled ids, those that hash lowest; its matrices are
of that many rows and about twenty columns. Scoring is one scan of all whole texts; the quantile is
taken from counts of the labelled scores in bins of ``BIN``.

Defined results: null text scores as the empty text does; a null id is scored, is not held out,
and never serves as a labelled row; rows that repeat a labelled id serve once, by the least of their
features; an id with both labels serves as both; without
labels of both kinds every score is 0.5; columns other than id and text are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import bounded_batches, column_parts, materialize, slices, text_of
from basketry.llm.quality_rules import COMMON_WORDS
from basketry.llm.text_stats import Stats, common_table

_TABLE = common_table(COMMON_WORDS)
#: Width of the bins of raw scores, and the raw score beyond which all are in one bin.
BIN = 1 / 512
_FAR = 64.0


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never used to learn: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_features(column: pa.Array) -> np.ndarray:
    """Texts by features, from the text alone."""
    return np.concatenate([_features(part) for part in column_parts(column)])


def _features(column: pa.Array) -> np.ndarray:
    s = Stats(column)
    words = s.n_words.astype(float)
    chars = s.classes.sum(axis=1).astype(float)
    per_word, per_char = 1 / np.maximum(words, 1), 1 / np.maximum(chars, 1)
    kinds = s.classes * per_char[:, None]
    first = s.raw[s.words.start] if len(s.words.start) else np.zeros(0, dtype=np.uint8)
    last = s.raw[s.words.end - 1] if len(s.words.end) else np.zeros(0, dtype=np.uint8)
    size = s.words.end - s.words.start

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[s.words.first[1:]] - total[s.words.first[:-1]]) * per_word

    upper = (first >= 65) & (first <= 90)
    columns = [
        np.sqrt(kinds[:, 1]), kinds[:, 1], np.sqrt(kinds[:, 6]), kinds[:, 6], np.sqrt(kinds[:, 2]), np.sqrt(kinds[:, 5]), kinds[:, 5], np.sqrt(kinds[:, 7]), kinds[:, 8], kinds[:, 3], np.sqrt(kinds[:, 4]),
        s.common(_TABLE).sum(axis=1) * per_word, s.word_chars * per_word / 10,
        np.sqrt(s.n_repeat_words * per_word), s.n_repeat_words * per_word, np.sqrt(np.minimum(1, s.n_dup_lines * 10 * per_word)),
        np.log1p(words) / 10, np.minimum(words, 100) / 100, np.minimum(words, 50) / 50,
        share(upper), share(last == ord("!")), share((size == 1) & (first == ord("|"))), share(size == 1), share(size > 14), share(last == ord(".")),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Model:
    """Weights on standardised features; the score quantile; the curve from scores to 0..1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    quantile: float
    slope: float
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.log(self.cut / (1 - self.cut)) + self.slope * (self.raw(x) - self.quantile)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_pairs(x: np.ndarray, good: np.ndarray, bad_share: float | None = None, cut: float = 0.7, pairs: int = 100_000, ridge: float = 1e-3, steps: int = 25) -> Model:
    """Weights that minimise the logistic loss of preferences of good over bad rows, by Newton steps.

    The quantile is that of the rows given, weighted to have ``bad_share`` bad ones.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    w = np.zeros(z.shape[1])
    if not good.any() or good.all():
        return Model(mean, scale, w, 0.0, 0.0, 0.5)
    draw = np.random.default_rng(7)
    d = z[draw.choice(np.flatnonzero(good), pairs)] - z[draw.choice(np.flatnonzero(~good), pairs)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / pairs + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    bad_share = float((~good).mean()) if bad_share is None else bad_share
    weight = np.where(good, (1 - bad_share) / good.sum(), bad_share / (~good).sum())
    order = np.argsort(raw)
    below = np.cumsum(weight[order])
    at = int(np.searchsorted(below, bad_share))
    near = raw[order][max(0, at - 1) : at + 1]  # halfway between the last below and the first above
    return Model(mean, scale, w, float(near.mean()), 1.0, cut)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000, cut: float = 0.7) -> Model:
    """Learn from at most ``max_labelled`` labelled rows that are not held out."""
    bounded_batches(docs.sparkSession)
    usable = usable_labels(labels, id_col, label_col)
    shares = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # most rows go by their hash alone, so that only a little over the bound is sorted for it
    share = min(1.0, 1.2 * max_labelled / max(1, sum(shares.values())))
    near = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < int(share * (1 << 31)))
    chosen = near.dropDuplicates().orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)), "doc_id", "label").limit(max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = text_features(part.column("text"))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "label": part.column("label"), "x": pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))})

    # the chosen ids are at most max_labelled, so they may be sent everywhere; rows that repeat one are reduced as they are found
    rows = text_of(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    rows = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label int, x array<double>")
    found = rows.groupBy("doc_id", "label").agg(F.min("x").alias("x")).select("label", "x").collect()
    if not found:
        width = text_features(pa.array([""])).shape[1]
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.0, 0.5)
    x, good = np.asarray([r["x"] for r in found]), np.asarray([r["label"] for r in found]) == 1
    order = np.lexsort((*x.T, good))  # as found, rows come in any order
    return fit_pairs(x[order], good[order], shares.get(0, 0) / max(1, sum(shares.values())), cut)


def usable_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """doc_id, label of the rows that may be learned from."""
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    return rows.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("doc_id"))


def raw_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, raw of every row, by one scan."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.raw(text_features(part.column("text"))))], ["doc_id", "raw"])

    rows = text_of(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, raw double")


def with_quantile(scored: DataFrame, labels: DataFrame, model: Model, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """``model`` with the quantile of all labelled rows' scores (``scored``: doc_id, raw).

    An id's rows count by their least score, once a label, so no repeated id weighs more. Where the
    quantile falls between two bins with nothing between them, it is halfway.
    """
    ids = usable_labels(labels, id_col, label_col).distinct()
    told = scored.groupBy("doc_id").agg(F.min("raw").alias("raw")).join(ids, "doc_id")
    binned = F.floor(F.greatest(F.lit(-_FAR), F.least(F.lit(_FAR), F.col("raw"))) / BIN).cast("int")
    # as many rows as there are bins at most
    found = sorted((r["bin"], r["n"], r["bad"]) for r in told.groupBy(binned.alias("bin")).agg(F.count("*").alias("n"), F.sum((F.col("label") == 0).cast("long")).alias("bad")).collect())
    if not model.slope or not found:
        return model
    at, n = np.asarray([r[0] for r in found]), np.cumsum([r[1] for r in found])
    bad = sum(r[2] for r in found)
    k = int(np.searchsorted(n, bad))  # the first bin by whose end that many scores are reached
    after = at[k + 1] if n[k] == bad and k + 1 < len(at) else at[k] + 1
    return replace(model, quantile=float((at[k] + 1 + after) / 2 * BIN))


def scores(scored: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted (score at or above the quantile) of rows doc_id, raw."""
    z = F.lit(float(np.log(model.cut / (1 - model.cut)))) + model.slope * (F.col("raw") - model.quantile)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return scored.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= F.lit(0.7 if model.slope else 2.0)).cast("int"))


def fit_whole(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000, cut: float = 0.7) -> tuple[Model, DataFrame]:
    """The fitted model with its quantile over all labelled rows, and doc_id, raw of every row."""
    model = fit(docs, labels, id_col, text_col, label_col, max_labelled, cut)
    scored = materialize(raw_scores(docs, model, id_col, text_col), "quality-scores")
    return with_quantile(scored, labels, model, id_col, label_col), scored


def accepted(docs: DataFrame, model: Model, text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``cut``; all of them without a model."""
    if not model.slope:
        return docs
    bounded_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            for part in slices(batch, text_col):
                keep = model.score(text_features(pc.fill_null(part.column(text_col), ""))) >= cut
                yield part.filter(pa.array(keep)).select(names)

    return docs.mapInArrow(run, docs.schema)


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model, scored = fit_whole(docs, labels, id_col, text_col, label_col, max_labelled)
    return scores(scored, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
