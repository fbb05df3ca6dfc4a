"""Approximate nearest neighbours by a permutation index.

Pivots are vectors of a bounded sample; there are about as many as the root of the number of
vectors, so that files grow no faster. A vector is represented by its ``prefix`` nearest pivots in
order. It is posted in the inverted files of its ``posts`` nearest pivots, and a query probes the
files of its ``probes`` nearest. Within a file, candidates are ranked by the footrule distance of
the ordered pivots, and the nearest of them, a ``part`` but ``least`` at the least, are reranked by
exact cosine. Each task returns at most k rows for a query, and the best k of these are the result.

How many files must be probed depends on the vectors. It is measured: the true neighbours of at
most ``sample_queries`` queries are found among all vectors, and ``probes`` is what reaches the
share ``target`` of them. A table that fits one block is probed whole.

Files are cut by their counted sizes into blocks of about ``block`` vectors and ``query_block``
queries, and a task is a pair of blocks of one file. So a popular pivot is many tasks' work, a
task's memory is bounded, and a query is sent to ``probes`` tasks and one more for each further
block of a file.

Equal vectors are one class, posted once with the k + 1 least ids of its members: more can't be
among a query's k nearest, as ties go to smaller ids.

Defined results: vectors that are null, zero, of another length than most, or hold a null or a
number that is not finite take no part, neither as queries nor as candidates; null ids take no
part; of rows that repeat an id and vector each counts once; fewer candidates than k give fewer
rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import materialize

#: Pivots at the most.
MOST_PIVOTS = 32_768


def usable(vector: Column) -> Column:
    """Whether a vector can have a cosine."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(classes: DataFrame, count: int, pivots: int, sample: int) -> np.ndarray:
    """Pivots from at most ``sample`` of ``count`` vectors, whose ids hash lowest: each the farthest of some candidates from those before."""
    # most vectors go by their hash alone, so that only a little over the bound is sorted for it
    share = min(1.0, 1.2 * sample / max(1, count))
    near = classes.select("vector", F.pmod(F.xxhash64("low_id"), F.lit(1 << 31)).alias("h")).filter(F.col("h") < int(share * (1 << 31)))
    rows = near.orderBy("h").limit(sample).select("vector").collect()
    if not rows:
        return np.zeros((0, 1))
    x = _unit(np.asarray([r[0] for r in rows], dtype=np.float64))
    chosen = [0]
    near = x @ x[0]
    draw = np.random.default_rng(11)
    while len(chosen) < min(pivots, len(x)):
        some = draw.choice(len(x), min(16, len(x)), replace=False)
        best = int(some[np.argmin(near[some])])
        if near[best] > 1 - 1e-9:
            best = int(np.argmin(near))
            if near[best] > 1 - 1e-9:
                break
        chosen.append(best)
        near = np.maximum(near, x @ x[best])
    return x[chosen]


def _nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each vector's ``prefix`` nearest pivots, the nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix]


def _footrule(places: np.ndarray, own: np.ndarray, pivots: int) -> np.ndarray:
    """Distance of one ordered list of pivots to many of its length; a pivot beyond a list stands at its end.

    Over n places, a pivot at place j of the one and place i of the other adds |i - j|, and a
    pivot that the other lacks adds n - j on either side: all in all, twice the sum of max(i, j)
    over the places of one list, less n (n - 1).
    """
    n = len(own)
    at = np.full(pivots, n, dtype=np.uint8 if n < 256 else np.uint16)
    at[own] = np.arange(n)
    return 2 * np.maximum(np.take(at, places, mode="clip"), np.arange(n, dtype=at.dtype)).sum(axis=1, dtype=np.int32) - n * (n - 1)


def needed_probes(truth: list[tuple[float, np.ndarray, np.ndarray]], pivots: int, target: float) -> int:
    """The fewest probes that reach the share ``target`` of true neighbours (their query's pivots in order, their files)."""
    need = []
    for _, order, files in truth:
        at = np.full(pivots, pivots)
        at[order] = np.arange(len(order))
        need.append(int(at[files].min()) + 1)
    need.sort()
    return need[max(0, int(np.ceil(target * len(need))) - 1)] if need else pivots


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None, prefix: int = 128, posts: int = 3, probes: int | None = None, target: float = 0.98, block: int = 16384, query_block: int = 4096, part: float = 0.08, least: int = 64, sample_queries: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score (cosine): the k nearest found of every row of which ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asks")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    width = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    result = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], result)
    width = width["width"]
    rows = rows.filter(F.size("vector") == width)
    ids = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    # ids of a class are kept to the k + 1 least as they are gathered, first within salted parts of it
    salted = rows.groupBy("vector", F.pmod(F.xxhash64("vec_id"), F.lit(256)).alias("salt")).agg(ids.alias("ids"))
    classes = salted.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")).withColumn("low_id", F.col("ids")[0])
    classes = materialize(classes, "vectors")
    asked = materialize(rows.filter("asks").select("vec_id", "vector").dropDuplicates(), "queries")
    count = classes.count()
    pivots = min(MOST_PIVOTS, max(256, int(np.sqrt(count)))) if pivots is None else pivots
    axes = choose_pivots(classes, count, pivots, max(4096, 4 * pivots))
    given = spark.sparkContext.broadcast(axes)  # at most MOST_PIVOTS times width numbers
    n_files, posts = len(axes), min(posts, len(axes))
    some = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_queries).collect()
    if not some:
        return spark.createDataFrame([], result)
    posted = _files_of(classes, given, width, posts)
    if probes is None:
        truth = _true_neighbours(posted, _unit(np.asarray([r["vector"] for r in some], dtype=np.float64)), axes, width, k)
        probes = n_files if count * posts <= block else needed_probes(truth, n_files, target)
    probing = _files_of(asked, given, width, min(probes, n_files))
    # a number for each file: how many blocks its vectors and its queries make
    blocks, query_blocks = (np.maximum(1, -(-_sizes(x, n_files) // size)) for x, size in ((posted, block), (probing, query_block)))

    def dealt(frame: DataFrame, number: str, asks: bool) -> DataFrame:
        """``frame`` with the tasks that each row goes to, as file, block and query block in one number."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, others = (query_blocks, blocks) if asks else (blocks, query_blocks)
            for batch in batches:
                files = batch.column("files").flatten().to_numpy().astype(np.int64)
                per = len(files) // max(1, batch.num_rows)
                own = np.repeat(batch.column("spread").to_numpy(), per) % mine[files]
                many = others[files]
                other = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                own, files = np.repeat(own, many), np.repeat(files, many)
                task = files << 40 | (other if asks else own) << 20 | (own if asks else other)
                ends = np.concatenate([[0], np.cumsum(many)])[:: max(1, per)] if len(files) else np.zeros(batch.num_rows + 1, dtype=np.int64)
                tasks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(task))
                yield pa.RecordBatch.from_arrays([batch.column("vector"), batch.column(number), tasks], ["vector", number, "tasks"])

        kind = frame.schema[number].dataType.simpleString()
        spread = frame.withColumn("spread", F.pmod(F.xxhash64(number, F.lit(3)), F.lit(1 << 30)))
        return spread.mapInArrow(run, f"vector array<double>, {number} {kind}, tasks array<bigint>").withColumn("task", F.explode("tasks")).drop("tasks")

    candidates = dealt(posted, "ids", False).select("task", F.lit(None).cast("bigint").alias("query"), "vector", "ids")
    both = candidates.unionByName(dealt(probing, "vec_id", True).select("task", F.col("vec_id").alias("query"), "vector", F.array().cast("array<bigint>").alias("ids")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column("task").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if held and held[0].column("task")[0].as_py() != key[lo]:
                    yield from _answer(held, width, given.value, prefix, part, least, k)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from _answer(held, width, given.value, prefix, part, least, k)

    found = both.repartition("task").sortWithinPartitions("task", F.col("query").asc_nulls_first()).mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # a vector is in several files, so a pair may come several times
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _files_of(frame: DataFrame, given: Broadcast, width: int, count: int) -> DataFrame:
    """``frame`` with files: each vector's ``count`` nearest pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = np.ascontiguousarray(_nearest_pivots(_unit(_matrix(batch.column("vector"), width)), given.value, count), dtype=np.int32)
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, files.size + 1, files.shape[1]), pa.int32()), pa.array(files.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "files"])

    return frame.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema) + ", files array<int>")


def _sizes(frame: DataFrame, n_files: int) -> np.ndarray:
    """How many rows each file has."""
    out = np.zeros(n_files, dtype=np.int64)
    for r in frame.select(F.explode("files").alias("file")).groupBy("file").count().collect():
        out[r["file"]] = r["count"]
    return out


def _true_neighbours(posted: DataFrame, queries: np.ndarray, pivots: np.ndarray, width: int, k: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Of each of some queries: similarity, the query's pivots in order, and the files of its k nearest other vectors among all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, list[int]]]] = [[] for _ in queries]
        for batch in batches:
            if not batch.num_rows:
                continue
            score = queries @ _unit(_matrix(batch.column("vector"), width)).T
            files = batch.column("files").flatten().to_numpy().reshape(batch.num_rows, -1)
            for q, own in enumerate(score):
                own = np.where(own > 1 - 1e-12, -2, own)  # the query itself
                top = np.argpartition(-own, min(k, len(own)) - 1)[:k]
                best[q] = sorted([*best[q], *((float(own[j]), files[j].tolist()) for j in top if own[j] >= -1.5)], reverse=True)[:k]
        rows = [(q, s, f) for q, own in enumerate(best) for s, f in own]
        q, s, f = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(s, pa.float64()), pa.array(f, pa.list_(pa.int32()))], ["q", "score", "files"])

    found = posted.select("vector", "files").mapInArrow(run, "q int, score double, files array<int>")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "files"))
    order = _nearest_pivots(queries, pivots, len(pivots))
    return [(r["score"], order[r["q"]], np.asarray(r["files"])) for r in found.withColumn("place", place).filter(F.col("place") <= k).collect()]


def _answer(held: list[pa.RecordBatch], width: int, pivots: np.ndarray, prefix: int, part: float, least: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of one block for each query that probes it; its vectors come first, then its queries."""
    rows = pa.Table.from_batches(held).combine_chunks()
    query = rows.column("query").combine_chunks()
    n = query.null_count
    if n == 0 or n == len(query):
        return
    x = _unit(_matrix(rows.column("vector").combine_chunks(), width))
    ids = rows.column("ids").combine_chunks().slice(0, n).to_pylist()
    prefix = min(prefix, len(pivots))
    places = np.ascontiguousarray(_nearest_pivots(x, pivots, prefix))
    keep = min(n, max(least, int(np.ceil(n * part))))
    out: list[tuple[int, int, float]] = []
    for i, asker in enumerate(query.slice(n).to_pylist(), start=n):
        near = np.arange(n)
        if keep < n:
            footrule = _footrule(places[:n], places[i], len(pivots))
            near = np.flatnonzero(footrule <= np.partition(footrule, keep - 1)[keep - 1])  # ties at the edge stay
        score = (x[near] * x[i]).sum(axis=1)
        top = np.flatnonzero(score >= np.partition(score, max(0, len(score) - k - 1))[max(0, len(score) - k - 1)])
        mine = sorted((-float(score[j]), v) for j in top.tolist() for v in ids[near[j]] if v != asker)[:k]
        out += [(asker, v, -s) for s, v in mine]
    if out:
        asker, vec, score = zip(*out)
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(asker, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})
