"""Self-join of documents by Jaccard similarity of their word n-grams, with Bayesian pruning.

1. One scan gives each text its set of n-gram hashes, folded into an id of that set, the keys of
   its MinHash bands, and one byte of each MinHash value. Texts with one set form a class: copies
   are never expanded into pairs. What follows is about classes.
2. Band buckets with the same members are reduced to one. A bucket of more than ``BLOCK`` members
   is cut into blocks, and every pair of blocks is its own task, so that no bucket is capped and
   none is held by one task. In a task, pairs compare MinHash bytes a few at a time and are
   dropped as soon as the posterior probability that they reach the threshold, from a uniform
   prior, falls below ``tolerance``. Survivors leave the task as a forest, linear in its members.
3. Components of the forests say which texts must meet. In components of more than one block the
   sketches meet first, in pairs of blocks, and a text goes only to those pairs of blocks in which
   it has a partner that survives. There every pair is verified by exact intersection of the n-gram
   sets; tasks return a row for each class with its links counted, and a forest of the verified links.
4. Components of these are the classes of near-duplicates.

Sets are told apart by 128 bits: a set's id has 64, and where two sets share one, they get ids of
their own from 64 more. n-grams are hashes of 54 bits or more: two different n-grams of one document
are taken for one with a probability of about n^2 / 2^55.

Defined results: words are runs of other than ASCII white space, compared as they are; a text of
fewer words than n has one n-gram, all its words; a null, empty or blank text has no n-gram, no
link, and its own id as class; a null id is a document like others, and the class id is the least
id that is not null; repeated rows are copies of each other; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import Words, bounded_batches, discard, materialize, mix, shingles, slices, text_bytes
from basketry.llm.components import connected_components

#: Members of a block of a bucket or a component, and n-grams of a block of texts, about.
BLOCK = 256
BLOCK_GRAMS = 500_000
#: Texts of which n-gram sets are taken at once have numbers of so many bits.
DOC_BITS = 10
_HELD_BYTES = 4 << 20
_FACTORS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def gram_sets(column: pa.Array, size: int, doc_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes, of 64 - ``doc_bits`` bits, of each of up to 2^doc_bits texts, end to end, and where each text's begin."""
    raw, offsets = text_bytes(column)
    grams, bounds = shingles(Words(raw, offsets), size)
    doc = np.repeat(np.arange(len(column), dtype=np.uint64), np.diff(bounds))
    gram_bits = np.uint64(64 - doc_bits)
    key = np.sort(doc << gram_bits | grams >> np.uint64(doc_bits))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & ((np.uint64(1) << gram_bits) - np.uint64(1)), np.searchsorted(key >> gram_bits, np.arange(len(column) + 1).astype(np.uint64))


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int, id_bits: int = 64) -> DataFrame:
    """doc_id, pick (finds the row again), set_id (null without n-grams), check (64 more bits of it), n_grams, keys, sketch."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (p.slice(at, 1 << DOC_BITS) for p in slices(batch, "text") for at in range(0, p.num_rows, 1 << DOC_BITS)):
                grams, bounds = gram_sets(part.column("text"), size, DOC_BITS)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                at = bounds[:-1][full]
                value = mix(grams + np.uint64(1))
                ids, check = np.zeros((2, len(n)), dtype=np.uint64)
                least = np.zeros((len(n), bands * rows), dtype=np.uint64)
                if len(full):
                    ids[full] = mix(np.add.reduceat(value, at) ^ mix(np.add.reduceat(value * _FACTORS[255], at))) >> np.uint64(64 - id_bits)
                    check[full] = mix(np.add.reduceat(mix(value ^ _FACTORS[254]), at))
                    for k in range(bands * rows):
                        least[full, k] = np.minimum.reduceat(value * _FACTORS[k] + _FACTORS[k] >> np.uint64(7), at)
                least = mix(least)
                keys = np.zeros((len(n), bands), dtype=np.uint64)
                for b in range(bands):
                    for k in range(b * rows, (b + 1) * rows):
                        keys[:, b] = mix(keys[:, b] * np.uint64(31) + least[:, k] + np.uint64(b))
                sketch = (least & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "pick": part.column("pick"), "set_id": pa.array(ids.view(np.int64), mask=n == 0), "check": pa.array(check.view(np.int64)), "n_grams": pa.array(n.astype(np.int64)),
                    "keys": pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.view(np.int64).ravel())), "sketch": pa.array([x.tobytes() for x in sketch], pa.binary()),
                })

    rows_ = _picked(docs, id_col, text_col)
    return rows_.mapInArrow(run, f"doc_id {rows_.schema['doc_id'].dataType.simpleString()}, pick long, set_id long, check long, n_grams long, keys array<long>, sketch binary")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A key by which a row of the input is found again; rows with one id and text share it."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("pick"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def least_matches(threshold: float, tolerance: float, steps: list[int]) -> list[int]:
    """After so many compared bytes, the fewest matches with which a pair is still kept.

    A byte matches with probability p = s + (1 - s) / 256. From a uniform prior of p, the
    posterior after m of n matches is Beta(m + 1, n - m + 1); a pair goes if its mass from the
    threshold on is below ``tolerance``.
    """
    p = threshold + (1 - threshold) / 256
    out = []
    for n in steps:
        mass, m = 0.0, 0
        while m <= n:
            mass += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
            if mass >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def pruned(a: np.ndarray, b: np.ndarray, needed: list[int], steps: list[int]) -> np.ndarray:
    """Which of the sketch pairs survive incremental comparison."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), dtype=np.int32), 0
    for upto, least in zip(steps, needed):
        matches = matches + (a[alive, done:upto] == b[alive, done:upto]).sum(axis=1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], upto
    return alive


def least_ids(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each node (an id) the least id that pairs of positions connect it with."""
    root = forest(len(node), a, b)
    least = node.copy()
    np.minimum.at(least, root, node)
    return least[root]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each of n nodes' least connected node."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _by_group(batches: Iterator[pa.RecordBatch], solve: Callable[[pa.Table], pa.RecordBatch | None], size_of: Callable[[pa.RecordBatch], int]) -> Iterator[pa.RecordBatch]:
    """Feed whole groups (runs of one ``g``), several at a time, to ``solve``."""
    held: list[pa.RecordBatch] = []
    weight = 0
    for batch in batches:
        g = batch.column("g").to_numpy()
        if not len(g):
            continue
        if held and weight >= _HELD_BYTES:
            more = np.flatnonzero(g != held[-1].column("g")[-1].as_py())
            if len(more):  # the last group that is held ends in this batch
                held.append(batch.slice(0, int(more[0])))
                if (out := solve(pa.Table.from_batches(held))) is not None:
                    yield out
                held, weight, batch = [], 0, batch.slice(int(more[0]))
        held.append(batch)
        weight += size_of(batch)
    if held and (out := solve(pa.Table.from_batches(held))) is not None:
        yield out


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each run of one g and set_id: repeated rows of one document come together."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        g, node = batch.column("g").to_numpy(), batch.column("set_id").to_numpy()
        fresh = np.ones(len(g), dtype=bool)
        fresh[1:] = (g[1:] != g[:-1]) | (node[1:] != node[:-1])
        fresh[0] = (g[0], node[0]) != last
        last = (g[-1], node[-1])
        yield batch.filter(pa.array(fresh))


def _tasks(members: DataFrame, group: str, node: str) -> DataFrame:
    """A row of ``members`` (with ``blocks``, of its group) for each pair of blocks that its block is in: g, side."""
    cut = members.withColumn("own", F.pmod(F.xxhash64(F.col(node), F.lit(5)), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.withColumn("g", F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other"))).withColumn("side", F.when(F.col("own") == F.col("other"), F.lit(0)).when(F.col("own") < F.col("other"), F.lit(1)).otherwise(F.lit(2)))


def _alive(cuts: np.ndarray, side: np.ndarray, sketch: np.ndarray, needed: list[int], steps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that meet in a group (``cuts`` says where groups begin) and survive."""
    sizes = np.diff(cuts)
    ends: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    for size in np.unique(sizes[sizes > 1]).tolist():
        i, j = np.triu_indices(size, 1)
        begin = cuts[:-1][sizes == size]
        for at in range(0, len(begin), step := max(1, 200_000 // len(i))):
            base = begin[at : at + step, None]
            a, b = (base + i).ravel(), (base + j).ravel()
            met = (side[a] == 0) | (side[a] != side[b])  # within one block, or across the two
            a, b = a[met], b[met]
            alive = pruned(sketch[a], sketch[b], needed, steps)
            ends.append((a[alive], b[alive]))
    return np.concatenate([x for x, _ in ends]), np.concatenate([x for _, x in ends])


def _unpacked(held: pa.Table, *names: str) -> tuple[np.ndarray, ...]:
    """Where groups begin (and the end of the last), the sketches as a matrix, and other columns."""
    g = held.column("g").to_numpy()
    sketch = np.frombuffer(b"".join(held.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(g), -1)
    return np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]]), sketch, *(held.column(c).to_numpy() for c in names)


def candidate_forest(reps: DataFrame, threshold: float, tolerance: float, bands: int, rows: int) -> DataFrame:
    """a, b: edges whose components hold all pairs that share a band and survive pruning."""
    keys = reps.select(F.explode("keys").alias("key"), "set_id")
    buckets = keys.groupBy("key").agg(F.count("*").alias("many"), F.bit_xor(F.xxhash64("set_id")).alias("who"), F.min("set_id").alias("low")).filter("many > 1")
    buckets = buckets.groupBy("many", "who", "low").agg(F.min("key").alias("key"))
    members = keys.join(buckets.select("key", F.ceil(F.col("many") / BLOCK).cast("int").alias("blocks")), "key").join(reps.select("set_id", "sketch"), "set_id")
    tasks = _tasks(members, "key", "set_id").select("g", "side", "set_id", "sketch")
    steps = list(range(16, bands * rows + 1, 16))
    needed = least_matches(threshold, tolerance, steps)

    def solve(held: pa.Table) -> pa.RecordBatch | None:
        cuts, sketch, side, node = _unpacked(held, "side", "set_id")
        a, b = _alive(cuts, side, sketch, needed, steps)
        if not len(a):
            return None
        least = least_ids(node, a, b)
        linked = np.flatnonzero(least != node)
        return pa.RecordBatch.from_pydict({"a": pa.array(node[linked]), "b": pa.array(least[linked])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_group(batches, solve, lambda b: b.num_rows * 200)

    return tasks.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def surviving_members(homes: DataFrame, threshold: float, tolerance: float, hashes: int) -> DataFrame:
    """set_id, g, side: of components of several blocks, the pairs of blocks in which a set has a partner that survives.

    ``homes``: set_id, sketch, root, blocks.
    """
    steps = list(range(16, hashes + 1, 16))
    needed = least_matches(threshold, tolerance, steps)
    tasks = _tasks(homes.filter("blocks > 1").select("root", "blocks", "set_id", "sketch"), "root", "set_id").select("g", "side", "set_id", "sketch")

    def solve(held: pa.Table) -> pa.RecordBatch | None:
        cuts, sketch, side, node, g = _unpacked(held, "side", "set_id", "g")
        at = np.unique(np.concatenate(_alive(cuts, side, sketch, needed, steps)))
        return pa.RecordBatch.from_pydict({"set_id": pa.array(node[at]), "g": pa.array(g[at]), "side": pa.array(side[at])}) if len(at) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_group(batches, solve, lambda b: b.num_rows * 200)

    return tasks.repartition("g").sortWithinPartitions("g").mapInArrow(run, "set_id long, g long, side int")


def verified_links(docs: DataFrame, homes: DataFrame, id_col: str, text_col: str, size: int, threshold: float, tolerance: float, hashes: int) -> DataFrame:
    """set_id, n_links (documents of other sets linked with it), root: by exact comparison within homes.

    ``homes``: pick, set_id, copies (documents with that set), sketch, root, blocks (of the sets with that root).
    """
    alone = _tasks(homes.filter("blocks = 1"), "root", "set_id").select("pick", "set_id", "copies", F.array(F.struct("g", "side")).alias("tasks"))
    several = surviving_members(homes, threshold, tolerance, hashes).groupBy("set_id").agg(F.collect_list(F.struct("g", "side")).alias("tasks"))
    several = several.join(homes.filter("blocks > 1").select("pick", "set_id", "copies"), "set_id").select("pick", "set_id", "copies", "tasks")
    texts = _picked(docs, id_col, text_col).drop("doc_id").join(alone.unionByName(several), "pick")
    tasks = texts.select("set_id", "copies", "text", F.explode("tasks").alias("t")).select("t.g", "t.side", "set_id", "copies", "text")

    def solve(held: pa.Table) -> pa.RecordBatch | None:
        held = held.combine_chunks()
        g, side, node, copies = (held.column(c).to_numpy() for c in ("g", "side", "set_id", "copies"))
        column = held.column("text")
        grams, bounds = gram_sets(column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks), size, max(1, (len(g) - 1).bit_length()))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]])
        links, ends = np.zeros(len(g), dtype=np.int64), []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi - lo < 2:
                continue
            near = _similar(grams[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], threshold)
            near &= (side[lo:hi, None] == 0) | (side[lo:hi, None] != side[None, lo:hi])
            links[lo:hi] += near @ copies[lo:hi]
            a, b = np.nonzero(np.triu(near))
            ends.append((a + lo, b + lo))
        if not ends:
            return None
        a, b = (np.concatenate(x) for x in zip(*ends))
        least = least_ids(node, a, b)
        linked = np.flatnonzero(links)
        return pa.RecordBatch.from_pydict({"set_id": pa.array(node[linked]), "n_links": pa.array(links[linked]), "root": pa.array(least[linked])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (part for batch in _once(batches) for part in slices(batch, "text"))
        yield from _by_group(small, solve, lambda b: b.column("text").nbytes)

    return tasks.repartition("g").sortWithinPartitions("g", "set_id").mapInArrow(run, "set_id long, n_links long, root long")


def _similar(grams: np.ndarray, bounds: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets (end to end in ``grams``) have at least that Jaccard similarity; no set with itself."""
    n, sizes = len(bounds) - 1, np.diff(bounds)
    if n == 2:
        shared = np.zeros((2, 2))
        shared[0, 1] = shared[1, 0] = len(np.intersect1d(grams[: bounds[1]], grams[bounds[1] :], assume_unique=True))
    else:
        doc = np.repeat(np.arange(n), sizes)
        order = np.argsort(grams, kind="stable")
        key = grams[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        column = np.cumsum(fresh) - 1
        often = np.bincount(column) > 1
        number = np.cumsum(often) - 1
        keep = often[column]
        row, column = doc[order][keep], number[column[keep]]
        shared = np.zeros((n, n))
        width = 4096
        for lo in range(0, int(number[-1]) + 1 if len(number) else 0, width):
            a, b = np.searchsorted(column, [lo, lo + width])
            x = np.zeros((n, width), dtype=np.float32)
            x[row[a:b], column[a:b] - lo] = 1
            shared += x @ x.T
    near = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
    np.fill_diagonal(near, False)
    return near


def _sets(signed: DataFrame) -> DataFrame:
    """A row for each set: how many documents have it, the least of them, and what to compare it by."""
    sets = signed.filter("set_id IS NOT NULL").groupBy("set_id").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("low_id"), F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "pick")).alias("low"),
        F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("n_grams").alias("n_grams"), F.min("check").alias("check"), F.max("check").alias("last_check"),
    )
    return materialize(sets.withColumn("pick", F.col("low.pick")), "sets")


def _apart(signed: DataFrame, sets: DataFrame) -> DataFrame:
    """``signed`` with other ids for sets that share one with another set."""
    shared = sets.filter("check <> last_check").select("set_id", F.lit(True).alias("shared"))
    both = signed.join(shared, "set_id", "left")
    return both.withColumn("set_id", F.when(F.col("shared"), F.xxhash64("set_id", "check")).otherwise(F.col("set_id"))).drop("shared")


def ngram_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, bands: int = 20, rows: int = 4, tolerance: float = 1e-6, id_bits: int = 64) -> DataFrame:
    """As ngram_join(), and pick (the row's key, see row_key()) and class_pick (the key of the row that stands for the class)."""
    signed = materialize(signatures(docs, id_col, text_col, size, bands, rows, id_bits), "signatures")
    reps = _sets(signed)
    while reps.filter("check <> last_check").take(1):
        signed = materialize(_apart(signed, reps), "signatures")
        reps = _sets(signed)
    met = connected_components(candidate_forest(reps, threshold, tolerance, bands, rows))
    homes = met.withColumnRenamed("node", "set_id").join(reps.select("set_id", "copies", "pick", "n_grams", "sketch"), "set_id")
    many = homes.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    homes = materialize(homes.join(many, "root").select("pick", "set_id", "copies", "sketch", "root", "blocks"), "homes")
    # the sketches were met once; here a pair that could still be one is never dropped
    links = materialize(verified_links(docs, homes, id_col, text_col, size, threshold, tolerance**2, bands * rows), "links")
    discard(homes)
    classes = connected_components(links.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    ids = reps.select("set_id", "copies", "low_id", "low").join(classes.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    ids = ids.join(ids.groupBy("root").agg(F.min("low_id").alias("class_id"), F.min("low").alias("first")), "root")
    ids = ids.join(links.groupBy("set_id").agg(F.sum("n_links").alias("others")), "set_id", "left")
    ids = ids.select("set_id", "class_id", F.col("first.pick").alias("class_pick"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    rows_ = signed.select("doc_id", "pick", "set_id").join(ids, "set_id", "left")
    alone = F.col("set_id").isNull()
    return rows_.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "pick", F.when(alone, F.col("pick")).otherwise(F.col("class_pick")).alias("class_pick"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, bands: int = 20, rows: int = 4, tolerance: float = 1e-6) -> DataFrame:
    """doc_id, class_id, n_links for every row: its class's least id, and how many other rows are similar to it."""
    return ngram_classes(docs, id_col, text_col, size, threshold, bands, rows, tolerance).select("doc_id", "class_id", "n_links")


def oracle(docs: str, size: int = 5, threshold: float = 0.8) -> str:
    """DuckDB SQL for ngram_join(docs), over all pairs that share an n-gram; ``docs`` is a table."""
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
g AS (SELECT DISTINCT r, unnest(list_transform(range(1, greatest(len(w) - {size - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {size - 1}], ' '))) AS gram FROM d WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM g x JOIN g y ON x.gram = y.gram AND x.r <> y.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE shared >= {threshold} * (na.n + nb.n - shared) - 1e-9),
c AS (SELECT r, r AS other FROM d UNION SELECT c.r, l.b FROM c JOIN l ON l.a = c.other)
SELECT d.doc_id, (SELECT min(o.doc_id) FROM c JOIN d o ON o.r = c.other WHERE c.r = d.r) AS class_id, (SELECT count(*) FROM l WHERE l.a = d.r) AS n_links FROM d"""
