"""Pairs of things that share keys, where so many do that a row for each shared key is too much.

Things are numbered and cut into strips. A task holds one strip and lets all other things pass by in
tiles of TILE; sums over shared keys of a tile and a part of the strip are matrix products, so a
pair is never a row of a shuffle. What is shuffled is each thing's ratings, once for each strip, and
the number of strips is fixed unless results of a strip take more than CELLS. Frequent keys are
columns of matrices, the others are matched one by one. A thing has one score for a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.dictionary import with_dense_ids
from basketry.storage import materialize

#: Things of a tile, and rows of a tile that are worked on at once.
TILE = 1024
ROWS = 256
#: Strips of things, unless they would have fewer than LEAST things.
STRIPS = 96
LEAST = 128
#: Numbers that a task sums up, or rows of shared rare keys that it makes, at once.
CELLS = 4_000_000
#: Fewer things are joined: their pairs are few, and shared keys are summed up before the shuffle.
FEW_THINGS = 2048
#: Keys that are columns of matrices: at most so many, each of a 32nd of all things or more.
HOT_KEYS, HOT_SHARE = 1024, 32
#: Beyond that, keys are not numbered.
MANY_KEYS = 1 << 17
#: Ratings of a thing that travel in one row.
PIECE = 256

#: Measures over sums of a part of a tile: which sums, and the function.
Measure = tuple[tuple[str, ...], Callable[[dict[str, np.ndarray]], np.ndarray]]


class _Tile:
    """Things, in the order of their numbers, and their scores."""

    def __init__(self, parts: list[pa.RecordBatch], hot: int, centred: bool):
        number = np.concatenate([p.column("number").to_numpy() for p in parts])
        lists = [p.column("ratings") for p in parts]
        flat = [x.flatten() for x in lists]
        sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists])
        key = np.concatenate([x.field("id").to_numpy() for x in flat])
        score = np.concatenate([x.field("score").to_numpy() for x in flat])
        self.numbers, first, row = np.unique(number, return_index=True, return_inverse=True)
        self.things = pa.concat_arrays([p.column("thing") for p in parts]).take(pa.array(first))
        row = np.repeat(row, sizes)
        n = self.size = len(self.numbers)
        value = score - (np.bincount(row, score, n) / np.bincount(row, minlength=n))[row] if centred else score
        order = np.argsort(key, kind="stable")
        self.key, self.row, self.score, self.value = key[order], row[order], score[order], value[order]
        self.cold = int(np.searchsorted(self.key, hot))
        at = (self.row[: self.cold], self.key[: self.cold])
        self.has, self.x, self.v = np.zeros((n, hot)), np.zeros((n, hot)), np.zeros((n, hot))
        self.has[at], self.x[at], self.v[at] = 1.0, self.score[: self.cold], self.value[: self.cold]
        self.xx = self.x * self.x


def _shared_rare(a: _Tile, low: int, high: int, b: _Tile) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cells (of rows ``low`` to ``high`` of ``a`` and all of ``b``) that share a rare key, and both scores."""
    mine = np.flatnonzero((a.row[a.cold :] >= low) & (a.row[a.cold :] < high)) + a.cold
    keys = b.key[b.cold :]
    begin, end = np.searchsorted(keys, a.key[mine], "left"), np.searchsorted(keys, a.key[mine], "right")
    times = end - begin
    mine, begin, times = mine[times > 0], begin[times > 0], times[times > 0]
    step = np.cumsum(times) // CELLS
    for part in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(step)) + 1) if len(mine) else ():
        n = times[part]
        theirs = np.repeat(begin[part] - (np.cumsum(n) - n), n) + np.arange(n.sum()) + b.cold
        own = np.repeat(mine[part], n)
        yield (a.row[own] - low) * b.size + b.row[theirs], a.score[own], b.score[theirs]


def _sums(a: _Tile, low: int, high: int, b: _Tile, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Sums over shared keys of the things ``low`` to ``high`` of ``a`` with each of ``b``."""
    has, x, xx = a.has[low:high], a.x[low:high], a.xx[low:high]
    make = {
        "n": lambda: has @ b.has.T, "sx": lambda: x @ b.has.T, "sy": lambda: has @ b.x.T, "sxx": lambda: xx @ b.has.T,
        "syy": lambda: has @ b.xx.T, "sxy": lambda: x @ b.x.T, "sdd": lambda: _squares(has, x, b),
    }
    out = {name: make[name]() for name in names}
    if a.cold < len(a.key) and b.cold < len(b.key):
        for cell, p, q in _shared_rare(a, low, high, b):
            more = {"n": None, "sx": p, "sy": q, "sxx": p * p, "syy": q * q, "sxy": p * q, "sdd": (p - q) * (p - q)}
            for name in names:
                out[name] += np.bincount(cell, more[name], (high - low) * b.size).reshape(high - low, b.size)
    return out


def _squares(has: np.ndarray, x: np.ndarray, b: _Tile) -> np.ndarray:
    """Summed squared differences: not from products, which would lose small ones."""
    out = np.zeros((len(x), b.size))
    for k in np.flatnonzero(has.any(0) & b.has.any(0)):
        off = x[:, k, None] - b.x[:, k]
        off *= off
        if not has[:, k].all():
            off *= has[:, k, None]
        if not b.has[:, k].all():
            off *= b.has[:, k]
        out += off
    return out


class _Strip:
    """One strip in its task: first come its own things, then those that pass by."""

    def __init__(self, hot: int, centred: bool, seen: Callable[[_Tile, _Tile], Iterator[pa.RecordBatch]], ended: Callable[[_Tile], Iterator[pa.RecordBatch]]):
        self.hot, self.centred, self.seen, self.ended = hot, centred, seen, ended
        self.own: list[_Tile] = []
        self.waiting: list[pa.RecordBatch] = []
        self.at = (-1, -1)

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Rows of one side, ascending by number."""
        side, tiles = rows.column("side")[0].as_py(), rows.column("number").to_numpy() // TILE
        cuts = [0, *(np.flatnonzero(np.diff(tiles)) + 1).tolist(), len(tiles)]
        for low, high in zip(cuts, cuts[1:]):
            if self.at != (side, tiles[low]):
                yield from self.flush()
                self.at = (side, tiles[low])
            self.waiting.append(rows.slice(low, high - low))

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.waiting:
            tile = _Tile(self.waiting, self.hot, self.centred)
            self.waiting = []
            if self.at[0] == 0:
                self.own.append(tile)
            else:
                for mine in self.own:
                    yield from self.seen(mine, tile)

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self.flush()
        for mine in self.own:
            yield from self.ended(mine)


def _walk(batches: Iterator[pa.RecordBatch], new: Callable[[], _Strip]) -> Iterator[pa.RecordBatch]:
    now, strip = None, None
    for batch in batches:
        which, side = batch.column("strip").to_numpy(), batch.column("side").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(which * 2 + side)) + 1).tolist(), len(which)] if len(which) else [0]
        for low, high in zip(cuts, cuts[1:]):
            if strip is None or which[low] != now:
                if strip is not None:
                    yield from strip.end()
                now, strip = which[low], new()
            yield from strip.add(batch.slice(low, high - low))
    if strip is not None:
        yield from strip.end()


@dataclass
class Layout:
    """number, thing, ratings (id, score) of things; key, id of keys; how many there are."""

    packed: DataFrame
    keys: DataFrame
    things: int
    hot: int
    n_keys: int
    types: dict[str, str]

    def _dealt(self, least: int, all_strips: bool, cells: int = 1) -> DataFrame:
        """Each thing once in its own strip (side 0), and in all that it passes by (side 1): up to its own, or all."""
        size = min(max(least, -(-self.things // STRIPS)), max(16, CELLS // cells))
        strips, own = -(-self.things // size), F.floor(F.col("number") / size).cast("int")
        there = F.sequence(F.lit(0), F.lit(strips - 1) if all_strips else own)
        rows = self.packed.withColumn("at", F.explode(F.concat(F.array(F.struct(own.alias("strip"), F.lit(0).alias("side"))), F.transform(there, lambda s: F.struct(s.alias("strip"), F.lit(1).alias("side"))))))
        rows = rows.select("at.strip", "at.side", "number", "thing", "ratings")
        return rows.repartitionById(strips, F.col("strip")).sortWithinPartitions("strip", "side", "number")

    def pairs(self, names: tuple[str, ...], measure: Measure | None = None, least: int = LEAST) -> DataFrame:
        """a, b (a < b) of all that share a key, with the sums ``names``, or with sim by ``measure``."""
        hot = self.hot
        wanted = tuple(dict.fromkeys(("n", *(measure[0] if measure else names))))
        shown = ("sim",) if measure else names

        def seen(a: _Tile, b: _Tile) -> Iterator[pa.RecordBatch]:
            if b.numbers[-1] <= a.numbers[0]:
                return
            for low in range(0, a.size, ROWS):
                high = min(a.size, low + ROWS)
                sums = _sums(a, low, high, b, wanted)
                there = sums["n"] > 0
                if a.numbers[high - 1] >= b.numbers[0]:
                    there &= a.numbers[low:high, None] < b.numbers
                i, j = np.nonzero(there)
                if measure:
                    sums = {"sim": measure[1](sums)}
                told = [sums[x][there].astype(np.int64) if x == "n" else sums[x][there] for x in shown]
                if len(i):
                    yield pa.RecordBatch.from_arrays([a.things.take(pa.array(i + low)), b.things.take(pa.array(j)), *map(pa.array, told)], ["a", "b", *shown])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _walk(batches, lambda: _Strip(hot, False, seen, lambda mine: iter(())))

        told = ", ".join(f"{x} {'long' if x == 'n' else 'double'}" for x in shown)
        return self._dealt(least, all_strips=False).mapInArrow(run, f"a {self.types['thing']}, b {self.types['thing']}, {told}")

    def weighted(self, measure: Measure, thresholds: list[float], centred: bool = False, least: int = LEAST) -> DataFrame:
        """thing, key, step, top, bottom of each thing and key that it has not: sums of weight times score, and of weight, over the others that have the key.

        The weight is the similarity where it is above ``thresholds``[``step``]. With ``centred``,
        its size is to be above, scores are less their thing's mean, and ``bottom`` sums sizes.
        """
        hot, n_keys, steps = self.hot, self.n_keys, list(thresholds)
        wanted = tuple(dict.fromkeys(("n", *measure[0])))

        def seen(a: _Tile, b: _Tile) -> Iterator[pa.RecordBatch]:
            if not hasattr(a, "top"):
                # number of others, so that weights that add up to nothing are told from none
                a.top, a.bottom, a.count = (np.zeros((len(steps), a.size, n_keys)) for _ in range(3))
            for low in range(0, a.size, ROWS):
                high = min(a.size, low + ROWS)
                sums = _sums(a, low, high, b, wanted)
                sim = measure[1](sums)
                there = sums["n"] > 0
                if a.numbers[low] <= b.numbers[-1] and b.numbers[0] <= a.numbers[high - 1]:
                    there &= a.numbers[low:high, None] != b.numbers
                size = np.abs(sim) if centred else sim
                size = np.where(there, size, -np.inf)
                for k, step in enumerate(steps):
                    near = size > step
                    if not near.any():
                        continue
                    weight = np.where(near, sim, 0.0)
                    self_weight = np.abs(weight) if centred else weight
                    at = (k, slice(low, high))
                    a.top[at][:, :hot] += weight @ b.v
                    a.bottom[at][:, :hot] += self_weight @ b.has
                    if step < 0:
                        a.count[at][:, :hot] += near.astype(float) @ b.has
                    # rare keys, a few at a time
                    wide = max(1, CELLS // (high - low))
                    for first in range(b.cold, len(b.key), wide):
                        part = slice(first, first + wide)
                        keys, begin = np.unique(b.key[part], return_index=True)
                        rows = b.row[part]
                        a.top[at][:, keys] += np.add.reduceat(weight[:, rows] * b.value[part], begin, axis=1)
                        a.bottom[at][:, keys] += np.add.reduceat(self_weight[:, rows], begin, axis=1)
                        if step < 0:
                            a.count[at][:, keys] += np.add.reduceat(near[:, rows].astype(float), begin, axis=1)
            return
            yield

        def ended(a: _Tile) -> Iterator[pa.RecordBatch]:
            if not hasattr(a, "top"):
                return
            for k, step in enumerate(steps):
                found = (a.count[k] if step < 0 else a.bottom[k]) > 0
                found[a.row, a.key] = False
                i, j = np.nonzero(found)
                yield pa.RecordBatch.from_arrays([a.things.take(pa.array(i)), pa.array(j, pa.int64()), pa.array(np.full(len(i), k, np.int32)), pa.array(a.top[k][found]), pa.array(a.bottom[k][found])], ["thing", "id", "step", "top", "bottom"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _walk(batches, lambda: _Strip(hot, centred, seen, ended))

        dealt = self._dealt(least, all_strips=True, cells=3 * n_keys * len(steps))
        found = dealt.mapInArrow(run, f"thing {self.types['thing']}, id long, step int, top double, bottom double")
        return found.join(F.broadcast(self.keys), "id").select("thing", "key", "step", "top", "bottom")


def lay_out(rows: DataFrame) -> Layout | None:
    """Things and keys of stored (thing, key, score) rows, numbered; None where joining them by key is no worse.

    That is so for few things, where few pairs share a key, or for too many keys. Rows with nulls,
    and scores that are no numbers or whose powers might not be, are left to the join too.
    """
    odd = F.col("thing").isNull() | F.col("key").isNull() | F.col("score").isNull() | ~(F.abs("score") < 1e70)
    sizes = materialize(rows.groupBy("key").agg(F.count("*").alias("n"), F.max(odd).alias("odd")), "key-sizes")
    n = F.col("n").cast("double")
    told = sizes.agg(F.count("*").alias("keys"), F.sum(n * (n - 1) / 2).alias("shared"), F.max("odd").alias("odd")).first()
    if not told["keys"] or told["odd"] or told["keys"] > MANY_KEYS:
        return None
    things = rows.select("thing").distinct()
    count = things.count()
    if count <= FEW_THINGS or told["shared"] * 16 < count * (count - 1) / 2:
        return None
    # the most frequent keys first
    keys = with_dense_ids(sizes.withColumn("_order", F.struct((-F.col("n")).alias("n"), "key")), "_order", "id").select("key", "id", "n")
    hot = min(HOT_KEYS, keys.filter(F.col("n") * HOT_SHARE >= count).count())
    numbers = with_dense_ids(things, "thing", "number")
    ratings = rows.join(F.broadcast(keys), "key").groupBy("thing", F.floor(F.col("id") / PIECE).alias("piece")).agg(F.collect_list(F.struct("id", "score")).alias("ratings"))
    packed = ratings.join(numbers, "thing").select("number", "thing", "ratings")
    return Layout(packed, keys.select("key", "id"), count, hot, told["keys"], {c: rows.schema[c].dataType.simpleString() for c in ("thing", "key")})
