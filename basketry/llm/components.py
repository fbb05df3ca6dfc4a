"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import discard, materialize
from basketry.storage import HOT_PARTS


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for every end of ``edges`` (a, b: long).

    Each round relinks neighbours to a node's least neighbour, by an aggregate that is partial on
    the map side and a join, so that no task holds a node's neighbourhood; the table stays linear in
    the number of nodes. Nodes with more than a ``HOT_PARTS``-th of all edges, ``HOT_PARTS`` at
    most, are found first: their least neighbours are part of the plan and their edges stay where
    they are. Rounds end when the edges no longer change and every edge leads to a root. The edges
    of a round are deleted after the next.
    """
    now = materialize(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _survey(now, 2 * now.count())
    for _ in range(max_rounds):
        if not state[0]:
            break
        before, last = state, now
        now = materialize(_small_star(_large_star(now, state[2])), "edges")
        state = _survey(now, 2 * state[0])
        discard(last)
        if state[:2] == before[:2]:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _survey(edges: DataFrame, total: int) -> tuple[int, int, dict[int, int]]:
    """How many edges there are, a hash of them, and the nodes with more than a ``HOT_PARTS``-th of ``total`` ends, with the least of each and its neighbours."""
    both = edges.select("a", "b", F.xxhash64("a", "b").alias("h")).union(edges.select("b", "a", F.lit(0).cast("long")))
    nodes = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"), F.bit_xor("h").alias("h"))
    hot = F.collect_list(F.when(F.col("n") * HOT_PARTS > total, F.struct("a", F.least("a", "low").alias("low"))))
    row = nodes.agg(F.sum("n").alias("n"), F.bit_xor("h").alias("h"), hot.alias("hot")).first()
    return (row["n"] or 0) // 2, row["h"], {r["a"]: r["low"] for r in row["hot"]}


def _large_star(edges: DataFrame, hot: dict[int, int]) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    cold = both.filter(~F.col("a").isin(*hot)) if hot else both
    least = cold.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    linked = cold.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    if hot:
        low = F.create_map(*(F.lit(x) for pair in hot.items() for x in pair))
        spread = both.filter(F.col("a").isin(*hot) & (F.col("b") > F.col("a")))
        linked = linked.union(spread.select(F.col("b").alias("a"), low[F.col("a")].alias("b")))
    return linked.filter(F.col("a") != F.col("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    # a node's smaller neighbours are few: edges lead to the least of a tree from the start
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return linked.union(least.select("a", F.col("low").alias("b"))).filter(F.col("a") != F.col("b")).distinct()
