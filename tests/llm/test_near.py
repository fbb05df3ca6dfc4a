"""The n-gram join and the permutation index against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import ann_permutation, components, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, threshold=0.8):
    """(n_links, class id) of each row, in order."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, least.get(find(i)) if s else d, n) for i, ((d, _), s, n) in enumerate(zip(rows, sets, links))]


def some_rows():
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(400)]
    base = [draw.choices(words, k=120) for _ in range(12)]
    rows = []
    for b in base:
        for _ in range(draw.randint(1, 12)):
            w = list(b)
            for _ in range(draw.randint(0, 5)):
                w[draw.randrange(len(w))] = draw.choice(words)
            rows.append(" ".join(w))
    rows += [rows[0]] * 5 + ["", None, " \n ", "one two", "one two", "one  two\n", "a b c d e", "a b c d e f", "x " * 3000]
    out = [(k * 3, t) for k, t in enumerate(rows)]
    return [*out, out[1], (None, rows[3]), (None, rows[3]), (None, "nobody else says this at all")]


@pytest.mark.parametrize("block", [256, 4])
def test_join_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = some_rows()
    docs = spark.createDataFrame([(d, t, "p", 1) for d, t in rows], "doc_id long, text string, pick string, set_id int").repartition(5)
    found = ngram_join.ngram_join(docs).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute(rows)))


def test_sets_that_share_an_id_are_told_apart(spark):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.ngram_classes(docs, id_bits=7).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute(rows)))


def test_join_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_join(docs).collect() == []
    assert ngram_join.ngram_join(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == [(1, 1, 0)]


def test_pruning_keeps_what_reaches_the_threshold():
    steps = [16, 32, 48, 64, 80]
    needed = ngram_join.least_matches(0.8, 1e-6, steps)
    assert needed == sorted(needed) and needed[0] > 0
    draw = np.random.default_rng(1)
    a = draw.integers(0, 256, (4000, 80), dtype=np.uint8)
    for similarity, least, most in ((0.8, 0.998, 1), (0.2, 0, 0.01)):
        b = np.where(draw.random(a.shape) < similarity, a, draw.integers(0, 256, a.shape, dtype=np.uint8))
        share = len(ngram_join.pruned(a, b, needed, steps)) / len(a)
        assert least <= share <= most


def test_components(spark):
    chain = [(k + 1, k) for k in range(40)] + [(100, 101), (7, 7), (103, 102), (102, 101)]
    found = {(r["node"], r["root"]) for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {(k, 0) for k in range(41)} | {(k, 100) for k in (100, 101, 102, 103)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_a_star_and_bridges(spark):
    """A hot node, whose edges are spread, and chains that hang on it."""
    star = [(k, 5000) for k in range(6000, 9000)] + [(k, k + 1) for k in range(100)] + [(100, 6500), (9001, 9002)]
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(star, "a long, b long").repartition(3)).collect()}
    assert found == {**{k: 0 for k in [*range(101), 5000, *range(6000, 9000)]}, 9001: 9001, 9002: 9001}


def test_footrule():
    draw = np.random.default_rng(0)
    lists = np.stack([draw.permutation(40)[:16] for _ in range(30)])
    place = lambda x: {p: i for i, p in enumerate(x)}
    by_hand = [sum(abs(place(x).get(p, 16) - place(lists[0]).get(p, 16)) for p in {*x, *lists[0]}) for x in lists.tolist()]
    assert ann_permutation._footrule(lists, lists[0], 40).tolist() == by_hand


def test_probes_follow_the_true_neighbours():
    order = np.asarray([3, 1, 0, 2])
    truth = [(0.9, order, np.asarray([1, 2])), (0.8, order, np.asarray([3, 0])), (0.7, order, np.asarray([2]))]
    assert [ann_permutation.needed_probes(truth, 4, t) for t in (0.3, 0.6, 1.0)] == [1, 2, 4]
    assert ann_permutation.needed_probes([], 4, 0.9) == 4


def nearest_by_hand(vectors, queries, k=5):
    ids = [i for i, _ in vectors]
    x = np.asarray([v for _, v in vectors], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, v in vectors:
        if i in queries:
            s = x @ (np.asarray(v, dtype=float) / np.linalg.norm(v))
            out[i] = sorted((-round(float(b), 12), a) for a, b in zip(ids, s) if a != i)[:k]
    return out


def test_index_of_few_vectors_is_exact(spark):
    draw = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in draw.normal(size=8)]) for i in range(40)]
    vectors += [(100 + i, vectors[0][1]) for i in range(9)]
    bad = [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [1.0] * 7), (204, [float("inf")] + [1.0] * 7), (205, [None] + [1.0] * 7), (None, [1.0] * 8)]
    rows = [(i, v, "f") for i, v in [*vectors, *bad, vectors[3]]]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>, file string")
    found = {}
    for r in ann_permutation.nearest(data, F.col("vec_id") % 20 == 0, probes=256).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    single = [(i, np.asarray(v, dtype=np.float32).astype(float)) for i, v in vectors]
    wanted = nearest_by_hand(single, {0, 20, 100})
    assert set(found) == set(wanted)
    for q, rows in wanted.items():
        assert [v for _, v in found[q]] == [v for _, v in rows]
        assert [s for s, _ in found[q]] == pytest.approx([s for s, _ in rows], abs=1e-9)


def test_index_recall(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(4000, 32))
    data = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    rows = ann_permutation.nearest(data, F.col("vec_id") % 50 == 0).collect()
    wanted = nearest_by_hand(list(enumerate(x)), set(range(0, 4000, 50)))
    hits = sum(r["vec_id"] in {v for _, v in wanted[r["query_id"]]} for r in rows)
    assert len(rows) == 400 and hits / 400 >= 0.9


def test_blocks_lose_nothing(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(600, 8))
    x[:300] = x[0] + draw.normal(size=(300, 8)) / 50  # half of all vectors crowd on one pivot
    data = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    ask = F.col("vec_id") % 20 == 0
    found = [sorted(map(tuple, ann_permutation.nearest(data, ask, pivots=16, prefix=16, probes=16, part=1.0, block=b, query_block=q).select("query_id", "rank", "vec_id").collect())) for b, q in ((16384, 4096), (20, 3))]
    assert found[0] == found[1]
    wanted = nearest_by_hand(list(enumerate(x)), set(range(0, 600, 20)))
    assert [(q, v) for q, _, v in found[0]] == [(q, v) for q in sorted(wanted) for _, v in wanted[q]]


def test_index_of_nothing(spark):
    data = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert ann_permutation.nearest(data, F.lit(True)).collect() == []
    alone = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert ann_permutation.nearest(alone, F.lit(True)).collect() == []
