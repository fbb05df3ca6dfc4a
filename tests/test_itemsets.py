import itertools
import random

import pytest
from pyspark.sql import functions as F

from basketry.operators import counters, dictionary, itemsets
from basketry.operators.rules import rules
from basketry.params import CFParams, MiningParams
from basketry.sources.memory import memory_baskets
from basketry.storage import materialize

TEN = ["ab", "acde", "bcdf", "abcd", "abcf", "bcdf", "abcde", "ace", "bcd", "cf"]


def as_dict(found):
    return {"".join(r["itemset"]): r["support"] for r in found.collect()}


def brute(baskets, least, max_k):
    sets = [set(b) for b in baskets]
    items = sorted(set().union(*sets)) if sets else []
    out = {}
    for k in range(1, max_k + 1):
        for c in itertools.combinations(items, k):
            n = sum(set(c) <= s for s in sets)
            if n >= least:
                out["".join(c)] = n
    return out


@pytest.mark.parametrize("name", sorted(itemsets.MINERS))
def test_ten_baskets(spark, name):
    occ = memory_baskets(spark, [list(b) for b in TEN])
    found = itemsets.MINERS[name](occ, MiningParams(3, 0.6, 0.4))
    assert as_dict(found.itemsets) == {"a": 6, "b": 7, "c": 9, "d": 6, "bc": 6, "cd": 6}
    deep = itemsets.MINERS[name](occ, MiningParams(3, 0.3, 0.4)).itemsets
    assert as_dict(deep) == brute(TEN, 3, 3) and deep.count() == 21


def test_ten_baskets_rules(spark):
    occ = memory_baskets(spark, [list(b) for b in TEN])
    few = rules(itemsets.apriori(occ, MiningParams(3, 0.6, 0.4)).itemsets, 0.4).collect()
    assert {("".join(r["antecedent"]), "".join(r["consequent"])): round(r["confidence"], 6) for r in few} == {("b", "c"): 0.857143, ("c", "b"): 0.666667, ("c", "d"): 0.666667, ("d", "c"): 1.0}
    many = rules(itemsets.apriori(occ, MiningParams(3, 0.3, 0.4)).itemsets, 0.4).collect()
    pairs = {("".join(r["antecedent"]), "".join(r["consequent"])): round(r["confidence"], 6) for r in many if len(r["consequent"]) == 2}
    assert len(many) == 45
    assert pairs == {("a", "bc"): 0.5, ("a", "cd"): 0.5, ("a", "ce"): 0.5, ("b", "ac"): 0.428571, ("b", "cd"): 0.714286, ("b", "cf"): 0.428571, ("c", "bd"): 0.555556, ("d", "ac"): 0.5, ("d", "bc"): 0.833333, ("e", "ac"): 1.0, ("f", "bc"): 0.75}


@pytest.mark.parametrize("seed", [1, 2])
def test_miners_against_brute_force(spark, seed):
    draw = random.Random(seed)
    baskets = [[i for i in "abcdefg" if draw.random() < 0.45] or ["a"] for _ in range(40)]
    occ = memory_baskets(spark, baskets)
    wanted = brute(baskets, MiningParams(4, 0.2).least_count(40), 4)
    for name, miner in itemsets.MINERS.items():
        assert as_dict(miner(occ, MiningParams(4, 0.2)).itemsets) == wanted, name
    assert as_dict(itemsets.vertical(occ, MiningParams(4, 0.2), chunk_baskets=7).itemsets) == wanted
    assert as_dict(itemsets.dhp(occ, MiningParams(4, 0.2), buckets=3).itemsets) == wanted


def test_no_frequent_item_and_no_baskets(spark):
    occ = memory_baskets(spark, [["a"], ["b"], ["c"]])
    for miner in itemsets.MINERS.values():
        assert miner(occ, MiningParams(2, 0.9)).itemsets.count() == 0
        assert miner(occ.filter("false"), MiningParams(2, 0.9)).itemsets.count() == 0


def test_bad_arguments():
    for wrong in ({"max_k": 0}, {"minsup": 0}, {"minconf": -1}, {"rounding": "up"}):
        with pytest.raises(ValueError):
            MiningParams(**wrong)
    with pytest.raises(ValueError):
        CFParams(top_n=-1)


def test_least_count_rounds_half_up():
    assert MiningParams(minsup=0.25).least_count(10) == 3
    assert MiningParams(minsup=0.25, rounding="floor").least_count(10) == 2
    assert MiningParams(minsup=0.01).least_count(3) == 1


def test_differences(spark):
    a = spark.createDataFrame([(1, ["a"], 3), (1, ["b"], 2), (2, ["a", "b"], 2)], "k int, itemset array<string>, support long")
    b = spark.createDataFrame([(1, ["a"], 4), (1, ["b"], 2), (1, ["c"], 2)], "k int, itemset array<string>, support long")
    assert {("".join(r["itemset"]), r["problem"]) for r in itemsets.differences(a, b).collect()} == {("a", "differing"), ("ab", "missing"), ("c", "redundant")}


def test_dictionary_and_order(spark):
    occ = memory_baskets(spark, [["b", "a", "a"], ["b", "c"]])
    assert [tuple(r) for r in dictionary.item_dictionary(occ).orderBy("item_id").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert [tuple(r) for r in dictionary.frequency_order(occ).orderBy("rank").collect()] == [("b", 2, 1), ("a", 1, 2), ("c", 1, 3)]
    assert counters.item_supports(occ, "occurrence").filter("item = 'a'").first()["support"] == 2
    with pytest.raises(ValueError):
        counters.item_supports(occ, "both")


def test_tuple_counters(spark):
    pairs = spark.createDataFrame([(1, 2, 3), (2, 1, 4), (1, 1, 9)], "i long, j long, n long")
    assert [tuple(r) for r in counters.pair_counter(pairs).collect()] == [(1, 2, 7)]
    triples = spark.createDataFrame([([3, 1, 2], 1), ([1, 2, 3], 2), ([1, 1, 2], 5), ([1, 2], 5)], "key array<long>, n long")
    assert [(r["key"], r["n"]) for r in counters.tuple_counter(triples, 3).collect()] == [([1, 2, 3], 3)]


def test_candidates_are_closed(spark):
    level = spark.createDataFrame([(["a", "b"],), (["a", "c"],), (["b", "c"],), (["b", "d"],)], "itemset array<string>").withColumn("k", F.lit(2))
    assert [r["itemset"] for r in itemsets.candidates(level).collect()] == [["a", "b", "c"]]


def test_equal_baskets_are_one_row(spark):
    kinds = ["abc"] * 300 + ["abd"] * 41 + ["bc"] * 7 + ["e"] * 3 + ["a"]
    occ = memory_baskets(spark, [list(x) for x in kinds])
    params = MiningParams(3, 0.01, 0.4)
    begun = itemsets.start(occ, params)
    assert {("".join(r["items"]), r["n"]) for r in begun.kinds.collect()} == {("abc", 300), ("abd", 41), ("bc", 7), ("a", 1)}
    wanted = {}
    for k in (1, 2, 3):
        for c in itertools.combinations("abcde", k):
            if (n := sum(set(c) <= set(x) for x in kinds)) >= begun.least:
                wanted[c] = n
    for miner in itemsets.MINERS.values():
        for of in (begun, occ):
            assert {tuple(r["itemset"]): r["support"] for r in miner(of, params).itemsets.collect()} == wanted


def test_what_baskets_hold_is_not_written(spark, monkeypatch):
    names = []
    monkeypatch.setattr(itemsets, "materialize", lambda df, name: names.append(name) or materialize(df, name))
    itemsets.apriori(memory_baskets(spark, [x.split() for x in ("a b c", "a b d", "a c d", "b c d", "a b c d")]), MiningParams(4, 0.2, 0.4))
    assert set(names) == {"seen", "baskets", "items", "candidates", "level"}
