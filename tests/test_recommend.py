import itertools
import re

import pytest

from basketry.operators import evaluate, recommend, similarity, strips
from basketry.operators.itemsets import apriori
from basketry.operators.rules import rules
from basketry.params import CFParams, MiningParams
from basketry.sources.memory import memory_ratings
from basketry.sources.tables import baskets_of_ratings

TOY = {0: {1: 3.0, 3: 4.0}, 1: {0: 3.0, 2: 3.0, 3: 2.0}, 2: {0: 4.0, 2: 1.5, 4: 1.5}, 3: {0: 2.5, 2: 4.0, 3: 3.0, 4: 3.0}, 4: {1: 3.5, 3: 4.5, 4: 2.5}}


@pytest.fixture(scope="module")
def toy(spark):
    return memory_ratings(spark, TOY).persist()


def pairs(sims):
    return {(r["a"], r["b"]): pytest.approx(r["sim"], abs=1e-6) for r in sims.collect()}


def test_pearson_and_euclidean(toy):
    assert pairs(similarity.user_similarities(toy)) == {(0, 1): 1, (0, 3): 1, (0, 4): 1, (1, 2): 1, (1, 3): 0.188982, (1, 4): 1, (2, 3): -0.755929, (2, 4): 1, (3, 4): 1}
    assert pairs(similarity.user_similarities(toy, similarity.euclidean)) == {(0, 1): 0.333333, (0, 3): 0.5, (0, 4): 0.585786, (1, 2): 0.356789, (1, 3): 0.4, (1, 4): 0.285714, (2, 3): 0.233715, (2, 4): 0.5, (3, 4): 0.387426}


def test_adjusted_cosine(toy):
    found = pairs(similarity.item_similarities(toy))
    assert found == {(0, 2): -0.803827, (0, 3): -0.299921, (0, 4): -0.873884, (1, 3): -0.447214, (1, 4): 1.0, (2, 3): -0.522113, (2, 4): 0.574606, (3, 4): -0.969231}


def test_user_based_one(toy):
    rows = recommend.user_based(toy, target=0).collect()
    assert {r["item_id"]: (r["raw"], r["score"]) for r in rows} == {0: (2.75, 3), 2: (3.5, 4), 4: (2.75, 3)}
    floor = recommend.user_based(toy, CFParams(rounding="floor"), target=0).collect()
    assert {r["item_id"]: r["score"] for r in floor} == {0: 2, 2: 3, 4: 2}
    best = recommend.user_based(toy, CFParams(top_n=2)).filter("user_id = 0").collect()
    assert {r["item_id"] for r in best} == {0, 2}


def test_top_matches(toy):
    sims = similarity.user_similarities(toy)
    assert [r["other"] for r in similarity.top_matches(sims, 3, 2).collect()] == [0, 4]
    assert similarity.top_matches(sims, 99, 2).collect() == []


def test_item_based_by_hand(toy):
    sims = {(r["a"], r["b"]): r["sim"] for r in similarity.item_similarities(toy).collect()}
    near = {frozenset(k): v for k, v in sims.items() if v > 0}
    wanted = {}
    for user, row in TOY.items():
        for j in range(5):
            w = [(near[frozenset((i, j))], s) for i, s in row.items() if frozenset((i, j)) in near]
            if j not in row and w:
                wanted[user, j] = round(sum(a * b for a, b in w) / sum(a for a, _ in w), 6)
    assert {(r["user_id"], r["item_id"]): r["raw"] for r in recommend.item_based(toy).collect()} == wanted


def test_hybrid_takes_common_items(toy):
    u, i = recommend.user_based(toy), recommend.item_based(toy)
    both = {(r["user_id"], r["item_id"]): r["raw"] for r in recommend.hybrid(u, i, 0.25).collect()}
    us, is_ = ({(r["user_id"], r["item_id"]): r["raw"] for r in x.collect()} for x in (u, i))
    assert both == {k: pytest.approx(0.75 * us[k] + 0.25 * is_[k], abs=1e-6) for k in us.keys() & is_.keys()}


def test_rule_based_by_hand(toy):
    found = rules(apriori(baskets_of_ratings(toy), MiningParams(3, 0.3, 0.6)).itemsets, 0.6)
    told = [(r["antecedent"], r["consequent"], r["confidence"]) for r in found.collect()]
    top, bottom = {}, {}
    for user, row in TOY.items():
        for a, c, conf in told:
            if set(a) <= row.keys():
                for item in c:
                    top[user, item] = top.get((user, item), 0) + conf * sum(row[i] for i in a)
                    bottom[user, item] = bottom.get((user, item), 0) + conf * len(a)
    assert {(r["user_id"], r["item_id"]): r["raw"] for r in recommend.rule_based(toy, found).collect()} == {k: pytest.approx(top[k] / bottom[k], abs=1e-6) for k in top}


def test_errors_count_missing_as_zero(spark, toy):
    test = memory_ratings(spark, {0: {0: 3.0, 7: 2.0}, 99: {1: 5.0}})
    row = evaluate.errors(recommend.user_based(toy), test, toy).first()
    assert (row["n"], row["mae"], row["rmse"]) == (2, pytest.approx((0.25 + 2) / 2), pytest.approx(((0.25**2 + 4) / 2) ** 0.5, abs=1e-6))


def test_predictions_at_all_thresholds(spark, toy):
    wanted = toy.select("user_id").distinct().crossJoin(toy.select("item_id").distinct())
    steps = [0.0, 0.19, 0.3, 0.45, 0.6]
    at = lambda rows, c: {(r["user_id"], r["item_id"], r[c]): pytest.approx(r["raw"], abs=1e-6) for r in rows.collect()}
    users, items = at(recommend.user_based_at(toy, steps, wanted), "user_threshold"), at(recommend.item_based_at(toy, steps, wanted), "item_threshold")
    assert users == {(r["user_id"], r["item_id"], t): r["raw"] for t in steps for r in recommend.user_based(toy, CFParams(t)).collect()}
    assert items == {(r["user_id"], r["item_id"], t): r["raw"] for t in steps for r in recommend.item_based(toy, CFParams(t)).collect()}


def test_repeated_ratings_count_once(spark):
    rows = [(0, 1, 5.0, 1), (0, 1, 1.0, 2), (1, 1, 4.0, 1), (1, 2, 2.0, 2), (1, 2, 3.0, 1), (2, 2, 1.0, 1), (2, 2, 1.0, 1)]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, score double, ts long")
    rules = spark.createDataFrame([([1, 2], [3], 0.9)], "antecedent array<long>, consequent array<long>, confidence double")
    assert [tuple(r) for r in recommend.rule_based(ratings, rules).collect()] == [(1, 3, 3.5)]
    assert {(r["a"], r["b"]): (r["n"], r["sxy"]) for r in similarity.pair_sums(similarity.user_rows(similarity.one_score(ratings))).collect()} == {(0, 1): (1, 20.0), (1, 2): (1, 3.0)}


def test_popular_keys_are_cut(spark):
    rows = spark.createDataFrame([(t, k, float(t * k % 5)) for t in range(60) for k in range(3) if (t + k) % 4], "thing long, key long, score double")
    sums = [sorted(map(tuple, similarity.pair_sums(rows, block).collect())) for block in (7, 1000)]
    assert sums[0] == sums[1] and len(sums[0]) > 1000


def test_grid_has_every_point(spark, toy):
    test = memory_ratings(spark, {0: {0: 3.0, 2: 2.0}, 3: {1: 4.0}, 99: {1: 5.0}})
    steps, alphas = [0.0, 0.3, 1.5], [0.5, 0.8]
    u, i = recommend.user_based_at(toy, steps, test), recommend.item_based_at(toy, steps, test)
    found = {(r["user_threshold"], r["item_threshold"], r["alpha"]): r["mae"] for r in evaluate.grid_search(u, i, test, toy, alphas, steps).collect()}
    assert set(found) == set(itertools.product(steps, steps, alphas))
    for (x, y, a), mae in found.items():
        both = recommend.hybrid(recommend.user_based(toy, CFParams(x)), recommend.item_based(toy, CFParams(y)), a)
        assert mae == pytest.approx(evaluate.errors(both, test, toy).first()["mae"], abs=2e-6)


@pytest.fixture(scope="module")
def crowd(spark):
    """Two strips of users; items that all rate, that few rate, and that a few tens rate."""
    rows = [(f"u{u:04}", i, float((u * 7 + i * 3 + u // 11) % 9 + 1)) for u in range(200) for i in range(70) if (u + i) % (1 + i) == 0 or (u * i) % 13 == 5]
    return spark.createDataFrame(rows, "user_id string, item_id long, score double").persist()


def both_forms(monkeypatch, make):
    """What ``make`` gives by strips and by joins, sorted, with real numbers last and rounded."""
    out = []
    for few in (0, 10**9):
        monkeypatch.setattr(strips, "FEW_THINGS", few)
        found = make().toPandas().round(6)
        out.append(found.sort_values(list(found.columns), ignore_index=True))
    assert len(out[0]) > 500
    return out


def is_one_pass(df):
    """No pair is a row of a join or an aggregate."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.index("MapInArrow") < min((plan.find(x) for x in ("Aggregate", "Join") if x in plan), default=len(plan))


def test_pair_sums_by_strips(crowd, monkeypatch):
    rows = similarity.user_rows(crowd)
    strip, join = both_forms(monkeypatch, lambda: similarity.pair_sums(rows))
    assert strip.equals(join[strip.columns])
    monkeypatch.setattr(strips, "FEW_THINGS", 0)
    assert is_one_pass(similarity.pair_sums(rows, only=("n",)))


@pytest.mark.parametrize("measure", [similarity.euclidean, similarity.pearson, similarity.cosine])
def test_similarities_by_strips(crowd, monkeypatch, measure):
    strip, join = both_forms(monkeypatch, lambda: similarity.user_similarities(crowd, measure))
    assert list(strip["a"]) == list(join["a"]) and list(strip["b"]) == list(join["b"])
    assert abs(strip["sim"] - join["sim"]).max() < 2e-6
    monkeypatch.setattr(strips, "FEW_THINGS", 0)
    assert is_one_pass(similarity.user_similarities(crowd, measure))


@pytest.mark.parametrize("threshold", [0.2, -0.4])
def test_user_based_by_strips(crowd, monkeypatch, threshold):
    strip, join = both_forms(monkeypatch, lambda: recommend.user_based(crowd, CFParams(threshold)).drop("score").filter("abs(raw) < 1e6"))
    assert list(strip["user_id"]) == list(join["user_id"]) and list(strip["item_id"]) == list(join["item_id"])
    assert abs(strip["raw"] - join["raw"]).max() < (2e-6 if threshold > 0 else 1e-3)  # weights of both signs may nearly cancel


def test_mean_centred_by_strips(crowd, monkeypatch):
    strip, join = both_forms(monkeypatch, lambda: recommend.mean_centred(crowd, CFParams(0.2)).drop("score"))
    assert list(strip["user_id"]) == list(join["user_id"]) and list(strip["item_id"]) == list(join["item_id"])
    assert abs(strip["raw"] - join["raw"]).max() < 2e-6


def test_thresholds_by_strips(crowd, monkeypatch):
    wanted = crowd.select("user_id").distinct().crossJoin(crowd.select("item_id").distinct().filter("item_id % 5 = 0"))
    strip, join = both_forms(monkeypatch, lambda: recommend.user_based_at(crowd, [0.0, 0.25, 0.9], wanted))
    assert len(strip) == len(join) and strip["user_threshold"].nunique() == 3
    assert (strip.drop(columns="raw") == join[strip.columns].drop(columns="raw")).all().all()
    assert abs(strip["raw"] - join["raw"]).max() < 2e-6


def test_odd_scores_are_joined(spark, monkeypatch):
    monkeypatch.setattr(strips, "FEW_THINGS", 0)
    rows = [(t, k, float(t + k)) for t in range(20) for k in range(3)]
    for odd in ((20, 0, None), (20, None, 1.0), (None, 0, 1.0), (20, 0, float("nan")), (20, 0, 1e80)):
        assert strips.lay_out(similarity.stored(spark.createDataFrame([*rows, odd], "thing long, key long, score double"))) is None
    assert strips.lay_out(similarity.stored(spark.createDataFrame(rows, "thing long, key long, score double"))).things == 20


def test_rules_of_one_antecedent_are_one(spark, toy):
    """Users are joined to antecedents, not to rules."""
    told = [([1], [3], 0.9), ([1], [4], 0.8), ([1], [3, 4], 0.5), ([1, 3], [4], 0.7)]
    rules_ = spark.createDataFrame(told, "antecedent array<long>, consequent array<long>, confidence double")
    found = recommend.rule_based(toy, rules_)
    assert {(r["user_id"], r["item_id"]): r["raw"] for r in found.filter("user_id = 0").collect()} == {(0, 3): 3.0, (0, 4): pytest.approx((0.8 * 3 + 0.5 * 3 + 0.7 * 7) / (0.8 + 0.5 + 0.7 * 2), abs=1e-6)}
    # ratings are shuffled to have one score each and then by user, and what rules give isn't
    assert len(re.findall(r"Exchange hashpartitioning\(user_id#\d+L?, ", found._jdf.queryExecution().executedPlan().toString())) - 1 == len(re.findall(r"REPARTITION_BY_NUM", found._jdf.queryExecution().executedPlan().toString())) == 1
