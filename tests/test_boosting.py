"""Boosted trees against a plain version of the same rules."""

import numpy as np
import pytest

from pairloom.operators import boosting
from pairloom.operators.boosting import boosted_scores, fit_boosted
from pairloom.operators.model import predict_pairs, train_link_classifier


def data(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    x[:, 2] = rng.integers(0, 3, n)
    y = ((x[:, 0] + 0.5 * x[:, 2] + 0.3 * rng.normal(size=n)) > 0.5).astype(int)
    return x, y


def frame(spark, x, y):
    rows = [(i, *map(float, r), int(t) if t is not None else None, "x") for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int, _scores string").repartition(3)


def plain(bins, y, features, rounds, depth, rate, weight):
    """Row lists and nested loops."""
    m, w = np.zeros(len(y)), np.where(y == 1, weight, 1.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m))
        g, h = w * (p - y), w * p * (1 - p)
        groups = [np.arange(len(y))]
        for _ in range(depth):
            split = []
            for rows in groups:
                best = (1e-9, None)
                for f in features:
                    for b in range(16):
                        inside = bins[rows, f] <= b
                        left, right = rows[inside], rows[~inside]
                        if h[left].sum() < 1 or h[right].sum() < 1:
                            continue
                        s = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1)
                        gain = s(left) + s(right) - s(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, (left, right))
                split += list(best[1]) if best[1] is not None else [rows, rows[:0]]
            groups = split
        for rows in groups:
            m[rows] -= rate * g[rows].sum() / (h[rows].sum() + 1)
    return 1 / (1 + np.exp(-m))


@pytest.mark.parametrize("refresh,few", [(1, 64), (8, 0)])
def test_two_subsets_fitted_together_equal_plain_trees(spark, monkeypatch, refresh, few):
    monkeypatch.setattr(boosting, "REFRESH", refresh)
    monkeypatch.setattr(boosting, "FEW_TASKS", few)
    x, y = data()
    df = frame(spark, x, y)
    model = fit_boosted(df, {"one": ["c"], "all": ["a", "b", "c"]}, rounds=4, depth=3, rate=0.3)
    got = {r.id: r for r in boosted_scores(model, df).collect()}
    bins = model.bins(x[:, ["abc".index(c) for c in model.columns]])
    at = {c: i for i, c in enumerate(model.columns)}
    for name, cols in (("one", "c"), ("all", "abc")):
        want = plain(bins, y, [at[c] for c in cols], 4, 3, 0.3, 10.0)
        assert np.allclose([got[i][f"score_{name}"] for i in range(len(y))], want)


def test_held_out_pairs_and_odd_rows(spark):
    x, y = data(600, 2)
    df = frame(spark, x, y)
    model = train_link_classifier(df.where("id < 400"), ["a", "b", "c"], rounds=10, rate=0.3, positive_weight=1.0)
    out = predict_pairs(model, df.where("id >= 400").withColumn("score", df.a)).collect()
    assert np.mean([(r.score > 0.5) == (r.label == 1) for r in out]) > 0.85
    odd = spark.createDataFrame([(1, None, float("nan"), 5.0, None), (2, 0.0, 0.0, 0.0, 1)], "id long, a double, b double, c double, label int")
    assert all(0 < r.score < 1 for r in predict_pairs(model, odd).collect())
    assert {r.score for r in predict_pairs(train_link_classifier(df.limit(0), ["a"], rounds=2), odd).collect()} == {0.5}


def test_levels_are_not_planned_one_by_one(spark):
    """Queries planned for six rounds of three levels: bin edges, the table of blocks, the margins after three rounds, and few besides."""
    x, y = data()
    df = frame(spark, x, y)
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()

    def planned():
        df.count()
        bus.waitUntilEmpty()
        return store.executionsList().last().executionId()

    before = planned()
    fit_boosted(df, {"all": ["a", "b", "c"]}, rounds=6, depth=3)
    assert planned() - before < 9
