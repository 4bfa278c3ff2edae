"""The golden graph: left nodes 0-3, right nodes 4-7, worked out by hand."""

import math
import random
from itertools import combinations

import pytest

from pairloom.operators import cooc, evaluate, graph, paths, sampling

EDGES = [(0, 4), (0, 5), (0, 6), (1, 4), (1, 5), (2, 5), (2, 6), (2, 7), (3, 4), (3, 7)]
TARGETS = [(0, 4), (0, 7), (1, 6), (1, 7), (2, 4), (3, 5), (3, 6), (1, 8)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "left long, right long").cache()


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame(TARGETS, "left long, right long").cache()


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_observations_k1(edges, targets):
    got = {}
    for r in cooc.observations(edges, targets, 1).orderBy("left", "right", "combo").collect():
        got.setdefault((r.left, r.right), []).append(round(r.x, 6))
    assert got == {
        (0, 4): [1.0, 0.666667, 0.5],
        (0, 7): [0.42062, 0.42062, 0.63093],
        (1, 6): [0.333333, 0.666667],
        (1, 7): [0.333333, 0.333333],
        (2, 4): [0.666667, 0.5, 0.5],
        (3, 5): [0.528321, 0.396241],
        (3, 6): [0.333333, 0.5],
    }


@pytest.mark.parametrize("walked", [False, True])
def test_observations_k2(edges, targets, walked):
    f = cooc.observations_walked if walked else cooc.observations
    got = {}
    for r in f(edges, targets, 2).orderBy("left", "right", "combo").collect():
        got.setdefault((r.left, r.right), []).append(round(r.x, 6))
    assert got == {(0, 4): [1.0, 1.0, 0.5], (0, 7): [0.63093], (1, 6): [0.5], (2, 4): [0.5]}


@pytest.mark.parametrize("k", [1, 2])
def test_walk_equals_joins_without_self(edges, targets, k):
    a = cooc.observations(edges, targets, k, exclude_self=True)
    b = cooc.observations_walked(edges, targets, k, exclude_self=True)
    key = lambda df: sorted((r.left, r.right, tuple(r.combo), round(r.x, 5)) for r in df.collect())
    assert key(a) == key(b)


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("k", [2, 3])
def test_a_crowded_walk_is_dealt_over_groups(spark, k, exclude_self):
    """Item 0 is everyone's, node 0 has every item: few rows a group, few subsets at a time and a plain count agree."""
    rng = random.Random(4)
    e = sorted({(u, 0) for u in range(12)} | {(0, v) for v in range(8)} | {(rng.randrange(12), rng.randrange(8)) for _ in range(40)})
    of = {u: {b for a, b in e if a == u} for u, _ in e}
    goals = [(u, v) for u in (0, 3, 7) for v in range(9)]
    want = {}
    for u, v in goals:
        for combo in combinations(sorted(of[u]), k):
            who = [w for w in of if set(combo) <= of[w] and not (exclude_self and w == u)]
            if c := sum(v in of[w] for w in who):
                want[u, v, combo] = round(c / len(who) / math.log1p(sum(b == v for _, b in e)) * math.log1p(len(of[u])), 9)
    df, pairs = (spark.createDataFrame(x, "left long, right long") for x in (e, goals))
    for cells, group_rows in ((4_000_000, 4096), (50, 4)):
        got = cooc.observations_walked(df, pairs, k, exclude_self, cells, group_rows).collect()
        assert len(got) == len(want) and {(r.left, r.right, tuple(r.combo)): r.x for r in got} == pytest.approx(want, rel=1e-5)


def test_moments_entropy_bins(edges, targets):
    m = cooc.left_max_count(cooc.observation_moments(cooc.observations(edges, targets, 1)))
    got = rows(cooc.mean_bin(cooc.entropy(cooc.skew_kurtosis(m))), "left", "right")
    r = got[0, 7]
    assert (r.n, r.n_left, r.mean_bin) == (3, 3, 6)
    assert [round(v, 6) for v in (r.s1, r.s2, r.raw_entropy, r.entropy)] == [1.472169, 0.751914, 1.019117, -0.305518]
    assert r.skew == r.kurt == 0.0
    assert round(got[0, 4].entropy, 6) == 0.488474 and got[0, 4].mean_bin == 8


def test_skew_kurtosis_with_zero_fill(spark):
    x = [0.5, 0.25, 1.0]
    row = (0, 1, 3, 5, *(float(sum(v**p for v in x)) for p in (1, 2, 3, 4)), sum(-v * math.log(v) for v in x))
    df = spark.createDataFrame([row], "left long, right long, n long, n_left long, s1 double, s2 double, s3 double, s4 double, raw_entropy double")
    r = cooc.entropy(cooc.skew_kurtosis(df)).first()
    assert [round(v, 6) for v in (r.skew, r.kurt, r.entropy)] == [1.088512, 0.535714, 0.163532]


def test_pair_features_fill_zero(edges, targets):
    got = rows(cooc.feature_matrix(edges, targets), "left", "right")
    assert len(got) == len(TARGETS) and len(cooc.feature_columns()) == 28
    assert got[1, 8].entropy_0 == 0.0 and got[1, 8].rdeg == 0.0
    assert got[0, 7].bin_7_1 == 1.0


PATHS = {(0, 7): (3, 3.75e-7, 0.813053, 1.149830), (1, 6): (3, 3.75e-7, 0.707107, 1.0), (1, 7): (2, 2.5e-7, 0.524377, 0.741582), (2, 4): (4, 5e-7, 1.16661, 1.64983), (3, 5): (3, 3.75e-7, 0.813053, 1.14983), (3, 6): (2, 2.5e-7, 0.524377, 0.741582)}


@pytest.mark.parametrize("pushed", [False, True])
def test_path_scores(spark, edges, targets, pushed):
    pairs = targets if pushed else None
    count, kz, a, b, d = (rows(x, "left", "right") for x in (paths.path3_count(edges, pairs), paths.katz(edges, 3, 0.005, pairs), paths.l3(edges, pairs), paths.l3(edges, pairs, "published"), paths.graph_distance(edges, 3, pairs=pairs)))
    for k, (n, s, x, y) in PATHS.items():
        assert count[k].paths == n and math.isclose(kz[k].score, s, rel_tol=1e-9)
        assert math.isclose(a[k].score, x, rel_tol=1e-5) and math.isclose(b[k].score, y, rel_tol=1e-5)
        assert math.isclose(d[k].score, 1 / 3)
    assert (0, 4) not in a and (0, 4) not in d
    if not pushed:
        assert math.isclose(kz[0, 5].score, 0.005000875)


def test_metrics(spark):
    df = spark.createDataFrame(list(zip([1, 1, 0, 0, 0, 1], [0.9, 0.4, 0.4, 0.8, 0.1, 0.7], strict=True)), "label int, score double")
    r = evaluate.ranking_metrics(df).first()
    assert (round(r.auroc, 6), round(r.aupr, 6), r.n_samples) == (0.722222, 0.755556, 6)
    again = evaluate.ranking_metrics(df.selectExpr("label", "3 * score - 7 AS score")).first()
    assert again.auroc == r.auroc


def test_metrics_without_a_class(spark):
    r = evaluate.ranking_metrics(spark.createDataFrame([(0, 0.5)], "label int, score double")).first()
    assert r.auroc is None and r.aupr is None


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame([(u, 100 + (u * 7 + i * i) % 40) for u in range(30) for i in range(u % 14 + 1)], "left long, right long").distinct().cache()


def test_holdout_is_disjoint_complete_and_sized(wide):
    train, test = sampling.holdout_per_left(wide, 0.2, 3)
    assert graph.overlap_check(train, test).first()[0] == 0
    assert train.unionByName(test).exceptAll(wide).isEmpty() and train.count() + test.count() == wide.count()
    want = {1: 0, 2: 0, 3: 1, 7: 1, 8: 2, 12: 2, 13: 3}
    n = {r.node: r.degree for r in graph.node_degrees(wide, "left").collect()}
    got = {r.node: r.degree for r in graph.node_degrees(test, "left").collect()}
    assert all(got.get(u, 0) == want[d] for u, d in n.items() if d in want)


@pytest.mark.parametrize("draw", [sampling.sample_negatives_uniform, sampling.sample_negatives_by_degree])
def test_negatives(wide, draw):
    got = draw(wide, 80, 1)
    assert got.distinct().count() == 80 and got.join(wide, ["left", "right"]).isEmpty()
    with pytest.raises(ValueError):
        draw(wide, 10_000, 1)


def test_core_has_min_degree(wide):
    core = graph.k_core(wide, 4)
    assert all(r.degree >= 4 for s in ("left", "right") for r in graph.node_degrees(core, s).collect())


@pytest.mark.parametrize("method", ["random", "degree", "fire", "normal"])
def test_budget_sampling_is_induced(wide, method):
    got = sampling.sample_for_budget(wide, method, 2, threshold=60, budget=40)
    assert 0 < got.count() <= wide.count() and got.join(wide, ["left", "right"], "left_anti").isEmpty()
    if method == "fire":
        assert got.count() <= 40


def test_fires_burn_the_budget_and_spread_along_edges(spark, wide):
    # the wide graph, 60 loose edges that each burn alone, repeated edges and nulls
    loose = spark.createDataFrame([(1000 + i, 1000 + i) for i in range(60)] * 2 + [(None, 5), (7, None)], "left long, right long")
    edges = wide.select("left", "right").unionByName(loose).cache()
    pairs = {(r.left, r.right) for r in edges.collect()}
    nodes = {("left", a) for a, b in pairs if None not in (a, b)} | {("right", b) for a, b in pairs if None not in (a, b)}
    for most in (30, len(nodes) - 20, len(nodes) + 5):
        got = sampling.burn_forest(edges, most, 0.7, 3).collect()
        level = {(r.side, r.node): r.level for r in got}
        assert len(got) == len(level) == min(most, len(nodes)) and set(level) <= nodes
        for r in got:
            if r.from_side is not None:
                ends = {r.side: r.node, r.from_side: r.from_node}
                assert (ends["left"], ends["right"]) in pairs and level[r.from_side, r.from_node] == r.level - 1
        assert sorted(map(str, got)) == sorted(map(str, sampling.burn_forest(edges.repartition(3), most, 0.7, 3).collect()))
    # 60 separate fires take few turns, as many start at once
    assert max(level.values()) < 30
    assert sampling.burn_forest(edges.limit(0), 5, 0.7, 3).isEmpty()


def test_splits_and_ratios(spark, wide):
    train, test = sampling.holdout_per_left(wide, 0.2, 3)
    neg = sampling.sample_negatives_uniform(wide, 200, 1)
    parts = sampling.split_train_test_negatives(sampling.assign_splits(wide.unionByName(neg), train, test), 1, 0)
    n = {(r.part, r.label): r["count"] for r in parts.groupBy("part", "label").count().collect()}
    assert n["train", 0] == min(200, n["train", 1]) == min(200, train.count()) and n["test", 1] == test.count()
    labelled = graph.union_pairs(test, neg)
    assert sampling.sample_ratio(labelled, 2, 1).count() == test.count() + min(200, 2 * test.count())


def test_factorize_and_kfold_and_allbut(spark):
    df = spark.createDataFrame([("b", 3), ("a", 1), ("b", 2), (None, 4)], "x string, at int")
    assert {(r.x, r.x_code) for r in graph.factorize(df, "x", "at").collect()} == {("a", 0), ("b", 1), (None, -1)}
    log = spark.createDataFrame([(u, t) for t in range(20) for u in (1, 2)], "user long, t long")
    folds = sampling.kfold_blocks(log, 5, "t", "user").groupBy("fold").count().collect()
    assert sorted((r.fold, r["count"]) for r in folds) == [(i, 8) for i in range(1, 6)]
    assert sampling.allbut(log, "user", ["t", "user"], 3, 5).where("is_test").count() == 6
    assert sampling.allbut(log, "user", ["t", "user"], 3, 5, max_test=4).where("is_test").count() == 4


def test_odd_inputs(spark, wide):
    from pairloom.functions.ranking import with_position
    from pairloom.operators import embed

    e = spark.createDataFrame([(1, 2, 9, 8)] * 3 + [(1, 3, 7, 6)], "left long, right long, _low int, _part int")
    placed = with_position(e, "right", "left", "_low")
    assert set(placed.columns) == {*e.columns, "position"} and sorted(r["_low"] for r in placed.collect()) == [7, 9, 9, 9]
    splits = sampling.assign_splits(e, e.where("right = 2"), e.where("right = 3"))
    assert sorted(r.split for r in splits.collect()) == ["test_pos", "train_pos"]
    coded = graph.factorize(graph.factorize(e, "right"), "right")
    assert coded.columns.count("right_code") == 1
    scored = evaluate.attach_scores(e.selectExpr("left", "right", "1 AS label", "5.0 AS score"), e.selectExpr("left", "right", "0.5 AS score"))
    assert {r.score for r in scored.collect()} == {0.5} and evaluate.ranking_metrics(scored.limit(0)).first().n_samples == 0
    none = e.limit(0).select("left", "right")
    assert embed.train_sage(none).isEmpty() and embed.train_edge_embeddings(none).isEmpty()
    assert graph.k_core(none, 2).isEmpty() and paths.graph_distance(none, 5, pairs=none).isEmpty()


def test_katz_of_length_five(wide):
    import numpy as np

    rows_ = [(r.left, r.right) for r in wide.collect()]
    ls, rs = (sorted({r[i] for r in rows_}) for i in (0, 1))
    a = np.zeros((len(ls), len(rs)))
    for u, v in rows_:
        a[ls.index(u), rs.index(v)] = 1
    want = 0.05 * a + 0.05**3 * a @ a.T @ a + 0.05**5 * a @ a.T @ a @ a.T @ a
    got = {(r.left, r.right): r.score for r in paths.katz(wide).collect()}
    assert len(got) == (want > 0).sum() and all(math.isclose(want[ls.index(u), rs.index(v)], s, rel_tol=1e-9) for (u, v), s in got.items())
    some = wide.sample(0.2, 1)
    assert {tuple(r) for r in paths.katz(wide, pairs=some).select("left", "right").collect()} == {tuple(r) for r in some.collect()}
