import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import spann
from pairloom.llm.covertree import Forest, Tree, build_levels, dual_traversal, near_vectors
from pairloom.llm.spann import nearest
from pairloom.llm.vectors import units

ODD = [(9001, None), (9002, [0.0] * 8), (9003, [float("nan")] + [1.0] * 7), (9004, [None] + [1.0] * 7), (9005, []), (9006, [float("inf")] * 8)]


def frame(spark, ids, x, odd=True):
    rows = [(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)] + (ODD if odd else [])
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.fixture(scope="module")
def crowd():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 8))
    near = base[0] + 0.02 * rng.normal(size=(150, 8))
    chain = base[1] + 0.25 * rng.normal(size=(60, 8))
    x = np.vstack([base, near, chain, base[:10], 3 * base[10:15]])
    return np.arange(len(x)), x


def brute(ids, x, t):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    on = u @ u.T >= t
    comp = ids.copy()
    while True:
        new = np.array([comp[row].min() for row in on])
        if (new == comp).all():
            return on.sum(1) - 1, comp
        comp = new


@pytest.mark.parametrize("chunk", [4096, 40])
def test_near_vectors_match_brute_force(spark, crowd, chunk):
    ids, x = crowd
    links, comp = brute(ids, x, 0.95)
    got = {r.vec_id: r for r in near_vectors(frame(spark, ids, x), 0.95, chunk).collect()}
    assert [got[i].n_links for i in ids] == links.tolist()
    assert [got[i].component_id for i in ids] == comp.tolist()
    assert all(got[i].kept == (c == i) for i, c in zip(ids, comp, strict=True))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i, _ in ODD)


@pytest.mark.parametrize("dim", [4, 16])
@pytest.mark.parametrize("t", [0.95, 0.8])
def test_traversal_of_two_trees_matches_brute_force(dim, t):
    """Trees of different heights, one without some of its centres, rows of different weights."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(150, dim))
    near = base[:1] + 0.1 * rng.normal(size=(150, dim))
    x, y = np.vstack([base, near]), np.vstack([near[:80] + 0.01 * rng.normal(size=(80, dim)), base[:5] * 2])
    paths = [np.stack(build_levels(units(z), np.sqrt(2 - 2 * t)), axis=1) for z in (x, y)]
    high = max(p.shape[1] for p in paths)
    paths = [np.concatenate([p] + [p[:, -1:]] * (high - p.shape[1]), axis=1) for p in paths]
    here = rng.random(len(x)) < 0.7
    x, paths[0] = x[here], paths[0][here]
    a, b = Tree(units(x), np.ones(len(x)), paths[0]), Tree(units(y), np.arange(len(y)) % 3 + 1.0, paths[1])
    on = a.x @ b.x.T >= t
    forest = Forest(len(x) + len(y))
    got_a, got_b = dual_traversal(a, b, x, y, t, False, forest)
    assert (got_a == on @ b.weight).all() and (got_b == on.sum(axis=0)).all()
    assert all(forest.find(int(i)) == forest.find(int(j) + len(x)) for i, j in zip(*np.nonzero(on), strict=True))
    assert (dual_traversal(a, a, x, x, t, True, Forest(len(x)))[0] == (a.x @ a.x.T >= t).sum(axis=1)).all()


def test_repeated_rows_and_empty_table(spark):
    same = spark.createDataFrame([(1, [1.0, 0.0])] * 3 + [(2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links) for r in near_vectors(same).collect()) == [(1, 2)] * 3 + [(2, 0)]
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert near_vectors(none).isEmpty() and nearest(none, none).isEmpty()


def test_search_recall_ties_and_scores(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(3000, 8)), np.ones((30, 8)) * 2])
    ids = np.arange(len(x))
    df = frame(spark, ids, x)
    rows = nearest(df, df.where("vec_id % 20 = 0"), 20).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((ids, -s))[:20]
        mine = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in mine)
        hits += len({r.vec_id for r in mine} & set(want.tolist()))
        total += 20
    assert hits / total >= 0.9
    copies = sorted(got[3000], key=lambda r: r.rank)
    assert [r.vec_id for r in copies] == list(range(3001, 3021))


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id = 0"), 20).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(i, i) for i in range(1, 5)]


def test_repeated_rows_take_no_places(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 8))
    df = frame(spark, range(60), x)
    many = df.crossJoin(spark.range(25)).select("vec_id", "embedding")
    got = {(r.query_id, r.rank, r.vec_id) for r in nearest(many, df.where("vec_id < 5"), 20, max_lists=1).collect()}
    for q in range(5):
        s = x @ x[q]
        s[q] = -np.inf
        assert [v for _, _, v in sorted(g for g in got if g[0] == q)] == np.lexsort((np.arange(60), -s))[:20].tolist()


def test_an_id_of_several_vectors_counts_by_its_best(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [10.0 + j, 0.0]) for j in range(30)] + [(i, [float(i) / 10, 1.0]) for i in range(2, 25)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id, r.score) for r in nearest(df, df.where("vec_id = 0"), 20, max_lists=1).collect())
    assert [v for _, v, _ in got] == [1, *range(24, 5, -1)] and got[0][2] == 39.0


@pytest.mark.parametrize("queries", [20_000, 7])
def test_recall_on_the_given_vectors(spark, monkeypatch, queries):
    monkeypatch.setattr(spann, "TASK_QUERIES", queries)
    monkeypatch.setattr(spann, "TASK_ROWS", 30_000 if queries > 7 else 60)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pd_ = df.toPandas()
    x, ids = np.stack(pd_.embedding).astype(float), pd_.vec_id.to_numpy()
    got = {}
    for r in nearest(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(got[ids[i]] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
        total += 20
    assert hits / total >= 0.9


def test_fitting_many_lists_holds_few_distances(monkeypatch):
    """All distances of 4,000 vectors to 1,000 centroids take 32 MB, and as much again for each step of their sum."""
    monkeypatch.setattr(spann, "CELLS", 1 << 16, raising=False)
    x = np.random.default_rng(3).normal(size=(4000, 8))
    tracemalloc.start()
    index = spann.Centroids(spann.balanced_centroids(x, 1000, rounds=2))
    index.calibrate(x, x[:64], np.arange(64), 10, 0.9, 4, 0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6


@pytest.mark.parametrize("most", [5, 40, 500])
def test_sample_is_that_of_the_lowest_hashes(spark, most):
    rows = spark.range(300).selectExpr("id as vec_id", "array(cast(id as double), 1.0D) as vec").repartition(7)
    want = rows.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(most).select("vec").collect()
    assert spann._sampled(rows, 300, most).collect() == want
