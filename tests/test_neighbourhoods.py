import hashlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from pairloom.operators import cooc, lattice, neighbourhoods, paths, sampling

RNG = np.random.default_rng(11)
EDGES = sorted({(int(a), int(b)) for a, b in zip(RNG.integers(0, 25, 160), RNG.integers(0, 18, 160), strict=True)})
PAIRS = sorted({(int(a), int(b)) for a, b in zip(RNG.integers(0, 27, 120), RNG.integers(0, 20, 120), strict=True)} | set(EDGES[:20]))
ITEMS, NEAR = {}, {}
for u, v in EDGES:
    ITEMS.setdefault(u, set()).add(v)
    NEAR.setdefault(v, set()).add(u)


def observed(k, exclude_self):
    out = {}
    for u, v in PAIRS:
        for s in combinations(sorted(ITEMS.get(u, ())), k):
            who = set.intersection(*(NEAR[i] for i in s)) - ({u} if exclude_self else set())
            if c := len(who & NEAR.get(v, set())):
                out[(u, v, *s)] = c, len(who)
    return out


def walked():
    return Counter((u, v) for u, v in PAIRS for a in ITEMS.get(u, ()) for b in NEAR[a] if v in ITEMS[b])


def block():
    goals = {u: [v for w, v in PAIRS if w == u and v in NEAR] for u in ITEMS}
    own = [{"left": u, "items": list(ITEMS[u]), "goals": goals[u], "left_value": 1.0} for u in sorted(ITEMS) if goals[u]]
    lists = [{"right": v, "near": list(NEAR[v]), "right_value": 1.0} for v in NEAR]
    lists_of = pa.list_(pa.int64())
    schema = pa.schema({"left": pa.int64(), "items": lists_of, "goals": lists_of, "left_value": pa.float64(), "right": pa.int64(), "near": lists_of, "right_value": pa.float64()})
    return neighbourhoods.Block(pa.Table.from_pylist(own + lists, schema))


@pytest.mark.parametrize("cells", [1_000_000, 30, 1])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_kernels_match_brute_force(monkeypatch, cells, exclude_self):
    monkeypatch.setattr(neighbourhoods, "CELLS", cells)
    for k, kernel, names in ((1, neighbourhoods.singles, ["s"]), (2, neighbourhoods.couples, ["s1", "s2"])):
        got = {}
        for f in kernel(exclude_self)(block()):
            for *at, c, n in zip(*(f[x].tolist() for x in ("left", "right", *names, "_c", "_n")), strict=True):
                assert tuple(at) not in got
                got[tuple(at)] = c, n
        assert got == observed(k, exclude_self)
    got = Counter()
    for f in neighbourhoods.walk_sums(block()):
        got.update(dict(zip(zip(f["left"].tolist(), f["right"].tolist(), strict=True), f["value"].tolist(), strict=True)))
    assert got == walked()


@pytest.fixture
def no_walk_joins(monkeypatch):
    def refused(*_, **__):
        raise AssertionError("a join that makes a row for each walk")

    for module in (paths, cooc):
        monkeypatch.setattr(module, "dealt_join", refused)
    monkeypatch.setattr(neighbourhoods, "FILL", 60)


def test_walks_of_pairs_need_no_row_each(spark, no_walk_joins):
    e = spark.createDataFrame(EDGES + [(None, 1), (2, None)], "left long, right long")
    p = spark.createDataFrame([*PAIRS, (3, None), (None, 3)], "left long, right long")
    assert {(r.left, r.right): r.paths for r in paths.path3_count(e, p).collect()} == walked()
    weight = e.selectExpr("left", "right", "left + 0.5D * right + 1 as _w")
    want = Counter()
    for u, v in PAIRS:
        for a in ITEMS.get(u, ()):
            for b in NEAR[a]:
                if v in ITEMS[b]:
                    want[(u, v)] += b + 0.5 * a + 1
    assert {(r.left, r.right): r.value for r in paths._walks3(e, p, weight).collect()} == pytest.approx(want)
    assert paths.path3_count(e.limit(0), p).isEmpty() and paths.path3_count(e, p.limit(0)).isEmpty()


@pytest.mark.parametrize("k", [1, 2])
def test_observations_need_no_row_for_each_walk(spark, no_walk_joins, k):
    e, p = (spark.createDataFrame(x, "left long, right long") for x in (EDGES, PAIRS))
    got = {(r.left, r.right, *r.combo) for r in cooc.observations(e, p, k).collect()}
    assert got == set(observed(k, False))


@pytest.mark.parametrize("k", [1, 2])
def test_crowded_left_nodes_give_the_same_observations(spark, k):
    e, p = (spark.createDataFrame(x, "left long, right long") for x in (EDGES, PAIRS))
    few, many = (sorted((r.left, r.right, *r.combo, r.x) for r in cooc.observations(e, p, k, most=m).collect()) for m in (60, 10**6))
    assert few == many


@pytest.mark.parametrize("k", [1, 2, 3])
def test_sums_need_no_row_for_each_step(spark, monkeypatch, k):
    """A row for each two steps between left nodes is made only for crowded ones."""

    def refused(*_):
        raise AssertionError("the walks of all left nodes were joined")

    monkeypatch.setattr(lattice, "adjacency", refused)
    monkeypatch.setattr(neighbourhoods, "FILL", 60)
    e, p = (spark.createDataFrame(x, "left long, right long") for x in (EDGES, PAIRS))
    n = Counter((u, v) for u, v, *_ in observed(k, False))
    assert {(r.left, r.right): r.n for r in lattice.observation_sums(e, p, k).collect()} == n


def test_a_crowded_left_node_without_partners_keeps_its_own_subsets(spark):
    """Nobody shares an item of node 1, and it has more steps than a block takes."""
    e = spark.createDataFrame([(1, v) for v in range(6)] + [(2, 9)], "left long, right long")
    p = e.where("left = 1 and right < 3")
    few, many = (sorted(map(tuple, lattice.observation_sums(e, p, 2, most=m).collect())) for m in (4, 10**6))
    assert [r[:3] for r in few] == [(1, v, 15) for v in range(3)] and few == [pytest.approx(r) for r in many]


def distances(edges, pairs, most):
    near, back = {}, {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        back.setdefault(v, set()).add(u)
    out = {}
    for u, v in pairs:
        seen, front, d = set(), {u}, 1
        while front and d <= most:
            items = set().union(*(near.get(x, set()) for x in front)) - seen
            if v in items:
                out[(u, v)] = d
                break
            seen |= items
            front, d = set().union(*(back[x] for x in items)) if items else set(), d + 2
    return out


@pytest.mark.parametrize("ways", [(4, 32), (1,), ()])
def test_distances_of_pairs_match_a_plain_walk(spark, monkeypatch, ways):
    """A long chain, a crowd, and a part of its own; ends that nothing reaches."""
    monkeypatch.setattr(paths, "WAYS", ways)
    chain = [(100 + i, 100 + j) for i in range(8) for j in (i, i + 1)]
    edges = EDGES[:60] + [(x + 500, y + 500) for x, y in EDGES[:20]] + chain
    pairs = sorted({(u, v) for u, _ in edges[::3] for _, v in edges[::4]} | {(9999, 100), (100, 9999)})
    e, p = (spark.createDataFrame(x, "left long, right long") for x in (edges, pairs))
    for most in (5, 9):
        got = {(r.left, r.right): round(1 / r.score) for r in paths.graph_distance(e, most, exclude_existing=False, pairs=p).collect()}
        assert got == distances(edges, pairs, most)


def test_distances_walk_on_only_for_pairs_that_no_way_solves(spark, monkeypatch):
    """Of these pairs none is left for walks from both ends: ways solve some, and the others lie in different parts of the graph."""
    edges = [(u, v) for u in range(12) for v in (u, (u + 1) % 12)]
    edges += [(u + 50, v + 50) for u, v in edges]
    e = spark.createDataFrame(edges, "left long, right long")
    p = spark.createDataFrame([(u, v) for u in (0, 1, 51) for v in (0, 3, 4, 55)], "left long, right long")
    left = {}

    def seen(e_, open_, ways, real=paths._tried):
        left[ways] = {(r.left < 50) == (r.right < 50) for r in open_.collect()}
        return real(e_, open_, ways)

    monkeypatch.setattr(paths, "_tried", seen)
    got = {(r.left, r.right): round(1 / r.score) for r in paths.graph_distance(e, 5, exclude_existing=False, pairs=p).collect()}
    assert got == distances(edges, [tuple(r) for r in p.collect()], 5) and left and set().union(*left.values()) == {True}


def test_support_of_pairs_is_counted_in_blocks(spark, monkeypatch):
    """One row leaves a task for each pair of items, not one for each pair and left node; crowded items give the same."""
    e = spark.createDataFrame([*EDGES, EDGES[0], (None, 1), (2, None)], "left long, right long")
    want = Counter(s for items in ITEMS.values() for s in combinations(sorted(items), 2))
    for fill, most in ((60, 10**6), (4_000_000, 60)):
        monkeypatch.setattr(neighbourhoods, "FILL", fill)
        out = cooc.combination_support(e, 2, most)
        assert {tuple(r.combo): r.support for r in out.collect()} == want
    assert "Join" not in cooc.combination_support(e, 2)._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]


def test_uniform_non_edges_are_drawn_once_and_not_sorted(spark, monkeypatch):
    """Half as many draws as twice what is asked for, and the rows beyond it are cut off by one bound."""

    def refused(*_):
        raise AssertionError("all draws were sorted")

    monkeypatch.setattr(sampling, "lowest", refused)
    edges = [(u, (u * 3 + i) % 90) for u in range(80) for i in range(4)]
    got = {tuple(r) for r in sampling.sample_negatives_uniform(spark.createDataFrame(edges, "left long, right long"), 900, 7).collect()}
    want, i = {}, 0
    number = lambda side, i: int(hashlib.md5(f"7|{side}|{i}".encode()).hexdigest()[:13], 16)
    while len(want) < 900:
        pair = number("L", i) % 80, number("R", i) % 90
        if pair not in set(edges):
            want.setdefault(pair, i)
        i += 1
    assert got == set(want)
    assert i <= sampling._draws(900, 80 * 90, 80 * 90 - 320) < 1.5 * 900


def test_few_possible_non_edges_take_more_draws(spark):
    edges = [(u, v) for u in range(12) for v in range(12) if u != v]
    got = {tuple(r) for r in sampling.sample_negatives_uniform(spark.createDataFrame(edges, "left long, right long"), 11, 7).collect()}
    assert len(got) == 11 and all(u == v for u, v in got)
