"""The walk of the subset lattice against plain sets."""

import math
import random
from itertools import combinations

import numpy as np
import pytest

from pairloom.operators import cooc
from pairloom.operators.lattice import bitmaps, observation_sums, popcounts, shared_subsets


def plain(edges, pairs, k, exclude_self):
    near, du, dv = {}, {}, {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        du[u] = du.get(u, 0) + 1
        dv[v] = dv.get(v, 0) + 1
    out = {}
    for u, v in set(pairs):
        for s in combinations(sorted(near.get(u, ())), k):
            c_s = [w for w in near if near[w] >= set(s) and not (exclude_self and w == u)]
            c = sum(v in near[w] for w in c_s)
            if c and v in dv:
                x = float(np.float32(c / len(c_s) / math.log1p(dv[v]) * math.log1p(du[u])))
                out.setdefault((u, v), []).append(x)
    return {p: (len(x), *(sum(y**i for y in x) for i in (1, 2, 3, 4)), sum(-y * math.log(y) for y in x)) for p, x in out.items()}


def close(got, want):
    return got.keys() == want.keys() and all(np.allclose(got[p], want[p], rtol=1e-9, atol=1e-12) and got[p][0] == want[p][0] for p in want)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(8)
    edges = [(u, 100 + rng.randrange(18)) for u in range(16) for _ in range(rng.choice([2, 4, 7, 11]))]
    edges += edges[:7]  # repeated rows count in degrees
    edges += [(50, 100 + i) for i in range(18)] + [(51, 300), (51, 301), (51, 302), (51, 303)]
    pairs = [(rng.randrange(16), 100 + rng.randrange(18)) for _ in range(60)] + edges[::3] + [(50, 104), (50, 300), (51, 300), (51, 105), (999, 100), (3, 999), (51, 300)]
    return edges, pairs


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("k", [1, 2, 3])
@pytest.mark.parametrize("group", [{}, {"group_rows": 3}, {"group_sets": 2.0, "cells": 40}])
def test_sums_equal_plain_sets(spark, made, k, exclude_self, group):
    """Also with all nodes dealt over groups by first item and part, and with blocks of a few words."""
    edges, pairs = made
    schema = "left long, right long, items string, w int"
    e, p = (spark.createDataFrame([(*r, "x", 1) for r in rows], schema) for rows in (edges, pairs))
    got = {(r.left, r.right): tuple(r)[2:] for r in observation_sums(e, p, k, exclude_self, **group).collect()}
    assert close(got, plain(edges, pairs, k, exclude_self))


def test_sums_equal_those_of_the_joins(spark, made):
    e, p = (spark.createDataFrame(rows, "left long, right long") for rows in made)
    for k in (1, 2):
        want = {(r.left, r.right): tuple(r)[2:] for r in cooc.observation_moments(cooc.observations(e, p, k)).collect()}
        assert close({(r.left, r.right): tuple(r)[2:] for r in observation_sums(e, p, k).collect()}, want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "left long, right long")
    some = spark.createDataFrame([(1, 2), (None, 3), (1, None)], "left long, right long")
    assert observation_sums(none, none, 3).isEmpty() and observation_sums(some, some, 3).isEmpty()


@pytest.mark.parametrize("cells", [1, 64, 10**6])
def test_all_intersecting_subsets_are_found_once(cells):
    rng = random.Random(1)
    members = [np.array(sorted(rng.sample(range(12), rng.randrange(7)))) for _ in range(150)]
    names = np.arange(12)
    bits = bitmaps(members, names)
    found = {tuple(s): int(np.bitwise_count(i).sum()) for block in shared_subsets(bits, 3, cells) for s, i in zip(*block, strict=True)}
    want = {s: n for s in combinations(range(12), 3) if (n := sum(set(s) <= set(m.tolist()) for m in members))}
    assert found == want
    assert (popcounts(bits, bits) == [[sum(a in m and b in m for m in members) for b in names] for a in names]).all()
