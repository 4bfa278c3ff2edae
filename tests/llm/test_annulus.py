"""Centroid clustering against a plain version in whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from pairloom.llm.annulus import Annuli, cluster_report, cluster_vectors, squared

SCHEMA = "vec_id long, embedding array<double>, cluster string, id long, vec string"
DIM = 8


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA)


def brute(rows, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == DIM and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    cents = [q for _, q in sorted(kept, key=lambda r: sha(f"2:{'' if r[0] is None else r[0]}"))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda q: min((dist(q, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        to = [near(q)[1] for _, q in kept]
        for j in set(to):
            own = [q for (_, q), t in zip(kept, to, strict=True) if t == j]
            cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, *near(q)[::-1]) for i, q in kept]
    total = {j: sum(d for _, c, d in out if c == j) for j in range(len(cents))}
    return sorted(((i, c, d, total[c], sum(total.values()), sha(",".join(map(str, cents[c])))) for i, c, d in out), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(60, DIM)), rng.normal(size=(40, DIM)) * 0.1 + 2, np.zeros((3, DIM)), np.full((4, DIM), -1.5), rng.integers(-1, 2, size=(60, DIM))])
    out = [(i, v.tolist()) for i, v in enumerate(x)]
    out += [(0, out[0][1]), (1, out[1][1]), (None, [0.5] * DIM)]
    return out + [(500, None), (501, []), (502, [1.0] * (DIM - 1)), (503, [None] + [1.0] * (DIM - 1)), (504, [float("nan")] + [1.0] * (DIM - 1)), (505, [float("-inf")] + [1.0] * (DIM - 1))]


@pytest.mark.parametrize("k,rounds", [(10, 4), (40, 2), (1, 1), (500, 2)])
def test_clusters_match_plain_version(spark, rows, k, rounds):
    got = cluster_report(frame(spark, rows), k=k, rounds=rounds, dim=DIM)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, k, rounds)


def test_equally_near_centroids_and_borders_go_to_the_smaller_number():
    """Points of a small grid have many centroids at one distance, some just on the border of the annulus."""
    grid = np.array([[x, y] for x in range(-3, 4) for y in range(-3, 4)], dtype=float)
    cents = np.random.default_rng(2).permutation(grid)[:30].astype(int).tolist() + [[0, 0], [0, 0]]
    names, best = Annuli(cents).nearest(np.repeat(grid, 2, axis=0))
    for p, n, d in zip(np.repeat(grid, 2, axis=0), names, best, strict=True):
        every = [(int(((p - c) ** 2).sum()), j) for j, c in enumerate(np.array(cents))]
        assert (int(d), n) == min(every)


def test_the_annulus_leaves_centroids_out():
    rng = np.random.default_rng(3)
    cents = (rng.normal(size=(50, DIM)) * np.linspace(10, 10_000, 50)[:, None]).astype(int).tolist()
    x = np.array(cents)[rng.integers(0, 50, 200)] + rng.integers(-3, 4, size=(200, DIM))
    first, past = Annuli(cents).reaches(x.astype(float))
    assert (past - first).mean() < 25


def test_large_components_stay_exact(spark):
    big = [(i, [float(2**20 + i), 3.0 * i, *([float(i % 3)] * (DIM - 2))]) for i in range(30)]
    assert sorted((tuple(r) for r in cluster_report(frame(spark, big), k=5, rounds=2, dim=DIM).collect()), key=repr) == brute(big, 5, 2)
    a = np.array([[float(2**30 + 1), 1.0]])
    assert squared(a, np.array([[0.0, 0.0]]))[0] == (2**30 + 1) ** 2 + 1
    with pytest.raises(Exception, match="too large"):
        cluster_report(frame(spark, [(1, [1e30] * DIM)]), dim=DIM).collect()


def test_empty_and_unusable_tables(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        assert cluster_report(frame(spark, rows), dim=DIM).count() == 0
        assert cluster_vectors(frame(spark, rows), dim=DIM)[1] == []
