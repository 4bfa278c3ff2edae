"""Hot keys: the same rows as the plain ways, dealt over many cells."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.functions import skew
from pairloom.operators import cooc, paths, sampling


def tuples(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def star(spark):
    """Left node 0 has every right node, right node 1000 has every left node; the rest is thin."""
    rng = random.Random(3)
    e = {(0, 1000 + v) for v in range(300)} | {(u, 1000) for u in range(300)} | {(rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(300)}
    return spark.createDataFrame(sorted(e), "left long, right long").repartition(4).cache()


def test_dealt_join_equals_join_and_bounds_cells(spark, monkeypatch):
    rng = random.Random(5)
    a = spark.createDataFrame([(1 if i % 3 else rng.randrange(30), i) for i in range(600)] + [(None, 1), (2, 5), (2, 5)], "k long, x long")
    b = spark.createDataFrame([(1 if i % 4 else rng.randrange(30), -i) for i in range(200)] + [(None, 2), (2, 7)], "k long, y long")
    want = tuples(a.join(b, "k"))
    assert tuples(skew.dealt_join(a, b, "k", most=50)) == want == tuples(skew.dealt_join(a, b, "k"))
    hot = spark.createDataFrame([(1, 9, 3)], "k long, _pa int, _pb int")
    rows, columns = skew.dealt(a, b, hot, "k")
    for side, n in ((rows, 450), (columns, 170)):
        cells = [r["count"] for r in side.groupBy("_i", "_j").count().collect()]
        assert len(cells) == 27 and max(cells) <= 2 * n / (9 if side is rows else 3) + 20
    monkeypatch.setattr(skew, "HOT_KEYS", 2)  # only the two hottest keys are dealt, all others joined as usual
    assert tuples(skew.dealt_join(a, b, "k", most=3)) == want


def test_dealt_join_of_empty_sides(spark):
    a, b = spark.createDataFrame([], "k long, x long"), spark.createDataFrame([(1, 2)] * 9, "k long, y long")
    assert skew.dealt_join(a, b, "k", most=3).isEmpty() and skew.dealt_join(b, a, "k", most=3).isEmpty()


def test_rank_of_hot_keys_equals_window(spark):
    rng = random.Random(7)
    rows = [(None if i % 9 == 0 else 0 if i % 3 else rng.randrange(20), rng.randrange(50), i, "x") for i in range(900)]
    df = spark.createDataFrame(rows, "k long, v long, id long, _part string").repartition(5)
    want = tuples(skew.with_rank(df, "k", "v", "id", rank="r", size="n"))
    got = skew.with_rank(df, "k", F.col("v"), "id", rank="r", size="n", most=40)
    assert got.columns == ["k", "v", "id", "_part", "r", "n"] and tuples(got) == want and len(want) == 900
    plain = {}
    for k, v, i, _ in rows:
        plain.setdefault(k, []).append((v, i))
    assert all(sorted(plain[k])[r - 1] == (v, i) and n == len(plain[k]) for k, v, i, _, r, n in want)
    assert skew.with_rank(df.limit(0), "k", "v", rank="r", most=1).isEmpty()


def test_holdout_and_allbut_of_a_hub(star):
    for few, many in zip(sampling.holdout_per_left(star, 0.2, 3, most=20), sampling.holdout_per_left(star, 0.2, 3), strict=True):
        assert tuples(few) == tuples(many)
    a, b = (sampling.allbut(star, "left", ["right"], 3, 40, 25, most=m).select("left", "right", "is_test") for m in (20, 10**6))
    assert tuples(a) == tuples(b) and a.where("is_test").count() == 25


@pytest.mark.parametrize("pushed", [False, True])
def test_walks_over_hubs(star, pushed):
    e = star.distinct()
    pairs = star.where("left < 40 or right = 1000").select("left", (F.col("right") + 1).alias("right")).distinct() if pushed else None
    assert tuples(paths._walks3(e, pairs, most=20)) == tuples(paths._walks3(e, pairs))


def test_cooccurrence_of_hubs_by_blocks(spark, star):
    of = {}
    for r in star.collect():
        of.setdefault(r.left, set()).add(r.right)
    want = Counter((s, v) for items in of.values() for s in items for v in items)
    odd = star.unionByName(star.limit(5)).unionByName(spark.createDataFrame([(0, None), (None, 1000), (None, 1001), (None, None)], star.schema))
    for settings in ({}, {"hub_degree": 0, "block": 40, "hubs": 30}, {"hub_degree": 4, "block": 1000}, {"hub_degree": 100, "block": 7}):
        got = cooc.cooccurrence(odd, **settings).collect()
        assert len(got) == len(want) and {(r.s, r.v): r.co for r in got} == want
    assert cooc.cooccurrence(star.limit(0)).isEmpty()
