"""Registered queries on a small orders and lineitem pair whose lines are mostly of low quantity."""

import pytest

from pairloom import registry


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    orders = [(o, o % 24) for o in range(48)]
    lines = [(o, (o * 7 + i * 3 + o // 24 * 11) % 30, float(1 + (o + i) % 50)) for o in range(48) for i in range(4)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{out}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{out}/lineitem.parquet")
    return out


def graph(spark, sf):
    return {(r.left, r.right) for r in registry.edges_of(spark, sf).collect()}


def test_core_keeps_lines_of_any_quantity(spark, sf):
    want = graph(spark, sf)
    while True:
        kept = {(u, v) for u, v in want if sum(a == u for a, _ in want) >= 4 and sum(b == v for _, b in want) >= 4}
        if kept == want:
            break
        want = kept
    assert want and {tuple(r) for r in registry.QUERIES["k_core_4_whole"](spark, sf).collect()} == want


def test_distances_equal_a_plain_walk(spark, sf):
    train, _, pairs = registry.pairs_of(spark, sf)
    e = {tuple(r) for r in train.collect()}
    want = {}
    for u, v in {tuple(r) for r in pairs.collect()} - e:
        reach = {b for a, b in e if a == u}
        for d in (3, 5):
            lefts = {a for a, b in e if b in reach}
            reach = {b for a, b in e if a in lefts}
            if v in reach:
                want[u, v] = round(1 / d, 6)
                break
    got = {(r.left, r.right): r.score for r in registry.QUERIES["graph_distance_5_whole"](spark, sf).collect()}
    assert got == want and want


def test_counts_cover_every_edge(spark, sf):
    n = len(graph(spark, sf))
    got = registry.QUERIES["model_split_counts_whole"](spark, sf).where("label = 1").groupBy().sum("n").first()[0]
    assert got == n


def test_triples_are_observed_on_every_edge(spark, sf):
    e = graph(spark, sf)
    degree = {u: sum(a == u for a, _ in e) for u, _ in e}
    got = {(r.left, r.right) for r in registry.QUERIES["cond_observations_k3_whole"](spark, sf).collect()}
    assert got == {(u, v) for u, v in e if degree[u] >= 3}


def test_report_makes_the_ratios_or_says_so(spark, sf):
    e = graph(spark, sf)
    test = registry.split_of(spark, sf)[1].count()
    none = 24 * 30 - len(e)
    got = {r.ratio: r for r in registry.QUERIES["evaluation_report_whole"](spark, sf).collect()}
    assert {k: r.n_samples for k, r in got.items()} == {k: test + min(k * test, none) for k in (1, 10, 100)}
    assert got[10].reached == 10.0 and got[100].reached == round(none / test, 4) < 100


def test_degree_draws_fill_up_to_all_non_edges(spark, sf):
    edges = registry.edges_of(spark, sf)
    e = graph(spark, sf)
    for n in (300, 528, 9000):
        got = [tuple(r) for r in registry.sampling.sample_negatives_up_to(edges, n, 1, by_degree=True).collect()]
        assert len(got) == len(set(got)) == min(n, 528) and not set(got) & e
