"""Co-occurrence features of pairs in the space of conditions.

For a left node u and a k-subset S of its neighbours, C(S) is the set of left
nodes adjacent to all of S (u is one of them).  For a target pair (u, v) the
observation of S is

    x = c / |C(S)| / ln(1 + d_v) * ln(1 + d_u),   c = #{w in C(S): v in N(w)},

kept if above 1e-8, as a float.  Degrees count rows, neighbours are distinct.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.skew import MOST, dealt_join
from pairloom.functions.storage import free, stored
from pairloom.operators.graph import KEYS, adjacency, node_degrees
from pairloom.operators.lattice import LEAST, bitmaps, observation_sums, popcounts
from pairloom.operators.neighbourhoods import by_blocks, couples, shared_items, singles

#: The lower edges of the mean bins.
MEAN_EDGES = (0.01, 0.05, 0.10, 0.20, 0.30, 0.40, 0.55, 0.70, 0.85)
BINS = 10


def cooccurrence(edges: DataFrame, hub_degree: int = 2048, block: int = 2048, hubs: int = 4096) -> DataFrame:
    """(s, v, co): how many left nodes are adjacent to both, s = v included.

    Only s <= v is counted, then mirrored.  Left nodes of up to ``hub_degree`` rows are joined with themselves.  Of the
    others, whose degree squared would be rows, a task takes the bitmaps of two blocks of about ``block`` items over at most about ``hubs``
    nodes and sends a row for each pair of items that meet, not one for each node as well.  Rules: null ends meet nothing, repeated
    edges count once.
    """
    e = edges.select(*KEYS).distinct()
    large = stored(node_degrees(edges, "left").where(F.col("degree") > hub_degree).select(F.col("node").alias("left")))
    n = large.count()
    if not n:
        free(large)
        half = _half(e)
    else:
        parts = _half(e.join(large, "left", "left_anti")).unionByName(_block_counts(e.where("right IS NOT NULL").join(large, "left", "left_semi"), block, -(-n // hubs)))
        half = parts.groupBy("s", "v").agg(F.sum("co").alias("co"))
    return half.unionByName(half.where("s < v").select(F.col("v").alias("s"), F.col("s").alias("v"), "co"))


def _half(e: DataFrame) -> DataFrame:
    """(s, v, co) with s <= v by the self-join."""
    return e.select("left", F.col("right").alias("s")).join(e.select("left", F.col("right").alias("v")), "left").where("s <= v").groupBy("s", "v").agg(F.count(F.lit(1)).alias("co"))


def _block_counts(e: DataFrame, block: int, chunks: int) -> DataFrame:
    """(s, v, co) with s <= v, a row a chunk of left nodes, from bitmaps of item blocks.

    Blocks go by hash, so pairs of blocks are not ordered as their items are: a pair is counted in the one cell of its two blocks.
    """
    blocks = max(1, -(-e.select("right").distinct().count() // block))
    placed = e.select(*KEYS, F.pmod(F.xxhash64("left"), F.lit(chunks)).alias("chunk"), F.pmod(F.xxhash64("right"), F.lit(blocks)).alias("own"))
    # the cells (i, j), i <= j, of which ``own`` is one
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames))
        i, j = int(f.i.iloc[0]), int(f.j.iloc[0])
        nodes = f.left.unique()
        at = pd.Series(np.arange(len(nodes)), index=nodes)
        sides = []
        for part in (i, j):
            own = f[f.own == part].sort_values("left")
            names = np.unique(own.right.to_numpy(dtype=np.int64))
            members = [np.zeros(0, dtype=np.int64)] * len(nodes)
            for node, g in own.groupby("left").right:
                members[at[node]] = g.to_numpy(dtype=np.int64)
            sides.append((names, bitmaps(members, names)))
        (a, x), (b, y) = sides
        for lo in range(0, len(a), 256):
            co = popcounts(x[lo : lo + 256], y)
            p, q = np.nonzero(co)
            s, v, c = a[lo + p], b[q], co[p, q]
            if i == j:
                once = s <= v
                s, v, c = s[once], v[once], c[once]
            yield pd.DataFrame({"s": np.minimum(s, v), "v": np.maximum(s, v), "co": c.astype(np.int64)})

    tasks = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(tasks, "chunk", "i", "j").groupBy("chunk", "i", "j").applyInPandas(count, "s long, v long, co long")


def conditional_probability(edges: DataFrame) -> DataFrame:
    """(s, v, p): P(v given s) = co(s, v) / |L(s)|."""
    size = node_degrees(edges.select(*KEYS).distinct(), "right").toDF("s", "n")
    return cooccurrence(edges).join(size, "s").select("s", "v", (F.col("co") / F.col("n")).alias("p"))


def combination_support(edges: DataFrame, k: int, most: int = MOST) -> DataFrame:
    """(combo, support): how many left nodes are adjacent to all of each k-set that some left node has.

    Pairs are counted in blocks of their smaller items; those of items of more than ``most`` steps, as all from k = 3 on, by joins.
    """
    e = edges.select(*KEYS).distinct()
    if k == 2:
        e = stored(e.where("left is not null and right is not null"))
        swapped = e.toDF("right", "left")
        out, crowded = by_blocks(swapped, None, shared_items, "s1 long, s2 long, support long", most=most)
        if crowded is not None:
            first = e.join(crowded.toDF("right"), "right", "left_semi").select("left", F.col("right").alias("s1"))
            rest = first.join(e.toDF("left", "s2"), "left").where("s1 < s2").groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("support"))
            out = out.unionByName(rest)
        return out.select(F.array("s1", "s2").alias("combo"), "support")
    if k == 1:
        return e.groupBy(F.array("right").alias("combo")).agg(F.count(F.lit(1)).alias("support"))
    grown = e.select("left", F.array("right").alias("combo"))
    for _ in range(k - 1):
        grown = grown.join(e, "left").where(F.col("right") > F.element_at("combo", -1)).select("left", F.concat("combo", F.array("right")).alias("combo"))
    return grown.groupBy("combo").agg(F.count(F.lit(1)).alias("support"))


def _degrees(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return node_degrees(edges, "left").toDF("left", "_du"), node_degrees(edges, "right").toDF("right", "_dv")


def _value(c: str, support: str) -> Column:
    return (F.col(c) / F.col(support) / F.log1p(F.col("_dv").cast("double")) * F.log1p(F.col("_du").cast("double"))).cast("float")


def _valued(counted: DataFrame, edges: DataFrame) -> DataFrame:
    """(left, right, combo, x) from (left, right, combo, _c, _n)."""
    du, dv = _degrees(edges)
    out = counted.join(du, "left").join(dv, "right").withColumn("x", _value("_c", "_n"))
    return out.where(F.col("x") > LEAST).select("left", "right", "combo", "x")


def observations(edges: DataFrame, pairs: DataFrame, k: int = 1, exclude_self: bool = False, most: int = MOST) -> DataFrame:
    """(left, right, combo, x) for the distinct target ``pairs``.

    k = 1 and 2 are counted in blocks of left nodes, those of more than ``most`` steps by joins; from 3 on, and for k = 2 on pairs that
    are edges (of which each has all its subsets), ``observations_walked`` does the same by a vectorised walk.
    ``exclude_self`` leaves u out of C(S).
    """
    if k >= 3:
        return observations_walked(edges, pairs, k, exclude_self)
    e, wanted = edges.select(*KEYS).distinct(), pairs.select(*KEYS).distinct()
    value = lambda side: node_degrees(edges, side).toDF(side, "value")
    names, kernel, joined = (["s"], singles, _k1) if k == 1 else (["s1", "s2"], couples, _k2)
    schema = ", ".join(f"{c} long" for c in (*KEYS, *names, "_c", "_n", "_du", "_dv"))
    counted, crowded = by_blocks(e, wanted, kernel(exclude_self), schema, left_value=value("left"), right_value=value("right"), most=most)
    out = counted.withColumn("combo", F.array(*names)).withColumn("x", _value("_c", "_n")).where(F.col("x") > LEAST).select(*KEYS, "combo", "x")
    return out if crowded is None else out.unionByName(joined(edges, e, wanted.join(crowded, "left", "left_semi"), exclude_self))


def _k1(edges: DataFrame, e: DataFrame, wanted: DataFrame, exclude_self: bool) -> DataFrame:
    steps = dealt_join(wanted, e.toDF("left", "s"), "left").select("left", "right", "s")
    # the co-occurrences that some pair needs, counted from the pairs' side of the edges only
    needed = steps.select("s", F.col("right").alias("v")).distinct()
    co = dealt_join(needed, e.toDF("w", "s"), "s").join(e.toDF("w", "v"), ["w", "v"]).groupBy("s", "v").agg(F.count(F.lit(1)).alias("_c"))
    support = node_degrees(e, "right").toDF("s", "_n")
    found = steps.join(co.withColumnRenamed("v", "right"), ["s", "right"]).join(support, "s")
    if exclude_self:
        own = e.withColumn("_own", F.lit(1))
        found = found.join(own, KEYS, "left").withColumns({"_c": F.col("_c") - F.coalesce("_own", F.lit(0)), "_n": F.col("_n") - 1}).where("_c > 0")
    return _valued(found.select("left", "right", F.array("s").alias("combo"), "_c", "_n"), edges)


def _k2(edges: DataFrame, e: DataFrame, wanted: DataFrame, exclude_self: bool) -> DataFrame:
    near = adjacency(e, "left").toDF("w", "w_near")
    triples = dealt_join(wanted, e.toDF("w", "right"), "right").select("left", "right", "w")
    if exclude_self:
        triples = triples.where("w <> left")
    both = triples.join(near, "w").join(near.toDF("left", "u_near"), "left").select("left", "right", F.array_intersect("u_near", "w_near").alias("common")).where(F.size("common") >= 2)
    first = both.select("left", "right", F.array_sort("common").alias("common")).select("left", "right", "common", F.posexplode("common").alias("i", "s1"))
    two = first.select("left", "right", "s1", F.explode(F.slice("common", F.col("i") + 2, F.size("common"))).alias("s2"))
    counted = two.groupBy("left", "right", "s1", "s2").agg(F.count(F.lit(1)).alias("_c"))
    needed = counted.select("s1", "s2").distinct()
    support = needed.join(e.toDF("x", "s1"), "s1").join(e.toDF("x", "s2"), ["x", "s2"]).groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("_n"))
    found = counted.join(support, ["s1", "s2"])
    if exclude_self:
        found = found.withColumn("_n", F.col("_n") - 1)
    return _valued(found.select("left", "right", F.array("s1", "s2").alias("combo"), "_c", "_n"), edges)


def observations_walked(edges: DataFrame, pairs: DataFrame, k: int, exclude_self: bool = False, cells: int = 4_000_000, group_rows: int = 4096) -> DataFrame:
    """As ``observations`` for any k, by the first items of the subsets.

    Each target node u meets the neighbours of its neighbours once (one row a node w that shares an item with u).  A
    group holds, for u and one of its items s, the nodes w that have s as well: bits of the later items they share, and of u's targets.
    The subsets that begin with s are enumerated there, as many at a time as fit ``cells`` bits.  Where more than
    ``group_rows`` nodes have s, they are dealt over several groups, and these groups' counts are added up.
    """
    e, wanted = edges.select(*KEYS).distinct(), pairs.select(*KEYS).distinct()
    targets = wanted.groupBy("left").agg(F.array_sort(F.collect_list("right")).alias("targets"))
    near = adjacency(e, "left").toDF("w", "w_near")
    steps = wanted.select("left").distinct().join(e, "left").join(e.toDF("w", "right"), "right")
    steps = steps.where("w <> left") if exclude_self else steps
    shared = steps.groupBy("left", "w").agg(F.array_sort(F.collect_list("right")).alias("common")).where(F.size("common") >= k)
    met = shared.join(near, "w").join(targets, "left").select("left", "w", "common", F.array_intersect("targets", "w_near").alias("hits"))
    begun = met.select("left", "w", "common", "hits", F.posexplode("common").alias("i", "first")).where(F.size("common") - F.col("i") >= k)
    rows = stored(begun.select("left", "first", "w", F.slice("common", F.col("i") + 2, F.size("common")).alias("rest"), "hits"))
    sizes = rows.groupBy("left", "first").agg(F.count(F.lit(1)).alias("nodes"))
    crowded = stored(sizes.where(F.col("nodes") > group_rows))

    def walk(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames))
        items = sorted({int(i) for rest in f.rest for i in rest})
        goals = sorted({int(v) for h in f.hits for v in h})
        at, to = {s: i for i, s in enumerate(items)}, {v: i for i, v in enumerate(goals)}
        has, hit = np.zeros((len(f), len(items)), bool), np.zeros((len(f), len(goals)))
        for r, (rest, h) in enumerate(zip(f.rest, f.hits, strict=True)):
            has[r, [at[int(i)] for i in rest]] = True
            hit[r, [to[int(v)] for v in h]] = 1
        subsets = combinations(range(len(items)), k - 1)
        while held := list(islice(subsets, max(1, cells // (len(f) * k)))):
            yield _counted(int(key[0]), int(key[1]), np.array(held, dtype=np.int64).reshape(len(held), k - 1), has, hit, np.array(items, dtype=np.int64), np.array(goals, dtype=np.int64), len(key) == 3)

    schema = "left long, right long, combo array<long>, _c long, _n long"
    # few bytes make much work here: a given number of partitions is not coalesced
    tasks = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.join(crowded, ["left", "first"], "left_anti").repartition(tasks, "left", "first").groupBy("left", "first").applyInPandas(walk, schema)
    if not crowded.isEmpty():
        part = F.pmod(F.xxhash64("w"), F.ceil(F.col("nodes") / group_rows)).alias("part")
        parts = stored(rows.join(crowded, ["left", "first"]).select("left", "first", "w", "rest", "hits", part).repartition(tasks, "left", "first", "part").groupBy("left", "first", "part").applyInPandas(walk, schema))
        support = parts.where("right IS NULL").groupBy("left", "combo").agg(F.sum("_n").alias("_n"))
        hits = parts.where("right IS NOT NULL").groupBy("left", "right", "combo").agg(F.sum("_c").alias("_c"))
        counted = counted.unionByName(hits.join(support, ["left", "combo"]).select("left", "right", "combo", "_c", "_n"))
    return _valued(counted, edges)


def _counted(u: int, first: int, subsets: np.ndarray, has: np.ndarray, hit: np.ndarray, items: np.ndarray, goals: np.ndarray, part: bool) -> pd.DataFrame:
    """Counts of the subsets that are ``first`` and some of ``items``; of a part of the nodes also how many there have each, with no right node."""
    inside = has[:, subsets].all(axis=2)
    n = inside.sum(axis=0)
    count = inside.T.astype(float) @ hit
    i, j = np.nonzero(count)
    names = np.concatenate([np.full((len(subsets), 1), first), items[subsets]], axis=1)
    out = pd.DataFrame({"left": u, "right": pd.array(goals[j], dtype="Int64"), "combo": pd.Series(list(names[i]), dtype=object), "_c": count[i, j].astype(np.int64), "_n": n[i]})
    if not part:
        return out
    some = np.flatnonzero(n)
    return pd.concat([out, pd.DataFrame({"left": u, "right": pd.array([None] * len(some), dtype="Int64"), "combo": pd.Series(list(names[some]), dtype=object), "_c": 0, "_n": n[some]})])


def observation_moments(obs: DataFrame) -> DataFrame:
    """(left, right, n, s1..s4, raw_entropy): sums of powers of x, and of -x ln x."""
    x = F.col("x").cast("double")
    return obs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"), F.sum(x * x * x).alias("s3"), F.sum(x * x * x * x).alias("s4"), F.sum(-x * F.log(x)).alias("raw_entropy"))


def left_max_count(moments: DataFrame) -> DataFrame:
    """``moments`` with ``n_left``: the largest n among the targets of the left node."""
    return moments.withColumn("n_left", F.max("n").over(W.partitionBy("left")))


def skew_kurtosis(moments: DataFrame) -> DataFrame:
    """With ``skew`` and ``kurt`` of n_left values, combinations not observed counting as zeros; 0 below four values or without variance."""
    n = F.col("n_left").cast("double")
    m = F.col("s1") / n
    var = F.col("s2") / n - m * m
    m3 = F.col("s3") / n - 3 * m * F.col("s2") / n + 2 * m * m * m
    m4 = F.col("s4") / n - 4 * m * F.col("s3") / n + 6 * m * m * F.col("s2") / n - 3 * m * m * m * m
    enough = (n >= 4) & (var > 1e-12)
    skew = F.sqrt(n * (n - 1)) / (n - 2) * m3 / (var * F.sqrt(var))
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (var * var) - 3) + 6)
    return moments.withColumns({"skew": F.when(enough, skew).otherwise(0.0), "kurt": F.when(enough, kurt).otherwise(0.0)})


def entropy(moments: DataFrame, shannon: bool = False, name: str = "entropy") -> DataFrame:
    """With ``entropy``: ln(s1) - raw / s1 by default, which is not Shannon's and may be negative; ``shannon`` adds instead. 10 without observations."""
    ratio = F.col("raw_entropy") / F.col("s1")
    value = F.log("s1") + ratio if shannon else F.log("s1") - ratio
    return moments.withColumn(name, F.when(F.col("s1") > 1e-12, value).otherwise(10.0))


def mean_bin(moments: DataFrame) -> DataFrame:
    """With ``mean_bin``: the number of edges that the float mean of x reaches."""
    mean = (F.col("s1") / F.col("n")).cast("float")
    return moments.withColumn("mean_bin", sum(((mean >= F.lit(t).cast("float")).cast("int") for t in MEAN_EDGES), F.lit(0)))


def mean_bin_onehot(moments: DataFrame) -> DataFrame:
    """With ``bin_0`` .. ``bin_9``: 1/n in the bin of the mean, 0 elsewhere."""
    return mean_bin(moments).withColumns({f"bin_{i}": F.when(F.col("mean_bin") == i, 1.0 / F.col("n")).otherwise(0.0).cast("float") for i in range(BINS)}).drop("mean_bin")


def observation_histogram(obs: DataFrame, normalized: bool = False) -> DataFrame:
    """(left, right, hist_0 .. hist_9): counts of x in ten equal bins of 0..1, the outer ones open; or their shares."""
    at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.col("x") * F.lit(10).cast("float")).cast("int")))
    one = F.lit(1)
    counts = obs.withColumn("_b", at).groupBy(*KEYS).agg(F.count(one).alias("_n"), *(F.count(F.when(F.col("_b") == i, one)).alias(f"hist_{i}") for i in range(BINS)))
    if normalized:
        counts = counts.withColumns({f"hist_{i}": F.col(f"hist_{i}") / F.col("_n") for i in range(BINS)})
    return counts.drop("_n")


def _block(edges: DataFrame, pairs: DataFrame, k: int, i: int) -> DataFrame:
    full = mean_bin_onehot(entropy(skew_kurtosis(left_max_count(observation_sums(edges, pairs, k)))))
    return full.select(*KEYS, *(F.col(f"bin_{b}").alias(f"bin_{b}_{i}") for b in range(BINS)), *(F.col(c).cast("float").alias(f"{c}_{i}") for c in ("kurt", "skew", "entropy")))


def pair_features(edges: DataFrame, pairs: DataFrame, ks: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Distinct targets with bins, kurt, skew and entropy of every k, suffixed _0, _1, ...; 0 where nothing was observed."""
    out = pairs.select(*KEYS).distinct()
    for i, k in enumerate(ks):
        out = out.join(_block(edges, pairs, k, i), KEYS, "left")
    return out.na.fill(0.0)


def log_degrees(edges: DataFrame, pairs: DataFrame, clip: bool = False) -> DataFrame:
    """``pairs`` with ``ldeg`` and ``rdeg``, ln(1 + degree); 0 for a node without edges.

    With ``clip`` an id above the largest of its side counts as that one.
    """
    out = pairs
    for side, name in (("left", "ldeg"), ("right", "rdeg")):
        degree = node_degrees(edges, side).toDF("_node", "_degree")
        key = F.col(side)
        if clip:
            out = out.crossJoin(F.broadcast(edges.agg(F.max(side).alias("_top"))))
            key = F.least(key, F.col("_top"))
        out = out.join(degree, key == F.col("_node"), "left").withColumn(name, F.log1p(F.coalesce("_degree", F.lit(0)).cast("double")).cast("float")).drop("_node", "_degree", "_top")
    return out


def feature_columns() -> list[str]:
    """The 28 columns in order."""
    return [c for i in (0, 1) for c in (*(f"bin_{b}_{i}" for b in range(BINS)), f"kurt_{i}", f"skew_{i}", f"entropy_{i}")] + ["ldeg", "rdeg"]


def feature_subsets() -> dict[str, list[str]]:
    """The six named subsets of the columns."""
    cols, degree = feature_columns(), ["ldeg", "rdeg"]
    return {"Only_Degree": degree, "Hist_SN1_Degree": cols[:10] + degree, "Hist_SN2_Degree": cols[13:23] + degree, "KSE_SN1_Degree": cols[10:13] + degree, "KSE_SN2_Degree": cols[23:26] + degree, "Full": cols}


def feature_matrix(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left, right) and the 28 feature columns."""
    return log_degrees(edges, pair_features(edges, pairs)).select(*KEYS, *feature_columns())
