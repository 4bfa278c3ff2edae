"""Sums over the observations of all k-subsets of neighbours, by a walk of the subset lattice on bitmaps.

For a left node u only subsets that another left node shares need a walk; all others are known by their number, as u
alone is adjacent to them.  The nodes that share k items with u or more are found within a block of left nodes (``neighbourhoods``).  Every item of u has a bitmap of
these nodes that have it, 64 to a word; subsets grow item by item, depth first, each from its prefix's intersection,
and a branch ends where the intersection is empty.  A popcount with the bitmap of the nodes that have a target v counts c for all
targets at once, and the sums of powers are taken where the subsets are found: a row for each pair leaves the task.

Left nodes with very many partners or shared subsets are dealt over several groups by first item and node; these send the counts of
their subsets, which are added up and then summed as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.skew import MOST
from pairloom.functions.storage import stored
from pairloom.operators.graph import KEYS, adjacency, node_degrees
from pairloom.operators.neighbourhoods import Block, by_blocks

#: Fixed value: the least observation kept.
LEAST = 1e-8
MOMENTS = ("n", "s1", "s2", "s3", "s4", "raw_entropy")
SCHEMA = "left long, right long, n long, s1 double, s2 double, s3 double, s4 double, raw_entropy double"


def bitmaps(members: list[np.ndarray], names: np.ndarray) -> np.ndarray:
    """A row of 64-bit words for each of the sorted ``names``: bit r says that ``members[r]`` holds it; others are skipped."""
    out = np.zeros((len(names), (len(members) + 63) // 64), dtype=np.uint64)
    if not len(names) or not len(members):
        return out
    held = np.concatenate(members)
    row = np.repeat(np.arange(len(members)), [len(m) for m in members])
    at = np.minimum(np.searchsorted(names, held), len(names) - 1)
    known = names[at] == held
    np.bitwise_or.at(out, (at[known], row[known] // 64), np.uint64(1) << (row[known] % 64).astype(np.uint64))
    return out


def shared_subsets(bits: np.ndarray, k: int, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, intersections) of all k-subsets of the rows of ``bits`` that intersect, in blocks of about ``cells`` words."""
    items, words = bits.shape
    step = max(1, cells // max(1, items * words))

    def grow(prefix: np.ndarray, inter: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if prefix.shape[1] == k:
            yield prefix, inter
            return
        for lo in range(0, len(prefix), step):
            p, b = prefix[lo : lo + step], inter[lo : lo + step]
            more = items - 1 - p[:, -1]
            i = np.repeat(np.arange(len(p)), more)
            j = np.arange(len(i)) - np.repeat(np.cumsum(more) - more, more) + p[i, -1] + 1
            both = b[i] & bits[j]
            some = both.any(axis=1)
            if some.any():
                yield from grow(np.column_stack([p[i[some]], j[some]]), both[some])

    first = np.flatnonzero(bits.any(axis=1))
    if len(first):
        yield from grow(first[:, None], bits[first])


def popcounts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits the rows of ``a`` and of ``b`` have in common, each with each."""
    out = np.zeros((len(a), len(b)), dtype=np.int32)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] & b[None, :, w])
    return out


def _add(total: np.ndarray, c: np.ndarray, n: np.ndarray, times: np.ndarray, lu: float, lv: np.ndarray) -> None:
    """Adds the observations of subsets (rows) and targets (columns), each ``times``, to the six sums of every target."""
    x = (c / n[:, None] / lv[None, :] * lu).astype(np.float32)
    x = np.where((c > 0) & (x > LEAST), x, 0).astype(np.float64)
    t = times[:, None]
    power = x * t
    total[0] += ((x > 0) * t).sum(axis=0)
    total[5] -= (power * np.log(np.where(x > 0, x, 1.0))).sum(axis=0)
    for p in range(1, 5):
        total[p] += power.sum(axis=0)
        power = power * x


def _light(k: int, exclude_self: bool, cells: int, group_rows: int, group_sets: float):
    """A kernel of the sums of every target; a left node that has too many partners or subsets gives one row without target instead."""

    def sums(b: Block) -> Iterator[dict[str, np.ndarray]]:
        held = np.zeros(len(b.names), dtype=np.int32)
        row = np.full(len(b.names), -1, dtype=np.int64)
        for p in b.parts():
            left, right, totals = [], [], []
            for i in range(p.n):
                u = p.lo + i
                items, goals = (x[q[u] : q[u + 1]] for x, q in ((b.items, b.ip), (b.goals, b.gp)))
                if len(items) < k:
                    continue
                fs, gs = slice(p.fp[i], p.fp[i + 1]), slice(p.gp[i], p.gp[i + 1])
                f, g = p.f[fs], p.g[gs]
                np.add.at(held, f, 1)
                if b.me[u] >= 0:
                    held[b.me[u]] = 0
                some = held[f] >= k
                nodes = np.unique(f[some])
                sets = float(_subsets(held[nodes].astype(np.float64), k).sum())
                held[f] = 0
                if len(nodes) > group_rows or sets > group_sets:
                    left.append([u])
                    right.append([-1])
                    totals.append(np.zeros((6, 1)))
                    continue
                row[nodes] = np.arange(len(nodes))
                common = _bits(p.f_at[fs][some] - b.ip[u], row[f[some]], len(items), len(nodes))
                met = row[g] >= 0
                here = _bits(p.g_at[gs][met] - b.gp[u], row[g[met]], len(goals), len(nodes))
                row[nodes] = -1
                own = np.zeros(len(goals), dtype=np.int32) if exclude_self else np.isin(goals, items).astype(np.int32)
                total = _sums(common, here, own, len(items), k, exclude_self, cells, float(b.left_value[u]), b.right_value[goals])
                seen = np.flatnonzero(total[0] > 0)
                left.append(np.full(len(seen), u))
                right.append(goals[seen])
                totals.append(total[:, seen])
            if left:
                at, to, total = np.concatenate(left).astype(np.int64), np.concatenate(right).astype(np.int64), np.concatenate(totals, axis=1)
                yield {"left": b.left[at], "right": pa.array(b.right[to], mask=to < 0), "n": np.rint(total[0]).astype(np.int64)} | {m: total[j] for j, m in enumerate(MOMENTS) if j}

    return sums


def _subsets(n: np.ndarray, k: int) -> np.ndarray:
    out = np.ones(len(n))
    for i in range(k):
        out = out * np.maximum(n - i, 0) / (i + 1)
    return out


def _bits(name: np.ndarray, member: np.ndarray, names: int, members: int) -> np.ndarray:
    """As ``bitmaps``, from the places of names and members."""
    out = np.zeros((names, (members + 63) // 64), dtype=np.uint64)
    np.bitwise_or.at(out, (name, member // 64), np.uint64(1) << (member % 64).astype(np.uint64))
    return out


def _sums(common: np.ndarray, here: np.ndarray, own: np.ndarray, items: int, k: int, exclude_self: bool, cells: int, lu: float, lv: np.ndarray) -> np.ndarray:
    """The six sums of every target, from the bitmaps of items and targets."""
    goals = len(lv)
    total, seen = np.zeros((6, goals)), 0
    for _, inter in shared_subsets(common, k, cells) if common.shape[1] else ():
        if inter.shape[1] == 1:
            inter, times = np.unique(inter[:, 0], return_counts=True)
            inter = inter[:, None]
        else:
            inter, times = np.unique(inter, axis=0, return_counts=True)
        seen += int(times.sum())
        n = np.bitwise_count(inter).sum(axis=1, dtype=np.int64) + (0 if exclude_self else 1)
        for lo in range(0, len(inter), step := max(1, cells // max(1, goals))):
            part = slice(lo, lo + step)
            _add(total, popcounts(inter[part], here) + own, n[part], times[part], lu, lv)
    if not exclude_self and (alone := comb(items, k) - seen):
        _add(total, own[None, :], np.ones(1), np.array([float(alone)]), lu, lv)
    return total


def _crowded(k: int, cells: int):
    """(left, combo, right, n) of a first item's subsets in one part of the nodes: how many have each (right null), and how many of these have a target."""

    def walk(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames))
        rest, hits = [[np.asarray(x) for x in f[c]] for c in ("rest", "hits")]
        items, goals = (np.unique(np.concatenate(x)) for x in (rest, hits))
        here = bitmaps(hits, goals)
        alone = np.zeros((1, 0), dtype=np.int64), bitmaps([np.zeros(1, dtype=np.int64)] * len(f), np.zeros(1, dtype=np.int64))
        for subsets, inter in [alone] if k == 1 else shared_subsets(bitmaps(rest, items), k - 1, cells):
            names = np.column_stack([np.full(len(subsets), int(key[1])), *items[subsets].T]).astype(np.int64)
            for lo in range(0, len(inter), step := max(1, cells // max(1, len(goals)))):
                part, named = inter[lo : lo + step], names[lo : lo + step]
                c = popcounts(part, here)
                i, j = np.nonzero(c)
                n = np.bitwise_count(part).sum(axis=1, dtype=np.int64)
                right = pd.array([None] * len(part) + goals[j].tolist(), dtype="Int64")
                yield pd.DataFrame({"left": int(key[0]), "combo": pd.Series([*named, *named[i]], dtype=object), "right": right, "n": np.concatenate([n, c[i, j]])})

    return walk


def _choose(d: Column, k: int) -> Column:
    """d choose k as a double, 0 below k."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * F.greatest(d - i, F.lit(0)) / (i + 1)
    return out


def observation_sums(edges: DataFrame, pairs: DataFrame, k: int, exclude_self: bool = False, cells: int = 2_000_000, group_rows: int = 4096, group_sets: float = 2e7, most: int = MOST) -> DataFrame:
    """(left, right, n, s1..s4, raw_entropy): the moments of ``observations`` for any k, without a row for an observation.

    A left node is done in its block unless more than ``group_rows`` nodes share k items with it or these share more than
    ``group_sets`` subsets in all.  Rules: as in ``observations``; targets whose right node has no edges have no observations.
    """
    e, wanted = edges.select(*KEYS).distinct(), pairs.select(*KEYS).distinct()
    value = lambda side: node_degrees(edges, side).select(F.col("node").alias(side), F.log1p(F.col("degree").cast("double")).alias("value"))
    sums, dealt = by_blocks(e, wanted, _light(k, exclude_self, cells, group_rows, group_sets), SCHEMA, left_value=value("left"), right_value=value("right"), most=most)
    sums = stored(sums)
    crowd = sums.where("right is null").select("left")
    crowd = stored(crowd if dealt is None else crowd.unionByName(dealt))
    out = sums.where("right is not null")
    return out if crowd.isEmpty() else out.unionByName(_crowded_sums(edges, e, wanted.join(crowd, "left", "left_semi"), k, exclude_self, cells, group_rows))


def _crowded_sums(edges: DataFrame, e: DataFrame, wanted: DataFrame, k: int, exclude_self: bool, cells: int, group_rows: int) -> DataFrame:
    tasks = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    log = lambda side, name: node_degrees(edges, side).select(F.col("node").alias(side), F.log1p(F.col("degree").cast("double")).alias(name))
    goals = wanted.join(log("right", "v"), "right").groupBy("left").agg(F.array_sort(F.collect_list("right")).alias("goals"))
    near = adjacency(e, "left").toDF("left", "near")
    info = stored(goals.join(near, "left").where(F.size("near") >= k).select("left", F.col("near").alias("items"), "goals"))
    steps = info.select("left").join(e, "left").join(e.toDF("w", "right"), "right").where("w <> left")
    shared = steps.groupBy("left", "w").agg(F.array_sort(F.collect_list("right")).alias("items")).where(F.size("items") >= k)
    met = shared.join(near.toDF("w", "near"), "w").join(info.select("left", "goals"), "left")
    rows = stored(met.select("left", "w", "items", F.array_intersect("near", "goals").alias("met")))
    rows = rows.join(rows.groupBy("left").agg(F.count(F.lit(1)).alias("nodes")), "left")
    part = F.pmod(F.xxhash64("w"), F.ceil(F.col("nodes") / group_rows)).alias("part")
    begun = rows.select("left", part, F.col("met").alias("hits"), "items", F.posexplode("items").alias("i", "first")).where(F.size("items") - F.col("i") >= k)
    begun = begun.select("left", "first", "part", "hits", F.slice("items", F.col("i") + 2, F.size("items")).alias("rest"))
    found = stored(begun.repartition(tasks, "left", "first", "part").groupBy("left", "first", "part").applyInPandas(_crowded(k, cells), "left long, combo array<long>, right long, n long"))
    me = 0 if exclude_self else 1
    support = found.where("right is null").groupBy("left", "combo").agg((F.sum("n") + me).alias("_n"))
    support = stored(support)
    hits = found.where("right is not null").groupBy("left", "combo", "right").agg(F.sum("n").alias("_c")).join(support, ["left", "combo"])
    keys = [*KEYS, "_n"]
    if exclude_self:
        counted = hits.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("times"))
    else:
        own = wanted.join(e, KEYS, "left_semi").join(info.select("left"), "left", "left_semi")
        hits = hits.join(own.withColumn("_own", F.lit(1)), KEYS, "left").withColumn("_c", F.col("_c") + F.coalesce("_own", F.lit(0)))
        met = stored(hits.groupBy(*keys, "_c", "_own").agg(F.count(F.lit(1)).alias("times")))
        # u itself has the target: subsets whose other nodes have not, and those that no other node has
        sizes = support.groupBy("left", "_n").agg(F.count(F.lit(1)).alias("all"))
        taken = met.where("_own = 1").groupBy(*keys).agg(F.sum("times").alias("gone"))
        quiet = own.join(sizes, "left").join(taken, keys, "left").select(*keys, F.lit(1).cast("long").alias("_c"), (F.col("all") - F.coalesce("gone", F.lit(0))).alias("times"))
        seen = sizes.groupBy("left").agg(F.sum("all").alias("seen"))
        alone = own.join(info.select("left", _choose(F.size("items"), k).alias("every")), "left").join(seen, "left", "left")
        alone = alone.select(*KEYS, F.lit(1).cast("long").alias("_n"), F.lit(1).cast("long").alias("_c"), (F.round("every") - F.coalesce("seen", F.lit(0))).cast("long").alias("times"))
        counted = met.select(*keys, "_c", "times").unionByName(quiet).unionByName(alone.select(*keys, "_c", "times")).where("times > 0")
    valued = counted.join(log("left", "lu"), "left").join(log("right", "lv"), "right")
    x = (F.col("_c") / F.col("_n") / F.col("lv") * F.col("lu")).cast("float").cast("double")
    t = F.col("times")
    full = valued.withColumn("x", x).where(F.col("x") > LEAST)
    x = F.col("x")
    return full.groupBy(*KEYS).agg(F.sum(t).alias("n"), F.sum(t * x).alias("s1"), F.sum(t * x * x).alias("s2"), F.sum(t * x * x * x).alias("s3"), F.sum(t * x * x * x * x).alias("s4"), F.sum(-t * x * F.log(x)).alias("raw_entropy"))
