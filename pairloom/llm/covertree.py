"""Near-duplicate vectors by dual traversal of cover trees; exact for a cosine threshold.

On unit vectors cosine >= t means a distance of at most eps = sqrt(2 - 2t).
Equal vectors are one row with a weight from the start.  Vectors go to the
nearest of a bounded number of pivots (the top of the tree, from a bounded
sample); a cell of many vectors is split into chunks by hash.  In each chunk
a cover tree is built whose levels have radii eps/2, eps, 2 eps, ...: every
node's members lie within its radius of its centre, and the centres of a
level farther apart than that.  A vector visits each later cell that may
hold a partner: d(x, pivot) <= radius + eps, and d(x, pivot) - d(x, own pivot) <= 2 eps.

Tasks then traverse two trees at a time from the top, level by level.  A pair of nodes is
dropped if d > r1 + r2 + eps, and accepted whole if d + r1 + r2 <= eps, so
that a crowd of near copies is counted by its nodes' weights; what lies between goes on
to the pairs of their children, and from the finest level to single vectors, where the cosine of the given vectors decides.
A task returns each vector's count and its root in the task, never a list of pairs.

Where data have no structure at the scale of eps (random directions in many
dimensions) pivots exclude little and the work tends to that of all pairs of
chunks; no bound known excludes them exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import stored
from pairloom.llm.components import connected_components
from pairloom.llm.vectors import matrix, padded, units, usable

CHUNK = 4096
MAX_PIVOTS = 1024
SAMPLE = 8192
GUARD = 1e-7


def greedy_net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres (indices) and each row's centre: rows of a net lie farther apart than ``radius``, all rows within it."""
    n = len(x)
    near = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ x.T))) <= radius
    owner = np.full(n, -1)
    centres = []
    for i in range(n):
        if owner[i] < 0:
            centres.append(i)
            owner[near[i] & (owner < 0)] = i
    return np.array(centres, dtype=np.int64), owner


def build_levels(x: np.ndarray, eps: float, top: float = 2.0) -> list[np.ndarray]:
    """Each row's centre on every level, finest first; a level is a net of the centres below it."""
    radius = eps / 2 * (1 - GUARD)
    centres, owner = greedy_net(x, radius)
    out = [owner]
    while radius * 2 < top and len(centres) > 1:
        radius *= 2
        upper, of = greedy_net(x[centres], radius)
        to = np.full(len(x), -1)
        to[centres] = centres[of]
        out.append(to[out[-1]])
        centres = centres[upper]
    return out


class Tree:
    """The nodes of every level over the rows at hand, finest level first, with true radii.

    ``path`` holds a row's centre on each level.  Of a node whose centre is not at hand the first member stands for it;
    a node without members is absent.
    """

    def __init__(self, x: np.ndarray, weight: np.ndarray, path: np.ndarray):
        self.x, self.weight = x, weight
        self.of, self.centre, self.radius, self.heavy, self.below = [], [], [], [], []
        for level in path.T:
            _, first, of = np.unique(level, return_index=True, return_inverse=True)
            radius = np.zeros(len(first))
            np.maximum.at(radius, of, _distance(x, x[first[of]]))
            # what a node holds: rows on the finest level, nodes of the level below on the others
            parent = of[self.centre[-1]] if self.centre else of
            order = np.argsort(parent, kind="stable")
            self.below.append(np.split(order, np.flatnonzero(np.diff(parent[order])) + 1))
            self.of.append(of)
            self.centre.append(first)
            self.radius.append(radius)
            self.heavy.append(np.bincount(of, weights=weight, minlength=len(first)))

    def rows(self, level: int, node: int) -> np.ndarray:
        return np.flatnonzero(self.of[level] == node)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, ((a - b) ** 2).sum(axis=1)))


class Forest:
    """Union-find over the rows of a task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def dual_traversal(a: Tree, b: Tree, raw_a: np.ndarray, raw_b: np.ndarray, threshold: float, same: bool, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the rows of ``b`` linked to each row of ``a`` and the other way; joins linked rows in ``forest``.

    ``same`` says that ``b`` is ``a``: every pair is then met both ways, and the first result counts all.
    """
    if not len(a.x) or not len(b.x):
        return np.zeros(len(a.x)), np.zeros(len(b.x))
    eps = float(np.sqrt(2 - 2 * threshold))
    got_a, got_b = np.zeros(len(a.x)), np.zeros(len(b.x))
    node_a, node_b = [np.zeros(len(c)) for c in a.centre], [np.zeros(len(c)) for c in b.centre]
    shift = 0 if same else len(a.x)
    whole: tuple[set[tuple[int, int]], set[tuple[int, int]]] = (set(), set())
    top = len(a.centre) - 1
    todo = [(top, np.arange(len(a.centre[top])), np.arange(len(b.centre[top])))]
    while todo:
        level, mine, theirs = todo.pop()
        d = np.sqrt(np.maximum(0.0, 2 - 2 * (a.x[a.centre[level][mine]] @ b.x[b.centre[level][theirs]].T)))
        reach = a.radius[level][mine][:, None] + b.radius[level][theirs][None, :]
        i, j = np.nonzero(d <= reach + eps + GUARD)
        sure = d[i, j] + reach[i, j] <= eps - GUARD
        if same and level == 0:  # rows of a node of the finest level are within eps of each other
            sure |= mine[i] == theirs[j]
        for u, v in zip(mine[i[sure]], theirs[j[sure]], strict=True):
            node_a[level][u] += b.heavy[level][v]
            node_b[level][v] += a.heavy[level][u]
            forest.join(int(a.centre[level][u]), int(b.centre[level][v]) + shift)
            whole[0].add((level, int(u)))
            whole[1].add((level, int(v)))
        i, j = i[~sure], j[~sure]
        if level:
            for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else []:
                children = [b.below[level][v] for v in theirs[j[part]]]
                todo.append((level - 1, a.below[level][mine[i[part[0]]]], np.concatenate(children)))
            continue
        for u, v in zip(mine[i], theirs[j], strict=True):
            ra, rb = a.below[0][u], b.below[0][v]
            cos = a.x[ra] @ b.x[rb].T
            linked = cos >= threshold
            for s, t in zip(*np.nonzero(np.abs(cos - threshold) < 1e-9), strict=True):
                linked[s, t] = cosine(raw_a[ra[s]], raw_b[rb[t]]) >= threshold
            got_a[ra] += linked @ b.weight[rb]
            got_b[rb] += linked.T @ a.weight[ra]
            for s, t in zip(*np.nonzero(linked), strict=True):
                forest.join(int(ra[s]), int(rb[t]) + shift)
    for tree, nodes, k in ((a, whole[0], 0), (b, whole[1], shift)):
        # all rows of an accepted node are linked to all of the other one, and so are connected
        for level, node in nodes | {(0, n) for n in range(len(tree.centre[0]))}:
            rows = tree.below[0][node] if not level else tree.rows(level, node)
            for r in rows[1:]:
                forest.join(int(rows[0]) + k, int(r) + k)
    for level in range(top + 1):
        got_a += node_a[level][a.of[level]]
        got_b += node_b[level][b.of[level]]
    return got_a, got_b


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float(x @ y / np.sqrt((x @ x) * (y @ y)))


def _pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` rows of the coarsest net, radii halving from 2, that has as many."""
    radius = 2.0
    while True:
        radius /= 2
        chosen: list[int] = []
        for i in range(len(sample)):
            if len(chosen) == k:
                break
            if not chosen or np.sqrt(np.maximum(0.0, 2 - 2 * (sample[chosen] @ sample[i]))).min() > radius:
                chosen.append(i)
        if len(chosen) >= k or radius < 1e-3:
            return sample[chosen]


def near_vectors(vectors: DataFrame, threshold: float = 0.95, chunk: int = CHUNK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rules: vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing (0 links, themselves as component);
    shorter vectors count as filled with zeros; repeated rows link with each other; where ids
    repeat every row counts; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"))
    good = padded(given.where(usable(F.col("vec"))), "vec")
    keyed = stored(good.withColumn("node", F.xxhash64("vec")))
    rows = stored(keyed.groupBy("node", "vec").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least")))
    n = rows.count()
    if n == 0:
        return given.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    k = max(1, min(MAX_PIVOTS, -(-n // chunk)))
    sample = rows.select("vec").orderBy(F.xxhash64("node", F.lit(5)), "node").limit(min(SAMPLE, 16 * k)).toPandas()  # at most SAMPLE vectors
    pivots = spark.sparkContext.broadcast(_pivots(units(matrix(sample.vec)), k))

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                d = np.sqrt(np.maximum(0.0, 2 - 2 * (units(matrix(f.vec)) @ pivots.value.T)))
                cell = d.argmin(axis=1)
                yield f[["node", "vec", "weight"]].assign(cell=cell, away=d[np.arange(len(f)), cell], all=list(d))

    homed = stored(rows.select("node", "vec", "weight").mapInPandas(settle, "node long, vec array<double>, weight long, cell int, away double, all array<double>"))
    stats = {r.cell: (r.radius, r.n) for r in homed.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}  # a row a pivot
    eps = float(np.sqrt(2 - 2 * threshold))
    chunks = {c: -(-m // chunk) for c, (_, m) in stats.items()}

    def visits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.array(sorted(stats))
        radius = np.array([stats[c][0] for c in cells])
        for f in frames:
            if len(f):
                d = matrix(f["all"])[:, cells]
                go = (d <= radius + eps + GUARD) & (d - f.away.to_numpy()[:, None] <= 2 * eps + GUARD) & (cells > f.cell.to_numpy()[:, None])
                part = [int(v % chunks[c]) for v, c in zip(f.node, f.cell, strict=True)]
                yield f[["node", "vec", "weight", "cell"]].assign(chunk=part, visit=[cells[g].astype(np.int32) for g in go])

    placed = homed.mapInPandas(visits, "node long, vec array<double>, weight long, cell int, chunk int, visit array<int>")

    def grow(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        ids = f.node.to_numpy()
        return f.assign(path=list(np.stack([ids[level] for level in build_levels(units(matrix(f.vec)), eps)], axis=1)))

    schema = "node long, vec array<double>, weight long, cell int, chunk int, visit array<int>, path array<long>"
    grown = stored(placed.groupBy("cell", "chunk").applyInPandas(grow, schema))
    guests = {r.c: -(-r.n // chunk) for r in grown.select(F.explode("visit").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a pivot

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at, task, side = [], [], []
            for i, (node, c, p, visit) in enumerate(zip(f.node, f.cell, f.chunk, f.visit, strict=True)):
                to = [(f"{c}:{min(p, q)}:{max(p, q)}", int(p > q)) for q in range(chunks[c])] + [(f"{c}:{p}:v{g}", 0) for g in range(guests.get(c, 0))]
                for other in visit:
                    g = node % guests[other]
                    to += [(f"{other}:{q}:v{g}", 1) for q in range(chunks[other])]
                at += [i] * len(to)
                task += [t for t, _ in to]
                side += [s for _, s in to]
                if len(at) > 20_000:
                    yield f[["node", "vec", "weight", "path"]].iloc[at].assign(task=task, side=side)
                    at, task, side = [], [], []
            if at:
                yield f[["node", "vec", "weight", "path"]].iloc[at].assign(task=task, side=side)

    def meet(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["side", "node"], ignore_index=True)
        _, first, last = key[0].split(":")
        same = first == last
        parts = [f] if same else [f[f.side == 0], f[f.side == 1]]
        raw = [matrix(p.vec) for p in parts]
        high = max(map(len, f.path))  # a lower tree stays with its root on the levels above it
        paths = [np.array([[*v, *[v[-1]] * (high - len(v))] for v in p.path], dtype=np.int64).reshape(len(p), high) for p in parts]
        trees = [Tree(units(r) if len(r) else np.zeros((0, 1)), p.weight.to_numpy(dtype=float), path) for r, p, path in zip(raw, parts, paths, strict=True)]
        forest = Forest(len(f))
        got, other = dual_traversal(trees[0], trees[-1], raw[0], raw[-1], threshold, same, forest)
        total = got if same else np.concatenate([got, other])
        root = f.node.to_numpy()[[forest.find(i) for i in range(len(f))]]
        out = pd.DataFrame({"node": f.node, "n": np.rint(total).astype(np.int64), "root": root})
        return out[(out.n > 0) | (out.root != out.node)]

    sent = grown.mapInPandas(send, "node long, vec array<double>, weight long, path array<long>, task string, side int")
    met = stored(sent.groupBy("task").applyInPandas(meet, "node long, n long, root long"))
    counts = met.groupBy("node").agg(F.sum("n").alias("n"))
    comp = connected_components(met.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = rows.select("node", "least").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")).join(counts, "node", "left")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = stored(named.join(least, "component").select("node", "component_id", "n"))
    linked = keyed.select("vec_id", "node").join(names, "node").select("vec_id", (F.col("n") - 1).alias("n_links"), "component_id")
    alone = given.where(~usable(F.col("vec"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
