"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted to a bounded sample by k-means whose assignment
penalises large clusters.  Every vector joins the list of its nearest centroid,
and a boundary vector up to ``copies`` lists whose centroids are
nearly as near and not on the same side.  A query finds centroids by best-first
search of a neighbour graph held in memory, and keeps the lists whose distance is within
(1 + ratio) of the nearest one's; the ratio is the smallest at which queries from the
sample reach the wanted recall within the sample.

Inner products become distances by one more component, sqrt(M^2 - |x|^2) with
M the largest norm (0 in queries), so nearest means largest product.
Lists meet the queries that chose them in tasks of bounded size: a list of many rows
is cut by hash into parts, which go to different tasks, and a task that many queries ask for is repeated for
blocks of TASK_QUERIES of them.  Scores are inner products of the given vectors in
double precision; a query's best of each task meet at the end.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.llm.common import stored
from pairloom.llm.vectors import matrix, padded, usable

#: Vectors that the centroids are fitted to: so many, or sixteen a list up to the second number.
SAMPLE = (8192, 32_768)
TASK_ROWS = 30_000
TASK_QUERIES = 20_000
#: Distances of vectors to centroids, or of centroids to each other, that are held at once.
CELLS = 1 << 21


def lift(x: np.ndarray, largest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, largest**2 - (x * x).sum(axis=1)))
    return np.hstack([x, rest[:, None]])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T)


def _blocks(rows: int, columns: int) -> Iterator[slice]:
    """Slices of rows, of CELLS distances each."""
    step = max(1, CELLS // max(1, columns))
    return (slice(lo, lo + step) for lo in range(0, rows, step))


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k-means in which a cluster above the mean size looks farther away."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    load = np.ones(k)
    for _ in range(rounds):
        # distances are made anew for the second pass: all of them together would fill the driver
        mean = sum(_squared(x[b], c).min(axis=1).sum() for b in _blocks(len(x), k)) / len(x)
        away = mean * 0.5 * np.maximum(0.0, load - 1)[None, :]
        own = np.concatenate([(_squared(x[b], c) + away).argmin(axis=1) for b in _blocks(len(x), k)])
        size = np.bincount(own, minlength=k)
        load = 0.5 * load + 0.5 * size * k / len(x)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], x[rng.integers(0, len(x), k)])
    return c


class Centroids:
    """Centroids, their neighbour graph, and the ratio that prunes lists."""

    def __init__(self, c: np.ndarray, degree: int = 16, seed: int = 2):
        self.c = c
        near = np.concatenate([np.argsort(_squared(c[b], c), axis=1, kind="stable")[:, 1 : degree + 1] for b in _blocks(len(c), len(c))])
        far = np.random.default_rng(seed).integers(0, len(c), (len(c), 2))
        both: list[set[int]] = [set(map(int, row)) | set(map(int, more)) for row, more in zip(near, far, strict=True)]
        for i in range(len(c)):
            both[i].add((i + 1) % len(c))  # a ring keeps the graph connected
            for j in list(both[i]):
                both[j].add(i)
        self.graph = [np.array(sorted(s - {i}), dtype=np.int64) for i, s in enumerate(both)]
        self.ratio = 0.0
        self.sizes = np.ones(len(c))

    def search(self, q: np.ndarray, least_rows: int) -> np.ndarray:
        """Lists within (1 + ratio) of the nearest, nearest first, and as many more as ``least_rows`` rows need.

        Best-first search from a fixed entry; it ends when the nearest
        centroid not yet opened lies beyond the limit and the eight found last brought none nearer.
        """
        gap = lambda i: ((self.c[i] - q) ** 2).sum(axis=-1)
        seen = np.zeros(len(self.c), dtype=bool)
        seen[0] = True
        open_ = [(float(gap(0)), 0)]
        done: list[tuple[float, int]] = []
        best, rows, idle = open_[0][0], 0.0, 0
        while open_:
            d, i = heapq.heappop(open_)
            beyond = d > best * (1 + self.ratio) ** 2
            idle = idle + 1 if beyond else 0
            if beyond and rows >= least_rows and idle > 8:
                break
            done.append((d, i))
            rows += self.sizes[i]
            new = self.graph[i][~seen[self.graph[i]]]
            seen[new] = True
            if len(new):
                g = gap(new)
                best = min(best, float(g.min()))
                for item in zip(g.tolist(), new.tolist(), strict=True):
                    heapq.heappush(open_, item)
        done.sort()
        keep, rows = [], 0.0
        for d, i in done:
            if d > done[0][0] * (1 + self.ratio) ** 2 and rows >= least_rows:
                break
            keep.append(i)
            rows += self.sizes[i]
        return np.array(keep, dtype=np.int64)

    def lists_of(self, x: np.ndarray, copies: int, spread: float) -> list[np.ndarray]:
        """The lists that each vector joins, its nearest first."""
        out = []
        for b in _blocks(len(x), len(self.c)):
            d = np.sqrt(_squared(x[b], self.c))
            order = np.argsort(d, axis=1, kind="stable")[:, : 2 * copies]
            for row, near in zip(np.take_along_axis(d, order, axis=1), order, strict=True):
                own = [0]
                if len(near) > 1 and row[1] <= (1 + spread) * row[0]:
                    between = np.sqrt(_squared(self.c[near], self.c[near]))
                    for j in range(1, len(near)):
                        if len(own) == copies or row[j] > (1 + spread) * row[0]:
                            break
                        if all(between[j, i] > row[j] for i in own):
                            own.append(j)
                out.append(near[own].astype(np.int32))
        return out

    def calibrate(self, x: np.ndarray, queries: np.ndarray, self_at: np.ndarray, k: int, recall: float, copies: int, spread: float) -> None:
        """Sets the least ratio at which the lists hold ``recall`` of the exact neighbours within the sample."""
        lists = self.lists_of(x, copies, spread)
        k = min(k, len(x) - 1)
        if k < 1:
            return
        top = []
        for b in _blocks(len(queries), len(x)):
            score = queries[b] @ x.T
            score[np.arange(len(score)), self_at[b]] = -np.inf
            top.append(np.argpartition(-score, k - 1, axis=1)[:, :k])
        top = np.concatenate(top)
        d = np.sqrt(_squared(queries, self.c))
        need = np.array([[d[q, lists[t]].min() / max(d[q].min(), 1e-12) - 1 for t in row] for q, row in enumerate(top)])
        self.ratio = float(np.quantile(need, recall)) + 1e-9


def _sampled(rows: DataFrame, n: int, most: int) -> DataFrame:
    """The vectors of the ``most`` lowest hashes of ``n`` rows; only rows of a hash below a bound that so many should have are sorted.

    A heap of whole vectors for each task would send ``most`` of each to the driver.
    """
    order = F.xxhash64("vec_id", "vec")
    share, found = (most + 6 * most**0.5 + 50) / n, rows
    while share < 1:
        found = rows.where(order < F.lit(int(share * (1 << 64)) - (1 << 63)))
        if found.count() >= most:
            break
        share, found = 4 * share, rows
    return found.orderBy(order, "vec_id").limit(most).select("vec")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, copies: int = 4, spread: float = 0.1, recall: float = 0.97, rows_per_list: int = 200, max_lists: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``queries`` its ``k`` nearest found among ``vectors``.

    Both have ``id_col`` and ``vector_col``; a row is no candidate of the
    query of its own id.  Rules: vectors that are null, empty, zero, or hold null or
    non-finite components take no part, nor do null ids; equal scores go to the smaller id; rows that
    repeat an id and its vector count once; with fewer candidates than ``k``, all are returned; shorter vectors
    count as filled with zeros.
    """
    spark = vectors.sparkSession
    take = lambda df, flag: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"), F.lit(flag).alias("is_query")).where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    # rows that repeat an id and its vector go before any list is cut to its best
    both = stored(padded(take(vectors, False).dropDuplicates(["vec_id", "vec"]).unionByName(take(queries, True)), "vec"))
    rows, asked = both.where("not is_query"), both.where("is_query")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    n, largest = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    if not n:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    lists = max(1, min(max_lists, n // rows_per_list, SAMPLE[1] // 4))
    sample = _sampled(rows, n, min(SAMPLE[1], max(SAMPLE[0], 16 * lists))).toPandas()  # at most SAMPLE[1] vectors
    x = matrix(sample.vec)
    lifted = lift(x, largest)
    lists = max(1, min(lists, len(x) // 4))
    index = Centroids(balanced_centroids(lifted, lists))
    some = np.random.default_rng(4).permutation(len(x))[:256]
    index.calibrate(lifted, np.hstack([x[some], np.zeros((len(some), 1))]), some, k, recall, copies, spread)
    index = spark.sparkContext.broadcast(index)

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                own = index.value.lists_of(lift(matrix(f.vec), largest), copies, spread)
                yield f[["vec_id", "vec"]].assign(lists=own)

    posted = stored(rows.mapInPandas(post, "vec_id long, vec array<double>, lists array<int>"))
    sizes = posted.groupBy(F.col("lists")[0].alias("list")).agg(F.countDistinct("vec_id").alias("n")).collect()  # a row a list
    counts = np.zeros(lists)
    for r in sizes:
        counts[r.list] = r.n
    total = int(posted.agg(F.sum(F.size("lists"))).first()[0])
    tasks = max(1, -(-total // TASK_ROWS))
    # a list lies in one task, or in as many as half-filled tasks would hold its primary rows
    parts = np.maximum(1, -(-2 * counts // TASK_ROWS)).astype(np.int64)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = index.value
        c.sizes = counts
        for f in frames:
            at, task, chosen = [], [], []
            for i, v in enumerate(f.vec):
                where: dict[int, set[int]] = {}
                for j in c.search(np.append(np.asarray(v, dtype=float), 0.0), k + 1).tolist():
                    for p in range(min(tasks, int(parts[j]))):
                        where.setdefault((j + p) % tasks, set()).add(j)
                for t, lists_ in where.items():
                    at.append(i)
                    task.append(t)
                    chosen.append(np.array(sorted(lists_), dtype=np.int32))
            yield f[["vec_id", "vec"]].iloc[at].assign(lists=chosen, task=task)

    asked = stored(asked.select("vec_id", "vec").mapInPandas(ask, "vec_id long, vec array<double>, lists array<int>, task int"))
    blocks = asked.groupBy("task").agg(F.ceil(F.count(F.lit(1)) / TASK_QUERIES).cast("int").alias("blocks"))
    part_of = F.element_at(F.array(*(F.lit(int(p)) for p in parts)), F.col("list") + 1) if parts.max() > 1 else F.lit(1)
    members = posted.withColumn("list", F.explode("lists"))
    members = members.withColumn("task", ((F.col("list") + F.pmod(F.xxhash64("vec_id"), part_of)) % tasks).cast("int")).join(blocks, "task")
    members = members.select("vec_id", "vec", F.array("list").alias("lists"), "task", F.explode(F.sequence(F.lit(1), "blocks")).alias("block"), F.lit(False).alias("is_query"))
    asked_in = asked.join(blocks, "task").select("vec_id", "vec", "lists", "task", (F.pmod(F.xxhash64("vec_id"), "blocks") + 1).cast("int").alias("block"), F.lit(True).alias("is_query"))
    met = members.unionByName(asked_in)

    def best(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        q, p = f[f.is_query], f[~f.is_query].sort_values("vec_id")
        if not len(q) or not len(p):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=object)
        qv, pv, pid = matrix(q.vec), matrix(p.vec), p.vec_id.to_numpy()
        of = np.array([x[0] for x in p.lists])
        asked_for: dict[int, list[int]] = {}
        for i, ls in enumerate(q.lists):
            for j in ls:
                asked_for.setdefault(int(j), []).append(i)
        found: list[list[np.ndarray]] = [[] for _ in range(len(q))]
        qid = q.vec_id.to_numpy()
        for j, who in asked_for.items():
            at = np.flatnonzero(of == j)
            if not len(at):
                continue
            first = np.unique(pid[at], return_index=True)[1]  # rows are in order of their ids
            for lo in range(0, len(who), 512):
                some_ = np.array(who[lo : lo + 512])
                s = qv[some_] @ pv[at].T
                s[qid[some_][:, None] == pid[at][None, :]] = -np.inf
                each = np.maximum.reduceat(s, first, axis=1)  # an id of several vectors counts once, by its best
                kth = np.partition(each, len(first) - k, axis=1)[:, len(first) - k] if len(first) > k else np.full(len(some_), -np.inf)
                keep = s >= (kth - 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0.0))))[:, None]
                for r, i in enumerate(some_):
                    found[i].append(at[keep[r] & np.isfinite(s[r])])
        ids, vs, ss = [], [], []
        for i, got in enumerate(found):
            if not got:
                continue
            at = np.concatenate(got)
            s = np.einsum("ij,j->i", pv[at], qv[i])
            order = np.lexsort((pid[at], -s))
            at, s = at[order], s[order]
            top = np.sort(np.unique(pid[at], return_index=True)[1])[:k]
            ids.append(np.full(len(top), qid[i]))
            vs.append(pid[at][top])
            ss.append(s[top])
        return pd.DataFrame({"query_id": np.concatenate(ids), "vec_id": np.concatenate(vs), "score": np.concatenate(ss)}) if ids else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=object)

    each = met.groupBy("task", "block").applyInPandas(best, "query_id long, vec_id long, score double")
    one_each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return one_each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
