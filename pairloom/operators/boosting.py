"""Gradient-boosted trees over binned features, several feature subsets fitted together.

Rows are binned once, by quantiles of all rows, and stored as blocks of bytes; a block also holds its rows' margins for every
subset.  Level by level one job adds up gradients and their weights by subset, node, feature and bin within each task; Spark adds up the
tasks' sums, unless they are few, and the driver picks the splits from them; their number depends on the settings only.  Margins are written anew every
few rounds; in between the last trees are applied on the fly.  The table of blocks is planned once for all levels between two writings: a query planned
for every level fills the driver's memory with plans and their metrics.  Logistic loss, second-order leaves, L2 weight 1.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.storage import free, stored

#: Rounds between two writings of the margins, and tasks whose sums the driver adds up itself.
REFRESH, FEW_TASKS = 3, 64
L2, LEAST_WEIGHT = 1.0, 1.0


@dataclass
class Tree:
    """Splits by level (features, last bins of the left side), a value for each leaf."""

    splits: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    leaves: np.ndarray | None = None

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        for feature, last in self.splits:
            at = 2 * at + (bins[rows, feature[at]] > last[at])
        return at


@dataclass
class BoostedScorer:
    """Trees by subset name over ``columns``, with the upper edges of their bins."""

    columns: list[str]
    edges: list[np.ndarray]
    trees: dict[str, list[Tree]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin numbers; a missing value counts as the least."""
        x = np.where(np.isnan(x), -np.inf, x)
        return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def margins(self, bins: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.zeros((len(bins), len(names)))
        for j, name in enumerate(names):
            for t in self.trees[name]:
                out[:, j] += t.leaves[t.nodes(bins)]
        return out


def best_splits(sums: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From (node, feature, bin, g or h) the best feature and bin of each node, and the sums of both sides; no gain: all to the left."""
    left = np.cumsum(sums, axis=2)
    total = left[:, :, -1:, :]
    right = total - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + L2)
    gain = np.where((left[..., 1] >= LEAST_WEIGHT) & (right[..., 1] >= LEAST_WEIGHT), score(left) + score(right) - score(total), 0.0)
    flat = gain.reshape(len(sums), -1)
    at = flat.argmax(axis=1)
    n = np.arange(len(sums))
    at = np.where(flat[n, at] > 1e-9, at, sums.shape[2] - 1)  # the last bin of the first feature: nothing is right of it
    f, b = np.divmod(at, sums.shape[2])
    return features[f], b, left[n, f, b], right[n, f, b]


def quantile_edges(rows: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """At most bins - 1 upper edges of each column, from one pass over all rows."""
    probs = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    got = rows.agg(*(F.percentile_approx(F.col(c).cast("double"), probs, F.lit(10_000)).alias(f"q{i}") for i, c in enumerate(columns))).first()
    return [np.unique(np.array(q if q is not None else [], dtype=np.float64)) for q in got]


def fit_boosted(rows: DataFrame, subsets: dict[str, list[str]], rounds: int = 100, depth: int = 4, rate: float = 0.05, bins: int = 16, positive_weight: float = 10.0, label: str = "label", grain: int | None = None) -> BoostedScorer:
    """One model a subset of columns from rows with ``label`` 0 or 1; positives count ``positive_weight`` times.

    With ``grain`` gradients are rounded to multiples of 2 ** -grain, so that their sums do not depend on the order of the rows.

    Rules: rows without a label teach nothing; a missing value counts as the least; an empty table gives trees without splits.
    """
    spark, names = rows.sparkSession, list(subsets)
    columns = list(dict.fromkeys(c for s in subsets.values() for c in s))
    own = [np.array([columns.index(c) for c in subsets[n]]) for n in names]
    known = rows.where(F.col(label).isNotNull())
    model = BoostedScorer(columns, quantile_edges(known, columns, bins), {n: [] for n in names})
    width = len(columns)

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                y = f["y"].to_numpy(dtype=np.float64)
                yield pd.DataFrame({"bins": [model.bins(f[[f"x{i}" for i in range(width)]].to_numpy(dtype=np.float64)).tobytes()], "y": [y.tobytes()], "margin": [np.zeros((len(y), len(names))).tobytes()]})

    schema = "bins binary, y binary, margin binary"
    slim = known.select(F.col(label).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)))
    table = stored(slim.mapInPandas(binned, schema))
    pending: list[list[Tree]] = []

    def opened(blocks: Iterable[tuple[bytes, bytes, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for b, y, margin in blocks:
            x = np.frombuffer(b, dtype=np.uint8).reshape(-1, width)
            m = np.frombuffer(margin, dtype=np.float64).reshape(-1, len(names)).copy()
            for trees in pending:
                for j, t in enumerate(trees):
                    m[:, j] += t.leaves[t.nodes(x)]
            yield x, np.frombuffer(y, dtype=np.float64), m

    def refreshed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(margin=[m.tobytes() for _, _, m in opened(zip(f.bins, f.y, f.margin, strict=True))])

    def histograms(begun: list[Tree]):
        def add(blocks: Iterable[tuple[bytes, bytes, bytes]]) -> Iterator[np.ndarray]:
            total = [np.zeros((1 << len(t.splits), len(o), bins, 2)) for t, o in zip(begun, own, strict=True)]
            for x, y, m in opened(blocks):
                p = 1 / (1 + np.exp(-m))
                w = np.where(y == 1, positive_weight, 1.0)[:, None]
                g, h = w * (p - y[:, None]), w * p * (1 - p)
                if grain is not None:
                    g, h = (np.round(np.ldexp(v, grain)) * 2.0**-grain for v in (g, h))
                for j, (t, o) in enumerate(zip(begun, own, strict=True)):
                    node = t.nodes(x) * bins
                    for i, c in enumerate(o):
                        at = node + x[:, c]
                        for s, v in enumerate((g, h)):
                            total[j][:, i, :, s] += np.bincount(at, v[:, j], minlength=len(total[j]) * bins).reshape(-1, bins)
            yield np.concatenate([t.ravel() for t in total])

        return add

    def collected(trees: list[Tree], level: int) -> list[np.ndarray]:
        """The sums of all tasks; of many tasks they are added up by Spark first."""
        sums = [np.zeros((1 << level, len(o), bins, 2)) for o in own]
        parts, tasks = planned.mapPartitions(histograms(trees)), planned.getNumPartitions()
        if not tasks:
            return sums
        flat = sum(parts.collect()) if tasks <= FEW_TASKS else parts.treeReduce(np.add)
        return [f.reshape(s.shape) for f, s in zip(np.split(flat, np.cumsum([s.size for s in sums])[:-1]), sums, strict=True)]

    planned = table.rdd
    for r in range(rounds):
        trees = [Tree() for _ in names]
        for level in range(depth):
            sums = collected(trees, level)
            for j, t in enumerate(trees):
                f, b, left, right = best_splits(sums[j], own[j])
                t.splits.append((f, b))
                ends = np.stack([left, right], axis=1).reshape(-1, 2)
                t.leaves = -rate * ends[:, 0] / (ends[:, 1] + L2)
        pending.append(trees)
        for n, t in zip(names, trees, strict=True):
            model.trees[n].append(t)
        if len(pending) == REFRESH and r + 1 < rounds:
            before, table = table, stored(table.mapInPandas(refreshed, schema))
            planned = table.rdd
            pending.clear()
            free(before)
    free(table)
    return model


def boosted_scores(model: BoostedScorer, rows: DataFrame, prefix: str = "score_") -> DataFrame:
    """``rows`` with a probability for each subset, in columns ``prefix`` and its name."""
    names = list(model.trees)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for x in batches:
            m = model.margins(model.bins(x.to_numpy(dtype=np.float64)), names)
            yield pd.Series(list(1 / (1 + np.exp(-m))))

    packed = F.struct(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(model.columns)))
    taken = {c.lower() for c in rows.columns}
    hold = "_scores"
    while hold in taken:
        hold += "_"
    out = rows.withColumn(hold, score(packed))
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), *(F.col(hold)[i].alias(f"{prefix}{n}") for i, n in enumerate(names)))
