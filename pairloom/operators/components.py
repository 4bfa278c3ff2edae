"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pairloom.functions.storage import free, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.  A stored table.

    Only minima are taken per node (partially, before each shuffle), so a hub
    gathers nowhere; each round is stored in the shared folder and the one before deleted.  Rounds go on until
    nothing changes, which the two steps reach in a number of rounds that grows with the logarithm of the nodes.

    Rules: loops and repeated edges are allowed; an edge with a null end is none; no edges give no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    before, state = None, (0, 0)
    while state != before and not (before is None and now.isEmpty()):
        before = state
        # large star: every larger neighbour of u (and u) hangs on the least of u's neighbourhood
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
        large = now.join(least, F.col("u") == F.col("c")).select("v", F.col("m").alias("u")).where("v <> u")
        large = stored(large.unionByName(least.where("c <> m").select(F.col("c").alias("v"), F.col("m").alias("u"))).distinct())
        # small star: u's smaller neighbours hang on the least of them
        low = large.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("m"))
        small = large.join(low, F.col("v") == F.col("c")).select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
        seen = Observation()
        found = small.unionByName(low.select(F.col("c").alias("v"), F.col("m").alias("u"))).distinct()
        after = stored(found.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")))
        free(now, large)
        now, state = after, (seen.get["n"], seen.get["h"])
    roots = now.select(F.col("u").alias("node")).distinct()
    out = stored(now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))))
    free(now)
    return out


def _roots(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """The smallest node reachable from each of 0 .. nodes - 1: roots hang on smaller ones, then all nodes on their roots."""
    root = np.arange(nodes)
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def bipartite_components(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(left, component) and (right, component) of the nodes of distinct edges.

    Ranges of left nodes are joined within tasks first and leave an edge a node, so that rounds over all tasks have few.
    Rules: an edge with a null end is none; an empty table gives no rows.
    """

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema=pa.schema({"a": pa.int64(), "b": pa.int64()}))
        names, at = np.unique(np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]), return_inverse=True)
        root = _roots(at[: len(rows)], at[len(rows) :], len(names))
        yield from pa.table({"a": names, "b": names[root]}).cast(pa.schema({"a": pa.int64(), "b": pa.int64()})).to_batches()

    tasks = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = e.where("left is not null and right is not null").select((F.col("left") * 2).alias("a"), (F.col("right") * 2 + 1).alias("b"))
    # every node has an edge to another one within its task or is its root
    every = connected_components(ends.repartitionByRange(tasks, "a").mapInArrow(within, "a long, b long"))
    side = lambda name, bit: every.where(F.col("node").bitwiseAND(1) == bit).select(F.shiftright("node", 1).alias(name), "component")
    return side("left", 0), side("right", 1)
