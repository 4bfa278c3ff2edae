"""Edge lists: projection, cleaning, indexing, degrees, cores, set operations.

An edge list has the long columns ``left`` and ``right``.

Rules, unless an operator says otherwise: an empty table gives no rows (counts give 0); repeated edges count as
often as they occur, but not in ``distinct_edges``, ``adjacency`` and ``symmetrize``; a null end is a value of its own in counts of
edges, no node of a node list or core, and meets nothing in joins; other columns pass or are dropped by name, never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.hashing import hash_key
from pairloom.functions.ranking import with_position
from pairloom.functions.storage import free, stored

KEYS = ["left", "right"]


def project_edges(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.select(F.col(left).cast("long").alias("left"), F.col(right).cast("long").alias("right"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(KEYS)


def factorize(df: DataFrame, col: str, order: str | Column | None = None, code: str | None = None) -> DataFrame:
    """``df`` with dense codes 0.. of ``col``, by value or by the least ``order`` of each value; null gets -1.

    Equal ``order`` goes by value; a column of the new name is replaced.
    """
    values = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(F.col(col) if order is None else order).alias("_first"))
    name = code or f"{col}_code"
    df = df.drop(name)
    coded = with_position(values, "_first", col, name=name).drop("_first").withColumnRenamed(col, "_value")
    return df.join(coded, F.col(col) == F.col("_value"), "left").drop("_value").withColumn(name, F.coalesce(F.col(name), F.lit(-1)).cast("long"))


def offset_right_ids(edges: DataFrame) -> DataFrame:
    """Right ids shifted by the largest left id plus one, so that both sides share one id space."""
    top = edges.agg((F.max("left") + 1).alias("_shift"))  # one row
    return edges.crossJoin(F.broadcast(top)).select("left", (F.col("right") + F.col("_shift")).alias("right"))


def node_list(edges: DataFrame, side: str) -> DataFrame:
    return edges.where(F.col(side).isNotNull()).select(F.col(side).alias("node")).distinct()


def node_lists(edges: DataFrame) -> DataFrame:
    """(side, node) of both sides, nulls dropped."""
    both = edges.select(F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("node")) for s in KEYS))).alias("x")).select("x.*")
    return both.where("node is not null").distinct()


def graph_stats(edges: DataFrame) -> DataFrame:
    """Counts of left nodes, right nodes and edges, counted from one row a node rather than in one distinct set."""
    nodes = node_lists(edges).groupBy().agg(F.count(F.when(F.col("side") == "left", 1)).alias("n_left"), F.count(F.when(F.col("side") == "right", 1)).alias("n_right"))
    return nodes.crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges")))


def node_degrees(edges: DataFrame, side: str) -> DataFrame:
    """(node, degree); repeated edges count."""
    return edges.groupBy(F.col(side).alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def k_core(edges: DataFrame, k: int, max_rounds: int = 100) -> DataFrame:
    """The largest subgraph whose nodes all have ``k`` edges or more (both sides trimmed at once, to a fixpoint)."""
    now, size = stored(edges.where("left is not null and right is not null")), None
    for _ in range(max_rounds):
        left = node_degrees(now, "left").where(F.col("degree") >= k).select(F.col("node").alias("left"))
        right = node_degrees(now, "right").where(F.col("degree") >= k).select(F.col("node").alias("right"))
        before, now = now, stored(now.join(left, "left", "left_semi").join(right, "right", "left_semi").select(*edges.columns))
        free(before)
        if (count := now.count()) == size:
            return now
        size = count
    raise RuntimeError(f"no fixpoint within {max_rounds} rounds")


def adjacency(edges: DataFrame, side: str = "left") -> DataFrame:
    """(node, neighbours): the sorted distinct neighbours of each node of ``side``."""
    other = "right" if side == "left" else "left"
    return edges.groupBy(F.col(side).alias("node")).agg(F.array_sort(F.collect_set(other)).alias("neighbours"))


def union_pairs(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Both with a label 1 or 0."""
    return positives.select(*KEYS, F.lit(1).alias("label")).unionByName(negatives.select(*KEYS, F.lit(0).alias("label")))


def except_pairs(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    return edges.join(chosen.select(*KEYS), KEYS, "left_anti")


def overlap_check(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row ``leaked``: how many rows the inner join of both has; 0 if the split is clean."""
    return train.select(*KEYS).join(test.select(*KEYS), KEYS).agg(F.count(F.lit(1)).alias("leaked"))


def shuffle_pairs(pairs: DataFrame, seed: int) -> DataFrame:
    """``pairs`` with ``position``, their place in a random order."""
    return with_position(pairs.withColumn("_key", hash_key(seed, *KEYS)), "_key", *KEYS).drop("_key")


def symmetrize(edges: DataFrame, a: str = "left", b: str = "right") -> DataFrame:
    """Every edge in both directions, once."""
    return edges.select(a, b).unionByName(edges.select(F.col(b).alias(a), F.col(a).alias(b))).distinct()
