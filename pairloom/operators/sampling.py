"""Node sampling, holdouts, folds and non-edge sampling.

All choices follow a hash of the row and a seed, so reruns agree.

Rules: equal hashes go by the row's own values; an empty table gives no rows; null nodes are no nodes and are
not drawn; repeated edges count in degrees and holdouts as often as they occur.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.hashing import hash_key, uniform
from pairloom.functions.ranking import HEAP_ROWS, _names, lowest, with_position
from pairloom.functions.skew import MOST, with_rank
from pairloom.functions.storage import free, stored
from pairloom.operators.graph import KEYS, except_pairs, node_degrees, node_list


def _induced(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    return edges.join(left.select(F.col("node").alias("left")), "left", "left_semi").join(right.select(F.col("node").alias("right")), "right", "left_semi").select(*KEYS)


def sample_random_nodes(edges: DataFrame, max_edges: int, seed: int) -> DataFrame:
    """Edges among uniformly chosen nodes of both sides, each side cut by sqrt(max_edges / edges); all edges if few enough."""
    if (n := edges.count()) <= max_edges:
        return edges
    r = math.sqrt(max_edges / n)
    sides = []
    for side in KEYS:
        nodes = node_list(edges, side)
        sides.append(lowest(nodes, int(nodes.count() * r), hash_key(seed, F.lit(side), "node"), "node"))
    return _induced(edges, *sides)


def sample_degree_nodes(edges: DataFrame, max_edges: int, seed: int) -> DataFrame:
    """As ``sample_random_nodes``, but nodes are drawn one after another in proportion to their degrees.

    The nodes of the lowest -ln(U) / degree are just such a sample.
    """
    if (n := edges.count()) <= max_edges:
        return edges
    r = math.sqrt(max_edges / n)
    sides = []
    for side in KEYS:
        nodes = node_degrees(edges, side)
        sides.append(lowest(nodes, int(nodes.count() * r), -F.log(uniform(seed, F.lit(side), "node")) / F.col("degree"), "node"))
    return _induced(edges, *sides)


def burn_forest(edges: DataFrame, max_nodes: int, p: float, seed: int, max_levels: int = 10_000) -> DataFrame:
    """(side, node, level, from_side, from_node): nodes burned by fires that start at random nodes and spread level by level.

    A burning node lights Geometric(1 - p) >= 1 of its unburned neighbours, in hash order; of several that light a node
    the one with the lowest hash claims it.  When all fires are out, as many new ones start at once as should fill the
    budget if each burns as many nodes as those of the last turn did on average (the first turn has one); they are the
    starts and have no ``from``.  Exactly min(max_nodes, all nodes) burn: the last level is cut in hash order.  Both sides
    burn: a node is (side, id).  Nulls are no nodes; repeated edges are one; an empty table burns nothing.
    """
    spark = edges.sparkSession
    known = edges.where("left is not null and right is not null").select(*KEYS).distinct()
    one = known.select(F.lit("left").alias("side"), F.col("left").alias("node"), F.lit("right").alias("to_side"), F.col("right").alias("to"))
    both = stored(one.unionByName(known.select(F.lit("right").alias("side"), F.col("right").alias("node"), F.lit("left").alias("to_side"), F.col("left").alias("to"))))
    order = stored(both.select("side", "node").distinct().withColumn("start", hash_key(seed, "side", "node")))
    goal = min(max_nodes, order.count())
    burned = spark.createDataFrame([], "side string, node long, level int, from_side string, from_node long")
    # no draw is longer, so each task keeps that many neighbours of a node at most before rows move
    longest = math.floor(math.log(0.5 / (1 << 52)) / math.log(p)) + 1
    front, fresh_count, count, starts, since = None, 0, 0, 1, 0
    for level in range(max_levels):
        room = goal - count
        if room <= 0:
            break
        if not fresh_count:
            starts, since = (1, 0) if front is None else (min(room, -(-room * starts // since)), 0)
            lit = lowest(order.join(burned, ["side", "node"], "left_anti"), starts, "start", "side", "node")
            lit = lit.select("side", "node", F.lit(None).cast("string").alias("from_side"), F.lit(None).cast("long").alias("from_node"))
        else:
            want = F.floor(F.log(uniform(seed, F.lit(f"g{level}"), "side", "node")) / F.lit(math.log(p))) + 1
            fresh = both.join(front.select("side", "node"), ["side", "node"]).join(burned.select(F.col("side").alias("to_side"), F.col("node").alias("to")), ["to_side", "to"], "left_anti")
            place = F.row_number().over(W.partitionBy("side", "node").orderBy(hash_key(seed, F.lit(f"n{level}"), "to_side", "to"), "to"))
            taken = fresh.withColumn("place", place).where(F.col("place") <= longest).where(F.col("place") <= want)
            claim = F.min(F.struct(hash_key(seed, F.lit(f"c{level}"), "side", "node", "to_side", "to").alias("key"), "side", "node")).alias("by")
            lit = taken.groupBy("to_side", "to").agg(claim).select(F.col("to_side").alias("side"), F.col("to").alias("node"), F.col("by.side").alias("from_side"), F.col("by.node").alias("from_node"))
            lit = lowest(lit, room, hash_key(seed, F.lit("b"), "side", "node"), "side", "node")
        before, front = (front, burned), stored(lit.select("side", "node", F.lit(level).alias("level"), "from_side", "from_node"))
        burned = stored(burned.unionByName(front))
        free(*before)
        fresh_count = front.count()
        count, since = count + fresh_count, since + fresh_count
    else:
        raise RuntimeError(f"fewer than {goal} nodes burned within {max_levels} levels")
    free(both, order, front)
    return burned


def sample_forest_fire(edges: DataFrame, max_edges: int, p: float, seed: int, max_levels: int = 10_000) -> DataFrame:
    """Edges among the nodes of ``burn_forest``; all edges if few enough.

    The budget counts burned nodes; if the edges among them are still too many, a uniform sample of them is kept.
    """
    if edges.count() <= max_edges:
        return edges
    burned = burn_forest(edges, max_edges, p, seed, max_levels)
    kept = _induced(edges, burned.where("side = 'left'"), burned.where("side = 'right'"))
    return lowest(kept, max_edges, hash_key(seed, *KEYS), *KEYS)


def sample_for_budget(edges: DataFrame, method: str, seed: int, threshold: int = 50_000, budget: int = 25_000) -> DataFrame:
    """Above ``threshold`` edges a sample by ``random``, ``degree`` or ``fire``; any other name means random to the threshold."""
    if edges.count() <= threshold:
        return edges
    name = method.lower().strip()
    if name == "degree":
        return sample_degree_nodes(edges, budget, seed)
    if name == "fire":
        return sample_forest_fire(edges, budget, 0.7, seed)
    return sample_random_nodes(edges, budget if name == "random" else threshold, seed)


def holdout_per_left(edges: DataFrame, frac: float = 0.2, seed: int = 0, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(train, test): of every left node round(frac * n) edges go to test; nodes of more than ``most`` edges are ranked by many tasks."""
    place, size, test = _names(edges, "_place", "_size", "_test")
    placed = with_rank(edges, "left", hash_key(seed, *KEYS), "right", rank=place, size=size, most=most)
    marked = placed.withColumn(test, F.col(place) <= F.floor(F.col(size) * F.lit(frac) + 0.5)).drop(place, size)
    return marked.where(~F.col(test)).drop(test), marked.where(F.col(test)).drop(test)


def kfold_blocks(log: DataFrame, k: int, *order: str) -> DataFrame:
    """``log`` with ``fold`` 1..k: k contiguous blocks of equal size in ``order`` (the last takes the rest)."""
    size = log.count() // k
    placed = with_position(log, *order, name="_pos")
    fold = F.least(F.lit(k), F.floor(F.col("_pos") / F.lit(max(1, size))) + 1)
    return placed.withColumn("fold", fold.cast("int")).drop("_pos")


def allbut(log: DataFrame, user: str, order: list[str], start: int, stop: int, max_test: int = 0, most: int = MOST) -> DataFrame:
    """``log`` with ``is_test``: rows whose ordinal within their user lies in start..stop, at most ``max_test`` of them in ``order`` if positive.

    Users of more than ``most`` rows are ranked by many tasks.
    """
    (ordinal,) = _names(log, "_ordinal")
    marked = with_rank(log, user, *order, rank=ordinal, most=most).withColumn("is_test", F.col(ordinal).between(start, stop)).drop(ordinal)
    if max_test <= 0:
        return marked
    tests = with_position(marked.where("is_test"), *order, name="_pos").withColumn("is_test", F.col("_pos") < max_test).drop("_pos")
    return tests.unionByName(marked.where("not is_test"))


def _draws(n: int, cells: int, possible: int) -> int:
    """How many draws from ``cells`` pairs, all alike, should give ``n`` of the ``possible`` ones, with six deviations to spare; at most 2 n + 100."""
    if 2 * n >= possible:
        return 2 * n + 100
    draws = -cells * math.log1p(-n / possible)
    return min(2 * n, math.ceil(draws + 6 * math.sqrt(draws))) + 100


def _drawn(edges: DataFrame, lefts: DataFrame, rights: DataFrame, n_left: int, n_right: int, n: int, seed: int, possible: int, draws: int) -> DataFrame:
    """The first ``n`` distinct non-edges in draw order; draws index (pos, left) and (pos, right), ``draws`` of them at first."""
    if n > possible:
        raise ValueError(f"{n} non-edges asked for; at most {possible} exist")
    spark = edges.sparkSession
    for _ in range(12):
        ids = spark.range(draws).select("id", F.pmod(hash_key(seed, F.lit("L"), "id"), F.lit(n_left)).alias("li"), F.pmod(hash_key(seed, F.lit("R"), "id"), F.lit(n_right)).alias("ri"))
        pairs = ids.join(lefts, F.col("li") == lefts["pos"]).select("id", "left", "ri").join(rights, F.col("ri") == rights["pos"]).select("id", *KEYS)
        found = except_pairs(pairs, edges).groupBy(*KEYS).agg(F.min("id").alias("draw"))
        got = stored(found)
        if (extra := got.count() - n) >= 0:
            if not extra:
                return got.select(*KEYS)
            if extra > HEAP_ROWS:
                return stored(lowest(got, n, "draw")).select(*KEYS)
            last = got.select("draw").orderBy(F.desc("draw")).limit(extra).agg(F.min("draw")).first()[0]  # one row
            return got.where(F.col("draw") < last).select(*KEYS)
        free(got)
        draws *= 4
    raise RuntimeError("non-edges are too rare to be drawn")


def _non_edges(edges: DataFrame) -> int:
    return node_list(edges, "left").count() * node_list(edges, "right").count() - edges.select(*KEYS).distinct().count()


def sample_negatives_uniform(edges: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` distinct non-edges, both ends uniform over the nodes."""
    sides = [stored(with_position(node_list(edges, s), "node", name="pos").withColumnRenamed("node", s)) for s in KEYS]
    n_left, n_right, possible = sides[0].count(), sides[1].count(), _non_edges(edges)
    return _drawn(edges, sides[0], sides[1], n_left, n_right, n, seed, possible, _draws(n, n_left * n_right, possible))


def sample_negatives_by_degree(edges: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` distinct non-edges, both ends in proportion to their degrees."""
    placed = stored(with_position(edges.select(*KEYS), *KEYS, name="pos"))
    m = placed.count()
    return _drawn(edges, placed.select("pos", "left"), placed.select("pos", "right"), m, m, n, seed, _non_edges(edges), 2 * n + 100)


def sample_negatives_up_to(edges: DataFrame, n: int, seed: int, by_degree: bool = False) -> DataFrame:
    """``n`` distinct non-edges, uniform or by degree, or all if fewer exist.

    Where ``n`` is over half of all, draws would repeat too often: all are listed, fewer than 2 * n, and those of the lowest hashes kept.
    """
    possible = _non_edges(edges)
    if 2 * n <= possible:
        return (sample_negatives_by_degree if by_degree else sample_negatives_uniform)(edges, n, seed)
    every = except_pairs(node_list(edges, "left").toDF("left").crossJoin(node_list(edges, "right").toDF("right")), edges)
    if by_degree and n < possible:  # the lowest -ln(U) / weight are a sample drawn one after another by weight
        for side in KEYS:
            every = every.join(node_degrees(edges, side).select(F.col("node").alias(side), F.col("degree").alias(f"_{side}")), side)
        return lowest(every.withColumn("_key", -F.log(uniform(seed, *KEYS)) / (F.col("_left") * F.col("_right"))), n, "_key", *KEYS).select(*KEYS)
    return every.select(*KEYS) if n >= possible else lowest(every, n, hash_key(seed, *KEYS), *KEYS)


def build_eval_pairs(targets: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """(left, right, label): distinct targets outside train, 1 if in test."""
    left = except_pairs(targets.select(*KEYS).distinct(), train)
    return left.join(test.select(*KEYS, F.lit(1).alias("label")).distinct(), KEYS, "left").withColumn("label", F.coalesce("label", F.lit(0)))


def assign_splits(targets: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """Distinct targets with ``split``: train_pos, test_pos or negative; a pair in both train and test is train_pos."""
    tags = train.select(*KEYS, F.lit("train_pos").alias("split")).unionByName(test.select(*KEYS, F.lit("test_pos").alias("split")))
    tags = tags.groupBy(*KEYS).agg(F.max("split").alias("split"))
    return targets.select(*KEYS).distinct().join(tags, KEYS, "left").withColumn("split", F.coalesce("split", F.lit("negative")))


def split_train_test_negatives(splits: DataFrame, ratio: int = 10, seed: int = 0) -> DataFrame:
    """Splits with ``part`` (train or test) and ``label``: ``ratio`` negatives for every train positive train, the others test.

    The cut is one number, the key of the last negative taken, found by a bounded sort of keys.
    """
    keyed = splits.withColumn("_key", hash_key(seed, *KEYS))
    want = ratio * splits.where("split = 'train_pos'").count()
    cut = lowest(keyed.where("split = 'negative'").select("_key"), want, "_key").agg(F.coalesce(F.max("_key"), F.lit(-1)).alias("_cut"))
    part = F.when((F.col("split") == "train_pos") | ((F.col("split") == "negative") & (F.col("_key") <= F.col("_cut"))), "train").otherwise("test")
    return keyed.crossJoin(F.broadcast(cut)).withColumn("part", part).withColumn("label", (F.col("split") != "negative").cast("int")).drop("_key", "_cut")


def sample_ratio(scored: DataFrame, ratio: int, seed: int) -> DataFrame:
    """All positives and min(ratio * positives, negatives) negatives of rows (left, right, label, ...)."""
    n = {r.label: r["count"] for r in scored.groupBy("label").count().collect()}  # two rows
    want, negatives = ratio * n.get(1, 0), scored.where("label = 0")
    if want < n.get(0, 0):
        negatives = lowest(negatives, want, hash_key(seed, F.lit(ratio), *KEYS), *KEYS)
    return scored.where("label = 1").unionByName(negatives)
