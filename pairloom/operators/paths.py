"""Path-based link scores: three-step walks, Katz, graph distance, degree-normalised paths of length three.

All take an optional ``pairs`` (left, right): then only these are scored, and
the pairs are pushed into the walk, from both ends, instead of filtering all pairs at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.skew import MOST, dealt_join
from pairloom.functions.storage import free, stored
from pairloom.operators.components import bipartite_components
from pairloom.operators.graph import KEYS, except_pairs
from pairloom.operators.neighbourhoods import by_blocks, walk_sums


def _walks3(e: DataFrame, pairs: DataFrame | None, weighted: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """(left, right, value): the sum over walks left - a - b - right of the weight of the step (a, b), 1 by default.

    With ``pairs``, blocks of left nodes sum the walks of theirs.  Nodes of more than ``most`` rows in a join are dealt over tasks.
    """
    if pairs is None:
        ab = _weighed(e, weighted)
        two = stored(dealt_join(e.toDF("left", "a"), ab, "a", most).groupBy("left", "b").agg(F.sum("_w").alias("_v")))
        return dealt_join(two, e.toDF("b", "right"), "b", most).groupBy(*KEYS).agg(F.sum("_v").alias("value"))
    wanted = pairs.select(*KEYS).distinct()
    out, crowded = by_blocks(e, wanted, walk_sums, f"left long, right long, value {'long' if weighted is None else 'double'}", weighted=weighted, most=most)
    return out if crowded is None else out.unionByName(_dealt_walks3(e, wanted.join(crowded, "left", "left_semi"), weighted, most))


def _weighed(e: DataFrame, weighted: DataFrame | None) -> DataFrame:
    return (e.withColumn("_w", F.lit(1)) if weighted is None else weighted).select(F.col("right").alias("a"), F.col("left").alias("b"), "_w")


def _dealt_walks3(e: DataFrame, pairs: DataFrame, weighted: DataFrame | None, most: int) -> DataFrame:
    """``_walks3`` of ``pairs`` by joins; the last two have one row of a key on one side."""
    ends = stored(dealt_join(pairs, e.toDF("b", "right"), "right", most).select(*KEYS, "b"))
    needed = ends.select("left", "b").distinct()
    two = dealt_join(needed, e.toDF("left", "a"), "left", most).join(_weighed(e, weighted), ["a", "b"]).groupBy("left", "b").agg(F.sum("_w").alias("_v"))
    return ends.join(two, ["left", "b"]).groupBy(*KEYS).agg(F.sum("_v").alias("value"))


def path3_count(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(left, right, paths): walks of three steps; pairs without one are absent."""
    return _walks3(edges.select(*KEYS).distinct(), pairs).select(*KEYS, F.col("value").cast("long").alias("paths"))


def katz(edges: DataFrame, max_len: int = 5, beta: float = 0.05, pairs: DataFrame | None = None) -> DataFrame:
    """(left, right, score): the sum over odd l <= max_len of beta^l times the walks of length l; edges keep their score.

    Only odd walks cross between the sides.  With ``pairs``, walks from 5 on are counted from both ends, which meet at a left node:
    2i steps from the left end, 2j + 1 from the right one, i - j being 0 or 1.  Without, walks of length l + 2 extend those of
    length l by a step back and a step forth, each grouped before the next.
    """
    e = edges.select(*KEYS).distinct()
    wanted = None if pairs is None else pairs.select(*KEYS).distinct()
    within = (lambda d: d) if wanted is None else lambda d: d.join(wanted, KEYS, "left_semi")
    parts = [within(e).select(*KEYS, F.lit(float(beta)).alias("term"))]
    if max_len >= 3:
        parts.append(_walks3(e, wanted).select(*KEYS, (F.col("value") * beta**3).alias("term")))
    if max_len >= 5 and wanted is not None:
        parts += [w.select(*KEYS, (F.col("value") * beta**length).alias("term")) for length, w in _meeting_walks(stored(e), stored(wanted), max_len)]
    walks = None
    for length in range(5, max_len + 1, 2) if wanted is None else ():
        walks = walks if walks is not None else _walks3_from(e, e)
        walks = stored(_extend(walks, e))
        parts.append(walks.select(*KEYS, (F.col("value") * beta**length).alias("term")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*KEYS).agg(F.sum("term").alias("score"))


def _meeting_walks(e: DataFrame, wanted: DataFrame, max_len: int) -> Iterator[tuple[int, DataFrame]]:
    """(length, (left, right, value)) for the lengths from 5 on: walks of ``wanted`` pairs, without a table of all pairs of their ends."""
    step = lambda d, end: d.join(e.toDF("b", "item"), "b").groupBy(end, "item").agg(F.sum("value").alias("value")).join(e.toDF("b", "item"), "item").groupBy(end, "b").agg(F.sum("value").alias("value"))
    one = F.lit(1).cast("long").alias("value")
    ahead = stored(step(wanted.select("left", F.col("left").alias("b"), one).distinct(), "left"))
    behind = wanted.select("right").distinct().join(e.toDF("b", "right"), "right").select("right", "b", one)
    for length in range(5, max_len + 1, 2):
        if length % 4 == 1:
            behind = stored(step(behind, "right"))
        else:
            ahead = stored(step(ahead, "left"))
        met = wanted.join(ahead.withColumnRenamed("value", "_f"), "left").join(behind, ["right", "b"])
        yield length, met.groupBy(*KEYS).agg(F.sum(F.col("_f") * F.col("value")).alias("value"))


def _walks3_from(start: DataFrame, e: DataFrame) -> DataFrame:
    return _extend(start.select(*KEYS, F.lit(1).cast("long").alias("value")), e)


def _extend(walks: DataFrame, e: DataFrame) -> DataFrame:
    back = walks.join(e.toDF("b", "right"), "right").groupBy("left", "b").agg(F.sum("value").alias("value"))
    return back.join(e.toDF("b", "right"), "b").groupBy("left", "right").agg(F.sum("value").alias("value"))


def graph_distance(edges: DataFrame, max_dist: int = 3, exclude_existing: bool = True, normalize: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """(left, right, score): 1 / distance of left and right nodes at an odd distance of at most ``max_dist``.

    With ``pairs``, only pairs not solved yet go on, the last by walks from both ends that meet in the middle.  Without,
    a level-by-level walk from all left nodes, of each level only new pairs.
    ``normalize`` scales scores to 0..1.  Rules: repeated edges and pairs count once; null nodes meet nothing.
    """
    e = edges.select(*KEYS).distinct()
    out = _distances(e, max_dist) if pairs is None else _pair_distances(stored(e), stored(pairs.select(*KEYS).distinct()), max_dist)
    out = out.select(*KEYS, (1.0 / F.col("dist")).alias("score"))
    out = except_pairs(out, e) if exclude_existing else out
    if normalize:
        ends = out.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
        out = out.crossJoin(F.broadcast(ends)).withColumn("score", F.when(F.col("_hi") > F.col("_lo"), (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.col("score"))).drop("_lo", "_hi")
    return out


def _pair_distances(e: DataFrame, wanted: DataFrame, max_dist: int) -> DataFrame:
    """(left, right, dist) of the ``wanted`` pairs.

    Three steps are counted in blocks of left nodes.  Beyond, pairs of different components are dropped, and pairs are tried for
    five steps by single ways on from their right end (``_tried``), of which most pairs at that distance have many.  Only for the
    others ``ahead`` holds the left nodes within so many double steps of a pair's left end, ``behind`` those next to its right end or so
    many double steps before it; in turn one of them takes a step.
    """
    solved = wanted.join(e, KEYS, "left_semi").withColumn("dist", F.lit(1))
    open_ = stored(wanted.join(e, KEYS, "left_anti"))
    old: list[DataFrame] = []

    def solve(hit: DataFrame, dist: int) -> None:
        nonlocal solved, open_
        hit = stored(hit)
        solved = solved.unionByName(hit.withColumn("dist", F.lit(dist)))
        old.append(open_)
        open_ = stored(open_.join(hit, KEYS, "left_anti"))

    if max_dist >= 3:
        solve(_walks3(e, open_).select(*KEYS), 3)
    if max_dist >= 5 and not open_.isEmpty():
        left, right = bipartite_components(e)
        old.append(open_)
        open_ = stored(open_.join(left, "left").join(right, ["right", "component"]).select(*KEYS))
        for ways in WAYS:
            if open_.isEmpty():
                break
            solve(_tried(e, open_, ways), 5)
    far = max_dist >= 5 and not open_.isEmpty()
    ahead = open_.select("left", F.col("left").alias("b")).distinct()
    behind = open_.select("right").distinct().join(e.toDF("b", "right"), "right")
    for dist in range(3, max_dist + 1, 2) if far else ():
        step = lambda d, end: d.join(open_.select(end).distinct(), end, "left_semi").join(e.toDF("b", "item"), "b").select(end, "item").distinct().join(e.toDF("b", "item"), "item").select(end, "b").distinct()
        if dist % 4 == 3:
            ahead = stored(step(ahead, "left"))
        else:
            behind = stored(step(behind, "right"))
        if dist > 3:
            solve(open_.join(behind, "right").join(ahead, ["left", "b"], "left_semi").select(*KEYS).distinct(), dist)
    free(*old)
    return solved


#: Ways on from a right node that pairs are tried by, in two turns.
WAYS = (4, 32)


def _tried(e: DataFrame, open_: DataFrame, ways: int) -> DataFrame:
    """Pairs of ``open_``, at a distance of five or more, that are found at five by at most ``ways`` ways of two steps from their right ends.

    A way ends at a right node; the pair is at five steps if that is at three.  The ways are those of the lowest hashes; pairs not found may be at five still.
    """
    first = lambda d, key, other, name: d.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64(key, other).alias("h"), F.col(other).alias("x")))), 1, ways).alias(name))
    near = first(e.join(open_.select("right").distinct(), "right", "left_semi"), "right", "left", "near").select("right", F.explode("near.x").alias("b"))
    far = first(e.select(F.col("left").alias("b"), F.col("right").alias("c")), "b", "c", "far").select("b", F.slice("far.x", 1, 2).alias("far"))
    on = near.join(far, "b").select("right", F.explode("far").alias("c")).where("c <> right").distinct()
    on = stored(first(on, "right", "c", "on").select("right", F.col("on.x").alias("on")))
    tries = stored(open_.join(on, "right").select(*KEYS, F.explode("on").alias("c")))
    reached = _walks3(e, tries.select("left", F.col("c").alias("right"))).select("left", F.col("right").alias("c"))
    return tries.join(reached, ["left", "c"], "left_semi").select(*KEYS).distinct()


def _distances(e: DataFrame, max_dist: int) -> DataFrame:
    """(left, right, dist) of all pairs."""
    lefts = e.select("left").distinct()
    seen_right = front = stored(e.withColumn("dist", F.lit(1)))
    seen_left = lefts.select(F.col("left"), F.col("left").alias("b"))
    for dist in range(3, max_dist + 1, 2):
        back = front.select(*KEYS).join(e.toDF("b", "right"), "right").select("left", "b").distinct()
        new_left = stored(back.join(seen_left, ["left", "b"], "left_anti"))
        seen_left = seen_left.unionByName(new_left)
        reached = new_left.join(e.toDF("b", "right"), "b").select(*KEYS).distinct()
        front = stored(reached.join(seen_right, KEYS, "left_anti").withColumn("dist", F.lit(dist)))
        seen_right = seen_right.unionByName(front)
    return seen_right


def l3(edges: DataFrame, pairs: DataFrame | None = None, degree_rule: str = "doubled", weight: str | None = None) -> DataFrame:
    """(left, right, score) of non-adjacent pairs: the sum over left - a - b - right of 1 / sqrt(k_a k_b).

    ``degree_rule``: ``doubled`` counts every right degree twice (the end of the larger id of
    each edge counts twice where right ids follow left ids), ``published`` once.  With a column ``weight`` a degree is the sum
    of its edges' absolute weights; steps still count alike.  Rules: of a repeated edge the largest weight counts, a null or zero weight is no edge.
    """
    size = F.lit(1.0) if weight is None else F.abs(F.col(weight).cast("double"))
    sized = edges.select(*KEYS, size.alias("_size")).where("_size > 0").groupBy(*KEYS).agg(F.max("_size").alias("_size"))
    e = sized.select(*KEYS)
    factor = 2.0 if degree_rule == "doubled" else 1.0
    ka = sized.groupBy("right").agg((F.sum("_size") * factor).alias("_ka"))
    kb = sized.groupBy("left").agg(F.sum("_size").alias("_kb"))
    weighted = e.join(ka, "right").join(kb, "left").select(*KEYS, (1.0 / F.sqrt(F.col("_ka") * F.col("_kb"))).alias("_w"))
    score = _walks3(e, pairs, weighted).withColumnRenamed("value", "score")
    return except_pairs(score, e)


def rank_predictions(pred: DataFrame, top_k: int | None = None, score: str = "score") -> DataFrame:
    """By score, best first; with ``top_k`` each left node's best with their ``rank`` (no global sort)."""
    if top_k is None:
        return pred.orderBy(F.desc(score), *KEYS)
    place = F.row_number().over(W.partitionBy("left").orderBy(F.desc(score), "right"))
    return pred.withColumn("rank", place).where(F.col("rank") <= top_k)
