"""Work on the neighbourhoods of left nodes, done where their lists lie instead of by joins that make a row for each walk.

Left nodes are cut, in order of their ids, into blocks of about FILL steps: the edges of the right nodes that they have or
aim at.  A task holds the left nodes of a block, and of every such right node once the left nodes that have it; what is
counted along walks of two or three steps is counted there, and only results leave.

Left nodes of more than ``most`` steps are not done here but returned, for joins that deal single nodes over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.ranking import with_running_sums
from pairloom.functions.skew import MOST
from pairloom.functions.storage import free, stored
from pairloom.operators.graph import KEYS

#: Steps of a block, and those that a task lays out at once.
FILL, CELLS = 4_000_000, 1_000_000


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, values) of a column of lists without nulls."""
    whole = column.combine_chunks()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    bounds = whole.offsets.to_numpy().astype(np.int64)
    return bounds - bounds[0], whole.values.slice(bounds[0], bounds[-1] - bounds[0]).to_numpy(zero_copy_only=False)


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of every run, one run after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def bounds_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


class Part:
    """Left nodes of a block laid out: ``f`` are the nodes next to their items, ``g`` those next to their targets.

    ``f_at`` and ``g_at`` are the item or target (a place in ``items`` or ``goals`` of the block) that a step goes by,
    ``fp`` and ``gp`` the bounds of the left nodes' steps.
    """

    def __init__(self, b: Block, lo: int, hi: int):
        self.lo, self.n = lo, hi - lo
        for side, at, bounds, places, ptr in (("f", "f_at", "fp", b.items, b.ip), ("g", "g_at", "gp", b.goals, b.gp)):
            of = np.arange(ptr[lo], ptr[hi])
            sizes = b.sizes[places[of]]
            steps = spread(b.lp[places[of]], sizes)
            setattr(self, side, b.near[steps])
            setattr(self, at, np.repeat(of, sizes))
            setattr(self, bounds, bounds_of(sizes)[ptr[lo : hi + 1] - ptr[lo]])
            if side == "f":
                self.weight = None if b.weight is None else b.weight[steps]

    def owners(self, bounds: np.ndarray) -> np.ndarray:
        """The left node, from 0 on in this part, of each step."""
        return np.repeat(np.arange(self.n), np.diff(bounds))


class Block:
    """``left`` with ``items`` and ``goals`` (places in ``right``; bounds ``ip``, ``gp``), ``right`` with ``near`` (places in ``names``; bounds ``lp``)."""

    def __init__(self, table: pa.Table):
        own = table.filter(pc.is_valid(table["left"]))
        lists = table.filter(pc.is_valid(table["right"])).sort_by("right")
        self.left, self.left_value = own["left"].to_numpy(), own["left_value"].to_numpy()
        self.right, self.right_value = lists["right"].to_numpy(), lists["right_value"].to_numpy()
        self.lp, near = _ragged(lists["near"])
        self.sizes = np.diff(self.lp)
        self.names, self.near = np.unique(near, return_inverse=True)
        self.weight = _ragged(lists["weight"])[1] if "weight" in table.column_names else None
        self.ip, items = _ragged(own["items"])
        self.gp, goals = _ragged(own["goals"])
        # in order within each left node: places are in order of the ids
        self.items, self.goals = (self._placed(p, x) for p, x in ((self.ip, items), (self.gp, goals)))
        me = np.minimum(np.searchsorted(self.names, self.left), max(0, len(self.names) - 1))
        self.me = np.where(self.names[me] == self.left, me, -1) if len(self.names) else np.full(len(self.left), -1)

    def _placed(self, bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.right, ids)
        return at[np.lexsort((at, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))))]

    def parts(self) -> Iterator[Part]:
        """All left nodes, as many at a time as have about CELLS steps."""
        steps = np.zeros(len(self.left), dtype=np.int64)
        for ptr, places in ((self.ip, self.items), (self.gp, self.goals)):
            run = bounds_of(self.sizes[places])
            steps += run[ptr[1:]] - run[ptr[:-1]]
        cut = np.cumsum(steps) // CELLS
        ends = [*(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(steps)]
        for lo, hi in zip([0, *ends], ends, strict=False):
            if hi > lo:
                yield Part(self, lo, hi)


Kernel = Callable[[Block], Iterator[dict[str, np.ndarray]]]


def by_blocks(
    e: DataFrame, wanted: DataFrame | None, kernel: Kernel, schema: str, weighted: DataFrame | None = None, left_value: DataFrame | None = None, right_value: DataFrame | None = None, most: int = MOST
) -> tuple[DataFrame, DataFrame | None]:
    """(rows, crowded): what ``kernel`` gives for blocks of the left nodes that have edges in ``e``, and targets in ``wanted`` if given.

    ``e`` and ``wanted`` are distinct.  ``weighted`` has ``_w`` for every edge, ``left_value`` and ``right_value`` a number ``value`` for nodes.
    ``crowded`` (``left``) holds the left nodes left out, or is None.  Rules: nulls meet nothing; targets without edges are no targets; an
    empty table gives no rows.
    """
    spark = e.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kernel_columns = [c.split()[0] for c in schema.split(", ")]
    known = lambda d: d.where("left is not null and right is not null")
    e = known(e)
    degree = e.groupBy("right").agg(F.count(F.lit(1)).alias("_d"))
    ends = e.select(*KEYS, F.lit(True).alias("own"))
    ends = ends if wanted is None else ends.unionByName(known(wanted).select(*KEYS, F.lit(False).alias("own")))
    # lists of single nodes are gathered only where they are short
    long = stored(ends.groupBy("left").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("left"))
    hubs = stored(degree.where(F.col("_d") > most).select("right"))
    crowded, short = None, e if weighted is None else e.join(known(weighted), KEYS)
    if not hubs.isEmpty():
        crowded, short = ends.join(hubs, "right", "left_semi").select("left").unionByName(long).distinct(), short.join(hubs, "right", "left_anti")
    elif not long.isEmpty():
        crowded = long
    ends = ends if crowded is None else ends.join(crowded, "left", "left_anti")
    given = lambda side: F.collect_list(F.when(F.col("own") if side else ~F.col("own"), F.col("right")))
    lefts = ends.join(degree, "right").groupBy("left").agg(given(True).alias("items"), given(False).alias("goals"), F.sum("_d").alias("cost"))
    lefts = lefts.where(F.size("items") > 0) if wanted is None else lefts.where((F.size("items") > 0) & (F.size("goals") > 0))
    no_value = F.lit(0.0).alias("left_value")
    lefts = lefts.withColumn("left_value", no_value) if left_value is None else lefts.join(left_value.select("left", F.col("value").cast("double").alias("left_value")), "left")
    lefts = stored(lefts)
    crowd = lefts.where(F.col("cost") > most).select("left")
    if not crowd.isEmpty():
        crowded = crowd if crowded is None else crowded.unionByName(crowd)
    crowded = crowded if crowded is None else stored(crowded)
    light = lefts.where(F.col("cost") <= most)
    total = light.agg(F.sum("cost")).first()[0] or 0
    fill = max(1, min(FILL, total // (2 * tasks) + 1))
    blocks = total // fill + 1
    run = with_running_sums(light, [F.col("left")], {"_run": "cost"})
    placed = stored(run.select(F.floor((F.col("_run") - 1) / fill).alias("block"), "left", "items", "goals", "left_value"))
    free(lefts)
    needed = placed.select("block", F.explode(F.concat("items", "goals")).alias("right")).distinct()
    lists = short.groupBy("right").agg(F.collect_list("left").alias("near")) if weighted is None else short.groupBy("right").agg(F.collect_list(F.struct("left", "_w")).alias("_l")).select("right", F.col("_l.left").alias("near"), F.col("_l._w").alias("weight"))
    lists = lists.withColumn("right_value", F.lit(0.0)) if right_value is None else lists.join(right_value.select("right", F.col("value").cast("double").alias("right_value")), "right")
    rows = placed.unionByName(needed.join(lists, "right"), allowMissingColumns=True)
    target = spark.createDataFrame([], schema).schema

    def run_block(table: pa.Table) -> pa.Table:
        kinds = {"bigint": pa.int64(), "double": pa.float64()}
        types = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in target.fields])
        found = [pa.table({c: x[c] if isinstance(x[c], pa.Array) else pa.array(x[c]) for c in kernel_columns}).cast(types) for x in kernel(Block(table))]
        return pa.concat_tables(found) if found else types.empty_table()

    return rows.repartition(max(tasks, blocks), "block").groupBy("block").applyInArrow(run_block, schema), crowded


# ---- kernels: counts along the walks of a block


def walk_sums(b: Block) -> Iterator[dict[str, np.ndarray]]:
    """(left, right, value): the sum over walks left - a - b - right of the weight of the step (a, b), or 1."""
    held = np.zeros(len(b.names), dtype=np.int64 if b.weight is None else np.float64)
    for p in b.parts():
        at = np.empty(len(p.g), dtype=held.dtype)
        for i in range(p.n):
            f = p.f[p.fp[i] : p.fp[i + 1]]
            g = slice(p.gp[i], p.gp[i + 1])
            np.add.at(held, f, 1 if p.weight is None else p.weight[p.fp[i] : p.fp[i + 1]])
            at[g] = held[p.g[g]]
            held[f] = 0
        if not len(at):
            continue
        first = np.flatnonzero(np.diff(p.g_at, prepend=-1))
        value, goal = np.add.reduceat(at, first), p.g_at[first]
        some = value > 0
        yield {"left": b.left[np.searchsorted(b.gp, goal[some], "right") - 1], "right": b.right[b.goals[goal[some]]], "value": value[some]}


def _tally(codes: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes and how often each occurs."""
    every = [np.unique(c, return_counts=True) for c in codes]
    if len(every) < 2:
        return every[0] if every else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    names, at = np.unique(np.concatenate([c for c, _ in every]), return_inverse=True)
    return names, np.bincount(at, np.concatenate([n for _, n in every])).astype(np.int64)


def _meetings(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with a[i] = b[j], of the sorted ``b``, about CELLS at a time."""
    lo = np.searchsorted(b, a, "left")
    sizes = np.searchsorted(b, a, "right") - lo
    cut = np.cumsum(sizes) // CELLS
    ends = [*(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(a)]
    for x, y in zip([0, *ends], ends, strict=False):
        if y > x and sizes[x:y].any():
            yield np.repeat(np.arange(x, y), sizes[x:y]), spread(lo[x:y], sizes[x:y])


def _marked(b: Block, p: Part, k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which steps ``f`` go to nodes that share ``k`` items with the left node, and are not itself unless a target has it; which ``g`` do."""
    held = np.zeros(len(b.names), dtype=np.int32)
    aimed = np.zeros(len(b.names), dtype=bool)
    f_in, g_in = np.zeros(len(p.f), dtype=bool), np.zeros(len(p.g), dtype=bool)
    for i in range(p.n):
        fs, gs, me = slice(p.fp[i], p.fp[i + 1]), slice(p.gp[i], p.gp[i + 1]), b.me[p.lo + i]
        f, g = p.f[fs], p.g[gs]
        np.add.at(held, f, 1)
        aimed[g] = True
        if exclude_self and me >= 0:
            held[me] = 0
        f_in[fs] = (held[f] >= k) & (aimed[f] if k == 1 else (f != me) | aimed[f])
        g_in[gs] = held[g] >= k
        held[f], aimed[g] = 0, False
    return f_in, g_in


def singles(exclude_self: bool) -> Kernel:
    """(left, right, s, _c, _n, _du, _dv): of each target and item of the left node how many nodes have both, if any, and how many the item."""

    def count(b: Block) -> Iterator[dict[str, np.ndarray]]:
        for p in b.parts():
            f_in, g_in = _marked(b, p, 1, exclude_self)
            names = len(b.names)
            f_key, f_at = (p.owners(p.fp) * names + p.f)[f_in], p.f_at[f_in]
            g_key, g_at = (p.owners(p.gp) * names + p.g)[g_in], p.g_at[g_in]
            order = np.argsort(g_key, kind="stable")
            g_key, g_at, n = g_key[order], g_at[order], len(b.items)
            codes, c = _tally(g_at[j] * n + f_at[i] for i, j in _meetings(f_key, g_key))
            goal, item = codes // n, b.items[codes % n]
            left = np.searchsorted(b.gp, goal, "right") - 1
            yield {"left": b.left[left], "right": b.right[b.goals[goal]], "s": b.right[item], "_c": c, "_n": b.sizes[item] - int(exclude_self), "_du": b.left_value[left], "_dv": b.right_value[b.goals[goal]]}

    return count


def couples(exclude_self: bool) -> Kernel:
    """As ``singles`` for two items ``s1`` < ``s2``."""

    def count(b: Block) -> Iterator[dict[str, np.ndarray]]:
        for p in b.parts():
            f_in, g_in = _marked(b, p, 2, exclude_self)
            names, wide = len(b.names), int(np.diff(b.ip[p.lo : p.lo + p.n + 1]).max(initial=1))
            owner = p.owners(p.fp)[f_in]
            key, item = owner * names + p.f[f_in], p.f_at[f_in] - b.ip[p.lo + owner]
            order = np.lexsort((item, key))
            key, item, owner = key[order], item[order], owner[order]
            self_ = key == owner * names + b.me[p.lo + owner]
            pair = lambda i, j: (owner[i] * wide + item[i]) * wide + item[j]
            after = np.arange(1, len(key) + 1)
            later = np.searchsorted(key, key, "right") - after  # entries of the same node behind this one

            def pairs(later=later, after=after, size=CELLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                cut = np.cumsum(later) // size
                ends = [*(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(later)]
                for x, y in zip([0, *ends], ends, strict=False):
                    if y > x and later[x:y].any():
                        yield np.repeat(np.arange(x, y), later[x:y]), spread(after[x:y], later[x:y])

            others, n = _tally(pair(i[~self_[i]], j[~self_[i]]) for i, j in pairs())
            g_key, g_at = (p.owners(p.gp) * names + p.g)[g_in], p.g_at[g_in]
            order = np.argsort(g_key, kind="stable")
            g_key, g_at = g_key[order], g_at[order]
            # a target is a place among those of its left node: codes of target and pair stay small
            each = int(np.diff(b.gp[p.lo : p.lo + p.n + 1]).max(initial=1))
            place = g_at - b.gp[np.searchsorted(b.gp, g_at, "right") - 1]
            codes, c = _tally(pair(i[x], j[x]) * each + place[y] for i, j in pairs() for x, y in _meetings(key[i], g_key))
            of, goal = codes // each, codes % each
            left = p.lo + of // (wide * wide)
            s1, s2 = (b.right[b.items[b.ip[left] + s]] for s in (of // wide % wide, of % wide))
            goal = b.goals[b.gp[left] + goal]
            at = np.minimum(np.searchsorted(others, of), max(0, len(others) - 1))
            shared = np.where(others[at] == of, n[at], 0) if len(others) else np.zeros(len(of), dtype=np.int64)
            yield {"left": b.left[left], "right": b.right[goal], "s1": s1, "s2": s2, "_c": c, "_n": shared + int(not exclude_self), "_du": b.left_value[left], "_dv": b.right_value[goal]}

    return count


def shared_items(b: Block) -> Iterator[dict[str, np.ndarray]]:
    """(s1, s2, support): how many of its nodes a left node s1 shares with every s2 of a larger id, if any."""
    for p in b.parts():
        names, owner = len(b.names), p.owners(p.fp)
        larger = p.f > b.me[p.lo + owner]
        codes, n = _tally(iter([owner[larger] * names + p.f[larger]]))
        yield {"s1": b.left[p.lo + codes // max(1, names)], "s2": b.names[codes % max(1, names)], "support": n}
