"""Joins and ranks that no single task does alone where one key holds many rows.

Keys of more than ``MOST`` rows are found by a count (summed within tasks first).  Their rows are dealt over cells, all others take
Spark's plain join or window.  Only work is dealt: the rows are the same either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.ranking import _names, _ranged, lowest
from pairloom.functions.storage import free, stored

#: Rows of a key beyond which it is dealt, and the number of such keys (the largest ones) that are broadcast.
MOST, HOT_KEYS = 1_000_000, 100_000


def _hot(sizes: DataFrame, size: str, key: str) -> DataFrame | None:
    """The largest HOT_KEYS of a table of large keys, stored; None if there are none."""
    found = stored(sizes)
    n = found.count()
    if n > HOT_KEYS:
        return stored(lowest(found, HOT_KEYS, F.desc(size), key))
    if not n:
        free(found)
        return None
    return found


def dealt(a: DataFrame, b: DataFrame, hot: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides at ``hot`` keys (``on``, ``_pa``, ``_pb``), with the cells ``_i``, ``_j`` of a grid of _pa x _pb.

    A row of ``a`` is dealt to one row of its key's grid and repeated along it, a row of ``b`` to one column.
    """
    small = F.broadcast(hot)
    across = lambda p: F.explode(F.sequence(F.lit(0), F.col(p) - 1))
    pick = lambda d, p: F.pmod(F.xxhash64(*d.columns), F.col(p)).cast("int")
    rows = a.join(small, on).select(*a.columns, pick(a, "_pa").alias("_i"), across("_pb").alias("_j"))
    columns = b.join(small, on).select(*b.columns, pick(b, "_pb").alias("_j"), across("_pa").alias("_i"))
    return rows, columns


def dealt_join(a: DataFrame, b: DataFrame, on: str, most: int = MOST) -> DataFrame:
    """The inner join of ``a`` and ``b`` on the column ``on``; a key's rows beyond ``most`` are dealt over cells of about as many.

    Rules: null keys meet nothing; repeated rows count as often as they occur but share a cell; an empty table gives no rows.
    """
    sizes = None
    for d, name in ((a, "_na"), (b, "_nb")):
        n = d.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
        n = n.select(on, *((F.col("_n") if name == m else F.lit(1).cast("long")).alias(m) for m in ("_na", "_nb")))
        sizes = n if sizes is None else sizes.unionByName(n)
    parts = lambda c: F.ceil(F.max(c) / most).cast("int")
    grids = sizes.where(F.col(on).isNotNull()).groupBy(on).agg(parts("_na").alias("_pa"), parts("_nb").alias("_pb"))
    hot = _hot(grids.withColumn("_cells", F.col("_pa").cast("long") * F.col("_pb")), "_cells", on)
    if hot is None:
        return a.join(b, on)
    hot = hot.drop("_cells")
    rows, columns = dealt(a, b, hot, on)
    rest = a.join(F.broadcast(hot.select(on)), on, "left_anti").join(b, on)
    return rest.unionByName(rows.join(columns, [on, "_i", "_j"]).drop("_i", "_j"))


def with_rank(df: DataFrame, key: str, *order, rank: str, size: str | None = None, most: int = MOST) -> DataFrame:
    """``df`` with the 1-based ``rank`` of each row within its ``key`` in ``order``, which should be total, and the key's ``size``.

    Keys of more than ``most`` rows are ranked by one range sort on key and order: a key that lies in several ranges adds
    the rows ahead of each.  Rules: null is a key of its own; an empty table gives no rows; columns named as the new ones are replaced.
    """
    df = df.drop(rank, *([size] if size else []))
    (name,) = _names(df, "_key")
    sizes = df.groupBy(F.col(key).alias(name)).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    hot = _hot(sizes, "_n", name)
    inside = W.partitionBy(key)
    light = df if hot is None else df.join(F.broadcast(hot.select(name)), F.col(key).eqNullSafe(F.col(name)), "left_anti")
    out = light.withColumn(rank, F.row_number().over(inside.orderBy(*order)).cast("long"))
    out = out.withColumn(size, F.count(F.lit(1)).over(inside)) if size else out
    if hot is None:
        return out
    at, part, low, ahead, whole, piece = _names(df, "_at", "_part", "_low", "_ahead", "_whole", "_piece")
    placed = _ranged(df.join(F.broadcast(hot.select(name)), F.col(key).eqNullSafe(F.col(name)), "left_semi"), [key, *order], at, part, low)
    pieces = placed.groupBy(F.col(key).alias(name), F.col(part).alias(piece)).agg(F.count(F.lit(1)).alias("_n"))
    by_key = W.partitionBy(name)
    before = F.coalesce(F.sum("_n").over(by_key.orderBy(piece).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a range meets others' keys at its two ends only: a row a hot key and two a range
    pieces = pieces.select(name, piece, before.alias(ahead), F.sum("_n").over(by_key).alias(whole))
    dealt_rows = placed.join(F.broadcast(pieces), F.col(key).eqNullSafe(F.col(name)) & (F.col(part) == F.col(piece)))
    dealt_rows = dealt_rows.withColumn(rank, F.row_number().over(W.partitionBy(part, key).orderBy(low)) + F.col(ahead))
    dealt_rows = dealt_rows.withColumn(size, F.col(whole)) if size else dealt_rows
    return out.unionByName(dealt_rows.select(*out.columns))
