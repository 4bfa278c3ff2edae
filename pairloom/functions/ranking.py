"""Global positions and prefix sums without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.storage import stored


def _names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def _ranged(df: DataFrame, order: list[str | Column], at: str, part: str, low: str) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    return stored(placed).withColumns({part: F.shiftright(at, 33), low: F.col(at).bitwiseAND((1 << 33) - 1)})


def with_position(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """``df`` with its 0-based position in ``order``, which should be total.

    One range sort; then only the row count of each partition is summed in order.
    """
    at, part, low, ahead = _names(df, "_at", "_part", "_low", "_before")
    placed = _ranged(df, list(order), at, part, low)
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(part, before.alias(ahead))  # a row a partition
    return placed.join(F.broadcast(offsets), part).withColumn(name, F.col(ahead) + F.col(low)).drop(part, ahead, low, at)


def with_running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with, for each ``new: column`` of ``sums``, the sum of the column up to and including the row."""
    at, part, low = _names(df, "_at", "_part", "_low")
    base = dict(zip(sums, _names(df, *(f"_b_{n}" for n in sums)), strict=True))
    placed = _ranged(df, order, at, part, low)
    totals = placed.groupBy(part).agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    ahead = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(part, *(F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(b) for n, b in base.items()))
    inside = W.partitionBy(part).orderBy(low)
    out = placed.join(F.broadcast(offsets), part)
    out = out.withColumns({n: F.sum(c).over(inside) + F.col(base[n]) for n, c in sums.items()})
    return out.drop(part, low, at, *base.values())


#: Up to so many rows a top-n is one bounded heap a task; beyond it is cut from a range sort.
HEAP_ROWS = 100_000


def lowest(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows in ``order``, which should be total; never gathers more than HEAP_ROWS rows in a task."""
    if n <= HEAP_ROWS:
        return df.orderBy(*order).limit(n)
    return with_position(df, *order, name="_pos").where(F.col("_pos") < n).drop("_pos")
