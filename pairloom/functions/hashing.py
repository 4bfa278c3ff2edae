"""Reproducible random numbers from row values, equal in Spark and in SQL engines with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: int | str, *cols: Column | str) -> Column:
    """A 52-bit integer from md5 of the seed and the columns joined by ``|``."""
    parts = [F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")


def uniform(seed: int | str, *cols: Column | str) -> Column:
    """A number in (0, 1)."""
    return (hash_key(seed, *cols) + F.lit(0.5)) / F.lit(float(1 << 52))
