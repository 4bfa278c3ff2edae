"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.storage import free, stored

__all__ = ["fold", "free", "given_back", "hand_small_batches", "let_go", "small_batches", "stored", "table", "tokenizer_path", "unit_hash"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def unit_hash(*cols: Column) -> Column:
    """A reproducible number in (0, 1) from the columns' values."""
    bits = F.shiftrightunsigned(F.xxhash64(*cols), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer file is installed, on the driver and on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Bytes of whole texts that Python is handed at a time at most, but for one longer text.
BATCH_BYTES = 4_000_000
_ROWS, _BYTES = (f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes"))


def hand_small_batches(spark: SparkSession, rows: int, size: int = BATCH_BYTES) -> None:
    """From now on Python is handed at most ``rows`` rows and about ``size`` bytes at a time; never more than the session allows already."""
    for name, most in ((_ROWS, rows), (_BYTES, size)):
        have = int(spark.conf.get(name).rstrip("bB"))
        spark.conf.set(name, str(min(most, have) if have > 0 else most))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """``hand_small_batches`` for the jobs run inside; for whole texts, of which ten thousand may fill a worker."""
    before = {name: spark.conf.get(name, None) for name in (_ROWS, _BYTES)}
    hand_small_batches(spark, rows)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def let_go(spark: SparkSession) -> None:
    """Lets the driver collect its garbage after a turn of a loop of many jobs.

    What Python no longer names keeps its plan, and so its shuffle files, until then; and the JVM's heap grows with the plans of all
    turns instead of one's, and keeps that size for the stages that follow.  Left alone Spark asks for it twice an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


Batch = TypeVar("Batch")


def give_back() -> None:
    """Gives memory that Arrow and the C library hold though nothing uses it back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def given_back(batches: Iterator[Batch]) -> Iterator[Batch]:
    """``batches`` of whole texts; after each, what is freed goes back to the system.

    Spark keeps a Python worker for the tasks and stages that follow, beside other workers and the JVM of the same executor;
    else each keeps the memory of its largest batches.
    """
    for batch in batches:
        yield batch
        del batch
        give_back()
