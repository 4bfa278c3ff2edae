"""Sharding in Hilbert-curve order.

Three metadata dimensions (source, language, text size) are quantised to
``bits`` bits each, a document's cell is numbered along the Hilbert curve, and
the documents sorted by (curve index, checksums of the text, id) are cut into
``shards`` runs whose row counts differ by one at most (the law ``rows``).
All documents of a text take the curve index of the one with the smallest id,
so equal texts lie side by side whatever their source or language; a group of
them is cut only where a shard ends.  Neighbouring documents share their
metadata, so the minima and maxima of a shard's columns let readers skip files
in every one of the dimensions.

Global positions come from range sorts: each sorted partition counts its
rows, and only those counts (one a partition) are summed in order.  A text's
documents may fill many ranges: each range finds its first one, and the first
range's holds for the others, so no task gathers a group.

Rules: a null text has size 1 and the checksum of the empty text; null and
unknown source or language sort first; a null id is the smallest; repeated
rows get slots of their own; documents of equal text and id go by source and
language;
an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.ranking import _ranged, with_position
from pairloom.llm.common import free, stored

BITS = 5


def hilbert_index(coords: list, bits: int):
    """Position along the Hilbert curve of integer points (numpy arrays, one a dimension)."""
    import numpy as np

    x = [np.asarray(c, dtype=np.int64).copy() for c in coords]
    n = len(x)
    for q in [1 << b for b in range(bits - 1, 0, -1)]:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for q in [1 << b for b in range(bits - 1, 0, -1)]:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
    x = [c ^ flip for c in x]
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = (out << 1) | ((c >> b) & 1)
    return out


def _codes(slim: DataFrame, col: str, bits: int) -> DataFrame:
    """(value, code): equal steps over the distinct values in order, weighted by nothing."""
    seen = stored(slim.groupBy(col).count().drop("count"))
    placed = with_position(seen, col, name="at")
    return placed.select(F.col(col).alias(f"{col}_key"), F.floor(F.col("at") * F.lit(1 << bits) / F.lit(max(1, seen.count()))).cast("int").alias(f"{col}_code"))


def _side_by_side(curved: DataFrame) -> DataFrame:
    """``curved`` with the curve index of each text's smallest id for all documents of that text."""
    text = ["text_hash", "text_crc32", "size"]
    ranged = _ranged(curved, [*text, "doc_id", "d0", "d1"], "at", "part", "low")
    pieces = ranged.groupBy(*text, "part").agg(F.min_by("curve", "low").alias("first"))
    homes = pieces.withColumn("home", F.first("first").over(W.partitionBy(*text).orderBy("part"))).drop("first")  # a row a text and range
    return ranged.join(homes, [*text, "part"]).select("doc_id", *text, F.col("home").alias("curve"), "d0", "d1")


def hilbert_shards(docs: DataFrame, shards: int = 16, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, str] = ("source", "lang")) -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot) for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = stored(
        docs.select(F.col(id_col).alias("doc_id"), *(F.col(c).cast("string").alias(f"d{i}") for i, c in enumerate(dims)), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    )
    coded = slim
    for i in range(len(dims)):
        # a row for each distinct value; Catalyst broadcasts it if it is small
        coded = coded.join(_codes(slim, f"d{i}", bits), F.col(f"d{i}").eqNullSafe(F.col(f"d{i}_key"))).drop(f"d{i}_key")
    # sizes in half powers of two: 2^bits steps reach 2^16 bytes, larger ones share the last
    step = F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.col("size")) * 2).cast("int")).cast("int")

    @F.pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a, b, c], bits))

    grouped = _side_by_side(coded.withColumn("curve", curve("d0_code", "d1_code", step)))
    placed = with_position(grouped, "curve", "text_crc32", "text_hash", "size", "doc_id", "d0", "d1", name="pos")
    total = slim.count()
    free(slim)
    shard = F.expr(f"cast((pos * {shards}) div {max(1, total)} as int)")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("pos") - first).cast("long").alias("slot"))


def write_shards(placed: DataFrame, docs: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes the documents as one folder a shard, in curve order within it."""
    placed.select(F.col("doc_id").alias("_id"), "shard", "slot").join(docs, F.col("_id") == F.col(id_col)).drop("_id").repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def law_column() -> Column:
    return F.lit("rows")
