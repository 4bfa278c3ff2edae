"""Exact centroid clustering by annulus search.

Vectors become whole numbers, so that distances, sums and means are exact and no result depends on the order of rows.
A round sorts the centroids by norm.  The distance of a vector to a centroid of about its own norm bounds that to its
nearest one from above; by the triangle inequality the nearest ones have norms within this bound of the vector's own.  A binary
search finds those centroids, bounds included, and the vector is compared exactly with them alone; of equally near
ones the smallest number wins.

Each task adds up its vectors by cluster and sends one row a cluster; the driver holds the centroids only.

Rules: vectors that are null, of another length, or hold null or non-finite components are left out; repeated rows count as
often as they occur; a null id counts as empty text in the first draw; with fewer vectors than ``k`` each is a centroid; an
empty table gives no rows.  Whole numbers beyond 2^31, whose squared distances a long cannot hold, raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import free, stored

#: Up to here sums of squares of differences are exact as doubles, for 64 components and fewer.
EXACT = 1 << 22
LARGEST = 1 << 31


def quantised(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) of a column of lists of ``dim`` numbers, as doubles without a fraction."""
    x = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), dim)
    if len(x) and np.abs(x).max() > LARGEST:
        raise OverflowError("a component is too large for exact distances")
    return x


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` to ``b``, one row or as many."""
    d = a - b
    if d.shape[1] <= 64 and (not d.size or np.abs(d).max() <= 2 * EXACT):
        return (d * d).sum(axis=1)
    return np.array([sum(int(v) ** 2 for v in row) for row in d], dtype=object)


class Annuli:
    """Centroids sorted by norm."""

    def __init__(self, centroids: list[list[int]]) -> None:
        c = np.array(centroids, dtype=np.float64)
        norms = np.sqrt((c * c).sum(axis=1))
        self.names = np.lexsort((np.arange(len(c)), norms))
        self.c, self.norms = c[self.names], norms[self.names]

    def reaches(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the first of the sorted centroids that may be nearest, and one past the last."""
        size, last = np.sqrt((x * x).sum(axis=1)), len(self.c) - 1
        at = np.minimum(np.searchsorted(self.norms, size), last)
        bound = np.minimum(*(np.sqrt(squared(x, self.c[i]).astype(np.float64)) for i in (at, np.maximum(at - 1, 0))))
        bound = bound + 1e-9 * (bound + size) + 1e-6  # roots are rounded; centroids on the border stay in
        return np.searchsorted(self.norms, size - bound, "left"), np.searchsorted(self.norms, size + bound, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid."""
        first, past = self.reaches(x)
        exact = not x.size or max(np.abs(x).max(), np.abs(self.c).max()) <= EXACT
        names, best = np.full(len(x), -1, dtype=np.int64), np.full(len(x), np.inf, dtype=np.float64 if exact else object)
        for j, name in enumerate(self.names):
            rows = np.flatnonzero((first <= j) & (j < past))
            if len(rows):
                d, had = squared(x[rows], self.c[j]), best[rows]
                better = ((d < had) | ((d == had) & (name < names[rows]))).astype(bool)
                names[rows[better]], best[rows[better]] = name, d[better]
        return names, best


def _sums(centroids: list[list[int]], scale: float):
    """A task's vectors, counted and added up by nearest centroid."""

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, dim = Annuli(centroids), len(centroids[0])
        n, total = np.zeros(len(centroids), dtype=np.int64), np.zeros((len(centroids), dim), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                x = quantised(b.column("vec"), dim, scale)
                names, _ = near.nearest(x)
                np.add.at(n, names, 1)
                np.add.at(total, names, x.astype(np.int64))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return batch


def _assigned(centroids: list[list[int]], scale: float):
    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, dim = Annuli(centroids), len(centroids[0])
        for b in batches:
            if b.num_rows:
                names, best = near.nearest(quantised(b.column("vec"), dim, scale))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(names.astype(np.int32)), pa.array([int(d) for d in best], pa.int64())], names=["id", "cluster", "distance"])

    return batch


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, seed: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance) of every vector kept, the centroids as whole numbers).

    The first centroids are the ``k`` vectors of the lowest sha256 of ``seed:id``; each of ``rounds`` replaces those that
    have vectors by floor(sum / count), component by component.
    """
    x = F.col("vec")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    kept = stored(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where((F.size("vec") == dim) & finite))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(drawn, "vec").limit(k).select("vec").collect()  # k rows
    kind = vectors.schema[id_col].dataType.simpleString()
    if not first:
        return kept.selectExpr("id", "cast(null as int) cluster", "cast(null as long) distance"), []
    centroids = quantised(pa.array([r.vec for r in first], pa.list_(pa.float64())), dim, scale).astype(np.int64).tolist()
    for _ in range(rounds):
        parts = kept.mapInArrow(_sums(centroids, scale), "cluster long, n long, total array<long>")
        new = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(dim))).alias("total")).collect()  # k rows at most
        for r in new:
            centroids[r.cluster] = [t // r.n for t in r.total]
    out = stored(kept.mapInArrow(_assigned(centroids, scale), f"id {kind}, cluster int, distance long"))
    free(kept)
    return out, centroids


def cluster_report(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, seed: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): with the sums of distances over each cluster and over all, and a digest of each final centroid."""
    found, centroids = cluster_vectors(vectors, k, rounds, dim, scale, seed, id_col, vec_col)
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    every = F.array(*(F.lit(sums.get(i, 0)).cast("long") for i in range(max(1, len(centroids)))))
    digests = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids or [[]]))
    at = F.col("cluster") + 1
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", F.element_at(every, at).alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), F.element_at(digests, at).alias("centroid_sha256"))
