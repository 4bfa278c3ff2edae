"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are n-grams over two readings of a text's words: the words themselves
with A-Z lowered (n = 1, 2) and their shapes (n = 1, 2, 3), in which letters
become ``a`` or ``A``, digits ``0`` and runs of one class one sign, so that
``Word,`` reads ``Aa,``.  Each n-gram is hashed to one of 2^BITS weights and
counts as a share of its family's n-grams; a score is the sparse dot product
through a sigmoid.

Training is FTRL-proximal with per-coordinate rates (learning rate ``alpha``,
``beta``, L1, L2) over a sample of at most ``max_rows`` labelled documents, read whole and
chosen by a hash of their ids; many tasks count their n-grams, one makes ``epochs`` passes over the sparse counts.

Rules: null and empty texts get the score of the bias; rows without a label,
or held out, teach nothing; with no labelled row every score is 0.5; repeated rows are scored alike and
teach as often as they occur; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.textblocks import blocks, mix64, words

BITS = 18
BIAS = 1 << BITS
SCALE = 10.0
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE[128:] = 97
_SHAPE[[9, 10, 11, 12, 13]] = 32


def _shaped(texts: list[bytes]) -> list[bytes]:
    buf = _SHAPE[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    keep = np.concatenate([[True], buf[1:] != buf[:-1]])
    return [buf[keep].tobytes()]


def families(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text index, weight index) of every n-gram, family by family."""
    plain, row, _, _ = words(texts)
    shape, _, _, _ = words(_shaped(texts), lower=False)
    out = []
    for h, orders, salt in ((plain, 2, 1), (shape, 3, 17)):
        grams = h
        for n in range(1, orders + 1):
            if n > 1:
                grams = mix64(grams[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[n - 1 :])
            inside = row[: len(row) - n + 1] == row[n - 1 :] if n > 1 else slice(None)
            r = row[: len(row) - n + 1][inside]
            out.append((r, (mix64(grams[inside] + np.uint64(salt + n)) >> np.uint64(64 - BITS)).astype(np.int64)))
    return out


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights (the last one the bias) from (indices, values, label) examples."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)
    for _ in range(epochs):
        for i, x, y in examples:
            w = np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))
            g = (_sigmoid(w @ x) - y) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def example(text: bytes, label: int) -> tuple[np.ndarray, np.ndarray, int]:
    idx, val = [np.array([BIAS])], [np.ones(1)]
    for _, i in families([text]):
        if len(i):
            u, c = np.unique(i, return_counts=True)
            idx.append(u)
            val.append(c * (SCALE / len(i)))
    i, back = np.unique(np.concatenate(idx), return_inverse=True)
    return i, np.bincount(back, weights=np.concatenate(val)), label


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """``docs`` (doc_id, text) joined to ``labels`` (doc_id, label); returns the weights."""
    chosen = labels.where("label is not null").select("doc_id", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    # at most max_rows ids
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [example(bytes(t), y) for t, y in zip(f.text, f.label, strict=True)]
            yield pd.DataFrame({"doc_id": f.doc_id, "label": f.label, "at": [i for i, _, _ in found], "x": [x for _, x, _ in found]})

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [(d, i, x, y) for f in frames for d, i, x, y in zip(f.doc_id, f["at"], f.x, f.label, strict=True)]
        found.sort(key=lambda e: (hash((e[0] * 2654435761) & 0xFFFFFFFF), e[0], e[3], e[1].tobytes(), e[2].tobytes()))
        if found:
            w = ftrl([(i, x, y) for _, i, x, y in found], epochs, alpha, beta, l1, l2)
            at = np.flatnonzero(w)
            yield pd.DataFrame({"i": at, "w": w[at]})

    counted = sample.mapInPandas(count, "doc_id long, label int, at array<long>, x array<double>")
    got = counted.repartition(1).mapInPandas(learn, "i long, w double").toPandas()  # at most 2^BITS + 1 rows
    weights = np.zeros(BIAS + 1)
    weights[got.i.to_numpy(dtype=np.int64)] = got.w.to_numpy(dtype=float)
    return weights


def score_block(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    total = np.full(len(texts), weights[BIAS])
    for row, i in families(texts):
        n = np.bincount(row, minlength=len(texts))
        total += SCALE * np.bincount(row, weights=weights[i], minlength=len(texts)) / np.maximum(n, 1)
    return _sigmoid(total)


def predict_quality(docs: DataFrame, weights: np.ndarray, text: str = "text") -> Column:
    """A double column for ``docs``: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.concatenate([np.zeros(0), *(score_block(b, shared.value) for _, b in blocks(texts, 500_000))]))

    return predict(F.col(text).cast("binary"))
