"""Language identification by words first, with backoff to character n-grams.

A known word scores its log frequency in each language; an unseen word scores
the mean over its known character n-grams of the longest length (4 down to 1)
of which any is known; a word of unknown characters says nothing.  A text's
language has the highest sum over all its words, and its score is the softmax
of the mean word score over ``EVIDENCE`` words (fewer, if the text has fewer).

Training reads a bounded sample (``per_lang`` documents of each language, by a hash of the
text), counts in Spark, and keeps the ``max_words`` commonest words and
``max_grams`` commonest n-grams of each length and language, or as many as ``max_entries`` allow each of very many
languages.  The broadcast model holds these entries only, so parameters fix its size; every language is learned.

Rules: a null text or one without a letter is ``und`` with score 0, and so is
every text if nothing was learned; equal scores go to the language first in code-point order;
repeated rows are scored alike and teach once; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.llm.common import free, given_back, stored

UND = "und"
EVIDENCE = 20
GRAMS = (4, 3, 2, 1)
BROADCAST_LANGS = 100_000
DENSE = 20_000_000
_WORD = re.compile(r"[^\W\d_]+")


def _grams(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in given_back(frames):
        for lang, part in frame.groupby("lang"):
            seen: dict[int, Counter] = {n: Counter() for n in (0, *GRAMS)}
            for text in part["text"]:
                seen[0].update(_WORD.findall(text.lower()))
            for word, c in seen[0].items():
                for n in GRAMS:
                    for g in _grams(word, n):
                        seen[n][g] += c
            for n, counts in seen.items():
                yield pd.DataFrame({"lang": lang, "n": n, "gram": list(counts), "c": list(counts.values())})


class LanguageModel:
    """Log frequencies by language of words (order 0) and n-grams; picklable and bounded.

    A table of entries by languages is dense up to DENSE cells; a larger one holds, for each entry, the languages that have
    it and by how much their logs exceed those of an unseen one.  Both give the same rows.
    """

    def __init__(self, rows: list, totals: dict[tuple[str, int], int]):
        self.langs = sorted({lang for lang, _ in totals})
        at = {lang: i for i, lang in enumerate(self.langs)}
        found: dict[int, dict[str, list]] = {n: {} for n in (0, *GRAMS)}
        for lang, n, gram, c in rows:
            found[n].setdefault(gram, []).append((at[lang], c))
        self.index: dict[int, dict[str, int]] = {}
        self.unseen: dict[int, np.ndarray] = {}
        self.logs: dict[int, np.ndarray | list] = {}
        for n, entries in found.items():
            total = np.array([totals.get((lang, n), 0) for lang in self.langs], dtype=float)
            self.unseen[n] = np.log(0.5 / (total + 0.5 * max(1, len(entries)))).astype(np.float32)
            self.index[n] = {g: i for i, g in enumerate(entries)}
            more = [(np.array([i for i, _ in e], dtype=np.int32), np.log([2 * c + 1 for _, c in e]).astype(np.float32)) for e in entries.values()]
            self.logs[n] = more
            if len(entries) * len(self.langs) <= DENSE:
                self.logs[n] = np.tile(self.unseen[n], (len(entries), 1))
                for i, (langs, log) in enumerate(more):
                    self.logs[n][i, langs] += log

    def word_row(self, word: str) -> np.ndarray | None:
        word = word if word.isalpha() else "".join(c for c in word if c.isalpha())
        if not word:
            return None
        if (one := self.index[0].get(word)) is not None:
            return self._mean(0, [one])
        for n in GRAMS:
            index = self.index[n]
            if known := [i for g in _grams(word, n) if (i := index.get(g)) is not None]:
                return self._mean(n, known)
        return np.zeros(len(self.langs), dtype=np.float32)

    def _mean(self, n: int, known: list[int]) -> np.ndarray:
        logs = self.logs[n]
        if isinstance(logs, np.ndarray):
            return logs[known[0]] if len(known) == 1 else logs[known].mean(axis=0)
        row = self.unseen[n].copy()
        for langs, more in (logs[i] for i in known):
            row[langs] += more / len(known)
        return row


class Scorer:
    """Scores texts, remembering up to ``room`` words."""

    def __init__(self, model: LanguageModel, room: int = 800_000):
        # so many numbers are remembered
        self.model, self.room = model, max(1000, room // max(1, len(model.langs)))
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.langs)), dtype=np.float32)
        self.n = 1  # row 0: words without a letter

    def _add(self, word: str) -> int:
        row = self.model.word_row(word)
        if row is None:
            self.at[word] = 0
            return 0
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n] = row
        self.at[word] = self.n
        self.n += 1
        return self.n - 1

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.langs:
            return UND, 0.0
        counts = Counter(_WORD.findall(text.lower()))
        if self.n > self.room:
            self.forget()
        get, add = self.at.get, self._add
        idx = np.fromiter([i if (i := get(w)) is not None else add(w) for w in counts], dtype=np.int64, count=len(counts))
        c = np.fromiter(counts.values(), dtype=np.float64, count=len(counts)) * (idx > 0)
        if not (n := c.sum()):
            return UND, 0.0
        mean = (c @ self.rows[idx]) / n
        e = np.exp((mean - mean.max()) * min(n, EVIDENCE))
        best = int(np.argmax(e))
        return self.model.langs[best], float(e[best] / e.sum())


def train_language_model(labelled: DataFrame, per_lang: int = 500, max_words: int = 20_000, max_grams: int = 5_000, max_entries: int = 2_000_000) -> LanguageModel:
    """From rows (text, lang) with neither null."""
    hashed = labelled.select("text", "lang", F.xxhash64("text").alias("h"))
    # hashes are put in order first, so that of the texts only the sample moves; copies count once.  In two steps: of a
    # language that most texts share, parts by hash pass on ``per_lang`` each
    in_part = F.row_number().over(W.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h"))
    parts = hashed.select("lang", "h").distinct().withColumn("k", in_part).where(F.col("k") <= per_lang).select("lang", "h")
    place = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    cut = stored(parts.withColumn("k", place).where(F.col("k") <= per_lang).groupBy("lang").agg(F.max("h").alias("cut")))
    # a row a language, counted; with it at hand only the sampled texts move
    cut = F.broadcast(cut) if cut.count() <= BROADCAST_LANGS else cut
    sample = hashed.join(cut, "lang").where("h <= cut").groupBy("lang", "h").agg(F.first("text").alias("text")).select("text", "lang")
    counts = stored(sample.mapInPandas(_count, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")))
    share = min(1.0, max_entries / max(1, counts.select("lang").distinct().count() * (max_words + len(GRAMS) * max_grams)))
    place = F.row_number().over(W.partitionBy("lang", "n").orderBy(F.desc("c"), "gram"))
    total = F.sum("c").over(W.partitionBy("lang", "n"))
    most = F.when(F.col("n") == 0, max(1, int(share * max_words))).otherwise(max(1, int(share * max_grams)))
    kept = counts.withColumns({"k": place, "total": total}).where(F.col("k") <= most).drop("k")
    got = kept.orderBy("lang", "n", "gram").collect()  # at most max_entries, or five a language
    free(counts)
    return LanguageModel([tuple(r)[:4] for r in got], {(r.lang, r.n): r.total for r in got})


def predict_language(docs: DataFrame, model: LanguageModel, text: str | Column = "text") -> Column:
    """A struct column (lang_pred, score) for ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = Scorer(shared.value)
        for texts in given_back(batches):
            yield pd.DataFrame([score(t) for t in texts], columns=["lang_pred", "score"])

    return predict(F.col(text) if isinstance(text, str) else text)


def drop_unidentified(docs: DataFrame, model: LanguageModel, min_score: float = 0.0) -> DataFrame:
    """The documents whose language was found with at least ``min_score``; columns unchanged."""
    mine = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    found = docs.select(mine, predict_language(docs, model).alias("language"))
    return found.where((F.col("language.lang_pred") != UND) & (F.col("language.score") >= min_score)).select("doc.*")
