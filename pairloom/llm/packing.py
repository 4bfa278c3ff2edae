"""Best-fit packing by patterns fitted with non-negative least squares.

Documents become token ids, each closed by an end id, and only documents longer than a
sequence are cut.  What packing needs to know of them is their histogram of
lengths, which has ``capacity`` cells at most whatever the number of
documents, so the plan is made on the driver and is as small:

1. patterns of one to four lengths that occur and fill a sequence best are enumerated;
2. non-negative least squares fits their repeat counts to the histogram;
3. the counts are rounded and cut to what is there;
4. the lengths left over are packed longest first, each time with the longest
   that still fits, a pattern again repeated as often as its lengths allow.

A plan row says: of length L, the pieces ranked from ``first`` on, ``per`` to a
sequence, go to the sequences from ``sequence`` on at ``offset``.  Pieces learn their rank
among those of equal length from counts by (length, salt), so that a length
which a third of all documents share is numbered in many tasks, and find their
plan row by binary search.

Rules: a null or empty text is the end id alone.  Equal rows are pieces of
their own.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.llm.common import given_back, stored

CAPACITY = 4096
END_ID = 1
#: Parts of words that a tokenizer remembers, and as many older ones: some 150 bytes each.
ROOM = 50_000


def _byte_signs() -> dict[int, str]:
    """The printable sign for each byte that is not one itself, as byte-level tokenizers number them."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class WordTokenizer:
    """A word-level tokenizer file read by ``tokenizers``, remembering parts of words and their ids.

    The file's pre-tokenizer cuts at white space and between letters, single
    digits and other signs, so the ids of a text are those of its words in
    order.  Signs at the end of a word are words of their own here.  Words in plain Latin letters, digits and ASCII signs are cut here and looked up in the
    file's model; all other words, and texts that hold a special token's
    string or separators that only some libraries call white space, go through the whole tokenizer.
    Ids are kept as little-endian 32-bit bytes.  At most ``room`` parts are remembered, as many of those used before
    them, so that frequent ones stay, and as many words of several parts or from the whole tokenizer.
    """

    _PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ʯ]+")
    _PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
    _ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
    _SIGNS = _byte_signs()
    _SIGN = r"!-/:-@\[-`{-~"
    # not after a letter whose lower case ends with a mark
    _ENDS = re.compile(f"[{_SIGN}](?<=[A-Za-zÀ-ÖØ-öø-įı-ʯ].)[{_SIGN}]*(?!\\S)")
    _ALONE = re.compile(f"[{_SIGN}]+")

    def __init__(self, path: str, room: int = ROOM):
        from tokenizers import Tokenizer

        self.whole, self.room = Tokenizer.from_file(path), room
        self.model = self.whole.model
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        if (out := self.parts.get(part)) is not None:
            return out
        if (out := self.older.get(part)) is None:
            shown = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self._SIGNS)
            out = _packed([t.id for t in self.model.tokenize(shown)])
        if len(self.parts) >= self.room:
            self.parts, self.older = {}, self.parts
        self.parts[part] = out
        return out

    def _word(self, word: str) -> bytes:
        if (out := self.words.get(word)) is not None:
            return out
        if word.isascii() or self._PLAIN.fullmatch(word):
            lower = word.lower()
            if lower == word and (word.isalpha() or self._ALONE.fullmatch(word)):
                return self._part(word)
            out = b"".join([self._part(p) for p in self._PART.findall(lower)])
        else:
            out = _packed(self.whole.encode(word, add_special_tokens=False).ids)
        if len(self.words) >= self.room:
            self.words.clear()
        self.words[word] = out
        return out

    def __call__(self, text: str) -> bytes:
        if any(odd in text for odd in self._ODD):
            return _packed(self.whole.encode(text, add_special_tokens=False).ids)
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        lower = text.lower()
        # else lower case depends on what stands around, or composes anew with a mark that follows
        if len(lower) == len(text) and "Σ" not in text and (lower.isascii() or unicodedata.is_normalized("NFC", lower)):
            text = lower
        add, out = self._word, []
        words = self._ENDS.sub(r" \g<0>", text).split()
        for at in range(0, len(words), 1000):
            get = self.parts.get  # not the same for ever
            out += [get(w) or add(w) for w in words[at : at + 1000]]
        return b"".join(out)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, room: int = ROOM) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece of every document; a task remembers up to twice ``room`` parts of words."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, end = WordTokenizer(tokenizer_path, room), _packed([end_id])
        for f in given_back(frames):
            rows, again = [], {t: None for t, n in Counter(f.iloc[:, 1]).items() if n > 1}
            for i, t in zip(f.iloc[:, 0], f.iloc[:, 1], strict=True):
                ids = again.get(t)
                if ids is None:
                    ids = (tok(t) if t else b"") + end
                    if t in again:
                        again[t] = ids
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else [])))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInPandas(cut, schema)


def enumerate_patterns(lengths: np.ndarray, capacity: int, tries: int = 12) -> np.ndarray:
    """Rows of four indices into the sorted ``lengths`` (-1: none) of full or nearly full sequences."""
    best = lambda room: np.searchsorted(lengths, room, "right") - 1  # noqa: E731  the longest that fits, or -1
    n = len(lengths)
    first = np.arange(n)
    rows = [np.stack([first, best(capacity - lengths), np.full(n, -1), np.full(n, -1)], 1)]
    rng = np.random.default_rng(3)
    for t in range(tries):
        room = capacity - lengths
        top = best(room)
        second = np.where(top >= 0, (rng.random(n) * (top + 1)).astype(int), -1)
        room = room - np.where(second >= 0, lengths[second], 0)
        third = best(room) if t % 2 == 0 else np.where(best(room) >= 0, (rng.random(n) * (best(room) + 1)).astype(int), -1)
        room = room - np.where(third >= 0, lengths[third], 0)
        rows.append(np.stack([first, second, third, best(room)], 1))
    found = np.unique(-np.sort(-np.concatenate(rows), axis=1), axis=0)
    full = np.where(found >= 0, lengths[found], 0).sum(1)
    return found[full >= 0.98 * capacity]


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, by accelerated projected gradients."""
    n, used = len(histogram), patterns >= 0
    at = np.where(used, patterns, n)

    def spread(x: np.ndarray) -> np.ndarray:
        return np.bincount(at.ravel(), weights=np.repeat(x, at.shape[1]), minlength=n + 1)[:n]

    def gather(r: np.ndarray) -> np.ndarray:
        return np.append(r, 0.0)[at].sum(1)

    v = np.ones(len(patterns))
    for _ in range(15):  # the largest curvature, by power iteration
        v = gather(spread(v))
        v /= max(1e-12, np.linalg.norm(v))
    step = 1.0 / max(1e-9, 1.05 * np.linalg.norm(gather(spread(v))))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * gather(spread(y) - histogram))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Plan rows (length, first, count, per, sequence, offset) that place every piece of the histogram.

    Their number does not grow with the pieces: patterns give at most 4 * 13 * capacity rows; of the sequences after them each
    uses up a length or leaves fewer of it than fit, so there are at most two a length, with fewer than sqrt(2 * capacity) lengths in each.
    """
    lengths = np.array(sorted(counts), dtype=np.int64)
    left = np.array([counts[int(x)] for x in lengths], dtype=np.int64)
    taken = np.zeros_like(left)
    rows, sequence = [], 0

    def place(pattern: list[int], repeat: int) -> None:
        nonlocal sequence
        offset = 0
        for i in sorted(set(pattern), reverse=True):
            per = pattern.count(i)
            rows.append((int(lengths[i]), int(taken[i]), per * repeat, per, sequence, offset))
            taken[i] += per * repeat
            left[i] -= per * repeat
            offset += per * int(lengths[i])
        sequence += repeat

    patterns = enumerate_patterns(lengths, capacity) if len(lengths) else np.zeros((0, 4), int)
    if len(patterns):
        x = fit_counts(patterns, left.astype(float))
        for k in np.argsort(-x, kind="stable"):
            if (want := int(x[k] + 0.5)) <= 0:
                break
            pattern = [int(i) for i in patterns[k] if i >= 0]
            repeat = min(want, *(int(left[i]) // pattern.count(i) for i in set(pattern)))
            if repeat > 0:
                place(pattern, repeat)
    alive = [i for i in range(len(lengths)) if left[i] > 0]  # sorted; the longest last
    while alive:
        pattern, room = [], capacity
        use: dict[int, int] = {}
        hi = len(alive)
        while hi:
            hi = _fitting(alive, lengths, room, hi)
            if hi == 0:
                break
            i = alive[hi - 1]
            n = min(int(left[i]), room // int(lengths[i]))
            use[i] = n
            pattern += [i] * n
            room -= n * int(lengths[i])
            hi -= 1
        place(pattern, min(int(left[i]) // n for i, n in use.items()))
        alive = [i for i in alive if left[i] > 0]
    return pd.DataFrame(rows, columns=["length", "first", "count", "per", "sequence", "offset"], dtype="int64").sort_values(["length", "first"], ignore_index=True)


def _fitting(alive: list[int], lengths: np.ndarray, room: int, hi: int) -> int:
    """How many of the first ``hi`` lengths alive fit into ``room``."""
    lo = 0
    while lo < hi:
        mid = (lo + hi) // 2
        if lengths[alive[mid]] <= room:
            lo = mid + 1
        else:
            hi = mid
    return lo


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, rows_per_salt: int = 250_000) -> DataFrame:
    """``pieces`` (stored) with sequence_id and offset.

    Pieces of one length are numbered in as many tasks as all pieces would need at ``rows_per_salt`` each, so that
    even a length that all of them share overfills none.
    """
    spark = pieces.sparkSession
    salts = 16 + pieces.count() // rows_per_salt
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before)
    histogram = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = plan_sequences(histogram, capacity)
    shared = spark.sparkContext.broadcast({c: plan[c].to_numpy() for c in plan})
    place = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    # at most capacity * salts rows
    ranked = salted.withColumn("place", place).join(counts.drop("n"), ["length", "salt"]).withColumn("rank", F.col("place") + F.col("before") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = shared.value
        key = p["length"] * (1 << 45) + p["first"]
        i = np.searchsorted(key, length.to_numpy() * (1 << 45) + rank.to_numpy(), "right") - 1
        k = rank.to_numpy() - p["first"][i]
        return pd.DataFrame({"sequence_id": p["sequence"][i] + k // p["per"][i], "offset": p["offset"][i] + (k % p["per"][i]) * length.to_numpy()})

    placed = ranked.withColumn("at", find("length", "rank"))
    return placed.select(*pieces.columns, "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, room: int = ROOM) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack_pieces(stored(cut_pieces(docs, tokenizer_path, capacity, end_id, with_ids=with_ids, room=room)), capacity)
