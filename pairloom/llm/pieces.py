"""Encoding and decoding with a sentencepiece vocabulary of the merge type.

The text is cut where no piece of the vocabulary can reach across: before a run of word marks, and around characters
that occur in no longer piece.  In each part every character begins as a symbol of its own.  An agenda holds the
adjacent pairs of symbols whose union is a piece, best score first and leftmost first among equals; the first pair is
merged and its new neighbours go on the agenda, until it is empty.  Symbols that are no piece become their bytes.
Short parts, of which there are very many, have their agendas side by side as rows of a numpy matrix, of which each row's
first least entry is merged at a time; long parts have a heap.  Ids of short parts are remembered, up to a bound.  Every text is encoded by the sentencepiece library too, in the same
Arrow batch, and another result of the library ends the job with the text's first difference.

Rules: a null text counts as empty and has no ids; texts of any length are taken whole; repeated rows are encoded one by
one; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import small_batches, stored

MARK, ALONE = "▁", "\n"
#: Parts up to so many characters are remembered, so many of them.
PART_CHARS, PARTS = 40, 300_000
#: Whole texts that Python is handed, and that the library encodes, at a time.
BATCH, BLOCK_CHARS = 1000, 1_000_000
#: Bits of a symbol's number in a pair, and of a place in an entry of the agenda.
BITS, PLACE = 20, 40
LEFT = (1 << PLACE) - 1
#: The rank of no pair; rows of a matrix of agendas.
NEVER, ROWS = (1 << 31) - 1, 20_000
#: The kinds of pieces in the model file that are used here, and its number for merges.
NORMAL, BYTE, MERGES = 1, 6, 2


class MergeEncoder:
    """The ids of a text by a model file of the merge type with byte fallback."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        self.library = SentencePieceProcessor(model_file=model_file)
        model = ModelProto.FromString(self.library.serialized_model_proto())
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != MERGES or sum(p.type == BYTE for p in model.pieces) != 256 or kinds - {1, 2, 3, BYTE}:
            raise ValueError("a merge-type vocabulary with byte fallback, without user-defined or unused pieces, is needed")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        scores = {s: at for at, s in enumerate(sorted({p.score for p in model.pieces}, reverse=True))}
        self.order = [scores[p.score] for p in model.pieces]
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        longer = [p for p in normal if len(p) > 1]
        # a symbol is a piece, or a character that is none: such ones are numbered on and have their bytes as ids
        inner = sorted({c for p in longer for c in p})
        self.symbol = dict(normal) | {c: len(model.pieces) + i for i, c in enumerate(c for c in inner if c not in normal)}
        self.spelt = {i: [byte[x] for x in c.encode()] for c, i in self.symbol.items() if i >= len(model.pieces)}
        self.pairs = {self.symbol[p[:i]] << BITS | self.symbol[p[i:]]: n for p, n in normal.items() for i in range(1, len(p)) if p[:i] in self.symbol and p[i:] in self.symbol}
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.unions = np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int32)
        self.ranks = np.array([*self.order, NEVER], dtype=np.int32)  # at -1, the union of no pair: never
        self.numbers = np.full(0x110000, -1, dtype=np.int32)
        self.numbers[[ord(c) for c in self.symbol if len(c) == 1]] = [i for c, i in self.symbol.items() if len(c) == 1]
        self.decimals = [str(i) for i in range(len(model.pieces))]
        self.bytes_of = lambda c: [byte[x] for x in c.encode()]
        apart = all(MARK not in p.lstrip(MARK) for p in longer)
        others = "".join(re.escape(c) for c in inner if c != MARK)
        self.parts = re.compile(f"{MARK}*[{others}]+|{MARK}+|." if apart and others else ".+", re.S).findall
        if ALONE in inner:
            raise ValueError("a vocabulary whose longer pieces have no line ends is needed")
        self.before = self.library.encode(ALONE)
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def merged(self, part: str) -> list[int]:
        """The ids of a part, by a heap as the agenda: numbers that hold a pair's place in the order of scores, then its left end."""
        symbol, pairs, order, n = self.symbol, self.pairs.get, self.order, len(part)
        if any(c not in symbol for c in part):  # characters of no piece merge with nothing
            return [i for run in re.findall("|".join((f"[{''.join(re.escape(c) for c in {*part} if c in symbol)}]+", ".")) if any(c in symbol for c in part) else ".", part, re.S) for i in (self.merged(run) if run[0] in symbol else self.bytes_of(run))]
        held = [symbol[c] for c in part]
        agenda = [order[m] << PLACE | i for i in range(n - 1) if (m := pairs(held[i] << BITS | held[i + 1])) is not None]
        if agenda:
            heapify(agenda)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while agenda:
                top = heappop(agenda)
                i = top & LEFT
                a, j = held[i], after[i]
                if a < 0 or j >= n or (m := pairs(a << BITS | held[j])) is None or order[m] != top >> PLACE:
                    continue  # one of the two has been merged meanwhile
                held[i], held[j] = m, -1
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if (q := pairs(m << BITS | held[k])) is not None:
                        heappush(agenda, order[q] << PLACE | i)
                h = before[i]
                if h >= 0 and (q := pairs(held[h] << BITS | m)) is not None:
                    heappush(agenda, order[q] << PLACE | h)
        last = len(order)
        if max(held, default=0) < last:
            return [s for s in held if s >= 0]
        return [x for s in held if s >= 0 for x in (self.spelt[s] if s >= last else (s,))]

    def union(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pieces that pairs of symbols make together, or -1."""
        key = a.astype(np.int64) << BITS | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.unions[at], -1)

    def merged_together(self, parts: list[str]) -> list[list[int]]:
        """``merged`` of short parts, whose agendas are the rows of a matrix."""
        size = np.array([len(p) for p in parts])
        symbols = self.numbers[np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)]
        ends = np.cumsum(size)
        out: list[list[int]] = [[]] * len(parts)
        last = len(self.order)
        for low, high in zip((0, 4, 8, 12, 20), (4, 8, 12, 20, PART_CHARS), strict=True):
            rows = np.flatnonzero((size > low) & (size <= high))
            for lo in range(0, len(rows), ROWS):
                own = rows[lo : lo + ROWS]
                column = np.arange(high)
                inside = column < size[own, None]
                held = np.where(inside, symbols[np.minimum((ends - size)[own, None] + column, len(symbols) - 1)], -1)
                self._settle(held)
                there = held >= 0
                flat, to = held[there].tolist(), np.cumsum(there.sum(axis=1)).tolist()
                b = 0
                for i, e in zip(own.tolist(), to, strict=True):
                    out[i], b = flat[b:e], e
                for i in own[(held >= last).any(axis=1)].tolist():
                    out[i] = [x for s in out[i] for x in (self.spelt[s] if s >= last else (s,))]
        return out

    def _settle(self, held: np.ndarray) -> None:
        """Merges the symbols in each row of ``held`` until no pair is a piece; -1 fills up on the right."""
        live, row = np.arange(len(held)), held
        new = np.where(row[:, 1:] >= 0, self.union(row[:, :-1], row[:, 1:]), -1)
        column = np.arange(row.shape[1])
        while len(live):
            agenda = self.ranks[new]
            at = agenda.argmin(axis=1) if agenda.shape[1] else np.zeros(len(live), dtype=np.int64)
            some = agenda[np.arange(len(live)), at] < NEVER if agenda.shape[1] else np.zeros(len(live), dtype=bool)
            held[live[~some]] = row[~some]
            live, row, new, at = live[some], row[some], new[some], at[some]
            if not len(live):
                return
            i = np.arange(len(live))
            union = new[i, at]
            # what stands right of the pair moves one place to the left
            after = column[None, :] > at[:, None]
            row = np.where(after, np.c_[row[:, 1:], np.full(len(live), -1)], row)
            new = np.where(after[:, :-1], np.c_[new[:, 1:], np.full(len(live), -1)], new)
            row[i, at] = union
            right = row[i, np.minimum(at + 1, row.shape[1] - 1)]
            open_ = at < new.shape[1]
            new[i[open_], at[open_]] = np.where(right >= 0, self.union(union, right), -1)[open_]
            back = at > 0
            new[i[back], at[back] - 1] = self.union(row[i[back], at[back] - 1], union[back])

    def learn(self, parts: list[list[str]]) -> None:
        """Makes the ids of all short parts known; earlier ones are forgotten when twice PARTS more have been learnt."""
        fresh = set().union(*parts)
        if len(self.known) + len(fresh) > PARTS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        fresh -= known.keys()
        again = fresh & older.keys()
        known.update((p, older[p]) for p in again)
        fresh -= again
        short = [p for p in fresh if 1 < len(p) <= PART_CHARS]
        single = [p for p in fresh if len(p) == 1]
        if single:
            known.update(zip(single, self.agreed(single, [self.merged(p) for p in single]), strict=True))
        if short:
            known.update(zip(short, self.agreed(short, self.merged_together(short)), strict=True))
            gc.freeze()  # hundreds of thousands of small lists that hold numbers only: not to be searched for cycles again and again

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        parts = [self.parts(self.library.normalize(t)) for t in texts]
        self.learn(parts)
        known, out = self.known, []
        for text in parts:
            ids: list[int] = []
            for p in text:
                ids += known[p] if p in known else self.agreed([p], [self.merged(p)])[0]  # long parts are not kept
            out.append(ids)
        return out

    def agreed(self, parts: list[str], ours: list[list[int]]) -> list[list[int]]:
        """The ids of parts, equal to what the library gives: it sets a mark before a text, so a part without one follows a character that stands alone."""
        theirs = self.library.encode([(p[1:] if p[0] == MARK else ALONE + p).replace(MARK, " ") for p in parts], num_threads=1)
        for p, ids, found in zip(parts, ours, theirs, strict=True):
            if ids != (found if p[0] == MARK else found[len(self.before) :]) and p != MARK:
                raise ValueError(f"the library encodes {p[:80]!r} otherwise: {found[:20]}, not {ids[:20]}")
        return ours

    def decoded(self, text: str, ids: list[int]) -> str:
        """The library's text of the ids, which is the one encoded, but for the mark."""
        out = self.library.decode(ids)
        if out.replace(MARK, " ") != text.replace(MARK, " "):
            raise ValueError(f"the ids of a text that begins {text[:80]!r} decode to another")
        return out


@lru_cache(maxsize=2)
def encoder(model_file: str) -> MergeEncoder:
    """One for each Python worker and file."""
    return MergeEncoder(model_file)


def in_blocks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, about BLOCK_CHARS characters at a time."""
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _mapped(docs: DataFrame, id_col: str, text_col: str, schema: str, row: Callable[[list[int], str, list[str]], tuple]) -> DataFrame:
    """A row (id, *row(ids, decoded, all ids as decimal texts)) for each document."""
    names = [c.split()[0] for c in schema.split(", ")]

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from public_tokenizers import path

        e = encoder(str(path(MODEL)))
        for b in batches:
            rows = []
            for texts in in_blocks([t or "" for t in b.column(1).to_pylist()]):
                for t, ids in zip(texts, e.encode(texts), strict=True):
                    rows.append(row(ids, e.decoded(t, ids), e.decimals))
            cols = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[c.split()[1]] for c in schema.split(", ")[1:]]
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias(names[0]), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession, BATCH):
        return stored(slim.mapInArrow(batch, schema.replace(f"{names[0]} long", f"{names[0]} {kind}", 1)))


#: The public vocabulary, installed on the driver and on every executor.
MODEL = "piece_bpe_32k.model"


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the ids of every whole text, without begin and end ids, and the text they decode to."""
    return _mapped(docs, id_col, text_col, "doc_id long, ids array<int>, decoded string", lambda ids, decoded, _: (ids, decoded))


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what ``encode_documents`` gives, as a count and digests made in the same batch."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _mapped(docs, id_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, decoded, shown: (len(ids), sha(",".join([shown[i] for i in ids])), sha(decoded)))
