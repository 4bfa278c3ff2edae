"""The trie of conversations by their turns.

A node is a distinct sequence of turns with which conversations begin.  Turns get 64-bit hashes, checked against their texts
(turns that share one are numbered apart).  numpy scans over chunks of a conversation give every prefix a polynomial
fingerprint: the sum of its turns' hashes times powers of a base, modulo two primes; what earlier chunks add up to is
carried on.  Prefixes of equal length and fingerprint form a group.  All turns of a group are compared with its
representative's, depth by depth; conversations that differ from it, and are thus not on its path, are split off from
that depth on, and the groups are formed anew until none differs.

The rollup to parents needs no walk over levels.  A node belongs to its smallest member, so what a conversation owns is
the rest of its path from some depth on; what lies below a node is then a sum over the node's members of values known for
each conversation.

Texts move once, to check the hashes, and once more only for turns that share conversation and turn number.
Conversations of any length are scanned in chunks, groups of any size are summed by task first, and long lists of members
are digested as a stream of pieces in order.

Rules: rows without conv_id take no part; a null turn comes first; rows that share conversation and turn go by role, then text;
null role or text is empty; repeated rows are turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.ranking import with_position
from pairloom.llm.common import free, stored

#: The primes of the fingerprints, and their bases.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1220703125)
#: Turns of a conversation that are scanned together, and ids in a piece of a list of members.
CHUNK, PIECE = 4096, 4096
NODE = ("depth", "f0", "f1", "split")
SCANNED = ("f0", "f1", "b0", "b1", "words")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponents modulo a prime below 2^31."""
    out, b, e = np.ones(len(exponents), dtype=np.uint64), np.uint64(base % prime), exponents.astype(np.uint64)
    p = np.uint64(prime)
    while e.any():
        out = np.where(e & np.uint64(1), out * b % p, out)
        b, e = b * b % p, e >> np.uint64(1)
    return out


def _restarted(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums that begin anew where ``starts`` is set."""
    run = np.cumsum(values, dtype=np.uint64)
    first = np.maximum.accumulate(np.where(starts, np.arange(len(values)), 0))
    return run - np.where(first > 0, run[first - 1], np.uint64(0))


def scan_prefixes(primes: tuple[int, int] = PRIMES):
    """Rows in order of (c, chunk, depth) get sums from the beginning of their chunk: ``f0``, ``f1``, both without the row itself (``b0``, ``b1``), and ``words``."""

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, carry = None, [0, 0, 0]
        for f in frames:
            if not len(f):
                continue
            c, chunk = f.c.to_numpy(), f.chunk.to_numpy()
            starts = np.r_[True, (c[1:] != c[:-1]) | (chunk[1:] != chunk[:-1])]
            goes_on = last == (c[0], chunk[0])
            head = np.cumsum(starts) == 1  # rows of the chunk that the last batch may have begun
            mixed = f.h.to_numpy().astype(np.uint64) ^ (f.v.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out, ahead = [], []
            for i, (p, b) in enumerate(zip(primes, BASES, strict=True)):
                term = mixed % np.uint64(p) * powers(b, f.depth.to_numpy(), p) % np.uint64(p)
                out.append((_restarted(term, starts) + np.where(head & goes_on, np.uint64(carry[i]), np.uint64(0))) % np.uint64(p))
                ahead.append((out[i] + np.uint64(p) - term) % np.uint64(p))
            words = _restarted(f.w.to_numpy().astype(np.uint64), starts) + np.where(head & goes_on, np.uint64(carry[2]), np.uint64(0))
            last, carry = (c[-1], chunk[-1]), [int(out[0][-1]), int(out[1][-1]), int(words[-1])]
            yield f.assign(**{n: x.astype(np.int64) for n, x in zip(SCANNED, (*out, *ahead, words), strict=True)})

    return batch


def _checked_turns(turns: DataFrame, bits: int) -> DataFrame:
    """(c, t, tie, h, v, w): turns without their texts; equal h and v only for equal role and text."""
    h = F.xxhash64("role", "text")
    h = h if bits >= 64 else h.bitwiseAND((1 << bits) - 1)
    w = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    hashed = turns.withColumns({"h": h, "w": w.cast("long"), "tie": F.lit(0)})
    same = F.struct("role", "text")
    shared = stored(hashed.groupBy("h").agg(F.min(same).alias("a"), F.max(same).alias("b")).where("a <> b").select("h"))
    again = stored(hashed.groupBy("c", "t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("c").alias("c2"), F.col("t").alias("t2")))
    if not again.isEmpty():
        at = (F.col("c") == F.col("c2")) & F.col("t").eqNullSafe(F.col("t2"))
        ties = hashed.join(again, at, "left_semi").withColumn("tie", F.row_number().over(W.partitionBy("c", "t").orderBy("role", "text")))
        hashed = hashed.join(again, at, "left_anti").unionByName(ties)
    if not shared.isEmpty():
        apart = hashed.join(shared, "h", "left_semi").select("h", "role", "text").distinct()
        numbered = stored(apart.withColumn("v", F.row_number().over(W.partitionBy("h").orderBy("role", "text"))))
        hashed = hashed.join(numbered, ["h", "role", "text"], "left")
    else:
        hashed = hashed.withColumn("v", F.lit(0))
    return hashed.select("c", "t", "tie", "h", F.coalesce("v", F.lit(0)).alias("v"), "w")


def rebuilt_turns(conversations: DataFrame, hash_bits: int = 64, family: int = 20, lend: int = 4) -> tuple[DataFrame, DataFrame]:
    """((c, length), (c, depth, h, v, w, length)): the rebuilt conversations and their turns, depth from 1.

    Conversation c begins with the first crc32(c) % ``lend`` turns of c - c % ``family`` and goes on after as many of its own.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("t"), text("role").alias("role"), text("text").alias("text"))
    placed = with_position(_checked_turns(turns, hash_bits), "c", F.col("t").asc_nulls_first(), "tie", "h", "v", name="pos")
    rows = stored(placed.select("c", "h", "v", "w", "pos", F.expr(f"pos div {CHUNK}").alias("block")))
    blocks = stored(rows.groupBy("c", "block").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")))
    own = blocks.groupBy("c").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    own = own.withColumns({"lent": F.crc32(F.col("c").cast("string").cast("binary")) % lend, "base": F.col("c") - F.col("c") % family})
    convs = own.join(own.select(F.col("c").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = convs.withColumn("head", F.least("lent", F.coalesce("base_n", F.lit(0))))
    convs = stored(convs.select("c", "base", "first", "lent", "head", (F.col("head") + F.greatest(F.col("n") - F.col("lent"), F.lit(0))).alias("length")))
    # a conversation of any length meets its numbers block by block
    near = blocks.select("c", "block").join(convs, "c")
    local = rows.join(near, ["c", "block"]).withColumn("own", F.col("pos") - F.col("first"))
    tails = local.where("own >= lent").select("c", (F.col("own") - F.col("lent") + F.col("head") + 1).alias("depth"), "h", "v", "w", "length")
    lenders = local.where((F.col("own") < lend - 1) & (F.col("c") == F.col("base"))).select("base", "own", "h", "v", "w")
    heads = lenders.join(convs.select("c", "base", "head", "length"), "base").where("own < head").select("c", (F.col("own") + 1).alias("depth"), "h", "v", "w", "length")
    return convs, tails.unionByName(heads)


def _fingerprinted(convs: DataFrame, rebuilt: DataFrame, primes: tuple[int, int]) -> DataFrame:
    """(c, chunk, depth, h, v, w, length, f0, f1, b0, b1, words, split, parent_split): every prefix, the empty one at depth 0."""
    tasks = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunked = rebuilt.withColumn("chunk", F.expr(f"(depth - 1) div {CHUNK}")).select("c", "chunk", "depth", "h", "v", "w", "length")
    schema = "c long, chunk long, depth long, h long, v int, w long, length long, " + ", ".join(f"{x} long" for x in SCANNED)
    scanned = stored(chunked.repartition(tasks, "c", "chunk").sortWithinPartitions("c", "chunk", "depth").mapInPandas(scan_prefixes(primes), schema))
    sums = ("f0", "f1", "words")
    ends = scanned.groupBy("c", "chunk").agg(*(F.max_by(x, "depth").alias(x) for x in sums))
    ahead = W.partitionBy("c").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    before = ends.select("c", "chunk", *(F.coalesce(F.sum(x).over(ahead), F.lit(0)).alias(f"{x}_") for x in sums)).where("chunk > 0")
    run = scanned.join(before, ["c", "chunk"], "left")
    add = lambda x, to: F.col(to) + F.coalesce(f"{x}_", F.lit(0))
    prints = {f"{k}{i}": add(f"f{i}", f"{k}{i}") % p for i, p in enumerate(primes) for k in "fb"}
    run = run.withColumns(prints | {"words": add("words", "words")}).drop(*(f"{x}_" for x in sums))
    fixed = {"c", "length"}
    roots = convs.select(*(F.col(x) if x in fixed else F.lit(0).cast(t).alias(x) for x, t in run.dtypes))
    out = stored(run.unionByName(roots).withColumns({"split": F.lit(0), "parent_split": F.lit(0)}))
    free(scanned)
    return out


def _settled(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefixes, nodes) with groups split until all turns of each equal its representative's."""
    same = ("h", "v", "parent_split")  # with the fingerprint these name the turn and the group of the prefix without it
    turn = [f(x).alias(f"{f.__name__}_{x}") for x in same for f in (F.min, F.max)]
    while True:
        groups = prefixes.groupBy(*NODE).agg(F.min("c").alias("conv_id"), F.max("length").alias("longest"), *turn)
        nodes = stored(groups)
        mixed = nodes.where(" or ".join(f"min_{x} <> max_{x}" for x in same)).select(*NODE, "conv_id")
        if mixed.isEmpty():
            return prefixes, nodes
        members = prefixes.join(mixed, list(NODE)).select(*NODE, "c", *same, "conv_id")
        shown = members.where("c = conv_id").select(*NODE, *(F.col(x).alias(f"rep_{x}") for x in same))
        off = stored(members.join(shown, list(NODE)).where(" or ".join(f"{x} <> rep_{x}" for x in same)).groupBy("c").agg(F.min("depth").alias("off")))
        marked = prefixes.join(off, "c", "left")
        later = {"split": F.col("split") + F.coalesce((F.col("depth") >= F.col("off")).cast("int"), F.lit(0)), "parent_split": F.col("parent_split") + F.coalesce((F.col("depth") - 1 >= F.col("off")).cast("int"), F.lit(0))}
        before, prefixes = prefixes, stored(marked.withColumns(later).drop("off"))
        free(before, nodes, off)


def _digests(ends: DataFrame) -> DataFrame:
    """(*NODE, ends_sha256) of the ids ``c`` of each node, in order."""
    tasks = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = list(NODE)

    def runs(f: pd.DataFrame) -> list[np.ndarray]:
        k = f[keys].to_numpy()
        return np.split(np.arange(len(f)), 1 + np.flatnonzero((k[1:] != k[:-1]).any(axis=1)))

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                c, found = f.c.to_numpy(), []
                for run in runs(f):
                    for at in range(0, len(run), PIECE):
                        part = run[at : at + PIECE]
                        found.append((*f.iloc[part[0]][keys], int(c[part[0]]), ",".join(map(str, c[part].tolist()))))
                yield pd.DataFrame(found, columns=[*keys, "first", "ids"])

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, sha = None, None
        for f in frames:
            done = []
            for *key, ids in zip(*(f[k] for k in keys), f.ids, strict=True):
                if key != last:
                    if last is not None:
                        done.append((*last, sha.hexdigest()))
                    last, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=[*keys, "ends_sha256"])
        if last is not None:
            yield pd.DataFrame([(*last, sha.hexdigest())], columns=[*keys, "ends_sha256"])

    schema = "depth long, f0 long, f1 long, split int"
    ordered = ends.repartitionByRange(tasks, *keys, "c").sortWithinPartitions(*keys, "c").select(*keys, "c")
    cut = ordered.mapInPandas(pieces, f"{schema}, first long, ids string")
    return cut.repartition(tasks, *keys).sortWithinPartitions(*keys, "first").mapInPandas(digest, f"{schema}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, primes: tuple[int, int] = PRIMES, hash_bits: int = 64, family: int = 20, lend: int = 4) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the rebuilt conversations.

    ``primes`` and ``hash_bits`` may be lowered in tests, for collisions.
    """
    convs, rebuilt = rebuilt_turns(conversations, hash_bits, family, lend)
    prefixes, nodes = _settled(_fingerprinted(convs, rebuilt, primes))
    # what each conversation owns: its path from depth ``owns`` on (past its end: nothing), and perhaps a leaf
    owns = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.min("depth").alias("owns"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))
    owns = stored(convs.select("c", "length").join(owns, "c", "left").select("c", F.coalesce("owns", F.col("length") + 1).alias("owns"), F.coalesce("leaf", F.lit(0)).alias("leaf")))
    chunks = stored(prefixes.groupBy("c", "chunk").agg(F.count(F.lit(1)).alias("n")).join(owns, "c").select("c", "chunk", "owns", "leaf"))
    known = prefixes.join(chunks, ["c", "chunk"])
    shared = known.where(F.col("depth") == F.col("owns") - 1).select("c", F.col("words").alias("shared"))
    shared = chunks.select("c", "chunk").join(shared, "c", "left")
    full = known.join(shared, ["c", "chunk"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    saved = F.when(F.col("depth") < F.col("owns"), F.col("shared") - (F.col("words") - F.col("w"))).otherwise(0)
    begins = ((F.col("length") > F.col("depth")) & (F.col("owns") <= F.col("depth") + 1)).cast("long")
    parent = ("b0", "b1", "parent_split")
    summed = stored(
        full.groupBy(*NODE).agg(
            F.min("c").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.sum(begins).alias("n_children"),
            F.sum("leaf").alias("n_leaves"),
            F.sum(saved).alias("saved_tokens"),
            *(F.max(x).alias(x) for x in parent),  # the same for all members
        )
    )
    above = summed.select((F.col("depth") + 1).alias("depth"), *(F.col(x).alias(y) for x, y in zip(("f0", "f1", "split"), parent, strict=True)), F.col("conv_id").alias("parent_conv_id"))
    digests = _digests(prefixes.where("depth = length").select(*NODE, "c"))
    out = summed.join(above, ["depth", *parent], "left").join(digests, list(NODE), "left")
    out = stored(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")))
    free(convs, prefixes, nodes, owns, chunks, summed)
    return out
