"""An exact Jaccard join of shingle sets by PartEnum signatures.

Sets of sizes a <= b with a Jaccard similarity of at least g have b <= a / g and share at least
g (a + b) / (1 + g) features.  Sizes fall into bands [3^j, 3^(j+1)); a set takes part in the band of its
size and, if a partner may be larger than that band, in the next.  In a band the feature
domain is partitioned, and subsets of partitions are enumerated whose content is a signature, such
that linked sets share one.

At a similarity of 0.75 linked sets may differ in two sevenths of their features, so that coarse
partitions nearly all differ: the two-level enumeration (n1 groups, n2 - k2 of n2 partitions of a
group) would need more signatures than are sent here and would send those of a passage
that thousands of texts share from every one of them (see the README for figures).  The partition
used is therefore the finest, one feature a part, and the subsets enumerated are single parts, in one order of all
features.  Linked sets then share one of the first a - g (a + b) / (1 + g) + 1 features of either set.  So

* a set sends its first a - g (a + b') / (1 + g) + 1 features, b' being its smallest possible partner, and
* marks those that reach a partner of its own size or larger (about half of them): of two sets
  that meet, the smaller must have marked the signature.

The order is by value, but features frequent in a sample of the texts come last, the rarer
first, so that a text sends part of a common passage only if three quarters of it are that passage.
Any order gives the same result; this one only saves work.

Pairs are compared along leaders, not all with all.  Of each bucket (the sets that share a signature) about the
first 9 in hash order lead, each compared with the later members; buckets of more sets that do not yet lie in one
component go on with the next leaders, up to the 73rd, 585th, ..., compared with later members of other components.
Of the pairs that a parity sketch does not exclude, those are verified first in which a set shares most signatures
with its leader, then the others that still join two components.  Near copies by the thousand thus cost a few
comparisons each, and no link between components is lost.

A sketch has 512 bits, each the parity of the features that fall on it: two
sets differ in at least as many features as their sketches in bits.  Sets of more than WIDE features have a second
sketch of four to eight bits a feature.  Pairs are verified on their whole texts, which are smaller than their sets.

Signatures frequent in the sample are sent to many parts.  Where sets meet leaders, a bucket is dealt over one part for
every SETS_PER_PART sets, and its leaders go to each of these, so that only buckets of more sets copy them.
Equal sets are one node throughout: tasks send a node's signatures once, and
documents meet their node's component at the end.  A node is a 62-bit digest
of the set (and features are 64-bit hashes of shingles).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.llm.common import free, given_back, let_go, small_batches, stored
from pairloom.llm.components import connected_components
from pairloom.llm.textblocks import blocks, mix64, shingles

RATIO = 3
#: A frequent signature is dealt over 32 parts and one more for so many distinct sets.
ROWS_PER_SALT = 1_000_000
#: Sets of a bucket that meet its leaders in one part, about.
SETS_PER_PART = 2048
#: About so many sets of a bucket lead in the first round.
FIRST = 9
#: Longs of a sketch.
SKETCH = 8
_BITS = [f"s{i}" for i in range(SKETCH)]
#: Bits of a bitmap as a power of two: sixteen a row, within these bounds (128 KB and 16 MB).
BITMAP_BITS = (20, 27)
#: One text in so many is sampled for frequent features, of which so many are kept (8 bytes each).
SAMPLE_PART = 32
MAX_FREQUENT = 200_000
#: Sets of more features have a sketch of their own size.
WIDE = 256
#: Texts that Python is handed at a time, and pairs of them.
BATCH, PAIR_BATCH = 1000, 100
#: A task remembers so many nodes it has sent.
SEEN = 200_000


def digest(hashes: np.ndarray) -> int:
    """A 62-bit number that equal sets share; 0 for the empty set."""
    if not len(hashes):
        return 0
    total = np.array([mix64(hashes ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)]) + np.uint64(len(hashes))
    return int(mix64(total)[0] >> np.uint64(2)) + 1


def band_of(size: int) -> int:
    """Number of the band [3^j, 3^(j+1)) that holds ``size``."""
    j, top = 0, RATIO
    while size >= top:
        j, top = j + 1, top * RATIO
    return j


def shared_least(a: int, b: int, percent: int) -> int:
    """The fewest features that linked sets of these sizes share."""
    return -(-percent * (a + b) // (100 + percent))


def signatures(hashes: np.ndarray, percent: int, frequent: np.ndarray | None = None) -> list[tuple[np.ndarray, int, int]]:
    """For each band that the sorted set takes part in: (signatures, how many of the first are marked, from which on they are frequent).

    ``frequent`` holds features, the rarest first; a set that only an equal one comes near sends none.
    """
    a = len(hashes)
    least, largest = -(-percent * a // 100), 100 * a // percent
    if least == a == largest:
        return []
    order = hashes[np.argsort(mix64(hashes), kind="stable")]
    sure = a
    if frequent is not None and len(frequent[0]):
        values, ranks = frequent
        at = np.minimum(np.searchsorted(values, order), len(values) - 1)
        late = values[at] == order
        sure = a - int(late.sum())
        order = np.concatenate([order[~late], order[late][np.argsort(ranks[at[late]], kind="stable")]])
    own = band_of(a)
    top = RATIO ** (own + 1)
    out = []
    for nxt in (0, 1):
        if nxt and largest < top:
            break
        marked = a - shared_least(a, top if nxt else a, percent) + 1
        sent = marked if nxt else a - shared_least(a, least, percent) + 1
        sigs = mix64(order[:sent] + np.uint64((own + nxt) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        out.append((sigs, marked, min(sure, sent)))
    return out


def sketch(hashes: np.ndarray, longs: int = SKETCH) -> np.ndarray:
    """The parities of the features that fall on each of 64 * ``longs`` bits (a power of two), as longs."""
    at = mix64(hashes ^ np.uint64(0x51ED270153A9D7C1)) & np.uint64(64 * longs - 1)
    n = np.bincount(at.astype(np.int64), minlength=64 * longs)
    return np.packbits((n & 1).astype(np.uint8)).view(np.int64)


def wide_sketch(hashes: np.ndarray) -> np.ndarray | None:
    return sketch(hashes, 1 << (4 * len(hashes) // 64).bit_length()) if len(hashes) > WIDE else None


def bits_apart(a: np.ndarray, b: np.ndarray) -> int:
    """In how many bits two sketches differ, the longer one folded to the length of the other."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())  # of signed numbers it counts the absolute value


def _slim(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, n_shingles, node, wide, s0, ...) of every row."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in given_back(frames):
            for at, block in blocks(f.text):
                found = shingles(block, width)
                ids = f.doc_id.iloc[at : at + len(block)].astype("Int64").reset_index(drop=True)
                bits = np.stack([sketch(h) for h in found])
                yield pd.DataFrame({"doc_id": ids, "n_shingles": [len(h) for h in found], "node": [digest(h) for h in found], "wide": [wide_sketch(h) for h in found]} | {c: bits[:, i] for i, c in enumerate(_BITS)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInPandas(measure, "doc_id long, n_shingles long, node long, wide array<long>, " + ", ".join(f"{c} long" for c in _BITS))


def _frequent(docs: DataFrame, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """At most MAX_FREQUENT features that three or more distinct sets of one text in SAMPLE_PART hold: (sorted values, ranks, 0 the rarest)."""

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in given_back(frames):
            for _, block in blocks(f.text):
                found = shingles(block, width)
                yield pd.DataFrame({"feature": np.concatenate(found).view(np.int64)})

    text = F.col(text_col)
    part = docs.where(text.isNotNull() & (F.pmod(F.xxhash64(text), F.lit(SAMPLE_PART)) == 0)).select(text.cast("binary").alias("text")).distinct()
    met = part.mapInPandas(features, "feature long").groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    got = met.orderBy(F.desc("n"), "feature").limit(MAX_FREQUENT).toPandas()
    values = got.feature.to_numpy(dtype=np.int64).view(np.uint64)
    by_value = np.argsort(values)
    return values[by_value], (len(values) - 1 - np.arange(len(values)))[by_value]


def _sent(docs: DataFrame, text_col: str, width: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(sig, key, hot): key is twice the node plus whether the signature is marked, hot whether it is frequent in the sample."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for f in given_back(frames):
            for _, block in blocks(f.text):
                sigs, keys, hot = [], [], []
                for h in shingles(block, width):
                    if len(h) and (node := digest(h)) not in seen:
                        seen.add(node)
                        for s, marked, sure in signatures(h, percent, shared.value):
                            sigs.append(s)
                            keys.append(2 * node + (np.arange(len(s)) < marked))
                            hot.append(np.arange(len(s)) >= sure)
                if sigs:
                    yield pd.DataFrame({"sig": np.concatenate(sigs).view(np.int64), "key": np.concatenate(keys).astype(np.int64), "hot": np.concatenate(hot)})
                if len(seen) > SEEN:
                    seen.clear()

    return docs.select(F.col(text_col).cast("binary").alias("text")).mapInPandas(send, "sig long, key long, hot boolean")


def _place(number: Column | str, bits: int) -> Column:
    """Where a bitmap holds ``number``."""
    return F.pmod(F.xxhash64(number), F.lit(1 << bits))


def _held(rows: DataFrame, bitmap: np.ndarray, number: Column | str, on: bool = True) -> DataFrame:
    """The ``rows`` whose ``number`` has its place in the bitmap; the others, if not ``on``.  Nothing is shuffled.

    Spark's own expressions test the bits: a Python function would need a worker of its own in every task, beside the one that
    is handed the texts, and Spark keeps such workers, with their memory, for the stages that follow.
    """
    row = pa.table({"bitmap": pa.ListArray.from_arrays(pa.array([0, len(bitmap)], pa.int32()), pa.array(bitmap))})
    at = _place(number, (len(bitmap) * 64).bit_length() - 1)
    bit = F.getbit(F.get("bitmap", F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int"))
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(row)), bit == int(on)).drop("bitmap")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids of bounded size (BITMAP_BITS): no id is missed, and few others pass while it is sparse."""
    bits = min(max(BITMAP_BITS[0], (16 * ids.count()).bit_length()), BITMAP_BITS[1])
    at = _place("doc_id", bits)
    words = ids.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {1 << bits}) & 63 as int))")).alias("b"))
    got = words.toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[got.w.to_numpy(dtype=np.int64)] = got.b.to_numpy(dtype=np.int64)
    return out


def _texts(docs: DataFrame, nodes: DataFrame, text_col: str, id_col: str, width: int) -> DataFrame:
    """(node, text) of ``nodes`` (node, doc_id) and of a few others; where ids repeat some more than once.  Nothing is shuffled."""

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in given_back(frames):
            for _, block in blocks(f.text):
                yield pd.DataFrame({"node": [digest(h) for h in shingles(block, width)], "text": block})

    keyed = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("binary").alias("text"))
    return _held(keyed, _bitmap(nodes.select("doc_id")), "key").select("text").mapInPandas(named, "node long, text binary")


def jaccard_components(docs: DataFrame, threshold: float = 0.75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, node, component_id) for every row.

    Rules: a row without words or text has no set, 0 shingles and itself as its component;
    rows with equal sets are one node; where ids repeat, each row has its own
    set; a null id takes part and gets the smallest id of its component.  An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    with small_batches(docs.sparkSession, BATCH):
        slim = stored(_slim(docs, id_col, text_col, width))
    nodes = stored(slim.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), *(F.first(c).alias(c) for c in ["wide", *_BITS])))
    ids = stored(slim.select("doc_id", "n_shingles", "node"))
    free(slim)  # its sketches are in nodes, once a set
    comp = _linked(docs, nodes, round(100 * threshold), width, id_col, text_col)
    named = nodes.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    names = stored(named.join(least, "component").select("node", "component_id"))
    free(nodes, comp)
    return ids.join(names, "node", "left").select("doc_id", "n_shingles", "node", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _met(docs: DataFrame, text_col: str, width: int, percent: int, salts: int) -> DataFrame:
    """(sig, salt, node, marked, held, u): the signatures sent that may meet another set, how many sets (about) sent them, and the set's place in hash order, 0 to 1; stored.

    The salt is the set's part of its bucket, 0 but for buckets of SETS_PER_PART sets or more.
    """
    sent = _sent(docs, text_col, width, percent, _frequent(docs, text_col, width))
    node = F.shiftright("key", 1)
    sent = sent.select("sig", F.when(F.col("hot"), 1 + F.pmod(F.xxhash64(node), F.lit(salts))).otherwise(F.lit(0)).cast("int").alias("salt"), "key")
    by_sig = W.partitionBy("sig", "salt")
    mark = F.col("key").bitwiseAND(1)
    seen = sent.withColumns({"lo": F.min("key").over(by_sig), "hi": F.max("key").over(by_sig), "any": F.max(mark).over(by_sig), "held": F.count(F.lit(1)).over(by_sig)})
    meets = seen.where("salt > 0 or (any = 1 and shiftright(lo, 1) <> shiftright(hi, 1))")
    with small_batches(docs.sparkSession, BATCH):
        parts = stored(meets.groupBy("sig", "salt", node.alias("node")).agg((F.max(mark) == 1).alias("marked"), F.max("held").alias("held")))
    # at most MAX_FREQUENT features in two bands each
    whole = F.broadcast(parts.where("salt > 0").groupBy("sig").agg(F.count(F.lit(1)).alias("all_held")))
    u = F.shiftrightunsigned(F.xxhash64("node"), 11) / F.lit(float(1 << 53))
    out = parts.join(whole, "sig", "left").select("sig", "node", "marked", F.coalesce("all_held", "held").alias("held"), u.alias("u"))
    out = stored(out.select("sig", F.pmod(F.xxhash64("node"), _parts()).cast("int").alias("salt"), "node", "marked", "held", "u"))
    free(parts)
    return out


def _linked(docs: DataFrame, nodes: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, component) of every node that is linked with another; stored."""
    salts = 32 + nodes.count() // ROWS_PER_SALT
    met = _met(docs, text_col, width, percent, salts)
    found = _wide_near(_first_pairs(met, nodes, percent), nodes, percent)
    large = stored(met.where(f"held > {FIRST}"))
    free(met)
    need = found.select(F.explode(F.array("node", "b_node")).alias("node")).unionByName(large.select("node")).distinct()
    with small_batches(docs.sparkSession, BATCH):
        texts = stored(_texts(docs, nodes.select("node", "doc_id").join(need, "node", "left_semi"), text_col, id_col, width))
    comp = stored(nodes.select("node", F.col("node").alias("component")).limit(0))
    done, lo, hi = [found], FIRST, 8 * FIRST + 1
    while True:
        found = done[-1]
        best = F.max(F.struct("n", "b_node", "b_size")).alias("best")
        first = stored(found.groupBy("node", "size").agg(best).select("node", "size", "best.*"))
        for some in (first, found.join(first, ["node", "b_node"], "left_anti")):
            comp = _joined(comp, _verified(_apart(some, comp), texts, percent, width))
            let_go(docs.sparkSession)
        free(first)
        now = _open(large, comp, nodes, lo)
        free(large)
        large = now
        if now.isEmpty():
            break
        tried = reduce(DataFrame.unionByName, [d.select("node", "b_node") for d in done])
        later = _later_pairs(now, lo, hi, percent).join(tried, ["node", "b_node"], "left_anti")
        done.append(_wide_near(later, nodes, percent))
        lo, hi = hi, 8 * hi + 1
    free(large, texts, *done)
    return comp


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (node, component) with the components that ``links`` (a, b) join made one; both are stored tables and deleted."""
    if links.isEmpty():
        free(links)
        return comp
    merged = connected_components(links)
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
    old = comp.join(moved, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    new = merged.join(comp.select("node"), "node", "left_anti")
    out = stored(old.unionByName(new))
    free(comp, links, merged)
    return out


def _parts() -> Column:
    """Over how many parts the bucket of a row is dealt."""
    return F.expr(f"1 + held div {SETS_PER_PART}")


def _leads(now: DataFrame, lo: int, hi: int) -> DataFrame:
    """The rows of sets in place ``lo`` to ``hi`` of their bucket, for every part of it, their columns renamed."""
    lead = now.where((F.col("u") * F.col("held") >= lo) & (F.col("u") * F.col("held") < hi))
    lead = lead.withColumn("salt", F.explode(F.sequence(F.lit(0), (_parts() - 1).cast("int"))))
    return lead.select("sig", "salt", *(F.col(c).alias(f"b_{c}") for c in now.columns if c not in ("sig", "salt", "held")))


def _near(percent: int) -> Column:
    """Whether sizes and sketches of two sets (size, s0, ..., b_size, b_s0, ...) allow a link."""
    apart = reduce(add, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"b_{c}"))) for c in _BITS))
    least = F.expr(f"({percent} * (size + b_size) + {99 + percent}) div {100 + percent}")
    return (F.least("size", "b_size") * 100 >= F.greatest("size", "b_size") * percent) & (apart <= F.col("size") + F.col("b_size") - 2 * least)


def _first_pairs(met: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, b_node, size, b_size, n): sets and the first leaders of their buckets with which they may be linked, and in how many buckets they meet."""
    pairs = met.join(_leads(met, 0, FIRST), ["sig", "salt"]).where((F.struct("u", "node") > F.struct("b_u", "b_node")) & (F.col("marked") | F.col("b_marked")))
    pairs = pairs.groupBy("node", "b_node").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("marked")).alias("marked"), F.bool_or(F.col("b_marked")).alias("b_marked"), F.bool_or(F.col("marked") & F.col("b_marked")).alias("both"))
    few = nodes.select("node", "size", *_BITS)
    pairs = pairs.join(few, "node").join(few.select(*(F.col(c).alias(f"b_{c}") for c in few.columns)), "b_node")
    # of sets of different size the smaller must have marked the signature
    marks = F.col("both") | (F.col("marked") & (F.col("size") < F.col("b_size"))) | (F.col("b_marked") & (F.col("b_size") < F.col("size")))
    return pairs.where(marks & _near(percent)).select("node", "b_node", "size", "b_size", "n")


def _wide_near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` without those that the sketches of large sets exclude; stored."""
    pairs = stored(pairs)
    names = pairs.columns
    both_large = (F.col("size") > WIDE) & (F.col("b_size") > WIDE)
    large = pairs.where(both_large).select(*names)
    if large.isEmpty():
        return pairs
    # few in later rounds: only the sketches of these move
    ends = large.select(F.explode(F.array("node", "b_node")).alias("doc_id")).distinct()
    wide = _held(nodes.where(F.col("size") > WIDE).select("node", "wide"), _bitmap(ends), "node")

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            most = [a + b - 2 * shared_least(a, b, percent) for a, b in zip(f["size"], f.b_size, strict=True)]
            keep = [bits_apart(x, y) <= k for x, y, k in zip(f.wide, f.b_wide, most, strict=True)]
            yield f.loc[keep, names]

    large = large.join(wide, "node").join(wide.toDF("b_node", "b_wide"), "b_node")
    out = stored(pairs.where(~both_large).unionByName(large.select(*names, "wide", "b_wide").mapInPandas(near, pairs.schema)))
    free(pairs)
    return out


def _open(large: DataFrame, comp: DataFrame, nodes: DataFrame, lo: int) -> DataFrame:
    """Rows of the buckets of more than ``lo`` sets that lie in several components, with the set's component, size and sketch; stored."""
    now = large.where(f"held > {lo}").select("sig", "salt", "node", "marked", "held", "u").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = now.groupBy("sig").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.max("salt").alias("salt")).where("c0 <> c1")
    return stored(now.join(several.select("sig"), "sig", "left_semi").join(nodes.select("node", "size", *_BITS), "node"))


def _later_pairs(now: DataFrame, lo: int, hi: int, percent: int) -> DataFrame:
    """As ``_first_pairs``, for later leaders and sets of other components; excluded before any row is made of a pair."""
    may = (F.struct("u", "node") > F.struct("b_u", "b_node")) & (F.col("component") != F.col("b_component"))
    may &= (F.col("marked") | (F.col("size") > F.col("b_size"))) & (F.col("b_marked") | (F.col("b_size") > F.col("size")))
    pairs = now.join(_leads(now, lo, hi), ["sig", "salt"]).where(may & _near(percent))
    return pairs.groupBy("node", "b_node", "size", "b_size").agg(F.count(F.lit(1)).alias("n"))


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Those of the ``pairs`` whose sets lie in different components, with these (a, b)."""
    both = pairs.join(comp.toDF("node", "a"), "node", "left").join(comp.toDF("b_node", "b"), "b_node", "left")
    both = both.withColumns({"a": F.coalesce("a", "node"), "b": F.coalesce("b", "b_node")})
    return both.where("a <> b").select("node", "b_node", "size", "b_size", "a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b) of the ``pairs`` of which 100 times the intersection reaches ``percent`` times the union; stored.

    A leader that many sets try meets them in parts: Spark splits such a join (adaptive execution, on by default).
    """
    pairs = stored(pairs)
    ends = pairs.select(F.explode(F.array("node", "b_node")).alias("doc_id")).distinct()
    texts = _held(texts, _bitmap(ends), "node")  # few in later rounds: only these move

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            on = np.zeros(len(f), dtype=bool)
            for lo, block in blocks(f.text):
                ours, theirs = (shingles(b, width) for b in (block, list(f.b_text.iloc[lo : lo + len(block)])))
                for i, (x, y) in enumerate(zip(ours, theirs, strict=True)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    on[lo + i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield f.loc[on, ["a", "b"]]

    both = pairs.join(texts, "node").join(texts.toDF("b_node", "b_text"), "b_node").select("a", "b", "text", "b_text")
    with small_batches(pairs.sparkSession, PAIR_BATCH):
        out = stored(both.mapInPandas(linked, "a long, b long").distinct())
    free(pairs)
    return out


def keep_one(docs: DataFrame, threshold: float = 0.75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of every component: that with the smallest id, and all without words; columns unchanged.

    A bitmap of the ids to drop lets the other documents pass where they are;
    only documents that it holds (few, while it is sparse) meet the exact list of ids.
    Of rows that repeat both id and text one stays.
    """
    found = stored(jaccard_components(docs, threshold, width, id_col, text_col).select("doc_id", (F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()) | (F.col("n_shingles") == 0)).alias("stays")))
    per = found.groupBy("doc_id").agg(F.bool_or("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    doubtful = stored(per.where(~F.col("stays") | (F.col("n") > 1) | F.col("doc_id").isNull()))
    # whole rows travel packed, so that no name of theirs can clash
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    bitmap = _bitmap(doubtful)
    passed, rest = _held(packed, bitmap, "key", on=False), _held(packed, bitmap, "key")
    out = doubtful.where("not stays").select(F.col("doc_id").alias("out"))
    twice = doubtful.where("stays").select(F.col("doc_id").alias("twice"))
    rest = rest.join(out, F.col("key").eqNullSafe(F.col("out")), "left_anti")
    same = F.col("key").eqNullSafe(F.col("twice"))
    once, again = rest.join(twice, same, "left_anti"), rest.join(twice, same, "left_semi").dropDuplicates(["key", "text"])
    return passed.unionByName(once).unionByName(again).select("row.*")
