"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: its share of all words by weight, capped
at ``max_repeats`` times its own words, the excess reshared by weight.  A
source that must give ``r`` times its words allocates ``floor(r)`` whole copies
of every document; the fraction left is an unequal-probability sample without
replacement whose size is fixed in words.  A document larger than the words due
takes no part.  Document *d* has inclusion
probability ``pi_d``, in proportion to the square root of its size; documents for which
this is 1 or more are taken first, and the others share the words left.  The rank is
``(U/(1-U)) / (pi_d/(1-pi_d))`` with ``U`` a hash of its id and seed; the
sample is the run of lowest ranks that reaches the words still due.

The run is cut without sorting a source in one place: ranks are counted in a
histogram of 4096 cells, its boundary cell in another of 4096, and only the
documents of that last cell (a 2^-24 part of a source) are put in order.  The
order then goes on past the document that did not fit: the documents left out that still fit are
run through in the same way, until none does.  If the smallest one left then brings a source nearer to its target
although it goes beyond it, it is taken as well; so a source ends within half of its smallest document left out.

DataFrame functions only.

Rules: a null or empty text has size 0 and is never taken.  A null source is a
source of its own, last in order.  Rows that repeat id, source and size are counted and
numbered, each number with a ``U`` of its own.  Equal ranks go by id, then number.  An empty table gives an
empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.ranking import with_position, with_running_sums
from pairloom.llm.common import let_go, stored, unit_hash

CELLS = 4096
#: Side tables have a row for each source; up to so many they are broadcast, beyond it they are joined by Spark's own choice.
BROADCAST_SOURCES = 100_000


def _per_source(df: DataFrame, sources: int) -> DataFrame:
    """``df``, a row for each source, marked for broadcast if the number of sources, which was counted, allows it."""
    return F.broadcast(df) if sources <= BROADCAST_SOURCES else df


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space, tab, LF, VT, FF and CR."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Weights repeat over the sources in code-point order, null last.  With
    sources ordered by cap / weight, the capped ones come first; the others get
    the words left, shared by the weights left.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.array(*(F.lit(float(x)) for x in weights))
    per = with_position(per, F.col("source").asc_nulls_last(), name="place")
    per = per.withColumn("weight", F.element_at(w, (F.col("place") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    # prefix sums over the sources by cap / weight, from a range sort: there may be as many sources as hosts
    per = with_running_sums(per, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], {"cap_run": "cap", "weight_run": "weight"})
    every = per.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    left = F.col("all_size") - F.col("cap_run") + F.col("cap")
    weight_left = F.col("all_weight") - F.col("weight_run") + F.col("weight")
    # left / weight_left rises as long as sources are capped and falls after: its peak is the level
    level = per.crossJoin(F.broadcast(every)).agg(F.max(left / weight_left).alias("level"))
    return per.crossJoin(F.broadcast(level)).select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: float = 3.0, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken (words, repeats counted), copies, and number (1, 2, ... among rows that repeat id, source and size)."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    # repeated rows are counted before they move, and numbered
    numbers = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("number")
    slim = stored(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")).select("doc_id", "source", "size", numbers))
    targets = source_targets(slim, weights, max_repeats)
    targets = stored(
        targets.withColumn("whole", F.floor(F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0)) + F.lit(1e-12)))
        .withColumn("most", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("source", "source_size", "target", "whole", "most")
    )
    sources = targets.count()
    certain = _certain(slim, targets, sources)
    targets = stored(
        targets.join(certain, F.col("source").eqNullSafe(F.col("m_source")), "left")
        .withColumn("due", F.col("most") - F.coalesce("certain_words", F.lit(0)))
        .select("source", "source_size", "target", "whole", "most", "certain_from", "due", "root_words")
    )
    t = _per_source(targets.withColumnRenamed("source", "t_source"), sources)
    pi = F.least(F.lit(0.999), F.greatest(F.lit(1e-9), F.col("due") * F.sqrt("size") / F.col("root_words")))
    u = unit_hash(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("size"), F.col("number"))
    ranked = slim.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    odds = (u / (1 - u)) / (pi / (1 - pi))
    fits = (F.col("size") > 0) & (F.col("most") >= 0.5) & (F.col("size") <= F.col("most"))
    sure = F.coalesce(fits & (F.col("size") >= F.col("certain_from")), F.lit(False))
    # rank / (1 + rank) keeps the order and lies in (0, 1)
    ranked = ranked.withColumns({"sure": sure, "rank": F.when(fits & ~sure, odds / (1 + odds)), "words": F.col("size")})
    kept = ["doc_id", "source", "size", "number", "source_size", "target", "whole", "most", "due", "rank", "in"]
    drawn = _run(ranked.where("rank is not null"), sources).select(*kept)
    drawn = stored(drawn.unionByName(ranked.where("rank is null").withColumn("in", F.col("sure").cast("int")).select(*kept)))
    drawn = _rounded(_fill(drawn, sources), sources)
    copies = F.col("whole").cast("long") + F.col("in")
    return drawn.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "number")


def _certain(slim: DataFrame, targets: DataFrame, sources: int) -> DataFrame:
    """For each source, of the documents that fit its words due: the least size taken for certain, the words of those, and the sum of size^1.5 of the others.

    Sizes go from the largest down: one is certain if its share of the words left by those before is 1 or more.
    """
    t = _per_source(targets.select(F.col("source").alias("m_source"), "most"), sources)
    at = slim.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).join(t, F.col("source").eqNullSafe(F.col("m_source"))).where("size <= most")
    down = W.partitionBy("m_source").orderBy(F.desc("size"))
    roots = F.col("n") * F.col("size") * F.sqrt("size")
    at = at.withColumns({
        "left": F.col("most") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "roots": F.sum(roots).over(down.rowsBetween(W.currentRow, W.unboundedFollowing)),
    }).withColumn("sure", F.col("left") * F.sqrt("size") >= F.col("roots"))
    return at.groupBy("m_source").agg(F.min(F.when(F.col("sure"), F.col("size"))).alias("certain_from"), F.sum(F.when(F.col("sure"), F.col("n") * F.col("size"))).alias("certain_words"), F.sum(F.when(~F.col("sure"), roots)).alias("root_words"))


def _run(rows: DataFrame, sources: int) -> DataFrame:
    """Rows (source, doc_id, rank, words, due) with ``in``: 1 for the run of lowest ranks of a source that stays within the words due."""
    cell = F.col("rank") * CELLS
    ranked = rows.withColumns({"cell": F.floor(cell).cast("int"), "fine": F.floor((cell - F.floor(cell)) * CELLS).cast("int")})
    cut = _boundary(ranked, ["source"], "cell", "due").withColumnsRenamed({"source": "c_source", "at": "cut_cell", "due_in": "cut_due"})
    ranked = ranked.join(_per_source(cut, sources), F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
    inside = ranked.where(F.col("cell") == F.col("cut_cell"))
    fine = _boundary(inside, ["source"], "fine", "cut_due").withColumnsRenamed({"source": "f_source", "at": "cut_fine", "due_in": "fine_due"})
    ranked = ranked.join(_per_source(fine, sources), F.col("source").eqNullSafe(F.col("f_source")), "left").drop("f_source")

    last = (F.col("cell") == F.col("cut_cell")) & (F.col("fine") == F.col("cut_fine"))
    run = F.sum("words").over(W.partitionBy("source").orderBy("rank", "doc_id", "number"))
    edge = ranked.where(last).withColumn("in", run <= F.col("fine_due"))
    # where no cell was cut the words due cover the whole source
    sure = F.col("cut_cell").isNull() | (F.col("cell") < F.col("cut_cell")) | ((F.col("cell") == F.col("cut_cell")) & (F.col("cut_fine").isNull() | (F.col("fine") < F.col("cut_fine"))))
    out = ranked.where(~F.coalesce(last, F.lit(False))).withColumn("in", sure).unionByName(edge)
    return out.withColumn("in", F.col("in").cast("int")).drop("cell", "fine", "cut_cell", "cut_due", "cut_fine", "fine_due")


def _boundary(rows: DataFrame, keys: list[str], cell: str, due: str) -> DataFrame:
    """For each source the first cell whose documents go past the words due, and the words due inside it."""
    cells = rows.groupBy(*keys, cell).agg(F.sum("words").alias("words"), F.max(due).alias("due"))
    so_far = F.sum("words").over(W.partitionBy(*keys).orderBy(cell))
    over = cells.withColumn("so_far", so_far).where(F.col("so_far") > F.col("due"))
    first = over.groupBy(*keys).agg(F.min_by(F.struct(cell, (F.col("due") - F.col("so_far") + F.col("words")).alias("due_in")), cell).alias("x"))
    return first.select(*keys, F.col(f"x.{cell}").alias("at"), F.col("x.due_in").alias("due_in"))


def _fill(drawn: DataFrame, sources: int) -> DataFrame:
    """Goes on in the order past what did not fit: runs through the documents left out that still fit, until none does.

    A run ends at a document that no longer fits, and its first one always fits, so every turn leaves fewer.
    """
    ranked = drawn.where("rank is not null")
    gaps = stored(ranked.groupBy(F.col("source").alias("g_source")).agg((F.max("due") - F.sum(F.col("in") * F.col("size"))).alias("gap")))
    units = ranked.where("in = 0").select("source", "doc_id", "size", "number", "rank", F.col("size").alias("words"))
    taken = None
    while True:
        g = _per_source(gaps, sources)
        open_ = stored(units.join(g, F.col("source").eqNullSafe(F.col("g_source"))).where("words <= gap").withColumnRenamed("gap", "due").drop("g_source"))
        if open_.isEmpty():
            break
        turn = stored(_run(open_, sources))
        won = turn.where("in = 1")
        if won.isEmpty():
            break
        taken = won if taken is None else taken.unionByName(won)
        more = won.groupBy(F.col("source").alias("w_source")).agg(F.sum("words").alias("more"))
        gaps = stored(gaps.join(more, F.col("g_source").eqNullSafe(F.col("w_source")), "left").select("g_source", (F.col("gap") - F.coalesce("more", F.lit(0))).alias("gap")))
        units = turn.where("in = 0").drop("due", "in")
        let_go(drawn.sparkSession)
    if taken is None:
        return drawn
    keys = taken.select(F.col("doc_id").alias("k_id"), F.col("source").alias("k_source"), F.col("size").alias("k_size"), F.col("number").alias("k_number"), F.lit(1).alias("added"))
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & F.col("source").eqNullSafe(F.col("k_source")) & (F.col("size") == F.col("k_size")) & (F.col("number") == F.col("k_number"))
    hit = F.col("rank").isNotNull() & F.col("added").isNotNull()
    return stored(drawn.join(keys, same, "left").withColumn("in", F.when(hit, 1).otherwise(F.col("in"))).drop("k_id", "k_source", "k_size", "k_number", "added"))


def _rounded(drawn: DataFrame, sources: int) -> DataFrame:
    """Takes the smallest document left out (then that of the least id) where it is less than twice what is still due."""
    gaps = drawn.groupBy(F.col("source").alias("g_source")).agg((F.max("most") - F.sum(F.col("in") * F.col("size"))).alias("gap"))
    left = drawn.where("in = 0 and size > 0").groupBy(F.col("source").alias("n_source")).agg(F.min(F.struct("size", "doc_id", "number")).alias("next"))
    more = left.join(gaps, F.col("n_source").eqNullSafe(F.col("g_source"))).where("next.size < 2 * gap").select("n_source", "next")
    out = drawn.join(_per_source(more, sources), F.col("source").eqNullSafe(F.col("n_source")), "left")
    hit = F.col("next").isNotNull() & F.struct("size", "doc_id", "number").eqNullSafe(F.col("next"))
    return out.withColumn("in", F.when(hit, 1).otherwise(F.col("in"))).drop("n_source", "next")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: float = 3.0, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, each as often as it was taken; columns unchanged."""
    mix = mix_sources(docs, weights, max_repeats, seed, id_col, text_col, source_col)
    taken = mix.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    mine = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    keyed = docs.select(mine, F.col(id_col).alias("k_id"), F.col(source_col).alias("k_source"), word_count(F.col(text_col)).alias("k_size"))
    same = F.col("k_id").eqNullSafe(F.col("doc_id")) & F.col("k_source").eqNullSafe(F.col("source")) & (F.col("k_size") == F.col("size"))
    met = keyed.join(taken, same)
    once = met.where("rows = 1").select("doc", "copies")
    # rows that repeat id, source and size share their copies evenly, the first in order of text taking what is over
    place = F.row_number().over(W.partitionBy("k_id", "k_source", "k_size").orderBy(F.col(f"doc.`{text_col}`")))
    over = met.where("rows > 1").withColumn("place", place).select("doc", F.expr("copies div rows + if(place <= copies % rows, 1, 0)").alias("copies"))
    return once.unionByName(over).where("copies > 0").select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc.*")
