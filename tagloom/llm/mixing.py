"""Mixing sources to target weights by entropy balancing.

Each document starts with one copy on average, as the mean of a binomial of `most`
copies. Among all rates whose words sum to each source's target, those that diverge least
from the start tilt a document's binomial exponentially by its words times its source's
multiplier, the solution of a convex dual. Newton steps find the multipliers of all
sources at once: each adds up gradient and curvature over the distributed table of
(source, size), which stands for all documents. The rates are then rounded to whole
copies: each document gets the whole part, and one more where a hash is below the rest,
shifted so that its source's words are used up. Histograms find that shift without
sorting a source in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

WEIGHTS = (5, 2, 1)
MOST = 3
#: Newton steps at most, and the miss, as a share of the target, from which on one more is the last.
NEWTON_STEPS, NEAR = 100, 1e-7
#: Sums over documents are of decimals, which come out alike in any order.
SUM = "decimal(28,9)"
#: Cells of a histogram of the hash, at each of two levels.
CELLS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with their rank (0, 1, ...) by code point, null last, without one task for all.

    Range partitions are numbered in order; each is offset by the rows before it.
    """
    ordered = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id())
    ordered = common.staged(ordered, "ordered").withColumns({"_part": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND((1 << 33) - 1)})
    parts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))  # as many as partitions
    before = parts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ordered.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_in")).drop("_at", "_part", "_in", "_before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, source_size) with target: shares of all words by weight.

    A target stops at `most` times its source's size; the excess is shared out again by
    weight, until none is above. Each round adds up two numbers.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = common.staged(ranked(sources).withColumn("weight", weight).withColumn("most", F.col("source_size") * most), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("most")
        n, capped, free = table.agg(F.count_if(above), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == full or not free:
            break
        full, level = n, (total - (capped or 0)) / free
    return table.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.col("most").cast("double")).alias("target"))


def tilted(t: Column, most: int = MOST) -> Column:
    """Mean copies of a binomial of `most` copies with mean 1, tilted by t."""
    return F.lit(float(most)) / (1 + (most - 1) * F.exp(-t))


def cells(sizes: DataFrame) -> DataFrame:
    """sizes (source_key, size) as source_key, size, n: as many rows as a source has sizes."""
    return sizes.where("size > 0").groupBy("source_key", "size").agg(F.count("*").alias("n"))


def multipliers(table: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """The multiplier t of each of sources (source_key, target, mean) that has a finite one.

    table: source_key, size, n. A document's rate is tilted(t * size / mean). The dual,
    sum over documents of log(mean of exp(t * copies * size / mean)) - t * target / mean,
    is convex; its gradient is words at these rates less target. A step is at most as long
    as t, or 1, and one that leaves what the signs of gradients so far allow is halved.
    """
    size, none = F.col("size").cast("double"), F.lit(None).cast("double")
    now = sources.select("source_key", "target", "mean", F.lit(0.0).alias("t"), none.alias("low"), none.alias("high"), F.lit(False).alias("done"))
    for _ in range(NEWTON_STEPS):
        rate = tilted(F.col("t") * size / F.col("mean"), most)
        words = F.sum((F.col("n") * size * rate).cast(SUM)).cast("double")
        curve = F.sum((F.col("n") * size * size / F.col("mean") * rate * (1 - rate / most)).cast(SUM)).cast("double")
        sums = table.join(now, "source_key").groupBy(*now.columns).agg((words - F.col("target")).alias("over"), curve.alias("curve"))
        low, high = F.when(F.col("over") < 0, F.col("t")).otherwise(F.col("low")), F.when(F.col("over") > 0, F.col("t")).otherwise(F.col("high"))
        most_step = F.greatest(F.lit(1.0), F.abs("t"))
        step = F.greatest(-most_step, F.least(most_step, F.col("over") / F.greatest(F.col("curve"), F.lit(1e-300))))
        to = F.col("t") - step
        inside = F.coalesce(to > low, F.lit(True)) & F.coalesce(to < high, F.lit(True))
        to = F.when(F.col("done") | (F.col("over") == 0), F.col("t")).when(inside, to).otherwise((low + high) / 2)
        done = F.col("done") | (F.abs("over") <= NEAR * F.col("target"))
        now = common.staged(sums.select("source_key", "target", "mean", to.alias("t"), low.alias("low"), high.alias("high"), done.alias("done")), "multipliers")
        if now.where("NOT done").isEmpty():
            break
    return now.select("source_key", "t")


def _hash(doc_id: Column, seed: int) -> Column:
    """A number from 0 to 1 of md5, uniform and the same on every run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"))), 1, 15), 16, 10).cast("long") / F.lit(float(1 << 60))


def _cut(docs: DataFrame, need: DataFrame, shift: int) -> DataFrame:
    """For each source the cell of v in which the words run out, and what they leave.

    docs: source_key, v (the place in the order), open (words); need: source_key, left.
    """
    cells = docs.groupBy("source_key", F.shiftright("v", shift).alias("cell")).agg(F.sum("open").alias("words"))
    running = F.sum("words").over(W.partitionBy("source_key").orderBy("cell"))
    at = cells.withColumn("upto", running).join(need, "source_key").where("upto > left")
    first = at.groupBy("source_key").agg(F.min("cell").alias("cell"))
    return at.join(first, ["source_key", "cell"], "left_semi").select("source_key", "cell", (F.col("left") - F.col("upto") + F.col("words")).alias("left"))


def _keyed(rows: DataFrame, seed: int) -> DataFrame:
    """rows (doc_id, text, source) with size, source_key and u beside their own columns."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    return rows.withColumns({"size": word_count(F.col("text")), "source_key": key, "u": _hash(F.col("doc_id"), seed)})


def _rated(rows: DataFrame, sources: DataFrame, total: int, most: int) -> DataFrame:
    """rows (size, source_key, u, ...) with base, the whole copies of their rate, v, their
    place in the order of those that get one more, and open, the words that one more has.

    Hot sources are broadcast; only rows of other sources are shuffled. Rows without words
    have a rate of one.
    """
    joined = common.lookup(rows, sources, "source_key", "source_rows", total)
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("t").isNull(), F.lit(float(most))).otherwise(tilted(F.col("t") * F.col("size") / F.col("mean"), most))
    joined = joined.withColumn("rate", rate).withColumn("base", F.floor("rate"))
    place = F.floor((F.col("u") - (F.col("rate") - F.col("base")) + 1) / 2 * float(1 << 60))
    return joined.withColumns({"v": F.least(place, F.lit((1 << 60) - 1)), "open": F.when(F.col("base") < most, F.col("size")).otherwise(0)}).drop("u")


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """For each source of sizes (doc_id, source, size, source_key, u) what its copies follow from.

    source_key, source_size, source_rows, target, mean (size of a document), t (null: all
    its documents get `most` copies), left: the words that are over after whole copies;
    stop: the document, in the order of v, at which one more ends; near: whether it still
    gets one.
    """
    sources = common.staged(sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows")), "sums")
    found = targets(sources.select("source", "source_size"), weights, most)
    found = found.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).join(sources.select("source_key", "source_rows"), "source_key")
    found = common.staged(found.withColumn("mean", F.col("source_size") / F.col("source_rows")), "targets")
    finite = found.where(F.col("target") < F.col("source_size") * most)
    table = common.staged(cells(sizes), "cells")
    found = common.staged(found.join(multipliers(table, finite, most), "source_key", "left").select("source_key", "source_size", "source_rows", "target", "mean", "t"), "rates")
    rated = common.staged(_rated(sizes.drop("source"), found, sizes.count(), most).select("doc_id", "source_key", "size", "base", "v", "open", "target"), "rated")
    used = rated.groupBy("source_key").agg((F.first("target") - F.sum(F.col("base") * F.col("size"))).alias("left"))
    need = common.staged(used.select("source_key", F.greatest(F.lit(0.0), F.col("left")).alias("left")), "left")

    # What one more copy may use up, found to within a cell of CELLS ** 2, then in order.
    bits = int(math.log2(CELLS))
    rated = rated.where("open > 0")
    coarse = common.staged(_cut(rated, need, 60 - bits), "coarse")
    inside = _in_cell(rated, coarse, 60 - bits)
    fine = common.staged(_cut(inside, coarse.select("source_key", "left"), 60 - 2 * bits), "fine")
    # Rows that repeat a document stand together.
    inside = _in_cell(inside, fine, 60 - 2 * bits).groupBy("source_key", "v", "doc_id", "size").agg(F.sum("open").alias("open"))
    order = W.partitionBy("source_key").orderBy("v", "doc_id", "size")
    last = inside.withColumn("upto", F.sum("open").over(order.rowsBetween(W.unboundedPreceding, 0))).join(fine.select("source_key", "left"), "source_key")
    last = last.where("upto > left").groupBy("source_key").agg(F.min(F.struct("v", "doc_id", "size", "open", "upto", "left")).alias("last"))
    near = F.col("last.upto") - F.col("last.left") < F.col("last.left") - F.col("last.upto") + F.col("last.open")
    last = last.select("source_key", F.struct("last.v", "last.doc_id", "last.size").alias("stop"), near.alias("near"))
    return common.staged(found.join(need, "source_key").join(last, "source_key", "left"), "plan")


def _copied(rows: DataFrame, ends: DataFrame, total: int, most: int) -> DataFrame:
    """rows (doc_id, size, source_key, u, ...) with copies, and what their source's plan says."""
    me = F.struct("v", "doc_id", "size")
    more = (F.col("left") > 0) & (F.col("open") > 0) & (F.col("stop").isNull() | (me < F.col("stop")) | ((me == F.col("stop")) & F.col("near")))
    return _rated(rows, ends, total, most).withColumn("copies", F.least(F.lit(most), F.col("base") + more.cast("long")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, size, source_size, target, copies, taken.

    size is the number of words, 0 for a null text. Rows with a null source form a source
    of their own, the last. taken = copies * size; a source's taken words miss its target
    by half a document at most. Rows that repeat a doc_id and its size share their copies, so that
    the miss may be half of their words; without a doc_id they come first. No
    text, no size or an empty table give no words, and 0 targets. Other columns are
    ignored. The same input gives the same result on every run.
    """
    sizes = common.staged(_keyed(docs.select("doc_id", "text", "source"), seed).drop("text"), "sizes")
    out = _copied(sizes.drop("source"), plan(sizes, weights, most), sizes.count(), most)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """docs with each row as often as the mix takes it, side by side; all columns stay."""
    rows = _keyed(docs.select("doc_id", "text", "source", F.struct("*").alias("_row")), seed).drop("text")
    sizes = common.staged(rows.drop("_row"), "sizes")
    out = _copied(rows.drop("source"), plan(sizes, weights, most), sizes.count(), most)
    return out.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def _in_cell(docs: DataFrame, cells: DataFrame, shift: int) -> DataFrame:
    """The documents in their source's cell, about one of CELLS; a hot source is in many cells."""
    part = docs.withColumn("_cell", F.shiftright("v", shift))
    return part.join(cells.select("source_key", F.col("cell").alias("_cell")), ["source_key", "_cell"], "left_semi").drop("_cell")
