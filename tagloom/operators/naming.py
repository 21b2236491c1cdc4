"""Unique names, given in an order: each row gets the first name of its list that none has yet.

Rows of one group have one list of names, numbered from 0 on. Without other names in the
way, a group's row of rank r gets name r. A name that another group's row, or a file that
is there, has by then is a gap: the ranks behind it move up. Gaps are found by reading
names as (group, number), and by rounds that compare what rows of different groups have got.
Ranks are counted over range partitions, so that no group needs a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.operators.catalog import stored


def counted_within(rows: DataFrame, group: list[str], order: list[Column], into: str, flag: Column | None = None) -> DataFrame:
    """rows with how many rows (that have the flag) come before each in its group.

    group: columns without nulls; the order must be total. Rows are sorted in range partitions by group and order; counts
    within a partition are offset by those of the group in partitions before it.
    """
    ordered = rows.withColumn("_flag", (F.lit(True) if flag is None else flag).cast("long"))
    ordered = stored(ordered.orderBy(*group, *order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33))
    within = F.sum("_flag").over(W.partitionBy("_part", *group).orderBy("_at")) - F.col("_flag")
    parts = ordered.groupBy("_part", *group).agg(F.sum("_flag").alias("_n"))  # a group has one row a partition
    before = parts.withColumn("_before", F.sum("_n").over(W.partitionBy(*group).orderBy("_part")) - F.col("_n")).drop("_n")
    joined = ordered.withColumn("_within", within).join(before, ["_part", *group])
    return joined.select(*rows.columns, (F.col("_within") + F.col("_before")).alias(into))


def named_in_order(rows: DataFrame, group: list[str], seq: str, write: Callable[[Column], Column], read: Callable[[Column], Column], existing: DataFrame | None = None) -> DataFrame:
    """rows with name: the first of write(0), write(1), ... that no row before it in the order
    of seq, and no row of existing (name), has.

    group: columns that the list depends on, without nulls; write(k): a Column of these and k;
    read(name): an array of structs (group ..., k) of all lists that have the name. seq must
    differ from row to row.
    """
    rows = stored(counted_within(rows, group, [F.col(seq)], "_rank"), "ranked")
    kind = rows.schema[seq].dataType
    gap = lambda names, since: names.select(since.cast(kind).alias("_since"), F.inline(read(F.col("name")))).select(*group, "k", "_since")
    # A group's first row gets the first name, or another row got it before: later rows don't.
    firsts = rows.where("_rank = 0").select(write(F.lit(0).cast("long")).alias("name"), seq, *(F.col(g).alias(f"_{g}") for g in group))
    gaps = firsts.select(F.col(seq).alias("_since"), *(f"_{g}" for g in group), F.inline(read(F.col("name"))))
    own = F.lit(True)
    for g in group:
        own = own & (F.col(g) == F.col(f"_{g}"))
    gaps = gaps.where(~own).select(*group, "k", "_since")
    if existing is not None:
        gaps = gaps.unionByName(gap(existing.select("name").distinct(), F.lit(None)))
    while True:
        gaps = stored(_earliest(gaps, group).join(rows.select(*group).distinct(), group, "left_semi"), "gaps")
        named = stored(_named(rows, gaps, group, seq, write), "named")
        first = named.groupBy("name").agg(F.min(seq).alias("_since"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        late = stored(named.join(first, "name").where(F.col(seq) > F.col("_since")).select(*group, "k", "_since"), "late")
        if late.isEmpty():
            return named.drop("k", "_rank")
        gaps = gaps.unionByName(late)


def _earliest(gaps: DataFrame, group: list[str]) -> DataFrame:
    """One row for each group and number; a null _since is earlier than any."""
    least = F.min(F.struct(F.col("_since").isNotNull().alias("later"), F.col("_since")))
    return gaps.groupBy(*group, "k").agg(least["_since"].alias("_since"))


def _named(rows: DataFrame, gaps: DataFrame, group: list[str], seq: str, write: Callable[[Column], Column]) -> DataFrame:
    """rows with their number k and name, given the gaps (group ..., k, _since)."""
    mine = rows.select(*group, F.col(seq).alias("_since"), F.lit(None).cast("long").alias("k")).join(gaps.select(*group).distinct(), group, "left_semi")
    both = counted_within(mine.unionByName(gaps), group, [F.col("_since").asc_nulls_first(), F.col("k").asc_nulls_last()], "_rows", F.col("k").isNull())
    # A row that would get the name of a gap before the gap is made keeps it: no gap then.
    each = F.array_sort(F.collect_list(F.struct("k", F.col("_rows").alias("rows"))))
    made = lambda open_, g: F.when(g["k"] - F.size(open_) >= g["rows"], F.concat(open_, F.array(g["k"]))).otherwise(open_)
    by_group = both.where("k IS NOT NULL").groupBy(*group).agg(each.alias("_gaps"))
    by_group = by_group.withColumn("_gaps", F.aggregate("_gaps", F.array().cast("array<bigint>"), made))
    number = F.aggregate(F.coalesce("_gaps", F.array().cast("array<bigint>")), F.col("_rank"), lambda at, k: F.when(k <= at, at + 1).otherwise(at))
    found = rows.join(by_group, group, "left").withColumn("k", number).drop("_gaps")
    return found.withColumn("name", write(F.col("k")))


def numbered_behind(name: Column, first: int = 1) -> Column:
    """What a text reads as where <text>_<n> is the name of number n - first + 1: itself and 0, and
    the text before a number at its end with that number's place."""
    stem, number = F.regexp_extract(name, r"(?s)^(.*)_([1-9][0-9]*)$", 1), F.regexp_extract(name, r"(?s)^(.*)_([1-9][0-9]*)$", 2).try_cast("long")
    plain = F.array(F.struct(name.alias("stem"), F.lit(0).cast("long").alias("k")))
    return F.when(number >= first, F.concat(plain, F.array(F.struct(stem.alias("stem"), (number - first + 1).alias("k"))))).otherwise(plain)
