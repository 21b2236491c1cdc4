"""Exact deduplication with a log-structured merge index of text digests.

Tasks gather digests in memtables of bounded size and flush them as sorted runs; the
Parquet files of the runs carry bloom filters on the digest. Compaction merges the runs
by digest, and keeps of each the row to keep and the number of rows. Rows whose digest
occurs more than once are hits: a fixed-size bit filter picks them from a second scan,
and each hit's normalised text is compared with that of the row to keep. Should a
comparison fail (two texts with one digest), that digest's rows are grouped anew by text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MEMTABLE_ROWS = 50_000
#: Hits of one digest that are compared in one place; more are dealt out by salt.
SALT_ROWS = 512


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACE, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _order(n_chars: Column, doc_id: Column) -> Column:
    """What the row to keep has the least of: most code points, then the smallest doc_id, null last."""
    return F.struct((-n_chars).alias("c"), doc_id.isNull().alias("none"), doc_id.alias("i"))


def _known(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id), F.lit(-(1 << 63)))


def memtables(rows_most: int = MEMTABLE_ROWS):
    """Flushes (digest, doc_id, n_chars) as sorted runs; a digest is in a run once.

    A null doc_id comes after all others.
    """

    def flush(table: dict, run: int) -> pa.RecordBatch:
        keys = sorted(table)
        kept = [table[k] for k in keys]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(np.full(len(keys), run)), pa.array([None if k[1] else k[2] for k in kept], pa.int64()), pa.array([-k[0] for k in kept], pa.int64()), pa.array([k[3] for k in kept], pa.int64())],
            names=["digest", "run", "keep_id", "keep_chars", "group_size"],
        )

    def run(batches):
        table, number = {}, 0
        for batch in batches:
            for digest, doc, chars in zip(*(batch.column(i).to_pylist() for i in range(3))):
                old = table.get(digest)
                key = (-chars, doc is None, doc or 0)
                table[digest] = (*min(key, old[:3]), old[3] + 1) if old else (*key, 1)
                if len(table) >= rows_most:
                    yield flush(table, number)
                    table, number = {}, number + 1
        if table:
            yield flush(table, number)

    return run


RUN = "digest binary, run long, keep_id long, keep_chars long, group_size long"


class DigestIndex:
    """Sorted runs in a folder of the shared store; `level` 1 has each digest once."""

    def __init__(self, spark, path: str | None = None, memtable_rows: int = MEMTABLE_ROWS):
        self.spark, self.path, self.memtable_rows = spark, path or common.scratch(spark, "digests"), memtable_rows
        self.runs: list[str] = []
        self.written = 0
        self.merged: str | None = None

    def _write(self, df: DataFrame, name: str) -> str:
        self.written += 1
        path = f"{self.path}/{self.written:06d}-{name}"
        options = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(self.memtable_rows), "parquet.bloom.filter.max.bytes": str(1 << 17)}
        df.write.options(**options).parquet(path)
        return path

    def add(self, entries: DataFrame) -> None:
        """Flushes the memtables over (digest, doc_id, n_chars) as runs of level 0."""
        rows = common.mapped(entries.select("digest", "doc_id", "n_chars"), memtables(self.memtable_rows), RUN)
        self.runs.append(self._write(rows, "runs"))

    def compact(self) -> DataFrame:
        """Merges all runs with what was merged before; of a digest the best row stays."""
        parts = [*self.runs, *([self.merged] if self.merged else [])]
        rows = self.spark.read.schema(RUN).parquet(*parts)
        best = F.min(_order(F.col("keep_chars"), F.col("keep_id")))
        merged = rows.groupBy("digest").agg(best.alias("best"), F.sum("group_size").alias("group_size"))
        merged = merged.select("digest", F.lit(0).cast("long").alias("run"), F.col("best.i").alias("keep_id"), (-F.col("best.c")).alias("keep_chars"), "group_size").sortWithinPartitions("digest")
        self.merged, self.runs = self._write(merged, "merged"), []
        return self.entries()

    def entries(self) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(self.merged).drop("run")

    def contains(self, digests: list[bytes]) -> DataFrame:
        """The entries of a few digests; bloom filters and order let the scan skip the rest."""
        return self.entries().where(F.col("digest").isin(digests))


def _with_digest(docs: DataFrame, digest, hits: DataFrame) -> DataFrame:
    """id, norm, digest and `place`, a number of the row by which many are dealt out, of the
    rows whose doc_id may be among those of hits."""
    rows = docs.select(_known("doc_id").alias("id"), "text", F.monotonically_increasing_id().alias("place"))
    rows = rows.where(common.bit_filter(hits.select(_known("doc_id").alias("id")), "id"))
    return rows.select("id", normalised(F.col("text")).alias("norm"), "place").withColumn("digest", digest(F.col("norm")))


def mismatches(docs: DataFrame, hits: DataFrame, digest, total: int) -> DataFrame:
    """Digests of which some row's text differs from that of the row to keep.

    hits: doc_id, digest, keep_id and group_size of rows whose digest occurs more than
    once. Only these are read, normalised and shuffled, a digest with many of them in
    salted parts, each beside a copy of the one text to keep.
    """
    groups = hits.where("doc_id <=> keep_id").groupBy("digest").agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))
    groups = groups.select("digest", "keep_id", F.ceil(F.col("group_size") / SALT_ROWS).cast("int").alias("salts"))
    # A digest with salts has over SALT_ROWS rows; of those over total / HOT rows there are
    # HOT at most, which are broadcast. Below that share one salt will do.
    hot = groups.where((F.col("salts") > 1) & (F.col("salts") * SALT_ROWS * common.HOT > total)).select("digest", "salts")
    mine = _with_digest(docs, digest, hits)
    mine = mine.join(F.broadcast(hot), "digest", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    member = mine.select("digest", "norm", F.pmod(F.xxhash64("place"), F.col("salts")).cast("int").alias("salt"))
    keeper = mine.join(groups.select("digest", _known("keep_id").alias("id")), ["digest", "id"], "left_semi")
    # Rows that repeat the row to keep stand behind one of them.
    keeper = keeper.select("digest", "norm", "salts").dropDuplicates(["digest"])
    keeper = keeper.select("digest", F.col("norm").alias("keep_norm"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return member.join(keeper, ["digest", "salt"]).where("norm != keep_norm").select("digest")


def _found(docs: DataFrame, memtable_rows: int, digest) -> tuple[DataFrame, DataFrame]:
    """exact_dedup's rows with their digests, and those of them whose digest occurs more than once.

    Texts are normalised and hashed once; what follows reads digests, and the texts of
    hits alone.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), normalised(F.col("text")).alias("norm"))
    sha = [] if digest is sha256 else [F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")]
    entries = common.staged(rows.select("doc_id", "n_chars", digest(F.col("norm")).alias("digest"), *sha), "entries")
    index = DigestIndex(docs.sparkSession, memtable_rows=memtable_rows)
    index.add(entries)
    level = index.compact().drop("keep_chars")
    total = entries.count()
    columns = ["doc_id", "digest", "keep_id", "group_size", F.lower(F.hex("digest")).alias("text_sha256") if digest is sha256 else "text_sha256"]
    twice = level.where("group_size > 1")
    hits = common.staged(common.lookup(entries.where(common.bit_filter(twice, "digest")), twice, "digest", "group_size", total).select(columns), "hits")
    wrong = common.staged(mismatches(docs, hits, digest, total).distinct(), "mismatches")
    if wrong.isEmpty():
        return common.lookup(entries, level, "digest", "group_size", total).select(columns), hits
    good = common.lookup(entries.join(wrong, "digest", "left_anti"), level, "digest", "group_size", total).select(columns)
    again = rows.withColumn("digest", digest(F.col("norm"))).join(wrong, "digest", "left_semi").withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    groups = again.groupBy("digest", "norm").agg(F.min(_order(F.col("n_chars"), F.col("doc_id"))).alias("best"), F.count("*").alias("group_size"))
    split = again.join(groups, ["digest", "norm"]).withColumn("keep_id", F.col("best.i")).select("doc_id", "digest", "keep_id", "group_size", "text_sha256")
    split = common.staged(split, "split")
    return good.unionByName(split), hits.join(wrong, "digest", "left_anti").unionByName(split.where("group_size > 1"))


def exact_dedup(docs: DataFrame, memtable_rows: int = MEMTABLE_ROWS, digest=sha256) -> DataFrame:
    """docs (doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256, for each row.

    Texts are equal if they are so without white space. Of equal texts the row with the
    most code points stays, of those the smallest doc_id. A null text counts as empty;
    empty texts are equal. A null doc_id comes after all others. Rows that repeat a doc_id
    and its text count each, and share one verdict. Other columns are ignored. An empty table gives an empty result.
    """
    rows, _ = _found(docs, memtable_rows, digest)
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def kept_rows(docs: DataFrame) -> DataFrame:
    """docs without the rows that are copies of another; all columns stay, whatever their names.

    Where rows repeat a doc_id with an equal text, one of them stays. Only rows that may
    go or be repeated are normalised again and shuffled.
    """
    _, hits = _found(docs.select("doc_id", "text"), MEMTABLE_ROWS, sha256)
    same = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    each = hits.groupBy(same("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).agg(F.first(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("_kept"), F.count("*").alias("_n"))
    touched = common.staged(each.where("NOT _kept OR _n > 1").select("_id", "_sha", "_kept"), "touched")
    boxed = docs.select(same("doc_id").alias("_id"), F.col("text").alias("_text"), F.struct("*").alias("_row"))
    may = common.bit_filter(touched, "_id")
    # Rows that repeat both are combined before the join, so that they make no hot key there.
    mine = boxed.where(may).withColumn("_sha", F.sha2(normalised(F.col("_text")).cast("binary"), 256)).drop("_text").dropDuplicates(["_id", "_sha"])
    mine = mine.join(touched, ["_id", "_sha"], "left").where("_kept IS NULL OR _kept")
    return boxed.where(~may).select("_row").unionByName(mine.select("_row")).select("_row.*")
