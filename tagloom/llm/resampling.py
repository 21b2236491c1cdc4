"""Importance resampling towards a target distribution of hashed word runs.

One scan of a text keeps the CRC-32 states of the last n starts in a ring; each further
word extends every state by a space and the word, and begins one of its own. The states
are the hashes of all runs of 1 to n words; modulo a number of buckets they are emitted,
counted by document. Bucket counts of all documents and of the target give each bucket a
gain, and the sum of a document's gains, with noise that follows its id, is its score; the
documents of highest score are drawn without replacement.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, scans

#: Words of a lower-cased text: letters a-z, digits, and all beyond ASCII.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BUCKETS = 10_000
RUNS = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Hashes of a text that a task holds before it counts them.
BLOCK = 1 << 18
#: Parts of 1 by which the sketch of quantiles may miss a rank.
ACCURACY = 10_000

FEATURES = "doc_id long, n_words long, n_features long, features array<struct<bucket:int,n:long>>"


def ring(text: bytes, n: int):
    """Lists of CRC-32 states, one list a word: of the runs of 1 to n words that end there."""
    states: list[int] = []
    crc32 = zlib.crc32
    for found in WORDS.finditer(text):
        word = found.group()
        if states:
            longer = b" " + word
            states = [crc32(longer, s) for s in states]
        states.append(crc32(word))
        yield states
        if len(states) == n:
            states = states[1:]


def counted(text: bytes, n: int, buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of words of a lower-cased text, and its buckets with their counts."""
    words, held, whole = 0, [], None
    for states in ring(text, n):
        words += 1
        held += states
        if len(held) >= BLOCK:
            whole = (0 if whole is None else whole) + np.bincount(np.array(held, np.int64) % buckets, minlength=buckets)
            held = []
    found, times = np.unique(np.array(held, np.int64) % buckets, return_counts=True)
    if whole is None:
        return words, found, times
    whole[found] += times
    found = np.flatnonzero(whole)
    return words, found, whole[found]


def hashed(docs: DataFrame, n: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_features, features (bucket, n), by buckets.

    A document has `buckets` features at most, whatever its length. Null and empty texts
    have no words.
    """

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "text"):
                words, found, times = [], [], []
                for text in common.text_bytes(part.column("text"), lower=True):
                    w, f, t = counted(text, n, buckets)
                    words.append(w)
                    found.append(f)
                    times.append(t)
                sizes = np.array([len(f) for f in found])
                ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                flat, many = np.concatenate(found).astype(np.int32), np.concatenate(times).astype(np.int64)
                features = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat), pa.array(many)], names=["bucket", "n"]))
                total = pa.array([int(t.sum()) for t in times], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.int64()), total, features], names=["doc_id", "n_words", "n_features", "features"])

    return common.mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, FEATURES)


def bucket_counts(rows: DataFrame) -> DataFrame:
    """rows of hashed() -> bucket, n; a task passes on one row a bucket at most."""
    return rows.select(F.inline("features")).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(rows: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket: a thousand times the log ratio of smoothed shares, rounded down.

    The driver gets one number a bucket, which is a parameter and not the data's size.
    """
    size = lambda df: df.agg(F.sum("n_features")).first()[0] or 0
    all_s, all_t = size(rows), size(target)
    counts = rows.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    for name, df in (("s", rows), ("t", target)):
        counts = counts.join(bucket_counts(df).withColumnRenamed("n", name), "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") + 1 for c in "st")
    gain = F.floor(1000 * F.log(t * float(all_s + buckets) / (s * float(all_t + buckets))))
    return [g for _, g in sorted(counts.select("bucket", gain).collect())]


def weighed(rows: DataFrame, gains: list[int]) -> DataFrame:
    """rows of hashed() -> doc_id, n_words, n_features, weight: the gains of all features."""
    shared = rows.sparkSession.sparkContext.broadcast(np.array(gains, np.int64))

    def run(batches):
        for batch in batches:
            lists = batch.column("features")
            flat, lengths = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            bucket, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            upto = np.append(0, np.cumsum(shared.value[bucket] * n))
            ends = np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(upto[ends] - upto[ends - lengths])], names=["doc_id", "n_words", "n_features", "weight"])

    return common.mapped(rows, run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A thousand times a Gumbel variate of the id's digest, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, n: int = RUNS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text), target (text) -> doc_id, n_words, n_features, weight, score, rank.

    Of the documents with least_words or more, `percent` in a hundred are drawn, those of
    highest score first, ties by the smaller doc_id; rank is 1, 2, 3 ... in that order and
    null for all others. Null and empty texts have no features and a weight of 0. A null
    doc_id comes after others of its score, and its noise is that of an empty id. Repeated rows
    are ranked one by one. An empty target gives gains by the documents' own counts; empty
    docs give no rows. Other columns are ignored.
    """
    rows = common.staged(hashed(docs, n, buckets), "features")
    wanted = common.staged(hashed(target.select(F.lit(0).alias("doc_id"), "text"), n, buckets), "target")
    scored = weighed(rows, gains(rows, wanted, buckets)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = common.staged(scored, "scores")
    able = F.col("n_words") >= least_words
    many = scored.where(able).count()
    draws = percent * many // 100
    none = F.lit(None).cast("long").alias("rank")
    if not draws:
        return scored.select("*", none)
    # A sketch of quantiles spares most rows the sort; whether it does is no matter of the result.
    share = max(0.0, 1 - draws / many - 2 / ACCURACY)
    from_score = scored.where(able).agg(F.percentile_approx("score", share, ACCURACY)).first()[0]
    if scored.where(able & (F.col("score") >= from_score)).count() < draws:
        from_score = -(1 << 63)
    inside = able & (F.col("score") >= F.lit(from_score))
    # The last key tells repeated rows apart, so that ranges can.
    first = scored.where(inside).withColumns({"one": F.lit(1).cast("long"), "_row": F.monotonically_increasing_id()})
    ranked = scans.running(first, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("n_words"), F.col("_row")], sums=["one"])
    rank = F.when(F.col("upto_one") <= draws, F.col("upto_one")).alias("rank")
    return ranked.select(*scored.columns, rank).unionByName(scored.where(~inside).select("*", none))
