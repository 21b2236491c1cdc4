import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tagloom.llm import exactdedup

ROWS = [(1, "a b"), (2, "ab"), (3, "a\n b"), (4, None), (5, " \t"), (6, "x" * 5000), (7, "x " * 5000), (8, "x " * 5000), (9, "é"), (9, "é"), (10, "e")]


def brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", text or "")].append((-len(text or ""), doc))
    return sorted((doc, min(g)[1], len(g), doc == min(g)[1], hashlib.sha256(norm.encode()).hexdigest()) for norm, g in groups.items() for _, doc in g)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, digest string")


def test_groups(spark):
    assert sorted(map(tuple, exactdedup.exact_dedup(frame(spark, ROWS), memtable_rows=2).collect())) == brute(ROWS)


def test_colliding_digests_are_told_apart(spark):
    weak = lambda text: F.sha2(text.cast("binary"), 256).substr(1, 1).cast("binary")
    rows = ROWS + [(100 + i, f"t{i % 37}") for i in range(200)]
    assert sorted(map(tuple, exactdedup.exact_dedup(frame(spark, rows), memtable_rows=5, digest=weak).collect())) == brute(rows)


def test_empty_table(spark):
    assert exactdedup.exact_dedup(frame(spark, [])).collect() == []


def test_hot_group(spark):
    rows = [(i, "same text") for i in range(3000)] + [(5000 + i, f"other {i}") for i in range(50)]
    assert sorted(map(tuple, exactdedup.exact_dedup(frame(spark, rows)).collect())) == brute(rows)


def test_kept_rows_keep_columns_and_one_of_repeats(spark):
    kept = exactdedup.kept_rows(frame(spark, ROWS))
    assert kept.columns == ["doc_id", "text", "digest"]
    assert sorted(r.doc_id for r in kept.select("doc_id").distinct().collect()) == sorted({b[1] for b in brute(ROWS)})


def test_index_takes_batches_and_compacts(spark):
    index = exactdedup.DigestIndex(spark, memtable_rows=3)
    entries = frame(spark, ROWS).select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), exactdedup.sha256(exactdedup.normalised(F.col("text"))).alias("digest"))
    index.add(entries.where("doc_id < 4"))
    index.compact()
    index.add(entries.where("doc_id >= 4"))
    found = {bytes(r.digest).hex(): (r.keep_id, r.group_size) for r in index.compact().collect()}
    assert found == {b[4]: (b[1], b[2]) for b in brute(ROWS)}
    some = bytes.fromhex(brute(ROWS)[0][4])
    assert [bytes(r.digest) for r in index.contains([some]).collect()] == [some]
