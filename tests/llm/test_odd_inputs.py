"""Clashing columns, nulls in any column, very long texts and many repeated rows, for all operators."""

import hashlib
import time

from pyspark.sql import functions as F

from tagloom.llm import chat, exactdedup, langid, mixing, neardup, ppm, quality, secretscan, warc

CLASH = ["_digest", "_text", "_score", "_dropped", "_row", "_id", "_sha", "_kept", "size", "u", "lang_pred", "0", "_hot", "rows"]


def odd_docs(spark):
    rows = [(1, "the cat sat on the mat and saw the dog run", "en", "a"), (2, "the cat  sat on the mat and saw the dog run", "en", "a"), (3, "der Hund lief in das Haus und sah die Katze", "de", None), (None, "the mat of the dog", "en", "b"), (None, None, None, None), (5, "", None, ""), (6, "das Haus", None, "b"), (6, "das Haus", None, "b")]
    rows += [(10 + i, f"the dog of house {i} ran to the cat", "en", "a") if i % 2 else (10 + i, f"der Hund von Haus {i} lief zu der Katze", "de", "b") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *(F.lit(f"{c}!").alias(c) for c in CLASH))


def test_clashing_columns_stay(spark):
    docs = odd_docs(spark)
    for kept in (langid.identified_rows, exactdedup.kept_rows, neardup.kept_rows, mixing.mixed_rows):
        out = kept(docs)
        assert out.columns == docs.columns, kept
        found = out.collect()
        assert found and all(r[c] == f"{c}!" for r in found for c in CLASH), kept
        assert set(found) <= set(docs.collect())


def test_nulls_have_a_result(spark):
    docs = odd_docs(spark)
    n = docs.count()
    for result in (langid.identify(docs), mixing.mix(docs), quality.judge(docs), secretscan.detect(docs), exactdedup.exact_dedup(docs), neardup.near_duplicates(docs, 2)):
        assert result.count() == n
    scored = ppm.score_held_out(docs)
    assert scored.count() == n
    found = {(r.doc_id, r.text_sha256): r for r in exactdedup.exact_dedup(docs).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert found[None, empty].keep_id == 5 and not found[None, empty].kept and found[5, empty].kept
    near = [r for r in neardup.near_duplicates(docs, 2).collect() if r.doc_id is None]
    assert len(near) == 2 and all(r.component_id is None and r.kept for r in near)
    pages = spark.createDataFrame([(None, None, None, 1), (None, "u", "x" * 2000, 1), (7, None, "x" * 2000, 1)], "page_id long, url string, html string, sha1 int")
    assert sorted((r.page_id or 0, r.record_type) for r in warc.archive(pages).collect()) == [(0, "response"), (0, "response"), (7, "response")]


def test_no_labels_keep_rows_with_letters(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "12 !", None), (3, None, "en")], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.identified_rows(docs).collect()] == [1]


def test_many_copies_of_one_row(spark):
    began = time.time()
    rows = spark.range(60_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same " * 40).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    found = exactdedup.exact_dedup(rows).groupBy("doc_id", "keep_id", "group_size", "kept").count().collect()
    assert [tuple(r) for r in found] == [(1, 1, 60_000, True, 60_000)]
    assert exactdedup.kept_rows(rows).count() == 1
    assert neardup.near_duplicates(rows).where("component_id = 1 AND kept").count() == 60_000
    assert mixing.mix(rows).agg(F.sum("taken")).first()[0] in (60_000 * 40, 0, 60_000 * 80)
    assert time.time() - began < 200


def test_very_long_texts(spark):
    line = "a lot of words, secret = abcdefgh12 \n"
    long = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit(line), 200_000).alias("text"))
    short = spark.createDataFrame([(2, "a few words")], "doc_id long, text string")
    docs = long.unionByName(short).select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"))
    by = lambda df: {r.doc_id: r for r in df.collect()}
    assert by(mixing.mix(docs))[1].size == 1_400_000
    judged = by(quality.judge(docs))[1]
    assert judged.n_words == 1_400_000 and judged.base_failed and judged.n_dup_lines == 199_999
    assert by(secretscan.detect(docs))[1].n_assign == 200_000
    assert by(neardup.near_duplicates(docs, 2))[1].n_shingles == 7
    turns = docs.select(F.lit(1).cast("long").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("assistant").alias("role"), "text")
    assert by(chat.digests(chat.format_conversations(turns)).withColumnRenamed("conv_id", "doc_id"))[1].loss_chars == 200_000 * len(line) + len("a few words")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    again = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 10))
    found = {r.page_id: r for r in warc.archive(again, compression="gzip").collect()}
    assert (found[1].record_type, found[1].refers_to, found[1].payload_bytes) == ("revisit", 11, 200_000 * len(line)) and found[12].record_type == "response"
