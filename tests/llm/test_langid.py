import zlib

import numpy as np
import pytest

from tagloom.llm import langid

D = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    found = langid.identify(docs).collect()
    assert len(found) == len(lang)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98


def test_held_out_rows_lang_and_source_are_never_read(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(300)
    plain = {r.doc_id: tuple(r) for r in langid.identify(docs).collect()}
    from pyspark.sql import functions as F

    changed = docs.withColumns({"lang": F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")), "source": F.lit("other")})
    assert {r.doc_id: tuple(r) for r in langid.identify(changed).collect()} == plain


def test_kernel_by_brute_force():
    texts = ["the cat sat", "der hund lief", "the dog ran on", ""]
    model = langid.fit(texts[:3], ["en", "de", "en"])
    model.prepare()
    got = model.kernel(texts)

    def grams(text, n):
        data = langid.padded(text)
        return {data[i : i + n] for i in range(len(data) - n + 1)}

    known = [set().union(*(grams(t, n) for t in texts[:3])) for n in range(1, 4)]

    def kernel(a, b):
        total = 0
        for n in range(1, 4):
            x, y = grams(a, n) & known[n - 1], grams(b, n) & known[n - 1]
            total += len(x & y) / max(1, np.sqrt(len(x) * len(y))) / 3
        return total

    mine = sorted(kernel(t, s) for t in texts for s in texts[:3])
    assert np.sort(got.ravel()) == pytest.approx(mine, abs=1e-5)


def test_long_texts_go_in_blocks(monkeypatch):
    model = langid.fit(["the cat sat on", "der hund lief"], ["en", "de"])
    model.prepare()
    texts = ["the cat and der hund", "x", ""]
    whole = model.marks(texts)
    monkeypatch.setattr(langid, "BLOCK", 4)
    assert (model.marks(texts) == whole).all()


def test_odd_texts_and_tables(spark):
    rows = [(i, "the cat sat on the mat" if i % 2 else "der hund lief in das haus", "en" if i % 2 else "de", "s") for i in range(40)]
    rows += [(100, None, "en", "s"), (101, "", None, None), (102, "123 !!", "en", "s"), (103, "the cat " * 30000, None, "s"), (104, "der hund", None, "s"), (104, "der hund", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert {out[k].lang_pred for k in (100, 101, 102)} == {"und"} and out[100].score == 0
    assert out[103].lang_pred == "en" and out[104].lang_pred == "de"
    kept = langid.identified_rows(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(out) - {100, 101, 102}
    empty = docs.limit(0)
    assert langid.identify(empty).collect() == [] and langid.identified_rows(empty).collect() == []


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(docs).collect()] == ["und"]


def test_languages_of_long_texts_only_are_learnt(spark):
    rows = [(i, "the cat sat on the mat " * 1000, "en") for i in range(20)] + [(100 + i, "1" * 30_000 + "der hund lief in das haus " * 2000, "de") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(len(t) <= langid.SAMPLE_BYTES + langid.PIECES for t, _ in langid.sample(docs))
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert found == {d: x for d, _, x in rows}
    assert langid.identified_rows(docs).count() == len(rows)


def test_every_language_is_sampled(spark):
    docs = spark.createDataFrame([(i, f"word{i} text", f"x{i}") for i in range(450)], "doc_id long, text string, lang string")
    assert {x for _, x in langid.sample(docs)} == {f"x{i}" for i in range(450)}


def test_pieces_are_spread_over_the_text(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([("ab" * 8,), ("é" * 100 + "z" * 100,)], "text string")
    found = [r[0] for r in docs.select(langid.spread(F.col("text"), 16)).collect()]
    assert found[0] == "ab" * 8 and found[1].startswith("é") and found[1].endswith("z") and len(found[1].encode()) < 40
