import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", "a", " ", "  two  spaces \n\n lines\n", "don't we'LL I'm 's", "ünïcode 日本語 😀 x² ½ Ⅷ", "tabs\t\tand\x1cseparators\x85", "under_score __init__ a_1", "<|endoftext|> stays text", "x" * 3000, "word " * 900, "1234567890 12 3.4", "é" * 500, "᠎​ zero", "𝒜𝓑 ꙮ ᱠ"]


def whole(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def check(found, texts, window):
    """Each id once, sequences without gaps, lengths that need no padding."""
    ids, sequences = {}, {}
    for r in found:
        got = np.frombuffer(r.ids, "<u4").tolist()
        assert len(got) == r.length > 0
        ids.setdefault(r.doc_id, {})[r.start] = got
        sequences.setdefault(r.sequence_id, {})[r.offset] = r.length
    for doc, text in texts.items():
        at, out = 0, []
        for start, got in sorted(ids[doc].items()):
            assert start == at
            at, out = at + len(got), out + got
        assert out == whole(text), doc
        assert {r.doc_tokens for r in found if r.doc_id == doc} == {len(out)}
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces.items()):
            assert offset == at
            at += length
        assert at == window or at < window and at & (at - 1) == 0


def test_odd_texts(spark):
    texts = dict(enumerate(TEXTS))
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in texts.items()], "doc_id long, text string, ids string, length int").repartition(4)
    for window in (1024, 16, 1):
        check(packing.pack(docs, PATH, window).collect(), texts, window)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed = packing.pack(docs, PATH).collect()
    check(packed, {r.doc_id: r.text for r in docs.collect()}, 1024)
    digests = packing.digests(packing.pack(docs, PATH)).collect()
    assert {(r.doc_id, r.start): r.ids_crc32 for r in digests} == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in packed}


def test_small_stores_and_blocks_change_nothing(monkeypatch):
    with open(PATH, encoding="utf-8") as file:
        made = file.read()
    texts = [t for t in TEXTS if t] + ["the cat sat on the mat, and then some more words " * 20]
    expected = [np.array(whole(t)[:-1], "<u2").tobytes() for t in texts]
    for name, value in (("STORE", 5), ("WHOLE", 64), ("LONG", 2)):
        monkeypatch.setattr(packing, name, value)
        encoder = packing.Encoder(made)
        assert [encoder.encode(t) for t in texts * 2] == expected * 2, name


def test_another_tokenizer_is_used_as_a_whole(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    docs = spark.createDataFrame([(1, "Some Words, here"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pack(docs, path, 64, end=7).orderBy("start").collect() if r.start == 0}
    assert (found[1] + found[2])[: len(found[1])] == (t.encode("Some Words, here", add_special_tokens=False).ids + [7])[: len(found[1])]


def test_sequences_and_repeated_rows(spark):
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text again").alias("text"))
    packed = packing.pack(rows, PATH, 256)
    n = len(whole("same text again"))
    assert packed.agg(F.sum("length")).first()[0] == 20_000 * n
    found = packing.sequences(packed)
    lengths = [len(r.ids) // 4 for r in found.select("ids").collect()]
    assert sum(lengths) == 20_000 * n and sum(x != 256 for x in lengths) <= 8
    assert all(r.starts == sorted(r.starts) and r.starts[0] == 0 and len(r.docs) == len(r.starts) for r in found.limit(20).collect())


def test_empty_table_and_bad_window(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, PATH).collect() == []
    with pytest.raises(ValueError):
        packing.pack(none, PATH, 1000)


def test_very_long_text(spark):
    docs = spark.range(1).select(F.lit(None).cast("long").alias("doc_id"), F.repeat(F.lit("a lot of words \n"), 200_000).alias("text"))
    out = packing.pack(docs, PATH).agg(F.sum("length"), F.max("doc_tokens"), F.count("doc_id"), F.max("sequence_id")).first()
    assert out[0] == out[1] and out[2] == 0 and out[3] >= out[0] // 1024 - 1


def test_pieces_of_many_documents():
    rng = np.random.default_rng(7)
    n = rng.integers(1, 60, 200)
    at = np.cumsum(n) - n
    for window in (1, 8, 64):
        total = int(n.sum()) // window * window
        inside = at + n <= total
        found = list(zip(*(x.tolist() for x in packing.windowed(at[inside], n[inside], window))))
        expected = [(row, *p) for row, (a, m) in enumerate(zip(at[inside].tolist(), n[inside].tolist())) for p in packing.pieces(a, m, total, window, [])]
        assert found == expected


def test_a_store_holds_what_a_task_meets_again():
    """A few thousand documents have over 200000 pre-tokens; none is encoded again on a second pass."""
    made, calls = [f" w{i}" for i in range(200_000)], []
    store = packing.Store(lambda piece: calls.append(piece) or b"")
    for piece in made * 2:
        store[piece]
    assert len(calls) == len(made)
