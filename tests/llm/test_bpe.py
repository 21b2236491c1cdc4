import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken

from tagloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, " ", "Hello world, it's 12345 o'clock!!\n\n  done", "naïve ÈÉ 漢字 🙂🙂 \x00\x7f", "a" * 5000, "ab" * 3000 + " \t\r\n" * 50, "don't WON'T ▁x ▁▁", "#*$%&|<> " * 40, "  x́", "zyx" * 2000]


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_as_tiktoken(spark, oracle):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, ids int")
    found = bpe.round_trip(docs, PATH, P.PATTERN).collect()
    assert len(found) == 2 * len(TEXTS)
    for r in found:
        text = TEXTS[r.doc_id] or ""
        ids = oracle.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_documents_as_tiktoken(spark, oracle):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode(docs, PATH, P.PATTERN).collect():
        assert struct.unpack(f"<{len(r.ids) // 4}I", r.ids) == tuple(oracle.encode_ordinary(texts[r.doc_id]))
        assert bytes(r.decoded).decode() == texts[r.doc_id]


def test_store_starts_anew(oracle, monkeypatch):
    monkeypatch.setattr(bpe, "STORE", 3)
    coder = bpe.Coder(bpe.read_ranks(PATH), P.PATTERN)
    for text in [*TEXTS, "a b", "a b c d e", "a b x"]:
        ids = oracle.encode_ordinary(text or "")
        assert coder.encode(text or "") == struct.pack(f"<{len(ids)}I", *ids)


def test_long_texts_go_in_parts(oracle, monkeypatch):
    coder = bpe.Coder(bpe.read_ranks(PATH), P.PATTERN)
    text = " ".join(t or "" for t in TEXTS)
    whole = coder.encode(text)
    monkeypatch.setattr(bpe, "WHOLE", 40)
    assert coder.encode(text) == whole and coder.decode(whole) == text.encode()


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).collect() == []


def test_incomplete_ranks():
    with pytest.raises(ValueError):
        bpe.serialise({b"a": 0})
