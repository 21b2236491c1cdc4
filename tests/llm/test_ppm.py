import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tagloom.llm import ppm


def lower(text):
    return (text or "").encode().lower()


def model(texts):
    """The trie by plain counting: counts of the next byte by context of 0 to 3 bytes."""
    trie = [defaultdict(Counter) for _ in range(4)]
    for t in texts:
        data = b"\xff\xff\xff" + t + b"\xff"
        for i in range(3, len(data)):
            for n in range(4):
                trie[n][data[i - n : i]][data[i]] += 1
    total = sum(sum(c.values()) for c in trie[0].values())
    return trie, total


def log_probability(trie, total, text):
    data, sum_ = b"\xff\xff\xff" + text + b"\xff", 0.0
    for i in range(3, len(data)):
        out, p, done = set(), 1.0, False
        for n in (3, 2, 1, 0):
            seen = trie[n].get(data[i - n : i])
            if n == 3 and seen and sum(seen.values()) * ppm.NODES < total:
                continue
            left = {s: c for s, c in (seen or {}).items() if s not in out}
            if not left:
                continue
            all_, kinds = sum(left.values()), len(left)
            if len(out | set(left)) == 256:
                kinds = 0
            if data[i] in left:
                p *= left[data[i]] / (all_ + kinds)
                done = True
                break
            p *= kinds / (all_ + kinds)
            out |= set(left)
        if not done:
            p /= 256 - len(out)
        sum_ += math.log10(p)
    return sum_


def brute(rows):
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", lower(t)) + [None]
    train = [(d, t) for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for _, t in train for w in words(t))
    n, v = sum(c.values()), len(c)
    trie, total = model([lower(t) for _, t in train])
    for d, t in rows:
        w = words(t)
        yield d, zlib.crc32(str(d).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), log_probability(trie, total, lower(t))


def same(found, expected):
    found, expected = sorted(map(tuple, found)), sorted(expected)
    assert [f[:5] for f in found] == [e[:5] for e in expected]
    for f, e in zip(found, expected):
        assert f[5:] == pytest.approx(e[5:], rel=1e-5, abs=1e-5)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string")
    same(ppm.score_held_out(docs).collect(), brute(rows))


def test_few_nodes_few_frequent_words_and_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(ppm, "NODES", 64)
    monkeypatch.setattr(ppm, "FREQUENT", 16)
    rows = [(i, f"The cat sat on mat {i % 7} {'É' * (i % 3)}") for i in range(60)] + [(100, None), (101, ""), (102, " \n "), (103, "zz " * 3000), (104, "\x00\x7f漢"), (105, "Kelvin K")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # Workers import the module anew, so the bounds are set in the driver alone where it matters.
    found = ppm.score_held_out(docs).collect()
    monkeypatch.undo()
    expected = list(brute(rows))
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in found) == sorted(e[:5] for e in expected)
    by = {e[0]: e[5] for e in expected}
    assert all(r.base_score == pytest.approx(by[r.doc_id]) for r in found)


def test_repeated_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "other"), (3, "a b"), (10, "a q"), (10, "a q")]
    found = ppm.score_held_out(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same(found, brute(rows))


def test_a_row_that_is_there_very_often(spark):
    """One row 20000 times, a word that training lacks in all others, and a rare context in all."""
    train = [(0, "the cat sat on the mat " * 12_000), (1, "xqzv jkwp")]
    rows = [(5, "xqzv unheard cat")] * 20_000 + [(i, f"unheard xqzv {i % 5}") for i in range(100, 3100)]
    found = ppm.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(train, "doc_id long, text string")).collect()
    trie, _ = model([lower(t) for _, t in train])
    assert sorted(r.doc_id for r in found) == sorted(d for d, _ in rows)
    # Known are xqzv and the end, and cat in the row that is there often.
    assert all(r.n_tokens == 4 and r.n_known == (3 if r.doc_id == 5 else 2) for r in found)
    exact = {t: log_probability(trie, 0, lower(t)) for t in {t for _, t in rows}}
    texts = dict(rows)
    assert all(r.score == pytest.approx(exact[texts[r.doc_id]], rel=1e-5, abs=1e-5) for r in found)


def test_long_texts_go_in_blocks(monkeypatch):
    texts = [b"", b"abc", b"the cat sat on the mat" * 3, b"x"]
    plain = [framed[i : i + 4] for t in texts for framed in [b"\xff\xff\xff" + t + b"\xff"] for i in range(len(framed) - 3)]
    for block in (1 << 22, 5, 1):
        monkeypatch.setattr(ppm, "BLOCK", block)
        found = [(i, int(c).to_bytes(4, "big")) for codes, owner in ppm._grams(texts) for c, i in zip(codes, owner)]
        assert sorted(c for _, c in found) == sorted(plain)
        assert [sum(i == k for i, _ in found) for k in range(4)] == [len(t) + 1 for t in texts]


def test_probabilities_add_up():
    rng = np.random.default_rng(0)
    levels = [rng.poisson(0.05, (7, 256)), rng.poisson(0.3, (1, 256)), rng.poisson(0.5, (1, 256)), rng.poisson(2, (1, 256))]
    levels[0][0] = 0
    levels[0][1] = 1
    p = ppm.blended(levels)
    assert p.sum(1) == pytest.approx(1) and (p[2:] > 0).all()


def test_no_training_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "ab c")], "doc_id long, text string")
    row = ppm.score(docs, docs.limit(0)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert row.score == pytest.approx(5 * math.log10(1 / 256), rel=1e-6)
    assert ppm.score_held_out(docs.limit(0)).collect() == []


def test_rare_contexts_are_nodes_too(spark):
    """Contexts that hold less than 1/65536 of the corpus, seen and unseen next bytes, copies."""
    common_text = "the cat sat on the mat " * 12_000
    train = [(0, common_text), (1, "xqzv jkwp"), (2, "xqzv 漢字 jkwq")]
    rows = [(10, "xqzv jkwp xqzv"), (11, "xqza 漢字x"), (11, "xqza 漢字x"), (12, "the cat"), (13, "")]
    found = ppm.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(train, "doc_id long, text string")).collect()
    trie, _ = model([lower(t) for _, t in train])
    expected = sorted((d, log_probability(trie, 0, lower(t))) for d, t in rows)
    assert [r[0] for r in sorted(map(tuple, found))] == [d for d, _ in expected]
    for r in found:
        assert r.score == pytest.approx(dict(expected)[r.doc_id], rel=1e-5, abs=1e-5), r.doc_id
