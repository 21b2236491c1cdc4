import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from shingle_oracle import brute

from tagloom.llm import neardup


def run(spark, rows, k=2, **kw):
    table = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, id string")
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(table, k, **kw).collect())


def odd_rows():
    """A walk whose neighbours are similar but not its ends, copies, odd texts, and copies of
    one text with few or many edits, of which the first is far from most."""
    random.seed(3)
    words, rows = [f"w{i}" for i in range(60)], []
    for i in range(200):
        words[random.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, "  The same\ttext, THE same " + " ".join(map(str, range(30)))) for i in range(50)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, "One two"), (2007, "É"), (2008, "é"), (2009, "a b c d e f"), (2010, "a b c d e f g"), (2011, "w " * 50_000)]
    base = [f"v{i}" for i in range(100)]
    for i in range(300):
        words = list(base)
        for at in random.sample(range(100), 14 if i == 0 else random.choice([1, 3, 5, 7, 9])):
            words[at] = f"y{i}x{at}"
        rows.append((3000 + i, " ".join(words)))
    random.shuffle(rows)
    return rows


def test_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 32)
    rows = odd_rows()
    rows += [(10_000 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_five_words(spark):
    rows = odd_rows()[::2]
    assert run(spark, rows, k=5) == brute(rows, 5)


def test_repeated_rows_and_empty_table(spark):
    rows = [(5, "a b c"), (5, "a b c"), (7, "a b c")]
    assert run(spark, rows) == [(5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False)]
    assert run(spark, []) == []


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 2000 + i) for i in range(300)] + [(7, 7)]
    found = dict(map(tuple, neardup.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(301)} | {i: 1000 for i in [1000, *range(2000, 2300)]}


def test_registers_and_estimate():
    low = np.array([1 << 63, (1 << 63) - 1, 3, 1, 0, (1 << 64) - 1, 0x00F8_0000_0000_0000], np.uint64)
    for value, got in zip(low.tolist(), neardup.compressed(low).tolist()):
        if value:
            zeros = 64 - value.bit_length()
            mantissa = (value << (zeros + 1) & (1 << 64) - 1) >> (64 - neardup.MANTISSA)
            assert got == zeros << neardup.MANTISSA | mantissa
    rng = np.random.default_rng(0)
    for j in (0.0, 0.3, 0.8):
        n = 2000
        both = int(2 * n * j / (1 + j))
        x = rng.integers(0, 1 << 64, 2 * n - both, np.uint64)
        a, b = np.sort(x[:n]), np.sort(x[n - both :])
        equal = np.mean([(r[0] == r[1]).mean() for r in [neardup.registers([a, b])]])
        assert neardup.estimate(equal, np.array(len(a)), np.array(len(b))) == pytest.approx(j, abs=0.12)


def test_kept_rows(spark):
    text = " ".join(map(str, range(100)))
    rows = [(3, text + " x", 1), (2, text, 1), (9, "else", 1), (10, None, 1)]
    out = neardup.kept_rows(spark.createDataFrame(rows, "doc_id long, text string, kept int"))
    assert out.columns == ["doc_id", "text", "kept"]
    assert sorted(r.doc_id for r in out.collect()) == [2, 9, 10]
