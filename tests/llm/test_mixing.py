import math
import random
from collections import defaultdict

import pytest

from tagloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def rows(spark, data):
    return spark.createDataFrame([(d, t, s, "clash") for d, t, s in data], SCHEMA)


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by the rule itself: share out, stop at the most, share the excess again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full, rest = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in full]
        level = rest / sum(weight[s] for s in free) if free else 0
        new = {s for s in free if weight[s] * level > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in order}
        full |= new
        rest -= sum(most * sizes[s] for s in new)


def test_targets_and_taken(spark):
    random.seed(1)
    data = [(i, " ".join(["w"] * random.choice([0, 1, 5, 50, 400])), random.choice(["b", "a", "Z", "é", None, "b", "b", "c", ""])) for i in range(3000)]
    data += [(5000, None, "a"), (5001, "x y", "tiny"), (5001, "x y", "tiny")]
    out = mixing.mix(rows(spark, data)).collect()
    assert len(out) == len(data)
    source = {d: s for d, _, s in data}
    sizes, taken, given = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        given[source[r.doc_id]] = r.target
        assert 0 <= r.taken <= 3 * r.size
    expected = fill(sizes)
    for s in sizes:
        assert given[s] == pytest.approx(expected[s])
        assert abs(taken[s] - expected[s]) <= 201
    again = mixing.mix(rows(spark, data[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def rate(t, x, most=3):
    return most / (1 + (most - 1) * math.exp(min(700, -t * x)))


def bisected(sizes, target):
    """The multiplier at which the tilted rates of documents of these sizes have the target's words."""
    mean, low, high = sum(sizes) / len(sizes), -1e6, 1e6
    for _ in range(200):
        t = (low + high) / 2
        low, high = (low, t) if sum(n * rate(t, n / mean) for n in sizes) > target else (t, high)
    return low


def test_newton_solves_the_dual_of_each_source(spark):
    random.seed(2)
    groups = {f"s{i}": [random.choice([0, 1, 2, 30, 31, 500, 20_000 if i == 3 else 7]) for _ in range(60)] for i in range(6)} | {"one": [1], "same": [9] * 5}
    part = {"s0": 1e-5, "s1": 0.3, "s2": 1.0, "s3": 0.9, "s4": 2.2, "s5": 2.99999, "one": 0.5, "same": 1.5}
    sizes = spark.createDataFrame([(s, n) for s, g in groups.items() for n in g], "source_key string, size long")
    sources = spark.createDataFrame([(s, sum(g) * part[s], sum(g) / len(g)) for s, g in groups.items()], "source_key string, target double, mean double")
    found = dict(map(tuple, mixing.multipliers(mixing.cells(sizes), sources).collect()))
    for s, g in groups.items():
        mean = sum(g) / len(g)
        assert sum(n * rate(found[s], n / mean) for n in g) == pytest.approx(sum(g) * part[s], rel=1e-8)
        assert found[s] == pytest.approx(bisected(g, sum(g) * part[s]), rel=1e-5, abs=1e-9)
    assert found["s2"] == 0


def test_copies_round_the_rates_of_documents(spark):
    random.seed(3)
    data = [(i, " ".join(["w"] * random.choice([1, 5, 50, 400])), "abcd"[min(3, i % 7)]) for i in range(1500)]
    out = mixing.mix(rows(spark, data)).collect()
    source = {d: s for d, _, s in data}
    for s in "abcd":
        mine = [r for r in out if source[r.doc_id] == s]
        target, size = mine[0].target, sum(r.size for r in mine)
        if target >= 3 * size:
            assert all(r.copies == 3 for r in mine)
            continue
        t, mean = bisected([r.size for r in mine], target), size / len(mine)
        for n in (1, 5, 50, 400):
            alike = [r.copies for r in mine if r.size == n]
            expected = rate(t, n / mean)
            assert set(alike) <= {math.floor(expected), math.floor(expected) + 1}
            assert sum(alike) / len(alike) == pytest.approx(expected, abs=3.5 * 0.5 / len(alike) ** 0.5)


def test_repeated_rows_odd_columns_and_a_hot_source(spark):
    data = [(1, "a b c", "hot")] * 400 + [(None, "x y", "hot"), (None, None, None), (7, "z " * 300_000, "long")] + [(10 + i, "w " * (i % 9), "cold") for i in range(300)]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in data], "doc_id long, text string, source string, u int, v int, copies int")
    out = mixing.mix(table).collect()
    assert len(out) == len(data) and all(0 <= r.taken <= 3 * r.size for r in out)
    back = mixing.mixed_rows(table)
    assert back.columns == table.columns
    counts = defaultdict(int)
    for r in back.collect():
        counts[r.doc_id, r.source] += 1
    taken = defaultdict(int)
    for r in out:
        taken[r.doc_id] += r.copies
    assert {d: sum(n for (x, _), n in counts.items() if x == d) for d in taken} == taken


def test_empty_table_and_no_words(spark):
    assert mixing.mix(rows(spark, [])).collect() == []
    out = mixing.mix(rows(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in out) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
