"""Names given in order, against a loop over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import catalog, clusters, naming

POOL = ["a", "a_1", "a_2", "a_1_1", "a_1_2", "a_2_1", "b", "a_3", "a_1_1_1", "a_01"]


def by_loop(moves, existing):
    used, out = set(existing), {}
    for _, source, folder in moves:
        name = source.rsplit("/", 1)[1]
        dot = name.rfind(".")
        stem, suffix = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        tried = (f"{folder}/{stem}{f'_{k}' if k else ''}{suffix}" for k in range(10_000))
        out[source] = next(t for t in tried if t not in used)
        used.add(out[source])
    return out


def placed(spark, moves, existing=None):
    rows = spark.createDataFrame([(*m, []) for m in moves], "seq long, source string, folder string, sidecars array<string>")
    there = spark.createDataFrame([(p,) for p in existing], "path string") if existing is not None else None
    return {r.source: r.destination for r in clusters.destinations(rows, there).collect()}


def test_a_numbered_name_that_another_has(spark):
    moves = [(1, "x/a.png", "out"), (2, "y/a.png", "out"), (3, "z/a_1.png", "out")]
    assert placed(spark, moves) == {"x/a.png": "out/a.png", "y/a.png": "out/a_1.png", "z/a_1.png": "out/a_1_1.png"}
    assert placed(spark, moves[:1], ["out/a.png", "out/a_1.png", "out/a_3.png"]) == {"x/a.png": "out/a_2.png"}


@pytest.mark.parametrize("seed", range(4))
def test_random_names(spark, seed):
    rng = random.Random(100 + seed)
    moves = [(i, f"d{i}/{rng.choice(POOL)}{rng.choice(['.png'] * 4 + ['.jpg', ''])}", "out") for i in range(rng.choice([12, 30]))]
    existing = [f"out/{rng.choice(POOL)}.png" for _ in range(rng.choice([0, 4]))]
    assert placed(spark, moves, existing) == by_loop(moves, existing)


def test_many_files_of_one_name(spark):
    rows = spark.range(3000).select(F.col("id").alias("seq"), F.concat(F.lit("d"), F.col("id").cast("string"), F.lit("/a.png")).alias("source"), F.lit("out").alias("folder"), F.array().cast("array<string>").alias("sidecars"))
    there = spark.range(1, 500, 2).select(F.concat(F.lit("out/a_"), F.col("id").cast("string"), F.lit(".png")).alias("path"))
    found = clusters.destinations(rows, there).select("destination").collect()
    assert len({r[0] for r in found}) == 3000 and not {r[0] for r in found} & {r.path for r in there.collect()}


def test_counts_within_groups(spark):
    rows = spark.range(2000).select((F.col("id") % 3 % 2).alias("g"), F.col("id"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        found = naming.counted_within(rows, ["g"], [F.desc("id")], "n", F.col("id") % 2 == 0).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for g in (0, 1):
        count = 0
        for r in sorted((r for r in found if r.g == g), key=lambda r: -r.id):
            assert r.n == count
            count += r.id % 2 == 0


def test_stems_and_folders_in_order(spark):
    files = [("a", 1), ("a", 2), ("1_a", 3), ("a", 4), ("2_b", 5), ("b", 6), ("b", 7), ("b", 8), ("3_a", 9), ("1_a", 10)]
    out = {r.pos: r.name for r in catalog.unique_names(spark.createDataFrame(files, "stem string, pos long")).collect()}
    assert out == {1: "a", 2: "1_a", 3: "1_1_a", 4: "2_a", 5: "2_b", 6: "b", 7: "1_b", 8: "3_b", 9: "3_a", 10: "2_1_a"}
