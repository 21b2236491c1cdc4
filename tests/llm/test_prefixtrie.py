import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from tagloom.llm import prefixtrie, registry

CONTRACT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, share=5, most=9):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    for turns in own.values():
        turns.sort()
    convs = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % most
        convs[conv] = [t[1:] for t in own.get(conv - conv % share, [])[:h]] + [t[1:] for t in turns[h:]]
    members, children, known, out = defaultdict(list), defaultdict(list), {}, []
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    for path in sorted(members, key=len, reverse=True):
        mine, below = members[path], [known[c] for c in children[path]]
        known[path] = sum(x for x, _ in below) or 1, sum(x for _, x in below) + (len(mine) - 1) * (len(path[-1][1]) if path else 0)
        ends = ",".join(str(c) for c in sorted(mine) if len(convs[c]) == len(path))
        out.append((min(mine), len(path), min(members[path[:-1]]) if path else None, len(mine), len(below), *known[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def found(df):
    rows = df.collect()
    assert sorted(r.position for r in rows) == list(range(len(rows)))
    by = {r.position: r for r in rows}
    for r in rows:  # a subtree is the interval from position to stop
        inside = [by[p] for p in range(r.position, r.stop + 1)]
        assert all(x.depth > r.depth for x in inside[1:]) and sum(x.n_children == 0 for x in inside) == r.n_leaves
        assert r.stop + 1 not in by or by[r.stop + 1].depth <= r.depth
    return sorted(repr(tuple(r[c] for c in CONTRACT)) for r in rows)


def random_rows():
    rng, rows = random.Random(3), []
    for conv in range(60):
        for turn in range(rng.choice([0, 1, 3, 3, 12, 30])):
            rows.append((conv, rng.choice([None, turn, turn, turn // 2]), rng.choice(["u", "a", None]), rng.choice(["x", "y", None, "zé", "x"])))
    return rows


def test_random_conversations(spark):
    rows = random_rows() + [(None, 1, "u", "x")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, node string").repartition(5)
    assert found(prefixtrie.prefix_trie(df)) == brute(rows)


def test_long_and_equal_conversations_over_many_partitions(spark):
    """One conversation holds a third of all rows, and many are equal."""
    rows = [(1000, t, "u", "x") for t in range(700)] + [(1001, t, "u", "x") for t in range(690)] + [(c, t, "u", "same") for c in range(2000, 2080) for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert sorted(repr(tuple(r)) for r in prefixtrie.prefix_trie(df).select(*CONTRACT).collect()) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_turnless_conversations_and_missing_bases(spark):
    # 7 % 5 != 0 and no conversation 5: its first turns are gone, all of them if it is short.
    rows = [(7, 0, "u", "a"), (9, 0, "u", "a"), (9, 1, "u", "b"), (11, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(prefixtrie.prefix_trie(df)) == brute(rows)


def test_repeated_rows(spark):
    rows = [(10, 0, "u", "a")] * 300 + [(15, 0, "u", "a")] * 200
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(prefixtrie.prefix_trie(df).where("depth < 5 OR depth > 0")) == brute(rows)


def test_digest_of_many_ids(spark, monkeypatch):
    df = spark.range(50_000).select((F.col("id") * 5).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("u").alias("role"), F.lit("hi").alias("text"))
    leaf = prefixtrie.prefix_trie(df).where("depth = 1").collect()
    assert [(r.n_convs, r.ends_sha256) for r in leaf] == [(50_000, hashlib.sha256(",".join(str(i * 5) for i in range(50_000)).encode()).hexdigest())]


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixtrie.prefix_trie(none).collect() == []


def test_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    expected = duckdb.connect().sql(registry.OP12_SQL.replace("FROM conversations", f"FROM '{sf_dir}/conversations.parquet'")).select(*CONTRACT).fetchall()
    assert sorted(map(repr, expected)) == brute(map(tuple, rows)) == sorted(repr(tuple(r[c] for c in CONTRACT)) for r in registry.op12_prefix_trie(spark, sf_dir).collect())
