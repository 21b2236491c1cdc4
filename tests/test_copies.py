"""Near pairs with copies, and originals at large ids; against all pairs in plain Python."""

import random

import duckdb

from tagloom import registry
from tagloom.operators import duplicates


def test_all_pairs_of_copies(spark, monkeypatch):
    """Words and arrays of words, in several parts and with classes larger than a part."""
    monkeypatch.setattr(duplicates, "PART", 5)
    monkeypatch.setattr(duplicates, "CELL", 9)
    rng = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for width, most in ((64, 6), (256, 30)):
        base = [rng.getrandbits(width) for _ in range(4)]
        hashes = [rng.choice(base) ^ (1 << rng.randrange(width) if rng.random() < 0.4 else 0) for _ in range(70)]
        words = [[signed(h >> 64 * k & (1 << 64) - 1) for k in range(width // 64)] for h in hashes]
        rows = spark.createDataFrame([(i, w if width > 64 else w[0]) for i, w in enumerate(words)], "id long, hash " + ("array<long>" if width > 64 else "long"))
        expected = [(i, j, (hashes[i] ^ hashes[j]).bit_count()) for i in range(70) for j in range(i + 1, 70)]
        found = duplicates.all_pairs(rows, most, width).collect()
        assert sorted(map(tuple, found)) == sorted(x for x in expected if x[2] <= most), width


def test_comparing_all_is_dealt_out(spark, monkeypatch):
    """Each task has two parts at most, however many hashes there are."""
    monkeypatch.setattr(duplicates, "CELL", 10)
    rows = spark.createDataFrame([(i, i * 7919) for i in range(100)], "id long, hash long")
    assert duplicates._near(rows, None, 17, 64).rdd.getNumPartitions() >= 100


def test_queries_as_sql_with_copies_and_large_ids(spark, tmp_path):
    """Copies of vectors, and ids over 100000, where the SQL's number of a pair weighs more than a bit."""
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(25)]
    rows = [(i * 60001 % 900007, [x + rng.choice([0, 0, 0.25]) * rng.gauss(0, 1) for x in rng.choice(base)] if rng.random() < 0.6 else rng.choice(base), 0) for i in range(160)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    plain = lambda rows: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)
    for name in ("duplicate_best_originals", "duplicate_original_groups", "duplicate_pairs", "duplicate_pairs_narrowed", "duplicate_pairs_surviving", "duplicates_verified", "duplicate_pairs_wide"):
        df = registry.queries()[name](spark, str(tmp_path))
        columns = ", ".join(f'"{c}"' for c in df.columns)
        assert plain(map(tuple, df.collect())) == plain(con.execute(f"SELECT {columns} FROM ({registry.oracle_sql()[name]})").fetchall()), name
