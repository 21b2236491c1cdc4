import hashlib
import math
import random
import re
import zlib

import duckdb
from pyspark.sql import functions as F

from tagloom.llm import registry, resampling, scans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    runs = [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
    return len(words), runs


def brute(docs, target, n, buckets, percent, least):
    bucket = lambda run: zlib.crc32(run.encode()) % buckets
    mine = [(d, *features(t, n)) for d, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for counts, lists in ((s, [r for _, _, r in mine]), (t, [features(x, n)[1] for x in target])):
        for runs in lists:
            for run in runs:
                counts[bucket(run)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for d, words, runs in mine:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(r)] for r in runs)
        rows.append((d, words, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[1]))
    drawn = [(*r, i + 1) for i, r in enumerate(able[: percent * len(able) // 100])]
    rest = rows.copy()
    for r in drawn:
        rest.remove(r[:5])
    return sorted(map(repr, drawn + [(*r, None) for r in rest]))


def odd_rows():
    random.seed(4)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x1", "İstanbul", "日本", "a"]
    texts = [None, "", " \n.,", "one", "\x00a\x7fb_c", "😀 SMILE 😀"] + [random.choice([" ", ", ", "\n"]).join(random.choices(words, k=random.randrange(60))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(7, texts[40])] * 30 + [(None, texts[41]), (None, None), (3, "word " * 25)]
    return rows, [None, "", "beta beta gamma", "été a alpha beta", "日本 x1"]


def test_against_brute_force(spark):
    rows, target = odd_rows()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, rank int, features string").repartition(5)
    wanted = spark.createDataFrame([(t, 9) for t in target], "text string, doc_id int")
    for n, buckets, percent, least in ((1, 10_000, 10, 20), (3, 97, 50, 5), (2, 7, 100, 0)):
        found = resampling.resample(docs, wanted, n, buckets, percent, least).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
        assert sorted(repr(tuple(r)) for r in found) == brute(rows, target, n, buckets, percent, least), (n, buckets)


def test_ring_extends_states():
    text = b"the cat sat on the mat and the cat ran"
    for n in (1, 2, 5, 50):
        runs = [x.encode() for x in features(text.decode(), n)[1]]
        assert sorted(s for states in resampling.ring(text, n) for s in states) == sorted(map(zlib.crc32, runs))


def test_blocks_of_a_long_text(monkeypatch):
    text = b"alpha beta gamma delta " * 3000
    whole = resampling.counted(text, 2, 50)
    monkeypatch.setattr(resampling, "BLOCK", 100)
    parts = resampling.counted(text, 2, 50)
    assert whole[0] == parts[0] == 12_000 and whole[1].tolist() == parts[1].tolist() and whole[2].tolist() == parts[2].tolist()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    assert [(r.doc_id, r.n_features, r.rank) for r in resampling.resample(some, none, percent=100).collect()] == [(1, 40, 1)]


def test_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    expected = con.sql(registry.OP11_SQL).select("doc_id", "n_features", "weight", "score", "rank").fetchall()
    found = registry.op11_resampling(spark, sf_dir).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in found)


def test_running_values_over_partitions(spark):
    """Sums and exclusive ors of groups that span many partitions, ties and repeated rows too."""
    random.seed(6)
    rows = [(g, random.randrange(50), random.randrange(-9, 9), random.getrandbits(63)) for g, n in ((1, 3), (2, 700), (3, 1), (9, 300)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g long, at long, x long, y long").withColumn("_row", F.monotonically_increasing_id())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for group in ("g", None):
            found = scans.running(df, [F.col(c) for c in ("g", "at", "_row")], sums=["x"], xors=["y"], group=group).orderBy("g", "at", "_row").collect()
            total, mixed, last = 0, 0, None
            for r in found:
                total, mixed = (r.x, r.y) if group and r.g != last else (total + r.x, mixed ^ r.y)
                last = r.g
                assert (r.upto_x, r.upto_y) == (total, mixed)
            assert len(found) == len(rows)
        assert scans.running(df.where("false"), [F.col("at")], sums=["x"]).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
