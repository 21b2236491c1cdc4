import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers as P
import tiktoken

sys.path.insert(0, str(Path(__file__).parent))
from shingle_oracle import brute as near_brute

import corpus_pipeline
from tagloom.llm import bpe, common, mixing

SF = "/root/testdata/sf0.01"


def test_each_stage_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    # Language ID: what goes has no letters, or next to no words.
    docs = common.staged(corpus_pipeline.language_id(spark, docs, SF), "t0")
    assert docs.columns == columns
    left = {r.doc_id for r in docs.collect()}
    assert left <= set(rows) and all(len(rows[d].text) < 200 or not re.search(r"[^\W\d_]", rows[d].text) for d in set(rows) - left)
    # Exact copies.
    groups = defaultdict(list)
    for d in left:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", rows[d].text)].append((-len(rows[d].text), d))
    docs = common.staged(corpus_pipeline.exact_dedup(spark, docs, SF), "t1")
    assert docs.columns == columns
    kept = sorted(r.doc_id for r in docs.collect())
    assert kept == sorted(min(g)[1] for g in groups.values())
    # Near copies.
    docs = common.staged(corpus_pipeline.near_dedup(spark, docs, SF), "t2")
    assert docs.columns == columns
    expected = [d for d, _, c, _ in near_brute([(d, rows[d].text) for d in kept], 5) if d == c]
    assert sorted(r.doc_id for r in docs.collect()) == expected
    # The mix.
    taken = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    docs = common.staged(corpus_pipeline.mix_sources(spark, docs, SF), "t3")
    assert docs.columns == columns
    out = docs.collect()
    assert Counter(r.doc_id for r in out) == {d: n for d, n in taken.items() if n}
    assert all(r == rows[r.doc_id] for r in out)
    # The encoding.
    oracle = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(corpus_pipeline.VOCABULARY)), special_tokens={})
    last = corpus_pipeline.byte_bpe(spark, docs, SF).collect()
    assert len(last) == len(out)
    for r in last:
        ids = [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]
        assert ids == oracle.encode_ordinary(rows[r.doc_id].text) and r.n_tokens == len(ids)


def test_run_and_empty_tables(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "MinHash near-dedup", "mixing", "byte-level BPE"]
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.count() > 50 and found.columns[:2] == ["doc_id", "n_tokens"]
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_and_nulls(spark):
    rows = [(1, None, None, None, "n"), (2, "the cat of the house", "en", None, "n"), (2, "the cat of the house", "en", None, "n"), (3, "das Haus und der Hund", "de", "s", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, ""), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "size"]
    assert {r.doc_id for r in corpus_pipeline.byte_bpe(spark, docs, "").collect()} == {2, 3}
