"""Language-model scores by prediction by partial matching over bytes.

The training rows' byte 4-grams are counted; they are the leaves of a trie whose contexts
of three, two, one and no bytes are sums of them. A context gives the next byte its count,
and escapes to the next shorter one with the share of its distinct bytes (method C);
bytes that a longer context has seen are excluded from the shorter. Every context that
was counted is a node. Each node's 256 log probabilities are worked out once, and a text's
code length is a sum of look-ups: shorter contexts, and those of three bytes that hold
TABLE-th of the corpus or more, are in a bounded table, the others are met by a join.
Word counts for the unigram base score go the same way: frequent words by a bounded table,
the others by a join.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A context of three bytes is a node if it holds 1/NODES of the corpus: any that is counted.
NODES = 1 << 63
#: Contexts of three bytes in the broadcast table, and words in the table of frequent ones.
TABLE = 1 << 16
FREQUENT = 1 << 20
#: Distinct keys that a task gathers before it passes their counts on.
GATHERED = 1 << 20
#: The end of a text: as a byte one that UTF-8 never has, which also stands before a text.
EDGE = b"\xff"
END = np.uint64(0x454E44)
WORDS, GRAMS = 0, 1
#: Bytes of a text that are looked at at once.
BLOCK = 1 << 22


def held_out(doc_id: str = "doc_id") -> Column:
    return common.crc_mod(doc_id, 7) == 2


def _grams(texts: list[bytes]):
    """(4-grams as 32-bit integers, their texts' numbers or the one number) by blocks: all
    that end at a byte or at the end of a text, with three edges before it."""
    small = [i for i, t in enumerate(texts) if len(t) <= BLOCK]
    if small:
        data = np.frombuffer(b"".join(EDGE * 3 + texts[i] + EDGE for i in small), np.uint8)
        lengths = np.array([len(texts[i]) + 4 for i in small])
        codes = _codes(data)
        inside = np.ones(len(codes), bool)
        for back in (1, 2, 3):  # those that reach over into the next text
            inside[np.cumsum(lengths)[:-1] - back] = False
        yield codes[inside], np.repeat(small, lengths - 3)
    for i, text in enumerate(texts):
        if len(text) > BLOCK:
            framed = EDGE * 3 + text + EDGE
            for at in range(0, len(framed) - 3, BLOCK):
                codes = _codes(np.frombuffer(framed[at : at + BLOCK + 3], np.uint8))
                yield codes, np.full(len(codes), i)


def _codes(data: np.ndarray) -> np.ndarray:
    wide = data.astype(np.uint32)
    return wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]


class _Counts:
    """Counts of keys, gathered until there are GATHERED of them."""

    def __init__(self, kind: int):
        self.kind, self.keys, self.ns, self.size = kind, [], [], 0

    def add(self, values: np.ndarray) -> None:
        keys, ns = np.unique(values, return_counts=True)
        self.keys.append(keys)
        self.ns.append(ns)
        self.size += len(keys)

    def merge(self) -> None:
        keys = np.concatenate(self.keys)
        order = np.argsort(keys, kind="stable")
        keys, ns = keys[order], np.concatenate(self.ns)[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.keys, self.ns, self.size = [keys[first]], [np.add.reduceat(ns, first)], len(first)

    def flush(self, last: bool = False):
        if self.size < GATHERED and not last or not self.size:
            return
        self.merge()
        if self.size >= GATHERED // 2 or last:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(self.size, self.kind, np.int32)), pa.array(self.keys[0].astype(np.uint64).view(np.int64)), pa.array(self.ns[0].astype(np.int64))], names=["kind", "key", "n"])
            self.keys, self.ns, self.size = [], [], 0


def counts(docs: DataFrame) -> DataFrame:
    """kind, key, n: how often each word (by hash, END for ends) and each 4-gram occurs."""

    def run(batches):
        words, grams, ends = _Counts(WORDS), _Counts(GRAMS), 0
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = common.text_bytes(part.column("text"), lower=True)
                words.add(common.word_hashes(texts)[0])
                for codes, _ in _grams(texts):
                    grams.add(codes)
                ends += len(texts)
                yield from words.flush()
                yield from grams.flush()
        words.add(np.full(ends, END))
        yield from words.flush(last=True)
        yield from grams.flush(last=True)

    part = common.mapped(docs.select("text"), run, "kind int, key long, n long")
    return part.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def blended(levels: list[np.ndarray]) -> np.ndarray:
    """Probabilities of the 256 bytes, a row for each row of the first level's counts.

    levels: counts of the longest context first; each has as many rows, or one.
    """
    rows = levels[0].shape[0]
    p, mass, out = np.zeros((rows, 256)), np.ones((rows, 1)), np.zeros((rows, 256), bool)
    for level in levels:
        n = np.where(out, 0, level).astype(np.float64)
        total, seen = n.sum(1, keepdims=True), n > 0
        kinds = seen.sum(1, keepdims=True)
        kinds = np.where((out | seen).all(1, keepdims=True), 0, kinds)  # nothing to escape to
        some = total > 0
        p += np.where(some, mass * n / np.maximum(total + kinds, 1), 0)
        mass = np.where(some, mass * kinds / np.maximum(total + kinds, 1), mass)
        out |= seen
    rest = ~out
    return p + mass * rest / np.maximum(rest.sum(1, keepdims=True), 1)


def _nodes(short: np.ndarray, total: int):
    """From 4-gram counts of some contexts of two bytes to their nodes' log probabilities,
    as `logs` for those in the table and as the array `rare` for the others."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        key, n = rows.key.to_numpy(), rows.n.to_numpy()
        found = []
        pair = key >> 8 & 0xFFFF
        for ctx in np.unique(pair):
            mine = pair == ctx
            first, symbol = key[mine] >> 24, key[mine] & 255
            which, row = np.unique(first, return_inverse=True)
            deep = np.zeros((len(which), 256))
            np.add.at(deep, (row, symbol), n[mine])
            two = deep.sum(0)[None, :]
            lower = [two, short[ctx & 255][None, :], short.sum(0)[None, :]]
            found.append((2, int(ctx), np.log10(blended(lower)).astype(np.float32)[0].tobytes(), None))
            sums = deep.sum(1)
            kept = sums * NODES >= total
            if kept.any():
                logs = np.log10(blended([deep[kept], *lower])).astype(np.float32)
                for c, x, often in zip(which[kept], logs, sums[kept] * TABLE >= total):
                    found.append((3, int(c) << 16 | int(ctx), x.tobytes() if often else None, None if often else x))
        return pd.DataFrame(found, columns=["order", "context", "logs", "rare"])

    return run


class Trie:
    """For each three bytes the row of its longest node's log probabilities, or RARE where
    that node is not in the table. rare: a bit for each three bytes."""

    RARE = -1

    def __init__(self, short: np.ndarray, nodes: list[tuple[int, int, bytes]], rare: np.ndarray):
        # Rows of the contexts of one byte come first; an unseen one is the same as of none.
        ones = np.log10(np.concatenate([blended([short[c][None, :], short.sum(0)[None, :]]) for c in range(256)])).astype(np.float32)
        nodes = sorted(nodes)
        self.logs = np.concatenate([ones, np.frombuffer(b"".join(x for *_, x in nodes), np.float32).reshape(-1, 256)])
        self.places = [(order, context) for order, context, _ in nodes]
        self.rare = rare

    def __getstate__(self):
        return {"logs": self.logs, "places": self.places, "rare": self.rare}

    def prepare(self) -> None:
        two = np.tile(np.arange(256, dtype=np.int32), 256)
        rows = np.arange(256, 256 + len(self.places), dtype=np.int32)
        order, context = (np.array([p[i] for p in self.places], np.int64) for i in (0, 1))
        two[context[order == 2]] = rows[order == 2]
        self.row = np.tile(two, 256)
        self.row[context[order == 3]] = rows[order == 3]
        self.row[np.unpackbits(self.rare, bitorder="little") == 1] = self.RARE
        self.flat = self.logs.ravel()

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for codes, owner in _grams(texts):
            row = self.row[codes >> 8].astype(np.int64)
            logs = np.where(row == self.RARE, 0, self.flat[np.maximum(row, 0) << 8 | (codes & 255)])
            out += np.bincount(owner, logs, len(texts))
        return out

    def others(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text's number, 4-gram, times) of those whose context is a node out of the table."""
        found = []
        for codes, owner in _grams(texts):
            rare = self.row[codes >> 8] == self.RARE
            keys, times = np.unique(owner[rare].astype(np.uint64) << np.uint64(32) | codes[rare], return_counts=True)
            found.append((keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF), times))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        owner, keys, times = map(np.concatenate, zip(*found))
        return owner.astype(np.int64), keys.astype(np.int64), times.astype(np.int32)


def train(table: DataFrame) -> tuple[Trie, DataFrame, np.ndarray, np.ndarray, int, int]:
    """The trie, its nodes out of the table (context, rare), the frequent words' hashes and
    counts, all tokens and the distinct ones.

    The driver gets 256 * 256 sums, TABLE + 256 * 256 nodes, a bit for each of 256 ** 3
    contexts, and FREQUENT words and the end at most.
    """
    words, grams = table.where(F.col("kind") == WORDS), table.where(F.col("kind") == GRAMS)
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = words.where((F.col("n") * FREQUENT >= tokens) | (F.col("key") == int(END))).select("key", "n").toPandas().sort_values("key")
    short = np.zeros((256, 256))
    sums = grams.groupBy(F.expr("cast(key & 65535 as int)").alias("key")).agg(F.sum("n").alias("n")).toPandas()
    short[sums.key.to_numpy(np.int64) >> 8, sums.key.to_numpy(np.int64) & 255] = sums.n.to_numpy(np.float64)
    total = int(short.sum())
    bins = F.pmod(F.xxhash64(F.expr("(key >> 8) & 65535")), F.lit(1024))
    nodes = common.staged(grams.groupBy(bins.alias("bin")).applyInPandas(_nodes(short, max(total, 1)), "order int, context long, logs binary, rare array<float>"), "nodes")
    others = nodes.where(F.col("logs").isNull()).select("context", "rare")
    words64 = others.groupBy(F.expr("shiftright(context, 6)").alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(context % 64 as int))")).alias("word")).toPandas()
    rare = np.zeros(256**3 // 64, np.uint64)
    rare[words64.id.to_numpy(np.int64)] = words64.word.to_numpy(np.int64).view(np.uint64)
    trie = Trie(short, [(r.order, r.context, bytes(r.logs)) for r in nodes.where(F.col("logs").isNotNull()).select("order", "context", "logs").collect()], rare.view(np.uint8))
    order = np.argsort(frequent.key.to_numpy(np.int64).view(np.uint64), kind="stable")
    return trie, others, frequent.key.to_numpy(np.int64).view(np.uint64)[order], frequent.n.to_numpy(np.int64)[order], int(tokens), int(distinct)


def _uid(doc, texts: list[bytes]) -> pa.Array:
    """128 bits of a row's doc_id and text."""
    import xxhash

    return pa.array([xxhash.xxh3_128_digest(b"%d:" % (d or 0) + t) for d, t in zip(doc.to_pylist(), texts)], pa.binary())


def _places(hashes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, hashes), max(len(table) - 1, 0))
    return at, (table[at] == hashes) if len(table) else np.zeros(len(hashes), bool)


def score(docs: DataFrame, train_docs: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score.

    train_docs are what is learnt from, docs itself by default. Words are in lower case
    (A-Z), each text has one end more, and a null text is empty. base_score is the sum over
    a text's tokens of log10((c + 1) / (N + V + 1)); score is the log10 probability of its
    bytes and its end. Without training rows every byte is as likely as another, and
    base_score is 0. Repeated rows get equal results; an empty table none.
    """
    table = common.staged(counts(docs if train_docs is None else train_docs), "counts")
    trie, nodes, keys, ns, tokens, distinct = train(table)
    shared = docs.sparkSession.sparkContext.broadcast((trie, keys, ns))
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    unit = np.log10(tokens + distinct + 1)

    def parts(batches):
        for batch in batches:
            for part in common.slices(batch, "text", 1 << 21):
                texts = common.text_bytes(part.column("text"), lower=True)
                hashes, owner = common.word_hashes(texts)
                doc = part.column("doc_id")
                yield doc, _uid(doc, texts), texts, hashes, owner

    model = f"ppm-{uuid.uuid4().hex}"

    def ready():
        shared.value[0].prepare()
        return shared.value

    def prepared():
        return common.held(model, ready)

    def summed(batches):
        trie, keys, ns = prepared()
        end = int(ns[keys == END].sum()) if len(keys) else 0
        for doc, uid, texts, hashes, owner in parts(batches):
            at, known = _places(hashes, keys)
            logs = np.log10(ns[at[known]] + 1.0) if len(ns) else np.zeros(0)
            sums = np.bincount(owner[known], logs, len(texts)) + np.log10(end + 1.0)
            n = np.bincount(owner, minlength=len(texts)) + 1
            arrays = [doc, uid, n, np.bincount(owner[known], minlength=len(texts)) + (end > 0), sums, trie.scores(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["doc_id", "uid", "n_tokens", "known", "base", "score"])

    def rare(batches):
        _, keys, _ = shared.value
        for _, uid, texts, hashes, owner in parts(batches):
            _, known = _places(hashes, keys)
            hashes, owner = hashes[~known], owner[~known]
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            first = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))) if len(hashes) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(hashes))).astype(np.int32)
            # And a row a text, without a key, that counts how often the text is there.
            none, zeros = pa.nulls(len(uid), pa.int64()), np.zeros(len(uid), np.int32)
            arrays = [pa.concat_arrays([uid.take(pa.array(owner[first])), uid]), pa.concat_arrays([pa.array(hashes[first].view(np.int64)), none]), pa.array(np.concatenate([times, zeros]))]
            yield pa.RecordBatch.from_arrays(arrays, names=["uid", "key", "times"])

    def deep(batches):
        trie, _, _ = prepared()
        for _, uid, texts, _, _ in parts(batches):
            owner, codes, times = trie.others(texts)
            yield pa.RecordBatch.from_arrays([uid.take(pa.array(owner)), pa.array(codes >> 8), pa.array((codes & 255).astype(np.int32)), pa.array(times)], names=["uid", "context", "symbol", "times"])

    words = table.where((F.col("kind") == WORDS) & (F.col("n") * FREQUENT < tokens)).select("key", "n")
    # A word that training lacks adds nothing. Words and contexts that many texts share are dealt
    # out by text, and so are the rows of a text that is there many times.
    asked = common.staged(common.mapped(rows, rare, "uid binary, key long, times int"), "asked")
    looked = asked.where("times > 0")
    zero, no = F.lit(0.0), F.lit(0).cast("long")
    copies = asked.where("times = 0").select("uid", F.lit(1).cast("long").alias("copies"), zero.alias("more"), no.alias("more_known"), zero.alias("deep"))
    found = common.salted(looked, words, "key", "uid", looked.count())
    found = found.select("uid", no.alias("copies"), (F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.col("times").cast("long").alias("more_known"), zero.alias("deep"))
    steps = common.staged(common.mapped(rows, deep, "uid binary, context long, symbol int, times int"), "steps")
    met = common.salted(steps, nodes, "context", "uid", steps.count())
    met = met.select("uid", no.alias("copies"), zero.alias("more"), no.alias("more_known"), (F.col("times") * F.get("rare", F.col("symbol")).cast("double")).alias("deep"))
    found = copies.unionByName(found).unionByName(met).groupBy("uid").agg(*(F.sum(c).alias(c) for c in ("copies", "more", "more_known", "deep")))
    sums = common.staged(common.mapped(rows, summed, "doc_id long, uid binary, n_tokens long, known long, base double, score double"), "sums")
    out = common.lookup(sums, common.staged(found, "found"), "uid", "copies", sums.count())
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + (F.col("more_known") / F.col("copies")).cast("long")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more") / F.col("copies") - F.col("n_tokens") * F.lit(float(unit))).alias("base_score"),
        (F.col("score") + F.col("deep") / F.col("copies")).alias("score"),
    )


def score_held_out(docs: DataFrame) -> DataFrame:
    """score() of all docs, learnt from those that are not held out, with held_out."""
    found = score(docs, docs.where(~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
