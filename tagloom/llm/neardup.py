"""Near-duplicates by HyperMinHash sketches of word-shingle sets.

A set's hashes fall into buckets, equal ranges of values; of each bucket's smallest hash a
register keeps the number of leading zeros and a few mantissa bits, and an empty bucket
has the register of another, in an order of its own. Rows with one set are one class. Bands of
registers are keys; in each band's bucket all classes are compared with its smallest
one, the hub. What the sketches, corrected for chance collisions of registers, let pass
is verified on full sets. Links join classes into components. In a bucket whose classes
are then in more than one component, the rest of its pairs is compared by sketches too,
block by block, and where sketches are similar enough the block's full sets are compared
in place, so that no link is lost for want of a hub, and pairs that are none are never
written as rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bands and registers in a band. Two sets of Jaccard similarity 0.8 share no band with
#: a chance of (1 - 0.8 ** REGISTERS) ** BANDS, 6e-7.
BANDS, REGISTERS = 36, 5
#: Bits of a register: leading zeros above, MANTISSA bits of the minimum below.
MANTISSA = 10
#: An estimate this far below the bound, five standard deviations, needs no verification; one
#: of sets of under SMALL elements together, of which some share a bucket, twice as far.
SLACK, SMALL = 0.15, 64
#: Classes in a block of a bucket's remaining pairs, and rows that a task compares at a time.
BLOCK, TASK_ROWS = 1024, 10_000
_PROBES = None


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of k words; of fewer words, that of them all."""
    n = len(words)
    if not n:
        return words
    m = min(k, n)
    h = common.mixed(words[: n - m + 1] + np.uint64(m))
    for i in range(1, m):
        h = common.mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[i : n - m + 1 + i])
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) > 1 else h


def probes() -> np.ndarray:
    """For each bucket all buckets in an order of its own: where it looks for a register if empty."""
    global _PROBES
    if _PROBES is None:
        n = BANDS * REGISTERS
        _PROBES = common.mixed(np.arange(1, n * n + 1, dtype=np.uint64)).reshape(n, n).argsort(1)
    return _PROBES


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each sorted set: of each bucket's smallest hash the number of
    leading zeros (6 bits) and the bits below the first one (MANTISSA bits). Empty sets get zeros."""
    n = BANDS * REGISTERS
    out, there = np.zeros((len(sets), n), np.uint16), np.zeros((len(sets), n), bool)
    joined = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket = ((joined >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    # Sets are sorted, so a bucket's first hash is its smallest.
    place = owner * n + bucket.astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    edge = np.array([-(-(b << 32) // n) << 32 for b in range(n)], np.uint64)
    # The place in the bucket, stretched to 64 bits; n would overflow at a bucket's end.
    low = (joined[first] - edge[bucket[first]]) * np.uint64(n - 1)
    out.ravel()[place[first]] = compressed(low)
    there.ravel()[place[first]] = True
    for i in np.flatnonzero(there.any(1) & ~there.all(1)):
        empty = np.flatnonzero(~there[i])
        order = probes()[empty]
        out[i, empty] = out[i, order[np.arange(len(empty)), there[i][order].argmax(1)]]
    return out


def compressed(low: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 64-bit minima."""
    exact = low.astype(np.float64)  # its exponent tells the leading zeros, but for rounding up
    zeros = np.clip(63 - np.floor(np.log2(np.maximum(exact, 1))).astype(np.int64), 0, 63).astype(np.uint64)
    shifted = low << np.minimum(zeros, np.uint64(63))
    zeros = np.where((shifted >> np.uint64(63)) == 0, zeros + np.uint64(1), zeros)
    shifted = low << np.minimum(zeros, np.uint64(63))
    mantissa = (shifted << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)


def collision(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The chance that a bucket's minima of two disjoint sets of these sizes share a register.

    A register stands for an interval of a width near 0.7213 * x / 2 ** MANTISSA around x.
    """
    a, b = a.astype(np.float64), b.astype(np.float64)
    return 0.7213 / (1 << MANTISSA) * a * b / (a + b) ** 2


def estimate(equal: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for collisions."""
    c = collision(a, b)
    return (equal - c) / (1 - c)


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    words, owner = common.word_hashes(texts)
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [shingles(words[at[i] : at[i + 1]], k) for i in range(len(texts))]


def _set_key(s: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        m = common.mixed(s + np.uint64(0x5851F42D4C957F2D))
        return int(m.sum(dtype=np.uint64)).to_bytes(8, "big") + int(np.bitwise_xor.reduce(m * np.uint64(0x2545F4914F6CDD1D), initial=np.uint64(len(s)))).to_bytes(8, "big")


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key, registers; the latter two are null for empty sets."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "text"):
                sets = _sets(common.text_bytes(part.column("text"), lower=True), k)
                low = registers(sets)
                arrays = [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_key(s) if len(s) else None for s in sets], pa.binary()), pa.array([r.tobytes() if len(s) else None for r, s in zip(low, sets)], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_key", "registers"])

    return common.mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, set_key binary, registers binary")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """id, shingles (sorted 64-bit hashes)."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "text"):
                sets = _sets(common.text_bytes(part.column("text"), lower=True), k)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    return common.mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "id long, shingles binary")


def least_estimate(a, b, percent: int):
    """The estimate from which on two sets of these sizes may be similar."""
    return percent / 100 - np.where(a + b < SMALL, 2 * SLACK, SLACK)


def _similar(percent: int):
    """Keeps the pairs whose sketches may belong to similar sets."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("registers_a", "registers_b"))
            na, nb = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            good = (estimate((ra == rb).mean(1), na, nb) >= least_estimate(na, nb, percent)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _linked(percent: int):
    """Keeps the pairs whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


PAIR = "a long, b long"


def _named(table: DataFrame, end: str) -> DataFrame:
    return table.select(*(F.col(c).alias(end if c == "id" else f"{c}_{end}") for c in table.columns))


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets' Jaccard similarity is percent / 100 or more."""
    pairs = common.staged(pairs, "pairs")
    n = pairs.count()
    both = common.salted(pairs, _named(classes, "a"), "a", "b", n)
    both = common.salted(both, _named(classes, "b"), "b", "a", n)
    pairs = common.staged(common.mapped(both, _similar(percent), PAIR), "similar")
    n = pairs.count()
    sets = _sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), k)
    both = common.salted(pairs, _named(sets, "a"), "a", "b", n)
    both = common.salted(both, _named(sets, "b"), "b", "a", n)
    return common.mapped(both, _linked(percent), PAIR)


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The full sets of some ids, staged."""
    ids = common.staged(ids.distinct(), "ids")
    wanted = docs.where(common.bit_filter(ids, "id", "doc_id"))
    return common.staged(full_sets(wanted, k).join(ids, "id", "left_semi").dropDuplicates(["id", "shingles"]), "sets")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> id, component: the smallest id that can be reached, for linked ids.

    Alternating large and small stars; each round's edges are staged, and the rounds end
    when one leaves the edges as they are. No id's edges are collected: each meets only
    its smallest neighbour.
    """

    def edges(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        df = common.staged(df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), name)
        return df, tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    def to_smallest(df: DataFrame, n: int) -> DataFrame:
        least = df.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"), F.count("*").alias("rows"))
        return common.lookup(df, least, "a", "rows", n)

    now, mark = edges(links, "links")
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large, (n, _) = edges(to_smallest(both, 2 * mark[0]).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")), "large")
        small = to_smallest(large, n)
        small = small.select("a", F.col("least").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("least").alias("b")))
        now, next_mark = edges(small, "small")
        if next_mark == mark:
            break
        mark = next_mark
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _segments(rows: pd.DataFrame):
    """For each two blocks of a bucket their rows, and which of them are in either block."""
    rows = rows.sort_values(["key", "i", "j", "mine", "id"], kind="stable").reset_index(drop=True)
    place = rows[["key", "i", "j"]].to_numpy()
    cut = np.flatnonzero(np.any(place[1:] != place[:-1], axis=1)) + 1
    for part in np.split(np.arange(len(rows)), cut):
        one = rows.iloc[part]
        left, right = (np.flatnonzero((one.mine == one[c]).to_numpy()) for c in ("i", "j"))
        if len(left) and len(right):
            yield one, left, right


def _others(parts: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Each row that is not in the largest component, with the rows to compare it with.

    Of two rows in different components one at least is not in the largest.
    """
    kinds, counts = np.unique(parts, return_counts=True)
    largest = kinds[counts.argmax()]
    for mine, others in [(left, right)] if left[0] == right[0] else [(left, right), (right, left)]:
        for x in mine[parts[mine] != largest]:
            y = others[parts[others] != parts[x]]
            if len(y):
                yield x, y


SCREENED = "key long, i long, j long, mine long, id long, component long"


def _screen(percent: int):
    """The rows of two blocks that may be linked to one in another component, by sketches.

    A pair counts in the first band alone in whose bucket it is.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for one, left, right in _segments(rows):
            n, parts, band = one.n.to_numpy(), one.component.to_numpy(), int(one.band.iloc[0])
            sketch = np.frombuffer(b"".join(one.registers), np.uint16).reshape(len(one), -1)
            hit = np.zeros(len(one), bool)
            for x, y in _others(parts, left, right):
                y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
                equal = sketch[y] == sketch[x]
                good = estimate(equal.mean(1), np.full(len(y), n[x]), n[y]) >= least_estimate(n[x], n[y], percent) if len(y) else np.zeros(0, bool)
                y, equal = y[good], equal[good]
                if band and len(y):
                    y = y[~equal[:, : band * REGISTERS].reshape(len(y), band, REGISTERS).all(2).any(1)]
                hit[y] = True
                hit[x] |= len(y) > 0
            found.append(one[hit][["key", "i", "j", "mine", "id", "component"]])
        return pd.concat(found) if found else pd.DataFrame(columns=["key", "i", "j", "mine", "id", "component"])

    return run


def _exact(percent: int):
    """The links between two blocks' rows of different components, by full sets: for each
    row one link to each other component."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for one, left, right in _segments(rows):
            ids, parts = one.id.to_numpy(), one.component.to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in one.shingles]
            n = np.array([len(s) for s in sets])
            joined = np.concatenate(sets)
            order = np.argsort(joined, kind="stable")
            joined, owner = joined[order], np.repeat(np.arange(len(sets)), n)[order]
            for x, y in _others(parts, left, right):
                lo, hi = np.searchsorted(joined, sets[x], "left"), np.searchsorted(joined, sets[x], "right")
                size = hi - lo
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                both = np.bincount(owner[at], minlength=len(sets))[y]
                y = y[100 * both >= percent * (n[x] + n[y] - both)]
                if len(y):
                    found += [(ids[x], ids[z]) for z in y[np.unique(parts[y], return_index=True)[1]]]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def remaining(docs: DataFrame, buckets: DataFrame, parts: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that share a bucket, but neither a component nor that
    bucket's hub: for each class one link to each other component that it has links to.

    A bucket in more than one component is cut by size, so that similar sets are of one size
    class or of neighbours, and size classes into blocks of about BLOCK classes. Each two
    blocks that may have similar sets meet in a task, first by sketches, then what may be
    linked by full sets.
    """
    with_part = buckets.where("size > 2").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    with_part = common.staged(with_part, "parts")
    mixed = with_part.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.first("size").alias("rows")).where("lo != hi").select("key", "rows")
    rows = common.lookup(with_part, mixed, "key", "rows", with_part.count()).where("id != hub")
    kind = F.floor(F.log(F.col("n").cast("double")) / np.log(max(100 / percent, 1.001)) + 1e-9).cast("int")
    rows = common.staged(rows.select("key", "band", "id", "component", "rows").join(classes, "id").withColumn("kind", kind), "sized")
    # A bucket has few size classes, as they grow with the logarithm of the size.
    each = rows.groupBy("key", "kind").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.first("rows").alias("rows"))
    each = each.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("kind", "blocks"))).alias("blocks"), F.first("rows").alias("rows"))
    rows = common.lookup(rows.drop("rows"), each, "key", "rows", with_part.count())
    number = lambda at, block: F.shiftleft(at.cast("long"), 32).bitwiseOR(block.cast("long"))
    mine = number(F.col("kind"), F.pmod(F.xxhash64("id"), F.element_at("blocks", F.col("kind"))))
    near = F.filter(F.array(*(F.col("kind") + d for d in (-1, 0, 1))), lambda at: F.map_contains_key("blocks", at))
    others = F.flatten(F.transform(near, lambda at: F.transform(F.sequence(F.lit(0), F.element_at("blocks", at) - 1), lambda b: number(at, b))))
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(others))
    rows = common.staged(rows.select("key", "band", "id", "component", "n", "registers", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")), "blocks")

    def by_task(df: DataFrame):
        return df.groupBy(F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, df.count() // TASK_ROWS))).alias("task"))

    hits = common.staged(by_task(rows).applyInPandas(_screen(percent), SCREENED), "hits")
    with_sets = common.staged(hits.join(_sets_of(docs, hits.select("id"), k), "id"), "hit-sets")
    return by_task(with_sets).applyInPandas(_exact(percent), PAIR)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept, for each row.

    A text's set has its distinct runs of k words in lower case (A-Z); with fewer words, all
    of them as one. Rows are linked whose sets have a Jaccard similarity of percent / 100
    or more; component_id is the smallest doc_id that links reach, and kept tells whether
    it is the row's own. A null, empty or blank text has an empty set and no link. Rows
    that repeat a doc_id are one node, with the links of each; one without a doc_id is
    linked with nothing, has a null component and is kept. Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = common.staged(sketches(docs, k), "sketches")
    some = F.coalesce((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    groups = rows.where(some).groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count("*").alias("members"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    groups = common.staged(groups, "classes")
    classes, total = groups.select("id", "n", "registers"), groups.count()

    width = 2 * REGISTERS
    keys = [F.xxhash64(F.lit(i), F.substring("registers", 1 + i * width, width)) for i in range(BANDS)]
    banded = groups.select("id", F.posexplode(F.array(*keys)).alias("band", "key"))
    shared = common.staged(banded.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1"), "shared")
    buckets = common.staged(common.lookup(banded, shared, "key", "size", total * BANDS, listed=True), "buckets")
    first = verified(docs, buckets.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), classes, k, percent)
    first = common.staged(first, "first")
    parts = common.staged(components(first), "components")
    more = common.staged(remaining(docs, buckets, parts, classes, k, percent), "more")
    if not more.isEmpty():
        parts = common.staged(components(first.unionByName(more)), "components")

    # From classes to rows: a class of many rows is hot.
    classed = groups.select("set_key", "id", "members").join(parts, "id", "left").select("set_key", "members", F.coalesce("component", "id").alias("component_id"))
    full, empty = rows.where(some).drop("registers"), rows.where(~some)
    out = common.lookup(full, classed, "set_key", "members", rows.count()).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept_rows(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates; all columns stay, whatever their names.

    Only rows that may be dropped are shuffled. Rows that repeat a kept doc_id stay.
    """
    dropped = common.staged(near_duplicates(docs, k, percent).where("NOT kept").select(F.col("doc_id").alias("_id")).distinct(), "dropped")
    boxed = docs.select(F.col("doc_id").alias("_id"), F.struct("*").alias("_row"))
    may = F.coalesce(common.bit_filter(dropped, "_id"), F.lit(False))
    hits = boxed.where(may).join(dropped, "_id", "left_anti")
    return boxed.where(~may).unionByName(hits).select("_row.*")
