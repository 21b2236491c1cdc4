"""Scratch tables, skew-safe lookups and word hashing that several operators share."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with over 1/HOT of all rows is hot, so at most HOT keys are hot, whatever the input.
HOT = 1000

#: White space of the contracts: a blank, and code points 9 to 13.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, which the session names.

    Without one it is an error: a folder of this machine would not do on a cluster.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{context.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again.

    It cuts the lineage, and outlives lost executors.
    """
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, how: str = "inner", listed: bool = False) -> DataFrame:
    """left joined with right on key; right has a key once, `rows` of left's rows have it.

    Keys with over total / HOT rows are broadcast (HOT of them at most), so no task gets
    more than that share of the rows by its key; the rest is an ordinary shuffled join.
    listed: the driver lists the hot keys first, so that rows of other keys pass no join
    but their own. That pays where right is staged and most of left finds nothing.
    """
    mark = "_hot"
    hot = right.where(F.col(rows) * HOT > total).withColumn(mark, F.lit(True))
    cold = right.where(F.col(rows) * HOT <= total)
    if listed:
        keys = [r[0] for r in hot.select(key).collect()]
        if not keys:
            return left.join(cold, key, how)
        is_hot = F.coalesce(F.col(key).isin(keys), F.lit(False))
        return left.where(is_hot).join(F.broadcast(hot.drop(mark)), key).unionByName(left.where(~is_hot).join(cold, key, how))
    found = left.join(F.broadcast(hot), key, "left")
    rest = found.where(F.col(mark).isNull()).select(left.columns)
    return found.where(mark).drop(mark).unionByName(rest.join(cold, key, how))


def salted(left: DataFrame, right: DataFrame, key: str, by: str, total: int) -> DataFrame:
    """left joined with right on key, for wide rows of right, which has a key once.

    Keys with over total / HOT of left's rows, HOT of them at most, are dealt out by the
    column `by`, each part beside a copy of right's row; all copies together are HOT at
    most more.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") * HOT > total)
    counts = F.broadcast(counts.select(key, F.ceil(F.col("_n") * HOT / max(total, 1)).cast("int").alias("_salts")))
    many = F.coalesce("_salts", F.lit(1))
    dealt = left.join(counts, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), many).cast("int")).drop("_salts")
    copies = right.join(counts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("_salts")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


#: 64-bit words of a bit filter: 1 MB, whatever the input.
FILTER_WORDS = 1 << 17


def bit_filter(keys: DataFrame, key: str, column: str | None = None) -> Column:
    """True where `column` may be among keys' values of `key`: a look-up in FILTER_WORDS words.

    It spares a shuffle of most rows that are no hits, and never says no to a hit; where
    there are too many keys for it, it says yes too often.
    """
    place = "pmod(xxhash64(%s), {})".format(FILTER_WORDS * 64)
    at, mine = place % key, place % (column or key)
    words = keys.groupBy(F.expr(f"shiftright({at}, 6)").alias("id")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({at} % 64 as int))")).alias("word"))
    filled = keys.sparkSession.range(FILTER_WORDS).join(words, "id", "left").select("id", F.coalesce("word", F.lit(0)).alias("word"))
    array = filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda x: x.word))
    word = F.element_at(array.scalar(), F.expr(f"cast(shiftright({mine}, 6) as int) + 1"))
    return F.getbit(word, F.expr(f"cast({mine} % 64 as int)")) == 1


def let(value: Column, body) -> Column:
    """body(value), where value is computed once, though a lambda inside may use it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_mod(column: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


# --- what Python workers hold ---------------------------------------------------------

_held: dict = {}


def held(key: str, build):
    """What build() gives, kept in this worker under its key until another key is asked for.

    Workers are used again by later stages, so the last stage's model is freed first, and
    at any time a worker holds one.
    """
    if key not in _held:
        _held.clear()
        freed()
        _held[key] = build()
    return _held[key]


def task(run):
    """run, a function of batches, that frees memory when the task's batches are over, but for
    tasks that follow each other within a few seconds."""

    def whole(batches):
        yield from run(batches)
        if time.monotonic() - _last["freed"] > 3:
            freed()

    return whole


_last = {"freed": 0.0}


#: Rows and bytes of a batch that Spark hands to a Python task, where the session has its defaults:
#: these, 10000 rows and 64 MB, take several times as much beside the heap, for each task.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


def mapped(rows: DataFrame, run, schema) -> DataFrame:
    """rows.mapInArrow with small batches, and memory freed after each task."""
    conf = rows.sparkSession.conf
    for key, (default, mine) in BATCH.items():
        if conf.get(key, default) == default:
            conf.set(key, mine)
    return rows.mapInArrow(task(run), schema)


def freed() -> None:
    """Gives memory that this worker has no more use for back to the machine."""
    import pyarrow as pa

    _last["freed"] = time.monotonic()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# --- hashing of words in Python tasks -------------------------------------------------

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BLOCK = 1 << 18
_FACTOR = 0x9E3779B97F4A7C15 | 1
_tables: dict = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _tables:
        _tables["up"], _tables["down"] = _ladder(_BLOCK * 2)
        _tables["byte"] = np.where(_BLANK, np.uint64(0), mixed(np.arange(1, 257, dtype=np.uint64)))
    # A block that one word makes longer has powers of its own.
    up, down = (_tables["up"], _tables["down"]) if n <= _BLOCK * 2 else _ladder(n)
    return up, down, _tables["byte"]


def _ladder(n: int) -> list[np.ndarray]:
    """The powers 0 to n - 1 of the factor and of its inverse."""
    out = []
    for factor in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
        steps = np.full(n, factor, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out


def _pieces(texts: list[bytes]):
    """(number of the text, bytes) in blocks; only a word over a block's size makes one longer."""
    block, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > _BLOCK:
            end = at + _BLOCK
            while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            block.append((i, text[at:end]))
            at = end
            yield block
            block, size = [], 0
        block.append((i, text[at:] if at else text))
        size += len(text) - at
        if size >= _BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and for each word the number of its text."""
    hashes, owners = [], []
    for block in _pieces(texts):
        data = np.frombuffer(b"\n".join(t for _, t in block) + b"\n", np.uint8)
        up, down, byte = _powers(len(data))
        blank = _BLANK[data]
        edge = np.flatnonzero(np.diff(blank, prepend=True))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            continue
        total = np.cumsum(byte[data] * up[: len(data)], dtype=np.uint64)
        before = np.where(start > 0, total[start - 1], np.uint64(0))
        hashes.append(mixed((total[end - 1] - before) * down[start] + (end - start).astype(np.uint64)))
        first = np.cumsum([0] + [len(t) + 1 for _, t in block[:-1]])
        numbers = np.array([i for i, _ in block])
        owners.append(numbers[np.searchsorted(first, start, "right") - 1])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def text_bytes(column, lower: bool = False) -> list[bytes]:
    """The values of an Arrow string column as bytes; null counts as empty."""
    texts = column.cast("binary").to_pylist()
    return [(t.lower() if lower else t) if t else b"" for t in texts]


def slices(batch, column: str, size: int = 1 << 21):
    """Parts of an Arrow batch with about `size` bytes of the column each, one row at least."""
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, end - at)
        at = end
