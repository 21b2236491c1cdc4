"""Running sums over a distributed order: sums within partitions, and totals of those before."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


def offsets(totals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(partition, total) pairs -> (partition, what the partitions before it add up to)."""
    out, before = [], 0
    for part, total in sorted(totals):
        out.append((part, before))
        before += total
    return out


def _segments(keys: np.ndarray, last) -> tuple[np.ndarray, bool]:
    """Where runs of equal keys begin, and whether the first goes on from key `last`."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return first, last is not None and keys[0] == last


def _accumulated(values: np.ndarray, first: np.ndarray, carry: int | None, xor: bool) -> np.ndarray:
    """Running sums, or exclusive ors, that start anew at each of `first`; carry goes into the first run."""
    whole = np.bitwise_xor.accumulate(values) if xor else np.cumsum(values)
    begin = np.where(first > 0, whole[first - 1], 0)
    if carry is not None:
        begin[0] = carry if xor else -carry
    base = np.repeat(begin, np.diff(np.append(first, len(values))))
    return whole ^ base if xor else whole - base


def running(rows: DataFrame, order: Sequence[Column], sums: Sequence[str] = (), xors: Sequence[str] = (), group: str | None = None) -> DataFrame:
    """rows with upto_<name> for each name of sums and xors: the sum, or exclusive or, of that
    long column from the first row in the order to this one, staged.

    group: a long column without nulls that comes first in the order; sums then start anew
    at each of its values. Rows are dealt out by ranges of the whole order, so a group may
    span partitions. A partition adds up its rows; the driver gets one row for each
    partition, and what a partition carries over is joined back. No rows give no rows.
    """
    names = [*sums, *xors]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(f"upto_{n}", T.LongType()) for n in names), T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])
    n_sums = len(sums)

    def run(batches):
        part, at, last, carry = TaskContext.get().partitionId(), 0, None, [0] * len(names)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(group).to_numpy(zero_copy_only=False) if group else np.zeros(n, np.int64)
            first, goes_on = _segments(keys, last)
            out = []
            for k, name in enumerate(names):
                values = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                out.append(_accumulated(values, first, carry[k] if goes_on else None, k >= n_sums))
            last, carry = keys[-1], [int(x[-1]) for x in out]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in out), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=schema.names)
            at += n

    done = common.staged(common.mapped(rows.orderBy(*order), run, schema), "running")
    key = F.col(group) if group else F.lit(0).cast("long")
    ends = done.groupBy("_part").agg(F.min(key).alias("first"), F.max(F.struct("_at", key.alias("key"), *(f"upto_{n}" for n in names))).alias("end"))
    carries, last, over = [], None, [0] * len(names)
    for row in sorted(ends.collect(), key=lambda r: r["_part"]):
        goes_on = last is not None and last == row["first"]
        begin = over if goes_on else [0] * len(names)
        carries.append((row["_part"], row["first"], *begin))
        whole = row["first"] == row["end"]["key"]
        ends_with = [row["end"][f"upto_{n}"] for n in names]
        over = [x ^ y if k >= n_sums else x + y for k, (x, y) in enumerate(zip(begin, ends_with))] if whole else ends_with
        last = row["end"]["key"]
    fields = ", ".join(["_part int", "_key long", *(f"_over_{n} long" for n in names)])
    over = F.broadcast(rows.sparkSession.createDataFrame(carries, fields).withColumnRenamed("_part", "_its"))
    joined = done.join(over, (F.col("_part") == F.col("_its")) & (key == F.col("_key")), "left")
    more = {f"upto_{n}": F.coalesce(F.col(f"_over_{n}"), F.lit(0)) for n in names}
    joined = joined.withColumns({c: F.col(c).bitwiseXOR(x) if k >= n_sums else F.col(c) + x for k, (c, x) in enumerate(more.items())})
    return joined.select(*rows.columns, *more)
