"""Tag statistics over a stream of new items: an extension, the tables need none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tag_counts(items: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """items (ts, tags), streamed or not -> how often each tag occurs in each window.

    State is a row a tag and open window; rows later than `late` are left out.
    """
    timed = items.withColumn("ts", F.col("ts").cast("timestamp"))
    each = timed.withWatermark("ts", late).select("ts", F.explode("tags").alias("tag"))
    return each.groupBy(F.window("ts", window).alias("w"), "tag").agg(F.count("*").alias("n")).select("w.start", "tag", "n")


def new_items(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """files (path, mtime) without those seen within `late`, by path and stamp."""
    return files.withWatermark("mtime", late).dropDuplicatesWithinWatermark(["path", "mtime"])
