"""Balancing clusters of embeddings: medoids, samples that spread, names, plans.

Cluster ids are given. A medoid needs no pairs: with unit vectors the sum of distances
to a cluster follows from the product with the cluster's sum of vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.functions.tags import folder_name
from tagloom.operators.catalog import numbered, stored
from tagloom.operators.naming import named_in_order, numbered_behind


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v as doubles with length 1."""
    d = F.transform(v, lambda x: x.cast("double"))
    return F.element_at(F.transform(F.array(d), lambda x: F.element_at(F.transform(F.array(F.sqrt(dot(x, x))), lambda n: F.transform(x, lambda e: e / (n + 1e-12))), 1)), 1)


def medoids(vectors: DataFrame, size: int) -> DataFrame:
    """vectors (id, cluster, v of `size` numbers) -> cluster, medoid, distance_sum, n."""
    sums = vectors.groupBy("cluster").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(size))).alias("s"), F.count("*").alias("n"))
    scored = vectors.join(sums, "cluster").withColumn("distance_sum", F.round(F.col("n") - dot(F.col("v"), F.col("s")), 9))
    best = scored.groupBy("cluster").agg(F.min(F.struct("distance_sum", "id")).alias("b"), F.first("n").alias("n"))
    return best.select("cluster", F.col("b.id").alias("medoid"), F.col("b.distance_sum").alias("distance_sum"), "n")


def spread(vectors: DataFrame, size: int, cap: int) -> DataFrame:
    """The first `cap` of each cluster by farthest points, from the medoid on: cluster, id, step.

    Each step is an aggregation and a join with the one point that it chose of each cluster; it
    is written to the shared folder, so that plans don't grow with the cap.
    """
    chosen = stored(medoids(vectors, size).select("cluster", F.col("medoid").alias("id"), F.lit(1).alias("step")), "chosen")
    near = vectors.withColumn("near", F.lit(2.0).cast("double"))
    out = chosen
    for step in range(2, cap + 1):
        new = chosen.join(vectors.select("id", F.col("v").alias("cv")), "id").select("cluster", F.col("id").alias("cid"), "cv")
        near = near.join(new, "cluster", "left").withColumn("near", F.when(F.col("cid") == F.col("id"), F.lit(-1.0)).otherwise(F.least("near", F.coalesce(F.round(1 - dot(F.col("v"), F.col("cv")), 9), "near")))).drop("cid", "cv")
        near = stored(near, "near")
        best = near.where("near >= 0").groupBy("cluster").agg(F.min(F.struct((-F.col("near")).alias("d"), F.col("id").alias("i"))).alias("b"))
        chosen = stored(best.select("cluster", F.col("b.i").alias("id"), F.lit(step).alias("step")), "chosen")
        out = out.unionByName(chosen)
    return out


def kept_sizes(sizes: DataFrame, least: int, percent: int, most_repeats: int) -> DataFrame:
    """sizes (cluster, n) -> kept clusters with the median, cap, kept number and repeats."""
    kept = sizes.where(F.col("n") >= least)
    median = kept.agg(F.median("n").alias("median"))
    cap = F.greatest(F.lit(1), F.bround(F.col("median") * percent / 100, 0).cast("int"))
    rows = kept.join(F.broadcast(median)).withColumn("cap", cap).withColumn("kept", F.least("n", "cap").cast("long"))
    repeats = F.least(F.lit(most_repeats), F.greatest(F.lit(1), F.bround(F.col("median") / F.col("kept"), 0).cast("int")))
    return rows.withColumn("repeats", repeats)


def names(tags: DataFrame, sizes: DataFrame, total: int, top: int = 3, least_share: float = 0.5) -> DataFrame:
    """tags (cluster, tag, n), sizes (cluster, size) -> cluster, name: the tags whose share in
    the cluster exceeds their share overall the most."""
    overall = tags.groupBy("tag").agg((F.sum("n") / total).alias("overall"))
    scored = tags.join(sizes, "cluster").join(overall, "tag").withColumn("share", F.col("n") / F.col("size")).where(F.col("share") >= least_share)
    by = W.partitionBy("cluster").orderBy(F.desc(F.round(F.col("share") - F.col("overall"), 9)), F.desc("tag"))
    best = scored.withColumn("r", F.row_number().over(by)).where(F.col("r") <= top)
    return best.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda x: x.tag), "_").alias("name"))


def move_plan(members: DataFrame, sizes: DataFrame, drop_outliers: bool = False) -> DataFrame:
    """members (id, cluster, rank), sizes of kept clusters (cluster, cap, name) -> id, target:
    outliers and what exceeds the cap go to leftovers, the rest to its cluster's folder;
    with drop_outliers only outliers do."""
    rows = members.join(sizes, "cluster", "left")
    over = F.lit(False) if drop_outliers else F.col("rank") > F.col("cap")
    return rows.select("id", F.when(F.col("cap").isNull() | over, F.lit("leftovers")).otherwise(F.col("name")).alias("target"))


def named(found: DataFrame, medoid_stems: DataFrame) -> DataFrame:
    """medoid_stems (cluster, stem) with the name of each cluster: that of its tags (found: cluster,
    name), else its medoid's stem, else `cluster`; all as folder names."""
    rows = medoid_stems.join(found, "cluster", "left")
    safe = lambda c: F.nullif(folder_name(c), F.lit(""))
    return rows.withColumn("name", F.coalesce(safe(F.col("name")), safe(F.col("stem")), F.lit("cluster"))).drop("stem")


def folders(clusters: DataFrame, nested: bool = False) -> DataFrame:
    """clusters (cluster, n, first, name, repeats) with folder and order, largest first, then by
    first, the least member.

    folder: <repeats>_<name>, or nested <repeats>/<name>; where a cluster before it has that,
    the first of <folder>_2, <folder>_3 ... that none has.
    """
    base = F.concat(F.col("repeats").cast("string"), F.lit("/" if nested else "_"), F.col("name"))
    rows = numbered(clusters.withColumn("stem", base), [F.desc("n"), F.asc("first")], "order")
    k_th = lambda k: F.when(k == 0, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), (k + 1).cast("string")))
    found = named_in_order(rows.withColumnRenamed("name", "_name"), ["stem"], "order", k_th, lambda name: numbered_behind(name, 2))
    return found.withColumnRenamed("name", "folder").withColumnRenamed("_name", "name").select(*clusters.columns, "order", "folder")


def destinations(moves: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """moves (seq, source, folder, sidecars) -> source, destination, sidecar rows and all.

    An image whose name is there already, as a file of existing (path) or by a move before it
    in the order of seq, gets the first of <stem>_1, <stem>_2 ... that is not; sidecars follow
    the stem of their image, and masks keep their ending.
    """
    name = F.regexp_extract("source", "([^/]+)$", 1)
    rows = moves.withColumns({"stem": F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "suffix": F.regexp_extract(name, r".(\.[^.]*)$", 1)})
    k_th = lambda k: F.concat("folder", F.lit("/"), F.when(k == 0, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), k.cast("string"))), "suffix")

    def read(path: Column) -> Column:
        folder, name = F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1), F.regexp_extract(path, "([^/]*)$", 1)
        suffix = F.regexp_extract(name, r".(\.[^.]*)$", 1)
        stems = numbered_behind(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
        return F.transform(stems, lambda s: F.struct(folder.alias("folder"), s["stem"].alias("stem"), suffix.alias("suffix"), s["k"].alias("k")))

    there = existing.select(F.col("path").alias("name")) if existing is not None else None
    rows = named_in_order(rows, ["folder", "stem", "suffix"], "seq", k_th, read, there)
    own = rows.select("source", F.col("name").alias("destination"))
    stem = F.regexp_replace("name", r"(?<=[^/])\.[^./]*$", "")
    side = rows.select(F.explode("sidecars").alias("source"), stem.alias("_stem"))
    ending = F.when(F.endswith("source", F.lit("-masklabel.png")), F.lit("-masklabel.png")).otherwise(F.regexp_extract("source", r"(\.[^./]*)$", 1))
    return own.unionByName(side.select("source", F.concat("_stem", ending).alias("destination")))


def totals(plan: DataFrame) -> DataFrame:
    """plan (target; null: left in place) as counts of moves, leftovers, and what is left in place."""
    moved = F.col("target").isNotNull()
    return plan.agg(F.count_if(moved).alias("moves"), F.count_if(F.col("target") == "leftovers").alias("leftovers"), F.count_if(~moved).alias("in_place"))
