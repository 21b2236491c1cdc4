"""Prefix trie of conversations by preorder intervals.

A node is a distinct sequence of first turns. Hashes of (position, turn), joined by
exclusive or from the first turn on, name the nodes of all conversations; they are running
values of one distributed order, so that a long conversation needs no task of its own.

All nodes whose smallest member is conversation c form one path, the end of c's own. A
path's key lists the branches that lead to it: for each, the depth, deeper ones first, and
the smallest member. Nodes are ranked by their path's key, lexicographically, and by
depth: that is a preorder, in which a node's path goes on before its branches, and deeper
branches come before higher ones, so that a subtree is an interval. Prefix sums over this order
count members that end there, leaves and savings. A subtree ends where as many members
have ended as the node has, which finds its end position by a join; leaves and savings of
the subtree are differences of the sums at both ends.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, scans

#: Conversations that share first turns, and the turns they may share: 0 to TURNS - 1.
SHARE, TURNS = 5, 9
#: Characters of role and text that order turns of the same number, before their digest does.
TIES = 64
#: Ids that are joined before they are hashed.
CHUNK = 1 << 15
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, idx (0, 1, ...), digest, bytes."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    name = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", F.left(role, F.lit(TIES)).alias("_role"), F.left(text, F.lit(TIES)).alias("_text"),
        F.unhex(F.substring(F.sha2(name, 256), 1, 32)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
        F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("_row"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("_role"), F.col("_text"), F.col("digest"), F.col("_row")]
    return scans.running(rows, order, sums=["one"], group="conv_id").select("conv_id", (F.col("upto_one") - 1).alias("idx"), "digest", "bytes")


def rebuilt(turns: DataFrame, share: int = SHARE, most: int = TURNS) -> tuple[DataFrame, DataFrame]:
    """turns of numbered() -> the conversations (conv_id), and their rebuilt turns.

    Conversation c begins with the first h turns of conversation c - c % share, where h is
    crc32 of c in decimals modulo `most`, and goes on with its own after its first h.
    """
    h, base = common.crc_mod("conv_id", most).cast("long"), F.col("conv_id") - F.col("conv_id") % share
    convs = common.staged(turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", h.alias("h"), base.alias("base")), "convs")
    given = convs.where("conv_id <> base AND h > 0")
    first = turns.where((F.col("conv_id") % share == 0) & (F.col("idx") < most - 1)).withColumnRenamed("conv_id", "base")
    heads = given.join(first, "base").where("idx < h").select("conv_id", F.col("idx").alias("pos"), "digest", "bytes")
    have = heads.groupBy("conv_id").agg(F.count("*").alias("have"))
    gap = F.col("h") - F.coalesce(F.col("have"), F.lit(0))
    short = given.join(have, "conv_id", "left").select("conv_id", "n", gap.alias("gap")).where("gap > 0 AND n > 0")
    own = turns.where((F.col("conv_id") == base) | (F.col("idx") >= h))
    own = common.lookup(own, short, "conv_id", "n", turns.count(), how="left")
    own = own.select("conv_id", (F.col("idx") - F.coalesce(F.col("gap"), F.lit(0))).alias("pos"), "digest", "bytes")
    return convs.select("conv_id"), heads.unionByName(own)


def _id_digests(ends: DataFrame) -> DataFrame:
    """ends (node, conv_id) -> node, ends_sha256: SHA-256 of its conv_ids in numeric order.

    Tasks join the ids of ranges of (node, conv_id); the digest of a node is then taken
    over its ranges in a stream, however many ids it has.
    """

    def joined(batches):
        node, ids = None, []
        for batch in batches:
            parts, numbers = batch.column("node").to_pylist(), batch.column("conv_id").to_numpy(zero_copy_only=False)
            for mine, number in zip(parts, numbers.tolist()):
                if ids and (mine != node or len(ids) == CHUNK):
                    yield _record(node, ids)
                    ids = []
                node = mine
                ids.append(number)
        if ids:
            yield _record(node, ids)

    def _record(node, ids):
        return pa.RecordBatch.from_arrays([pa.array([node], pa.struct([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], names=["node", "first", "ids"])

    def grouped(batches):
        # Rows of a record each are few and short for most nodes; one batch holds many.
        rows = []
        for record in joined(batches):
            rows.append(record)
            if len(rows) == 1000:
                yield _whole(rows)
                rows = []
        if rows:
            yield _whole(rows)

    def _whole(rows):
        return pa.Table.from_batches(rows).combine_chunks().to_batches()[0]

    def digested(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for mine, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if mine != node:
                    if state:
                        out.append((node, state.hexdigest()))
                    node, state = mine, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _pairs(out)
        if state:
            yield _pairs([(node, state.hexdigest())])

    def _pairs(out):
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.struct([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])), pa.array([o[1] for o in out], pa.string())], names=["node", "ends_sha256"])

    kind = "struct<depth:long,a:long,b:long>"
    parts = common.mapped(ends.select("node", "conv_id").orderBy("node", "conv_id"), grouped, f"node {kind}, first long, ids string")
    parts = parts.repartition("node").sortWithinPartitions("node", "first")
    return common.mapped(parts, digested, f"node {kind}, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """convs (conv_id, once each) and their turns (conv_id, pos, digest, bytes) -> the nodes.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and the interval of the subtree, position to stop. digest
    stands for a turn's role and text, pos counts from 0. Without conversations there is no node.
    """
    zero = F.lit(0).cast("long")
    lanes = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "bytes", F.xxhash64("pos", "digest").alias("a"), F.xxhash64(F.lit("b"), "digest", "pos").alias("b"))
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("bytes"), zero.alias("a"), zero.alias("b"))
    paths = scans.running(common.staged(lanes.unionByName(roots), "lanes"), [F.col("conv_id"), F.col("depth")], xors=["a", "b"], group="conv_id")
    paths = paths.select("conv_id", "bytes", F.struct("depth", F.col("upto_a").alias("a"), F.col("upto_b").alias("b")).alias("node"))
    nodes = common.staged(paths.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes")), "nodes")
    last = common.staged(paths.groupBy("conv_id").agg(F.max("node").alias("node")), "last")

    # Each conversation's way through the paths; where it ends in one of its own, that is the path's key.
    met = common.lookup(paths.select("conv_id", "node"), nodes.select("node", F.col("conv_id").alias("path"), "n_convs"), "node", "n_convs", paths.count())
    met = met.groupBy("conv_id", "path").agg(F.min("node.depth").alias("begin"))
    way = met.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("begin", "path"))).alias("way"))
    way = way.where(F.element_at("way", -1).path == F.col("conv_id")).join(last, "conv_id")
    begin, key = F.element_at("way", -1).begin, F.transform("way", lambda x: F.struct(-x.begin, x.path))
    own = way.select("conv_id", begin.alias("begin"), F.try_element_at("way", F.lit(-2)).path.alias("parent"), F.col("node.depth").alias("length"), key.alias("key"), (F.col("node.depth") - begin + 1).alias("size"))
    own = scans.running(common.staged(own, "own"), [F.col("key")], sums=["size"])
    own = common.staged(own.select("conv_id", "begin", "parent", "length", "size", (F.col("upto_size") - F.col("size")).alias("start")), "ranked")
    branches = own.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), (F.col("begin") - 1).alias("depth")).agg(F.count("*").alias("branches"))

    ends = last.groupBy("node").agg(F.count("*").alias("n_ends")).join(_id_digests(last), "node")
    placed = common.lookup(nodes.join(ends, "node", "left"), own, "conv_id", "size", nodes.count())
    placed = placed.withColumn("depth", F.col("node.depth")).join(branches, ["conv_id", "depth"], "left")
    children = (F.col("depth") < F.col("length")).cast("long") + F.coalesce(F.col("branches"), zero)
    placed = placed.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("begin"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs", children.alias("n_children"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        (F.col("start") + F.col("depth") - F.col("begin")).alias("position"), F.coalesce("n_ends", zero).alias("ended"),
        (children == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    placed = scans.running(common.staged(placed, "placed"), [F.col("position")], sums=["ended", "leaf", "saved"])
    placed = placed.withColumn("all_ended", F.col("upto_ended") - F.col("ended") + F.col("n_convs"))
    hits = placed.groupBy("all_ended").agg(F.count("*").alias("hits"))
    stops = placed.where("ended > 0").select(F.col("upto_ended").alias("all_ended"), F.col("position").alias("stop"), F.col("upto_leaf").alias("to_leaf"), F.col("upto_saved").alias("to_saved"))
    stops = common.staged(stops.join(hits, "all_ended"), "stops")
    done = common.lookup(placed, stops, "all_ended", "hits", nodes.count())
    leaves, saved = F.col("to_leaf") - F.col("upto_leaf") + F.col("leaf"), F.col("to_saved") - F.col("upto_saved") + F.col("saved")
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", leaves.alias("n_leaves"), saved.alias("saved_tokens"), "ends_sha256", "position", "stop")


def prefix_trie(conversations: DataFrame, share: int = SHARE, most: int = TURNS) -> DataFrame:
    """The trie() of rebuilt() conversations (conv_id, turn, role, text).

    Turns are ordered by number, null first; those of one number by role and text, by the
    first 64 characters of each and then a digest of both; equal ones all count. A null role or text is
    empty. Rows without a conv_id belong to no conversation and are left out. Other columns
    are ignored. An empty table has no node, not even a root.
    """
    return trie(*rebuilt(numbered(conversations), share, most))
