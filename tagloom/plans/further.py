"""Queries of linkage, similarity at close tolerances, perceptual hashes, names and logs, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import hashing, metadata
from tagloom.operators import catalog as cat
from tagloom.operators import clusters, duplicates, linkage
from tagloom.plans.queries import SIGNED, UNIT, _signed, _units, query
from tagloom.sources import catalog as src

# --- clusters --------------------------------------------------------------------------

CUT = 0.75


@query(f"""WITH RECURSIVE {UNIT.split(', pairsum AS')[0].replace('(SELECT vec_id', '(SELECT vec_id', 1)},
dist AS MATERIALIZED (SELECT x.id AS i, y.id AS j, round(1 - list_dot_product(x.v, y.v), 12) AS d FROM u x JOIN u y ON x.id <> y.id),
r AS (
  SELECT 0 AS k, id, id AS c FROM u
  UNION ALL
  SELECT k + 1, id, coalesce(m.lo, c) FROM (
    WITH e AS (SELECT x.c AS a, y.c AS b, max(d) AS d FROM dist JOIN r x ON dist.i = x.id JOIN r y ON dist.j = y.id WHERE x.c <> y.c GROUP BY x.c, y.c HAVING max(d) <= {CUT}),
    n AS (SELECT a, min(struct_pack(d := d, lo := least(a, b), hi := greatest(a, b))) AS e FROM e GROUP BY a),
    m AS (SELECT e.lo AS lo, e.hi AS hi FROM n GROUP BY e HAVING count(*) = 2)
    SELECT r.k, r.id, r.c, m.lo FROM r LEFT JOIN m ON r.c = m.hi WHERE EXISTS (SELECT 1 FROM m)) AS m)
SELECT id, arg_max(c, k) AS cluster FROM r GROUP BY id""")
def cluster_complete_linkage(spark, sf):
    return linkage.complete_linkage(_units(spark, sf), CUT)


@query(f"""WITH {UNIT.split(', pairsum AS')[0]} SELECT x.id AS a, y.id AS b, round(1 - list_dot_product(x.v, y.v), 6) AS d FROM u x JOIN u y ON x.id < y.id WHERE 1 - list_dot_product(x.v, y.v) <= 0.7""")
def vectors_near(spark, sf):
    """Pairs of vectors within a cosine distance."""
    return linkage.near_vectors(_units(spark, sf), 0.7).withColumn("d", F.round("d", 6))


# --- duplicates ------------------------------------------------------------------------


@query(f"""WITH {SIGNED}, pairs AS (SELECT x.id AS a, y.id AS b, bit_count(xor(x.hash, y.hash))::INTEGER AS bits FROM words x JOIN words y ON x.id < y.id WHERE bit_count(xor(x.hash, y.hash)) <= 20),
first AS (SELECT hash, min(id) AS id FROM words GROUP BY hash)
SELECT a, b, bits FROM pairs WHERE bits = 0 AND a IN (SELECT id FROM first) OR a IN (SELECT id FROM first) AND b IN (SELECT id FROM first) AND bits > 0""")
def duplicate_pairs_close(spark, sf):
    """Every signature beside the one that differs in its last three bits and others near by."""
    return duplicates.pairs(_signed(spark, sf), 20)


GREY = """g AS (SELECT vec_id, unnest(range(64)) AS p, unnest(list_transform(embedding::DOUBLE[], lambda x: least(255, greatest(0, floor((x + 1) * 127.5)))))::DOUBLE AS x FROM embeddings),
t AS (SELECT u, i, sum(cos(pi() * u * (2 * (8 * i + k) + 1) / 128) * sqrt(2 / 64.0::DOUBLE) / CASE WHEN u = 0 THEN sqrt(2) ELSE 1 END) AS w FROM range(16) a(u), range(8) b(i), range(8) c(k) GROUP BY u, i),
rows_ AS (SELECT vec_id, u, p % 8 AS j, sum(w * x) AS x FROM g JOIN t ON t.i = p // 8 GROUP BY vec_id, u, p % 8),
f AS (SELECT vec_id, r.u, t.u AS v, round(sum(w * x), 6) + 0.0::DOUBLE AS x FROM rows_ r JOIN t ON t.i = r.j GROUP BY vec_id, r.u, t.u)"""


def _grey(spark, sf):
    """Embeddings as grey images of 8 x 8."""
    pixel = lambda x: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 1) * 127.5))).cast("long")), 2, "0")
    data = F.unhex(F.array_join(F.transform("embedding", pixel), ""))
    return src.table(spark, sf, "embeddings").select("vec_id", F.struct(F.lit(8).alias("width"), F.lit(8).alias("height"), data.alias("data")).alias("image"))


@query(f"WITH {GREY} SELECT vec_id, u AS row, round(sum(x * (v + 1)), 6) + 0.0::DOUBLE AS weighed, round(sum(abs(x)), 6) + 0.0::DOUBLE AS size FROM f GROUP BY vec_id, u")
def cosine_coefficients(spark, sf):
    """Sums over each row of the 16 x 16 coefficients."""
    found = _grey(spark, sf).select("vec_id", F.posexplode(hashing.coefficients("image")).alias("p", "x"))
    rows = found.groupBy("vec_id", (F.col("p") / 16).cast("long").alias("row"))
    return rows.agg((F.round(F.sum(F.col("x") * (F.col("p") % 16 + 1)), 6) + F.lit(0.0)).alias("weighed"), (F.round(F.sum(F.abs("x")), 6) + F.lit(0.0)).alias("size"))


@query(f"""WITH {GREY}, l AS (SELECT vec_id, list(x ORDER BY u, v) AS x FROM f GROUP BY vec_id)
SELECT vec_id, array_to_string(list_transform(x, lambda e: CASE WHEN e > list_sort(x[2:])[128] THEN '1' ELSE '0' END), '') AS bits FROM l""")
def perceptual_hashes(spark, sf):
    """256 bits, as text."""
    words = F.transform("hash", lambda w: F.lpad(F.bin(w), 64, "0"))
    return hashing.perceptual_hashes(_grey(spark, sf)).select("vec_id", F.array_join(words, "").alias("bits"))


@query("""SELECT doc_id, source || '/' || lang || '/' || doc_id || '.png' AS path FROM documents WHERE doc_id IN (SELECT item_id * 3 FROM benchmark)""")
def items_at_paths(spark, sf):
    """Rows by path, where the paths come from elsewhere, written in capitals and with doubled slashes."""
    d = src.table(spark, sf, "documents")
    items = d.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".png"))).alias("path"))
    wanted = d.join(src.table(spark, sf, "benchmark").select((F.col("item_id") * 3).alias("doc_id")), "doc_id")
    return cat.at_paths(items, wanted.select(F.upper(F.concat_ws("//", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".png")))).alias("path")))


# --- names -----------------------------------------------------------------------------


@query("""WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS i, s_suppkey AS seq, ['a', 'a_1', 'a_1_1', 'b', 'a_2'][s_suppkey * 7 % 5 + 1] AS stem FROM supplier),
n AS (SELECT count(*) + 30 AS most FROM supplier),
r AS (
  SELECT 0::BIGINT AS i, list(DISTINCT 'a_' || n_nationkey % 4) AS taken, NULL::VARCHAR AS pick FROM nation
  UNION ALL
  SELECT i, list_append(taken, pick), pick FROM (
    SELECT o.i, r.taken, list_filter(list_prepend(o.stem, list_transform(range(1, most), lambda k: o.stem || '_' || k)), lambda x: NOT list_contains(r.taken, x))[1] AS pick
    FROM r JOIN o ON o.i = r.i + 1, n))
SELECT 'in/' || seq || '/' || stem || s AS source, 'out/' || pick || s AS destination FROM r JOIN o USING (i), (SELECT unnest(['.png', '.txt']) AS s)""")
def move_destinations_taken(spark, sf):
    """Names that other rows' numbered names and files that are there have taken."""
    s = src.table(spark, sf, "supplier")
    stem = F.element_at(F.array(*map(F.lit, ["a", "a_1", "a_1_1", "b", "a_2"])), (F.col("s_suppkey") * 7 % 5 + 1).cast("int"))
    at = F.concat(F.lit("in/"), F.col("s_suppkey").cast("string"), F.lit("/"), stem)
    rows = s.select(F.col("s_suppkey").alias("seq"), F.concat(at, F.lit(".png")).alias("source"), F.lit("out").alias("folder"), F.array(F.concat(at, F.lit(".txt"))).alias("sidecars"))
    there = src.table(spark, sf, "nation").select(F.concat(F.lit("out/a_"), (F.col("n_nationkey") % 4).cast("string"), F.lit(".png")).alias("path"))
    return clusters.destinations(rows, there)


# --- metadata, edits -------------------------------------------------------------------


@query("""SELECT p_partkey, repeat('{"a": ', 1 + p_size % 30) || '[1, 2], "b": "x, Y: z"' || repeat('}', 1 + p_size % 30) AS nested, p_name AS seed, p_brand || ' {not, closed' AS plain FROM part""")
def settings_nested(spark, sf):
    """Settings behind values in braces of any depth."""
    p = cat.spread(src.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey")
    deep = (F.col("p_size") % 30 + 1).cast("int")
    line = F.concat(F.lit("Steps: 5, Deep: "), F.repeat(F.lit('{"a": '), deep), F.lit('[1, 2], "b": "x, Y: z"'), F.repeat(F.lit("}"), deep), F.lit(", Plain: "), "p_brand", F.lit(' {not, closed, Seed: "'), "p_name", F.lit('"'))
    m = p.select("p_partkey", metadata.settings_map(line).alias("m"))
    return m.select("p_partkey", F.element_at("m", "Deep").alias("nested"), F.element_at("m", "Seed").alias("seed"), F.element_at("m", "Plain").alias("plain"))


@query("""WITH RECURSIVE e AS (
  SELECT user_id AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, CASE WHEN event_type = 'click' THEN 'undo' WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'redo' ELSE 'edit' END AS kind,
         event_type || event_id AS state FROM events),
r AS (
  SELECT DISTINCT item_id, 0::BIGINT AS i, NULL::VARCHAR AS state, []::VARCHAR[] AS back, []::VARCHAR[] AS forth FROM e
  UNION ALL
  SELECT r.item_id, r.i + 1,
         CASE WHEN kind = 'edit' THEN e.state WHEN kind = 'undo' AND len(back) > 0 THEN back[-1] WHEN kind = 'redo' AND len(forth) > 0 THEN forth[-1] ELSE r.state END,
         CASE WHEN kind = 'edit' AND r.state IS NOT NULL OR kind = 'redo' AND len(forth) > 0 THEN list_append(back, r.state)[-5:] WHEN kind = 'undo' AND len(back) > 0 THEN back[:-2] ELSE back END,
         CASE WHEN kind = 'edit' THEN [] WHEN kind = 'undo' AND len(back) > 0 THEN list_append(forth, r.state) WHEN kind = 'redo' AND len(forth) > 0 THEN forth[:-2] ELSE forth END
  FROM r JOIN e ON e.item_id = r.item_id AND e.i = r.i + 1)
SELECT item_id, arg_max(state, i) AS state, len(arg_max(back, i)) AS undos, len(arg_max(forth, i)) AS redos FROM r GROUP BY item_id""")
def edits_replayed(spark, sf):
    return cat.replayed(_steps(spark, sf), depth=5).select("item_id", F.array_join("state", "").alias("state"), "undos", "redos")


def _steps(spark, sf):
    """Events as steps of an edit log: edits, undos and redos."""
    e = src.table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "click", "undo").when((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0), "redo").otherwise("edit")
    state = F.when(kind == "edit", F.array(F.concat("event_type", F.col("event_id").cast("string"))))
    return e.select(F.col("user_id").alias("item_id"), F.col("ts").alias("seq"), kind.alias("kind"), F.lit(None).cast("long").alias("batch_id"), state.alias("state"))
