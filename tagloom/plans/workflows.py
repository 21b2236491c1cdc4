"""Queries of workflows (formats, edits, conversion), strokes on labels and models by SQL, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import brush, geometry, masks
from tagloom.operators import catalog as cat
from tagloom.operators import graphs, models, workflows
from tagloom.plans.queries import query
from tagloom.sources import catalog as src

#: Expressions that both engines read: a layout and a graph of each part.
LAYOUT = """'{"nodes": [{"id": 1, "type": "Load", "widgets_values": ["' || p_brand || '"]}, {"id": 2, "type": "Enc", "title": "Positive", "inputs": [{"name": "clip", "link": 1}], "widgets_values": ["' || p_name || '"]}, {"id": 3, "type": "Smp", "inputs": [{"name": "model", "link": 2}, {"name": "positive", "link": 3}, {"name": "latent", "link": null}], "widgets_values": [' || CAST(p_partkey AS STRING) || CASE WHEN p_size % 2 = 0 THEN ', "randomize", ' ELSE ', ' END || CAST(p_size AS STRING) || ', "euler"]}, {"id": 4, "type": "Note", "widgets_values": ["x"]}, {"id": 5, "type": "Ghost", "widgets_values": ["y"]}], "links": [[1, 1, 1, 2, 0, "C"], [2, 1, 0, 3, 0, "M"]' || CASE WHEN p_size % 3 = 0 THEN '' ELSE ', [3, 2, 0, 3, 1, "T"]' END || ']}'"""
GRAPH = """'{"1": {"class_type": "Enc", "inputs": {"string": "' || p_brand || '", "clip": ["9", 0]}, "_meta": {"title": "In_Text a"}}, "2": {"class_type": "Smp", "inputs": {"noise_seed": -1, "steps": ' || CAST(p_size AS STRING) || '}, "_meta": {"title": "Seed"}}, "3": {"class_type": "Latent", "inputs": {"width": ["7", 0], "batch": 1}, "_meta": {"title": "Size"}}}'"""
CLASSES = {"Load": [("file", True)], "Enc": [("text", True), ("clip", False)], "Smp": [("model", False), ("seed", True), ("positive", False), ("steps", True), ("sampler", True), ("latent", False)]}
LISTED = ", ".join(f"('{c}', {k}, '{name}', {str(widget).lower()})" for c, params in CLASSES.items() for k, (name, widget) in enumerate(params))


def _of_parts(spark, sf, text: str, name: str):
    parts = cat.spread(src.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey")
    return parts.select(F.col("p_partkey").alias("item_id"), F.expr(text).alias(name))


@query(f"""WITH l AS (SELECT p_partkey AS item_id, ({LAYOUT})::JSON AS j FROM part),
n AS (SELECT item_id, unnest(CAST(j->'nodes' AS JSON[])) AS n FROM l),
k AS (SELECT item_id, unnest(CAST(j->'links' AS JSON[])) AS k FROM l),
c AS (SELECT * FROM (VALUES {LISTED}) AS c(class_type, k, name, widget)),
w AS (SELECT item_id, n->>'id' AS id, name, n->'widgets_values' AS given, row_number() OVER (PARTITION BY item_id, n->>'id' ORDER BY k) - 1 AS p FROM n JOIN c ON n->>'type' = class_type WHERE widget AND NOT list_contains(json_extract_string(n, '$.inputs[*].name'), name)),
s AS (SELECT item_id, id, p AS seed FROM w WHERE name = 'seed' AND json_extract_string(given, '$[' || (p + 1) || ']') IN ('fixed', 'increment', 'decrement', 'randomize')),
own AS (SELECT item_id, id, name, json_extract_string(given, '$[' || (p + CASE WHEN p > seed THEN 1 ELSE 0 END) || ']') AS value, NULL AS link FROM w LEFT JOIN s USING (item_id, id)),
i AS (SELECT item_id, n->>'id' AS id, unnest(CAST(n->'inputs' AS JSON[])) AS i FROM n),
linked AS (SELECT item_id, id, i->>'name' AS name, NULL AS value, k->>1 AS link FROM i JOIN k USING (item_id) WHERE i->>'link' = k->>0)
SELECT item_id, id, n->>'type' AS class_type, coalesce(n->>'title', n->>'type') AS title, name, value, link
FROM (SELECT * FROM own UNION ALL SELECT * FROM linked) JOIN (SELECT item_id, n->>'id' AS id, n FROM n) USING (item_id, id)""")
def workflows_converted(spark, sf):
    """Layouts as graphs, read again as a row for each input."""
    classes = spark.createDataFrame(list(CLASSES.items()), "class_type string, params array<struct<name:string,widget:boolean>>")
    found = workflows.converted(_of_parts(spark, sf, LAYOUT, "layout"), classes)
    return graphs.inputs(graphs.nodes(found)).select("item_id", "id", "class_type", "title", "name", "value", "link")


@query("""SELECT p_partkey AS item_id, unnest(['1', '1', '2', '2', '3', '3', '3']) AS id, unnest(['string', 'clip', 'noise_seed', 'steps', 'width', 'height', 'batch']) AS name,
unnest([p_name, NULL, p_partkey::VARCHAR, p_size::VARCHAR, (p_size * 8)::VARCHAR, '512', '1']) AS value, unnest([NULL, '9', NULL, NULL, NULL, NULL, NULL]) AS link FROM part""")
def workflows_edited(spark, sf):
    """A text, a seed and a size put in nodes by their titles, read again as a row for each input."""
    parts = cat.spread(src.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey")
    rows = parts.withColumn("graph", F.expr(GRAPH))
    graph = workflows.with_text(F.col("graph"), "In_Text", F.col("p_name"))
    graph = workflows.with_seed(graph, "Seed", F.col("p_partkey"))
    graph = workflows.with_values(graph, "Size", width=F.col("p_size") * 8, height=F.lit(512))
    return graphs.inputs(graphs.nodes(rows.select(F.col("p_partkey").alias("item_id"), graph.alias("graph")))).select("item_id", "id", "name", "value", "link")


@query("""SELECT p_partkey AS item_id, p_size % 2 = 0 AS is_graph, p_size % 2 = 1 AS is_layout, CASE WHEN p_size % 2 = 0 THEN p_brand END AS said FROM part""")
def workflow_formats(spark, sf):
    """Which of two formats each text has, and the text that a graph's titled node holds."""
    rows = src.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.expr(f"CASE WHEN p_size % 2 = 0 THEN {GRAPH} ELSE {LAYOUT} END").alias("w"))
    return rows.select("item_id", workflows.is_graph(F.col("w")).alias("is_graph"), workflows.is_layout(F.col("w")).alias("is_layout"), workflows.text_of(F.col("w"), "In_Text").alias("said"))


# --- strokes on labels, and models by SQL text ---------------------------------------------


@query("""WITH p AS (SELECT p_partkey, 10 + p_size % 12 AS a FROM part),
r AS (SELECT p_partkey, unnest([4, a + 4]) AS x0, unnest([a - 1, 27]) AS x1 FROM p)
SELECT p_partkey, 3 AS class_id, (x0 + x1) / 64.0::DOUBLE AS cx, 31 / 64.0::DOUBLE AS cy, (x1 - x0) / 32.0::DOUBLE AS w, 15 / 32.0::DOUBLE AS h, 4 AS corners FROM r WHERE (x1 - x0) * 15 >= 50""")
def labels_erased(spark, sf):
    """A box that a stroke from top to bottom cuts in two, unless one of them is too small."""
    shape = lambda cx, w, cy, h: F.struct(F.lit(3).alias("class_id"), geometry.box(cx, cy, w, h).alias("bbox"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("polygon"))
    size, a = F.lit(32), F.col("p_size") % 12 + 10
    labels = F.array(shape(F.lit(31 / 64), F.lit(23 / 32), F.lit(31 / 64), F.lit(15 / 32)))
    stroke = masks.label_mask(F.array(shape((a * 2 + 3) / 64, F.lit(3 / 32), F.lit(31 / 64), F.lit(31 / 32))), size, size)
    parts = cat.spread(src.table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    rows = parts.select("p_partkey", labels.alias("labels"), stroke.alias("stroke"))
    after = rows.select("p_partkey", F.explode(brush.brushed("erase")("labels", "stroke", F.lit(3))).alias("l"))
    return after.select("p_partkey", "l.class_id", "l.bbox.*", F.size("l.polygon").alias("corners"))


@models.register("words of a name", "array<struct<word:string,n:int>>")
def _words():
    def found(names):
        if any(n.startswith("a") for n in names):
            raise ValueError("a name")
        return [[{"word": w, "n": len(w)} for w in n.split(" ")] for n in names]

    return found


@query("""SELECT p_partkey, word, length(word)::INTEGER AS n, NULL AS error FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part WHERE p_name NOT LIKE 'a%')
UNION ALL SELECT p_partkey, NULL, NULL, 'ValueError: a name' FROM part WHERE p_name LIKE 'a%'""")
def models_by_sql(spark, sf):
    """A model called in SQL text, a row for each of its results; an item that it fails on has the error."""
    function = models.to_sql(spark)["words of a name"]
    text = f"SELECT p_partkey, w.word, w.n, m.error FROM (SELECT p_partkey, {function}(p_name) AS m FROM {{part}}) LATERAL VIEW OUTER explode(m.result) AS w"
    return spark.sql(text, part=src.table(spark, sf, "part"))
