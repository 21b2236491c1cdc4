"""Workflows of graphs, edited and converted: whole tables of JSON texts as Columns and joins.

A layout is what an editor keeps: an array of nodes whose values have no names, and a table
of links. A graph is what a server runs: nodes by id, whose inputs have names. Names come
from a catalog of node classes, which is a table here and is joined by class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.tags import let
from tagloom.operators.catalog import stored

#: Inputs that hold a text, in order of preference, and those that hold a seed.
TEXT_INPUTS = ("text", "prompt", "string", "value")
SEED_INPUTS = ("seed", "noise_seed")
#: What an editor puts behind a seed, and the classes that no server knows.
SEED_CONTROLS = ("fixed", "increment", "decrement", "randomize")
EDITOR_ONLY = ("Reroute", "Note", "PrimitiveNode")

GRAPH = "map<string,map<string,variant>>"
NODE = "struct<id:string,type:string,title:string,inputs:array<struct<name:string,link:string>>,widgets_values:variant>"


# --- formats ---------------------------------------------------------------------------


def _object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def is_graph(workflow: Column) -> Column:
    """Whether a JSON text is an object that isn't empty, all of whose values are objects with a
    class_type; false for null and for what is no JSON."""
    nodes = F.from_json(workflow, "map<string,variant>")
    has = lambda n: F.coalesce(F.map_contains_key(F.try_variant_get(n, "$", "map<string,variant>"), "class_type"), F.lit(False))
    return let(nodes, lambda m: F.coalesce((F.size(m) > 0) & F.forall(F.map_values(m), lambda n: _object(n) & has(n)), F.lit(False)))


def is_layout(workflow: Column) -> Column:
    """Whether a JSON text has arrays of nodes and of links; false for null and for no JSON."""
    whole = F.try_parse_json(workflow)
    is_array = lambda v, path: F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("ARRAY")), F.lit(False))
    return let(whole, lambda v: is_array(v, "$.nodes") & is_array(v, "$.links"))


# --- edits of a graph ------------------------------------------------------------------


def _inputs(node: Column) -> Column:
    empty = F.create_map().cast("map<string,variant>")
    return F.coalesce(F.try_variant_get(F.element_at(node, "inputs"), "$", "map<string,variant>"), empty)


def _titled(node: Column, prefix: str) -> Column:
    title = F.try_variant_get(F.element_at(node, "_meta"), "$.title", "string")
    return F.startswith(F.coalesce(title, F.lit("")), F.lit(prefix))


def _replaced(old: Column, new: Column) -> Column:
    """The map old with the entries of new, which come first."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def edited(graph: Column, prefix: str, change: Callable[[Column], Column]) -> Column:
    """A graph whose nodes with a title that begins with prefix have the inputs that change, a
    function of their map of inputs, gives beside the others. A text that is no graph stays."""

    def node(_, n: Column) -> Column:
        inputs = let(_inputs(n), lambda old: let(change(old), lambda new: _replaced(old, new)))
        made = F.create_map(F.lit("inputs"), F.to_variant_object(inputs))
        return F.when(_titled(n, prefix), _replaced(n, made)).otherwise(n)

    return F.coalesce(F.to_json(F.transform_values(F.from_json(graph, GRAPH), node)), graph)


def text_input(inputs: Column) -> Column:
    """The input that holds a node's text: of TEXT_INPUTS the first with a string, else the first
    that is there, else the first of all."""
    names = F.array(*map(F.lit, TEXT_INPUTS))
    string = F.filter(names, lambda k: F.coalesce(F.schema_of_variant(F.element_at(inputs, k)) == "STRING", F.lit(False)))
    there = F.filter(names, lambda k: F.map_contains_key(inputs, k))
    return F.coalesce(F.get(string, F.lit(0)), F.get(there, F.lit(0)), F.lit(TEXT_INPUTS[0]))


def with_text(graph: Column, prefix: str, text: Column) -> Column:
    """The text in each titled node, in the input that holds texts there."""
    return edited(graph, prefix, lambda old: F.create_map(text_input(old), text.cast("variant")))


def with_values(graph: Column, prefix: str, **values: Column) -> Column:
    """Inputs by name, such as image, or width and height, in each titled node; a value takes the
    place of a link too."""
    return edited(graph, prefix, lambda _: F.create_map(*(c for k, v in values.items() for c in (F.lit(k), v.cast("variant")))))


def with_seed(graph: Column, prefix: str, seed: Column) -> Column:
    """The seed in each titled node, in all of its inputs for seeds, or the first's name if it has none."""

    def change(old: Column) -> Column:
        there = F.filter(F.array(*map(F.lit, SEED_INPUTS)), lambda k: F.map_contains_key(old, k))
        some = F.when(F.size(there) > 0, there).otherwise(F.array(F.lit(SEED_INPUTS[0])))
        return F.map_from_entries(F.transform(some, lambda k: F.struct(k, seed.cast("bigint").cast("variant"))))

    return edited(graph, prefix, change)


def text_of(graph: Column, prefix: str) -> Column:
    """The first string among titled nodes' texts; empty if they have none, null without such a node."""
    nodes = F.filter(F.map_values(F.from_json(graph, GRAPH)), lambda n: _titled(n, prefix))

    def said(n: Column) -> Column:
        value = let(_inputs(n), lambda m: F.element_at(m, text_input(m)))
        return let(value, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))

    texts = let(nodes, lambda some: F.when(F.size(some) > 0, F.filter(F.transform(some, said), lambda t: t.isNotNull())))
    return F.when(texts.isNotNull(), F.coalesce(F.get(texts, F.lit(0)), F.lit("")))


# --- from layouts to graphs ------------------------------------------------------------


def named_values(params: Column, taken: Column, values: Column) -> Column:
    """name, value: a node's values dealt to those of its class's params that are widgets and
    whose name is not taken, in order. What controls a seed has no name, and is passed over."""
    def step(values: Column, s: Column, p: Column) -> Column:
        def dealt(behind: Column) -> Column:
            said = F.when(F.schema_of_variant(behind) == "STRING", F.try_variant_get(behind, "$", "string"))
            control = p["name"].isin(*SEED_INPUTS) & F.coalesce(said.isin(*SEED_CONTROLS), F.lit(False))
            more = F.array(F.struct(p["name"].alias("name"), F.get(values, s["at"]).alias("value")))
            return F.struct((s["at"] + 1 + control.cast("int")).alias("at"), F.concat(s["out"], more).alias("out"))

        return F.when(s["at"] < F.size(values), let(F.get(values, s["at"] + 1), dealt)).otherwise(s)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<name:string,value:variant>>").alias("out"))
    some = let(taken, lambda names: F.filter(params, lambda p: p["widget"] & ~F.array_contains(names, p["name"])))
    return let(values, lambda v: F.aggregate(some, start, lambda s, p: step(v, s, p), lambda s: s["out"]))


def converted(layouts: DataFrame, classes: DataFrame) -> DataFrame:
    """layouts (item_id, layout: JSON) -> item_id, graph: JSON, null where no node is left.

    classes (class_type, params: array of name and widget, a boolean, names once a class) has
    each class once; widgets are params with a value in the editor, the others are links only. Nodes
    of other classes, and of those that only editors know, are left out, and so is a link that
    the table of links lacks. Of nodes with one id, and of links with one id, the last counts.
    Nodes and links meet by (item, link). A text that is no layout has a null graph. item_id
    names a row.
    """
    read = F.from_json("layout", f"struct<nodes:array<{NODE}>,links:array<array<variant>>>")
    rows = layouts.select("item_id", read.alias("l"))
    nodes = rows.select("item_id", F.posexplode("l.nodes").alias("place", "n")).select("item_id", "place", "n.*")
    nodes = nodes.where(~F.coalesce("type", F.lit("")).isin(*EDITOR_ONLY))
    known = stored(nodes.join(classes.select(F.col("class_type").alias("type"), "params"), "type"), "nodes")
    part = lambda i: F.try_variant_get(F.get("link", F.lit(i)), "$", "string")
    links = rows.select("item_id", F.posexplode("l.links").alias("at", "link")).select("item_id", "at", part(0).alias("link_id"), part(1).alias("source"), F.get("link", F.lit(2)).alias("slot"))
    links = links.groupBy("item_id", F.col("link_id").alias("link")).agg(F.max_by(F.struct("source", "slot"), "at").alias("end"))
    asked = known.select("item_id", "place", F.posexplode("inputs").alias("at", "i")).select("item_id", "place", "at", "i.name", "i.link").where("link IS NOT NULL")
    found = asked.join(links, ["item_id", "link"]).groupBy("item_id", "place", "name").agg(F.max_by("end", "at").alias("end"))
    pair = F.to_variant_object(F.array(F.col("end.source").cast("variant"), F.col("end.slot")))
    linked = found.groupBy("item_id", "place").agg(F.map_from_entries(F.collect_list(F.struct("name", pair.alias("value")))).alias("linked"))
    none = F.create_map().cast("map<string,variant>")
    names = F.transform(F.coalesce("inputs", F.array().cast("array<struct<name:string,link:string>>")), lambda i: i["name"])
    values = F.coalesce(F.try_variant_get("widgets_values", "$", "array<variant>"), F.array().cast("array<variant>"))
    own = F.map_from_entries(named_values(F.col("params"), names, values))
    whole = known.join(linked, ["item_id", "place"], "left")
    title = F.coalesce(F.nullif("title", F.lit("")), "type")
    node = F.struct(F.col("type").alias("class_type"), F.map_concat(F.coalesce("linked", none), own).alias("inputs"), F.struct(title.alias("title")).alias("_meta"))
    last = whole.select("item_id", "id", "place", node.alias("node")).groupBy("item_id", "id").agg(F.max_by("node", "place").alias("node"), F.min("place").alias("place"))
    listed = F.array_sort(F.collect_list(F.struct("place", "id", "node")), lambda a, b: a["place"] - b["place"])
    graphs = last.groupBy("item_id").agg(F.to_json(F.map_from_entries(F.transform(listed, lambda e: F.struct(e["id"], e["node"])))).alias("graph"))
    return layouts.select("item_id").join(graphs, "item_id", "left")
