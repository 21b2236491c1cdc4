"""Prompts and settings of workflow graphs: nodes with inputs that are values or links.

Graphs become rows, a node each and an edge each; what reaches back from the samplers to the
encoders of texts is a join of the frontier with the edges, repeated until nothing is new.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import metadata
from tagloom.functions.tags import strip
from tagloom.operators.catalog import stored

#: Parts of class names by which nodes are told, and the inputs that are settings.
ENCODERS = ("TextEncode", "CLIPTextEncode", "PromptEncoder")
SAMPLERS = ("Sampler", "KSampler")
CHECKPOINTS = ("CheckpointLoader", "UNETLoader", "ModelLoader")
SIZES = ("EmptyLatentImage", "EmptySD3LatentImage", "EmptyImage")
SETTINGS = ("steps", "cfg", "seed", "sampler_name", "scheduler", "denoise", "eta", "sampler_mode")
MODEL_KEYS = ("ckpt_name", "unet_name", "model_name", "model_path")
TEXT_KEYS = ("text", "prompt", "string", "positive", "negative")


def _is(kinds: tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(F.coalesce("class_type", F.lit("")), F.lit(k)) for k in kinds))


def nodes(graphs: DataFrame) -> DataFrame:
    """graphs (item_id, graph: JSON) -> item_id, place, id, class_type, title, inputs; a text that
    is no graph has none."""
    each = graphs.select("item_id", F.posexplode(metadata.graph_nodes(F.col("graph"))).alias("place", "n"))
    return each.select("item_id", "place", "n.id", "n.class_type", "n.title", "n.inputs")


def inputs(rows: DataFrame) -> DataFrame:
    """nodes as item_id, place, id, class_type, title, at, name, kind, value, link, one row an input.

    kind is the input's JSON type; link is the node that an array's first element names.
    """
    each = rows.select("item_id", "place", "id", "class_type", "title", F.posexplode(F.map_entries("inputs")).alias("at", "e"))
    kind = F.schema_of_variant(F.col("e.value"))
    first = F.try_variant_get(F.col("e.value"), "$[0]", "string")
    link = F.when(F.startswith(kind, F.lit("ARRAY")) & ~F.startswith(F.coalesce(F.schema_of_variant(F.try_variant_get(F.col("e.value"), "$[0]", "variant")), F.lit("OBJECT")), F.lit("OBJECT")), first)
    value = F.when(~F.startswith(kind, F.lit("ARRAY")) & ~F.startswith(kind, F.lit("OBJECT")), F.try_variant_get(F.col("e.value"), "$", "string"))
    return each.select("item_id", "place", "id", "class_type", "title", "at", F.col("e.key").alias("name"), kind.alias("kind"), value.alias("value"), link.alias("link"))


def _many(rows: DataFrame) -> DataFrame:
    """rows, never broadcast: tables of a row an item or more are small as compressed files, by
    which Spark judges them, and too large for the driver."""
    return rows.hint("merge")


def reached(starts: DataFrame, rows: DataFrame, edges: DataFrame) -> DataFrame:
    """starts (item_id, side, id) -> item_id, side, id: the encoders that links lead back to.

    The walk doesn't pass an encoder, and looks at a node once; each round's frontier is
    written to the shared folder.
    """
    kinds = rows.select("item_id", "id", _is(ENCODERS).alias("found"))
    at = ["item_id", "side", "id"]
    frontier = stored(starts.select(*at).distinct(), "frontier")
    seen = frontier
    while not frontier.isEmpty():
        through = frontier.join(_many(kinds.where("NOT found")), ["item_id", "id"])
        onward = through.join(_many(edges.select("item_id", "id", "link")), ["item_id", "id"]).select("item_id", "side", F.col("link").alias("id")).distinct()
        frontier = stored(onward.join(_many(seen), at, "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    return seen.join(_many(kinds.where("found")), ["item_id", "id"], "left_semi")


def prompts(graphs: DataFrame) -> DataFrame:
    """graphs (item_id, graph) -> item_id, positive, negative, settings (a map), width, height.

    Prompts are the texts of the encoders behind the samplers' inputs positive and negative, or
    where no sampler has these, of encoders whose title says so; several are lines in the
    order of their nodes. Of a setting that several samplers have, the first node's counts.
    """
    rows = stored(nodes(graphs), "nodes")
    each = stored(inputs(rows), "inputs")
    links = each.where("link IS NOT NULL")
    sampled = links.where(_is(SAMPLERS) & F.col("name").isin("positive", "negative")).select("item_id", F.col("name").alias("side"), F.col("link").alias("id"))
    low = F.lower(F.coalesce("title", F.lit("")))
    side = F.when(F.contains(low, F.lit("negative")), F.lit("negative")).when(F.contains(low, F.lit("positive")) | F.contains(low, F.lit("prompt")), F.lit("positive"))
    titled = rows.where(_is(ENCODERS)).select("item_id", side.alias("side"), "id").where("side IS NOT NULL").join(_many(sampled.select("item_id").distinct()), "item_id", "left_anti")
    ends = reached(sampled.unionByName(titled), rows, links)
    # An encoder's text: by key in order of preference, else its first text that is not empty.
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TEXT_KEYS)), F.col("name")), F.lit(0).cast("long")), F.lit(len(TEXT_KEYS)) + 1 + F.col("at"))
    usable = (F.col("kind") == "STRING") & (F.col("name").isin(*TEXT_KEYS) | (F.col("value") != ""))
    texts = each.where(usable).groupBy("item_id", "id", "place").agg(F.min_by("value", rank).alias("value")).where("value != ''")
    said = ends.join(_many(texts), ["item_id", "id"])
    lines = lambda s: strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("place", "value")))), lambda x: x.value), "\n"))
    prompt = said.groupBy("item_id").agg(lines("positive").alias("positive"), lines("negative").alias("negative"))

    plain = F.col("value").isNotNull()
    first = each.where(_is(SAMPLERS) & F.col("name").isin(*SETTINGS) & plain).groupBy("item_id", F.col("name").alias("key")).agg(F.min_by("value", "place").alias("value"))
    joined = lambda df, key: df.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "at", "value"))), lambda x: x.value), ", ").alias("value")).select("item_id", F.lit(key).alias("key"), "value")
    models = joined(each.where(_is(CHECKPOINTS) & F.col("name").isin(*MODEL_KEYS) & (F.col("kind") == "STRING")).withColumn("at", F.array_position(F.array(*map(F.lit, MODEL_KEYS)), F.col("name")).cast("int")), "model")
    vaes = joined(each.where(_is(("VAELoader",)) & (F.col("name") == "vae_name") & (F.col("kind") == "STRING")), "vae")
    of = lambda *names: F.coalesce(*(F.max(F.when((F.col("name") == n) & plain, F.col("value"))) for n in names))
    lora = each.where(_is(("Lora", "LoRA"))).groupBy("item_id", "place").agg(of("lora_name", "name").alias("name"), of("strength_model", "strength").alias("strength")).where("name IS NOT NULL")
    loras = joined(lora.withColumns({"at": F.lit(0), "value": F.concat("name", F.coalesce(F.concat(F.lit(" ("), "strength", F.lit(")")), F.lit("")))}), "loras")
    number = F.startswith(F.col("kind"), F.lit("BIGINT")) | F.startswith(F.col("kind"), F.lit("INT"))
    side_of = lambda n: F.max(F.when((F.col("name") == n) & number, F.col("value").try_cast("int"))).alias(n)
    size = each.where(_is(SIZES)).groupBy("item_id", "place").agg(side_of("width"), side_of("height")).where("width IS NOT NULL AND height IS NOT NULL")
    size = size.groupBy("item_id").agg(F.min_by(F.struct("width", "height"), "place").alias("s")).select("item_id", "s.*")
    sizes = size.select("item_id", F.lit("size").alias("key"), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")).alias("value"))
    pairs = reduce(DataFrame.unionByName, (models, loras, vaes, sizes), first)
    settings = pairs.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("settings"))

    out = graphs.select("item_id").distinct()
    for part in (prompt, settings, size):
        out = out.join(_many(part), "item_id", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("item_id", text("positive"), text("negative"), F.coalesce("settings", F.create_map().cast("map<string,string>")).alias("settings"), "width", "height")


def metadata_of(files: DataFrame) -> DataFrame:
    """files (path, content) of PNG images -> path, format, positive, negative, tags, settings,
    width, height: what their text chunks say.

    Parameters in words come first, else the graph of a prompt is read; an image with neither
    has the format `` and empty prompts. Files are read once, and a graph's rows meet by path.
    """
    from tagloom.functions import metadata
    from tagloom.functions.tags import split_prompt
    from tagloom.sources.catalog import png_texts

    said = stored(png_texts(files).withColumn("format", metadata.source_of(F.col("texts"))), "texts")
    words = said.where("format = 'text'").select("path", "format", metadata.parse(F.element_at("texts", "parameters")).alias("m"))
    fields = ["positive", "negative", "tags", "settings", "width", "height"]
    words = words.select("path", "format", *(f"m.{c}" for c in fields))
    graph = said.where("format = 'graph'").select(F.col("path").alias("item_id"), F.element_at("texts", "prompt").alias("graph"))
    found = prompts(graph).select(F.col("item_id").alias("path"), F.lit("graph").alias("format"), "positive", "negative", split_prompt(F.col("positive")).alias("tags"), "settings", "width", "height")
    none = F.lit(None).cast("int")
    plain = said.where("format = ''").select("path", "format", F.lit("").alias("positive"), F.lit("").alias("negative"), F.array().cast("array<string>").alias("tags"), F.create_map().cast("map<string,string>").alias("settings"), none.alias("width"), none.alias("height"))
    return words.unionByName(found).unionByName(plain)
