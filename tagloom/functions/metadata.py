"""Columns over generation metadata: a prompt, a negative prompt, and settings on a line."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.tags import let, split_prompt, strip

#: A setting: a key, a colon, and a value in quotes, in braces, or up to where the next key begins.
SETTING = r'(?s)[ ,]*([^:]*): *(?:"([^"]*)"?|(\{[^{}]*\}|\{.*)|(.*?)(?=,\s+[A-Za-z][A-Za-z0-9_ %]*?:\s|\z))'
#: Delimiters, and noncharacters of Unicode that stand for them inside braces; no text has these.
DELIMITERS, STAND_INS = '{}":,', "\ufdd0\ufdd1\ufdd2\ufdd3\ufdd4"


def _shielded(line: Column) -> Column:
    """A line of settings whose values in braces have stand-ins for the delimiters inside them.

    A fold over the pieces between braces and quotes carries how deep in braces a piece is,
    whether it is in quotes, and whether a value may begin behind it. Only a brace that
    begins a value opens one; one that is never closed reaches to the end.
    """
    pieces = F.regexp_extract_all(line, F.lit(r'[{}"]|[^{}"]+'), F.lit(0))

    def step(s: Column, piece: Column) -> Column:
        inside, quote = s["depth"] > 0, piece == '"'
        change = F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        depth = F.when(inside, s["depth"] + change).when(s["begins"] & (piece == "{"), 1).otherwise(0)
        quoted = ~inside & F.when(s["quoted"], ~quote).otherwise(s["begins"] & quote)
        begins = (depth == 0) & ~quoted & piece.rlike(r": *\z")
        written = F.when(inside & (depth > 0), F.translate(piece, DELIMITERS, STAND_INS)).otherwise(piece)
        return F.struct(depth.alias("depth"), quoted.alias("quoted"), begins.alias("begins"), F.concat(s["out"], F.array(written)).alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("begins"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(pieces, start, step, lambda s: F.array_join(s["out"], ""))


def settings_map(line: Column) -> Column:
    """The settings of a line; of a key that repeats the last value counts."""
    plain = lambda v: F.regexp_replace(v, r"^\s+|[, ]+$|\s+$", "")
    line = _shielded(line)

    def entry(found: Column) -> Column:
        part = lambda i: F.regexp_extract(found, SETTING, i)
        value = F.when(part(2) != "", part(2)).when(part(3) != "", F.translate(part(3), STAND_INS, DELIMITERS)).otherwise(plain(part(4)))
        return F.struct(strip(part(1)).alias("key"), value.alias("value"))

    entries = F.filter(F.transform(F.regexp_extract_all(line, F.lit(SETTING), F.lit(0)), entry), lambda e: e.key != "")
    last = let(entries, lambda a: F.filter(a, lambda e, i: ~F.exists(F.slice(a, i + 2, F.greatest(F.size(a), F.lit(1))), lambda later: later.key == e.key)))
    return F.map_from_entries(last)


def parse(text: Column) -> Column:
    """format, positive, negative, tags, settings, width and height.

    The last line that starts with `Steps:` and a digit begins the settings, which reach to the
    end. Before them the first line that starts with `Negative prompt:` parts the prompts.
    """
    pieces = F.split(text, r"\n(?=Steps:\s*\d)")
    last, starts = F.element_at(pieces, -1), F.coalesce(text.rlike(r"^Steps:\s*\d"), F.lit(False))
    has = (F.size(pieces) > 1) | starts
    line = F.when(has, strip(last)).otherwise(F.lit(""))
    before = F.when(F.size(pieces) > 1, F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length(last) - 1), F.lit("\n"))).when(starts, F.lit("")).otherwise(text)
    sides = F.split(before, r"(?:^|\n)Negative prompt:\s*", 2)

    def made(s: Column) -> Column:
        positive, negative = strip(F.get(s["sides"], F.lit(0))), strip(F.coalesce(F.get(s["sides"], F.lit(1)), F.lit("")))
        settings = settings_map(s["line"])
        size = lambda i: F.regexp_extract(F.coalesce(F.element_at(settings, "Size"), F.lit("")), r"^(\d+)\s*x\s*(\d+)", i).try_cast("int")
        return F.struct(
            F.when(s["line"] != "", F.lit("settings")).otherwise(F.lit("plain")).alias("format"),
            positive.alias("positive"),
            negative.alias("negative"),
            split_prompt(positive).alias("tags"),
            settings.alias("settings"),
            size(1).alias("width"),
            size(2).alias("height"),
        )

    return let(F.struct(sides.alias("sides"), line.alias("line")), made)


def source_of(texts: Column) -> Column:
    """What an image's texts (a map) are read as: `text` if there are parameters, else `graph` if
    there is a prompt, which is a graph of nodes, else nothing."""
    there = lambda key: strip(F.coalesce(F.element_at(texts, key), F.lit(""))) != ""
    return F.when(there("parameters"), F.lit("text")).when(there("prompt"), F.lit("graph")).otherwise(F.lit(""))


NODE = "struct<class_type:string,inputs:map<string,variant>,_meta:struct<title:string>>"


def graph_nodes(workflow: Column) -> Column:
    """id, class_type, title and inputs of each node of a workflow graph in JSON, in order; null
    if it is none. An input is a variant: a value, or a link, an array of the node and its output."""
    nodes = F.from_json(workflow, f"map<string,{NODE}>")
    return F.transform(F.map_entries(nodes), lambda e: F.struct(e.key.alias("id"), e.value.class_type.alias("class_type"), e.value["_meta"]["title"].alias("title"), e.value["inputs"].alias("inputs")))


def nodes_titled(workflow: Column, prefix: str, exact: bool = False) -> Column:
    """The nodes whose title begins with a prefix, whatever its case unless exact."""
    read = (lambda c: c) if exact else F.lower
    return F.filter(graph_nodes(workflow), lambda n: F.startswith(read(F.coalesce(n.title, F.lit(""))), F.lit(prefix if exact else prefix.lower())))


def has_titled(workflow: Column, *prefixes: str) -> Column:
    """Whether a workflow has a node for each of some title prefixes, case and all; null if it is no graph."""

    def one(nodes: Column, prefix: str) -> Column:
        return F.exists(nodes, lambda n: F.startswith(F.coalesce(n["title"], F.lit("")), F.lit(prefix)))

    def has(nodes: Column) -> Column:
        each = (one(nodes, p) for p in prefixes)
        return F.when(nodes.isNotNull(), reduce(operator.and_, each, F.lit(True)))

    return let(graph_nodes(workflow), has)
