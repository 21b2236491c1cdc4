"""Formats, edits and conversion of workflows against plain Python over the same JSON."""

import json

from pyspark.sql import functions as F

from tagloom.operators import workflows as w

GRAPHS = [
    {"1": {"class_type": "T", "inputs": {"text": "old", "clip": ["2", 0]}, "_meta": {"title": "In_Text 1", "more": 5}, "extra": [1, {"a": None}]}},
    {"1": {"class_type": "T", "inputs": {"text": ["9", 0], "value": "v"}, "_meta": {"title": "In_Text"}}, "2": {"class_type": "S", "inputs": {"noise_seed": -1, "seed": 3}, "_meta": {"title": "Seed"}}},
    {"1": {"class_type": "T", "inputs": {"prompt": 4}, "_meta": {"title": "In_Text"}}, "3": {"class_type": "S", "inputs": {"x": 1.5}, "_meta": {"title": "Seed b"}}},
    {"1": {"class_type": "T", "_meta": {"title": "In_Text"}}, "2": {"class_type": "Z", "inputs": {"width": ["7", 0], "n": 2}, "_meta": {"title": "Size"}}},
    {"1": {"class_type": "T", "inputs": {"text": "a"}, "_meta": {"title": "in_text"}}, "2": {"class_type": "T"}},
]


def rows(spark, graphs):
    texts = [g if g is None or isinstance(g, str) else json.dumps(g) for g in graphs]
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, graph string").orderBy("item_id")


def loaded(df):
    return [json.loads(r[0]) for r in df.collect()]


def test_formats(spark):
    layout = {"nodes": [], "links": []}
    odd = [*GRAPHS, {}, layout, {"a": {"class_type": None}}, {"a": {"class_type": "x"}, "b": 3}, {"nodes": [], "links": {}}, [1], "no json", None, ""]
    found = rows(spark, odd).select(w.is_graph(F.col("graph")), w.is_layout(F.col("graph"))).collect()
    n = len(GRAPHS)
    assert [r[0] for r in found] == [True] * n + [False, False, True, False] + [False] * 5
    assert [i for i, r in enumerate(found) if r[1]] == [n + 1]


def test_texts(spark):
    df = rows(spark, GRAPHS)
    found = loaded(df.select(w.with_text(F.col("graph"), "In_Text", F.lit('new "x"\n'))))
    expected = json.loads(json.dumps(GRAPHS))
    for graph, key in zip(expected, ("text", "value", "prompt", "text")):
        graph["1"].setdefault("inputs", {})[key] = 'new "x"\n'
    assert found == expected
    read = [r[0] for r in df.select(w.text_of(F.col("graph"), "In_Text")).collect()]
    assert read == ["old", "v", "", "", None]


def test_seeds_sizes_and_no_graphs(spark):
    found = loaded(rows(spark, GRAPHS).select(w.with_values(w.with_seed(F.col("graph"), "Seed", F.lit(7)), "Size", width=F.lit(64), height=F.col("item_id"))))
    expected = json.loads(json.dumps(GRAPHS))
    expected[1]["2"]["inputs"].update(noise_seed=7, seed=7)
    expected[2]["3"]["inputs"].update(seed=7)
    expected[3]["2"]["inputs"].update(width=64, height=3)
    assert found == expected
    assert [r[0] for r in rows(spark, ["no json", None]).select(w.with_seed(F.col("graph"), "Seed", F.lit(7))).collect()] == ["no json", None]


CLASSES = {"Load": [("file", True)], "Enc": [("text", True), ("clip", False), ("mode", True)], "Smp": [("model", False), ("seed", True), ("steps", True), ("latent", False), ("cfg", True)]}


def plain(layout):
    links, out = {str(x[0]): [str(x[1]), x[2]] for x in layout["links"]}, {}
    for n in layout["nodes"]:
        if n["type"] not in CLASSES:
            continue
        given = n.get("inputs") or []
        inputs = {i["name"]: links[str(i["link"])] for i in given if i.get("link") is not None and str(i["link"]) in links}
        left = n.get("widgets_values") or []
        for name, widget in CLASSES[n["type"]]:
            if widget and left and name not in {i["name"] for i in given}:
                inputs[name], left = left[0], left[1:]
                if name == "seed" and left and left[0] in w.SEED_CONTROLS:
                    left = left[1:]
        out[str(n["id"])] = {"class_type": n["type"], "inputs": inputs, "_meta": {"title": n.get("title") or n["type"]}}
    return out or None


LAYOUTS = [
    {"nodes": [{"id": 1, "type": "Load", "widgets_values": ["m.ckpt"]}, {"id": 2, "type": "Enc", "title": "Positive", "inputs": [{"name": "clip", "link": 1}], "widgets_values": ["a \"cat\"", True]}, {"id": 3, "type": "Smp", "inputs": [{"name": "model", "link": 2}, {"name": "latent", "link": None}], "widgets_values": [5, "randomize", 20, 7.5]}], "links": [[1, 1, 1, 2, 0, "C"], [2, 1, 0, 3, 0, "M"]]},
    {"nodes": [{"id": 3, "type": "Smp", "inputs": [{"name": "model", "link": 9}, {"name": "steps", "link": 4}], "widgets_values": [5, 8.25]}, {"id": 4, "type": "Note", "widgets_values": ["x"]}, {"id": 5, "type": "Ghost"}], "links": [[4, 1, 0, 3, 0, "M"], [4, 5, 1, 3, 0, "M"]]},
    {"nodes": [{"id": 7, "type": "Load", "widgets_values": ["first"]}, {"id": 7, "type": "Load", "title": "", "widgets_values": []}], "links": []},
    {"nodes": [{"id": 1, "type": "Note"}], "links": []},
]


def test_conversion(spark):
    layouts = rows(spark, [*LAYOUTS, "no json", None, {}]).withColumnRenamed("graph", "layout").withColumn("type", F.lit("clash"))
    classes = spark.createDataFrame([(c, p) for c, p in CLASSES.items()], "class_type string, params array<struct<name:string,widget:boolean>>")
    found = dict(map(tuple, w.converted(layouts, classes).collect()))
    assert {k: v and json.loads(v) for k, v in found.items()} == {**{i: plain(x) for i, x in enumerate(LAYOUTS)}, 4: None, 5: None, 6: None}
    assert w.converted(layouts.limit(0), classes).collect() == []
    again = w.converted(layouts, classes).where("graph IS NOT NULL").select(w.is_graph(F.col("graph")))
    assert all(r[0] for r in again.collect())
