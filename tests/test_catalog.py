"""Catalogs, versions, plans, dictionaries, plug-ins and graphs on small inputs."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tagloom.functions import metadata
from tagloom.functions import tags as tg
from tagloom.operators import catalog, clusters, graphs, models
from tagloom.sources import catalog as src


def test_edits_are_replayed(spark):
    random.seed(4)
    steps = []
    for seq in range(3000):
        kind = random.choice(["edit", "edit", "undo", "undo", "redo"])
        steps.append((random.randrange(12), seq, kind, None, [f"t{seq}"] if kind == "edit" else None))
    states = {}
    for item, _, kind, _, new in sorted(steps, key=lambda s: s[1]):
        now, back, forth = states.setdefault(item, [None, [], []])
        if kind == "edit":
            back = (back + [now] * (now is not None))[-5:]
            states[item] = [new, back, []]
        elif kind == "undo" and back:
            states[item] = [back[-1], back[:-1], forth + [now]]
        elif kind == "redo" and forth:
            states[item] = [forth[-1], (back + [now])[-5:], forth[:-1]]
    found = catalog.replayed(spark.createDataFrame(steps, f"item_id long, seq long, {catalog.STEP}"), depth=5)
    assert {r.item_id: (r.state, r.undos, r.redos) for r in found.collect()} == {i: (s, len(b), len(f)) for i, (s, b, f) in states.items()}
    assert catalog.replayed(spark.createDataFrame([], f"item_id long, seq long, {catalog.STEP}")).collect() == []


def test_folders_that_are_taken(spark):
    rows = [(1, 5, 1, "x", 2), (2, 4, 2, "x", 2), (3, 3, 3, "x_2", 2), (4, 2, 4, "x", 2), (5, 9, 5, "x", 3)]
    flat = {r.cluster: (r.order, r.folder) for r in clusters.folders(spark.createDataFrame(rows, "cluster int, n int, first int, name string, repeats int")).collect()}
    assert flat == {5: (1, "3_x"), 1: (2, "2_x"), 2: (3, "2_x_2"), 3: (4, "2_x_2_2"), 4: (5, "2_x_3")}
    nested = clusters.folders(spark.createDataFrame(rows[:1], "cluster int, n int, first int, name string, repeats int"), nested=True).first().folder
    assert nested == "2/x"


def test_numbers_over_range_partitions(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(13)
    found = catalog.numbered(rows, [F.desc("k")]).collect()
    assert [r["k"] for r in sorted(found, key=lambda r: r["rank"])] == sorted((r["k"] for r in found), reverse=True)
    assert sorted(r["rank"] for r in found) == list(range(1, 5001)) and catalog.numbered(rows.limit(0), [F.asc("k")]).count() == 0


def test_exact_splits(spark):
    items = lambda n: spark.range(n).withColumnRenamed("id", "item_id")
    for n, percent, fallback, expected in ((10, 80, True, (8, 2)), (1, 80, True, (1, 1)), (3, 10, True, (1, 2)), (3, 10, False, (0, 3)), (0, 80, True, (0, 0))):
        found = [r.split for r in catalog.split_exactly(items(n), "item_id", percent, fallback=fallback).collect()]
        assert (found.count("train"), found.count("valid")) == expected
    a, b = ({r.item_id for r in catalog.split_exactly(items(100).repartition(p), "item_id", seed=s).where("split = 'train'").collect()} for p, s in ((3, 1), (7, 1)))
    assert a == b and a != {r.item_id for r in catalog.split_exactly(items(100), "item_id", seed=2).where("split = 'train'").collect()}


def test_shuffles_keep_tags(spark):
    rows = [(i, [f"t{j}" for j in range(i % 9)] + ["t0"] * (i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, tags array<string>")
    once, again, other = ({r.id: r.t for r in df.select("id", tg.shuffled(F.col("tags"), keep, seed).alias("t")).collect()} for keep, seed in ((True, 1), (True, 1), (False, 2)))
    assert once == again and once != dict(rows) and other != once
    assert all(sorted(once[i]) == sorted(t) == sorted(other[i]) and once[i][:1] == t[:1] for i, t in rows)


def test_tag_texts(spark):
    df = spark.createDataFrame([(["a", "b"], "a ,b", "x/y z/é.1.png"), (["a"], "b\tc", ".hid/n")], "tags array<string>, text string, path string")
    first, second = df.select(tg.committed(F.col("tags"), F.col("text")).alias("c"), tg.cache_name(F.col("path")).alias("n"), catalog.pasted(F.col("tags"), F.col("text")).alias("p")).collect()
    assert (first.c.tags, first.c.changed, first.n, first.p) == (["a", "b"], False, "x_y_z_é.1.png", ["a", "b", "a", "b"])
    assert (second.c.tags, second.c.changed, second.n) == (["b\tc"], True, ".hid_n.png")
    assert [tg.unescaped(s) for s in (r"\n", r"\t;", "", ", ", "\\")] == ["\n", "\t;", ", ", ", ", "\\"]


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II5B", 640, 480, 8, 2, 0, 0, 0))


def test_png_texts_and_listings(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "B.png").write_bytes(PNG + chunk(b"tEXt", b"parameters\0a, b\nSteps: 3") + chunk(b"tEXt", b"bad") + chunk(b"zTXt", b"z\0\0" + zlib.compress(b"zip")) + chunk(b"iTXt", "i\0\1\0de\0ü\0".encode() + zlib.compress("ünt".encode())) + chunk(b"IEND", b""))
    (tmp_path / "sub/a.GIF").write_bytes(b"GIF89a" + struct.pack("<HH", 30, 20) + b"\0" * 9)
    (tmp_path / "sub/c-MASKLABEL.png").write_bytes(PNG[:20])
    (tmp_path / "sub/n-mask2.bmp").write_bytes(b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -9) + b"\0" * 9)
    (tmp_path / "x.txt").write_text("no")
    files = spark.read.format("binaryFile").load(f"{tmp_path}/B.png").unionByName(spark.read.format("binaryFile").load(f"{tmp_path}/x.txt"))
    texts = {r.path.rsplit("/", 1)[1]: r.texts for r in src.png_texts(files).collect()}
    assert texts == {"B.png": {"parameters": "a, b\nSteps: 3", "z": "zip", "i": "ünt"}, "x.txt": {}}
    kinds = src.png_texts(files).select(metadata.source_of(F.col("texts")).alias("k"), "path").collect()
    assert {r.path.rsplit("/", 1)[1]: r.k for r in kinds} == {"B.png": "text", "x.txt": ""}
    found = src.scan_images(spark, f"{tmp_path}/sub", str(tmp_path), originals=(str(tmp_path),)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.relative_path, r.root, r.width, r.height, r.is_original) for r in found] == [("a.GIF", None, 0, 30, 20, True), ("B.png", None, 1, 640, 480, True), ("n-mask2.bmp", None, 0, 7, 9, True)]
    deep = src.scan_images(spark, str(tmp_path), skip="any mask").collect()
    assert [(r.relative_path, r.width, r.height, r.is_original) for r in deep] == [("B.png", 640, 480, False), ("sub/a.GIF", 30, 20, False)]
    assert len(src.scan_images(spark, str(tmp_path), skip="nothing").collect()) == 4


def test_dictionaries_of_a_folder(spark, tmp_path):
    for name, rows in (("b.parquet", [("cat_one", 1, 5, "c1, c2")]), ("a.parquet", [("dog", 2, 9, ""), (" ", 0, 0, "")])):
        spark.createDataFrame(rows, "name string, category int, post_count long, aliases string").toPandas().to_parquet(tmp_path / name)
    (tmp_path / "custom_tags.txt").write_text("Cat One\n\nown_tag\nown tag\n dog \n")
    rows = src.dictionary_folder(spark, str(tmp_path)).orderBy("load_seq").collect()
    assert [(r.name, r.display_name, r.category, r.post_count) for r in rows] == [("dog", "dog", 2, 9), ("cat_one", "cat one", 1, 5), ("own_tag", "own tag", 0, 0)]


def test_sources_and_files(spark):
    empty = spark.createDataFrame([], "seq int, path string, original boolean")
    some = catalog.with_source(catalog.with_source(catalog.with_source(empty, "/a", True), "/b"), "/a")
    assert sorted(map(tuple, some.collect())) == [(0, "/a", True), (1, "/b", False)]
    assert sorted(map(tuple, catalog.with_source(some, "/b", True).collect())) == [(0, "/a", False), (1, "/b", True)]
    items = spark.createDataFrame([("/r/a.png", ["/r/a.txt"])], "path string, sidecars array<string>")
    assert {r.stays for r in catalog.file_plan(items, "move", "/r/sub", "/r").collect()} == {True}
    assert [(r.source, r.destination, r.stays) for r in catalog.file_plan(items, "trash").collect()] == [("/r/a.png", None, False), ("/r/a.txt", None, False)]
    labels = spark.createDataFrame([("a.b.png", [1]), ("c.png", [])], "path string, labels array<int>")
    assert [tuple(r) for r in catalog.masked_manifest(labels).collect()] == [("a.b.png", "a.b-mask.png")]
    assert catalog.number_in_range("3", 1, 5) == 3
    for bad in ("x", "9", "1.5"):
        with pytest.raises(ValueError):
            catalog.number_in_range(bad, 1, 5)


FORGE = 'cat, dog <lora:x:0.8> sky AND tree\nNegative prompt: blurry\nSteps: 30, Sampler: Euler a, Size: 512x768, Note: "a, b", Extra: {"k": [1, {"z": {}}]}, Steps: 31, Version: v1, with comma, Model hash: abc'


def test_generation_texts(spark):
    texts = [FORGE, "Steps: 5, Size: 8 x 9", "only a prompt\n", "x\nNegative prompt:\ny\nSteps: no digit", "a\nSteps: 1, A: b\nmore\nSteps: 2, C: {open", "", 'p\nSteps: 3, Q: "never closed, x: y']
    out = [r.m for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", metadata.parse(F.col("t")).alias("m")).orderBy("i").collect()]
    assert out[0].tags == ["cat", "dog", "<lora:x:0.8>", "sky", "tree"] and out[0].negative == "blurry" and (out[0].width, out[0].height) == (512, 768)
    assert out[0].settings == {"Steps": "31", "Sampler": "Euler a", "Size": "512x768", "Note": "a, b", "Extra": '{"k": [1, {"z": {}}]}', "Version": "v1, with comma", "Model hash": "abc"}
    assert (out[1].positive, out[1].width, out[1].height, out[1].format) == ("", 8, 9, "settings")
    assert (out[2].positive, out[2].settings, out[2].format) == ("only a prompt", {}, "plain")
    assert (out[3].positive, out[3].negative) == ("x", "y\nSteps: no digit")
    assert out[4].positive == "a\nSteps: 1, A: b\nmore" and out[4].settings == {"Steps": "2", "C": "{open"}
    assert out[5].format == "plain" and out[6].settings == {"Steps": "3", "Q": "never closed, x: y"}


def test_graphs_with_cycles_titles_and_bad_json(spark):
    import json

    link = lambda n: [str(n), 0]
    node = lambda kind, title=None, **i: {"class_type": kind, "inputs": i} | ({"_meta": {"title": title}} if title else {})
    cycle = {"1": node("KSampler", positive=link(2), negative=link(5), seed=7, steps=link(9)), "2": node("A", x=link(3), y=link(4)), "3": node("B", x=link(2)), "4": node("CLIPTextEncode", text="deep", clip=link(5)), "5": node("TextEncodeX", clip=link(4), other="fallback", more="no"), "6": node("KSamplerB", positive=link(7), seed=8, cfg=1.5), "7": node("CLIPTextEncode", prompt="second", text=link(1))}
    titles = {"a": node("CLIPTextEncode", "the Negative one", text="bad"), "b": node("CLIPTextEncode", "A prompt", text="good"), "c": node("CLIPTextEncode", "other", text="none"), "d": node("VAELoader", vae_name="v"), "e": node("EmptyLatentImage", width=64, height=32), "f": node("EmptyImage", width=1, height=1)}
    rows = [(1, json.dumps(cycle)), (2, json.dumps(titles)), (3, "{bad"), (4, "[]"), (5, None)]
    out = {r.item_id: r for r in graphs.prompts(spark.createDataFrame(rows, "item_id long, graph string")).collect()}
    assert (out[1].positive, out[1].negative, out[1].settings) == ("deep\nsecond", "fallback", {"seed": "7", "cfg": "1.5"})
    assert (out[2].positive, out[2].negative, out[2].settings, out[2].width) == ("good", "bad", {"vae": "v", "size": "64x32"}, 64)
    assert all(out[i].positive == "" and out[i].settings == {} and out[i].width is None for i in (3, 4, 5))


def test_plug_ins(spark):
    class Captioner:
        def __call__(self, values):
            return [["new", v] for v in values]

        def finalize(self):
            pass

    models.register("test caption", "array<string>", replaces=False)(Captioner)
    models.register("test replace", "array<string>", replaces=True)(lambda: lambda values: [["r"] if v != "b" else 1 / 0 for v in values])
    models.register("test mask", "string", wants_mask=True)(lambda: lambda values: [f"{v['image']}+{v['mask']}" for v in values])
    models.register("test no mask", "string")(lambda: lambda values: [f"{v['image']}+{v['mask']}" for v in values])
    items = spark.createDataFrame([("a", ["x"], "i", "m"), ("b", ["y"], "j", None)], "path string, tags array<string>, image string, mask string")
    assert [r.tags for r in models.captioned(items, "test caption", "path").orderBy("path").collect()] == [["x", "new", "a"], ["y", "new", "b"]]
    replaced = models.captioned(items, "test replace", "path").orderBy("path").collect()
    assert [r.tags for r in replaced] == [["r"], ["y"]] and "ZeroDivisionError" in replaced[1].error
    assert [r.modified for r in models.modified(items, "test mask").collect()] == ["i+m"]
    assert sorted(r.modified for r in models.modified(items, "test no mask").collect()) == ["i+None", "j+None"]
    models.register("test make", "string")(lambda: lambda values: [f"made {v}" for v in values])
    cache = spark.createDataFrame([("a.png", "old")], "key string, generated string")
    assert {r.path: r.generated for r in models.generated(items, "test make", "path", cache).collect()} == {"a": "old", "b": "made b"}

    @models.job("test job", [{"name": "n", "label": "N", "type": "number", "default": 2}])
    def numbers(spark, n):
        return spark.range(int(n))

    assert "test job" in models.jobs() and models.run_job(spark, "test job").count() == 2 and models.run_job(spark, "test job", n="3").count() == 3
    with pytest.raises(ValueError):
        models.run_job(spark, "test job", m=1)
    with pytest.raises(ValueError):
        models.job("bad", [{"name": "n", "type": "colour", "label": "", "default": 0}])
