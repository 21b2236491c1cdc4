import fnmatch
import re

import pytest
from pyspark.sql import functions as F

from tagloom.functions import geometry, metadata, tags
from tagloom.operators import catalog, clusters, duplicates
from tagloom.sources import catalog as sources

ITEMS = [(1, "a/cat_01.png", ["cat", "long hair", "Solo"]), (2, "a/dog_02.png", ["dog", "solo", "solo"]), (3, "b/sun-set.png", ["sun", "shadow"]), (4, "b/or.png", []), (5, "b/cat dog.png", ["cat", "dog", "1girl (x)"])]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "id long, name string, tags array<string>").cache()


N, T = lambda: F.col("name"), lambda: F.col("tags")


@pytest.mark.parametrize(
    "predicate, ids",
    [
        (lambda: tags.text_matches(N(), T(), "cat"), [1, 5]),
        (lambda: tags.tag_is(T(), "SOLO"), [1, 2]),
        (lambda: tags.tag_is(T(), "cat") & ~tags.tag_is(T(), "dog"), [1]),
        (lambda: tags.tag_is(T(), "cat") | tags.tag_is(T(), "sun"), [1, 3, 5]),
        (lambda: F.size("tags") >= 3, [1, 2, 5]),
        (lambda: tags.regex_matches(N(), T(), "^sun$"), [3]),
        (lambda: tags.tag_is(T(), "l*r"), [1]),
        (lambda: tags.name_is(N(), "*dog*"), [2, 5]),
        (lambda: ~tags.tag_is(T(), "solo"), [3, 4, 5]),
        (lambda: tags.tag_is(T(), "1girl (x)"), [5]),
        (lambda: tags.regex_matches(N(), T(), "("), []),
    ],
)
def test_predicates(items, predicate, ids):
    assert sorted(r.id for r in items.where(predicate()).collect()) == ids


@pytest.mark.parametrize("pattern", ["a*b", "?at", "[a-c]at*", "[!a]*", "a.b?", "*(x)", "a[", "x*\n?"])
def test_globs(spark, pattern):
    words = ["axxb", "cat", "bat", "AT", "dat s", "a.bc", "1 (x)", "a[", "x\n\nb", "ab\n"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    found = {r.w for r in rows.where(F.col("w").rlike(tags.glob(pattern))).collect()}
    assert found == {w for w in words if re.match(fnmatch.translate(pattern.lower()), w.lower())}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*values):
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def test_edits(spark):
    check = lambda column, expected: (lambda got: got == expected or pytest.fail(f"{got} != {expected}"))(one(spark, column))
    check(tags.dedupe(arr("a", "A ", "b")), ["a", "b"])
    check(tags.to_front(arr("a", "b", "c", "b"), ["b", "z"]), ["b", "a", "c"])
    check(tags.merge_prompt(arr("cat"), arr("Cat", "dog", "DOG")), ["cat", "dog"])
    check(tags.strip_reasoning(F.lit("<think>x</think> hi")), "hi")
    check(tags.strip_reasoning(F.lit("x</think> hi")), "hi")
    check(tags.split_prompt(F.lit("cat, dog <lora:x:0.8> sky AND tree")), ["cat", "dog", "<lora:x:0.8>", "sky", "tree"])
    check(tags.split_caption(F.lit(" a ,\t b,,c \n")), ["a", "b", "c"])
    check(tags.split_caption(F.lit("a\nb, c\n"), "\n"), ["a", "b, c"])
    check(tags.order_alphabetically(arr("x", "b", "B", "a"), True), ["x", "a", "b", "B"])
    check(tags.order_alphabetically(arr()), [])
    check(tags.reverse(arr("x", "b", "a"), True), ["x", "a", "b"])
    check(tags.replace(arr("ab", "b"), "(", "x", regex=True), ["ab", "b"])
    check(tags.append_absent(arr("a"), arr("b", "b", "a")), ["a", "b"])
    check(tags.folder_name(F.lit("  A b/Ç--d!! ")), "a_b_ç--d")
    for n, shown in ((0, ""), (7, "7"), (3400, "3k"), (1_250_000, "1.2M")):
        check(tags.compact_count(F.lit(n)), shown)
    assert one(spark, tags.dedupe(F.lit(None).cast("array<string>"))) is None


@pytest.mark.parametrize("line, cls, box, points", [("0 0.5 0.5 0.2 0.4", 0, (0.5, 0.5, 0.2, 0.4), None), ("1 0.1 0.1 0.3 0.1 0.3 0.5", 1, (0.2, 0.3, 0.2, 0.4), 3), ("0 0.1 0.2 0.3", None, None, None), ("0 .1 .1 .1 .1 .1", None, None, None), ("0.0 .5 .5 .2 .2", None, None, None), ("cat, dog", None, None, None), ("", None, None, None)])
def test_label_lines(spark, line, cls, box, points):
    got = one(spark, geometry.parse_yolo(F.lit(line)))
    if cls is None:
        assert got is None
    else:
        assert got.class_id == cls and tuple(got.bbox) == pytest.approx(box) and (got.polygon and len(got.polygon)) == points


def test_crop(spark):
    size, rect = (F.lit(100), F.lit(100)), (F.lit(50), F.lit(0), F.lit(50), F.lit(100))
    d = lambda *v: [F.lit(float(x)) for x in v]
    assert tuple(one(spark, geometry.crop(*d(0.5, 0.5, 0.2, 0.2), size, rect))) == pytest.approx((0.1, 0.5, 0.2, 0.2))
    assert one(spark, geometry.crop(*d(0.2, 0.5, 0.2, 0.2), size, rect)) is None


def test_tolerance():
    assert [geometry.hash_bits_allowed(t) for t in (0, 25, 100, 900)] == [0, 16, 64, 64]


def test_metadata(spark):
    text = 'cat, dog <lora:x:0.8> sky AND tree\nNegative prompt: blurry\nSteps: 30, Sampler: Euler a, Size: 512x768, Note: "a, b", Extra: {"k": [1, 2]}, Version: v1'
    got = one(spark, metadata.parse(F.lit(text)))
    assert got.tags == ["cat", "dog", "<lora:x:0.8>", "sky", "tree"] and got.negative == "blurry" and (got.width, got.height) == (512, 768)
    assert got.settings == {"Steps": "30", "Sampler": "Euler a", "Size": "512x768", "Note": "a, b", "Extra": '{"k": [1, 2]}', "Version": "v1"}
    plain = one(spark, metadata.parse(F.lit("just a prompt")))
    assert plain.positive == "just a prompt" and plain.settings == {} and plain.format == "plain"
    graph = '{"3": {"class_type": "Load", "_meta": {"title": "Input image"}}, "4": {"class_type": "Save"}}'
    assert [n.id for n in one(spark, metadata.nodes_titled(F.lit(graph), "input"))] == ["3"]
    assert one(spark, metadata.graph_nodes(F.lit("{bad"))) is None


def test_components_and_balance(spark):
    links = spark.createDataFrame([(0, 1), (1, 2), (4, 5)] + [(10 + i, 11 + i) for i in range(40)], "a long, b long")
    found = dict(map(tuple, duplicates.components(links).collect()))
    assert found == {0: 0, 1: 0, 2: 0, 4: 4, 5: 4} | {10 + i: 10 for i in range(41)}
    sizes = spark.createDataFrame([("a", 3), ("b", 5), ("c", 10), ("d", 1)], "cluster string, n long")
    got = {r.cluster: (r.cap, r.kept, r.repeats) for r in clusters.kept_sizes(sizes, 3, 150, 5).collect()}
    assert got == {"a": (8, 3, 2), "b": (8, 5, 1), "c": (8, 8, 1)}
    even = spark.createDataFrame([("a", 3), ("b", 3)], "cluster string, n long")
    assert {r.cap for r in clusters.kept_sizes(even, 3, 150, 5).collect()} == {4}


def test_pairs_of_copies_and_monotone_thresholds(spark):
    import random

    random.seed(1)
    base = [random.getrandbits(63) for _ in range(30)]
    rows = [(i, base[i % 30] ^ (1 << random.randrange(60) if i % 3 else 0)) for i in range(200)]
    signed = spark.createDataFrame(rows, "id long, hash long")
    last = set()
    for most in (0, 1, 2, 4):
        found = {(r.a, r.b) for r in duplicates.pairs(signed, most).collect()}
        links = spark.createDataFrame([(a, b) for a, b in found] or [(0, 0)], "a long, b long")
        expected = [(a, b) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= most]
        parts = dict(map(tuple, duplicates.components(links).collect()))
        assert all(parts[a] == parts[b] for a, b in expected)
        assert all((rows[a][1] ^ rows[b][1]).bit_count() <= most for a, b in found)
        last = found


def test_spread_by_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, i % 3, [float(x) for x in v[i]]) for i in range(40)], "id long, cluster int, v array<double>")
    got = {}
    for r in clusters.spread(rows, 4, 5).orderBy("cluster", "step").collect():
        got.setdefault(r.cluster, []).append(r.id)
    for c in range(3):
        ids = [i for i in range(40) if i % 3 == c]
        d = 1 - v[ids] @ v[ids].T
        order = [int(np.argmin(d.sum(1).round(9)))]
        while len(order) < 5:
            near = d[:, order].min(1).round(9)
            near[order] = -1
            order.append(int(np.argmax(near)))
        assert got[c] == [ids[i] for i in order]


def test_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, text in (("a.txt", "cat, dog ,, x\n"), ("sub/b.txt", ""), ("a.png", "x"), ("sub/B-masklabel.png", "x"), ("sub/c.JPG", "xy")):
        (tmp_path / "in" / name).write_text(text)
    assert {r.stem: r.tags for r in sources.read_captions(spark, f"{tmp_path}/in").collect()} == {"a": ["cat", "dog", "x"]}
    found = sources.scan_images(spark, f"{tmp_path}/in", f"{tmp_path}/in/sub").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.root) for r in found) == [("a.png", 0), ("c.JPG", 0)]
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "a.txt").write_text("0 0.5 0.5 0.2 0.4\nbad\n1 .1 .1 .3 .1 .3 .5\n")
    assert sorted((r.stem, r.label.class_id) for r in sources.read_labels(spark, f"{tmp_path}/labels").collect()) == [("a", 0), ("a", 1)]
    items = spark.createDataFrame([("x.png", ["a, b", 'q"t']), ("y.png", [])], "name string, tags array<string>")
    sources.write_snapshot(items, f"{tmp_path}/snap")
    assert {r.name: r.tags for r in sources.read_snapshot(spark, f"{tmp_path}/snap").collect()} == {"x.png": ["a", "b", 'q"t'], "y.png": []}
    spark.createDataFrame([("long_hair", 0, 5, "lh, l_h"), (" ", 0, 1, None)], "name string, category int, post_count int, aliases string").write.parquet(f"{tmp_path}/dict")
    assert [(r.display_name, r.aliases) for r in sources.dictionary(spark, f"{tmp_path}/dict").collect()] == [("long hair", ["lh", "l_h"])]
    (tmp_path / "d.csv").write_text("a_b,1,7,x\nc,bad,worse\nd\n")
    rows = sources.dictionary_csv(spark, f"{tmp_path}/d.csv").collect()
    assert [(r.name, r.category, r.post_count) for r in rows] == [("a_b", 1, 7), ("c", 0, 0)]


def test_split_is_stable_and_near_its_share(spark):
    rows = spark.range(5000).withColumnRenamed("id", "item_id")
    split = {r.item_id: r.split for r in catalog.split_train(rows, "item_id").collect()}
    assert 0.77 < sum(s == "train" for s in split.values()) / 5000 < 0.83
    assert {r.item_id: r.split for r in catalog.split_train(rows.where("item_id < 10"), "item_id").collect()} == {i: split[i] for i in range(10)}


def test_settings_in_braces_of_any_depth(spark):
    deep = "{" * 40 + '"a, B: c": "}' + "}" * 39
    cases = {
        f"Steps: 3, Deep: {deep}, Seed: 7": {"Steps": "3", "Deep": deep, "Seed": "7"},
        'A: "x {, y", B: {"k": {"l": "m, N: o"}}, C: d': {"A": "x {, y", "B": '{"k": {"l": "m, N: o"}}', "C": "d"},
        "A: b {c, D: e}, F: g": {"A": "b {c", "D": "e}", "F": "g"},
        "A: {never {closed}, B: c": {"A": "{never {closed}, B: c"},
        "A: {}, B: {1}, A: z": {"A": "z", "B": "{1}"},
    }
    for line, expected in cases.items():
        got = one(spark, metadata.settings_map(F.lit(line)))
        assert {k: got.get(k) for k in expected} == expected, line
