"""Label geometry, masks and files of labels."""

import random

import numpy as np
from pyspark.sql import functions as F

from tagloom.functions import geometry as geo
from tagloom.functions import masks
from tagloom.operators import catalog
from tagloom.sources import catalog as src

LABEL = f"class_id int, bbox {geo.BOX}, polygon array<struct<x:double,y:double>>"
LABELS = f"labels array<struct<{LABEL.replace('class_id int', 'class_id:int').replace('bbox ', 'bbox:').replace('polygon ', 'polygon:')}>>"


def test_crops_of_boxes_and_polygons(spark):
    inside, outside = [(0.6, 0.2), (0.9, 0.2), (0.9, 1.5)], [(0.1, 0.1), (0.4, 0.1), (0.2, 0.4)]
    labels = [(0, (0.5, 0.5, 0.2, 0.2), None), (1, (0.2, 0.5, 0.2, 0.2), None), (2, None, inside), (3, None, outside), (4, (0.2, 0.5, 0.2, 0.2), inside), (5, (0.7, 0.5, 0.2, 0.2), outside), (6, None, None), (7, (0.7, 0.5, 0.2, 0.2), inside[:2])]
    df = spark.createDataFrame([(labels,)], LABELS)
    out = df.select(F.explode(geo.crop_labels(F.col("labels"), (F.lit(100), F.lit(100)), (F.lit(50), F.lit(0), F.lit(50), F.lit(100)))).alias("t")).select("t.*").collect()
    assert [r.class_id for r in out] == [0, 2, 7]
    assert [round(v, 9) for v in out[0].bbox] == [0.1, 0.5, 0.2, 0.2]
    assert [(round(p.x, 9), round(p.y, 9)) for p in out[1].polygon] == [(0.2, 0.2), (0.8, 0.2), (0.8, 1.0)] and out[2].polygon is None
    assert df.select(F.size(geo.crop_labels(F.col("labels"), (F.lit(0), F.lit(100)), (F.lit(0), F.lit(0), F.lit(50), F.lit(100))))).first()[0] <= 2


def test_splits_and_scaled_rects(spark):
    one = spark.range(1)
    rects = one.select(geo.split_rects(F.lit(0.0), (F.lit(10), F.lit(20)), False).alias("a"), geo.split_rects(F.lit(0.55), (F.lit(10), F.lit(20)), True).alias("b")).first()
    assert [tuple(r) for r in rects.a] == [(0, 0, 10, 1), (0, 1, 10, 19)] and [tuple(r) for r in rects.b] == [(0, 0, 5, 20), (5, 0, 5, 20)]
    scaled = lambda *r: one.select(geo.scaled_rect(tuple(map(F.lit, r)), (F.lit(50), F.lit(50)), (F.lit(100), F.lit(200)))).first()[0]
    assert tuple(scaled(10.3, 5.0, 60.0, 10.0)) == (20, 20, 80, 40) and scaled(50.0, 0.0, 10.0, 10.0) is None


def test_tolerances():
    assert [geo.hash_bits_allowed(t) for t in (-5, 0, 25, 100, 300)] == [0, 0, 16, 64, 64]
    assert geo.difference_allowed(0) == 0.005 and abs(geo.difference_allowed(100) - 0.3) < 1e-12 and geo.shortlist_bits(100) == 96
    assert geo.tolerance_text("hash", 25) == "match when at most 16 of 256 hash bits differ"
    assert "96 bits" in geo.tolerance_text("both", 50) and "%" in geo.tolerance_text("aligned", 50)


def test_accepted_pairs(spark):
    rows = spark.createDataFrame([(16, 0.99), (17, 0.9), (96, 0.999), (None, 0.999), (16, None)], "bits int, score double")
    took = lambda kind: [r[0] for r in rows.select(geo.pair_accepted(kind, 25, F.col("bits"), F.col("score"))).collect()]
    assert took("hash") == [True, False, False, False, True]
    assert took("aligned") == [True, False, True, True, False] and took("both") == [True, False, True, False, False]


def test_files_of_labels_and_captions_round_trip(spark, tmp_path):
    labels = [(0, (0.5, 0.25, 0.125, 0.5), None), (3, None, [(0.1, 0.1), (0.3, 0.1), (0.3, 0.5)]), (4, None, None)]
    items = spark.createDataFrame([("x/a.png", labels, ["b", "ä c"]), ("y/b.b.jpg", [], [])], f"name string, {LABELS}, tags array<string>")
    src.write_labels(items, f"{tmp_path}/l")
    assert (tmp_path / "l/x/a.txt").read_text() == "0 0.500000 0.250000 0.125000 0.500000\n3 0.100000 0.100000 0.300000 0.100000 0.300000 0.500000\n"
    assert (tmp_path / "l/y/b.b.txt").read_text() == ""
    back = {r.label.class_id: r for r in src.read_labels(spark, f"{tmp_path}/l").collect()}
    assert set(back) == {0, 3} and tuple(back[0].label.bbox) == (0.5, 0.25, 0.125, 0.5)
    src.write_captions(items, f"{tmp_path}/c")
    assert {r.stem: r.tags for r in src.read_captions(spark, f"{tmp_path}/c").collect()}["a"] == ["b", "ä c"]
    classes = spark.createDataFrame([(1, "two", "#f", "polygon"), (0, "one", "#e", "bbox")], "class_id int, name string, color string, kind string")
    form = catalog.label_format(classes)
    copies = src.export_dataset(items.withColumnRenamed("name", "path"), classes, f"{tmp_path}/d", form)
    assert form == "segmentation" and [tuple(r) for r in copies.collect()] == [("x/a.png", f"{tmp_path}/d/images/a.png")]
    assert (tmp_path / "d/classes.txt").read_text() == "one\ntwo\n" and (tmp_path / "d/labels/a.txt").read_text().startswith("0 0.437500 0.000000 0.562500")


def test_classes(spark):
    classes = spark.createDataFrame([(0, "a", "#1", "bbox")], "class_id int, name string, color string, kind string")
    two = catalog.with_new_class(classes, "b", ["#1", "#2"], "polygon")
    assert [tuple(r) for r in two.orderBy("class_id").collect()] == [(0, "a", "#1", "bbox"), (1, "b", "#2", "polygon")]
    lines = catalog.class_lines(two).withColumnRenamed("class_id", "seq")
    assert sorted(map(tuple, catalog.classes_of_lines(lines).collect())) == sorted(map(tuple, two.collect()))
    file = spark.createDataFrame([(0, " x "), (1, ""), (2, "y")], "seq int, line string")
    labels = spark.createDataFrame([(5,)], "class_id int")
    assert [tuple(r) for r in catalog.class_list(labels, file).orderBy("class_id").collect()] == [(0, "x"), (1, "y")]
    assert catalog.class_list(labels, file.limit(0)).count() == 6


def mask(spark, *arrays):
    return spark.createDataFrame([(i, (a.shape[1], a.shape[0], bytearray(a.astype(np.uint8).tobytes()))) for i, a in enumerate(arrays)], f"id int, m {masks.MASK.simpleString()}")


def pixels(rows, column="m"):
    return [None if r[column].data is None else np.frombuffer(bytes(r[column].data), np.uint8).reshape(r[column].height, r[column].width) for r in rows]


def test_masks(spark):
    a = np.zeros((9, 12), np.uint8)
    a[1:4, 1:3] = 255
    a[4, 3] = 255  # touches by a corner
    a[7, 8:11] = 255
    df = mask(spark, a, np.zeros((4, 4)))
    out = df.select(masks.largest("m").alias("l"), masks.inverted("m").alias("i"), masks.dilated(1, 3)("m").alias("d"), masks.mask_box("m").alias("b"), masks.regions(0)("m").alias("r"), masks.cleared_edge(2)("m").alias("e"), masks.merged("m", masks.inverted("m")).alias("o"), masks.erased("m", "m").alias("x"), masks.overlap("m", masks.largest("m")).alias("v")).collect()
    big = a.copy()
    big[7] = 0
    assert (pixels(out, "l")[0] == big).all() and (pixels(out, "i")[0] == 255 - a).all()
    ys, xs = np.nonzero(a)
    cross = np.zeros_like(a)
    for y, x in zip(ys, xs):
        for dy, dx in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)):
            if 0 <= y + dy < 9 and 0 <= x + dx < 12:
                cross[y + dy, x + dx] = 255
    assert (pixels(out, "d")[0] == cross).all()
    assert [round(v, 9) for v in out[0].b] == [0.5, 0.5, round(10 / 12, 9), round(7 / 9, 9)] and out[1].b is None or all(v is None for v in out[1].b)
    assert sorted(map(tuple, out[0].r)) == [(1, 1, 4, 5), (8, 7, 11, 8)] and [tuple(x) for x in out[1].r] == [(0, 0, 4, 4)]
    edge = a.copy()
    edge[:2], edge[7:], edge[:, :2], edge[:, 10:] = 0, 0, 0, 0
    assert (pixels(out, "e")[0] == edge).all() and (pixels(out, "o")[0] == 255).all() and not pixels(out, "x")[0].any() and out[0].v and not out[1].v


def test_regions_by_flood(spark):
    random.seed(1)
    for _ in range(30):
        a = np.array([[255 * (random.random() < 0.45) for _ in range(13)] for _ in range(11)], np.uint8)
        number, seen, count = masks.parts(a), np.zeros_like(a, bool), 0
        for y, x in zip(*np.nonzero(a)):
            if seen[y, x]:
                continue
            count, todo, here = count + 1, [(y, x)], set()
            while todo:
                p = todo.pop()
                if 0 <= p[0] < 11 and 0 <= p[1] < 13 and a[p] and p not in here:
                    here.add(p)
                    todo += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            for p in here:
                seen[p] = True
            assert {number[p] for p in here} == {number[y, x]} and (number == number[y, x]).sum() == len(here)
    assert masks.joined_boxes([(0, 0, 1, 1), (5, 5, 6, 6), (1, 1, 5, 5), (9, 9, 9, 9)]) == [(0, 0, 6, 6), (9, 9, 9, 9)]


def test_shapes_to_masks(spark):
    labels = [(0, (0.5, 0.5, 0.5, 0.5), None), (1, None, [(0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.5)])]
    df = spark.createDataFrame([(labels[:1], 1), (labels[1:], 2), ([], 3), (labels, 4)], f"{LABELS}, k int")
    box, square, none, both = pixels(df.select(masks.label_mask("labels", F.lit(8), F.lit(8)).alias("m"), "k").orderBy("k").collect())
    assert (np.nonzero(box)[0].min(), np.nonzero(box)[0].max(), np.nonzero(box)[1].max()) == (2, 6, 6)
    assert (square[:5, :5] == 255).all() and square.sum() == 25 * 255 and none is None and (both == np.maximum(box, square)).all()


def test_borders_and_agreement(spark):
    a = np.full((10, 20), 90)
    a[:2], a[9:], a[:, :3] = 0, 0, 0
    dark = np.zeros((5, 5))
    rows = mask(spark, a, dark, np.full((5, 5), 99)).select(masks.borders(10)("m").alias("b"), masks.border_mask("m", masks.borders(10)("m")).alias("m")).collect()
    assert [tuple(r.b) for r in rows] == [(2, 1, 3, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert pixels(rows)[1] is None and pixels(rows)[0].sum() == 255 * 7 * 17
    rng = np.random.default_rng(0)
    x = rng.integers(50, 150, (64, 64))
    y = x + 20
    y[:16, :16] = 250
    whole, part = np.full((64, 64), 255), np.zeros((64, 64))
    part[:5] = 255
    df = mask(spark, x, y, whole, part).groupBy().pivot("id", [0, 1, 2, 3]).agg(F.first("m"))
    same, other, few = df.select(masks.aligned_score("0", "0", "2"), masks.aligned_score("0", "1", "2"), masks.aligned_score("0", "0", "3")).first()
    assert same == 1 and other == 1 - 16 / 256 and few == 0


def test_six_digits_as_in_c(spark):
    random.seed(2)
    values = [0.0, -0.25, 3.5e-6, 2.5e-6, 1.5e-6, 5e-7, 4.9e-7, 0.1328125, 0.1171875, 0.9999995, 0.9999996, 1.0, 3.9999999, -1e-9, 0.00390625]
    values += [random.randrange(4_000_000) / 1e6 + 5e-7 for _ in range(3000)] + [random.random() for _ in range(2000)] + [random.randrange(512) / 128 for _ in range(500)] + [random.random() / 3000 for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    wrong = [(v, got) for v, got in df.select("v", geo.six_digits(F.col("v"))).collect() if got != f"{v:.6f}"]
    assert not wrong, wrong[:5]


def test_a_side_of_a_box_is_written_once(spark):
    """Six digits are exact, also at halves, and take no decimals, which cost most of label_files."""
    import random

    from pyspark.sql import functions as F

    from tagloom.functions import geometry as geo

    rng = random.Random(3)
    values = [s * v for k in (rng.randrange(4_000_000) for _ in range(500)) for v in ((k + 0.5) / 1e6, k / 128 % 4, rng.uniform(0, 4), 0.49999999999999994e-6) for s in (1, -1)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", geo.six_digits(F.col("v")).alias("t"))
    assert [r.t for r in df.collect()] == [f"{v:.6f}" for v in values]
    box = geo.box(F.col("v"), F.lit(0.5), F.lit(0.25), F.lit(0.25))
    plan = df.select(geo.polygon_line(F.lit(1), box, F.lit(None).cast("array<struct<x:double,y:double>>")))._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal" not in plan
