"""Strokes on labels: outlines go back to their masks, and labels join, part and vanish."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import brush, masks


def back(a):
    out = np.zeros_like(a)
    for points in brush.polygons(a):
        out |= masks.filled([tuple(map(int, p)) for p in points], a.shape[1], a.shape[0])
    return out


def grown(a):
    wide = np.pad(a, 1)
    return np.maximum.reduce([wide[y : y + a.shape[0], x : x + a.shape[1]] for y in range(3) for x in range(3)])


def test_masks_and_polygons_and_back():
    y, x = np.mgrid[:90, :120]
    rng = np.random.default_rng(3)
    shapes = [(x - 50) ** 2 + (y - 40) ** 2 < 900, (x - 20) ** 2 / 4 + (y - 45) ** 2 < 60, (abs(x - 60) < 30) & (abs(y - 45) < 20), ((x - 50) ** 2 + (y - 40) ** 2 < 900) | (abs(x - 95) < 12) & (abs(y - 70) < 12)]
    for _ in range(5):
        shapes.append(np.logical_or.reduce([(x - cx) ** 2 + (y - cy) ** 2 < r * r for cx, cy, r in zip(rng.integers(15, 105, 6), rng.integers(15, 75, 6), rng.integers(6, 14, 6))]))
    for shape in shapes:
        a = np.where(shape, 255, 0).astype(np.uint8)
        full = np.zeros_like(a)  # without holes, as outlines are outer ones
        number = masks.parts(a)
        for k in np.unique(number)[1:]:
            ys, xs = np.nonzero(number == k)
            full |= masks.filled([tuple(map(int, p)) for p in brush.outline(number, k, xs[0], ys[0])], 120, 90)
        assert (full >= a).all()
        exact = [p for p in brush.polygons(a)]
        assert exact
        slack = 1 + int(np.ceil(max(brush.SLACK * 2 * (np.ptp(p, 0).sum()) for p in exact)))
        far, near = back(a), full
        for _ in range(slack):
            far, near = grown(far), grown(near)
        assert (back(a) <= near).all() and (full <= far).all()


def test_outlines_of_odd_shapes():
    a = np.zeros((12, 12), np.uint8)
    a[3, 4] = 255
    assert brush.outline(masks.parts(a), masks.parts(a).max(), 4, 3).tolist() == [[4, 3]] and brush.polygons(a) == []
    a[3, 4:9] = 255  # a line: there and back again
    assert len(brush.outline(masks.parts(a), masks.parts(a).max(), 4, 3)) == 8 and brush.polygons(a) == []
    a[:] = 255
    assert brush.polygons(a)[0].tolist() == [[0, 0], [11, 0], [11, 11], [0, 11]]
    ring = np.full((30, 30), 255, np.uint8)
    ring[5:25, 5:25] = 0
    ring[10:20, 10:20] = 255  # in the hole of another
    assert len(brush.polygons(ring)) == 1


def rect(x0, x1, y0, y1, size=64):
    a = np.zeros((size, size), np.uint8)
    a[y0 : y1 + 1, x0 : x1 + 1] = 255
    return a


def box(label, size=64):
    b = label["bbox"]
    return tuple(round(v * size, 6) for v in (b["cx"] - b["w"] / 2, b["cx"] + b["w"] / 2, b["cy"] - b["h"] / 2, b["cy"] + b["h"] / 2))


def label(class_id, x0, x1, y0, y1, size=64):
    return (class_id, ((x0 + x1) / 2 / size, (y0 + y1) / 2 / size, (x1 - x0) / size, (y1 - y0) / size), None)


def test_modes(spark):
    labels = [label(1, 4, 20, 8, 40), label(1, 30, 50, 8, 40), label(2, 4, 50, 8, 40), label(1, 4, 20, 50, 60), (1, None, None)]
    rows = [(0, labels, rect(16, 34, 8, 40)), (1, labels, rect(40, 44, 0, 63)), (2, None, rect(10, 30, 10, 30)), (3, labels, None), (4, labels, rect(9, 9, 9, 9)), (5, [], rect(0, 63, 0, 63)), (6, labels, rect(0, 63, 0, 63))]
    shape = f"id int, labels {brush.LABELS.simpleString()}, m {masks.MASK.simpleString()}"
    df = spark.createDataFrame([(i, x, None if a is None else (64, 64, bytearray(a.tobytes()))) for i, x, a in rows], shape)
    one = F.lit(1)
    new, both, cut = ([r[0] for r in df.select(brush.brushed(mode)("labels", "m", one).alias("l"), "id").orderBy("id").select("l").collect()] for mode in ("new", "combine", "erase"))
    assert [len(x) for x in new] == [6, 6, 1, 5, 5, 1, 6]
    assert [(x["class_id"], box(x)) for x in both[0] if x["bbox"]] == [(2, (4, 50, 8, 40)), (1, (4, 20, 50, 60)), (1, (4, 50, 8, 40))]
    assert [(x["class_id"], box(x)) for x in cut[1] if x["bbox"]] == [(1, (4, 20, 8, 40)), (2, (4, 50, 8, 40)), (1, (4, 20, 50, 60)), (1, (30, 39, 8, 40)), (1, (45, 50, 8, 40))]
    assert [box(x) for x in both[2]] == [(10, 30, 10, 30)] and cut[2] == [] and cut[5] == []
    assert len(both[3]) == len(cut[3]) == len(both[4]) == len(cut[4]) == 5
    assert [x["class_id"] for x in cut[6]] == [2, 1] and cut[6][1]["bbox"] is None
    assert df.limit(0).select(brush.brushed("erase")("labels", "m", one)).collect() == []
    with pytest.raises(ValueError):
        brush.brushed("paint")
