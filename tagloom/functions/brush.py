"""Strokes of a brush on an item's labels: masks as outlines, and labels that a stroke joins or cuts.

An item's labels and stroke are one row of an Arrow batch; memory is that of a few masks of
one image.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.functions import masks

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LABELS = T.ArrayType(T.StructType([T.StructField("class_id", T.IntegerType()), T.StructField("bbox", masks.BOX), T.StructField("polygon", T.ArrayType(POINT))]))
#: The least area of a shape in pixels, and how far a polygon may be from the
#: outline, as a share of the outline's length.
LEAST_AREA, SLACK = 50, 0.004
#: Steps to the eight neighbours, clockwise from the right.
STEPS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
#: By the last step's direction and which neighbours are inside, as bits: the next step's direction.
TURNS = tuple(tuple(next((d for d in ((came + 6 + turn) % 8 for turn in range(8)) if code >> d & 1), None) for code in range(256)) for came in range(8))


def _after(points: np.ndarray, by: int = 1) -> np.ndarray:
    """The points of a closed line, from another one on."""
    return np.concatenate([points[by:], points[:by]])


def outline(number: np.ndarray, k: int, x: int, y: int) -> np.ndarray:
    """The pixels (x, y) around the region k of numbered regions, clockwise; x, y is the first
    pixel of its first row.

    Each step looks for the next pixel from the left of the last one's direction on.
    """
    height, wide = number.shape[0] + 2, number.shape[1] + 2
    inside = np.zeros((height + 2, wide + 2), np.uint8)
    inside[2:-2, 2:-2] = number == k
    codes = np.zeros((height, wide), np.uint8)
    for d, (dx, dy) in enumerate(STEPS):
        codes |= inside[1 + dy : 1 + dy + height, 1 + dx : 1 + dx + wide] << d
    flat = codes.tobytes()
    ahead = [dx + dy * wide for dx, dy in STEPS]
    start = at = (y + 1) * wide + x + 1
    found, came, first = [start], 0, None
    while True:
        d = TURNS[came][flat[at]]
        if d is None or at == start and d == first:
            break
        first = d if first is None else first
        at, came = at + ahead[d], d
        found.append(at)
    around = np.array(found if d is None else found[:-1])
    return np.stack([around % wide - 1, around // wide - 1], axis=1)


def simplified(points: np.ndarray, slack: float) -> np.ndarray:
    """Some of a closed line's points, none of the others farther than slack from the new line.

    The line is halved at the point farthest from the first one, and each piece is cut at
    its farthest point while that is too far.
    """
    far = int(((points - points[0]) ** 2).sum(1).argmax())
    ring = np.concatenate([points, points[:1]]).astype(float)
    kept, todo = {0, far}, [(0, far), (far, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        line, rest = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
        share = np.clip(rest @ line / max(line @ line, 1e-12), 0, 1)
        away = np.hypot(*(rest - share[:, None] * line).T)
        if away.max() > slack:
            c = a + 1 + int(away.argmax())
            kept.add(c)
            todo += [(a, c), (c, b)]
    return points[sorted(kept)]


def polygons(a: np.ndarray) -> list[np.ndarray]:
    """The outer outlines of a mask's regions as polygons of pixels, in order of their first pixel.

    Holes are filled, with what is in them; regions under LEAST_AREA are left out.
    """
    number, out = masks.parts(a), []
    covered = np.zeros(a.shape, bool)
    ys, xs = np.nonzero(number)
    ks, first, of = np.unique(number[ys, xs], return_index=True, return_inverse=True)
    low, high = np.full((len(ks), 2), max(a.shape)), np.zeros((len(ks), 2), np.int64)
    for i, at in enumerate((xs, ys)):
        np.minimum.at(low[:, i], of, at)
        np.maximum.at(high[:, i], of, at)
    # Too small in a box is too small, with all that is in the holes.
    todo = [i for i in np.argsort(first) if (high[i] - low[i]).prod() >= LEAST_AREA]
    for i in todo:
        if covered[ys[first[i]], xs[first[i]]]:
            continue  # in another's hole
        box = tuple(slice(low[i, j], high[i, j] + 1) for j in (1, 0))
        points = outline(number[box], ks[i], xs[first[i]] - low[i, 0], 0)
        ahead = _after(points)
        step = ahead - points
        corners = points[(step != _after(step, -1)).any(1)]
        if i != todo[-1]:
            covered[box] |= masks.filled([tuple(map(int, p)) for p in corners], *(high[i] - low[i] + 1)) > 0
        area = abs((points[:, 0] * ahead[:, 1] - ahead[:, 0] * points[:, 1]).sum()) / 2
        if area >= LEAST_AREA:
            points = simplified(corners, SLACK * np.hypot(*step.T).sum())
            if len(points) >= 3:
                out.append(points + low[i])
    return out


def _labels(a: np.ndarray, class_id: int | None) -> list[dict]:
    out, size = [], np.array(a.shape[::-1])
    for points in polygons(a):
        shares = points / size
        low, high = shares.min(0), shares.max(0)
        box = dict(zip(("cx", "cy", "w", "h"), map(float, (*(low + high) / 2, *(high - low)))))
        out.append({"class_id": class_id, "bbox": box, "polygon": [{"x": float(x), "y": float(y)} for x, y in shares]})
    return out


def _stroked(labels: list | None, stroke: dict | None, class_id: int | None, mode: str) -> list[dict]:
    labels = labels or []
    if not stroke or stroke["data"] is None:
        return labels
    drawn = np.where(masks._array(stroke) > 127, 255, 0).astype(np.uint8)
    if mode == "new":
        return labels + _labels(drawn, class_id)
    met, height, width = {}, *drawn.shape
    for i, label in enumerate(labels):
        if label["class_id"] == class_id:
            mine = masks._label_mask(label, width, height)
            if mine is not None and (mine & drawn).any():
                met[i] = mine
    if mode == "erase" and not met or not polygons(drawn):
        return labels
    if mode == "combine":
        whole = np.maximum.reduce([drawn, *met.values()])
    else:
        whole = np.where(drawn > 0, 0, np.maximum.reduce(list(met.values())))
    return [x for i, x in enumerate(labels) if i not in met] + _labels(whole, class_id)


def brushed(mode: str):
    """A function of labels, a stroke's mask of the image's size, and the brush's class: the labels after it.

    new: each region of the stroke is a label more. combine: it and the labels of its class
    that it touches become one mask, whose regions are the labels. erase: it is taken out of
    those labels, which may be cut in several or vanish. Others stay as they are, in order,
    before the new ones. A null or empty stroke, and one with no region of LEAST_AREA, changes
    nothing; null labels count as none.
    """
    if mode not in ("new", "combine", "erase"):
        raise ValueError(f"{mode} is no mode")
    arrow = to_arrow_type(LABELS)

    def run(labels: pa.Array, stroke: pa.Array, class_id: pa.Array) -> pa.Array:
        return pa.array([_stroked(*row, mode) for row in zip(labels.to_pylist(), stroke.to_pylist(), class_id.to_pylist())], arrow)

    return F.arrow_udf(run, LABELS)
