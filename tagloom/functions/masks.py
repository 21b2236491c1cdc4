"""Binary masks of images, as arrays of bytes, worked on in Arrow batches.

A mask is a struct (width, height, data): rows of pixels from the top, 255 in and 0 out; where
there is none, its data is null.
Spark partitions the items; each function here is a few numpy lines on one of them, with
memory of the size of one mask.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _fields(kind: T.DataType, *names: str) -> T.StructType:
    return T.StructType([T.StructField(n, kind) for n in names])


MASK = T.StructType([*_fields(T.IntegerType(), "width", "height").fields, T.StructField("data", T.BinaryType())])
BOX = _fields(T.DoubleType(), "cx", "cy", "w", "h")
SIDES = _fields(T.IntegerType(), "top", "bottom", "left", "right")
REGIONS = T.ArrayType(_fields(T.IntegerType(), "left", "top", "right", "bottom"))


def _array(mask) -> np.ndarray:
    return np.frombuffer(mask["data"], np.uint8).reshape(mask["height"], mask["width"])


def _struct(a: np.ndarray) -> dict:
    return {"width": a.shape[1], "height": a.shape[0], "data": np.ascontiguousarray(a, np.uint8).tobytes()}


def _rows(frame: pd.DataFrame) -> list:
    return [None if r["data"] is None else r for r in frame.to_dict("records")]


def _masks(found: list) -> pd.DataFrame:
    return pd.DataFrame([f if f else {"width": None, "height": None, "data": None} for f in found], columns=["width", "height", "data"])


def filled(points: list[tuple[int, int]], width: int, height: int) -> np.ndarray:
    """A polygon's pixels: those whose centre is inside by the even-odd rule, and its edges.

    Each row's crossings with the edges, in order, begin and end its runs.
    """
    out = np.zeros((height, width), np.uint8)
    ring = list(zip(points, points[1:] + points[:1]))
    for y in range(max(0, min(p[1] for p in points)), min(height - 1, max(p[1] for p in points)) + 1):
        cross = sorted(x0 + (y - y0) * (x1 - x0) / (y1 - y0) for (x0, y0), (x1, y1) in ring if min(y0, y1) <= y < max(y0, y1))
        for a, b in zip(cross[::2], cross[1::2]):
            out[y, max(0, int(np.ceil(a))) : max(0, int(np.floor(b)) + 1)] = 255
    for (x0, y0), (x1, y1) in ring:
        n = max(abs(x1 - x0), abs(y1 - y0), 1)
        xs, ys = np.rint(np.linspace(x0, x1, n + 1)).astype(int), np.rint(np.linspace(y0, y1, n + 1)).astype(int)
        good = (xs >= 0) & (xs < width) & (ys >= 0) & (ys < height)
        out[ys[good], xs[good]] = 255
    return out


def _label_mask(label, width: int, height: int) -> np.ndarray | None:
    polygon, box = label["polygon"], label["bbox"]
    if polygon is not None and len(polygon) >= 3:
        return filled([(int(p["x"] * width), int(p["y"] * height)) for p in polygon], width, height)
    if box is None:
        return None
    out = np.zeros((height, width), np.uint8)
    x0, x1 = (int((box["cx"] + s * box["w"] / 2) * width) for s in (-1, 1))
    y0, y1 = (int((box["cy"] + s * box["h"] / 2) * height) for s in (-1, 1))
    out[max(0, y0) : max(0, y1 + 1), max(0, x0) : max(0, x1 + 1)] = 255  # the ends are part of it
    return out


@F.pandas_udf(MASK)
def label_mask(labels: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """The mask of an array of labels (polygon, else bbox, in shares), or-ed; null without any shape."""
    out = []
    for each, w, h in zip(labels, width, height):
        shapes = [m for m in (_label_mask(x, int(w), int(h)) for x in (each if each is not None else [])) if m is not None]
        out.append(_struct(np.maximum.reduce(shapes)) if shapes else None)
    return _masks(out)


def _combined(op):
    @F.pandas_udf(MASK)
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _masks([None if x is None and y is None else _struct(op(_array(x or y) if x else np.zeros_like(_array(y)), _array(y) if y else np.zeros_like(_array(x)))) for x, y in zip(_rows(a), _rows(b))])

    return run


#: Masks of one size: what is in either, and what is in the first alone; null counts as empty.
merged, erased = _combined(np.maximum), _combined(lambda x, y: np.where(y > 0, 0, x))


@F.pandas_udf(T.BooleanType())
def overlap(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    return pd.Series([bool(x and y and (_array(x) & _array(y)).any()) for x, y in zip(_rows(a), _rows(b))])


def _each(op):
    @F.pandas_udf(MASK)
    def run(a: pd.DataFrame) -> pd.DataFrame:
        return _masks([x and _struct(op(_array(x))) for x in _rows(a)])

    return run


inverted, binary = _each(lambda a: 255 - a), _each(lambda a: np.where(a > 127, 255, 0))


def _disc(size: int) -> list[tuple[int, int]]:
    """Offsets of an ellipse that fills a square of an odd size."""
    r = size // 2
    return [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if abs(x) <= round(r * np.sqrt(max(0.0, 1 - (y / max(r, 1)) ** 2)))]


def dilated(iterations: int = 3, size: int = 7):
    """A function of masks: each pixel spread over an ellipse, some times over."""

    def op(a: np.ndarray) -> np.ndarray:
        r, (h, w) = size // 2, a.shape
        for _ in range(iterations):
            wide = np.pad(a, r)
            a = np.maximum.reduce([wide[r + y : r + y + h, r + x : r + x + w] for y, x in _disc(size)])
        return a

    return _each(op)


def parts(a: np.ndarray) -> np.ndarray:
    """A number for each pixel: 0 out, else that of its region of touching pixels, corners too.

    Runs of pixels in a row are joined with those that they touch in the row above.
    """
    wide = np.zeros((a.shape[0], a.shape[1] + 2), np.int8)
    wide[:, 1:-1] = a > 127
    edge = wide[:, 1:] - wide[:, :-1]
    (rows, begin), end = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
    starts, ends, root = begin.tolist(), end.tolist(), list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(rows, np.arange(a.shape[0] + 1)).tolist()
    for y in range(1, a.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if starts[i] <= ends[j] and starts[j] <= ends[i]:
                x, z = top(i), top(j)
                root[max(x, z)] = min(x, z)
            i, j = (i + 1, j) if ends[i] < ends[j] else (i, j + 1)
    out = np.zeros(a.shape, np.int32)
    out[wide[:, 1:-1] > 0] = np.repeat(np.array([top(i) + 1 for i in range(len(root))], np.int32), end - begin)
    return out


def _largest(a: np.ndarray) -> np.ndarray:
    number = parts(a)
    sizes = np.bincount(number.ravel())
    sizes[0] = 0
    return np.where(number == sizes.argmax(), 255, 0) if sizes.any() else a


largest = _each(_largest)


@F.pandas_udf(BOX)
def mask_box(a: pd.DataFrame) -> pd.DataFrame:
    """The box of what is in, in shares; null if nothing is."""
    out = []
    for x in _rows(a):
        ys, xs = np.nonzero(_array(x)) if x else ((), ())
        if len(ys):
            (h, w), (x0, x1), (y0, y1) = (x["height"], x["width"]), (xs.min(), xs.max() + 1), (ys.min(), ys.max() + 1)
            out.append(((x0 + x1) / 2 / w, (y0 + y1) / 2 / h, (x1 - x0) / w, (y1 - y0) / h))
        else:
            out.append((None,) * 4)
    return pd.DataFrame(out, columns=["cx", "cy", "w", "h"])


def borders(threshold: float):
    """A function of grey images: how many rows and columns at each side are as dark on average;
    all 0 in an image without a border, or that is dark throughout."""

    @F.pandas_udf(SIDES)
    def run(a: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x in _rows(a):
            sides = []
            for axis in (1, 0):
                light = np.flatnonzero(_array(x).mean(axis) > threshold) if x else []
                sides += [light[0], _array(x).shape[1 - axis] - 1 - light[-1]] if len(light) else [0, 0]
            out.append(sides)
        return pd.DataFrame(out, columns=["top", "bottom", "left", "right"]).astype("int32")

    return run


@F.pandas_udf(MASK)
def border_mask(image: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
    """The mask of an image within its borders; null without any border."""
    out = []
    for x, (top, bottom, left, right) in zip(_rows(image), sides[["top", "bottom", "left", "right"]].to_numpy()):
        inside = np.zeros((x["height"], x["width"]), np.uint8) if x and (top or bottom or left or right) else None
        if inside is not None:
            inside[top : x["height"] - bottom, left : x["width"] - right] = 255
        out.append(None if inside is None else _struct(inside))
    return _masks(out)


def cleared_edge(step: int):
    """A function of masks: without the pixels within `step` of the image's edge."""

    def op(a: np.ndarray) -> np.ndarray:
        n, (h, w) = min(step, a.shape[0] // 2, a.shape[1] // 2), a.shape
        out = np.zeros_like(a) if n > 0 else a
        if n > 0:
            out[n : h - n, n : w - n] = a[n : h - n, n : w - n]
        return out

    return _each(op)


def joined_boxes(boxes: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Boxes (left, top, right, bottom), those that touch made one, until none do."""
    boxes = list(boxes)
    while True:
        out: list[tuple[int, int, int, int]] = []
        for l, t, r, b in boxes:  # noqa: E741
            hit = [o for o in out if l <= o[2] and r >= o[0] and t <= o[3] and b >= o[1]]
            out = [o for o in out if o not in hit] + [(min([l, *(o[0] for o in hit)]), min([t, *(o[1] for o in hit)]), max([r, *(o[2] for o in hit)]), max([b, *(o[3] for o in hit)]))]
        if len(out) == len(boxes):
            return sorted(out)
        boxes = out


def regions(context: int = 128):
    """A function of masks: the boxes of their regions, each with so many pixels around, those that
    touch made one; without any region the whole image."""

    @F.pandas_udf(REGIONS)
    def run(a: pd.DataFrame) -> pd.Series:
        out = []
        for x in _rows(a):
            boxes = []
            if x:
                number = parts(_array(x))
                for k in np.unique(number[number > 0]):
                    ys, xs = np.nonzero(number == k)
                    boxes.append((max(0, int(xs.min()) - context), max(0, int(ys.min()) - context), min(x["width"], int(xs.max()) + 1 + context), min(x["height"], int(ys.max()) + 1 + context)))
            found = joined_boxes(boxes) or ([(0, 0, x["width"], x["height"])] if x else [])
            out.append([dict(zip(("left", "top", "right", "bottom"), b)) for b in found])
        return pd.Series(out)

    return run


#: Of an aligned pair the least share of pixels that both have, cells a side, and
#: grey levels from which on a cell differs.
COVERAGE, GRID, CELL_LEVELS = 0.2, 16, 18


def _cells(a: np.ndarray) -> np.ndarray:
    """Averages over GRID x GRID cells; a pixel on an edge counts for both by its share."""
    for axis in (0, 1):
        n = a.shape[axis]
        low = np.arange(GRID)[:, None] * n / GRID
        part = np.clip(np.minimum(low + n / GRID, np.arange(n) + 1) - np.maximum(low, np.arange(n)), 0, None) / (n / GRID)
        a = part @ a if axis == 0 else a @ part.T
    return a


@F.pandas_udf(T.DoubleType())
def aligned_score(image: pd.DataFrame, other: pd.DataFrame, covered: pd.DataFrame) -> pd.Series:
    """How far two grey images agree, from 0 to 1, of which the second was brought into line with
    the first where `covered` says so: cells that differ in the mean once both are of the same
    brightness, of all cells that are covered by half."""
    out = []
    for x, y, c in zip(_rows(image), _rows(other), _rows(covered)):
        if not (x and y and c):
            out.append(0.0)
            continue
        a, b, valid = _array(x).astype(np.float64), _array(y).astype(np.float64), _array(c) > 0
        if not valid.any() or valid.sum() < COVERAGE * valid.size:
            out.append(0.0)
            continue
        apart = np.where(valid, np.abs(a - b - (a[valid].mean() - b[valid].mean())), 0)
        counted = _cells(valid.astype(np.float64)) > 0.5
        out.append(1 - (_cells(apart) > CELL_LEVELS)[counted].sum() / counted.sum() if counted.any() else 0.0)
    return pd.Series(out)
