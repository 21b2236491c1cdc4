"""Columns over label geometry: boxes (cx, cy, w, h) and polygons in shares of the image."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.tags import let

BOX = "struct<cx:double,cy:double,w:double,h:double>"


def box(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.struct(cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))


def bounding_box(points: Column) -> Column:
    """The box around an array of (x, y)."""
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    low, high = (F.array_min(xs), F.array_min(ys)), (F.array_max(xs), F.array_max(ys))
    return box((low[0] + high[0]) / 2, (low[1] + high[1]) / 2, high[0] - low[0], high[1] - low[1])


def parse_yolo(line: Column) -> Column:
    """class_id, bbox and polygon of a label line, null if it is none.

    Four numbers after an integer class are a box, six or more, an even number, a polygon
    with its bounding box.
    """
    none = F.lit(None).cast("array<struct<x:double,y:double>>")

    # Each step is bound once: what a lambda names is else evaluated for each of its elements.
    def read(parts: Column) -> Column:
        cls = F.when(F.get(parts, F.lit(0)).rlike(r"^[+-]?\d+$"), F.get(parts, F.lit(0)).try_cast("int"))
        values = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda v: v.try_cast("double"))
        return F.struct(cls.alias("cls"), values.alias("values"))

    def made(s: Column) -> Column:
        cls, values = s["cls"], s["values"]
        n, good = F.size(values), ~F.exists(values, lambda v: v.isNull()) & cls.isNotNull()
        at = lambda i: F.get(values, F.lit(i))
        points = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(n / 2).cast("int") - 1)), lambda i: F.struct(F.get(values, 2 * i).alias("x"), F.get(values, 2 * i + 1).alias("y")))
        plain = F.struct(cls.alias("class_id"), box(at(0), at(1), at(2), at(3)).alias("bbox"), none.alias("polygon"))
        poly = let(points, lambda p: F.struct(cls.alias("class_id"), bounding_box(p).alias("bbox"), p.alias("polygon")))
        return F.when(good & (n == 4), plain).when(good & (n >= 6) & (n % 2 == 0), poly)

    return let(let(F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+"), read), made)


#: Pixels that rounding may leave of a side that is gone.
NOTHING = 1e-6


def crop(cx: Column, cy: Column, w: Column, h: Column, size: tuple[Column, Column], rect: tuple[Column, Column, Column, Column]) -> Column:
    """A box in shares of a crop (x, y, w, h in pixels) of an image of this size; null if
    a pixel or less of it is left in either direction, or the image or crop has no area."""
    (iw, ih), (x, y, rw, rh) = size, rect
    left, right = F.greatest((cx - w / 2) * iw - x, F.lit(0.0)), F.least((cx + w / 2) * iw - x, rw * F.lit(1.0))
    top, bottom = F.greatest((cy - h / 2) * ih - y, F.lit(0.0)), F.least((cy + h / 2) * ih - y, rh * F.lit(1.0))
    area = (iw > 0) & (ih > 0) & (rw > 0) & (rh > 0)
    return F.when(area & (right - left > 1 + NOTHING) & (bottom - top > 1 + NOTHING), box((left + right) / 2 / rw, (top + bottom) / 2 / rh, (right - left) / rw, (bottom - top) / rh))


def crop_polygon(polygon: Column, size: tuple[Column, Column], rect: tuple[Column, Column, Column, Column]) -> Column:
    """A polygon's points in shares of a crop, each moved to the crop's edge if it is outside;
    null if all of them are on one side outside."""
    (iw, ih), (x, y, rw, rh) = size, rect
    pixels = F.transform(polygon, lambda p: F.struct((p.x * iw - x).alias("x"), (p.y * ih - y).alias("y")))
    within = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most * F.lit(1.0)) / most

    def kept(points: Column) -> Column:
        # Of most polygons a point says soon that not all are on one side.
        sides = (lambda p: p.x <= 0, lambda p: p.x >= rw, lambda p: p.y <= 0, lambda p: p.y >= rh)
        outside = reduce(operator.or_, (F.forall(points, side) for side in sides))
        return F.when(~outside, F.transform(points, lambda p: F.struct(within(p.x, rw).alias("x"), within(p.y, rh).alias("y"))))

    return let(pixels, kept)


def crop_labels(labels: Column, size: tuple[Column, Column], rect: tuple[Column, Column, Column, Column]) -> Column:
    """Labels (class_id, bbox, polygon) on a crop. A label goes if its box or its polygon, of
    three points or more, does; one with neither goes as well."""

    def moved(t: Column) -> Column:
        many = F.coalesce(F.size(t["polygon"]) >= 3, F.lit(False))
        b = crop(t["bbox"]["cx"], t["bbox"]["cy"], t["bbox"]["w"], t["bbox"]["h"], size, rect)
        return F.struct(t["class_id"].alias("class_id"), t["bbox"].isNotNull().alias("has_box"), many.alias("has_points"), F.when(t["bbox"].isNotNull(), b).alias("bbox"), F.when(many, crop_polygon(t["polygon"], size, rect)).alias("polygon"))

    # What a label had stays beside what is left of it, so that each is cropped once.
    stays = lambda t: (t["has_box"] == t["bbox"].isNotNull()) & (t["has_points"] == t["polygon"].isNotNull()) & (t["has_box"] | t["has_points"])
    return F.transform(F.filter(F.transform(labels, moved), stays), lambda t: F.struct(t["class_id"].alias("class_id"), t["bbox"].alias("bbox"), t["polygon"].alias("polygon")))


def scaled_rect(rect: tuple[Column, Column, Column, Column], shown: tuple[Column, Column], size: tuple[Column, Column]) -> Column:
    """A crop (x, y, w, h) drawn on a preview of size `shown`, in whole pixels of the image
    and within it; null if nothing of it is left."""
    names = ("x", "y", "w", "h")
    out = []
    for i, (at, width) in enumerate(((rect[0], rect[2]), (rect[1], rect[3]))):
        scale = F.when((shown[0] > 0) & (shown[1] > 0), size[i] / shown[i]).otherwise(F.lit(1.0))
        start = F.greatest(F.lit(0), F.least((at * scale).cast("int"), size[i]))
        out.append((start, F.least((width * scale).cast("int"), size[i] - start)))
    (x, w), (y, h) = out
    return F.when((w > 0) & (h > 0), F.struct(*(c.alias(n) for n, c in zip(names, (x, y, w, h)))))


def split_rects(position: Column, size: tuple[Column, Column], vertical: bool) -> Column:
    """The two crops of an image that is split at a share of its width (vertical) or height;
    each has a pixel at least."""
    w, h = size
    at = lambda n: F.greatest(F.lit(1), F.least((position * n).cast("int"), n - 1))
    rect = lambda *r: F.struct(*(v.alias(n) for n, v in zip(("x", "y", "w", "h"), r)))
    zero = F.lit(0)
    return F.array(rect(zero, zero, at(w), h), rect(at(w), zero, w - at(w), h)) if vertical else F.array(rect(zero, zero, w, at(h)), rect(zero, at(h), w, h - at(h)))


def offset(cx: Column, cy: Column, w: Column, h: Column, dx: float, dy: float) -> Column:
    """A box moved; it is not clamped to the image."""
    return box(cx + dx, cy + dy, w, h)


def corners(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """A box as a polygon, from its upper left corner clockwise."""
    x0, x1, y0, y1 = cx - w / 2, cx + w / 2, cy - h / 2, cy + h / 2
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))))


def _six(*values: Column) -> Column:
    # As one step of an array, each value is computed once.
    return F.array_join(F.transform(F.array(*(v.cast("double") for v in values)), six_digits), " ")


def six_digits(value: Column) -> Column:
    """A number from -4 to 4 with six digits, rounded by its exact value, halves to even, as
    printf does in C; Java's, by which others are written, rounds what is printed of it up.

    Only a product with a half left over leaves it open, as halves are doubles themselves; then
    the product's error, which the value's upper and lower bits give without rounding, tells.
    """
    x = F.abs(value)
    y = x * 1e6
    wide = x * (2.0**27 + 1)
    upper = wide - (wide - x)
    error = (upper * 1e6 - y) + (x - upper) * 1e6
    down = F.floor(y)
    up = (error > 0) | ((error == 0) & (down % 2 == 1))
    n = F.when(y - down == 0.5, down + up.cast("long")).otherwise(F.rint(y).cast("long"))
    text = F.overlay(F.substr((n + 10_000_000).cast("string"), F.lit(2)), F.lit("."), F.lit(2), F.lit(0))
    return F.when(x < 4, F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)).otherwise(F.format_string("%.6f", value))


def box_line(class_id: Column, bbox: Column) -> Column:
    """A label file's line of a box, empty without one."""
    line = F.concat_ws(" ", class_id.cast("string"), _six(bbox["cx"], bbox["cy"], bbox["w"], bbox["h"]))
    return F.when(bbox.isNotNull(), line).otherwise(F.lit(""))


def polygon_line(class_id: Column, bbox: Column, polygon: Column) -> Column:
    """A label file's line of a polygon of three points or more, else of its box's corners."""
    own = F.array_join(F.transform(polygon, lambda p: _six(p["x"], p["y"])), " ")
    # Each side of a box is written once, and stands at two corners.
    half = bbox["w"] / 2, bbox["h"] / 2
    sides = F.array(*(v.cast("double") for v in (bbox["cx"] - half[0], bbox["cy"] - half[1], bbox["cx"] + half[0], bbox["cy"] + half[1])))
    boxed = let(F.transform(sides, six_digits), lambda v: F.concat_ws(" ", v[0], v[1], v[2], v[1], v[2], v[3], v[0], v[3]))
    number = class_id.cast("string")
    return F.when(F.coalesce(F.size(polygon) >= 3, F.lit(False)), F.concat_ws(" ", number, own)).when(bbox.isNotNull(), F.concat_ws(" ", number, boxed)).otherwise(F.lit(""))


def label_lines(labels: Column, form: str | None = None) -> Column:
    """A label file's text: each label as it is, or all as boxes (detection) or polygons
    (segmentation); what has no such line is left out, and no lines are an empty text."""

    def line(t: Column) -> Column:
        plain, poly = box_line(t["class_id"], t["bbox"]), polygon_line(t["class_id"], t["bbox"], t["polygon"])
        own = F.when(F.coalesce(F.size(t["polygon"]) >= 3, F.lit(False)), poly).otherwise(plain)
        return {"detection": plain, "segmentation": poly}.get(form, own)

    lines = F.filter(F.transform(labels, line), lambda x: x != "")
    return F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")


def frame_count(seconds: Column) -> Column:
    return F.when(seconds <= 1, F.lit(1)).otherwise(F.least(F.lit(100), F.greatest(F.lit(1), F.ceil(seconds / F.ln(seconds)).cast("int"))))


def snapped_size(width: Column, height: Column, pixels: int = 1_048_576, step: int = 16) -> Column:
    """Near `pixels` at the same aspect, both sides multiples of step."""
    scale = F.sqrt(F.lit(float(pixels)) / (width * height))
    side = lambda s: F.greatest(F.lit(step), (F.bround(s * scale / step, 0) * step).cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


#: Bits of a hash that a tolerance of 100 allows, and of a shortlist; shares of
#: an aligned image that may differ at tolerances of 0 and 100.
MOST_BITS, SHORTLIST_BITS, LEAST_SHARE, MOST_SHARE = 64, 96, 0.005, 0.3


def _share(tolerance: float) -> float:
    return min(max(tolerance, 0), 100) / 100


def hash_bits_allowed(tolerance: float) -> int:
    """Bits that two hashes may differ in, at a tolerance from 0 to 100."""
    return round(_share(tolerance) * MOST_BITS)


def difference_allowed(tolerance: float) -> float:
    """The share of an aligned image that may differ; 1 less it is the least score."""
    return LEAST_SHARE + _share(tolerance) ** 2 * (MOST_SHARE - LEAST_SHARE)


def shortlist_bits(tolerance: float) -> int:
    """Bits that hashes of pairs which are then compared by their images may differ in."""
    return max(hash_bits_allowed(tolerance), SHORTLIST_BITS)


def pair_accepted(kind: str, tolerance: float, bits: Column, score: Column) -> Column:
    """Whether a measured pair matches; what was not measured doesn't. kind: hash, aligned, both.

    All bounds grow with the tolerance, so pairs measured at one can be narrowed to a lesser.
    """
    near, alike = bits <= (shortlist_bits(tolerance) if kind == "both" else hash_bits_allowed(tolerance)), score >= 1 - difference_allowed(tolerance)
    return F.coalesce({"hash": near, "aligned": alike, "both": near & alike}[kind], F.lit(False))


def tolerance_text(kind: str, tolerance: float, width: int = 256) -> str:
    """What a tolerance means, in words."""
    if kind == "hash":
        return f"match when at most {hash_bits_allowed(tolerance)} of {width} hash bits differ"
    aligned = f"at most {difference_allowed(tolerance):.1%} of the aligned image differs"
    return f"match when {aligned}" if kind == "aligned" else f"shortlist within {shortlist_bits(tolerance)} bits, then {aligned}"
