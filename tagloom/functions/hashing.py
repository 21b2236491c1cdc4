"""Perceptual hashes of grey images: area resize and cosine transform as matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of the square that images are resized to, and of the coefficients that are kept.
SIDE, KEPT = 64, 16


def area_weights(size: int, to: int = SIDE) -> np.ndarray:
    """Row i: how much of each of `size` pixels lies in the i-th of `to` equal parts; rows add up to 1."""
    edges = np.arange(to + 1) * size / to
    pixels = np.arange(size)
    shared = np.minimum(edges[1:, None], pixels + 1) - np.maximum(edges[:-1, None], pixels)
    return np.maximum(shared, 0) * to / size


def cosines(size: int = SIDE, kept: int = KEPT) -> np.ndarray:
    """The first rows of the orthonormal cosine transform of the second kind."""
    rows = np.cos(np.pi * np.arange(kept)[:, None] * (2 * np.arange(size) + 1) / (2 * size)) * np.sqrt(2 / size)
    rows[0] /= np.sqrt(2)
    return rows


def coefficients(image: Column | str) -> Column:
    """The KEPT x KEPT lowest coefficients, row by row, of grey images (width, height, data).

    Both steps are linear in rows and in columns, so one matrix for each side does for
    all images of one size: they are transformed as one stack. Six digits are kept, so that
    equal ones are equal whatever order they were added up in. Null for images that are null,
    have no pixels, or whose data are not width x height bytes.
    """
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("array<double>")
    def run(images: pa.Array) -> pa.Array:
        if isinstance(images, pa.ChunkedArray):
            images = images.combine_chunks()
        width, height = (images.field(c).to_numpy(zero_copy_only=False) for c in ("width", "height"))
        data, there = images.field("data"), images.is_valid().to_numpy(zero_copy_only=False)
        out: list = [None] * len(images)
        sizes: dict[tuple[int, int], list[int]] = {}
        for i in np.flatnonzero(there):
            if data[i].is_valid and width[i] > 0 and height[i] > 0 and len(data[i].as_buffer()) == width[i] * height[i]:
                sizes.setdefault((int(width[i]), int(height[i])), []).append(i)
        for (w, h), rows in sizes.items():
            across, down = cosines() @ area_weights(w), cosines() @ area_weights(h)
            step = max(1, (1 << 24) // (w * h))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                stack = np.stack([np.frombuffer(data[i].as_buffer(), np.uint8) for i in some]).reshape(-1, h, w)
                found = np.round(down @ stack.astype(np.float64) @ across.T, 6) + 0.0
                for i, values in zip(some, found.reshape(len(some), -1)):
                    out[i] = values
        return pa.array(out, pa.list_(pa.float64()))

    return run(image)


def perceptual_hashes(images: DataFrame, image: str = "image") -> DataFrame:
    """images with hash, 256 bits of their grey image as four words: each coefficient's bit
    tells whether it is above the median of all but the first. Null without coefficients."""
    from tagloom.operators.duplicates import signature

    found = images.withColumn("_coefficients", coefficients(image))
    return found.withColumn("hash", F.when(F.col("_coefficients").isNotNull(), signature(F.col("_coefficients"), KEPT * KEPT))).drop("_coefficients")
