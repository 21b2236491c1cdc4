"""Perceptual hashes against sums written out."""

import numpy as np
from pyspark.sql import functions as F

from tagloom.functions import hashing


def by_sums(image):
    """Area resize pixel by pixel, then the transform by its formula."""
    h, w = image.shape
    small = np.zeros((64, 64))
    for size, axis in ((h, 0), (w, 1)):
        assert np.allclose(hashing.area_weights(size).sum(1), 1)
    for i in range(64):
        for j in range(64):
            total = 0.0
            for y in range(int(i * h / 64), min(h, int(np.ceil((i + 1) * h / 64)))):
                for x in range(int(j * w / 64), min(w, int(np.ceil((j + 1) * w / 64)))):
                    high = min((i + 1) * h / 64, y + 1) - max(i * h / 64, y)
                    wide = min((j + 1) * w / 64, x + 1) - max(j * w / 64, x)
                    total += image[y, x] * high * wide
            small[i, j] = total / (h / 64 * w / 64)
    k = np.arange(64)
    scale = lambda u: np.sqrt((1 if u == 0 else 2) / 64)
    return np.array([[scale(u) * scale(v) * (small * np.cos(np.pi * u * (2 * k[:, None] + 1) / 128) * np.cos(np.pi * v * (2 * k + 1) / 128)).sum() for v in range(16)] for u in range(16)])


def test_coefficients_and_bits(spark):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 256, shape).astype(np.uint8) for shape in ((8, 8), (64, 64), (100, 37), (1, 5), (130, 70))]
    rows = [(i, (a.shape[1], a.shape[0], a.tobytes())) for i, a in enumerate(images)] + [(10, None), (11, (2, 2, b"abc")), (12, (0, 0, b"")), (13, (2, 2, None))]
    df = spark.createDataFrame(rows, "id int, image struct<width:int,height:int,data:binary>")
    found = {r.id: r for r in hashing.perceptual_hashes(df).withColumn("c", hashing.coefficients("image")).collect()}
    for i, image in enumerate(images):
        expected = by_sums(image)
        assert np.allclose(found[i].c, expected.ravel(), atol=2e-6)
        bits = "".join(f"{w & (1 << 64) - 1:064b}" for w in found[i].hash)
        c = np.array(found[i].c)
        assert bits == "".join("1" if x > np.median(c[1:]) else "0" for x in c)
    assert all(found[i].hash is None and found[i].c is None for i in (10, 11, 12, 13))


def test_images_that_are_alike_have_near_hashes(spark):
    rng = np.random.default_rng(1)
    smooth = np.add.outer(np.sin(np.arange(96) / 9) * 60, np.cos(np.arange(96) / 14) * 60) + 128
    noisy = np.clip(smooth + rng.normal(0, 3, smooth.shape), 0, 255)
    other = rng.integers(0, 256, smooth.shape)
    rows = [(i, (96, 96, a.astype(np.uint8).tobytes())) for i, a in enumerate((smooth, noisy, other))]
    df = hashing.perceptual_hashes(spark.createDataFrame(rows, "id int, image struct<width:int,height:int,data:binary>"))
    words = {r.id: r.hash for r in df.select("id", F.col("hash")).collect()}
    apart = lambda a, b: sum((x ^ y & (1 << 64) - 1).bit_count() if x >= 0 and y >= 0 else ((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(words[a], words[b]))
    assert apart(0, 1) < apart(0, 2)
