"""Listings that read heads only, and writers that leave all or nothing."""

import io
import os
import struct
import time

import pytest
from pyspark.sql import functions as F

from tagloom.sources import catalog as sources
from tagloom.sources import images


def jpeg(width, height, skipped=0):
    parts = [b"\xff\xd8", b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9)]
    parts += [b"\xff\xe1" + struct.pack(">H", 65535) + bytes(65533)] * skipped  # a long preview
    parts += [b"\xff\xff\xc2" + struct.pack(">HBHHB", 17, 8, height, width, 3) + bytes(9), b"\xff\xda" + bytes(5000), b"\xff\xd9"]
    return b"".join(parts)


def tiff(width, height, order, at=8):
    o = {"little": "<", "big": ">"}[order]
    head = (b"II*\0" if order == "little" else b"MM\0*") + struct.pack(o + "I", at) + bytes(at - 8)
    wide = struct.pack(o + "HHI", 256, 3, 1) + struct.pack(o + "HH", width, 0)
    high = struct.pack(o + "HHII", 257, 4, 1, height)
    return head + struct.pack(o + "H", 3) + struct.pack(o + "HHII", 254, 4, 1, 0) + wide + high + bytes(4)


def riff(kind, body):
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


FILES = {
    "a.jpg": (jpeg(640, 480), (640, 480)),
    "b.JPEG": (jpeg(3000, 2000, skipped=40), (3000, 2000)),
    "c.webp": (riff(b"VP8X", b"\x10\0\0\0" + (1919).to_bytes(3, "little") + (1079).to_bytes(3, "little")), (1920, 1080)),
    "d.webp": (riff(b"VP8L", b"\x2f" + ((299) | (199 << 14)).to_bytes(4, "little") + bytes(8)), (300, 200)),
    "e.webp": (riff(b"VP8 ", b"\x10\0\0\x9d\x01\x2a" + struct.pack("<HH", 17, 33) + bytes(8)), (17, 33)),
    "f.tif": (tiff(70, 90, "little"), (70, 90)),
    "g.tiff": (tiff(71, 91, "big", at=100_000), (71, 91)),
    "h.png": (b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 5, 6) + bytes(50), (5, 6)),
    "i.gif": (b"GIF89a" + struct.pack("<HH", 7, 8) + bytes(20), (7, 8)),
    "j.bmp": (b"BM" + bytes(16) + struct.pack("<ii", 9, -10) + bytes(20), (9, 10)),
    "k.jpg": (b"\xff\xd8\xff\xe1\xff", (0, 0)),
    "l.png": (b"no image", (0, 0)),
    "m.tif": (b"II*\0" + struct.pack("<I", 10**6), (0, 0)),
    "n.webp": (riff(b"XXXX", bytes(20)), (0, 0)),
    "o.jpg": (b"", (0, 0)),
}


def test_sizes_of_all_kinds_from_few_bytes():
    class Counted(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            data = super().read(n)
            self.read_bytes += len(data)
            return data

    for name, (data, size) in FILES.items():
        file = Counted(data)
        assert images.size_of(file) == size, name
        assert file.read_bytes < 600, name


def test_a_listing_reads_no_other_file(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in/sub")
    for name, (data, _) in FILES.items():
        with open(f"{tmp_path}/in/{'sub/' if name < 'c' else ''}{name}", "wb") as out:
            out.write(data)
    with open(f"{tmp_path}/in/video.mp4", "wb") as out:
        out.truncate(3 << 30)  # more than one value of Spark holds
    found = {r.path.rsplit("/", 1)[1]: r for r in sources.scan_images(spark, f"{tmp_path}/in").collect()}
    # Spark lists no empty files.
    assert {n: (r.width, r.height) for n, r in found.items()} == {n: size for n, (data, size) in FILES.items() if data}
    assert found["a.jpg"].relative_path == "sub/a.jpg" and found["a.jpg"].size == len(FILES["a.jpg"][0])


def test_sizes_from_contents(spark):
    rows = [(n, d) for n, (d, _) in FILES.items()]
    contents = spark.createDataFrame(rows, "path string, content binary")
    found = sources.image_sizes(contents.select("path"), contents).collect()
    assert {r.path: (r.width, r.height) for r in found} == {n: size for n, (_, size) in FILES.items()}
    assert not images.known("viewfs://store/in") and images.known("/tmp") and images.known("file:/tmp")


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    rows = spark.range(200, numPartitions=5).select(F.concat(F.lit("d/"), F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.col("id"))
    broken = F.when(F.col("id") == 150, F.raise_error(F.lit("no text"))).otherwise(F.col("id").cast("string"))
    os.makedirs(f"{tmp_path}/out")
    with pytest.raises(Exception, match="no text"):
        sources.write_files(rows.select("name", broken.alias("text")), f"{tmp_path}/out")
    assert os.listdir(f"{tmp_path}/out") == []
    time.sleep(2)  # tasks that outlive the failed job
    assert os.listdir(f"{tmp_path}/out") == []
    sources.write_files(rows.select("name", F.col("id").cast("string").alias("text")), f"file:{tmp_path}/out")
    assert sorted(os.listdir(f"{tmp_path}/out/d")) == sorted(f"{i}.txt" for i in range(200)) and os.listdir(f"{tmp_path}/out") == ["d"]
    assert open(f"{tmp_path}/out/d/7.txt").read() == "7"
    sources.write_files(rows.where("id = 7").select("name", F.lit("new").alias("text")), f"{tmp_path}/out")
    assert open(f"{tmp_path}/out/d/7.txt").read() == "new"


def test_metadata_of_images(spark):
    """Parameters before a graph, a graph, and neither."""
    from tagloom.operators import graphs

    chunk = lambda key, text: struct.pack(">I", len(key) + 1 + len(text)) + b"tEXt" + key + b"\0" + text + bytes(4)
    png = lambda *chunks: b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + bytes(17) + b"".join(chunks)
    graph = b'{"1": {"class_type": "KSampler", "inputs": {"positive": ["2", 0], "steps": 9}}, "2": {"class_type": "CLIPTextEncode", "inputs": {"text": "a cat, b"}}}'
    words = b"sun, sky\nNegative prompt: rain\nSteps: 5, Size: 64x32"
    rows = [("w.png", png(chunk(b"parameters", words), chunk(b"prompt", graph))), ("g.png", png(chunk(b"prompt", graph))), ("n.png", png()), ("x.jpg", b"abc")]
    found = {r.path: r for r in graphs.metadata_of(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert len(found) == 4
    w, g, n = found["w.png"], found["g.png"], found["n.png"]
    assert (w.format, w.positive, w.negative, w.tags, w.width, w.height, w.settings["Steps"]) == ("text", "sun, sky", "rain", ["sun", "sky"], 64, 32, "5")
    assert (g.format, g.positive, g.tags, g.settings["steps"], g.width) == ("graph", "a cat, b", ["a cat", "b"], "9", None)
    assert (n.format, n.positive, n.tags, n.settings) == ("", "", [], {}) and found["x.jpg"].format == ""
