"""Sizes of image files from the few bytes that tell them, read where they stand."""

from __future__ import annotations

import re
from typing import BinaryIO


def store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    path = re.sub("^file:/{0,2}(?=/)", "", path)
    return (LocalFileSystem(), path) if path.startswith("/") else FileSystem.from_uri(path)


def known(path: str) -> bool:
    """Whether pyarrow.fs has a file system for the path's scheme."""
    try:
        store(path)
    except (ValueError, OSError):
        return False
    return True


def opened(path: str):
    """A file that is read from its store as it is asked for."""
    fs, inside = store(path)
    return fs.open_input_file(inside)


def _exactly(file: BinaryIO, at: int, n: int) -> bytes:
    file.seek(at)
    data = file.read(n)
    if len(data) < n:
        raise ValueError("the file ends early")
    return data


def _jpeg(file: BinaryIO) -> tuple[int, int]:
    """Goes from segment to segment by their lengths, up to the one that begins a frame."""
    at = 2
    while True:
        mark = _exactly(file, at, 2)
        if mark[0] != 0xFF:
            raise ValueError("no segment")
        kind = mark[1]
        if kind == 0xFF:  # a filler
            at += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:  # marks without a length
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            frame = _exactly(file, at + 5, 4)
            return int.from_bytes(frame[2:], "big"), int.from_bytes(frame[:2], "big")
        elif kind in (0xD9, 0xDA):
            raise ValueError("no frame before the picture")
        else:
            length = int.from_bytes(_exactly(file, at + 2, 2), "big")
            if length < 2:
                raise ValueError("a segment shorter than its length")
            at += 2 + length


def _webp(file: BinaryIO) -> tuple[int, int]:
    kind, body = _exactly(file, 12, 4), _exactly(file, 20, 10)
    if kind == b"VP8X":
        return 1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little")
    if kind == b"VP8L" and body[0] == 0x2F:
        bits = int.from_bytes(body[1:5], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and body[3:6] == b"\x9d\x01\x2a":
        return int.from_bytes(body[6:8], "little") & 0x3FFF, int.from_bytes(body[8:10], "little") & 0x3FFF
    raise ValueError("another kind of WebP")


def _tiff(file: BinaryIO, order: str) -> tuple[int, int]:
    """Width and height are entries 256 and 257 of the first directory."""
    at = int.from_bytes(_exactly(file, 4, 4), order)
    entries = int.from_bytes(_exactly(file, at, 2), order)
    table, found = _exactly(file, at + 2, 12 * entries), {}
    for i in range(0, len(table), 12):
        tag, kind = (int.from_bytes(table[i + k : i + k + 2], order) for k in (0, 2))
        found[tag] = int.from_bytes(table[i + 8 : i + (10 if kind == 3 else 12)], order)
    return found.get(256, 0), found.get(257, 0)


def size_of(file: BinaryIO) -> tuple[int, int]:
    """Width and height of a PNG, GIF, BMP, JPEG, WebP or TIFF file, 0 for others and for those
    that are damaged before their size."""
    head = file.read(26)
    number = lambda a, b, order="little": int.from_bytes(head[a:b], order)
    try:
        if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
            return number(16, 20, "big"), number(20, 24, "big")
        if head[:4] == b"GIF8" and len(head) >= 10:
            return number(6, 8), number(8, 10)
        if head[:2] == b"BM" and len(head) >= 26:
            return number(18, 22), abs(int.from_bytes(head[22:26], "little", signed=True))  # negative in files from the top
        if head[:3] == b"\xff\xd8\xff":
            return _jpeg(file)
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            return _webp(file)
        if head[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(file, "little" if head[:1] == b"I" else "big")
    except ValueError:
        pass
    return 0, 0
