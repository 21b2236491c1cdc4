"""Concatenate and cut: documents' token ids, one after the other, in windows of fixed length.

The first pass encodes each text once and adds up tokens within its partition. The totals
of the partitions, one number each, give every document its place in one long stream of
ids. The second pass cuts the stream at fixed windows: each document gives one record for
each window that it meets, so that a window's boundaries need no neighbour. What is left
behind the last whole window is cut at powers of two, which take no padding.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, scans
from .bpe import byte_characters

WINDOW = 1024
#: The id that ends a document.
END = 0
#: Pre-tokens whose ids a worker keeps; beyond that it starts anew and looks into the last such store.
STORE = 500_000
#: Characters over which a pre-token is not kept, and characters of a text that are cut at once.
LONG, WHOLE = 64, 1 << 18
#: The cut of byte-level tokenizers into pre-tokens, where `_plain` holds.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _odd(character: str) -> bool:
    """Whether `re` may not tell a character's class as Unicode does: numbers that are no
    digits, separators that only Python takes for space, and whatever was given its class
    after version 3.2, as libraries go by different versions."""
    kind = unicodedata.category(character)
    return kind != unicodedata.ucd_3_2_0.category(character) or kind in ("No", "Nl", "Cn", "Cs") or "\x1c" <= character <= "\x1f"


class Store(dict):
    """Ids by pre-token. What is missing is encoded, and kept unless it is long; a full store
    starts anew and takes what it lacks from the one before."""

    def __init__(self, encode):
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= LONG:
            if len(self) >= STORE:
                self.older = self.copy()
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes whole texts as a tokenizer of the library `tokenizers` does, without special tokens.

    Byte-level tokenizers that neither normalise nor put a space before the text cut it by
    a known pattern: their model then encodes each distinct pre-token once. Texts with odd
    characters, and all texts of other tokenizers, are encoded as a whole.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        made = json.loads(tokenizer)
        cut = made.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        plain = plain and not made.get("normalizer") and made["model"].get("type") == "BPE" and all(t.get("special") for t in made.get("added_tokens") or [])
        self.plain = plain
        self.known: set[str] = set()
        self.model = self.tokenizer.model
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.to_characters = dict(enumerate(byte_characters()))
        self.store = Store(self._one)

    def encode(self, text: str) -> bytes:
        """Ids, little-endian, of self.kind."""
        if not self.plain or self._has_odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if len(text) <= WHOLE:
            return self._ids(PLAIN.findall(text))
        found = (m.group() for m in PLAIN.finditer(text))
        return b"".join(iter(lambda: self._ids(list(islice(found, WHOLE // 4))), b""))

    def _has_odd(self, text: str) -> bool:
        """known holds the characters that were found not to be odd."""
        new = set(text) - self.known
        if any(map(_odd, new)):
            return True
        self.known |= new
        return False

    def _one(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            mapped = piece.replace(" ", self.to_characters[32])
        else:
            mapped = piece.encode().decode("latin-1").translate(self.to_characters)
        found = [t.id for t in self.model.tokenize(mapped)]
        return struct.pack(f"<{len(found)}{'H' if self.kind == '<u2' else 'I'}", *found)

    def _ids(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.store.__getitem__, pieces))


def encoded(docs: DataFrame, path: str, end: int = END) -> tuple[DataFrame, str]:
    """docs (doc_id, text) -> doc_id, ids (with the end id), n, _part, _upto (tokens of its
    partition up to and with it), staged; and how an id is written.

    The driver reads the tokenizer's file and broadcasts it, so executors need no file.
    """
    with open(path, encoding="utf-8") as file:
        tokenizer = file.read()
    kind = Encoder(tokenizer).kind
    key = "pack-" + hashlib.sha256(tokenizer.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    last_id = np.array([end], kind).tobytes()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        mine = common.held(key, lambda: Encoder(shared.value))
        part, upto, last, ids = TaskContext.get().partitionId(), 0, None, b""
        for batch in batches:
            for some in common.slices(batch, "text"):
                rows = []
                for text in some.column("text").to_pylist():
                    if text != last or not ids:  # copies that stand side by side are encoded once
                        last, ids = text, mine.encode(text or "") + last_id
                    rows.append(ids)
                n = np.array([len(r) // np.dtype(kind).itemsize for r in rows], np.int64)
                ends = upto + np.cumsum(n)
                upto = int(ends[-1])
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(rows, pa.binary()), pa.array(n), pa.array(np.full(len(rows), part, np.int32)), pa.array(ends)], names=["doc_id", "ids", "n", "_part", "_upto"])

    rows = common.mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids binary, n long, _part int, _upto long")
    return common.staged(rows, "ids"), kind


def cuts(total: int, window: int) -> list[int]:
    """Starts of the sequences behind the last whole window: powers of two, the largest first."""
    at, out = total // window * window, []
    for bit in reversed(range(window.bit_length())):
        if (total - at) >> bit:
            out.append(at)
            at += 1 << bit
    return out


def pieces(at: int, n: int, total: int, window: int, tail: list[int]) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the stream's ids from `at`, n of them, cut by windows."""
    whole, out, now = total // window * window, [], at
    starts = [*tail, total]
    while now < at + n:
        if now < whole:
            sequence, offset = divmod(now, window)
            until = now - offset + window
        else:
            k = int(np.searchsorted(tail, now, "right")) - 1
            sequence, offset, until = whole // window + k, now - tail[k], starts[k + 1]
        until = min(until, at + n)
        out.append((now - at, until - now, sequence, offset))
        now = until
    return out


def windowed(at: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """The same for many documents before the last whole window's end: row, start, length, sequence, offset."""
    first = at // window + 1
    count = np.maximum((at + n - 1) // window - first + 1, 0) + 1
    row = np.repeat(np.arange(len(at)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.where(place == 0, at[row], (first[row] + place - 1) * window)
    end = np.where(place == count[row] - 1, (at + n)[row], (first[row] + place) * window)
    return row, begin - at[row], end - begin, begin // window, begin % window


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """docs (doc_id, text) -> one row a piece: doc_id, start (its document's ids before it),
    length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    path: a file of the library `tokenizers`; strings of special tokens in a text are
    ordinary text. Each document ends with the id `end`, so null and empty texts have one
    id. Sequences hold `window` ids; those behind the last whole one have lengths that are
    powers of two, so no sequence needs padding. Repeated rows are documents of their own; a
    null doc_id stays null. An empty table gives no rows; other columns are ignored. The
    order of documents is that of the table's partitions.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("a window's length is a power of two")
    rows, kind = encoded(docs, path, end)
    totals = [tuple(r) for r in rows.groupBy("_part").agg(F.sum("n")).collect()]  # a number a partition
    total = sum(n for _, n in totals)
    tail = cuts(total, window)
    before = F.broadcast(rows.sparkSession.createDataFrame(scans.offsets(totals), "_part int, _before long"))
    placed = rows.join(before, "_part").select("doc_id", "ids", "n", (F.col("_before") + F.col("_upto") - F.col("n")).alias("at"))
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    whole = total // window * window

    def run(batches):
        common.held("pieces", tuple)  # a worker that has encoded gives its store back
        for batch in batches:
            for some in common.slices(batch, "ids", 1 << 20):
                n, at = (some.column(c).to_numpy() for c in ("n", "at"))
                data = np.frombuffer(b"".join(some.column("ids").to_pylist()), kind).astype("<u4")
                if (at + n).max() <= whole:
                    row, *numbers = windowed(at, n, window)
                else:  # the end of the stream
                    found = [(row, *piece) for row, (a, m) in enumerate(zip(at.tolist(), n.tolist())) for piece in pieces(a, m, total, window, tail)]
                    row, *numbers = np.array(found, np.int64).T
                start, length, sequence, offset = map(pa.array, numbers)
                ends = pa.array(np.append(0, np.cumsum(numbers[1]) * 4).astype(np.int32))
                ids = pa.Array.from_buffers(pa.binary(), len(row), [None, ends.buffers()[1], pa.py_buffer(data)])
                doc, tokens = some.column("doc_id").take(pa.array(row)), pa.array(n[row])
                yield pa.RecordBatch.from_arrays([doc, start, length, ids, tokens, sequence, offset], names=names)

    return common.mapped(placed, run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Pieces of pack() -> sequence_id, ids (one after the other), starts (where its pieces
    begin), docs (their doc_ids). A sequence has a window's ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    whole = F.aggregate("parts", F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x.ids))
    return joined.select("sequence_id", whole.alias("ids"), F.col("parts.offset").alias("starts"), F.col("parts.doc_id").alias("docs"))


def digests(packed: DataFrame) -> DataFrame:
    """Pieces of pack() with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
