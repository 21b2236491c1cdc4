"""Byte-level BPE by a sentencepiece model that is serialised straight from the ranks.

A vocabulary of byte strings with ranks becomes a sentencepiece BPE model: every byte is
written as one printable character, each token is a piece whose score is its negative
rank, and normalisation is the identity. Sentencepiece then merges the neighbours of best
score, as byte-level BPE merges those of lowest rank. Texts are cut into pre-tokens
first; a task encodes each distinct pre-token once and keeps the ids in a bounded store.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct pre-tokens whose ids a task keeps; beyond that it starts anew, and for those that it
#: lacks looks into the last such store.
STORE = 120_000
#: Pre-tokens over this many bytes are encoded without being kept.
LONG = 256
#: Characters of a text whose pre-tokens a task holds at once.
WHOLE = 1 << 21


def byte_characters() -> list[str]:
    """A printable character for each byte; those that are printable stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """One field of a protocol buffer message: bytes, float or int."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of the ranks, which are 0 to n - 1; id n is the unknown piece."""
    if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be 0 to n - 1 and hold every byte")
    characters = byte_characters()
    unknown, bpe = 2, 2
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(characters[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    none = (1 << 64) - 1  # -1: the model has no such piece
    trainer = _field(3, bpe) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + b"".join(_field(k, none) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class Coder:
    """Encodes and decodes whole texts; one for each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.to_characters = dict(enumerate(byte_characters()))
        # Two stores, so that what is met often outlives the change of them.
        self.store: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encoded(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids as little-endian 32-bit integers."""
        out, rest = {}, []
        for p in pieces:
            rank = self.ranks.get(p.encode())
            if rank is None:
                rest.append(p)
            else:
                out[p] = struct.pack("<I", rank)
        if rest:
            written = [p.encode().decode("latin-1").translate(self.to_characters) for p in rest]
            for p, ids in zip(rest, self.model.encode(written, num_threads=1)):
                out[p] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, text: str) -> bytes:
        if len(text) <= WHOLE:
            return self._ids(self.pattern.findall(text))
        found = (m.group() for m in self.pattern.finditer(text))
        return b"".join(iter(lambda: self._ids(list(islice(found, WHOLE // 4))), b""))

    def _ids(self, pieces: list[str]) -> bytes:
        store = self.store
        new = set(pieces).difference(store)
        if not new:
            return b"".join(map(store.__getitem__, pieces))
        again = {p: self.older[p] for p in new if p in self.older}
        found = again | self._encoded([p for p in new if p not in again])
        kept = {p: ids for p, ids in found.items() if len(p) <= LONG}
        if len(store) + len(kept) > STORE:
            use = {p: store[p] for p in set(pieces) if p in store} | found
            self.older, self.store = store, kept
        else:
            store.update(kept)
            use = store if len(kept) == len(found) else store | found
        return b"".join(map(use.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, "<u4")
        return b"".join(b"".join(map(self.tokens.__getitem__, numbers[i : i + WHOLE].tolist())) for i in range(0, len(numbers), WHOLE))


def _shared(docs: DataFrame, path: str, pattern: str):
    """A function that gives a task's worker its one Coder.

    The driver reads the vocabulary and broadcasts it; its size is the vocabulary's, and
    executors need no file.
    """
    ranks = read_ranks(path)
    key = "bpe-" + hashlib.sha256(b"".join([pattern.encode(), *sorted(ranks, key=ranks.get)])).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    return lambda: common.held(key, lambda: Coder(shared.value, pattern))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids (little-endian unsigned 32-bit), decoded (bytes).

    A null text counts as empty; an empty one has no ids. Rows are independent, so repeated
    rows and an empty table give as many rows. Other columns are ignored.
    """

    coder = _shared(docs, path, pattern)

    def run(batches):
        mine = coder()
        for batch in batches:
            for part in common.slices(batch, "text"):
                ids = [mine.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([mine.decode(i) for i in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    return common.mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """Digests of ids and of decoded bytes: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The digests are taken in the tasks; the ids, as little-endian unsigned 32-bit integers,
    are a column only if asked for. Copies of a text that stand side by side are encoded once.
    """
    coder = _shared(docs, path, pattern)
    columns = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.binary()} if ids else {})
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches):
        mine, last, row = coder(), None, ()
        for batch in batches:
            for part in common.slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    if not row or text != last:
                        found = mine.encode(text or "")
                        last, row = text, (len(found) // 4, sha(found), sha(mine.decode(found)), found)
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), columns.values()))], names=["doc_id", *columns])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    return common.mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)
