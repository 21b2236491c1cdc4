"""Language identification by string kernels.

The kernel of two texts is the blended spectrum: for each n up to ORDER, the share of
their byte n-grams that both contain (presence, not counts), averaged over n. Landmark
texts give a Nyström approximation, on which one-versus-rest ridge regression is solved in
closed form. Tasks mark the n-grams that a text contains in a 0/1 matrix and score many
texts at once with two matrix products: texts x landmarks, then landmarks x languages.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ORDER = 3
#: The sample of labelled rows that a model is fitted on: rows a language, drawn from all,
#: about the most bytes of a text that fitting uses, in PIECES spread over it, and about the
#: most bytes of all, which many languages share. Everything else covers whole texts.
SAMPLE_ROWS = 300
SAMPLE_BYTES = 20_000
SAMPLE_TOTAL = 1 << 26
PIECES = 8
#: Landmark texts, or one a language if there are more, and n-grams that the kernel knows.
LANDMARKS = 160
GRAMS = 12_000
RIDGE = 1e-3
UNKNOWN = "und"
#: Bytes of a text whose n-grams are looked up at once, and cells of the 0/1 matrix of some texts.
BLOCK = 1 << 20
CELLS = 1 << 22

_LETTER = re.compile(r"[^\W\d_]")


def _shifted(data: np.ndarray, n: int) -> list[np.ndarray]:
    """The first, second, ... bytes of all n-grams of a byte array."""
    return [data[k : len(data) - n + 1 + k] for k in range(n)]


def _codes(letters: np.ndarray, grams, size: int) -> np.ndarray:
    """n-grams, given as their first, second, ... bytes, as integers of n digits below size."""
    out = 0
    for part in grams:
        out = out * size + letters[part]
    return out


_BYTES = np.arange(256, dtype=np.int32)


def padded(text: str) -> bytes:
    """Lower case, with blanks around."""
    return b" " + text.lower().encode() + b" "


class Model:
    """grams: for n = 1 to ORDER the sorted n-grams; landmarks: 0/1 rows over all of them."""

    def __init__(self, grams: list[np.ndarray], landmarks: np.ndarray | None = None, weights: np.ndarray | None = None, languages: list[str] | None = None):
        self.grams, self.landmarks, self.weights, self.languages = grams, landmarks, weights, languages
        self.starts = np.cumsum([0] + [len(g) for g in grams])
        self.width = int(self.starts[-1])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("letters", "tables", "left")}

    def prepare(self) -> None:
        """Look-up tables from n-gram to column; unknown n-grams share a last, unused one.

        Bytes are numbered first, so that a table has a cell for each n of the bytes that
        known n-grams have, all others being one.
        """
        used = np.unique(np.concatenate([(g[:, None] >> np.arange(0, 8 * n, 8) & 255).ravel() for n, g in enumerate(self.grams, 1)]))
        self.size = len(used) + 1
        self.letters = np.full(256, len(used), np.int32)
        self.letters[used] = np.arange(len(used))
        self.tables = []
        for n, grams, start in zip(range(1, ORDER + 1), self.grams, self.starts):
            table = np.full(self.size**n, self.width, np.int32)
            table[_codes(self.letters, (grams >> np.arange(8 * n - 8, -1, -8)[:, None]) & 255, self.size)] = np.arange(len(grams)) + start
            self.tables.append(table)
        self.left = None if self.landmarks is None else np.ascontiguousarray(self._normal(self.landmarks).T)

    def _normal(self, marks: np.ndarray) -> np.ndarray:
        """Rows whose products are the kernel: each n's part has length 1 / sqrt(ORDER)."""
        out = marks.astype(np.float32)
        for a, b in zip(self.starts[:-1], self.starts[1:]):
            part = out[:, a:b]
            part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1) * ORDER)
        return out

    def marks(self, texts: list[str]) -> np.ndarray:
        """The n-grams that each text contains, as a 0/1 matrix."""
        out = np.zeros((len(texts), self.width + 1), np.uint8)
        for row, text in zip(out, texts):
            data = np.frombuffer(padded(text), np.uint8)
            for at in range(0, len(data), BLOCK):
                for n, table in enumerate(self.tables, 1):
                    part = data[at : at + BLOCK + n - 1]
                    if len(part) >= n:
                        row[table[_codes(self.letters, _shifted(part, n), self.size)]] = 1
        return out[:, :-1]

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Texts x landmarks, some texts at a time, so that CELLS bounds the matrix."""
        step = max(1, CELLS // (self.width + 1))
        parts = [self._normal(self.marks(texts[i : i + step])) @ self.left for i in range(0, len(texts), step)]
        return np.concatenate(parts) if parts else np.zeros((0, self.left.shape[1]), np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel(texts) @ self.weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A language and a score from 0 to 1 for each text."""
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        languages, out = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known and self.languages:
            s = self.scores([texts[i] for i in known])
            for i, k, v in zip(known, s.argmax(1).tolist(), np.clip(s.max(1), 0, 1).astype(float).tolist()):
                languages[i], out[i] = self.languages[k], v
        return languages, out


def fit(texts: list[str], labels: list[str]) -> Model:
    """The model of labelled texts; without any it knows no language."""
    order = np.lexsort((np.array([hash_of(t) for t in texts], np.uint64), np.array(labels))) if texts else []
    texts, labels = [texts[i] for i in order], [labels[i] for i in order]
    found = []
    for n in range(1, ORDER + 1):
        counts = np.zeros(256**n, np.int32)
        for text in texts:
            data = np.frombuffer(padded(text), np.uint8)
            counts[np.unique(_codes(_BYTES, _shifted(data, n), 256)) if len(data) >= n else []] += 1
        grams = np.flatnonzero(counts)
        if len(grams) > GRAMS:
            grams = np.sort(grams[np.argsort(-counts[grams], kind="stable")[:GRAMS]])
        found.append(grams.astype(np.int32))
    model = Model(found)
    model.prepare()
    if not texts:
        return Model(found, np.zeros((0, model.width), np.uint8), np.zeros((0, 0), np.float32), [])
    # Landmarks: as many of each language, spread over its rows.
    languages = sorted(set(labels))
    each = max(1, LANDMARKS // len(languages))
    at = np.array(labels)
    chosen = np.concatenate([np.flatnonzero(at == x)[:each] for x in languages])
    model.landmarks = model.marks([texts[i] for i in chosen])
    model.prepare()
    k = model.kernel(texts).astype(np.float64)
    values, vectors = np.linalg.eigh(k[chosen])
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = k @ root
    y = (at[:, None] == np.array(languages)[None, :]).astype(np.float64)
    # Each language counts alike, however many rows it has.
    w = (y / y.sum(0)).sum(1, keepdims=True)
    solved = np.linalg.solve(z.T @ (w * z) + RIDGE * np.eye(z.shape[1]), z.T @ (w * y))
    return Model(found, model.landmarks, (root @ solved).astype(np.float32), languages)


def hash_of(text: str) -> int:
    return zlib.crc32(text.encode())


def spread(text: Column, size: int) -> Column:
    """A text of over `size` bytes as PIECES of it, evenly spread, of about that size together."""
    n = F.length(text)
    take = F.greatest(F.lit(1), F.floor(n * F.lit(size) / F.octet_length(text) / PIECES)).cast("int")
    pieces = [F.substring(text, (F.floor((n - take) * F.lit(k / (PIECES - 1))) + 1).cast("int"), take) for k in range(PIECES)]
    return F.when(F.octet_length(text) <= size, text).otherwise(F.concat_ws(" ", *pieces))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """About `rows` labelled texts a language, chosen by a hash of doc_id; 1.3 times that at
    most. Of a long text there are pieces."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike("\\p{L}")).select("doc_id", "text", "lang")
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return []
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, rows / r["count"])) for r in counts], "lang string, share double")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    chosen = labelled.join(F.broadcast(share), "lang").where(part < F.col("share"))
    size = max(PIECES, min(SAMPLE_BYTES, SAMPLE_TOTAL // (rows * len(counts))))
    most = int(1.3 * rows * len(counts))
    return [(r.text, r.lang) for r in chosen.select("doc_id", spread(F.col("text"), size).alias("text"), "lang", part.alias("part")).orderBy("part", "doc_id").limit(most).select("text", "lang").collect()]


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model of the rows of docs (doc_id, text, lang) that have a text and a language."""
    pairs = sample(docs, rows)
    return fit([t for t, _ in pairs], [x for _, x in pairs])


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs with lang_pred and score beside the columns in `keep`; only text is read for them.

    A text that is null, empty or without any letter is UNKNOWN with score 0. Whole texts
    are read, however long; rows are independent, so repeated rows get equal results and an
    empty table none. The model's size is bounded by LANDMARKS, GRAMS and the languages.
    """
    return _scored(docs.select(*keep, F.col("text").alias("_text")), len(keep), model, False).toDF(*keep, "lang_pred", "score")


def _scored(rows: DataFrame, text_at: int, model: Model, whole: bool = True) -> DataFrame:
    """rows, whose columns are numbered, with the language and score of the column text_at;
    unless they are to be whole, that column, the last, is left out."""
    shared, key = rows.sparkSession.sparkContext.broadcast(model), f"langid-{uuid.uuid4().hex}"
    numbered = rows.toDF(*map(str, range(len(rows.columns))))
    own = len(rows.columns) - (not whole)
    schema = T.StructType([*numbered.schema.fields[:own], T.StructField("lang", T.StringType()), T.StructField("p", T.DoubleType())])

    def ready() -> Model:
        shared.value.prepare()
        return shared.value

    def run(batches):
        mine = common.held(key, ready)
        for batch in batches:
            for part in common.slices(batch, str(text_at), 1 << 20):
                languages, scores = mine.predict(part.column(text_at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:own], pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return common.mapped(numbered, run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return common.crc_mod(doc_id, 5) == 0


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; the model never sees held-out rows."""
    model = train(docs.where(~held_out()))
    found = predict(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def identified_rows(docs: DataFrame, least_score: float = 0.2) -> DataFrame:
    """docs without the rows whose language cannot be told: no letters, or a score below
    least_score for every language. All columns stay, whatever their names. Where no row
    has both a text and a language, there is nothing to learn, and all rows with letters stay.
    """
    model = train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike("\\p{L}"))
    found = _scored(docs, docs.columns.index("text"), model)
    good = found.where((F.col("lang") != UNKNOWN) & (F.col("p") >= least_score))
    return good.drop("lang", "p").toDF(*docs.columns)
