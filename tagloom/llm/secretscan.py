"""Secret scans: fixed rules, and a character convolutional network over candidates.

Candidates are runs of characters that keys are written in, each with its surroundings in a
window of fixed width. Each scan cuts them from the texts anew, as runs over the codes of many
texts at once, which costs less than to keep them. Labelled examples that are made by rule join
them, so that there is a network for any input. It is trained in numpy on a loss
that is zero, and so is its gradient, for what is told apart by a margin: a working set has
what isn't, and sweeps over all candidates add to it until nothing outside it is within the
margin, so that the loss on it is the loss on all. Scores are calibrated on all candidates
that are held out from training, and the threshold is the greatest that keeps a given recall
of these. A last scan scores every candidate in its text; those above the threshold that no
rule found, and parts of candidates outside the rules' spans, are added to these.
"""

from __future__ import annotations

import copy
import hashlib
import heapq
import itertools
import math
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The rules, in order of kind.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "model")
_ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

#: The rules' least length of a value.
LEAST = 8
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: What a candidate is: no finding, a finding, or a part beside one, which is no example.
OTHER, FOUND, PART = 0, 1, 2
#: Characters of a window: before a candidate, of it, and after. A longer candidate has
#: several windows, of which each starts STRIDE after the last; it scores as its best.
BEFORE, INSIDE, AFTER, STRIDE = 24, 48, 8, 40
WIDTH = BEFORE + INSIDE + AFTER
FILTERS, KERNEL, SYMBOLS = 24, 5, 256
#: Windows that are scored at a time, and that are cut at a time.
BLOCK, CUTS = 2048, 1 << 14
#: Examples made by rule of each label.
MADE = 1200
EPOCHS, RECALL, BATCH = 8, 0.98, 128
#: A logit that is further from 0 than MARGIN on its label's side has no loss. The working set gets
#: what is within MARGIN + SLACK; SLACK doubles with each sweep over all, so that sweeps end.
MARGIN, SLACK = 2.0, 1.0
#: First shares of the candidates, by hash, on which a network is brought up before it meets all.
SHARES = (64, 8)
#: Examples of the working set that one task learns from at a time.
SHARD = 1 << 16
#: Strata of the candidates: findings, and others of digits, of letters, and of both or more.
STRATA = ("found", "digits", "letters", "mixed")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the rules find, in order; ends are exclusive."""
    spans, low = [], text.lower().encode()
    if any(h in low for h in _ASSIGN_HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _codes(text: str) -> bytes:
    return text.encode("latin-1", "replace").translate(_NARROW)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, what it is) of the candidates, each FOUND one before its parts outside
    all spans; spans are in order."""
    out, first = [], 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        # Spans of one rule don't overlap, so few that end before a candidate stand behind `first`.
        while first < len(spans) and spans[first][2] <= start:
            first += 1
        parts, at, met = [], start, False
        for s, _, e in itertools.islice(spans, first, None):
            if s >= end:
                break
            if e > start:
                met = True
                parts.append((at, s))
                at = max(at, e)
        if not met:
            out.append((start, end, OTHER))
            continue
        out.append((start, end, FOUND))
        out += [(s, e, PART) for s, e in [*parts, (at, end)] if e - s >= LEAST]
    return out


_NARROW = bytes(min(b, 127) for b in range(256))
_AROUND = bytes(128 + min(b, 126) for b in range(256))


def windows(text: str, start: int, end: int) -> bytes:
    """Codes around and in a candidate, WIDTH a window; those around it are 128 and more."""
    out = []
    for at in range(start, max(start + 1, end - INSIDE + STRIDE), STRIDE):
        before = text[max(0, at - BEFORE) : at].encode("latin-1", "replace").translate(_AROUND).rjust(BEFORE, b"\xff")
        stop = min(end, at + INSIDE)
        after = text[stop : stop + AFTER].encode("latin-1", "replace").translate(_AROUND).ljust(AFTER, b"\xff")
        out.append(before + (_codes(text[at:stop]) + after).ljust(INSIDE + AFTER, b"\xff"))
    return b"".join(out)


def stratum(value: str, what: int) -> int:
    """The number of a candidate's stratum; PART has none, and counts as mixed."""
    bare = value.strip("+/_=-")
    return 0 if what == FOUND else 1 if bare.isdigit() else 2 if bare.isalpha() else 3


#: Characters of Latin-1 of which a candidate may consist, and its letters and digits.
_MAY = bytes(b < 128 and bool(CANDIDATE.fullmatch(chr(b) * LEAST)) for b in range(256))
_DIGIT = bytes(b < 128 and chr(b).isdigit() for b in range(256))
_ALNUM = bytes(b < 128 and chr(b).isalnum() for b in range(256))
#: By how much a window has of a candidate, what its bytes are cut to (and) and filled with (or).
_CUT, _FILL = np.zeros((INSIDE + 1, WIDTH), np.uint8), np.zeros((INSIDE + 1, WIDTH), np.uint8)
for _n in range(INSIDE + 1):
    _CUT[_n, : BEFORE + _n + AFTER] = 255
    _CUT[_n, BEFORE : BEFORE + _n] = 127
    _FILL[_n, BEFORE + _n + AFTER :] = 255


class Cut:
    """The rules' spans and the candidates of texts, as `base_spans`, `candidates`, `stratum` and `windows` have them.

    All texts are one array of codes, in which runs are found at once; only texts in which a
    rule may find something go through the rules. rows, starts, ends, whats: of the candidates,
    by text and start, with places in their texts.
    """

    def __init__(self, texts: list[str]):
        gap = b"\xff" * BEFORE
        raw = [x.encode("latin-1", "replace") for x in texts]
        joined = gap + b"".join(x + gap for x in raw) + b"\xff" * WIDTH
        sizes = np.array([len(x) for x in raw], np.int64) + BEFORE
        self.first = BEFORE + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
        self.codes = np.frombuffer(joined.translate(_AROUND), np.uint8).copy()
        self.codes[: BEFORE] = 255
        self.codes[len(self.codes) - WIDTH :] = 255
        for at in (self.first + sizes - BEFORE).tolist():
            self.codes[at : at + BEFORE] = 255
        may = np.frombuffer(joined.translate(_MAY), bool)
        edges = np.flatnonzero(may[1:] != may[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= LEAST
        starts, ends = starts[long], ends[long]
        rows = np.searchsorted(self.first, starts, "right") - 1
        # Where the rules may find something: a hint, or a run of hexadecimal digits in a long candidate.
        low, near = joined.lower(), set()
        for hint, where in [(h, low) for h in _ASSIGN_HINTS] + [(b"AKIA", joined)]:
            at = where.find(hint)
            while at >= 0:
                row = int(np.searchsorted(self.first, at, "right")) - 1
                near.add(row)
                at = where.find(hint, int(self.first[row] + sizes[row]))
        for i in np.flatnonzero(ends - starts >= 32).tolist():
            if HEX.search(joined[starts[i] : ends[i]].decode("latin-1")):
                near.add(int(rows[i]))
        self.spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        whats = np.full(len(rows), OTHER, np.int8)
        if near:
            more = []
            for row in near:
                self.spans[row] = base_spans(texts[row])
                more += [(row, s + int(self.first[row]), e + int(self.first[row]), what) for s, e, what in candidates(texts[row], self.spans[row])]
            plain = ~np.isin(rows, np.fromiter(near, np.int64))
            table = np.array(more, np.int64).reshape(-1, 4)
            rows, starts, ends, whats = (np.concatenate([x[plain], table[:, k]]) for k, x in enumerate((rows, starts, ends, whats)))
            order = np.lexsort((whats == PART, starts, rows))
            rows, starts, ends, whats = rows[order], starts[order], ends[order], whats[order]
        self.rows, self.whats, self._starts, self._ends, self._raw = rows, whats, starts, ends, joined
        self.starts, self.ends = starts - self.first[rows], ends - self.first[rows]

    def strata(self) -> np.ndarray:
        def count(table: bytes) -> np.ndarray:
            before = np.cumsum(np.frombuffer(self._raw.translate(table), np.int8), dtype=np.int32)
            return before[self._ends - 1] - before[self._starts - 1]

        alnum, digits = count(_ALNUM), count(_DIGIT)
        out = np.where(alnum < self._ends - self._starts, 3, np.where(digits == alnum, 1, np.where(digits == 0, 2, 3))).astype(np.int32)
        for i in np.flatnonzero((alnum < self._ends - self._starts) & ((digits == alnum) | (digits == 0))).tolist():
            out[i] = stratum(self._raw[self._starts[i] : self._ends[i]].decode("latin-1"), OTHER)
        out[self.whats == FOUND] = 0
        return out

    def windows(self, take: np.ndarray, offset: np.ndarray | int = 0) -> np.ndarray:
        """A window of each candidate in take, which starts by offset after it."""
        at = self._starts[take] + offset
        n = np.minimum(self._ends[take] - at, INSIDE)
        out = np.lib.stride_tricks.sliding_window_view(self.codes, WIDTH)[at - BEFORE]
        out &= _CUT[n]
        out |= _FILL[n]
        return out


def draws(codes: np.ndarray) -> np.ndarray:
    """The CRC-32 of each window; no code is 0, so that they are strings to numpy."""
    return np.fromiter(map(zlib.crc32, codes.view(f"S{WIDTH}").ravel().tolist()), np.int64, len(codes))


#: Of numbers, words and mixtures that no rule found so many times more are drawn.
OTHERS = 2


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """stratum, n, draw, codes: for each task and stratum how many candidates there are (no
    codes), and the different windows of least hash, which hold the least of all.

    It is for a look at a table's candidates; the network learns from all of them (`examples`).
    """

    def run(batches):
        counts, kept = [0] * len(STRATA), [{} for _ in STRATA]
        heaps: list[list] = [[] for _ in STRATA]
        most = [sample] + [OTHERS * sample] * 3
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for start, end, what in candidates(text or "", base_spans(text or "")):
                    if what == PART:
                        continue
                    k = stratum(text[start:end], what)
                    counts[k] += 1
                    # What cannot be among the least is told from the value, before its window is cut.
                    if what == OTHER and len(heaps[k]) == most[k] and zlib.crc32(text[start:end].encode()) > -heaps[k][0][0]:
                        continue
                    codes = windows(text, start, end)[:WIDTH]
                    draw = zlib.crc32(text[start:end].encode())
                    if codes in kept[k]:
                        continue
                    if len(heaps[k]) < most[k]:
                        heapq.heappush(heaps[k], (-draw, codes))
                        kept[k][codes] = draw
                    elif (-draw, codes) > heaps[k][0]:
                        kept[k].pop(heapq.heapreplace(heaps[k], (-draw, codes))[1])
                        kept[k][codes] = draw
        rows = [(k, n, None, None) for k, n in enumerate(counts)] + [(k, None, draw, codes) for k in range(len(STRATA)) for codes, draw in kept[k].items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["stratum", "n", "draw", "codes"])

    return common.mapped(docs.select("text"), run, "stratum int, n long, draw long, codes binary")


def matrix(column) -> np.ndarray:
    """Codes of an Arrow column of whole windows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)


def made_examples(n: int = MADE, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Codes and labels of n keys, and of as many numbers, words, paths and names, by rule."""
    rng = random.Random(seed)
    pick = lambda symbols, k: "".join(rng.choices(symbols, k=k))
    low, mixed = string.ascii_lowercase + string.digits, string.ascii_letters + string.digits
    onsets, vowels, codas = [*"bcdfghjklmnpqrstvwxyz", "ch", "sch", "pf", "st", "tr", "br", "qu", ""], ["a", "e", "i", "o", "u", "aa", "ei", "ie", "ou", "y"], ["", "", "n", "s", "r", "l", "t", "ng", "tz", "pf", "ck", "lich"]
    word = lambda: "".join(rng.choice(part) for _ in range(rng.randint(2, 5)) for part in (onsets, vowels, codas))
    keys = [
        lambda: pick("0123456789abcdef", rng.choice([32, 40, 64])),
        lambda: pick("0123456789ABCDEF", rng.choice([32, 40])),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        lambda: pick(mixed + "+/", rng.randint(24, 64)),
        lambda: pick(mixed, rng.randint(20, 40)),
        lambda: rng.choice(["sk_live_", "ghp_", "xoxb-", "key-"]) + pick(mixed, rng.randint(20, 36)),
    ]
    harmless = [
        lambda: pick(string.digits, rng.randint(8, 20)),
        lambda: "-".join(pick(string.digits, 4) for _ in range(rng.randint(2, 4))),
        lambda: f"20{pick(string.digits, 2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
        word,
        word,
        lambda: word() + word(),
        lambda: word().upper(),
        lambda: word().title() + word().title() + word().title(),
        lambda: "_".join(word() for _ in range(rng.randint(2, 4))),
        lambda: "/".join(word() for _ in range(rng.randint(2, 4))),
        lambda: "-".join(word() for _ in range(2)) + f"-{rng.randint(1, 99)}",
        lambda: rng.choice("-=_") * rng.randint(8, 40),
        lambda: f"{word()}{rng.randint(1, 2030)}",
    ]
    codes, labels = [], []
    for label, kinds in ((1, keys), (0, harmless)):
        for i in range(n):
            value = kinds[i % len(kinds)]()
            value += "x" * (LEAST - len(value))
            before = rng.choice([f"{word()} ", f"{word()}: ", f'{word()} = "', f"{word()}, {word()} ", "\n", ""])
            text = before + value + rng.choice(["", " ", '"', ".", f" {word()}", "\n"])
            codes.append(windows(text, len(before), len(before) + len(value))[:WIDTH])
            labels.append(label)
    return np.frombuffer(b"".join(codes), np.uint8).reshape(-1, WIDTH), np.array(labels)


class Network:
    """Convolution over one-hot characters, the greatest value of each filter, one output."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0, 0.1, (KERNEL, SYMBOLS, FILTERS)).astype(np.float32)
        self.c = np.zeros(FILTERS, np.float32)
        self.v = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.b = np.float32(0)
        self.scale, self.shift, self.threshold, self.precision = 1.0, 0.0, 1.0, 1.0
        self.integers: tuple | None = None

    def _integers(self) -> tuple[list[tuple[np.ndarray, int]], np.float32]:
        """As _singles, of two characters at a time where there are two, in 16-bit multiples of a step."""
        most = float((np.abs(self.w).max(1).sum(0) + np.abs(self.c)).max())
        step = np.float32(2.0 ** math.ceil(math.log2(max(most, 1e-6) / 32000)))
        w = np.rint(self.w / step).astype(np.int16)
        first, second = ((w[k][:, None] + w[k + 1][None]).reshape(-1, FILTERS) for k in (0, 2))
        return [(first + np.rint(self.c / step).astype(np.int16), 0), (second, 2), (w[4], 4)], step

    def _singles(self) -> list[tuple[np.ndarray, int]]:
        """What a place of the convolution adds up: (values, place of the first character)."""
        return [(self.w[0] + self.c, 0)] + [(self.w[k], k) for k in range(1, KERNEL)]

    def _pooled(self, codes: np.ndarray, tables: list[tuple[np.ndarray, int]], tell: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The greatest value of each filter, 0 at least, and its place if tell.

        Windows are taken by length, so that of what fills them up only one place is looked at.
        """
        length = np.minimum(WIDTH, WIDTH - (codes[:, ::-1] != 255).argmax(1) + KERNEL).astype(np.int16)
        order = np.argsort(-length, kind="stable")
        kind = tables[0][0].dtype
        out, places = np.empty((len(codes), FILTERS), kind), np.zeros((len(codes), FILTERS), np.int64) if tell else None
        for i in range(0, len(codes), BLOCK):
            rows = order[i : i + BLOCK]
            x = np.ascontiguousarray(codes[rows].T).astype(np.intp)
            pairs = x[:-1] * SYMBOLS + x[1:]
            best, at = np.zeros((len(rows), FILTERS), kind), np.zeros((len(rows), FILTERS), np.int64) if tell else None
            value, more = np.empty_like(best), np.empty_like(best)
            for j, n in enumerate(np.searchsorted(-length[rows], -np.arange(KERNEL, length[rows[0]] + 1), "right")):
                h, g = value[:n], more[:n]
                for table, k in tables:
                    np.take(table, (x if len(table) == SYMBOLS else pairs)[j + k, :n], 0, out=g if k else h, mode="clip")
                    if k:
                        h += g
                if tell:
                    np.copyto(at[:n], j, where=h > best[:n])
                np.maximum(best[:n], h, out=best[:n])
            out[rows] = best
            if tell:
                places[rows] = at
        return out, places

    def logits(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(0, np.float32)
        tables, step = self.integers or self._integers()
        # Row by row, so that a window's logit doesn't depend on those beside it.
        return (self._pooled(codes, tables)[0] * (self.v * step)).sum(1) + self.b

    def ready(self) -> Network:
        """Keeps its tables of integers, for a task, where its weights don't change any more."""
        self.integers = self.integers or self._integers()
        return self

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.logits(codes).astype(np.float64) + self.shift)))

    def fit(self, codes: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 0, shares: tuple[float, float] | None = None) -> None:
        """Adam on the squared distance to the margin; both labels weigh alike. An epoch goes over
        what is within MARGIN + SLACK as it begins, as the rest has no gradient.

        shares: of the labels 0 and 1 in all examples, where these are a part of them.
        """
        rng, step = np.random.default_rng(seed), 0
        shares = shares or ((labels == 0).mean(), (labels == 1).mean())
        weight = np.where(labels == 1, 0.5 / max(1e-9, shares[1]), 0.5 / max(1e-9, shares[0]))
        names = ("w", "c", "v", "b")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        for _ in range(epochs):
            near = np.flatnonzero(np.where(labels == 1, 1, -1) * self.logits(codes) < MARGIN + SLACK)
            for part in np.array_split(rng.permutation(near), math.ceil(len(near) / BATCH) or 1):
                if not len(part):
                    break
                sign = np.where(labels[part] == 1, 1.0, -1.0)
                pooled, _ = self._pooled(codes[part], self._singles())
                short = np.maximum(0, MARGIN - sign * (pooled @ self.v + self.b))
                # What is beyond the margin has no gradient.
                rows = np.flatnonzero(short)
                d = (-sign * short * weight[part] / len(part)).astype(np.float32)[rows]
                x, pooled = codes[part][rows], pooled[rows]
                back = (d[:, None] * self.v) * (pooled > 0)
                g = {"w": np.zeros_like(self.w), "c": back.sum(0), "v": pooled.T @ d, "b": d.sum()}
                if len(rows):
                    at = self._pooled(x, self._singles(), True)[1]
                    for k in range(KERNEL):
                        np.add.at(g["w"][k], (np.take_along_axis(x, at + k, 1), np.arange(FILTERS)[None, :]), back)
                step += 1
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * g[k]
                    second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                    move = 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - move).astype(np.float32))

    def calibrate(self, codes: np.ndarray, labels: np.ndarray, recall: float = RECALL, weights: np.ndarray | None = None) -> None:
        """A logistic scale by damped Newton steps, then the greatest threshold that keeps the recall.

        Each step is halved until the penalised log loss falls, so that it ends at its least
        value also where the labels are told apart without error. weights: how many candidates
        an example stands for; the precision at the threshold is of these.
        """
        z, y = self.logits(codes).astype(np.float64), labels.astype(np.float64)
        w = np.ones(len(z)) if weights is None else np.asarray(weights, np.float64)
        w = w / w.mean()
        soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        mean, spread = z.mean(), max(float(z.std()), 1e-6)
        self._scaled(lambda theta: _sums((z - mean) / spread, soft, w, theta), mean, spread)
        scored = self.probability(codes)
        found = np.sort(scored[labels == 1])
        self.threshold = float(found[int((1 - recall) * len(found))]) if len(found) else 1.0
        taken = scored >= self.threshold
        self.precision = float((w * (taken & (labels == 1))).sum() / max(1e-300, (w * taken).sum()))

    def _scaled(self, sums, mean: float, spread: float) -> None:
        """scale and shift, by Newton steps; sums(theta) are those of `_sums` over all examples,
        whose logits are taken less mean, by spread."""

        def penalised(theta):
            loss, g0, g1, h00, h01, h11 = sums(theta)
            return loss + RIDGE / 2 * theta @ theta, np.array([g0, g1]) + RIDGE * theta, np.array([[h00, h01], [h01, h11]]) + RIDGE * np.eye(2)

        theta = np.zeros(2)
        loss, gradient, curvature = penalised(theta)
        self.losses = [loss]
        for _ in range(100):
            step, size = np.linalg.solve(curvature, gradient), 1.0
            slope = float(gradient @ step)
            while size > 1e-10 and (tried := penalised(theta - size * step))[0] > loss - 1e-4 * size * slope:
                size /= 2
            if size <= 1e-10:
                break
            theta, (loss, gradient, curvature) = theta - size * step, tried
            self.losses.append(loss)
            if self.losses[-2] - loss < 1e-10 * max(1.0, loss):
                break
        scale = max(theta[0], 1e-3)
        self.scale, self.shift = float(scale / spread), float(theta[1] - scale * mean / spread)


def _sums(x: np.ndarray, soft: np.ndarray, w: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The log loss of a logistic scale, its two derivatives and its three second ones."""
    t = theta[0] * x + theta[1]
    p = 1 / (1 + np.exp(-t))
    d, h = w * (p - soft), w * p * (1 - p)
    return np.array([(w * (np.logaddexp(0, t) - soft * t)).sum(), (d * x).sum(), d.sum(), (h * x * x).sum(), (h * x).sum(), h.sum()])


#: Weight of the penalty on a logistic scale, in examples.
RIDGE = 1e-2


def _variants(codes: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows as they are; where alone is true also without surroundings, and so in the
    other case; and the place of each one's origin."""
    rows = np.flatnonzero(alone)
    bare = codes[rows].copy()
    bare[bare >= 128] = 255
    swapped = bare.copy()
    low, up = (swapped >= 97) & (swapped <= 122), (swapped >= 65) & (swapped <= 90)
    swapped[low] -= 32
    swapped[up] += 32
    return np.concatenate([codes, bare, swapped]), np.concatenate([np.arange(len(codes)), rows, rows])


def _telling(codes: np.ndarray) -> np.ndarray:
    """Whether a window's candidate has both letters and digits, so that it may be told by itself."""
    letter = ((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122))
    return letter.any(1) & ((codes >= 48) & (codes <= 57)).any(1)


def _learnt(network: Network, working: DataFrame, made: tuple[np.ndarray, np.ndarray]) -> None:
    """Goes on with the network's fit, on the working set (label, draw, codes) and the made examples.

    Parts of SHARD examples by hash learn in a task each, and their networks are averaged
    after each epoch; the made examples join each part. Neither parts nor order depend on how
    rows lie in partitions.
    """
    sizes = dict(map(tuple, working.groupBy("label").count().collect()))
    total = sum(sizes.values())
    parts = 1 + total // SHARD
    shares = tuple((sizes.get(k, 0) / parts + (made[1] == k).sum()) / (total / parts + len(made[1])) for k in (0, 1))
    rounds, epochs = (1, EPOCHS) if parts == 1 else (EPOCHS, 1)
    names = ("w", "c", "v", "b")
    dealt = working.withColumn("part", F.pmod(F.xxhash64("draw"), F.lit(parts)).cast("int"))
    for i in range(rounds):
        mine = network.__dict__

        def run(key, table):
            table = table.sort_by([("draw", "ascending"), ("codes", "ascending"), ("label", "ascending")])
            codes = np.concatenate([matrix(table.column("codes")), made[0]])
            labels = np.concatenate([table.column("label").to_numpy().astype(np.int64), made[1]])
            x, origin = _variants(codes, _telling(codes) | (labels == 0))
            local = Network()
            local.__dict__.update(copy.deepcopy(mine))
            local.fit(x, labels[origin], epochs, i, shares)
            flat = np.concatenate([np.ravel(getattr(local, k)) for k in names]).astype(np.float32)
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "weights": pa.array([flat.tobytes()], pa.binary())})

        if total:
            fitted = common.staged(dealt.groupBy("part").applyInArrow(run, "part int, weights binary"), "networks")
            # The driver holds one partition's networks at a time.
            flats = (r.weights for r in fitted.orderBy("part").toLocalIterator())
        else:
            none = pa.table({"label": pa.array([], pa.int32()), "draw": pa.array([], pa.int64()), "codes": pa.array([], pa.binary())})
            flats = run((pa.scalar(0),), none).column("weights").to_pylist()
        n, flat = 0, np.zeros(1)
        for one in flats:
            n, flat = n + 1, flat + np.frombuffer(one, np.float32).astype(np.float64)
        flat, at = (flat / n).astype(np.float32), 0
        for k in names:
            shape = np.shape(getattr(network, k))
            size = int(np.prod(shape))
            setattr(network, k, flat[at : at + size].reshape(shape) if shape else flat[at])
            at += size


def scores(docs: DataFrame, network: Network, first: Network | None = None, within: float | None = None, kinds: tuple[int, ...] = (0, 1, 2, 3), learn: bool = True, share: int = 1) -> DataFrame:
    """label, draw, codes, z, and z as an ordered integer, of the candidates that are not PART: each one's
    first window; mixtures that `first` takes for findings are left out.

    Texts are read and cut anew, which is cheaper than to keep windows. kinds: the strata; learn:
    those to learn from, or else those held out, of which one in `share` is taken by hash.
    within: only rows of which z is nearer than that to the other label, else without codes.
    """
    held = docs.sparkSession.sparkContext.broadcast((network, first))

    def run(batches):
        network, first = (x and x.ready() for x in held.value)
        for batch in batches:
            for part in common.slices(batch, "text"):
                cut = Cut([t or "" for t in part.column("text").to_pylist()])
                strata = cut.strata()
                some = np.flatnonzero((cut.whats != PART) & np.isin(strata, kinds))
                for i in range(0, len(some), CUTS):
                    rows = some[i : i + CUTS]
                    codes = cut.windows(rows)
                    draw = draws(codes)
                    mine = np.flatnonzero(((draw % 4 != 0) == learn) & (draw // 4 % share == 0))
                    codes, draw, kind = codes[mine], draw[mine], strata[rows[mine]]
                    z, labels = network.logits(codes), (kind == 0).astype(np.int32)
                    take = np.ones(len(z), bool) if within is None else np.where(labels == 1, z, -z) < within
                    mixed = np.flatnonzero(take & (kind == STRATA.index("mixed")))
                    if first is not None and len(mixed):
                        take[mixed] = first.logits(codes[mixed]) < 0
                    if take.any():
                        whole = pa.array(codes[take].view(f"V{WIDTH}").ravel().tolist() if within is not None else [None] * int(take.sum()), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(labels[take]), pa.array(draw[take]), whole, pa.array(z[take].astype(np.float64)), pa.array(_order(z[take]).astype(np.int32))], names=["label", "draw", "codes", "z", "key"])

    return common.mapped(docs.select("text"), run, "label int, draw long, codes binary, z double, key int")


def _order(z: np.ndarray) -> np.ndarray:
    """Integers of 32 bits, ordered as the floats are."""
    bits = (z + np.float32(0)).view(np.int32).astype(np.int64)
    return np.where(bits < 0, -(bits & 0x7FFFFFFF), bits)


def _ranked(keys: DataFrame, mine: np.ndarray, rank: int) -> int:
    """The value at that rank of the 32-bit integers in keys' `key` and in mine, by two counts of 16 bits each."""
    high, low, value = F.shiftright("key", 16), F.col("key").bitwiseAND(65535), 0
    for part, of in ((high, lambda k: k >> 16), (low, lambda k: k & 65535)):
        counts = dict(map(tuple, keys.groupBy(part.alias("part")).count().collect()))
        for k in of(mine).tolist():
            counts[k] = counts.get(k, 0) + 1
        for k in sorted(counts):
            if rank < counts[k]:
                break
            rank -= counts[k]
        value = (value << 16) + k
        keys, mine = keys.where(high == value), mine[mine >> 16 == value]
    return value


def calibrated(network: Network, scored: DataFrame, made: tuple[np.ndarray, np.ndarray], recall: float = RECALL) -> None:
    """Network.calibrate over all rows of scored (label, z, key) and the made examples, each once."""
    rows = common.staged(scored.select("label", "z", "key"), "scores")
    z, y = network.logits(made[0]).astype(np.float64), made[1]
    n, ones, total, squares = (float(v or 0) for v in rows.agg(F.count("*"), F.sum("label"), F.sum("z"), F.sum(F.col("z") * F.col("z"))).first())
    n, ones, total, squares = n + len(z), int(ones + y.sum()), total + z.sum(), squares + (z * z).sum()
    mean = total / n
    spread = max(math.sqrt(max(0.0, squares / n - mean * mean)), 1e-6)
    soft = {1: (ones + 1) / (ones + 2), 0: 1 / (n - ones + 2)}

    def sums(theta):
        x, s = (F.col("z") - mean) / spread, F.when(F.col("label") == 1, soft[1]).otherwise(soft[0])
        a = rows.select(x.alias("x"), s.alias("s"), (F.lit(float(theta[0])) * x + float(theta[1])).alias("t")).withColumn("p", 1 / (1 + F.exp(-F.col("t"))))
        x, t, p = F.col("x"), F.col("t"), F.col("p")
        d, h = p - F.col("s"), p * (1 - p)
        loss = F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t))) - F.col("s") * t
        theirs = a.agg(*(F.coalesce(F.sum(e), F.lit(0.0)) for e in (loss, d * x, d, h * x * x, h * x, h))).first()
        return np.array(theirs, np.float64) + _sums((z - mean) / spread, np.where(y == 1, soft[1], soft[0]), np.ones(len(z)), theta)

    network._scaled(sums, mean, spread)
    keys = _order(z.astype(np.float32))
    least = _ranked(rows.where("label = 1").select("key"), keys[y == 1], int((1 - recall) * ones))
    bits = np.array([least if least >= 0 else -least], np.int32)
    at = float(bits.view(np.float32)[0]) * (1 if least >= 0 else -1)
    network.threshold = float(1 / (1 + np.exp(-(network.scale * at + network.shift))))
    taken = rows.where(F.col("key") >= least).agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    network.precision = float((taken[1] + (keys[y == 1] >= least).sum()) / max(1, taken[0] + (keys >= least).sum()))


def train(docs: DataFrame) -> Network:
    """A network fitted to the rules' findings in docs and to examples made by rule.

    All candidates of docs take part. A fourth of the different windows, by hash, is held out,
    as of the examples made. Numbers and words that no rule found are harmless examples.
    Mixtures that no rule found may be keys: a first network learns without them, and those
    that it takes for findings have no part in the second's fit and calibration.

    Examples beyond the margin have neither loss nor gradient. So the working set has all
    that counts, once a sweep over all candidates finds nothing else within the margin.
    """
    codes, labels = made_examples()
    apart = np.arange(len(codes)) // 13 % 4 == 0
    mine, held = (codes[~apart], labels[~apart]), (codes[apart], labels[apart])
    plain, mixed = (0, 1, 2), (3,)
    network, working = Network(), docs.sparkSession.createDataFrame([], "label int, draw long, codes binary")
    _learnt(network, working, mine)
    slack = SLACK

    def swept(kinds: tuple[int, ...], first: Network | None = None, share: int = 1) -> bool:
        """Adds to the working set, and learns, if something outside it is within the margin."""
        nonlocal working
        near = common.staged(scores(docs, network, first, MARGIN + slack, kinds, True, share).groupBy("label", "draw", "codes").agg(F.min(F.when(F.col("label") == 1, F.col("z")).otherwise(-F.col("z"))).alias("z")), "near")
        new = near.join(working, ["label", "draw", "codes"], "left_anti")
        if not new.where(F.col("z") < MARGIN).take(1):
            return False
        working = common.staged(working.unionByName(new.drop("z")), "working")
        _learnt(network, working, mine)
        return True

    for share in SHARES:
        swept(plain, share=share)
    while swept(plain):
        slack *= 2
    first, slack = copy.deepcopy(network), SLACK
    if swept(mixed, first):
        while swept(plain + mixed, first):
            slack *= 2
    calibrated(network, scores(docs, network, first, learn=False), held)
    return network


def detect(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end by start, then kind, in code points, ends exclusive; those
    of kind `model` are the network's. A null text counts as empty. Whole texts are
    scanned; rows are independent but for the training, so repeated rows get equal
    results, and an empty table none. The findings to learn from are those in `labelled`
    (doc_id, text), or else in docs; examples made by rule join them.
    """
    network = docs.sparkSession.sparkContext.broadcast(train(docs if labelled is None else labelled))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    written = lambda x: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in x)

    def scored(cut: Cut) -> list[list]:
        """The network's spans in each text. Windows are scored in blocks as they are cut."""
        mine, added = network.value.ready(), [[] for _ in cut.spans]
        some = np.flatnonzero(cut.whats != FOUND)
        counts = np.maximum(1, -(-(cut.ends[some] - cut.starts[some] - INSIDE + STRIDE) // STRIDE))
        best, ends = np.zeros(len(some)), np.cumsum(counts)
        for i in range(0, int(ends[-1]) if len(ends) else 0, CUTS):
            number = np.arange(i, min(i + CUTS, int(ends[-1])))
            of = np.searchsorted(ends, number, "right")
            np.maximum.at(best, of, mine.probability(cut.windows(some[of], (number - ends[of] + counts[of]) * STRIDE)))
        for k in some[best >= mine.threshold].tolist():
            added[cut.rows[k]].append((int(cut.starts[k]), 3, int(cut.ends[k])))
        return added

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "text"):
                cut = Cut([t or "" for t in part.column("text").to_pylist()])
                out = []
                for doc, mine, more in zip(part.column("doc_id").to_pylist(), cut.spans, scored(cut)):
                    kinds = [k for _, k, _ in mine]
                    out.append((doc, *(kinds.count(k) for k in range(3)), hashlib.sha256(written(mine).encode()).hexdigest(), written(sorted(mine + more))))
                types = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return common.mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
