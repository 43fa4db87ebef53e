"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad by a two-state CRF. A line's features are its own form (length, shares of letters, capitals,
digits, symbols, repeated words, ...) and that of the lines before and after it. Forward-backward marginals of "good", weighted
by line lengths, are the document's score. Lines are trained with their document's label, on a bounded sample of labelled
documents (whole texts in the order of hashed ids, at most SAMPLE of them and SAMPLE_LINES lines in all: what the driver fits on is
bounded by both); scoring covers all documents and whole texts.

Defined results. Null or empty text: one empty line, scored like any line. Rows with equal doc_id: each scored by its text.
Null doc_id: scored, and not held out. No labelled rows, or labels of one kind only: a constant score (the share of
good labels with one of each kind added). Labels that are null are ignored. Empty table: no rows. Very long texts: whole; one of more than
LINES_AT_ONCE lines goes by stretches, forward and backward, to the same score. Extra columns, whatever their names: kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 6000
#: Lines of all of them together, at most.
SAMPLE_LINES = 200_000
#: Lines whose features are made at once.
_CHUNK = 4096
THRESHOLD = 0.3
FOLDS = 5
#: Lines whose features are held at once; a text of more goes by stretches of about so many bytes.
LINES_AT_ONCE = 50_000
STRETCH = 1 << 18
FORM = 24
WIDTH = 3 * FORM + 3
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER, _DIGITS, _BLANK = bytes(range(65, 91)), b"0123456789", b" \t\r\x0b\x0c"
_PLAIN = b".,;:'\"()-?"
_ODD = b"#$%&*@^~=+<>{}[]_\\/`"


def form(line: bytes) -> list[float]:
    """What a line looks like, every number between 0 and about 1."""
    n = len(line)
    if not n:
        return [1.0] + [0.0] * (FORM - 1)
    left = lambda drop: (n - len(line.translate(None, drop))) / n
    letters, upper, digits, blank, plain, odd = map(left, (_LETTERS, _UPPER, _DIGITS, _BLANK, _PLAIN, _ODD))
    bars, bangs = line.count(b"|") / n, line.count(b"!") / n
    words = line.split()
    w = len(words)
    distinct = len(set(words)) / w if w else 1.0
    same = sum(map(bytes.__eq__, words, words[1:])) / w if w else 0.0
    return [
        0.0, min(1.0, np.log1p(n) / 8), min(1.0, np.log1p(w) / 6), min(1.0, n / max(w, 1) / 20), letters, min(1.0, upper * 2), float(upper > 0.3), min(1.0, digits * 4),
        float(digits > 0.15), blank, min(1.0, plain * 8), min(1.0, odd * 8), float(odd > 0.03), float(odd > 0.1), min(1.0, bars * 10), float(bars > 0.02),
        min(1.0, bangs * 10), float(bangs > 0.03), distinct, float(w > 5 and distinct < 0.5), min(1.0, same * 2), float(w > 3 and same > 0.2), float(line.rstrip()[-1:] in b".!?"), float(w < 4),
    ]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x WIDTH) features with those of the neighbours, and the lines' weights."""
    lines = text.encode("utf-8", "replace").split(b"\n")
    own = np.empty((len(lines), FORM), dtype=np.float32)
    for at in range(0, len(lines), _CHUNK):  # numbers as Python objects only for so many lines at once
        own[at : at + _CHUNK] = [form(x) for x in lines[at : at + _CHUNK]]
    out = np.zeros((len(lines), WIDTH), dtype=np.float32)
    out[:, :FORM] = own
    out[1:, FORM : 2 * FORM] = own[:-1]
    out[:-1, 2 * FORM : 3 * FORM] = own[1:]
    out[0, 3 * FORM] = out[-1, 3 * FORM + 1] = out[:, 3 * FORM + 2] = 1.0
    return out, np.array([max(1, len(x)) for x in lines], dtype=np.float64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Chains:
    """Documents' lines side by side: forward-backward runs over all documents at once, longest first."""

    def __init__(self, counts):
        self.n = np.asarray(counts, dtype=np.int64)
        self.order = np.argsort(-self.n, kind="stable")
        self.first = (np.cumsum(self.n) - self.n)[self.order]
        self.sorted = self.n[self.order]
        # how many documents have more than t lines
        self.live = np.searchsorted(-self.sorted, -np.arange(1, (self.sorted[0] if len(self.n) else 0) + 1), side="right")

    def marginals(self, score: np.ndarray, move: np.ndarray, pairs: bool = False):
        """P(good) of every line; with pairs, the summed expectation of each transition too. score: of good over bad; move: 2 x 2, logs."""
        k, longest = np.exp(move - move.max()), len(self.live)
        odds = np.stack([np.ones_like(score), np.exp(np.clip(score, -30, 30))], axis=1)
        odds /= odds.sum(axis=1, keepdims=True)
        ahead = np.empty_like(odds)
        for t in range(longest):
            at = self.first[: self.live[t]] + t
            a = odds[at] if t == 0 else (ahead[at - 1] @ k) * odds[at]
            ahead[at] = a / a.sum(axis=1, keepdims=True)
        back = np.ones_like(odds)
        for t in range(longest - 2, -1, -1):
            at = self.first[: self.live[t + 1]] + t
            b = (back[at + 1] * odds[at + 1]) @ k.T
            back[at] = b / b.sum(axis=1, keepdims=True)
        both = ahead * back
        good = both[:, 1] / both.sum(axis=1)
        if not pairs:
            return good
        inner = np.ones(len(score), dtype=bool)
        inner[(np.cumsum(self.n) - 1)] = False
        at = np.flatnonzero(inner)
        joint = ahead[at][:, :, None] * k[None] * (odds[at + 1] * back[at + 1])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        return good, joint.sum(axis=0)


class Model:
    """weights of a line's features, transition scores; constant: the score of everything if nothing could be learned."""

    def __init__(self, weights=None, move=None, constant=None):
        self.weights, self.move, self.constant = weights, move, constant

    def _emissions(self, before: bytes | None, lines: list[bytes], after: bytes | None) -> np.ndarray:
        """The lines' scores of good over bad; a line that repeats is looked at once. before, after: the lines beside them; None at an end."""
        held = [*([] if before is None else [before]), *lines, *([] if after is None else [after])]
        number: dict[bytes, int] = {}
        at = np.array([number.setdefault(x, len(number)) for x in held])
        looks = np.array([form(x) for x in number], dtype=np.float32)
        own, last, following = (looks @ self.weights[k * FORM : (k + 1) * FORM] for k in range(3))
        out = own[at].astype(np.float64) + self.weights[3 * FORM + 2]
        out[1:] += last[at[:-1]]
        out[:-1] += following[at[1:]]
        out[0] += self.weights[3 * FORM] if before is None else 0.0
        out[-1] += self.weights[3 * FORM + 1] if after is None else 0.0
        return out[before is not None : len(held) - (after is not None)]

    def score_long(self, text: str, most: int | None = None) -> float:
        """The score of a text of any number of lines, stretch by stretch of about `most` bytes: forward to the end, keeping the message
        that enters each stretch, then backward. What is held is a stretch's, whatever the text's length."""
        if self.constant is not None:
            return self.constant
        data, most = text.encode("utf-8", "replace"), most or STRETCH
        cuts = [0]
        while (cut := data.find(b"\n", cuts[-1] + most)) >= 0:
            cuts.append(cut + 1)
        cuts.append(len(data) + 1)
        (k00, k01), (k10, k11) = np.exp(self.move - self.move.max()).tolist()

        def stretch(n):
            a, b = cuts[n], cuts[n + 1]
            lines = data[a : b - 1].split(b"\n")
            before = data[data.rfind(b"\n", 0, a - 1) + 1 : a - 1] if a else None
            end = data.find(b"\n", b)
            after = data[b : end if end >= 0 else len(data)] if b <= len(data) else None
            good = _sigmoid(self._emissions(before, lines, after)).tolist()
            return lines, good

        def ahead(message, good):
            out = []
            for p in good:
                f0, f1 = (1.0, 1.0) if message is None else (message[0] * k00 + message[1] * k10, message[0] * k01 + message[1] * k11)
                f0, f1 = f0 * (1 - p), f1 * p
                message = f0 / (f0 + f1), f1 / (f0 + f1)
                out.append(message)
            return out

        entering: list = [None]
        for n in range(len(cuts) - 2):
            entering.append(ahead(entering[-1], stretch(n)[1])[-1])
        total = weight = 0.0
        back = (1.0, 1.0)
        for n in range(len(cuts) - 2, -1, -1):
            lines, good = stretch(n)
            for line, (f0, f1), p in zip(reversed(lines), reversed(ahead(entering[n], good)), reversed(good), strict=True):
                w = max(1, len(line))
                total += w * f1 * back[1] / (f0 * back[0] + f1 * back[1])
                weight += w
                b0, b1 = back[0] * (1 - p), back[1] * p
                back = b0 * k00 + b1 * k01, b0 * k10 + b1 * k11
                back = back[0] / (back[0] + back[1]), back[1] / (back[0] + back[1])
        return total / weight

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        made = [features(t) for t in texts]
        emit = np.concatenate([x @ self.weights for x, _ in made]) if made else np.zeros(0)
        good = Chains([len(w) for _, w in made]).marginals(emit.astype(np.float64), self.move)
        ends = np.cumsum([len(w) for _, w in made])
        return np.array([float(np.average(good[e - len(w) : e], weights=w)) for (_, w), e in zip(made, ends, strict=True)]) if made else np.zeros(0)


def fit(x: np.ndarray, counts: list[int], labels: list[int], rounds: int = 60, ridge: float = 1e-3) -> Model:
    """Maximum likelihood of the lines' labels (their documents') by gradient steps: the features alone first, then the chain."""
    labels = np.asarray(labels, dtype=np.float64)
    if len(set(labels.tolist())) < 2:
        return Model(constant=float((labels.sum() + 1) / (len(labels) + 2)))
    counts = np.asarray(counts)
    y = np.repeat(labels, counts)
    weight = np.repeat(1 / counts, counts)  # each document counts alike
    weight /= weight.sum()
    x = x.astype(np.float64)
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)

    def step(k, grad, rate):
        nonlocal m, v, w, move
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        change = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        w, move = w - change[: len(w)], move - change[len(w) :].reshape(2, 2)

    for k in range(1, 201):
        step(k, np.r_[x.T @ (weight * (_sigmoid(x @ w) - y)) + ridge * w, np.zeros(4)], 0.1)
    chains = Chains(counts)
    last = np.cumsum(counts) - 1
    inner = np.ones(len(y), dtype=bool)
    inner[last] = False
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = ((y == label) & inner).sum()
    moves = max(1.0, seen.sum())
    m, v = np.zeros_like(m), np.zeros_like(v)
    for k in range(1, rounds + 1):
        good, joint = chains.marginals(x @ w, move, pairs=True)
        # the weights share out evenly between documents, the transitions between moves
        step(k, np.r_[x.T @ (weight * (good - y)) + ridge * w, ((joint - seen) / moves + ridge * 10 * move).ravel()], 0.03)
    return Model(w, move)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> Model:
    """Fit on a bounded sample of labelled documents that are not held out. What reaches the driver is their lines' features.

    Of an id with several labels the greatest counts; of an id with several rows one text is taken.
    """
    rows = labels.select(labels["doc_id"].cast("long").alias("_id"), labels["quality"].cast("int").alias("_label"))
    rows = rows.where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    chosen = rows.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    plain = docs.select(docs["doc_id"].cast("long").alias("_id"), text_of(docs).alias("text"))
    joined = plain.join(F.broadcast(chosen), "_id").select("_id", "_label", "text")  # at most `sample` rows of two numbers
    measured = joined.groupBy("_id").agg(F.min(F.struct(F.xxhash64("text").alias("copy"), F.regexp_count("text", F.lit("\n")).alias("breaks"))).alias("one"))
    before = F.sum(F.col("one.breaks") + 1).over(Window.orderBy(F.xxhash64("_id"), "_id"))  # at most `sample` rows
    fits = written(measured.withColumn("upto", before).where(F.col("upto") <= sample_lines).select("_id", F.col("one.copy").alias("copy")), "sample")

    def run(batches):
        for batch in batches:
            made = [features(t.as_py())[0] for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.astype("<f4").tobytes() for x in made], pa.binary())], names=["id", "label", "x"])

    once = joined.withColumn("copy", F.xxhash64("text")).join(F.broadcast(fits), ["_id", "copy"]).dropDuplicates(["_id"]).select("_id", "_label", "text")
    found = sorted(once.mapInArrow(run, "id long, label int, x binary").collect())
    x = [np.frombuffer(r["x"], dtype="<f4").reshape(-1, WIDTH) for r in found]
    return fit(np.concatenate(x) if x else np.zeros((0, WIDTH)), [len(a) for a in x], [r["label"] for r in found])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the column quality_score (an input column of that name is replaced). No column but text is looked at."""
    kept = [c for c in docs.columns if c != "quality_score"]
    rows = docs.select(*[docs[f"`{c}`"] for c in kept], text_of(docs).alias("_line_text"))
    schema = rows.drop("_line_text").withColumn("quality_score", F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            scores, held, lines = [], [], 0
            for text in batch.column(batch.num_columns - 1):
                text = text.as_py()
                n = text.count("\n") + 1
                if held and (lines + n > LINES_AT_ONCE or len(held) == 512):
                    scores += model.score(held).tolist()
                    held, lines = [], 0
                if n > LINES_AT_ONCE:
                    scores.append(model.score_long(text))
                else:
                    held.append(text)
                    lines += n
            scores += model.score(held).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "quality_score"])

    return rows.mapInArrow(run, schema)
