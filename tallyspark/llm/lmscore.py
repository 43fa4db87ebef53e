"""Masked pseudo-likelihood: a window network that predicts every token from both its sides.

Vocabulary: all words of all documents are counted in a table. The WORDS most frequent are tokens of their own; the other words share
OTHERS hashed tokens. Tokens are put into classes of WIDE, by falling frequency. The network adds up one learned vector for
each neighbour (two before, two behind; the token itself is masked), goes through a tanh layer and predicts the token's class,
and within the class the token, each by a softmax over learned vectors. What a hashed token stands for has the share of it that
the counts say, so that every conditional probability is normalised over words. A document's score is the sum of the logarithms.

The network is of constant size; the table of counts grows with the corpus, stays distributed and is joined with the words of
the documents that have no token of their own.

Training: every task goes once over every position of all its documents by minibatch steps (Adagrad) from one start; the mean of the
tasks' parameters, weighted by tokens seen, is the model. Spark adds up one array a task, FAN arrays at a time, in as many levels
as the number of tasks asks for; only the finished model reaches the driver. Tasks are those that the written tokens are read by.

Defined results. Null or empty text: no tokens, sum 0, null mean. Rows with equal ids: each by its own text. Very long texts
are scored whole. A word that the counts don't hold is taken to occur once. Empty table: no rows.
"""

from __future__ import annotations

from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

WORDS = 3840
OTHERS = 255
PAD = 0
CLASSES = 64
WIDE = 64
HIDDEN = 32
WINDOW = (-2, -1, 1, 2)
BATCH = 16384
RATE = 0.15
#: Tokens of several documents that are worked off at once.
STRETCH = 1 << 16
#: Places whose scores are worked off at once: they stay in a core's cache.
TILE = 1024
#: Arrays of parameters that one task adds up.
FAN = 8
SEED = 42
#: The greatest score of a class or token: its exp is far from the limit.
MOST = np.float32(60)
_REACH = 2
#: What keeps rows of arrays from lying a power of two apart, where they would share places in a cache.
_APART = 16
_ONES = np.ones(CLASSES, dtype=np.float32)  # as many as WIDE: classes and tokens of a class are chosen alike


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, h, n): how often each lower-cased word occurs in all documents, and its hash."""
    tokens = F.array_remove(F.split(F.lower(text_of(docs)), "[ \\t\\n\\x0B\\f\\r]+"), "")
    counted = docs.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return written(counted.select("word", F.xxhash64("word").alias("h"), "n"), "words")


def lexicon(counted: DataFrame, words: int = WORDS) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Token of each frequent word; the counts of all tokens (0: beyond a text's ends); whether any word has the token."""
    top = counted.orderBy(F.desc("n"), "word").limit(words).collect()  # a constant number of rows
    ids = {r["word"].encode(): k + 1 for k, r in enumerate(top)}
    counts, rare = np.zeros(1 + words + OTHERS), np.zeros(OTHERS)
    counts[1 : len(top) + 1] = [r["n"] for r in top]
    for r in counted.groupBy(F.pmod("h", F.lit(OTHERS)).alias("token")).agg(F.sum("n").alias("n")).collect():  # OTHERS rows
        rare[r["token"]] = r["n"]
    for r in top:
        rare[r["h"] % OTHERS] -= r["n"]
    counts[1 + words :] = rare
    used = np.ones(len(counts), dtype=bool)
    used[0], used[len(top) + 1 : 1 + words] = False, False
    return ids, counts, used


class Model:
    """The network. Its parameters are near, out, bias, word, word_bias."""

    PARTS = ("near", "out", "bias", "word", "word_bias")

    def __init__(self, ids: dict[bytes, int], counts: np.ndarray, used: np.ndarray):
        self.ids, self.size = ids, len(counts)
        places = CLASSES * WIDE
        order = np.argsort(-counts[1:], kind="stable") + 1
        self.place = np.zeros(self.size, dtype=np.int64)
        self.place[order] = np.arange(len(order))
        self.kind = (self.place // WIDE).astype(np.uint8)
        mass = np.zeros(places)
        mass[self.place[1:]] = np.where(used[1:], counts[1:] + 1, 0)
        mass = mass.reshape(CLASSES, WIDE)
        # what a hashed token's words count together; their own counts are added where words are known
        self.shared = np.zeros(self.size)
        self.shared[self.size - OTHERS :] = np.log(np.maximum(1.0, counts[self.size - OTHERS :]))
        rng = np.random.default_rng(3)
        normal = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.near, self.out, self.word = normal(len(WINDOW), self.size, HIDDEN), normal(HIDDEN, CLASSES), normal(CLASSES, WIDE, HIDDEN)
        log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1e-9)), -1e9).astype(np.float32)  # noqa: E731 - places without a token are closed
        self.bias, self.word_bias = log(mass.sum(axis=1)), log(mass)
        self.bias -= self.bias.max()
        self.word_bias -= np.maximum(self.word_bias.max(axis=1, keepdims=True), -1e8)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of a text, and the hashes of its words that have none of their own."""
        words = text.lower().encode("utf-8", "replace").split()
        out = np.fromiter(map(self.ids.get, words, repeat(0)), dtype=np.int64, count=len(words))
        rare = out == 0
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, compress(words, rare.tolist()), repeat(SEED)), dtype=np.uint64).view(np.int64)
        out[rare] = self.size - OTHERS + hashes % OTHERS
        return out, hashes

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self.PARTS])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name in self.PARTS:
            part = getattr(self, name)
            setattr(self, name, flat[at : at + part.size].astype(np.float32).reshape(part.shape))
            at += part.size

    def _hidden(self, padded, at):
        """The tanh layer at these places; a last column of ones brings the biases into the products."""
        total = self.near[0].take(padded[at + WINDOW[0]], axis=0)
        for k, step in enumerate(WINDOW[1:], 1):
            total += self.near[k].take(padded[at + step], axis=0)
        hidden = np.ones((len(at), HIDDEN + 1), dtype=np.float32)
        np.tanh(total, out=hidden[:, :HIDDEN])
        return hidden

    def _vectors(self):
        """Vectors and biases of all softmaxes, (softmax, choice, HIDDEN + 1): the classes, then the tokens of each class; whether scores can reach MOST."""
        vectors = np.empty((1 + CLASSES, WIDE, HIDDEN + 1), dtype=np.float32)
        vectors[0, :, :HIDDEN], vectors[0, :, HIDDEN] = self.out.T, self.bias
        vectors[1:, :, :HIDDEN], vectors[1:, :, HIDDEN] = self.word, self.word_bias
        reach = np.abs(vectors[:, :, :HIDDEN]).sum(axis=2) + vectors[:, :, HIDDEN]  # tanh stays within 1
        return vectors, not reach.max() <= MOST

    def _sorted(self, padded, at):
        """The places in the order of their tokens' classes: (order, places, classes, places of the tokens in their classes)."""
        kind = self.kind[padded[at]]
        order = np.argsort(kind, kind="stable")
        at = at[order]
        return order, at, kind[order].astype(np.int64), self.place[padded[at]] % WIDE

    @staticmethod
    def _tiles(kind, within):
        """(from, to, softmaxes) of TILE places at a time; softmaxes: (vectors' number, from and to in the tile, choices taken)."""
        for a in range(0, len(kind), TILE):
            mine, spot = kind[a : a + TILE], within[a : a + TILE]
            cuts = [0, *(np.flatnonzero(mine[1:] != mine[:-1]) + 1).tolist(), len(mine)]
            yield a, a + len(mine), [(0, 0, len(mine), mine), *((1 + int(mine[x]), x, y, spot[x:y]) for x, y in zip(cuts, cuts[1:], strict=False))]

    @staticmethod
    def _odds(scores, high):
        """exp of scores in their place, and its sums. Scores stay far below the limit of single precision; beyond MOST they are cut."""
        if high:
            np.minimum(scores, MOST, out=scores)
        np.exp(scores, out=scores)
        return scores, scores @ _ONES

    def log_likelihood(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log P(word | both sides) at these places of the padded tokens, less the log of the word's count if it shares a token."""
        order, at, kind, within = self._sorted(padded, at)
        vectors, high = self._vectors()
        found, line, held = -self.shared[padded[at]], np.arange(TILE) * WIDE, np.empty((TILE, WIDE), dtype=np.float32)
        for a, b, softmaxes in self._tiles(kind, within):
            hidden = self._hidden(padded, at[a:b])
            for v, x, y, choice in softmaxes:
                scores = np.matmul(hidden[x:y], vectors[v].T, out=held[: y - x])
                mine = np.minimum(scores.ravel()[line[: y - x] + choice], MOST)
                _, total = self._odds(scores, high)
                found[a + x : a + y] += mine - np.log(total)
        out = np.empty(len(at))
        out[order] = found
        return out

    def start(self) -> None:
        """Sums of squares for Adagrad: one for each vector or bias."""
        self.seen = {"near": np.full(self.near.shape[:2], 1e-6, dtype=np.float32), "word": np.full(self.word.shape[:2], 1e-6, dtype=np.float32)}
        self.seen |= {name: np.full(getattr(self, name).shape, 1e-6, dtype=np.float32) for name in ("out", "bias", "word_bias")}

    def step(self, padded: np.ndarray, at: np.ndarray, rate: float = RATE) -> None:
        """One step by the summed gradient of these places' log-likelihood."""
        _, at, kind, within = self._sorted(padded, at)
        vectors, high = self._vectors()
        grads, line, held = np.zeros_like(vectors), np.arange(TILE) * WIDE, np.empty((TILE, WIDE), dtype=np.float32)
        parts = np.empty((HIDDEN, len(at) + _APART))[:, : len(at)]
        for a, b, softmaxes in self._tiles(kind, within):
            hidden, back = self._hidden(padded, at[a:b]), np.zeros((b - a, HIDDEN), dtype=np.float32)
            for v, x, y, choice in softmaxes:
                error, total = self._odds(np.matmul(hidden[x:y], vectors[v].T, out=held[: y - x]), high)
                error *= (1 / total)[:, None]
                error.ravel()[line[: y - x] + choice] -= 1
                back[x:y] += error @ vectors[v, :, :HIDDEN]
                grads[v] += error.T @ hidden[x:y]
            back *= 1 - hidden[:, :HIDDEN] ** 2
            parts[:, a:b] = back.T
        for name, grad in (("out", grads[0, :, :HIDDEN].T), ("bias", grads[0, :, HIDDEN]), ("word_bias", grads[1:, :, HIDDEN])):
            self.seen[name] += grad**2
            getattr(self, name).__isub__(rate * grad / np.sqrt(self.seen[name]))
        grad, seen = grads[1:, :, :HIDDEN], self.seen["word"]
        seen += np.einsum("cwh,cwh->cw", grad, grad) / HIDDEN
        self.word -= grad * (rate / np.sqrt(seen))[:, :, None]
        grad = np.empty((HIDDEN, self.size + _APART), dtype=np.float32)[:, : self.size]
        for k, step in enumerate(WINDOW):  # the rows of one neighbour's vectors, summed by token
            token, seen = padded[at + step], self.seen["near"][k]
            for h in range(HIDDEN):
                grad[h] = np.bincount(token, parts[h], self.size)
            seen += np.einsum("hw,hw->w", grad, grad) / HIDDEN
            self.near[k] -= (grad * (rate / np.sqrt(seen))).T


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents in one array, apart by padding; where each begins."""
    gap = np.zeros(_REACH, dtype=np.int64)
    starts = np.cumsum([_REACH] + [len(p) + _REACH for p in parts[:-1]]) if parts else np.zeros(0, dtype=np.int64)
    return np.concatenate([gap, *[x for p in parts for x in (p, gap)]]), starts


def _stretches(items, size):
    """(first row, items) of rows that come to some STRETCH tokens, size(item) each."""
    first, held, n = 0, [], 0
    for k, item in enumerate(items):
        held.append(item)
        n += size(item)
        if n >= STRETCH:
            yield first, held
            first, held, n = k + 1, [], 0
    if held:
        yield first, held


def _read(value) -> np.ndarray:
    """A document's tokens as written."""
    return np.frombuffer(value.as_buffer(), dtype=np.uint16).astype(np.int64)


def tokenised(docs: DataFrame, model: Model) -> DataFrame:
    """(row, doc_id, tokens, rare), written: every document's tokens, two bytes each, and the hashes of its words that have none of their own."""

    def run(batches):
        for batch in batches:
            for first, held in _stretches((model.tokens(text.as_py()) for text in batch.column(2)), lambda x: len(x[0])):
                ends = np.cumsum([0, *(len(hashes) for _, hashes in held)]).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([hashes for _, hashes in held])))
                tokens = pa.array([part.astype(np.uint16).tobytes() for part, _ in held], pa.binary())
                mine = batch.slice(first, len(held))
                yield pa.RecordBatch.from_arrays([mine.column(0), mine.column(1), tokens, rare], names=["row", "doc_id", "tokens", "rare"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return written(rows.mapInArrow(run, "row long, doc_id long, tokens binary, rare array<bigint>"), "tokens")


def _summed(arrays: DataFrame, width: int) -> DataFrame:
    """One row (v, n): the sums of rows (v, n), v being binary arrays of `width` doubles. Every level is written."""
    def add(batches):
        total, n = np.zeros(width), 0
        for batch in batches:
            for v, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total += np.frombuffer(v.as_buffer(), dtype=np.float64)
                n += k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["v", "n"])

    left = arrays.count()
    while left > 1:
        left = -(-left // FAN)
        arrays = written(arrays.repartition(left).mapInArrow(add, "v binary, n long"), "sums")
    return arrays


def fitted(rows: DataFrame, lexis: tuple[dict[bytes, int], np.ndarray, np.ndarray]) -> Model:
    """The model of tokenised documents."""
    model = Model(*lexis)

    def run(batches):
        mine, seen, rng = Model(*lexis), 0, np.random.default_rng(7)
        mine.start()
        for batch in batches:
            for _, parts in _stretches(map(_read, batch.column(0)), len):
                padded, _ = _padded(parts)
                places = rng.permutation(np.flatnonzero(padded != PAD))
                for k in range(0, len(places), BATCH):
                    mine.step(padded, places[k : k + BATCH])
                seen += len(places)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([(mine.flat().astype(np.float64) * seen).tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["v", "n"])

    arrays = written(rows.select("tokens").mapInArrow(run, "v binary, n long"), "arrays")
    found = _summed(arrays, len(model.flat())).first()  # the model: of constant size
    if found is not None:
        model.load(np.frombuffer(found["v"], dtype=np.float64) / found["n"])
    return model


def scored(rows: DataFrame, model: Model, counted: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, sum_logprob, mean_logprob) of tokenised documents."""

    def run(batches):
        for batch in batches:
            for first, parts in _stretches(map(_read, batch.column(2)), len):
                padded, starts = _padded(parts)
                logs = np.zeros(len(padded) + 1)
                real = np.flatnonzero(padded != PAD)
                for k in range(0, len(real), BATCH):
                    logs[real[k : k + BATCH]] = model.log_likelihood(padded, real[k : k + BATCH])
                sums = np.array([logs[s : s + len(p)].sum() for s, p in zip(starts.tolist(), parts, strict=True)])
                n = np.array([len(p) for p in parts], dtype=np.int64)
                part = batch.slice(first, len(parts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(sums)], names=["row", "doc_id", "n_tokens", "net"])

    sums = rows.select("row", "doc_id", "tokens").mapInArrow(run, "row long, doc_id long, n_tokens long, net double")
    # what rare words' own counts add: nothing for those that occur once
    known = counted.where("n > 1").select("h", F.ln("n").alias("log"))
    added = rows.select("row", F.explode("rare").alias("h")).join(known, "h").groupBy("row").agg(F.sum("log").alias("added"))
    total = F.col("net") + F.coalesce("added", F.lit(0.0))
    return sums.join(added, "row", "left").select("doc_id", "n_tokens", total.alias("sum_logprob"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_logprob"))


def train(docs: DataFrame, counted: DataFrame) -> Model:
    """The model of these documents."""
    lexis = lexicon(counted)
    return fitted(tokenised(docs, Model(*lexis)), lexis)


def score(docs: DataFrame, model: Model, counted: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, sum_logprob, mean_logprob) of every document."""
    return scored(tokenised(docs, model), model, counted)


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Train on all documents, then score all documents. Texts are tokenised once."""
    counted = word_counts(docs)
    lexis = lexicon(counted)
    rows = tokenised(docs, Model(*lexis))
    return scored(rows, fitted(rows, lexis), counted)
