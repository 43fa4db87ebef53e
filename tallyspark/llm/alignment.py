"""Cross-tokenizer alignment: which tokens of two tokenizers end together.

Token ends are marked in bitsets packed into 64-bit words, one bit for each byte of the texts of a stretch, one bitset for each
tokenizer. Their AND has the shared cuts. The rank of a cut in a bitset (set bits up to it: whole words' popcounts added up, and the
popcount of the masked word) is the number of the token that ends there; select lists the cuts. Between two cuts lies a group: some
tokens of each side over the same bytes. A link is a pair of tokens that end at the same byte.

Of two tokens that end together, the bytes of the shorter one are an ending of the longer one's. So the pairs of ids that can ever
link are bounded by the two vocabularies: each entry has no more endings than bytes, and each ending at most two ids (a piece, and a
single byte's own). `most_pairs` states that bound (about 600,000 for the production pair); the table of counts never exceeds it, is
checked against it, and is the only thing that is broadcast. Texts are tokenized once; what is written for each document are its
distinct pairs of ids.

Defined results. Null and empty texts, and texts whose tokens' bytes are not a blank and the text (a text with U+2581 in it): no
tokens, zeros, an empty digest. Very long texts: tokenized and aligned whole, in stretches that end where both tokenizers have an
end anyhow. Rows with equal ids and repeated rows: each counts by its own text. Empty table: no rows. Null doc_id: kept. Extra
columns, whatever their names: left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .common import text_of, written

#: How byte-level vocabularies cut a text into words (fixed value, the usual pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A stretch of a text ends in front of a blank between two plain letters: all tokenizers of both kinds have an end there.
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: Characters that are aligned at a time, and the longest stretch of a text but for one without such a blank.
STRETCH = 1 << 20


def _byte_table(vocab: dict[str, int]) -> list[bytes]:
    """Each id's bytes, from entries in printable stand-ins of bytes."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    out = [b""] * (max(vocab.values()) + 1)
    for entry, n in vocab.items():
        out[n] = bytes(byte[c] for c in entry)
    return out


class ByteLevel:
    """A byte-level BPE from its tokenizer file, by its own merges; special tokens' strings are plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, first = made["model"], made["pre_tokenizer"]
        plain = first == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": first.get("trim_offsets"), "use_regex": True}
        if model["type"] != "BPE" or made.get("normalizer") or not plain:
            raise ValueError("a tokenizer of another kind")
        self.bytes = _byte_table(model["vocab"])
        order = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in order]
        if ids != sorted(ids) or min(ids, default=256) < 256:
            raise ValueError("merges that are not in the order of their ids")
        self._model = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks={b: n for n, b in enumerate(self.bytes) if b}, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return self._model.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


class Pair:
    """Both tokenizers of a worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), pieces.encoder(path_b)
        self.lengths_a = np.fromiter(map(len, self.a.bytes), np.int64, len(self.a.bytes))
        self.lengths_b = np.fromiter(map(len, self.b.bytes), np.int64, len(self.b.bytes))
        # how ids are written within a group and at the end of a group's side
        self.n_a, self.n_b = len(self.a.bytes), len(self.b.bytes)
        self.signs = [f"{n}{mark}" for count, marks in ((self.n_a, ",|"), (self.n_b, ",;")) for mark in marks for n in range(count)]

    def tokens(self, parts: list[tuple[str, bool]]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of both for each stretch (first ones without the blank that both put in front); None where their bytes don't agree.

        Either side's bytes are the text's, but for U+2581, which pieces hold as a blank: so the numbers of bytes tell.
        """
        spaced = [" " + t if first else t for t, first in parts]
        out: list = []
        for text, packed in zip(spaced, self.b.encode_spaced(spaced), strict=True):
            a, b = self.a.encode(text), np.frombuffer(packed, "<u4").astype(np.int64)
            n = len(text.encode())
            same = pieces.BLANK not in text and self.lengths_a[a].sum() == n == self.lengths_b[b].sum()
            out.append((a, b) if same else None)
        return out


@lru_cache(maxsize=1)
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def most_pairs(pair: Pair) -> int:
    """No more pairs of ids than this can ever link: see above."""
    return 2 * int(pair.lengths_a.sum() + pair.lengths_b.sum())


class Bits:
    """A bitset over positions 0 to n - 1 in 64-bit words, with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, places: np.ndarray, n: int) -> Bits:
        flags = np.zeros(-(-n // 64) * 64, np.uint8)
        flags[places] = 1
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        counts = np.bitwise_count(self.words).astype(np.int64)
        word = places >> 6
        below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return (np.cumsum(counts) - counts)[word] + np.bitwise_count(self.words[word] & below)


def align(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the tokens of either side that end at each shared cut. Both sides cover the same bytes."""
    n = int(lengths_a.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = Bits.of(np.cumsum(lengths_a) - 1, n), Bits.of(np.cumsum(lengths_b) - 1, n)
    cuts = (a & b).select()
    return a.rank(cuts), b.rank(cuts)


def stretches(text: str, most: int = STRETCH) -> Iterator[str]:
    """The text in stretches of about `most` characters that end in front of a blank between plain letters."""
    at = 0
    while len(text) - at > most:
        cut = _CUT.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Aligned:
    """What is known of one text: numbers of tokens and groups, the digest of the groups, distinct links and how often each occurs."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = 0
        self.agrees, self._digest, self._keys, self._times = True, hashlib.sha256(), [], []

    def add(self, n_a: int, n_b: int, groups: str, keys: np.ndarray) -> None:
        """The next stretch: its numbers of tokens, its groups as text, its links as a * 2^32 + b."""
        self._digest.update((";" * (self.n_a > 0) + groups).encode())
        self.n_a, self.n_b, self.n_groups = self.n_a + n_a, self.n_b + n_b, self.n_groups + len(keys)
        found, times = np.unique(keys, return_counts=True)
        self._keys.append(found)
        self._times.append(times)

    def row(self) -> tuple:
        none = np.zeros(0, np.int64)
        if not self.agrees or not self.n_a:
            return 0, 0, 0, "", none, none
        found, place = np.unique(np.concatenate(self._keys), return_inverse=True)
        times = np.bincount(place, np.concatenate(self._times), len(found)).astype(np.int64)
        return self.n_a, self.n_b, self.n_groups, self._digest.hexdigest(), found, times


def _align_parts(parts: list[tuple[Aligned, str, bool]], pair: Pair) -> None:
    """Aligns the stretches of several texts in one pair of bitsets; all texts end where both tokenizers have an end."""
    found = [(of, x) for (of, _, _), x in zip(parts, pair.tokens([(t, first) for _, t, first in parts]), strict=True)]
    for of, x in found:
        of.agrees &= x is not None
    found = [(of, x) for of, x in found if x is not None]
    if not found:
        return
    a, b = (np.concatenate([x[side] for _, x in found]) for side in (0, 1))
    last_a, last_b = align(pair.lengths_a[a], pair.lengths_b[b])
    keys = (a[last_a] << 32) | b[last_b]
    # all tokens in the order in which groups list them: a group's on the one side, then on the other
    ends = [np.zeros(len(x), np.int64) for x in (a, b)]
    ends[0][last_a] = ends[1][last_b] = 1
    group_a, group_b = (np.cumsum(e) - e for e in ends)
    listed = np.empty(len(a) + len(b), np.int64)
    listed[np.arange(len(a)) + np.append(0, last_b + 1)[group_a]] = a + pair.n_a * ends[0]
    listed[np.arange(len(b)) + (last_a + 1)[group_b]] = b + pair.n_b * ends[1] + 2 * pair.n_a
    at = done = 0
    for (of, x), cut in zip(found, np.searchsorted(last_a, np.cumsum([len(x[0]) for _, x in found])).tolist(), strict=True):
        upto = done + len(x[0]) + len(x[1])
        of.add(len(x[0]), len(x[1]), "".join(map(pair.signs.__getitem__, listed[done:upto].tolist()))[:-1], keys[at:cut])
        at, done = cut, upto


def aligned(texts: Iterable[str], pair: Pair) -> Iterator[tuple]:
    """(n_a, n_b, n_groups, digest, distinct links as a * 2^32 + b, how often each occurs) of each whole text."""
    waiting: list[Aligned] = []
    parts: list[tuple[Aligned, str, bool]] = []
    size = 0
    for text in texts:
        waiting.append(Aligned())
        for k, part in enumerate(stretches(text) if text else ()):
            parts.append((waiting[-1], part, k == 0))
            size += len(part)
            if size >= STRETCH:
                _align_parts(parts, pair)
                parts, size = [], 0
                yield from (w.row() for w in waiting[:-1])
                del waiting[:-1]
    _align_parts(parts, pair)
    yield from (w.row() for w in waiting)


_ROW = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
_ROW_DDL = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(r[5]) for r in rows)]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(r[k] for r in rows)]))) for k in (5, 6)]
    return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_ROW[:5])), *lists], names=[n for n, _ in _ROW])


def documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, pairs, times): each text's alignment with its distinct links."""

    def run(batches):
        pair = _pair(path_a, path_b)
        for batch in batches:
            rows, held = [], 0
            for doc, found in zip(batch.column(0).to_pylist(), aligned((t.as_py() for t in batch.column(1)), pair), strict=True):
                rows.append((doc, *found))
                held += len(found[4])
                if held >= 1 << 18:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, _ROW_DDL)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, links, best): how many links hold each pair of ids, and whether no other pair of its B id has more."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("links"))
    highest = counts.groupBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")).agg(F.max("links").alias("highest"))
    joined = counts.join(highest, F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)) == F.col("b"))
    return joined.select("pair", "links", (F.col("links") == F.col("highest")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    spark = docs.sparkSession
    rows = written(documents(docs, path_a, path_b), "aligned")
    table = written(pair_counts(rows), "pairs")
    if table.count() > most_pairs(_pair(path_a, path_b)):
        raise AssertionError("more pairs than two vocabularies can link")
    found = table.orderBy("pair").toArrow()  # bounded by the vocabularies
    shared = spark.sparkContext.broadcast(tuple(found.column(k).to_numpy() for k in range(3)))

    def run(batches):
        keys, links, best = shared.value
        for batch in batches:
            pairs, times = batch.column(5), batch.column(6).flatten().to_numpy()
            at = np.searchsorted(keys, pairs.flatten().to_numpy())
            ends = np.cumsum(np.asarray(pairs.value_lengths()))
            sums = [np.diff(np.append(0, np.cumsum(x))[ends], prepend=0) if len(x) else np.zeros(len(ends), np.int64) for x in (times, times * best[at], times * links[at])] if len(keys) else [np.zeros(len(ends), np.int64)] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *(pa.array(x, pa.int64()) for x in sums), batch.column(4)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
