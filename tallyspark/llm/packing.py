"""Harmonic packing of token sequences into bins of fixed capacity.

A document of n tokens is cut into whole bins and a remainder; the remainder is cut into pieces whose lengths are
reciprocals of the capacity: floor(capacity / j) for j = 2, 3, ... (the longest that fits, and again with what is left). A
rest below SHORT tokens stays whole, as a piece of the class j = floor(capacity / rest). A bin of class j holds
exactly j pieces of one length, so each worker fills the bins of each class on its own, in a stream, holding one open bin for
each class. What it still holds at its end goes to a pool: at most one bin's tokens for each class and worker. The pool, laid out
as one stream, is cut at multiples of the capacity, and its tail at powers of two, which need no padding.

Defined results. Null text: empty, hence the one end token. Equal ids or repeated rows: each row is packed on its own.
Very long texts are cut like all others. Empty table: no pieces. Null doc_id: packed, with a null id.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

CAPACITY = 2048
END = 1
#: A rest of fewer tokens than this is not cut further.
SHORT = 32
#: Words whose ids a worker remembers.
REMEMBERED = 250_000
_POOL = 1 << 62
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, pool_part int, pool_at long"
_TYPES = [pa.int64()] * 7 + [pa.binary(), pa.int32(), pa.int64()]
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "pool_part", "pool_at"]


#: Marks behind a Latin letter and before a blank: a token boundary stands in front of them.
_MARKS = re.compile(r"(?<=[a-z\u00df-\u00f6\u00f8-\u00ff])([.,;:!?%$&*#]+)(?=[ \n]|$)")


def _merging(path: str):
    """Bytes of the ids of one run of composed lower-case letters, by the vocabulary's own merges; None if it isn't of that kind.

    A word's end is part of its last symbol. Here it is a byte that UTF-8 never has, which joins the last byte before all else.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("continuing_subword_prefix"):
        return None
    # the usual printable stand-ins of bytes: printable ones stand for themselves, the others follow from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = model["vocab"]
    raw = lambda t: bytes(byte[c] for c in t.removesuffix("</w>")) + (_END if t.endswith("</w>") else b"")
    order = [c for c in byte if c in vocab] + [c + "</w>" for c in byte if c + "</w>" in vocab]
    order += ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
    ids = {byte[c]: vocab[c] for c in byte if c in vocab}
    for token in order[len(ids) :]:
        if raw(token) not in ranks:
            ids[len(ranks)] = vocab[token]
            ranks[raw(token)] = len(ranks)
    engine = tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    as_bytes = [ids.get(n, 0).to_bytes(4, "little") for n in range(len(ranks))]
    return lambda word: b"".join([as_bytes[n] for n in engine.encode_single_piece(word.encode() + _END)])


_END = b"\xff"


class Encoder(dict):
    """Word to the bytes of its ids (little-endian, 32 bits). Words are what plain blanks and line ends separate.

    The vocabulary lower-cases, drops white space, never joins across it, and keeps letters and marks apart. So the ids of a text
    are those of its words, cut off from marks behind them, in a row. New words of letters go through the vocabulary's merges
    directly. All else, and texts for which lower-casing first might matter (not in composed form, special tokens, the Greek
    final sigma), is encoded by the tokenizer as it stands.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _merging(path)

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(word) > 64:
            return self._encode(word)
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = self.letters(word) if self.letters and word.isalpha() else self._encode(word)
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        get, out = self.__getitem__, []
        for text in texts:
            low = text.lower()
            plain = "<|" not in text and "\u03a3" not in text and is_normalized("NFC", text) and is_normalized("NFC", low)
            out.append(b"".join(map(get, _MARKS.sub(r" \1", low).replace("\n", " ").split(" "))) if plain else self._encode(text))
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """A worker's encoder: it remembers words from one task to the next."""
    return Encoder(path)


def lengths(tokens: int, capacity: int = CAPACITY, short: int = SHORT) -> list[int]:
    """The lengths of the pieces of a document."""
    whole, rest = divmod(tokens, capacity)
    out = [capacity] * whole
    while rest:
        piece = rest if rest < short else capacity // -(-capacity // rest)
        out.append(piece)
        rest -= piece
    return out


def tail_cuts(total: int, capacity: int = CAPACITY) -> list[int]:
    """Where the last, incomplete bin of a stream is cut: into powers of two, longest first. Positions from the stream's start."""
    at, rest, out = total - total % capacity, total % capacity, []
    while rest:
        out.append(at)
        at += 1 << (rest.bit_length() - 1)
        rest -= 1 << (rest.bit_length() - 1)
    return out


def documents(batches, encode, most: int = 256, chars: int = 1 << 20):
    """(doc_id, ids) of each row; texts are encoded some at a time, up to so many characters (one text at least)."""
    docs, texts, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            docs.append(doc)
            texts.append(text)
            held += len(text)
            if len(docs) >= most or held >= chars:
                yield from zip(docs, encode(texts), strict=True)
                docs, texts, held = [], [], 0
    yield from zip(docs, encode(texts), strict=True)


def _pack(path: str, capacity: int, keep_ids: bool):
    def run(batches):
        encode, part = _encoder(path).ids, TaskContext.get().partitionId()
        open_bins, bins, pool_at = defaultdict(list), 0, 0
        end = np.array([END], dtype="<u4").tobytes()
        out = [[] for _ in _NAMES]

        def put(piece, sequence, offset, pool=None):
            doc, start, n, total, ids = piece
            for column, x in zip(out, (doc, start, n, zlib.crc32(ids), total, sequence, offset, ids if keep_ids or pool is not None else None, None if pool is None else part, pool), strict=True):
                column.append(x)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _TYPES, strict=True)], names=_NAMES)
            for column in out:
                column.clear()
            return batch

        for doc, ids in documents(batches, encode):
            ids += end
            total, start = len(ids) // 4, 0
            for n in lengths(total, capacity):
                held = open_bins[n]
                held.append((doc, start, n, total, ids[4 * start : 4 * (start + n)]))
                start += n
                if len(held) == capacity // n:
                    for k, piece in enumerate(held):
                        put(piece, (part << 36) + bins, k * n)
                    bins += 1
                    held.clear()
            if len(out[0]) >= 4096:
                yield flush()
        for held in open_bins.values():
            for piece in held:
                put(piece, None, None, pool_at)
                pool_at += piece[2]
        yield flush()

    return run


def _cut_pool(capacity: int, total: int, keep_ids: bool):
    """Pieces at their places in the pool's stream, cut where a bin ends."""
    tail = tail_cuts(total, capacity)
    last = total - total % capacity

    def run(batches):
        for batch in batches:
            out = [[] for _ in _NAMES[:8]]
            for doc, start, n, doc_tokens, ids, at in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                done = 0
                while done < n:
                    here = at + done
                    if here < last:
                        first, upto, number = here - here % capacity, here - here % capacity + capacity, here // capacity
                    else:
                        k = bisect_right(tail, here) - 1
                        first, upto, number = tail[k], tail[k + 1] if k + 1 < len(tail) else total, last // capacity + k
                    take = min(n - done, upto - here)
                    part = ids[4 * done : 4 * (done + take)]
                    for column, x in zip(out, (doc, start + done, take, zlib.crc32(part), doc_tokens, _POOL + number, here - first, part if keep_ids else None), strict=True):
                        column.append(x)
                    done += take
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _TYPES, strict=False)], names=_NAMES[:8])

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    ids (little-endian 32-bit) are only filled if keep_ids. path: the tokenizer's file, found alike on every machine.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    first = written(rows.mapInArrow(_pack(path, capacity, keep_ids), _SCHEMA), "packed")
    pool = first.where("pool_part is not null")
    # one row a worker: where its part of the pool begins
    parts = written(pool.groupBy("pool_part").agg(F.sum("length").alias("tokens")), "pool")
    ahead = F.sum("tokens").over(Window.orderBy("pool_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = parts.select("pool_part", F.coalesce(ahead, F.lit(0)).alias("begin"))
    total = parts.agg(F.sum("tokens")).first()[0] or 0
    placed = pool.join(begins, "pool_part").select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("begin") + F.col("pool_at")).alias("at"))
    rest = placed.mapInArrow(_cut_pool(capacity, total, keep_ids), ", ".join(_SCHEMA.split(", ")[:8]))
    return first.where("pool_part is null").select(*_NAMES[:8]).unionByName(rest)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, doc_ids): packed sequences, unpadded, from pieces that hold their ids."""
    joined = F.expr("aggregate(transform(p, x -> x.ids), cast('' as binary), (a, x) -> concat(a, x))")
    grouped = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    return grouped.select("sequence_id", "length", joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"))
