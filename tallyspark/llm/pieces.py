"""SentencePiece BPE: encoding by vectorised merge rounds in numpy, and decoding.

A text is a row of words: no piece of the vocabulary has a blank behind another character, so merges never leave a word. All new
words of a batch are laid into one flat array of symbols. In each round every word merges its best pair (the highest score, which is
the smallest rank) at the leftmost places at once: up to and including the first place where the merge makes a pair that ranks no
worse, as that one comes next. Words without a pair left are taken out, and the array is compacted, until no pair remains. Where no
piece can hold what stands on both sides of a boundary, a word is two. A worker remembers the ids of its words from task to task.

Runs of blanks: if their pieces have one score, lower than all others, they are filled from the left after all else; they are
counted, not merged.

Defined results. Null text: as the empty one, the end id alone. Very long texts: encoded whole, in stretches that end at words; a
word of any length is merged whole. Rows with equal ids and repeated rows: each by its own text. Empty table: no rows. Null
doc_id: encoded, with a null id. Extra columns, whatever their names: left out. A character that the vocabulary lacks becomes its
bytes.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_of

#: What stands for a blank in pieces (fixed value).
BLANK = "▁"
#: Words whose ids a worker remembers, and the longest of them.
REMEMBERED = 500_000
LONGEST = 64
#: Characters of a stretch: texts are encoded in stretches of about so many, several texts together up to as many.
STRETCH = 1 << 20
#: In front of a word that has no blank in front.
_BARE = "\x01"
_NONE = np.iinfo(np.int64).max


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    """One replacement character for each byte that belongs to no character."""
    return "�", error.start + 1


codecs.register_error("tally-each-byte", _each_byte)


def stretches(text: str, most: int = STRETCH) -> Iterator[str]:
    """The text in pieces of about `most` characters; each but the first begins with a blank behind another character."""
    at = 0
    while len(text) - at > most:
        cut = re.compile("(?<=[^ ▁]) ").search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _filled(n: int, lengths: set[int]) -> list[int]:
    """A run of n blanks, merged from the left by pieces of these lengths."""
    blocks = [1] * n
    while (k := next((k for k in range(len(blocks) - 1) if blocks[k] + blocks[k + 1] in lengths), None)) is not None:
        blocks[k : k + 2] = [blocks[k] + blocks[k + 1]]
    return blocks


class _Sorted:
    """From pairs of small numbers to numbers, by binary search."""

    def __init__(self, found: dict[tuple[int, int], int], base: int):
        self.base = base
        keys = np.fromiter((a * base + b for a, b in found), np.int64, len(found))
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], _NONE), np.append(np.fromiter(found.values(), np.int64, len(found))[order], -1)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The value of each pair, -1 for pairs without one."""
        key = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], -1)


class Merger:
    """The vocabulary's pairs, and the merge rounds over a flat array of symbols."""

    def __init__(self, pieces: dict[str, float]):
        """pieces: those that texts may hold, with their scores."""
        names = list(dict.fromkeys([*pieces, *(c for p in pieces for c in p)]))
        self.symbol = {p: n for n, p in enumerate(names)}
        n = self.unknown = len(names)
        best = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.rank = np.array([best[pieces[p]] if p in pieces else 0 for p in names] + [0], np.int64)
        pairs: dict[tuple[int, int], int] = {}
        grams: dict[str, int] = {}
        ends = [(grams.setdefault(p[-2:], len(grams)), grams.setdefault(p[:2], len(grams))) for p in names]
        alive: dict[tuple[int, int], int] = {}
        for p in pieces:
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a, b] = self.symbol[p]
                for tail in {p[k - 1 : k], p[max(k - 2, 0) : k]}:
                    for head in {p[k : k + 1], p[k : k + 2]}:
                        if tail in grams and head in grams:
                            alive[grams[tail], grams[head]] = 1
        self.pairs, self.alive = _Sorted(pairs, n + 1), _Sorted(alive, len(grams) + 1)
        self.tail = np.array([t for t, _ in ends] + [len(grams)], np.int64)
        self.head = np.array([h for _, h in ends] + [len(grams)], np.int64)
        self.of_character = np.full(0x110000, n, np.int32)
        for p in names:
            if len(p) == 1:
                self.of_character[ord(p)] = self.symbol[p]

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' symbols in one array, -1 where a character has been merged into the symbol before it; and the words' starts."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        starts = np.cumsum(lengths) - lengths
        first = np.zeros(len(points), bool)
        first[starts[lengths > 0]] = True
        out = self.of_character[points].astype(np.int64)
        self._rounds(out, first)
        return out, starts

    def _rounds(self, out: np.ndarray, first: np.ndarray) -> None:
        sym, place = out.copy(), np.arange(len(out))
        made = np.full(len(sym), -1, np.int64)  # what symbol and its successor make
        self._pair(sym, first, made, np.arange(len(sym)))
        while len(sym):
            rank = np.where(made >= 0, self.rank[made], _NONE)
            starts = np.flatnonzero(first)
            lengths = np.diff(starts, append=len(sym))
            low = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            at = np.flatnonzero((rank == low) & (low < _NONE))
            if not len(at):
                return
            # of places that overlap every other one, from the left
            begins = np.diff(at, prepend=-2) != 1
            number = np.arange(len(at))
            at = at[(number - np.maximum.accumulate(np.where(begins, number, 0))) % 2 == 0]
            new, worst = made[at], low[at]
            # a merge whose new pair ranks no worse is a word's last of this round
            before = np.maximum(at - 1, 0)
            left = np.where(first[at], self.unknown, sym[before])
            touching = np.flatnonzero((np.diff(at, prepend=-9) == 2) & ~first[at])
            left[touching] = new[touching - 1]
            after = np.minimum(at + 2, len(sym) - 1)
            right = np.where((at + 2 < len(sym)) & ~first[after], sym[after], self.unknown)
            ends = np.zeros(len(at), bool)
            for pair in (self.pairs(left, new), self.pairs(new, right)):
                ends |= (pair >= 0) & (self.rank[pair] <= worst)
            if ends.any():
                seen = np.cumsum(ends) - ends
                word = np.cumsum(first)[at]
                opens = np.diff(word, prepend=-1) != 0
                kept = seen == np.maximum.accumulate(np.where(opens, seen, 0))
                at, new = at[kept], new[kept]
            sym[at] = new
            out[place[at]], out[place[at + 1]] = new, -1
            stays = low < _NONE
            stays[at + 1] = False
            now = (np.cumsum(stays) - 1)[at]
            sym, place, first, made = sym[stays], place[stays], first[stays], made[stays]
            changed = np.concatenate([now, now[~first[now]] - 1])
            self._pair(sym, first, made, changed)

    def _pair(self, sym: np.ndarray, first: np.ndarray, made: np.ndarray, at: np.ndarray) -> None:
        """What each of these symbols makes with its successor; words part where nothing can ever stand across."""
        after = np.minimum(at + 1, len(sym) - 1)
        inside = (at + 1 < len(sym)) & ~first[after]
        made[at] = -1
        at, after = at[inside], after[inside]
        made[at] = found = self.pairs(sym[at], sym[after])
        at, after = at[found < 0], after[found < 0]
        first[after[self.alive(self.tail[sym[at]], self.head[sym[after]]) < 0]] = True


class Encoder:
    """A model's words to ids, and ids to texts."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        names = [model.id_to_piece(n) for n in ids]
        if any(map(model.is_unused, ids)) or model.normalize("  aﬁ\t ") != f"{BLANK * 3}aﬁ\t{BLANK}" or any(BLANK in p.lstrip(BLANK) for p in names):
            raise ValueError("a model of another kind: its pieces cross words, or it changes texts before it encodes them")
        pieces = {p: model.get_score(n) for n, p in enumerate(names) if not (model.is_control(n) or model.is_unknown(n) or model.is_byte(n))}
        of_byte = {int(p[3:5], 16): n for n, p in enumerate(names) if model.is_byte(n)}
        if len(of_byte) != 256:
            raise ValueError("a model without pieces for bytes")
        self.end = model.eos_id()
        self.merger = Merger(pieces)
        self.ids = np.full(self.merger.unknown + 1, -1, np.int64)  # of symbols
        for n, p in enumerate(names):
            if p in pieces:
                self.ids[self.merger.symbol[p]] = n
        self.of_byte = of_byte
        #: The bytes of each id; control pieces have none.
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(n) else p.replace(BLANK, " ").encode() if p in pieces else b"" for n, p in enumerate(names)]
        self.bytes[model.unk_id()] = " ⁇ ".encode()
        self.control = [n for n in ids if model.is_control(n)]
        self.blank_first = {n for n, p in enumerate(names) if p in pieces and p[:1] == BLANK}
        # a run's ids by its length, if runs are filled from the left after all else
        runs = {len(p): n for n, p in enumerate(names) if p and not p.strip(BLANK)}
        scores, full = {pieces[BLANK * k] for k in runs if k > 1}, max(runs, default=1)
        mixed = any(p.startswith(BLANK * 2) for p in pieces if p.strip(BLANK))
        last = 1 in runs and len(scores) == 1 and not mixed and max(scores) < min(s for p, s in pieces.items() if p.strip(BLANK) and len(p) > 1)
        # the first `full` blanks become one piece without the help of others: so all further ones start anew
        self.full = full if last and _filled(full, set(runs)) == [full] else 0
        self.runs = [[runs[k] for k in _filled(rest, set(runs))] for rest in range(full + 1)] if self.full else []
        # a line end that no longer piece holds is a word of its own
        self.lone = not any("\n" in p and len(p) > 1 for p in pieces)
        self._word = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+" if self.lone else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.known: dict[str, bytes] = {_BARE: b""}

    def words(self, text: str) -> list[str]:
        """The words of a text that begins with a blank, or is empty.

        A word is written without its one blank in front; words without a blank begin with the sign _BARE, those with more than one
        (or with that sign in them) stand with their blanks.
        """
        if "  " not in text and BLANK not in text and _BARE not in text:
            if self.lone and "\n" in text:
                text = text.replace("\n", f" {_BARE}\n {_BARE}")
            return text.split(" ")[1:]
        found = self._word.findall(text.replace(" ", BLANK))
        return [_BARE + w if w[0] != BLANK else w if w[1:2] in (BLANK, _BARE) else w[1:] for w in found]

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        spelt = [w[1:] if w[:1] == _BARE else w if w[:1] == BLANK else BLANK + w for w in words]
        blanks = [len(w) - len(w.lstrip(BLANK)) if w[1:2] == BLANK and self.full else 0 for w in spelt]
        merging = [w[k - 1 :] if k else w for w, k in zip(spelt, blanks, strict=True)]
        merged, starts = self.merger.symbols(merging)
        whole = np.flatnonzero(merged >= 0)
        ids = self.ids[merged[whole]]
        cuts = np.searchsorted(whole, np.append(starts, len(merged))).tolist()
        packed, lacks = ids.astype("<u4").tobytes(), ids < 0
        lacking = np.append(np.cumsum(lacks) - lacks, lacks.sum()).tolist()
        for n, w in enumerate(words):
            a, b = cuts[n], cuts[n + 1]
            found = packed[4 * a : 4 * b]
            if lacking[a] != lacking[b]:  # characters as bytes
                each = zip(ids[a:b].tolist(), (whole[a:b] - starts[n]).tolist(), strict=True)
                found = np.array([x for k, place in each for x in ([k] if k >= 0 else [self.of_byte[x] for x in merging[n][place].encode()])], "<u4").tobytes()
            if blanks[n]:  # the last blank is the run's unless it has been merged with what follows
                alone = int.from_bytes(found[:4], "little") == self.runs[1][0]
                fill, rest = divmod(blanks[n] - (not alone), self.full)
                found = np.array(self.runs[self.full] * fill + self.runs[rest], "<u4").tobytes() + found[4 * alone :]
            self.known[w] = found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts (little-endian, 32 bits), without an end id. For texts of a stretch together, not more."""
        return self.encode_spaced([(" " + t if t else t) for t in texts])

    def encode_spaced(self, texts: list[str]) -> list[bytes]:
        """The same for texts, or stretches of texts, that have the blank in front already."""
        rows = list(map(self.words, texts))
        words = set().union(*rows)
        new = words - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {_BARE: b""}
            new = words - self.known.keys()
        self._learn(list(new))
        out = [b"".join(map(self.known.__getitem__, row)) for row in rows]
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
        return out

    def encode_long(self, text: str) -> Iterator[bytes]:
        """The ids of one text of any length, stretch by stretch."""
        for n, part in enumerate(stretches(text)):
            yield (self.encode if n == 0 else self.encode_spaced)([part])[0]

    def decode(self, ids: Iterable[bytes]) -> Iterator[str]:
        """The text of ids that come in parts, each of whole 32-bit numbers. The first piece's blank goes, as it was put there."""
        begun, kept = False, b""
        for part in ids:
            numbers = np.frombuffer(part, "<u4")
            for piece in np.split(numbers, np.flatnonzero(np.isin(numbers, self.control))):
                numbers = piece.tolist()
                if numbers and numbers[0] in self.control:  # parts the bytes on its sides
                    yield kept.decode("utf-8", "tally-each-byte")
                    kept = b""
                raw = b"".join(map(self.bytes.__getitem__, numbers))
                if raw and not begun:
                    begun, first = True, next(n for n in numbers if self.bytes[n])
                    raw = raw[1:] if first in self.blank_first else raw
                raw = kept + raw
                cut = len(raw)  # a character that the part's end cuts waits for its other bytes
                for back in range(1, min(4, cut) + 1):
                    if raw[-back] & 0xC0 != 0x80:
                        cut -= back if raw[-back] >= 0xC0 and back < 2 + (raw[-back] >= 0xE0) + (raw[-back] >= 0xF0) else 0
                        break
                kept = raw[cut:]
                yield raw[:cut].decode("utf-8", "tally-each-byte")
        yield kept.decode("utf-8", "tally-each-byte")


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """A worker's encoder: it remembers words from one task to the next."""
    return Encoder(path)


def encoded(texts: Iterable[str], model: Encoder) -> Iterator[list[bytes]]:
    """For each text its ids in parts. Short texts are encoded together."""
    held, size = [], 0
    for text in texts:
        if len(text) > STRETCH:
            yield from ([x] for x in model.encode(held))
            held, size = [], 0
            yield list(model.encode_long(text))
            continue
        held.append(text)
        size += len(text)
        if size >= STRETCH:
            yield from ([x] for x in model.encode(held))
            held, size = [], 0
    yield from ([x] for x in model.encode(held))


def _numbers(parts: Iterable[bytes], most: int = 1 << 18) -> Iterator[list[int]]:
    for part in parts:
        for at in range(0, len(part), 4 * most):
            yield np.frombuffer(part[at : at + 4 * most], "<u4").tolist()


def _digests(parts: list[bytes], model: Encoder) -> tuple[int, str, str]:
    ids, text, n = hashlib.sha256(), hashlib.sha256(), 0
    for numbers in _numbers(parts):
        ids.update((" " * (n > 0) + " ".join(map(str, numbers))).encode())
        n += len(numbers)
    for part in model.decode(parts):
        text.update(part.encode())
    return n, ids.hexdigest(), text.hexdigest()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every document: little-endian 32-bit ids with the end id. path: the model's file, alike on every machine."""

    def run(batches):
        model = encoder(path)
        end = np.array([model.end], "<u4").tobytes()
        for batch in batches:
            for doc, parts in zip(batch.column(0), encoded((t.as_py() for t in batch.column(1)), model), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), pa.array([b"".join([*parts, end])], pa.binary())], names=["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids) as encode gives them."""

    def run(batches):
        model = encoder(path)
        for batch in batches:
            texts = ["".join(model.decode([ids.as_py() or b""])) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(rows["doc_id"].cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids with the end id, and of the text decoded from them."""

    def run(batches):
        model = encoder(path)
        end = np.array([model.end], "<u4").tobytes()
        for batch in batches:
            rows = [_digests([*parts, end], model) for parts in encoded((t.as_py() for t in batch.column(1)), model)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
