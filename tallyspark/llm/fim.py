"""Fill-in-middle transformation: texts cut into prefix, middle and suffix by an event scan.

One Aho-Corasick automaton runs over a text and finds its events: the ASCII characters that change the class of what follows, and the
sentinels. What lies between two events (a gap) holds a number of units that follows from its length alone. So a short table of events,
with the units before each, stands for the whole text: the place of unit k is found by binary search in it and arithmetic within a gap.

Kinds of units, with their class-changing characters and the units of a gap of g characters:

| kind | events | an event | a gap of g characters |
|-|-|-|-|
| code_points | line ends | one unit | g units |
| words | white space | with the gap before it one unit | none by itself; at the text's end one, if not empty |
| lines | line ends | with the gap before it one unit | none by itself; at the text's end one, if not empty |

Units cover a text without a rest: their joined texts are the text. Sentinels (the marks of the output) are events of all kinds; they
tell which texts stay plain, and where an output is taken apart again: the same scan restores texts.

The draws are digits of the SHA-256 of a seed and the document's id, so they don't depend on partitions or on a task that is run again.

Defined results. Null and empty texts: plain, empty output. Texts with a sentinel in them: plain. Null doc_id: drawn as an empty id.
Very long texts: whole. Rows with equal ids: cut alike by their own numbers of units. Repeated rows: each is kept. Empty table: no
rows. Extra columns, whatever their names: left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_of

#: Sentinels of the output (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_LINE_ENDS, _SPACE = "\n", " \t\n\r\x0b\x0c"
#: Class-changing characters of a kind, and whether each character of a gap is a unit (or else what an event ends is one).
KINDS = {"code_points": (_LINE_ENDS, True), "words": (_SPACE, False), "lines": (_LINE_ENDS, False)}
#: Of a hundred texts so many are transformed, and of a hundred of these so many have their suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20


class Events:
    """The events of one text: where each begins, what is found, and the units before it."""

    def __init__(self, places: list[int], ends: list[int], units: list[int], sentinels: list[tuple[int, str]], length: int, total: int, each: bool):
        self.places, self.ends, self.units, self.sentinels, self.length, self.total, self.each = places, ends, units, sentinels, length, total, each

    def place(self, unit: int) -> int:
        """Where the unit of this number (from 0) begins; the text's end for the number of all units."""
        if unit >= self.total:
            return self.length
        k = bisect_right(self.units, unit) - 1  # the last event with no more units before it
        if k < 0:
            return unit if self.each else 0
        if not self.each:  # units end with events: this one begins where the last of the units before it ends
            return self.ends[k - 1] if self.units[k] == unit and k else 0 if self.units[k] == unit else self.ends[k]
        return self.places[k] + unit - self.units[k]

    def rank(self, place: int) -> int:
        """Events that are class-changing characters before a place."""
        return bisect_right(self.places, place - 1)


class Scanner:
    def __init__(self, kind: str = "code_points"):
        import ahocorasick

        self.changing, self.each = KINDS[kind]
        self.automaton = ahocorasick.Automaton()
        for mark in (PREFIX, SUFFIX, MIDDLE):
            self.automaton.add_word(mark, mark)
        for c in self.changing:
            self.automaton.add_word(c, c)
        self.automaton.make_automaton()

    def events(self, text: str) -> Events:
        places, ends, units, sentinels, done, total = [], [], [], [], 0, 0
        for last, found in self.automaton.iter(text):
            if len(found) > 1:
                sentinels.append((last - 2, found))
                continue
            gap = last - done
            if self.each:
                total += gap
            places.append(last)
            units.append(total)
            total, done = total + 1, last + 1
            ends.append(done)
        rest = len(text) - done
        total += rest if self.each else rest > 0
        return Events(places, ends, units, sentinels, len(text), total, self.each)


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """Four numbers of 32 bits for a document."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]


def transform(doc_id: int | None, text: str, scanner: Scanner, seed: int = 1) -> dict:
    """One document's form, units, cuts and output."""
    found = scanner.events(text)
    n, (h1, h2, h3, h4) = found.total, draws(doc_id, seed)
    out = {"n": n, "form": "plain", "prefix_units": None, "middle_units": None, "middle_line": None, "suffix_line": None, "output": text}
    if text and not found.sentinels and h3 % 100 < TRANSFORMED:
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = found.place(first), found.place(second)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        spm = h4 % 100 < SUFFIX_FIRST
        output = [SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle] if spm else [PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle]
        out |= {"form": "spm" if spm else "psm", "prefix_units": first, "middle_units": second - first, "output": "".join(output)}
        if scanner.changing == _LINE_ENDS:  # lines, from 1, on which middle and suffix begin
            out |= {"middle_line": 1 + found.rank(a), "suffix_line": 1 + found.rank(b)}
    return out


def restore(output: str, form: str, scanner: Scanner) -> str:
    """The text that an output was made of. Sentinels of a text can't be taken for marks: such texts are plain."""
    if form == "plain":
        return output
    marks = scanner.events(output).sentinels
    if [m for _, m in marks] != ([SUFFIX, PREFIX, MIDDLE] if form == "spm" else [PREFIX, SUFFIX, MIDDLE]) or marks[0][0]:
        raise ValueError(f"not an output of the form {form}")
    first, second, middle = (output[at + 3 : upto] for (at, _), upto in zip(marks, [marks[1][0], marks[2][0], len(output)], strict=True))
    return second + middle + first if form == "spm" else first + middle + second


_FIELDS = [("n", pa.int64()), ("form", pa.string()), ("prefix_units", pa.int64()), ("middle_units", pa.int64()), ("middle_line", pa.int64()), ("suffix_line", pa.int64()), ("output", pa.string())]
_DDL = "doc_id long, n long, form string, prefix_units long, middle_units long, middle_line long, suffix_line long, output string"
#: Characters of outputs that a task holds at a time, one text at least.
_HELD = 1 << 22


def fill_in_middle(docs: DataFrame, kind: str = "code_points", seed: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, middle_line, suffix_line, output) of every document."""

    def run(batches):
        scanner = Scanner(kind)
        for batch in batches:
            ids, rows, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                rows.append(transform(doc, text.as_py(), scanner, seed))
                size += len(rows[-1]["output"])
                if size >= _HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r[c] for r in rows], t) for c, t in _FIELDS)], names=["doc_id", *(c for c, _ in _FIELDS)])
                    ids, rows, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r[c] for r in rows], t) for c, t in _FIELDS)], names=["doc_id", *(c for c, _ in _FIELDS)])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, _DDL)


def restored(rows: DataFrame, kind: str = "code_points") -> DataFrame:
    """The rows (form, output and others) with one column more, `restored`: the text rebuilt from form and output alone."""

    def run(batches):
        scanner = Scanner(kind)
        for batch in batches:
            form, output = batch.schema.get_field_index("form"), batch.schema.get_field_index("output")
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                texts = [restore(o.as_py(), f.as_py(), scanner) for o, f in zip(part.column(output), part.column(form), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "restored"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "restored string"]))
