"""License scans: exact phrases, and fuzzy search for short notices.

A notice that may be written with up to E errors is split into E + 1 pieces; by the pigeonhole principle at least one of
them stands unchanged in every such place. The pieces of all notices are sought at once (Aho-Corasick); around each hit
the regex library's bounded-error matching verifies the notice and tells its span and its number of edits.

Texts are lower-cased (A to Z), cut into words and joined by single blanks; spans are given in words, from 0.

Defined results. Null text: as the empty one. No finding: empty labels, null places, score 0. Very long texts are searched
whole. Rows with equal ids: each by its own text. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_of

#: Exact phrases and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices and their labels (fixed values, opening phrases of public licenses).
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2.0",
    "under the terms of the gnu general public license": "gpl-notice",
    "under the terms of the gnu lesser general public license": "lgpl-notice",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under a creative commons attribution": "cc-by-notice",
    "distributed under the boost software license": "boost",
    "made available under the terms of the eclipse public license": "epl",
    "released under the mit license": "mit-notice",
    "all rights are reserved by the author": "reserved-notice",
}
#: One error is allowed for so many characters of a notice, MOST at most.
PER_ERROR = 12
MOST = 4
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass"))


def errors_allowed(notice: str) -> int:
    return min(MOST, len(notice) // PER_ERROR)


def seeds(notice: str) -> list[tuple[str, int]]:
    """The pieces of a notice, one more than errors are allowed, with their places in it."""
    n = errors_allowed(notice) + 1
    cuts = [len(notice) * k // n for k in range(n + 1)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, notices: dict[str, str] | None = None, base: dict[str, str] | None = None):
        import ahocorasick
        import regex

        self.notices, self.base = NOTICES if notices is None else notices, BASE if base is None else base
        places: dict[str, list] = {}
        for notice in self.notices:
            for seed, at in seeds(notice):
                places.setdefault(seed, []).append((notice, at))
        self.automaton = ahocorasick.Automaton()
        for seed, found in places.items():
            self.automaton.add_word(seed, (len(seed), found))
        if places:
            self.automaton.make_automaton()
        self.fuzzy = {n: regex.compile(f"(?e)(?:{regex.escape(n)}){{e<={errors_allowed(n)}}}") for n in self.notices}

    def exact(self, joined: str) -> Iterator[tuple[int, str]]:
        """(first word, label) of every place of a base phrase. joined: the words, with a blank around each."""
        for phrase, label in self.base.items():
            at, word, seen = joined.find(f" {phrase} "), 0, 0
            while at >= 0:
                word, seen = word + joined.count(" ", seen, at), at
                yield word, label
                at = joined.find(f" {phrase} ", at + 1)

    def near(self, joined: str) -> Iterator[tuple[int, int, str, int, int]]:
        """(first character, last + 1, label, edits, allowed) of every notice found, longest spans of one place only."""
        if not len(self.automaton):
            return
        tried: dict[str, int] = {}
        for end, (length, found) in self.automaton.iter(joined):
            for notice, at in found:
                slack = errors_allowed(notice)
                done = tried.get(notice, 0)
                if end < done:
                    continue  # lies in a span found already
                begin = max(done, end + 1 - length - at - slack)
                hit = self.fuzzy[notice].search(joined, begin, min(len(joined), begin + len(notice) + 2 * slack))
                if hit:
                    tried[notice] = hit.end()
                    yield hit.start(), hit.end(), self.notices[notice], sum(hit.fuzzy_counts), slack

    def scan(self, text: str | None) -> dict:
        found = words(text)
        joined = f" {' '.join(found)} "
        base = sorted(self.exact(joined))
        spans, counted, seen = [], 0, 0
        for a, b, label, edits, slack in sorted(self.near(joined)):
            # the word that the first non-blank character belongs to
            a += joined[a] == " "
            counted, seen = counted + joined.count(" ", seen, a), a
            spans.append({"first": counted - 1, "last": counted - 1 + joined.count(" ", a, b - (joined[b - 1] == " ")), "label": label, "edits": edits, "likeness": 1 - edits / (2 * (slack + 1))})
        labels = {label for _, label in base}
        return {
            "n_words": len(found), "n_base": len(base), "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None,
            "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {s["label"] for s in spans})),
            "score": 1.0 if base else max((s["likeness"] for s in spans), default=0.0), "spans": spans,
        }


_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("edits", pa.int64()), ("likeness", pa.float64())]))


def scan(docs: DataFrame, notices: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every document."""

    def run(batches):
        scanner = Scanner(notices, base)
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[name] for r in rows], kind) for name, kind in [*_FIELDS, ("spans", _SPAN)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *[name for name, _ in _FIELDS], "spans"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first: long, last: long, label: string, edits: long, likeness: double>>"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, schema)
