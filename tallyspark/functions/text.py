"""Column expressions over text: folding, keys, order, cleaning."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

#: How strongly a letter's accent counts between equal base letters (fixed values).
ACCENT_RANKS = ("áéíóú", "öü", "őű")


@functools.cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """What case-folding, compatibility decomposition and dropping of combining marks make of single characters.

    Made from the Unicode data: characters and what each becomes (those that vanish last), and those that become several.
    Hangul syllables stay whole.
    """
    one, gone, several = [], [], {}
    for code in range(0x20, 0x20000):
        c = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        folded = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))
        if folded == c:
            continue
        if len(folded) == 1:
            one.append((c, folded))
        elif folded:
            several[c] = folded
        else:
            gone.append(c)
    return "".join(c for c, _ in one) + "".join(gone), "".join(f for _, f in one), several


def fold(x: Column) -> Column:
    """For search: case-folded, decomposed, without combining marks, in any script. Built-in functions only.

    Plain ASCII text is only lower-cased; the characters that become several (as in ﬁ or ß) are replaced where a text has any.
    """
    s = F.replace(x.cast("string"), F.lit("ß"), F.lit("ss"))  # the one of these that is common
    matching, replacing, several = _folding()
    letters, spellings = F.lit("".join(several)), F.split(F.lit("\x01".join(several.values())), "\x01")  # two literals, whatever their length
    spell = lambda c: F.coalesce(F.get(spellings, F.nullif(F.instr(letters, c), F.lit(0)) - 1), c)
    none = F.translate(s, "".join(several), "") == s  # a look-up a character; a class of so many characters would be tried one by one
    spelt = F.when(none, s).otherwise(F.array_join(F.transform(F.split(s, ""), lambda c: F.when(c < "\x80", c).otherwise(spell(c))), ""))
    return F.when(s.rlike(r"[^\x00-\x7F]"), F.translate(spelt, matching, replacing)).otherwise(F.lower(s))


def is_empty(x: Column, kind: str = "string") -> Column:
    """Null, the empty text or the empty list."""
    if kind.startswith("array"):
        return x.isNull() | (F.size(x) == 0)
    return x.isNull() | (x == "") if kind == "string" else x.isNull()


def hu_base(x: Column) -> Column:
    """First part of the Hungarian order: ö/ő follow o and ü/ű follow u as letters of their own."""
    own = F.lower(x)
    for letters, base in (("öő", "o"), ("üű", "u")):
        own = F.regexp_replace(own, f"[{letters}]", base + "￿")
    return fold(own)


def hu_accents(x: Column) -> Column:
    """Second part: the accents' ranks, letter by letter."""
    low = F.lower(x)
    for rank, letters in enumerate(ACCENT_RANKS, 1):
        low = F.regexp_replace(low, f"[{letters}]", str(rank))
    return F.regexp_replace(low, "[^123]", "0")


def normalize(x: Column) -> Column:
    """Lower-case words of ASCII letters and digits, joined by single blanks."""
    return F.trim(F.regexp_replace(fold(F.coalesce(x.cast("string"), F.lit(""))), "[^a-z0-9]+", " "))


def compact(x: Column) -> Column:
    return squeezed(normalize(x))


def squeezed(normalized: Column) -> Column:
    """A normalised text without its blanks."""
    return F.replace(normalized, F.lit(" "), F.lit(""))


def name_key(x: Column) -> Column:
    """A name without reference numbers and single letters; null if nothing is left."""
    words = F.filter(F.split(normalize(x), " "), lambda w: (F.length(w) > 1) & ~w.rlike("[0-9]"))
    return F.nullif(F.array_join(words, " "), F.lit(""))


def number_key(x: Column) -> Column:
    """An invoice number's letters and digits, upper case; null without a digit."""
    key = F.upper(F.regexp_replace(x, "[^0-9A-Za-z]", ""))
    return F.when(key.rlike("[0-9]"), key)


def has_words(text: Column, words: Column) -> Column:
    """Whether normalised words stand in a normalised text as whole words."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), words, F.lit(" "))) & (words != "")


def number_in(number: Column, text: Column, least: int = 4, least_compact: int = 6) -> Column:
    """Whether a document's number stands in a text: as whole words, or, if it is long enough, with no regard to separators."""
    n, bare = normalize(number), compact(number)
    return F.coalesce((F.length(bare) >= least) & (has_words(normalize(text), n) | ((F.length(bare) >= least_compact) & F.contains(compact(text), bare))), F.lit(False))


#: Marks of accents as typesetters write them, and the letters they make (fixed values).
TYPESET = {"\\'a": "á", "\\'e": "é", "\\'i": "í", "\\'o": "ó", "\\'u": "ú", '\\"o': "ö", '\\"u': "ü", "\\H{o}": "ő", "\\H{u}": "ű", '\\"a': "ä", "\\ss": "ß"}
#: Signs that stand where a font lost a letter, and the letters (fixed values).
LOST = {"õ": "ő", "û": "ű", "Õ": "Ő", "Û": "Ű", "\ufffd": ""}


def repaired(x: Column) -> Column:
    """Lost letters, typeset accents and dashes as they should be."""
    for mark, letter in TYPESET.items():
        x = F.replace(x, F.lit(mark), F.lit(letter))
    for sign, letter in LOST.items():
        x = F.replace(x, F.lit(sign), F.lit(letter))
    return normalize_dashes(x)


def name_share(words: Column, others: Column) -> Column:
    """The share of a name's words that another name has."""
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, others)) / F.size(F.array_distinct(words))).otherwise(F.lit(0.0))


def significant_words(x: Column, ignore: list[str]) -> Column:
    return F.array_except(F.split(normalize(x), " "), F.array(*[F.lit(w) for w in ["", *ignore]]))


def shape(x: Column) -> Column:
    """Letters as a, digits as d, all else as it stands."""
    return F.regexp_replace(F.regexp_replace(x, r"\p{L}", "a"), r"[0-9]", "d")


def safe_part(x: Column, limit: int = 80) -> Column:
    """A piece of a file name: no separators, control or reserved characters, single blanks, no dots at the ends."""
    clean = F.regexp_replace(F.regexp_replace(x, r'[\x00-\x1f<>:"/\\|?*]+', " "), r"\s+", " ")
    return F.left(F.regexp_replace(F.trim(clean), r"^[. ]+|[. ]+$", ""), F.lit(limit))


def normalize_dashes(x: Column) -> Column:
    return F.translate(x, "‐‑‒–—―−", "-------")


def undoubled(x: Column) -> Column:
    """A line printed twice over ("TTeexxtt") as printed once: only if it consists of doubled characters."""
    doubled = x.rlike(r"^((.)\2)+$") & (F.length(x) >= 4)
    return F.when(doubled, F.regexp_replace(x, r"(.)\1", "$1")).otherwise(x)


def clean_body(x: Column, marker: str, limit: int = 4000) -> Column:
    """A mail's own text: up to the quoted history, without lines that are only an address, blanks evened, cut at a length."""
    own = F.split(x, marker, 2)[0]
    own = F.regexp_replace(own, r"(?m)^\s*https?://\S+\s*$", "")
    own = F.regexp_replace(F.regexp_replace(own, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.left(F.trim(own), F.lit(limit))


def guarded(x: Column) -> Column:
    """Text that a spreadsheet would read as a formula gets an apostrophe; plain numbers stay."""
    risky = F.ltrim(x).rlike(r"^[=+@\t-]") & ~x.rlike(r"^\s*-?[0-9]+([.,][0-9]+)?\s*$")
    return F.when(risky, F.concat(F.lit("'"), x)).otherwise(x)


@pandas_udf(T.StringType())
def mask_cards(x):
    """Every full card number in a text as its first six and last four digits. Long hexadecimal digests stay."""
    import re

    run = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,}(?![0-9A-Za-z])|(?<![0-9])[0-9](?:[ .-]?[0-9]){14,15}(?![0-9])")

    def luhn(d):
        return sum(v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0

    def one(m):
        d = re.sub("[^0-9]", "", m[0])
        card = len(d) == len(re.sub("[ .-]", "", m[0])) and luhn(d) and ((len(d) == 16 and d[0] in "23456") or (len(d) == 15 and d[:2] in ("34", "37")))
        return f"{d[:6]}{'x' * (len(d) - 10)}{d[-4:]}" if card else m[0]

    return x.map(lambda s: None if s is None else run.sub(one, s))


#: A long hexadecimal digest, or fifteen or sixteen digits with single separators.
_RUN = r"(?<![0-9A-Za-z])[0-9a-f]{32,}(?![0-9A-Za-z])|(?<![0-9])[0-9](?:[ .-]?[0-9]){14,15}(?![0-9])"


def masked(x: Column) -> Column:
    """The same as mask_cards in built-in functions, so that it can stand inside transform()."""

    def card(run: Column) -> Column:
        d = F.regexp_replace(run, "[ .-]", "")
        n = F.length(d)
        # from the right every second digit counts twice, its digits added up
        digit = lambda k: F.substring(d, n - k + 1, F.lit(1)).cast("int")
        points = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, k: a + F.when(k % 2 == 1, digit(k)).otherwise(F.when(digit(k) > 4, 2 * digit(k) - 9).otherwise(2 * digit(k))))
        kind = (n == 16) & d.rlike("^[2-6]") | (n == 15) & d.rlike("^3[47]")
        fits = d.rlike("^[0-9]{15,16}$") & kind & F.when(d.rlike("^[0-9]{15,16}$"), points % 10 == 0).otherwise(False)
        return F.when(fits, F.concat(F.left(d, F.lit(6)), F.repeat(F.lit("x"), n - 10), F.right(d, F.lit(4)))).otherwise(run)

    between, runs = F.split(x, _RUN, -1), F.regexp_extract_all(x, F.lit(_RUN), F.lit(0))
    pieces = F.zip_with(between, F.transform(runs, card), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(x.rlike("[0-9]{2}|[0-9][ .-][0-9]"), F.array_join(pieces, "")).otherwise(x)


@pandas_udf(T.DoubleType())
def likeness(a, b):
    """Matching-blocks ratio of two texts."""
    from difflib import SequenceMatcher

    return a.combine(b, lambda x, y: None if x is None or y is None else 1.0 if x == y else SequenceMatcher(None, x, y).ratio())


def fuzzy_word(word: Column, other: Column, least: int = 5, prefix_share: float = 0.6, ratio: float = 0.85) -> Column:
    """One word begins the other (long enough), or they differ by about a letter. The costly ratio comes last."""
    begins = other.startswith(word) | ((F.length(other) >= F.greatest(F.lit(float(least)), prefix_share * F.length(word))) & word.startswith(other))
    near = (F.least(F.length(word), F.length(other)) >= least) & (F.abs(F.length(word) - F.length(other)) <= 2)
    return begins | F.when(near & ~begins, likeness(word, other) >= ratio).otherwise(False)


def text_usable(x: Column, least: int = 40, share: float = 0.5) -> Column:
    """Whether a text layer is worth reading: long enough, and mostly letters and digits."""
    kept = F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))
    return (F.length(x) >= least) & (kept >= share * F.length(F.regexp_replace(x, r"\s", "")))
