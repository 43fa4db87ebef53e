"""Column expressions over printed and exact numbers."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currency tokens left out when a number is read (fixed values).
CURRENCIES = r"(?i)\b(?:huf|ft|eur|usd|gbp|chf)\b|[€$£]"
_TYPE = "decimal(38,6)"


def read_number(raw: Column, kind: str = "money", convention: str | None = None, dot_is_decimal: bool = False) -> Column:
    """A printed number as struct(value, ambiguous): null if unreadable, never guessed in silence.

    Both separators: the last one is the decimal one. One separator, repeated: groups. Three digits behind it: a group for money
    (never three decimals), else by the document's convention ("comma", "dot", unknown: the dot groups, and is ambiguous).
    """
    s = F.trim(F.translate(raw.cast("string"), "  ", "  "))
    s = F.regexp_replace(s, CURRENCIES, "")
    s = F.trim(F.regexp_replace(s, r"[,.]?\s*[-–]\s*$", ""))
    s = F.regexp_replace(F.replace(s, F.lit(" "), F.lit("")), r"[^0-9.,-]", "")
    bad = s.isNull() | s.isin("", "-", ".", ",") | s.rlike("-.*-|.-")
    dots, commas = F.length(F.regexp_replace(s, r"[^.]", "")), F.length(F.regexp_replace(s, "[^,]", ""))
    last = F.when(F.instr(F.reverse(s), ",") < F.instr(F.reverse(s), "."), ",").otherwise(".")
    both = (dots > 0) & (commas > 0)
    twice = F.when(last == ",", commas > 1).otherwise(dots > 1)
    mixed = F.when(last == ",", F.translate(s, ",.", ".")).otherwise(F.translate(s, ",", ""))
    one = (dots > 0) | (commas > 0)
    grouped = s.rlike(r"^-?[0-9]{1,3}(?:\.[0-9]{3})+$") | s.rlike("^-?[0-9]{1,3}(?:,[0-9]{3})+$")
    many = (dots + commas) > 1
    fraction = F.length(F.regexp_extract(s, "[.,]([0-9]*)$", 1))
    joined, pointed = F.translate(s, ".,", ""), F.translate(s, ",", ".")
    groups_here = F.when(commas > 0, F.lit(convention == "dot")).otherwise(F.lit(convention != "dot"))
    three = (fraction == 3) & grouped & ~many
    text = (
        F.when(bad, None)
        .when(both, F.when(~twice, mixed))
        .when(one & many, F.when(grouped, joined))
        .when(one & three, joined if kind == "money" else F.when(groups_here, joined).otherwise(pointed))
        .when(one, pointed)
        .otherwise(s)
    )
    unsure = F.lit(False)
    if kind == "money":
        unsure = one & ~both & ~many & ~three & ((fraction >= 3) | ((dots > 0) & (fraction <= 2) & F.lit(not dot_is_decimal)))
    else:
        short = (dots > 0) & (fraction <= 2) & F.lit(not dot_is_decimal and convention != "dot")
        unsure = one & ~both & ~many & ((three & F.lit(convention is None)) | (~three & short))
    value = text.try_cast(_TYPE)
    return F.struct(value.alias("value"), (F.coalesce(unsure, F.lit(False)) & value.isNotNull()).alias("ambiguous"))


def read_input(raw: Column) -> Column:
    """A typed amount by the Hungarian habit (a blank or a dot groups, a comma is decimal); null if unreadable or ambiguous."""
    s = F.regexp_replace(raw.cast("string"), r"[\s ]", "")
    fine = s.rlike(r"^-?[0-9.,]+$") & s.rlike("[0-9]")
    zero = F.regexp_replace(s, "[-.,0]", "") == ""
    dots, commas = F.length(F.regexp_replace(s, r"[^.]", "")), F.length(F.regexp_replace(s, "[^,]", ""))
    fraction = F.length(F.regexp_extract(s, "[.,]([0-9]*)$", 1))
    both = read_number(s)
    return (
        F.when(~fine, None)
        .when(zero, F.lit(0).cast(_TYPE))
        .when((dots > 0) & (commas > 0), F.when(~both["ambiguous"], both["value"]))
        .when(commas > 0, F.when((commas == 1) & (fraction != 3), F.translate(s, ",", ".").try_cast(_TYPE)))
        .when(dots > 0, F.when(s.rlike(r"^-?[0-9]{1,3}(?:\.[0-9]{3})+$"), F.translate(s, ".", "").try_cast(_TYPE)))
        .otherwise(s.try_cast(_TYPE))
    )


def canonical(x: Column) -> Column:
    """An exact number as text without trailing zeros."""
    s = x.cast("string")
    return F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


def minor_units(x: Column, decimals: int = 2) -> Column:
    return F.round(x.cast("decimal(30,8)") * 10**decimals).cast("bigint")


def vat_fraction(x: Column) -> Column:
    """A printed VAT rate ("27%", "27 %") as a fraction; null if there is no number."""
    return (F.nullif(F.replace(F.regexp_extract(x, r"([0-9]+(?:[.,][0-9]+)?)", 1), F.lit(","), F.lit(".")), F.lit("")).try_cast("decimal(10,4)") / 100).cast("decimal(12,6)")


def round_to(x: Column, unit: str | Decimal, mode: str = "half_up") -> Column:
    """To a multiple of a unit: half_up, half_even, or down (towards zero)."""
    u = F.lit(Decimal(str(unit)))
    q = (x / u).cast("decimal(38,6)")
    whole = {"half_up": F.round(q), "half_even": F.bround(q), "down": F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q))}[mode]
    return (whole.cast("decimal(28,0)") * u).cast("decimal(18,2)")


def convention_votes(text: Column) -> tuple[Column, Column]:
    """How often a text's numbers show a decimal comma, and a decimal point (dates and times left out)."""
    t = F.regexp_replace(text, r"[0-9]{4}\s*[.\-/]\s*[0-9]{1,2}\s*[.\-/]\s*[0-9]{1,2}\.?|[0-9]{1,2}\s*[.\-/]\s*[0-9]{1,2}\s*[.\-/]\s*[0-9]{4}|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?", " ")
    comma = (r"[0-9][.  ][0-9]{3},[0-9]{1,2}(?![0-9])", r"(?<![0-9.,])[0-9]+,[0-9]{2}(?![0-9.,]?[0-9])", r"(?<![0-9.,])[0-9]+,[0-9]{4,}(?![0-9])")
    dot = (r"[0-9],[0-9]{3}\.[0-9]{1,2}(?![0-9])", r"(?<![0-9.,])[0-9]{1,3}(?:,[0-9]{3}){2,}(?![0-9.,]?[0-9])", r"(?<![0-9.,])[0-9]+\.[0-9]{2}(?![0-9.,]?[0-9])", r"(?<![0-9.,])[0-9]+\.[0-9]{4,}(?![0-9])")
    count = lambda patterns: sum((F.regexp_count(t, F.lit(p)) for p in patterns[1:]), F.regexp_count(t, F.lit(patterns[0])))
    return count(comma), count(dot)
