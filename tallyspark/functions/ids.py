"""Column expressions over identifiers and their check digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of check digits (fixed values of the public rules).
TAX_WEIGHTS = (9, 7, 3, 1, 9, 7, 3)
GIRO_WEIGHTS = (9, 7, 3, 1)


def _digits(x: Column) -> Column:
    return F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: c.try_cast("int"))


def _weighted(digits: Column, weights: tuple[int, ...]) -> Column:
    w = F.array(*[F.lit(n) for n in weights])
    return F.aggregate(F.transform(digits, lambda d, i: d * F.element_at(w, (i % len(weights) + 1).cast("int"))), F.lit(0), lambda a, v: a + v)


def hu_tax_code(raw: Column) -> Column:
    """The verdict on a domestic tax number: ok, or what is wrong (check digit, VAT code, county)."""
    d = F.regexp_replace(raw, "[^0-9]", "")
    check = F.pmod(10 - _weighted(_digits(F.substring(d, 1, 7)), TAX_WEIGHTS) % 10, F.lit(10))
    county = F.substring(d, 10, 2).try_cast("int")
    return (
        F.when(raw.isNull() | (raw == ""), "taxid.missing")
        .when(~d.rlike("^[0-9]{11}$"), "taxid.unrecognized")
        .when(check != F.substring(d, 8, 1).try_cast("int"), "taxid.checkdigit")
        .when(~F.substring(d, 9, 1).try_cast("int").between(1, 5), "taxid.vatcode")
        .when(~(county.between(2, 20) | county.between(22, 44) | (county == 51)), "taxid.county")
        .otherwise("taxid.ok")
    )


def giro_ok(digits: Column) -> Column:
    """The two check digits of a domestic account number of 16 or 24 digits."""
    part = lambda x: _weighted(_digits(x), GIRO_WEIGHTS) % 10 == 0
    return F.coalesce(digits.rlike("^(?:[0-9]{16}|[0-9]{24})$") & part(F.substring(digits, 1, 8)) & part(F.substr(digits, F.lit(9))), F.lit(False))


def mod97(x: Column) -> Column:
    """Remainder of an IBAN's rearranged digits: a fold over characters, never a number of 30 digits."""
    turned = F.concat(F.substr(x, F.lit(5)), F.substring(x, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97).cast("int"))


def account_code(raw: Column) -> Column:
    """The verdict on an account: IBAN by mod 97 (Hungarian ones also by their inner digits), or a domestic number."""
    s = F.upper(F.regexp_replace(raw, r"[\s-]", ""))
    hungarian = s.startswith("HU")
    iban = s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$")
    return (
        F.when(raw.isNull() | (raw == ""), "account.missing")
        .when(iban & hungarian & (F.length(s) != 28), "iban.hu_length")
        .when(iban & (mod97(s) != 1), "iban.checksum")
        .when(iban & hungarian & ~giro_ok(F.substr(s, F.lit(5))), "iban.hu_account_checksum")
        .when(iban, "iban.ok")
        .when(s.rlike("^(?:[0-9]{16}|[0-9]{24})$"), F.when(giro_ok(s), "account.hu_domestic").otherwise("account.hu_checksum"))
        .otherwise("account.format")
    )


def account_key(raw: Column) -> Column:
    """One key for an IBAN, its 24 domestic digits and the 16-digit form; empty if masked or unreadable."""
    s = F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\s-]", ""))
    inner = F.when(s.rlike("^HU[0-9]{26}$"), F.substr(s, F.lit(5))).otherwise(s)
    return F.when(inner.rlike("^(?:[0-9]{16}|[0-9]{24})$"), F.rpad(inner, 24, "0")).when(s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$"), s).otherwise("")


def is_card(digits: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits) & (digits.rlike("^[2-6][0-9]{15}$") | digits.rlike("^3[47][0-9]{13}$")), F.lit(False))


def content_id(*parts: Column) -> Column:
    """A stable identity of values, null and empty text told apart."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def line_id(statement: Column, occurrence: Column, *content: Column) -> Column:
    """A statement line's identity: its statement, a digest of its content, its occurrence among identical lines."""
    return F.concat_ws(":", F.left(statement, F.lit(16)), F.left(content_id(*content), F.lit(12)), occurrence.cast("string"))
