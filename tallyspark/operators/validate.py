"""Checks of statements and invoices: balances, totals, lines, lists, dates. Exact decimals throughout."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def _signed(direction: str, amount: str) -> Column:
    return F.when(F.col(direction) == "credit", F.col(amount)).otherwise(-F.col(amount))


def running_balance(lines: DataFrame, key: str, order: str, opening: str, tolerance: str = "0.01") -> DataFrame:
    """(key, first_break): the first line whose printed balance differs from the opening balance and all movements so far."""
    so_far = F.sum(_signed("direction", "amount")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    off = F.abs(F.col(opening) + so_far - F.col("running_balance")) > F.lit(Decimal(tolerance))
    return lines.withColumn("_off", off).groupBy(key).agg(F.min(F.when(F.col("_off"), F.col(order))).alias("first_break"))


def closing_balance(lines: DataFrame, key: str, opening: str, closing: str, tolerance: str = "0.01") -> DataFrame:
    """(key, ok, difference) of opening plus movements against the closing balance."""
    diff = (F.max(opening) + F.sum(_signed("direction", "amount")) - F.max(closing)).cast(MONEY)
    return lines.groupBy(key).agg(diff.alias("difference")).select(key, (F.abs("difference") <= F.lit(Decimal(tolerance))).alias("ok"), "difference")


def direction_totals(lines: DataFrame, key: str) -> DataFrame:
    side = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), F.lit(0)).cast(MONEY)
    return lines.groupBy(key).agg(side("debit").alias("total_debit"), side("credit").alias("total_credit"))


def directions_from_balances(lines: DataFrame, key: str, order: str) -> DataFrame:
    """The direction that a change of the running balance shows (null on the first line and where nothing changes)."""
    step = F.col("running_balance") - F.lag("running_balance").over(Window.partitionBy(key).orderBy(order))
    return lines.withColumn("derived", F.when(step > 0, "credit").when(step < 0, "debit"))


def line_sum(headers: DataFrame, lines: DataFrame, key: str, total: str, amount: str, least: str = "0.02", each: str = "0.005") -> DataFrame:
    """(key, code, difference): lines' sum against the header's, within a tolerance that grows with the lines."""
    s = lines.groupBy(key).agg(F.sum(amount).alias("_sum"), F.count("*").alias("_n"), F.count(amount).alias("_given"))
    rows = headers.join(s, key, "left")
    diff = (F.col("_sum") - F.col(total)).cast(MONEY)
    tolerance = F.greatest(F.lit(Decimal(least)).cast("decimal(18,3)"), (F.lit(Decimal(each)) * F.col("_n")).cast("decimal(18,3)"))
    code = F.when(F.col("_n").isNull(), "lines.none").when(F.col("_given") < F.col("_n"), "lines.incomplete").when(F.abs(diff) <= tolerance, "lines.total_ok").otherwise("lines.total_mismatch")
    return rows.select(key, code.alias("code"), diff.alias("difference"))


def line_arithmetic(product: Column, stated: Column, least: str = "1", percent: str = "1") -> Column:
    """Whether quantity times price (or net with VAT) is the printed amount, within 1 or 1 per cent."""
    tolerance = F.greatest(F.lit(Decimal(least)).cast("decimal(18,4)"), (F.abs(stated) * F.lit(Decimal(percent)) / 100).cast("decimal(18,4)"))
    return F.abs(product - stated) <= tolerance


def vat_code(net: Column, vat: Column, gross: Column, tolerance: str = "0.02") -> Column:
    return F.when(net.isNull() | vat.isNull() | gross.isNull(), "totals.unparseable").when(F.abs(net + vat - gross) <= F.lit(Decimal(tolerance)), "totals.ok").otherwise("totals.mismatch")


def date_order_code(issue: Column, due: Column, optional: bool = False) -> Column:
    ok = F.when(due.isNull() & issue.isNotNull(), "dates.no_due") if optional else F.when(F.lit(False), "")
    return ok.when(issue.isNull() | due.isNull(), "dates.unparseable").when(due < issue, "dates.due_before_issue").otherwise("dates.ok")


def list_checks(rows: Column, least: int, required: list[str], positive: list[str]) -> Column:
    """struct(enough, missing, not_positive): a list's length, and the numbers (from 1) of rows without a value or not above zero."""
    at = lambda bad: F.array_join(F.filter(F.transform(rows, lambda r, i: F.when(bad(r), (i + 1).cast("string"))), lambda x: x.isNotNull()), ",")
    missing = lambda r: F.greatest(*[r[c].isNull() for c in required], F.lit(False))
    low = lambda r: F.greatest(*[F.coalesce(r[c] <= 0, F.lit(False)) for c in positive], F.lit(False))
    return F.struct((F.size(rows) >= least).alias("enough"), at(missing).alias("missing"), at(low).alias("not_positive"))
