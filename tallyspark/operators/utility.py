"""Utility costs by place, utility and month: settlement bills, cover by days, what can't be placed, copies left out, totals."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import written
from . import intervals

#: Words of an address that its postcode tells already (fixed values).
_DISTRICT = r"^(?:[ivxl]+|ker|kerület)$"
UNKNOWN = "(unknown place)"


@dataclass(frozen=True)
class Grid:
    """cells: (place, utility, month, status, amount, consumption, settlement, summary_only, bills), sources: (place, utility, month, status,
    amount, item_id), where bills that have no place in the grid stand with their reasons (no_period, no_amount, duplicate), series:
    (place, utility, total, bills, suppliers, summary_only), grand_total: (grand_total), one row."""

    cells: DataFrame
    sources: DataFrame
    series: DataFrame
    grand_total: DataFrame


def place_key(address: Column) -> Column:
    """An address as it is compared: case, punctuation, blanks and districts don't matter."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(address), "[.,;:]", " "), r"\s+", " ")), " ")
    return F.coalesce(F.nullif(F.array_join(F.filter(words, lambda w: ~w.rlike(_DISTRICT)), " "), F.lit("")), F.lit(UNKNOWN))


def first_of_copies(bills: DataFrame, different: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(those that stay, (item_id, same_as)): of the bills of one copy_key the first stays, a confirmed copy coming last; bills that a person
    told apart from it (different: a, b) are looked at again among themselves, round by round. Bills without a key stay."""
    told = different.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"), F.lit(True).alias("_told")).distinct()
    left = written(bills.where("copy_key is not null"), "bills")
    stay, gone = [bills.where("copy_key is null")], []
    while not left.isEmpty():
        first = F.first("item_id").over(Window.partitionBy("copy_key").orderBy(F.coalesce("confirmed", F.lit(False)), "item_id"))
        marked = left.withColumn("_first", first)
        marked = marked.join(told, (F.least("item_id", "_first") == F.col("_a")) & (F.greatest("item_id", "_first") == F.col("_b")), "left")
        marked = written(marked, "bills")
        stay.append(marked.where("item_id = _first").select(*bills.columns))
        gone.append(marked.where("item_id <> _first and _told is null").select("item_id", F.col("_first").alias("same_as")))
        left = marked.where("item_id <> _first and _told").select(*bills.columns)
    none = bills.limit(0).select("item_id", F.col("item_id").alias("same_as"))
    return reduce(DataFrame.unionByName, stay), reduce(DataFrame.unionByName, gone, none)


def grid(bills: DataFrame, different: DataFrame) -> Grid:
    """The monthly grid of bills: item_id, address, utility, start, end, amount, consumption, supplier, summary_only, copy_key, confirmed.

    A settlement bill's period holds another bill's of its series. In the order of starts, latest first, and of ends, that is
    so if the least end seen before is no later than its own: one running minimum, no bill meets another. A settlement counts
    whole in its last month; all other bills are split by days, and their cover alone makes a month ok, partial, an overlap or missing.
    """
    reason = F.when(F.col("start").isNull() | F.col("end").isNull() | (F.col("end") < F.col("start")), "no_period").when(F.col("amount").isNull(), "no_amount")
    rows = bills.withColumn("place", place_key(F.col("address"))).withColumn("reason", reason)
    unplaced = rows.where("reason is not null").select("item_id", "reason")
    good, copies = first_of_copies(rows.where("reason is null").drop("reason"), different)
    series = ["place", "utility"]
    before = F.min("end").over(Window.partitionBy(*series).orderBy(F.desc("start"), "end").rowsBetween(Window.unboundedPreceding, -1))
    periods = good.select(*series, "start", "end").distinct().withColumn("settlement", F.coalesce(before <= F.col("end"), F.lit(False)))
    good = written(good.join(periods, [*series, "start", "end"]), "placed")
    regular = good.where("not settlement")
    cells = intervals.month_status(regular, series, "start", "end")
    long = F.explode(F.array(F.struct(F.lit("amount").alias("what"), F.col("amount").alias("value")), F.struct(F.lit("consumption").alias("what"), F.col("consumption").alias("value"))))
    parts = intervals.by_month(regular.select("item_id", *series, "start", "end", long.alias("x")).select("item_id", *series, "start", "end", "x.what", "x.value").where("value is not null"), "start", "end", "value")
    share = lambda what: F.max(F.when(F.col("what") == what, F.col("share"))).cast("decimal(18,2)").alias(what)
    parts = parts.groupBy("item_id", *series, "month").agg(share("amount"), share("consumption")).withColumn("settlement", F.lit(False))
    whole = good.where("settlement").select("item_id", *series, F.date_format("end", "yyyy-MM").alias("month"), "amount", F.lit(None).cast("decimal(18,2)").alias("consumption"), F.lit(True).alias("settlement"))
    sources = written(parts.unionByName(whole), "sources")
    sums = sources.groupBy(*series, "month").agg(F.sum("amount").cast("decimal(18,2)").alias("amount"), F.sum("consumption").cast("decimal(18,2)").alias("consumption"), F.max("settlement").alias("settlement"), F.count("*").alias("bills"))
    totals = good.groupBy(*series).agg(F.sum("amount").cast("decimal(18,2)").alias("total"), F.count("*").alias("bills"), F.array_join(F.array_sort(F.collect_set("supplier")), ", ").alias("suppliers"), F.min_by(F.coalesce("summary_only", F.lit(False)), F.struct("start", "end", "item_id")).alias("summary_only"))
    told = cells.join(sums, [*series, "month"], "full").join(totals.select(*series, "summary_only"), series)
    told = told.select(*series, "month", F.coalesce("status", F.lit("ok")).alias("status"), "amount", "consumption", F.coalesce("settlement", F.lit(False)).alias("settlement"), "summary_only", F.coalesce("bills", F.lit(0)).alias("bills"))
    stated = sources.join(told.select(*series, "month", "status"), [*series, "month"]).select(*series, "month", F.when(F.col("settlement"), "settlement").otherwise(F.col("status")).alias("status"), "amount", "item_id")
    absent = unplaced.select(F.col("reason").alias("status"), "item_id").unionByName(copies.select(F.lit("duplicate").alias("status"), "item_id"))
    none = F.lit(None).cast("string")
    stated = stated.unionByName(absent.select(none.alias("place"), none.alias("utility"), none.alias("month"), "status", F.lit(None).cast("decimal(18,2)").alias("amount"), "item_id"))
    zero = F.lit(0).cast("decimal(18,2)")
    grand = totals.agg(F.coalesce(F.sum(F.when(~F.col("summary_only"), F.col("total"))), zero).cast("decimal(18,2)").alias("grand_total"))
    return Grid(told, stated, totals, grand)
