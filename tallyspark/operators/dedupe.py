"""Duplicate invoices: blocked by number and supplier, classified by their fields, grouped by components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.staging import written
from .graph import components


def comparable(x: Column) -> Column:
    """Equal values alike: numbers exactly ("100" is "100.00"), text without case; null if empty."""
    s = F.nullif(F.trim(x), F.lit(""))
    number = s.rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    return F.when(number, F.regexp_replace(s.try_cast("decimal(30,6)").cast("string"), r"\.?0+$", "")).otherwise(F.lower(s))


def pairs(docs: DataFrame, ident: str, number: str, supplier: list[str], compared: list[str]) -> DataFrame:
    """(a, b, kind, differing, missing) of documents with one number and supplier. A known difference outweighs a missing field.

    Blocks are one invoice's readings, hence small; see clusters() for groups of any size.
    """
    rows = docs.select(F.col(ident).alias("id"), text.number_key(F.col(number)).alias("_k"), *[F.col(c).alias(f"_s{n}") for n, c in enumerate(supplier)], *[comparable(F.col(c)).alias(c) for c in compared]).where("_k is not null")
    keys = ["_k", *[f"_s{n}" for n in range(len(supplier))]]
    a, b = rows.select(*keys, F.col("id").alias("a"), F.struct(*compared).alias("x")), rows.select(*keys, F.col("id").alias("b"), F.struct(*compared).alias("y"))
    both = a.join(b, keys).where("a < b")
    differ = F.array_compact(F.array(*[F.when(F.col(f"x.{c}") != F.col(f"y.{c}"), F.lit(c)) for c in compared]))
    missing = F.array_compact(F.array(*[F.when(F.col(f"x.{c}").isNull() | F.col(f"y.{c}").isNull(), F.lit(c)) for c in compared]))
    kind = F.when(F.size(differ) > 0, "variant").when(F.size(missing) > 0, "undecidable").otherwise("copy")
    return both.select("a", "b", kind.alias("kind"), F.array_join(differ, ",").alias("differing"), F.array_join(missing, ",").alias("missing"))


def clusters(docs: DataFrame, ident: str, number: str, supplier: list[str]) -> DataFrame:
    """(ident, cluster): groups of two or more, named by their smallest id. A group is a chain of links to its smallest member by any
    supplier key, so its size never squares."""
    rows = written(docs.select(F.col(ident).alias("id"), text.number_key(F.col(number)).alias("_k"), *[F.col(c).alias(f"_s{n}") for n, c in enumerate(supplier)]).where("_k is not null"), "register")
    edges = None
    for n in range(len(supplier)):
        first = rows.groupBy("_k", f"_s{n}").agg(F.min("id").alias("a")).where(f"_s{n} is not null")
        one = rows.join(first, ["_k", f"_s{n}"]).select("a", F.col("id").alias("b"))
        edges = one if edges is None else edges.unionByName(one)
    return components(edges).select(F.col("node").alias(ident), F.col("root").alias("cluster"))
