"""Parties: matched with the register, suggested for it, told apart as own or other; directions and marks from what was seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def tax_key(x: Column) -> Column:
    """The digits that tell a taxpayer (the first eight); null if there are fewer."""
    digits = F.regexp_replace(x, "[^0-9]", "")
    return F.when(F.length(digits) >= 8, F.left(digits, F.lit(8)))


def match(parties: DataFrame, partners: DataFrame) -> DataFrame:
    """(party_id, partner_id, by): by tax number, else by a name that only one partner has. Both sides: id, tax_number, name."""
    p = partners.select("partner_id", tax_key(F.col("tax_number")).alias("t"), text.name_key(F.col("name")).alias("n"))
    by_tax = p.where("t is not null").groupBy("t").agg(F.min("partner_id").alias("p1"))
    by_name = p.where("n is not null").groupBy("n").agg(F.min("partner_id").alias("p2"), F.count("*").alias("k")).where("k = 1").drop("k")
    rows = parties.select("party_id", tax_key(F.col("tax_number")).alias("t"), text.name_key(F.col("name")).alias("n"))
    rows = rows.join(by_tax, "t", "left").join(by_name, "n", "left")
    return rows.select("party_id", F.coalesce("p1", "p2").alias("partner_id"), F.when(F.col("p1").isNotNull(), "tax_number").when(F.col("p2").isNotNull(), "name").alias("by"))


def suggestions(seen: DataFrame, partners: DataFrame, dismissed: DataFrame) -> DataFrame:
    """(tax_key, label, documents): parties seen in documents that are neither registered nor dismissed, by tax number and by name.

    seen: doc_id, tax_number, name. dismissed: tax_key. The label is the name seen most often.
    """
    s = seen.select("doc_id", "name", tax_key(F.col("tax_number")).alias("tax_key"), text.name_key(F.col("name")).alias("n")).where("tax_key is not null")
    s = s.join(partners.select(tax_key(F.col("tax_number")).alias("tax_key")), "tax_key", "left_anti")
    s = s.join(partners.select(text.name_key(F.col("name")).alias("n")), "n", "left_anti").join(dismissed.select("tax_key"), "tax_key", "left_anti")
    named = s.groupBy("tax_key", "name").agg(F.count("*").alias("k"), F.count("doc_id").alias("d"))
    return named.groupBy("tax_key").agg(F.max_by("name", F.struct("k", "name")).alias("label"), F.sum("d").alias("documents"))


def orientation(history: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, supplier): which of two parties supplies the other, by the majority of at least `least` documents; null if they are even.

    history: supplier, buyer (keys). a < b."""
    rows = history.where("supplier <> buyer").select(F.least("supplier", "buyer").alias("a"), F.greatest("supplier", "buyer").alias("b"), (F.col("supplier") < F.col("buyer")).alias("first"))
    votes = rows.groupBy("a", "b").agg(F.count_if("first").alias("x"), F.count_if(~F.col("first")).alias("y")).where(F.col("x") + F.col("y") >= least)
    return votes.select("a", "b", F.when(F.col("x") > F.col("y"), F.col("a")).when(F.col("y") > F.col("x"), F.col("b")).alias("supplier"))


def own_suggestion(seen: DataFrame, share: float = 0.1) -> DataFrame:
    """(tax_key, label, documents): identities that may be the holder's own: each tax number with its most common name and how many
    documents show it, without numbers that are a rare reading beside a name's usual one (fewer than `share` of it). seen: doc_id, tax_number, name."""
    s = seen.select("doc_id", "name", tax_key(F.col("tax_number")).alias("tax_key"), text.name_key(F.col("name")).alias("n")).where("tax_key is not null and n is not null")
    pairs = s.groupBy("n", "tax_key").agg(F.countDistinct("doc_id").alias("k"))
    usual = pairs.withColumn("most", F.max("k").over(Window.partitionBy("n"))).where(F.col("k") >= share * F.col("most")).select("n", "tax_key")
    kept = s.join(usual, ["n", "tax_key"], "left_semi")
    labels = kept.groupBy("tax_key", "name").agg(F.count("*").alias("k")).groupBy("tax_key").agg(F.max_by("name", F.struct("k", "name")).alias("label"))
    return kept.groupBy("tax_key").agg(F.countDistinct("doc_id").alias("documents")).join(labels, "tax_key").select("tax_key", "label", "documents")


def direction(invoices: DataFrame, own: DataFrame) -> DataFrame:
    """(invoice_id, direction, support): whether the own party bought or sold, from both sides: its tax number counts two, its name one.

    invoices: invoice_id, supplier_tax, supplier_name, buyer_tax, buyer_name. own: tax_number, name. Null: even or nothing seen."""
    taxes, names = own.select(tax_key(F.col("tax_number")).alias("k")).distinct(), own.select(text.name_key(F.col("name")).alias("k")).distinct()
    rows = invoices
    for side in ("supplier", "buyer"):
        for part, keys, key in (("tax", taxes, tax_key), ("name", names, text.name_key)):
            rows = rows.join(keys.select(F.col("k").alias("_k"), F.lit(True).alias(f"_{side}_{part}")), key(F.col(f"{side}_{part}")) == F.col("_k"), "left").drop("_k")
    points = lambda side: F.when(F.col(f"_{side}_tax"), 2).otherwise(0) + F.when(F.col(f"_{side}_name"), 1).otherwise(0)
    net = points("buyer") - points("supplier")
    return rows.select("invoice_id", F.when(net > 0, "incoming").when(net < 0, "outgoing").alias("direction"), F.abs(net).cast("int").alias("support"))


def marks(lines: DataFrame) -> DataFrame:
    """(line_id, marks): what other lines of the same partner were marked as, most frequent first ("rent:3,tax:1"); empty if nothing.

    lines: line_id, key (of the partner), category (null: not marked)."""
    per = lines.where("category is not null").groupBy("key", "category").agg(F.countDistinct("line_id").alias("n"))
    all_ = per.groupBy("key").agg(F.collect_list(F.struct("category", "n")).alias("seen"))  # one entry a category
    rows = lines.groupBy("line_id", "key").agg(F.collect_set("category").alias("own")).join(all_, "key", "left")
    less = F.transform("seen", lambda s: F.struct((F.when(F.array_contains("own", s["category"]), 1).otherwise(0) - s["n"]).alias("n"), s["category"].alias("category")))
    told = F.transform(F.array_sort(F.filter(less, lambda s: s["n"] < 0)), lambda s: F.concat_ws(":", s["category"], (-s["n"]).cast("string")))
    return rows.select("line_id", F.coalesce(F.array_join(told, ","), F.lit("")).alias("marks"))
