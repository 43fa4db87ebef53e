"""What belongs together in a package: groups of lines and invoices with their kind, flags and the lists a person checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import written
from .graph import components

#: Lists in their order, states of a line that a person has to decide, flags that ask to look at the documents (fixed values).
LISTS = ("to_decide", "line_without_invoice", "invoice_without_payment", "overdue", "late", "double_payment", "clarify", "paired", "marked", "credited", "excluded")
OPEN = ("proposed", "amount_only", "partly_allocated", "open")
CLARIFY = ("several_candidates", "amount_differs", "statement_unverified", "double_payment", "rest_left")


@dataclass(frozen=True)
class Overview:
    """groups: (group, kind, day, lines, invoices, pairs, flags, lists); pairs: (line_id, invoice_id, state, several, days_from_due);
    invoices: (invoice_id, paid_on, days_from_due, overdue_days, double_payment)."""

    groups: DataFrame
    pairs: DataFrame
    invoices: DataFrame


def pairs_of(lines: DataFrame, invoices: DataFrame, allocations: DataFrame, candidates: DataFrame, repeats: DataFrame) -> DataFrame:
    """(line_id, invoice_id, state, several, days_from_due): allocated and proposed pairs, and each line that repeats a payment with the one
    invoice of those that it may repeat whose due (else issue) day is nearest to its own."""
    taken = allocations.select("line_id", "invoice_id", F.lit("allocated").alias("state"), F.lit(False).alias("several"))
    taken = taken.unionByName(candidates.where("proposed").select("line_id", "invoice_id", F.lit("proposed").alias("state"), F.coalesce("multiple_candidates", F.lit(False)).alias("several")))
    days = lines.select("line_id", "booking_date")
    dated = taken.join(days, "line_id").join(invoices.select("invoice_id", "due_date"), "invoice_id")
    dated = dated.select("line_id", "invoice_id", "state", "several", F.datediff("booking_date", "due_date").alias("days_from_due"))
    again = repeats.where("not paid").join(days, "line_id").join(invoices.select("invoice_id", F.coalesce("due_date", "issue_date").alias("anchor")), "invoice_id")
    near = again.groupBy("line_id").agg(F.min(F.struct(F.coalesce(F.abs(F.datediff("booking_date", "anchor")), F.lit(1_000_000)).alias("far"), "invoice_id")).alias("x"))
    return dated.unionByName(near.select("line_id", "x.invoice_id", F.lit("repeat").alias("state"), F.lit(False).alias("several"), F.lit(None).cast("int").alias("days_from_due")))


def timing(pairs: DataFrame, lines: DataFrame, invoices: DataFrame, repeats: DataFrame) -> DataFrame:
    """(invoice_id, paid_on, days_from_due, overdue_days, double_payment) of every invoice."""
    paying = pairs.where("state in ('allocated', 'proposed')").join(lines.select("line_id", "booking_date"), "line_id")
    per = paying.groupBy("invoice_id").agg(F.max("booking_date").alias("paid_on"), F.max(F.col("state") == "proposed").alias("proposed"))
    rows = invoices.join(per, "invoice_id", "left").join(repeats.select("invoice_id", F.lit(True).alias("twice")).distinct(), "invoice_id", "left")
    open_rest = F.coalesce("own", F.lit(True)) & ~F.col("state").isin("confirmed", "credited", "excluded") & (F.col("rest") > 0) & ~F.coalesce("proposed", F.lit(False))
    overdue = F.when(open_rest & (F.col("due_date") < F.col("checked_until")), F.datediff("checked_until", "due_date"))
    return rows.select("invoice_id", "paid_on", F.datediff("paid_on", "due_date").alias("days_from_due"), overdue.alias("overdue_days"), F.coalesce("twice", F.lit(False)).alias("double_payment"))


def build(lines: DataFrame, invoices: DataFrame, allocations: DataFrame, candidates: DataFrame, repeats: DataFrame) -> Overview:
    """The groups of a package: what pairs tie together, and every line and own invoice that is in no pair by itself.

    Nodes are numbers: an invoice its id doubled, a line its id doubled and one. A pair of which neither side is in another pair is a group
    at once; only the rest goes through the contraction of components. A group is then one aggregate over its members' facts, combined
    before the shuffle; nothing of a group is listed.

    lines: line_id, state, booking_date, statement_verified. invoices: invoice_id, state, issue_date, due_date, rest, checked_until, own.
    allocations: line_id, invoice_id. candidates: line_id, invoice_id, proposed, multiple_candidates. repeats: invoice_id, line_id, paid
    (whether the line is one that pays it). Another party's invoice is shown only in a pair.
    """
    pairs = written(pairs_of(lines, invoices, allocations, candidates, repeats), "pairs")
    facts = written(timing(pairs, lines, invoices, repeats), "timing")
    ends = pairs.select("line_id", "invoice_id").distinct()
    alone = (F.count("*").over(Window.partitionBy("line_id")) == 1) & (F.count("*").over(Window.partitionBy("invoice_id")) == 1)
    marked = written(ends.withColumn("alone", alone), "ends")
    node_i, node_l = F.col("invoice_id") * 2, F.col("line_id") * 2 + 1
    roots = components(marked.where("not alone").select(node_i.alias("a"), node_l.alias("b")))
    single = marked.where("alone")
    roots = written(roots.unionByName(single.select(node_i.alias("node"), node_i.alias("root"))).unionByName(single.select(node_l.alias("node"), node_i.alias("root"))), "roots")
    own = lambda df, node: df.withColumn("node", node).join(roots, "node", "left").withColumn("group", F.coalesce("root", "node")).withColumn("in_pair", F.col("root").isNotNull()).drop("node", "root")
    none = F.lit(None)
    columns = {
        "group": "long", "line_id": "long", "invoice_id": "long", "line_state": "string", "invoice_state": "string", "pair_state": "string", "line_day": "date", "invoice_day": "date",
        "late": "boolean", "overdue": "boolean", "twice": "boolean", "several": "boolean", "unverified": "boolean", "no_due": "boolean",
    }
    fill = lambda df: df.select(*[(F.col(c) if c in df.columns else none).cast(t).alias(c) for c, t in columns.items()])
    of_lines = own(lines, node_l).withColumn("line_state", F.col("state")).withColumn("line_day", F.col("booking_date")).withColumn("unverified", ~F.coalesce("statement_verified", F.lit(True)) & (F.col("state") != "excluded"))
    of_invoices = own(invoices.join(facts.select("invoice_id", "overdue_days", F.col("double_payment").alias("twice")), "invoice_id"), node_i).where("in_pair or coalesce(own, true)")
    of_invoices = of_invoices.withColumn("invoice_state", F.col("state")).withColumn("invoice_day", F.coalesce("due_date", "issue_date")).withColumn("overdue", F.col("overdue_days").isNotNull()).withColumn("no_due", F.col("due_date").isNull())
    of_pairs = own(pairs.drop("line_id"), node_i).withColumn("pair_state", F.col("state")).withColumn("late", (F.col("state") != "repeat") & (F.coalesce("days_from_due", F.lit(0)) > 0)).drop("invoice_id")
    members = fill(of_lines.drop("invoice_id")).unionByName(fill(of_invoices.drop("line_id"))).unionByName(fill(of_pairs))
    has: dict[str, Column] = {
        "has_proposed": F.col("pair_state") == "proposed", "has_allocated": F.col("pair_state") == "allocated", "all_credited": None, "late": F.col("late"), "overdue": F.col("overdue"), "double_payment": F.col("twice"),
        "several_candidates": F.col("several"), "amount_differs": F.col("invoice_state") == "amount_differs", "statement_unverified": F.col("unverified"), "part_line": F.col("line_state") == "partly_allocated",
        "part_invoice": F.col("invoice_state") == "partly_paid", "no_due_date": F.col("no_due"), "confirmed": F.col("invoice_state") == "confirmed", "undecided": F.col("line_state").isin(*OPEN),
    }
    some = [F.coalesce(F.max(c), F.lit(False)).alias(k) for k, c in has.items() if c is not None]
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    g = members.groupBy("group").agg(
        *some, count(F.col("line_id").isNotNull()).alias("lines"), count(F.col("invoice_id").isNotNull()).alias("invoices"), count(F.col("pair_state").isNotNull()).alias("pairs"),
        count(F.col("invoice_state") == "credited").alias("n_credited"), count(F.col("invoice_state") == "confirmed").alias("n_confirmed"), F.min("line_day").alias("line_day"), F.min("invoice_day").alias("invoice_day"),
        F.min_by("line_state", F.struct("line_day", "line_id")).alias("first_state"), F.min("invoice_id").alias("first_invoice"), F.min("line_id").alias("first_line"),
    )
    kind = (
        F.when(F.col("has_proposed"), "proposed").when(F.col("has_allocated"), "paired").when((F.col("invoices") > 0) & (F.col("n_credited") == F.col("invoices")), "credited")
        .when((F.col("invoices") > 0) & (F.col("n_confirmed") == F.col("invoices")), "paired").when(F.col("invoices") > 0, "invoice_only").when(F.col("first_state").isin("marked", "excluded"), F.col("first_state")).otherwise("line_only")
    )
    g = g.withColumn("kind", kind).withColumn("rest_left", ((F.col("kind") == "paired") & F.col("part_line")) | F.col("part_invoice")).withColumn("paid_elsewhere", F.col("confirmed") & ~F.col("has_allocated"))
    flags = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in ("late", "overdue", "double_payment", "several_candidates", "amount_differs", "statement_unverified", "rest_left", "no_due_date", "paid_elsewhere")]))
    told = {"to_decide": F.col("undecided"), "line_without_invoice": F.col("kind") == "line_only", "invoice_without_payment": F.col("kind") == "invoice_only", "clarify": F.arrays_overlap("flags", F.array(*[F.lit(c) for c in CLARIFY]))}
    told |= {c: F.array_contains("flags", c) for c in ("overdue", "late", "double_payment")} | {c: F.col("kind") == c for c in ("paired", "marked", "credited", "excluded")}
    g = g.withColumn("flags", flags).withColumn("lists", F.array_compact(F.array(*[F.when(told[c], F.lit(c)) for c in LISTS])))
    name = F.when(F.col("first_invoice").isNotNull(), F.concat(F.lit("i"), F.col("first_invoice").cast("string"))).otherwise(F.concat(F.lit("l"), F.col("first_line").cast("string")))
    return Overview(g.select(name.alias("group"), "kind", F.coalesce("line_day", "invoice_day").alias("day"), "lines", "invoices", "pairs", "flags", "lists"), pairs, facts)


def list_counts(groups: DataFrame) -> DataFrame:
    """(list, groups): how many groups each list has; `all` for all of them."""
    return groups.select(F.explode(F.array_append("lists", F.lit("all"))).alias("list")).groupBy("list").agg(F.count("*").alias("groups"))
