"""Which statement line pays which invoice: candidates, precedence, combinations, settlement, statuses.

A pair is a candidate only if something ties it: the line's text names the invoice's number, it goes to the partner's account, or
(for a person to see) the amounts are equal. So pairs are found by equality joins on these ties, and the window, the side and the
currency are tested on what they yield; lines and invoices never meet as a product. Accounts and amounts tie only within a
month of the invoice's window, so that neither a partner's long history nor a common amount makes pairs of all its years.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.staging import written
from .graph import components


@dataclass(frozen=True)
class Rules:
    days_before_issue: int = 10
    days_after_due: int = 60
    unnamed_days_before_issue: int = 3
    max_combined: int = 6
    weights: tuple[tuple[str, int], ...] = (("invoice_number", 60), ("supplier_account", 30), ("equal", 10))


def window(rules: Rules):
    """First and last day on which an invoice's payment is looked for."""
    end = F.greatest(F.coalesce("due_date", "issue_date"), F.col("issue_date"))
    return F.date_sub("issue_date", rules.days_before_issue), F.date_add(end, rules.days_after_due)


def candidates(invoices: DataFrame, lines: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(line_id, invoice_id, named, by_account, equal, proposed, amount_only, strength).

    invoices: invoice_id, number, partner, side, currency, amount, issue_date, due_date. lines: line_id, memo, account,
    direction, currency, amount, booking_date.
    """
    lo, hi = window(rules)
    inv = invoices.select("invoice_id", text.normalize(F.col("number")).alias("number"), F.col("partner").cast("string").alias("partner"), (F.col("side") == "outgoing").alias("incoming_money"), "currency", F.col("amount").alias("whole"), "issue_date", lo.alias("lo"), hi.alias("hi"))
    pay = lines.select("line_id", text.normalize(F.col("memo")).alias("memo"), F.col("account").cast("string").alias("account"), (F.col("direction") == "credit").alias("incoming_money"), "currency", F.col("amount").alias("paid"), "booking_date")
    months = F.sequence(F.trunc("lo", "MM"), F.trunc("hi", "MM"), F.expr("interval 1 month"))
    monthly = lambda kind, month, value: F.concat(F.lit(kind), F.date_format(month, "yyyyMM"), F.lit("|"), value.cast("string"))
    inv_keys = F.array_compact(F.concat(F.array(F.concat(F.lit("number|"), F.regexp_extract("number", "([^ ]+)$", 1))), F.transform(months, lambda m: monthly("account|", m, F.col("partner"))), F.transform(months, lambda m: monthly("amount|", m, F.col("whole")))))
    pay_keys = F.array_compact(F.array_union(F.transform(F.filter(F.array_distinct(F.split("memo", " ")), lambda w: w.rlike("[0-9]")), lambda w: F.concat(F.lit("number|"), w)), F.array(monthly("account|", F.col("booking_date"), F.col("account")), monthly("amount|", F.col("booking_date"), F.col("paid")))))
    both = inv.withColumn("tie", F.explode(inv_keys)).join(pay.withColumn("tie", F.explode(pay_keys)), ["tie", "incoming_money", "currency"])
    pairs = both.where("booking_date between lo and hi").drop("tie").dropDuplicates(["line_id", "invoice_id"])
    named = text.has_words(F.col("memo"), F.col("number"))
    pairs = pairs.select("line_id", "invoice_id", named.alias("named"), F.coalesce(F.col("account") == F.col("partner"), F.lit(False)).alias("by_account"), (F.col("paid") == F.col("whole")).alias("equal"), (F.datediff("booking_date", "issue_date") < -rules.unnamed_days_before_issue).alias("early"))
    tied = F.col("named") | F.col("by_account")
    pairs = pairs.where(tied | F.col("equal")).where(F.col("named") | ~F.col("early"))
    w = dict(rules.weights)
    points = sum((F.when(F.col(c), w[k]).otherwise(0) for c, k in (("by_account", "supplier_account"), ("equal", "equal"))), F.when(F.col("named"), w["invoice_number"]).otherwise(0))
    return pairs.select("line_id", "invoice_id", "named", "by_account", "equal", (tied & F.col("equal")).alias("proposed"), (~tied).alias("amount_only"), F.least(F.lit(100), points).cast("int").alias("strength"))


def named_first(pairs: DataFrame) -> DataFrame:
    """A line that names a proposed invoice proposes no other, and that invoice is proposed on no other line."""
    sure = F.max(F.col("proposed") & F.col("named"))
    held = sure.over(Window.partitionBy("line_id")) | sure.over(Window.partitionBy("invoice_id"))
    return pairs.withColumn("proposed", F.col("proposed") & (F.col("named") | ~held))


def combined(pairs: DataFrame, invoices: DataFrame, lines: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(line_id, invoice_ids): lines without a proposal whose text names two or more invoices that together make their amount.

    All invoices named with another amount count, or none: parts of them are never tried.
    """
    open_lines = pairs.groupBy("line_id").agg(F.max("proposed").alias("p")).where("not p").select("line_id")
    group = pairs.where("named and not equal").join(open_lines, "line_id", "left_semi").join(invoices.select("invoice_id", F.col("amount").alias("whole"), "issue_date"), "invoice_id")
    sums = group.groupBy("line_id").agg(F.sum("whole").alias("total"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("issue_date", "invoice_id"))).alias("g"))
    fits = sums.where(F.col("n").between(2, rules.max_combined)).join(lines.select("line_id", "amount"), "line_id").where("total = amount")
    return fits.select("line_id", F.array_join(F.transform("g", lambda x: x["invoice_id"].cast("string")), ",").alias("invoice_ids"))


def multiplicity(pairs: DataFrame) -> DataFrame:
    """Equal amounts without a tie give way to proposals; what is still proposed or listed twice is marked."""
    by_line, by_invoice = Window.partitionBy("line_id"), Window.partitionBy("invoice_id")
    taken = F.max("proposed").over(by_line) | F.max("proposed").over(by_invoice)
    left = pairs.withColumn("taken", taken).where("not amount_only or not taken").drop("taken")
    n = lambda c, w: F.count_if(c).over(w)
    proposed, waiting = F.col("proposed"), F.col("proposed") | F.col("amount_only")
    many = (proposed & ((n(proposed, by_line) > 1) | (n(proposed, by_invoice) > 1))) | (F.col("amount_only") & ((n(waiting, by_line) > 1) | (n(waiting, by_invoice) > 1)))
    return left.withColumn("multiple_candidates", many)


def settled(allocations: DataFrame, invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """allocations(seq, invoice_id, line_id, part) with whether each counts: they apply in order while both sides have room.

    One that would exceed a side consumes nothing. Where the running sums of all never exceed a side they all count; only
    components that an excess touches are worked off in sequence, each by itself. A line and an invoice that meet nothing else are a component
    at once; only the rest is contracted. Tasks pass through their components' rows in order and hold the rooms of one component.
    """
    rows = allocations.join(invoices.select("invoice_id", F.col("amount").alias("invoice_total")), "invoice_id")

    def seen(rows, key, other, total):  # what stands on one side: whether all fit, and whether it meets one of the other side only
        side = Window.partitionBy(key)
        return rows.withColumn(f"_over_{key}", F.sum("part").over(side) > F.col(total)).withColumn(f"_one_{key}", F.min(other).over(side) == F.max(other).over(side))

    rows = seen(rows, "invoice_id", "line_id", "invoice_total").join(lines.select("line_id", F.col("amount").alias("line_total")), "line_id")
    rows = seen(rows, "line_id", "invoice_id", "line_total")
    kept = ["seq", "invoice_id", "line_id", "part", "invoice_total", "line_total"]
    marked = rows.select(*kept, (F.col("_over_invoice_id") | F.col("_over_line_id")).alias("tight"), (F.col("_one_invoice_id") & F.col("_one_line_id")).alias("alone"))
    marked = written(marked, "allocations")
    node_a, node_b = F.concat(F.lit("i"), F.col("invoice_id")), F.concat(F.lit("l"), F.col("line_id"))
    met = marked.where("not alone")
    roots = components(met.select(node_a.alias("a"), node_b.alias("b")))
    placed = met.join(roots.select(F.col("node").alias("_n"), "root"), node_a == F.col("_n")).drop("_n", "alone")
    placed = placed.withColumn("tight", F.max("tight").over(Window.partitionBy("root")))
    placed = placed.unionByName(marked.where("alone").withColumn("root", node_a).drop("alone"))  # all rows of such a pair are tight, or none
    easy = placed.where("not tight").select("seq", "invoice_id", "line_id", "part", F.lit(True).alias("counts"))

    def fold(batches):
        import pyarrow as pa

        at, room = None, {}
        for batch in batches:
            out = []
            for root, invoice, line, part, whole, paid in zip(*[batch.column(c).to_pylist() for c in ("root", "invoice_id", "line_id", "part", "invoice_total", "line_total")], strict=True):
                if root != at:
                    at, room = root, {}
                a, b = room.get(("i", invoice), whole), room.get(("l", line), paid)
                fits = part <= a and part <= b
                if fits:
                    room["i", invoice], room["l", line] = a - part, b - part
                out.append(fits)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("seq", "invoice_id", "line_id", "part")], pa.array(out, pa.bool_())], names=["seq", "invoice_id", "line_id", "part", "counts"])

    hard = placed.where("tight").drop("tight").repartition("root").sortWithinPartitions("root", "seq").mapInArrow(fold, easy.schema)
    return easy.unionByName(hard)


def credited(invoices: DataFrame, notes: DataFrame, paid: DataFrame) -> DataFrame:
    """(invoice_id, note_id): a credit note cancels the one invoice of its partner, currency and exact amount, issued on or before it,
    that no earlier note took, if nothing is paid on it. In the order of note ids, within each such group, of which a task holds one."""
    keys = ["partner", "currency", "amount"]
    a = notes.select(*keys, F.lit("n").alias("kind"), F.col("note_id").alias("id"), F.col("issue_date").alias("day"), F.lit(False).alias("paid"))
    b = invoices.join(paid.select("invoice_id", F.lit(True).alias("paid")).distinct(), "invoice_id", "left").select(*keys, F.lit("i").alias("kind"), F.col("invoice_id").alias("id"), F.col("issue_date").alias("day"), F.coalesce("paid", F.lit(False)).alias("paid"))
    def fold(batches):
        import pyarrow as pa

        columns = ["partner", "currency", "amount", "kind", "id", "day", "paid"]
        at, inv, first = None, [], 0
        for batch in batches:
            out = []
            for *group, kind, ident, day, is_paid in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
                if group != at:
                    at, inv, first = group, [], 0
                if kind == "i":
                    inv.append((day, ident, is_paid))
                    continue
                fits = [r for r in inv[first : first + 2] if r[0] <= day]  # two that fit are enough to know; one that fits alone is the earliest
                if len(fits) == 1 and not fits[0][2]:
                    first += 1
                    out.append((fits[0][1], ident))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["invoice_id", "note_id"])

    # a task passes through its groups: invoices by day and id, then notes by id
    rows = a.unionByName(b.join(notes.select(*keys).distinct(), keys, "left_semi")).where("day is not null").repartition(*keys)
    return rows.sortWithinPartitions(*keys, "kind", F.when(F.col("kind") == "i", F.col("day")), "id").mapInArrow(fold, "invoice_id long, note_id long")


def statuses(invoices: DataFrame, pairs: DataFrame, paid: DataFrame, cancelled: DataFrame, coverage: DataFrame, excluded: DataFrame | None = None, no_rate: DataFrame | None = None) -> DataFrame:
    """(invoice_id, status) by a fixed ladder. paid(invoice_id, paid), cancelled(invoice_id), coverage(invoice_id, covered),
    excluded(invoice_id), no_rate(invoice_id): a line of another currency could be its payment, but no rate is known."""
    per = pairs.groupBy("invoice_id").agg(F.max("proposed").alias("proposed"), F.max("amount_only").alias("amount_only"), F.lit(True).alias("any"))
    rows = invoices.select("invoice_id", "amount").join(per, "invoice_id", "left").join(paid, "invoice_id", "left").join(coverage, "invoice_id", "left")
    for name, df in (("cancelled", cancelled), ("excluded", excluded), ("no_rate", no_rate)):
        rows = rows.withColumn(name, F.lit(None).cast("boolean")) if df is None else rows.join(df.select("invoice_id", F.lit(True).alias(name)).distinct(), "invoice_id", "left")
    status = (
        F.when(F.col("excluded"), "excluded").when(F.col("paid") >= F.col("amount"), "confirmed").when(F.col("cancelled"), "credited").when(F.col("proposed"), "proposed").when(F.col("amount_only"), "amount_only")
        .when(F.col("paid") > 0, "partly_paid").when(F.col("any"), "amount_differs").when(F.col("no_rate"), "rate_missing").when(F.col("covered") == "full", "no_payment_found").when(F.col("covered") == "partial", "partly_covered").otherwise("not_covered")
    )
    return rows.select("invoice_id", status.alias("status"))


def repeats(pairs: DataFrame) -> DataFrame:
    """(invoice_id, lines): invoices that two or more lines each look like the full payment of."""
    full = pairs.where("equal and not amount_only")
    return full.groupBy("invoice_id").agg(F.sort_array(F.collect_set("line_id")).alias("l")).where(F.size("l") >= 2).select("invoice_id", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("lines"))


def preselect(invoices: DataFrame, lines: DataFrame, k: int = 3, share: float = 0.10) -> DataFrame:
    """(line_id, rank, invoice_id): for each line its partner's invoices by relative gap of amounts, then issue date and id.

    Amounts that lie within the share of each other meet in the same or a neighbouring step of their logarithm, so a partner's lines
    and invoices do not meet pairwise.
    """
    step = lambda c: F.floor(F.ln(F.col(c).cast("double")) / F.lit(-math.log(1 - share) * 1.0001)).cast("long")
    pay = lines.where("amount > 0").select("line_id", F.col("account").alias("partner"), F.col("amount").alias("paid"), step("amount").alias("_at"))
    inv = invoices.where("amount > 0").select("invoice_id", "partner", F.col("amount").alias("whole"), "issue_date", step("amount").alias("_step"))
    inv = inv.withColumn("_at", F.explode(F.array(*[F.col("_step") + d for d in (-1, 0, 1)]))).drop("_step")
    both = pay.join(inv, ["partner", "_at"])
    gap = F.abs(F.col("paid") - F.col("whole"))
    near = both.where(gap <= F.col("whole") * F.lit(str(share)).cast("decimal(4,2)")).withColumn("gap", F.round(gap / F.col("whole"), 6))
    rank = F.row_number().over(Window.partitionBy("line_id").orderBy("gap", "issue_date", "invoice_id"))
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("line_id", "rank", "invoice_id")


def overview(pairs: DataFrame, invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """(component, lines, invoices, kind, late): what belongs together through proposed pairs, named by its smallest invoice.

    Nodes are numbers: an invoice its id doubled, a line its id doubled and one. A pair whose line and invoice are in no other pair is
    a component at once; only the rest is contracted.
    """
    p = pairs.where("proposed").select("line_id", "invoice_id")
    alone = (F.count("*").over(Window.partitionBy("line_id")) == 1) & (F.count("*").over(Window.partitionBy("invoice_id")) == 1)
    marked = written(p.withColumn("alone", alone), "pairs")
    node = F.col("invoice_id") * 2
    roots = components(marked.where("not alone").select(node.alias("a"), (F.col("line_id") * 2 + 1).alias("b")))
    several = marked.where("not alone").withColumn("node", node).join(roots, "node").select("line_id", "invoice_id", "root")
    rooted = marked.where("alone").select("line_id", "invoice_id", node.alias("root")).unionByName(several)
    dated = rooted.join(invoices.select("invoice_id", "due_date"), "invoice_id").join(lines.select("line_id", "booking_date"), "line_id")
    g = dated.groupBy("root").agg(F.min("invoice_id").alias("component"), F.countDistinct("line_id").alias("lines"), F.countDistinct("invoice_id").alias("invoices"), F.max(F.col("booking_date") > F.col("due_date")).alias("late"))
    kind = F.when((F.col("lines") == 1) & (F.col("invoices") == 1), "single").when(F.col("lines") == 1, "combined").when(F.col("invoices") == 1, "split").otherwise("mixed")
    return g.select("component", "lines", "invoices", kind.alias("kind"), "late")


def nearest_anchor(lines: DataFrame, invoices: DataFrame, on: list[str]) -> DataFrame:
    """(line_id, invoice_id): each line with the invoice of its key whose due (else issue) day is nearest; ties to the smaller id.

    Of a day's invoices only the smallest id can win; the last day before and the first day after a line are found by windows over days, so
    lines and invoices of a key do not meet pairwise.
    """
    day = F.coalesce("due_date", "issue_date")
    anchors = invoices.groupBy(*on, day.alias("day")).agg(F.min("invoice_id").alias("id")).where("day is not null")
    none = F.lit(None).cast("long")
    events = anchors.select(*on, "day", F.struct("day", "id").alias("anchor"), none.alias("line_id")).unionByName(lines.where("booking_date is not null").select(*on, F.col("booking_date").alias("day"), F.lit(None).cast(anchors.select(F.struct("day", "id")).schema[0].dataType).alias("anchor"), F.col("line_id").cast("long").alias("line_id")))
    last = lambda order: F.last("anchor", ignorenulls=True).over(Window.partitionBy(*on).orderBy(order, F.col("line_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumn("before", last(F.col("day"))).withColumn("after", last(F.desc("day"))).where("line_id is not null")
    far = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.datediff("day", F.col(f"{side}.day"))).alias("far"), F.col(f"{side}.id").alias("id")))
    return rows.select("line_id", F.least(far("before"), far("after"))["id"].alias("invoice_id")).where("invoice_id is not null")


def learned_names(confirmed: DataFrame, least: int = 2) -> DataFrame:
    """(name_key, partner): names that confirmed pairs tie to a partner often enough."""
    keyed = confirmed.select(text.name_key(F.col("name")).alias("name_key"), "partner").where("name_key is not null")
    return keyed.groupBy("name_key", "partner").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def common_words(names: DataFrame, name: str, least: int = 3, share: float = 0.0) -> DataFrame:
    """(word, n): words in so many different names that they tie nothing."""
    keys = names.select(F.array_distinct(F.filter(F.split(text.normalize(F.col(name)), " "), lambda w: (F.length(w) >= 4) & ~w.rlike("[0-9]"))).alias("w")).distinct()
    counts = keys.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    most = max(float(least), share * keys.count()) if share else float(least)
    return counts.where(F.col("n") >= most)
