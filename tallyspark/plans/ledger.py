"""Queries of reconciliation over invoices and statement lines derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import dedupe, intervals, overview, reconcile, relations
from .staging import table

#: Derived tables; the same text serves both engines.
INVOICES = """SELECT o_orderkey AS invoice_id, concat('INV-', CAST(o_orderkey AS STRING)) AS number, o_custkey AS partner, CASE WHEN o_orderkey % 7 = 0 THEN 'outgoing' ELSE 'incoming' END AS side,
    CASE WHEN o_orderkey % 4 = 0 THEN 'EUR' ELSE 'HUF' END AS currency, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(o_orderdate AS DATE) AS issue_date,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INT) AS due_date FROM {orders}"""
_LINE = """SELECT o_orderkey * 10 + {n} AS line_id, CASE WHEN o_orderkey % 2 = 0 THEN concat('Payment inv ', CAST(o_orderkey AS STRING), ' thanks') ELSE 'transfer' END AS memo,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS account, CASE WHEN o_orderkey % 7 = 0 THEN 'credit' ELSE 'debit' END AS direction, CASE WHEN o_orderkey % 4 = 0 THEN 'EUR' ELSE 'HUF' END AS currency,
    CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) - CAST(1 AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 - {back} AS INT) AS booking_date FROM {{orders}} WHERE {where}"""
_TOGETHER = """SELECT 1000000000 + CAST(floor(o_orderkey / 20) AS BIGINT) AS line_id, concat('inv ', CAST(min(o_orderkey) AS STRING), ' inv ', CAST(max(o_orderkey) AS STRING)) AS memo, CAST(NULL AS BIGINT) AS account,
    'debit' AS direction, 'HUF' AS currency, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount, CAST(max(o_orderdate) AS DATE) + 5 AS booking_date FROM {orders}
    WHERE o_orderkey % 20 IN (11, 13) AND o_orderkey % 7 <> 0 GROUP BY floor(o_orderkey / 20) HAVING count(*) = 2 AND CAST(max(o_orderdate) AS DATE) - CAST(min(o_orderdate) AS DATE) < {days}"""


def _lines(days):
    return " UNION ALL ".join([_LINE.format(n=1, back=5, where="o_orderkey % 3 <> 2"), _LINE.format(n=2, back=4, where="o_orderkey % 26 = 0"), _TOGETHER.replace("{days}", days)])


def invoices(spark, sf):
    return spark.sql(INVOICES, orders=table(spark, sf, "orders"))


def lines(spark, sf):
    return spark.sql(_lines("interval 1200 days"), orders=table(spark, sf, "orders"))


def pairs(spark, sf):
    return reconcile.candidates(invoices(spark, sf), lines(spark, sf))


def reconcile_candidates(spark, sf):
    return pairs(spark, sf)


def reconcile_named_first(spark, sf):
    return reconcile.named_first(pairs(spark, sf)).where("proposed").select("line_id", "invoice_id")


def reconcile_multiplicity(spark, sf):
    return reconcile.multiplicity(reconcile.named_first(pairs(spark, sf))).select("line_id", "invoice_id", "proposed", "amount_only", "multiple_candidates")


def combined_payment(spark, sf):
    return reconcile.combined(reconcile.named_first(pairs(spark, sf)), invoices(spark, sf), lines(spark, sf))


def repeated_payments(spark, sf):
    return reconcile.repeats(pairs(spark, sf))


def reconcile_status(spark, sf):
    inv = invoices(spark, sf)
    paid = inv.where("invoice_id % 10 = 3").select("invoice_id", F.when(F.col("invoice_id") % 20 == 3, F.col("amount")).otherwise(F.lit(1).cast("decimal(18,2)")).alias("paid"))
    cancelled = inv.where("invoice_id % 50 = 7").select("invoice_id")
    state = F.when(F.col("invoice_id") % 3 == 0, "full").when(F.col("invoice_id") % 3 == 1, "partial").otherwise("none")
    left = reconcile.multiplicity(reconcile.named_first(pairs(spark, sf)))
    excluded, no_rate = inv.where("invoice_id % 97 = 0").select("invoice_id"), inv.where("invoice_id % 4 = 0 and invoice_id % 3 = 2").select("invoice_id")
    return reconcile.statuses(inv, left, paid, cancelled, inv.select("invoice_id", state.alias("covered")), excluded, no_rate)


def range_join_months(spark, sf):
    """Lines to a partner's account and its invoices by the window alone, bucketed by month."""
    inv = invoices(spark, sf).select("invoice_id", "currency", F.col("partner").alias("account"), F.date_sub("issue_date", 3).alias("lo"), F.date_add("due_date", 10).alias("hi"))
    pay = lines(spark, sf).select("line_id", "currency", "account", "booking_date")
    return intervals.month_range_join(pay, inv, ["currency", "account"], "booking_date", "lo", "hi").select("line_id", "invoice_id")


def preselect_topk(spark, sf):
    return reconcile.preselect(invoices(spark, sf), lines(spark, sf).where("account is not null"))


def overview_components(spark, sf):
    return reconcile.overview(reconcile.named_first(pairs(spark, sf)), invoices(spark, sf), lines(spark, sf))


#: Lines and invoices with their states, and what ties them; the same text serves both engines.
_O_LINES = """SELECT line_id, CASE line_id % 7 WHEN 0 THEN 'marked' WHEN 1 THEN 'excluded' WHEN 2 THEN 'partly_allocated' WHEN 3 THEN 'open' WHEN 4 THEN 'proposed' ELSE 'allocated' END AS state, booking_date, line_id % 17 > 0 AS statement_verified FROM ({lines}) l"""
_O_INV = """SELECT invoice_id, CASE invoice_id % 9 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'credited' WHEN 2 THEN 'partly_paid' WHEN 3 THEN 'amount_differs' WHEN 4 THEN 'excluded' ELSE 'open' END AS state, issue_date, CASE WHEN invoice_id % 8 > 0 THEN due_date END AS due_date,
    amount - (invoice_id % 3) * amount / 2 AS rest, issue_date + CAST(invoice_id % 70 AS INT) AS checked_until, invoice_id % 12 > 0 AS own FROM ({invoices}) i"""
_O_ALLOC = "SELECT line_id, CAST(floor(line_id / 10) AS BIGINT) AS invoice_id FROM ({lines}) l WHERE line_id < 1000000000 AND floor(line_id / 10) % 10 = 3"
_O_CAND = """SELECT line_id, CAST(floor(line_id / 10) AS BIGINT) AS invoice_id, floor(line_id / 10) % 4 > 0 AS proposed, floor(line_id / 10) % 14 = 0 AS multiple_candidates FROM ({lines}) l WHERE line_id < 1000000000 AND floor(line_id / 10) % 5 > 1
    UNION ALL SELECT line_id, CAST(floor(line_id / 10) AS BIGINT) + 1, true, true FROM ({lines}) l WHERE line_id < 1000000000 AND floor(line_id / 10) % 14 = 0
    UNION ALL SELECT line_id, CAST(floor((line_id - 1000000000) * 20 + 11) AS BIGINT), true, false FROM ({lines}) l WHERE line_id >= 1000000000"""
_O_REPEAT = "SELECT CAST(floor(line_id / 10) AS BIGINT) + d AS invoice_id, line_id, line_id % 10 = 1 AS paid FROM ({lines}) l CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 2) z WHERE line_id < 1000000000 AND floor(line_id / 10) % 26 = 0"


def _overview(spark, sf):
    spark_sql = lambda t: spark.sql(t.replace("{lines}", _lines("interval 1200 days")).replace("{invoices}", INVOICES), orders=table(spark, sf, "orders"))
    inv = spark_sql(_O_INV)
    known = inv.select("invoice_id")
    real = lambda t: spark_sql(t).join(known, "invoice_id", "left_semi")
    return overview.build(spark_sql(_O_LINES), inv, real(_O_ALLOC), real(_O_CAND), real(_O_REPEAT))


def overview_groups(spark, sf):
    """All groups of lines and invoices, those in no pair too, with their kinds, flags and lists."""
    return _overview(spark, sf).groups.select("group", "kind", "day", "lines", "invoices", "pairs", F.array_join("flags", ",").alias("flags"), F.array_join("lists", ",").alias("lists"))


def overview_lists(spark, sf):
    return overview.list_counts(_overview(spark, sf).groups)


def invoice_timing(spark, sf):
    """When each invoice was paid, how late, for how long it is overdue, and whether it may have been paid twice."""
    return _overview(spark, sf).invoices


def nearest_anchor(spark, sf):
    pay = lines(spark, sf).where("account is not null").select("line_id", F.col("account").alias("partner"), "booking_date")
    return reconcile.nearest_anchor(pay, invoices(spark, sf).select("invoice_id", "partner", "issue_date", "due_date"), ["partner"])


def credit_note_cancel(spark, sf):
    inv = invoices(spark, sf).withColumn("amount", F.round(F.col("amount") / 10000).cast("decimal(18,2)"))
    notes = inv.where("invoice_id % 13 = 0").select(F.col("invoice_id").alias("note_id"), "partner", "currency", "amount", F.date_add("issue_date", 400).alias("issue_date"))
    return reconcile.credited(inv.where("invoice_id % 13 <> 0"), notes, inv.where("invoice_id % 6 = 1").select("invoice_id"))


def settled_rests(spark, sf):
    inv, pay = invoices(spark, sf).select("invoice_id", "amount"), invoices(spark, sf).select((F.col("invoice_id") * 10 + 1).alias("line_id"), "amount")
    part = inv.select((F.col("invoice_id") * 2).alias("seq"), "invoice_id", (F.col("invoice_id") * 10 + 1).alias("line_id"), F.round(F.col("amount") / 2, 2).cast("decimal(18,2)").alias("part"))
    again = part.where("invoice_id % 3 = 0").withColumn("seq", F.col("seq") + 1)
    third = part.where("invoice_id % 6 = 0").withColumn("seq", F.col("seq") + 10_000_000)
    return reconcile.settled(part.unionByName(again).unionByName(third), inv, pay).select("seq", "invoice_id", "counts")


def learned_names(spark, sf):
    named = table(spark, sf, "part").select(F.concat("p_type", F.lit(" *"), F.col("p_partkey").cast("string"), F.lit(" b")).alias("name"), F.col("p_brand").alias("partner"))
    return reconcile.learned_names(named, 3)


def common_words(spark, sf):
    return reconcile.common_words(table(spark, sf, "part"), "p_name", 3)


def line_match_nth(spark, sf):
    li = table(spark, sf, "lineitem")
    old = li.select("l_orderkey", F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("pos"))
    new = li.where("l_linenumber > 1").select("l_orderkey", F.col("l_returnflag").alias("flag"), (F.col("l_linenumber") - 1).alias("new_pos"))
    return relations.nth_join(old, new, ["l_orderkey", "flag"], [F.col("pos")], [F.col("new_pos")])


def line_occurrence(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return relations.occurrence(li, ["l_orderkey", "l_returnflag", "l_linestatus"], [F.col("l_linenumber")])


def fx_asof_rate(spark, sf):
    days = spark.range(0, 4000).select(F.date_add(F.lit("1992-01-01").cast("date"), F.col("id").cast("int")).alias("day"), "id")
    rates = days.where("id % 7 not in (5, 6)").select(F.lit("EUR").alias("currency"), "day", (F.lit(390) + F.col("id") % 50).cast("decimal(18,6)").alias("rate"))
    known = days.where("id % 100 not between 40 and 45").select(F.lit("EUR").alias("currency"), "day")
    asked = invoices(spark, sf).where("currency = 'EUR'").select("invoice_id", "currency", F.col("issue_date").alias("day"))
    rates = rates.join(known, ["currency", "day"], "left_semi")
    return intervals.as_of(asked, rates, known, ["currency"], "day", "rate", 3).select("invoice_id", F.col("rate").cast("double").alias("rate"), "rate_day")


def fx_convert_band(spark, sf):
    rate = F.lit(390).cast("decimal(18,6)")
    inv = invoices(spark, sf).where("currency = 'EUR'")
    paid = (F.col("amount") * (380 + F.col("invoice_id") % 21).cast("decimal(9,0)")).cast("decimal(28,2)")
    expected = (F.col("amount") * rate).cast("decimal(28,8)")
    deviation = F.bround(paid.cast("double") / expected.cast("double") - 1, 4)
    within = F.when((deviation >= -0.01) & (deviation <= 0.02), "fx_within").otherwise("fx_outside")
    return inv.select("invoice_id", F.bround(expected, 2).cast("decimal(18,2)").alias("converted"), within.alias("relation"))


def missing_spans(spark, sf):
    ev = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    edge = ev.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    every = edge.select("user_id", F.explode(F.sequence("a", "b")).alias("day"))
    return intervals.spans(relations.anti(every, ev, ["user_id", "day"]), ["user_id"], "day", 10)


def _periods(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("statement"), F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 90).cast("int")).alias("end"))


def coverage_merge(spark, sf):
    return intervals.merged(_periods(spark, sf), ["account"])


def coverage_contains(spark, sf):
    wanted = invoices(spark, sf).select(F.col("partner").alias("account"), "invoice_id", F.col("issue_date").alias("start"), F.date_add("due_date", 20).alias("end"))
    return intervals.covered(wanted, intervals.merged(_periods(spark, sf).where("statement % 3 <> 0"), ["account"]), ["account"], "invoice_id")


def statement_overlap_pairs(spark, sf):
    return intervals.overlapping(_periods(spark, sf), ["account"], "statement")


def replacement_chain(spark, sf):
    """Each statement is replaced by the next one of its account that overlaps it; where that ends."""
    over = intervals.overlapping(_periods(spark, sf), ["account"], "statement")
    return intervals.chain_ends(over.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("next")))


def monthly_allocation(spark, sf):
    p = _periods(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("statement"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount")), "statement")
    return intervals.by_month(p, "start", "end", "amount").select("statement", "month", "share")


def account_month_grid(spark, sf):
    return intervals.month_status(_periods(spark, sf), ["account"], "start", "end")


#: Statements that mostly follow each other: from the middle of one month to the middle of the next, some shifted, missing or left open.
_MONTHLY = """SELECT o_orderkey AS statement, o_custkey AS account, CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' ELSE 'HUF' END AS currency, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + CAST(o_orderkey * 13 % 200 - 2 AS INT) AS `end`,
    o_orderkey % 6 > 0 AS verified, o_orderkey % 5 > 0 AS approved, CAST(o_orderkey % 3 AS DECIMAL(18,2)) AS opening, CAST(o_orderkey % 4 AS DECIMAL(18,2)) AS closing FROM {orders}
    UNION ALL SELECT o_orderkey + 1000000000, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' ELSE 'HUF' END, CAST(o_orderdate AS DATE) + CAST(o_orderkey * 13 % 200 - 1 AS INT), CAST(o_orderdate AS DATE) + CAST(o_orderkey * 13 % 200 + 50 AS INT),
    true, o_orderkey % 7 > 0, CAST(o_orderkey % 5 AS DECIMAL(18,2)), CAST(1 AS DECIMAL(18,2)) FROM {orders} WHERE o_orderkey % 3 = 0"""
_ACCOUNTS = """SELECT o_custkey AS account, CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' ELSE 'HUF' END AS currency, CASE WHEN o_custkey % 4 = 0 THEN CAST(min(o_orderdate) AS DATE) + 40 END AS opened, CASE WHEN o_custkey % 5 = 0 THEN CAST(max(o_orderdate) AS DATE) - 20 END AS closed FROM {orders} GROUP BY 1, 2, o_custkey"""


def month_states(spark, sf):
    """The state of every account's months, 1997 to the middle of July 1998."""
    o = table(spark, sf, "orders")
    day = lambda d: F.lit(d).cast("date")
    return intervals.month_states(spark.sql(_ACCOUNTS, orders=o), spark.sql(_MONTHLY, orders=o), day("1997-01-01"), day("1998-09-01"), day("1998-07-15"))


def balance_breaks(spark, sf):
    """Where a statement does not open with the balance at which the one before it closed."""
    from pyspark.sql import Window

    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("statement"), F.to_date("o_orderdate").alias("start"), F.round("o_totalprice").cast("long").alias("opening"), (F.round("o_totalprice").cast("long") + F.col("o_orderkey") % 3).alias("closing"))
    before = F.lag("closing").over(Window.partitionBy("account").orderBy("start", "statement"))
    return o.withColumn("before", before).select("account", "statement", F.coalesce(F.col("before") != F.col("opening"), F.lit(False)).alias("broken"))


def months_between(spark, sf):
    return invoices(spark, sf).select("invoice_id", F.size(dates.months(F.col("issue_date"), F.col("due_date"))).cast("long").alias("n"), F.array_join(dates.months(F.col("issue_date"), F.col("due_date")), ",").alias("months"))


def _register(spark, sf):
    """Invoices as several readings of them: a copy, a variant in its total, one without a currency, another spelling of the number."""
    base = invoices(spark, sf).select("invoice_id", "number", "partner", F.col("amount").cast("string").alias("gross_total"), F.col("issue_date").cast("string").alias("issue_date"), F.lower("currency").alias("currency"))
    k = F.col("invoice_id") % 4
    again = base.select(
        (F.col("invoice_id") + 1_000_000_000).alias("invoice_id"), F.replace("number", F.lit("-"), F.lit(" /")).alias("number"), "partner",
        F.when(k == 1, F.concat("gross_total", F.lit("9"))).when(k == 0, F.concat("gross_total", F.lit("0"))).otherwise(F.col("gross_total")).alias("gross_total"), "issue_date",
        F.when(k == 2, F.lit(None)).otherwise(F.upper("currency")).alias("currency"),
    )
    return base.unionByName(again)


def duplicate_pairs(spark, sf):
    return dedupe.pairs(_register(spark, sf), "invoice_id", "number", ["partner"], ["gross_total", "issue_date", "currency"])


def duplicate_kinds(spark, sf):
    return duplicate_pairs(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


def duplicate_clusters(spark, sf):
    return dedupe.clusters(_register(spark, sf), "invoice_id", "number", ["partner"])


def routing_proposal(spark, sf):
    """Documents to packages: same partner, the day within the package's period; only if there is exactly one."""
    packages = _periods(spark, sf).select(F.col("account").alias("partner"), F.col("statement").alias("package"), "start", "end")
    docs = invoices(spark, sf).select("invoice_id", "partner", "issue_date")
    hit = intervals.month_range_join(docs, packages, ["partner"], "issue_date", "start", "end")
    return hit.groupBy("invoice_id").agg(F.when(F.count("*") == 1, F.min("package")).alias("package"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        reconcile_candidates, reconcile_named_first, reconcile_multiplicity, combined_payment, repeated_payments, reconcile_status, range_join_months, preselect_topk, overview_components, overview_groups, overview_lists, invoice_timing, nearest_anchor,
        credit_note_cancel, settled_rests, learned_names, common_words, line_match_nth, line_occurrence, fx_asof_rate, fx_convert_band, missing_spans, coverage_merge, coverage_contains, statement_overlap_pairs,
        replacement_chain, monthly_allocation, account_month_grid, month_states, balance_breaks, months_between, duplicate_pairs, duplicate_kinds, duplicate_clusters, routing_proposal,
    )
}

_I = INVOICES.format(orders="orders")
_L = _lines("1200").format(orders="orders")
_CAND = f"""inv AS ({_I}), pay AS ({_L}), raw AS (SELECT line_id, invoice_id, contains(concat(' ', trim(regexp_replace(lower(memo), '[^a-z0-9]+', ' ', 'g')), ' '), concat(' inv ', CAST(invoice_id AS VARCHAR), ' ')) AS named,
    coalesce(account = partner, false) AS by_account, pay.amount = inv.amount AS equal, booking_date - issue_date < -3 AS early FROM inv JOIN pay ON inv.currency = pay.currency AND (side = 'outgoing') = (direction = 'credit')
    AND booking_date BETWEEN issue_date - 10 AND greatest(due_date, issue_date) + 60),
    cand AS (SELECT line_id, invoice_id, named, by_account, equal, (named OR by_account) AND equal AS proposed, NOT (named OR by_account) AS amount_only,
    CAST(least(100, CASE WHEN named THEN 60 ELSE 0 END + CASE WHEN by_account THEN 30 ELSE 0 END + CASE WHEN equal THEN 10 ELSE 0 END) AS INT) AS strength FROM raw WHERE (named OR by_account OR equal) AND (named OR NOT early)),
    nf AS (SELECT * REPLACE (proposed AND (named OR NOT (bool_or(proposed AND named) OVER (PARTITION BY line_id) OR bool_or(proposed AND named) OVER (PARTITION BY invoice_id))) AS proposed) FROM cand),
    mu AS (SELECT *, bool_or(proposed) OVER (PARTITION BY line_id) OR bool_or(proposed) OVER (PARTITION BY invoice_id) AS taken FROM nf), lf AS (SELECT * FROM mu WHERE NOT amount_only OR NOT taken)"""
_DAYS = "days AS (SELECT CAST(DATE '1992-01-01' + CAST(i AS INT) AS DATE) AS day, i FROM range(0, 4000) t(i))"
_P = "p AS (SELECT o_custkey AS account, o_orderkey AS statement, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) AS e FROM orders)"
_OVER = "ov AS (SELECT x.account, x.statement AS a, y.statement AS b FROM p x JOIN p y ON x.account = y.account AND x.statement < y.statement AND x.s <= y.e AND y.s <= x.e WHERE NOT ((y.s = x.e AND x.s < y.s AND y.e > x.e) OR (x.s = y.e AND y.s < x.s AND x.e > y.e)))"
_MERGE = "r AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY account ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS n FROM {src}), g AS (SELECT *, sum(n) OVER (PARTITION BY account ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM r), merged AS (SELECT account, min(s) AS s, max(e) AS e FROM g GROUP BY account, i)"
_REG = f"""inv AS ({_I}), base AS (SELECT invoice_id, number, partner, CAST(amount AS VARCHAR) AS gross_total, CAST(issue_date AS VARCHAR) AS issue_date, lower(currency) AS currency FROM inv),
    reg AS (SELECT * FROM base UNION ALL SELECT invoice_id + 1000000000, replace(number, '-', ' /'), partner, CASE invoice_id % 4 WHEN 1 THEN gross_total || '9' WHEN 0 THEN gross_total || '0' ELSE gross_total END, issue_date, CASE WHEN invoice_id % 4 = 2 THEN NULL ELSE upper(currency) END FROM base)"""
_DUP = f"""WITH {_REG}, d AS (SELECT a.invoice_id AS a, b.invoice_id AS b, CAST(a.gross_total AS DECIMAL(30,6)) <> CAST(b.gross_total AS DECIMAL(30,6)) AS g, a.issue_date <> b.issue_date AS i, lower(a.currency) <> lower(b.currency) AS c FROM reg a JOIN reg b
    ON upper(regexp_replace(a.number, '[^0-9A-Za-z]', '', 'g')) = upper(regexp_replace(b.number, '[^0-9A-Za-z]', '', 'g')) AND a.partner = b.partner AND a.invoice_id < b.invoice_id)
    SELECT a, b, CASE WHEN g OR i OR c THEN 'variant' WHEN c IS NULL THEN 'undecidable' ELSE 'copy' END AS kind, concat_ws(',', CASE WHEN g THEN 'gross_total' END, CASE WHEN i THEN 'issue_date' END, CASE WHEN c THEN 'currency' END) AS differing, CASE WHEN c IS NULL THEN 'currency' ELSE '' END AS missing FROM d"""
_duck = lambda t: t.replace("{lines}", _L).replace("{invoices}", _I)
_OVERVIEW = f"""ln AS ({_duck(_O_LINES)}), iv AS ({_duck(_O_INV)}), al AS (SELECT * FROM ({_duck(_O_ALLOC)}) WHERE invoice_id IN (SELECT invoice_id FROM iv)), cn AS (SELECT * FROM ({_duck(_O_CAND)}) WHERE invoice_id IN (SELECT invoice_id FROM iv)), rp AS (SELECT * FROM ({_duck(_O_REPEAT)}) WHERE invoice_id IN (SELECT invoice_id FROM iv)),
    nr AS (SELECT line_id, arg_min(invoice_id, (coalesce(abs(booking_date - coalesce(due_date, issue_date)), 1000000), invoice_id)) AS invoice_id FROM rp JOIN ln USING (line_id) JOIN iv USING (invoice_id) WHERE NOT paid GROUP BY 1),
    pr AS (SELECT line_id, invoice_id, 'allocated' AS state, false AS several FROM al UNION ALL SELECT line_id, invoice_id, 'proposed', multiple_candidates FROM cn WHERE proposed UNION ALL SELECT line_id, invoice_id, 'repeat', false FROM nr),
    pd AS (SELECT pr.*, booking_date, CASE WHEN pr.state <> 'repeat' THEN booking_date - due_date END AS late FROM pr JOIN ln USING (line_id) JOIN iv USING (invoice_id)),
    tm AS (SELECT iv.invoice_id, p.paid_on, p.paid_on - due_date AS days_from_due, CASE WHEN own AND state NOT IN ('confirmed', 'credited', 'excluded') AND rest > 0 AND NOT coalesce(p.prop, false) AND due_date < checked_until THEN checked_until - due_date END AS overdue_days, iv.invoice_id IN (SELECT invoice_id FROM rp) AS double_payment
        FROM iv LEFT JOIN (SELECT invoice_id, max(booking_date) AS paid_on, bool_or(state = 'proposed') AS prop FROM pd WHERE state <> 'repeat' GROUP BY 1) p ON p.invoice_id = iv.invoice_id),
    ed AS (SELECT invoice_id * 2 AS a, line_id * 2 + 1 AS b FROM pr UNION SELECT line_id * 2 + 1, invoice_id * 2 FROM pr), reach AS (SELECT a AS n, a AS m FROM ed UNION SELECT reach.n, ed.b FROM reach JOIN ed ON reach.m = ed.a), rt AS (SELECT n, min(m) AS root FROM reach GROUP BY n),
    gl AS (SELECT coalesce(root, line_id * 2 + 1) AS g, ln.* FROM ln LEFT JOIN rt ON n = line_id * 2 + 1), gi AS (SELECT coalesce(root, invoice_id * 2) AS g, iv.*, overdue_days, double_payment FROM iv JOIN tm USING (invoice_id) LEFT JOIN rt ON n = invoice_id * 2 WHERE own OR root IS NOT NULL), gp AS (SELECT root AS g, pd.* FROM pd JOIN rt ON n = invoice_id * 2),
    sl AS (SELECT g, count(*) AS nl, min(booking_date) AS day, arg_min(state, (booking_date, line_id)) AS first_state, min(line_id) AS line_id, bool_or(NOT statement_verified AND state <> 'excluded') AS unverified, bool_or(state = 'partly_allocated') AS part, bool_or(state IN ('proposed', 'amount_only', 'partly_allocated', 'open')) AS undecided FROM gl GROUP BY 1),
    si AS (SELECT g, count(*) AS ni, min(coalesce(due_date, issue_date)) AS day, min(invoice_id) AS invoice_id, bool_or(overdue_days IS NOT NULL) AS overdue, bool_or(double_payment) AS twice, bool_or(state = 'amount_differs') AS differs, bool_or(state = 'partly_paid') AS part, bool_or(due_date IS NULL) AS no_due, bool_or(state = 'confirmed') AS conf, bool_and(state = 'credited') AS cred, bool_and(state = 'confirmed') AS all_conf FROM gi GROUP BY 1),
    sp AS (SELECT g, count(*) AS np, bool_or(state = 'proposed') AS prop, bool_or(state = 'allocated') AS alloc, bool_or(coalesce(late, 0) > 0) AS late, bool_or(several) AS several FROM gp GROUP BY 1),
    k AS (SELECT coalesce(sl.g, si.g) AS g, CASE WHEN prop THEN 'proposed' WHEN alloc THEN 'paired' WHEN cred THEN 'credited' WHEN all_conf THEN 'paired' WHEN ni > 0 THEN 'invoice_only' WHEN first_state IN ('marked', 'excluded') THEN first_state ELSE 'line_only' END AS kind,
        coalesce(sl.day, si.day) AS day, coalesce(nl, 0) AS lines, coalesce(ni, 0) AS invoices, coalesce(np, 0) AS pairs, coalesce('i' || invoice_id, 'l' || line_id) AS name, late, overdue, twice, several, differs, unverified, sl.part AS lpart, si.part AS ipart, no_due, conf AND NOT coalesce(alloc, false) AS elsewhere, undecided FROM sl FULL JOIN si ON sl.g = si.g LEFT JOIN sp ON sp.g = coalesce(sl.g, si.g)),
    fl AS (SELECT *, concat_ws(',', CASE WHEN late THEN 'late' END, CASE WHEN overdue THEN 'overdue' END, CASE WHEN twice THEN 'double_payment' END, CASE WHEN several THEN 'several_candidates' END, CASE WHEN differs THEN 'amount_differs' END, CASE WHEN unverified THEN 'statement_unverified' END,
        CASE WHEN (kind = 'paired' AND lpart) OR ipart THEN 'rest_left' END, CASE WHEN no_due THEN 'no_due_date' END, CASE WHEN elsewhere THEN 'paid_elsewhere' END) AS flags FROM k),
    gr AS (SELECT name AS "group", kind, day, lines, invoices, pairs, flags, concat_ws(',', CASE WHEN undecided THEN 'to_decide' END, CASE kind WHEN 'line_only' THEN 'line_without_invoice' WHEN 'invoice_only' THEN 'invoice_without_payment' END, CASE WHEN overdue THEN 'overdue' END, CASE WHEN late THEN 'late' END, CASE WHEN twice THEN 'double_payment' END,
        CASE WHEN regexp_matches(flags, 'several_candidates|amount_differs|statement_unverified|double_payment|rest_left') THEN 'clarify' END, CASE WHEN kind IN ('paired', 'marked', 'credited', 'excluded') THEN kind END) AS lists FROM fl)"""
_MS = f"""sm AS ({_MONTHLY.replace("{orders}", "orders").replace("`", '"')}), s AS (SELECT * FROM sm WHERE start <= "end"), ac AS ({_ACCOUNTS.replace("{orders}", "orders")}),
    c AS (SELECT account, currency, opened, closed, CAST(m AS DATE) AS m, CAST(m AS DATE) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS e FROM ac, generate_series(TIMESTAMP '1997-01-01', TIMESTAMP '1998-09-01', INTERVAL 1 MONTH) g(m)),
    d AS (SELECT *, greatest(m, opened) AS lo, least(CAST(e AS DATE), closed, DATE '1998-07-14') AS hi FROM c),
    days AS (SELECT account, currency, m, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM d WHERE lo <= hi),
    has AS (SELECT DISTINCT account, currency, CAST(unnest(generate_series(start, "end", INTERVAL 1 DAY)) AS DATE) AS day FROM s),
    gap AS (SELECT account, currency, m, bool_or(has.day IS NULL) AS gap FROM days LEFT JOIN has USING (account, currency, day) GROUP BY 1, 2, 3),
    per AS (SELECT account, currency, m, count(*) AS n, bool_and(verified) AS v, bool_and(approved) AS a FROM d JOIN s USING (account, currency) WHERE s.start <= d.e AND s."end" >= m GROUP BY 1, 2, 3),
    lg AS (SELECT *, lag(start) OVER w AS s1, lag("end") OVER w AS e1, lag(closing) OVER w AS c1 FROM s WINDOW w AS (PARTITION BY account, currency ORDER BY start, "end", statement)),
    fl AS (SELECT *, start <= e1 AND NOT (start = e1 AND s1 < start AND "end" > e1) AS o FROM lg WHERE e1 IS NOT NULL),
    fo AS (SELECT DISTINCT account, currency, m, 'overlap' AS flag FROM d JOIN fl USING (account, currency) WHERE o AND date_trunc('month', start) <= m AND m <= least("end", e1) UNION SELECT account, currency, CAST(date_trunc('month', start) AS DATE), 'break' FROM fl WHERE NOT o AND start - e1 IN (0, 1) AND c1 <> opening),
    fg AS (SELECT account, currency, m, string_agg(flag, ',' ORDER BY flag DESC) AS flags FROM fo GROUP BY 1, 2, 3)"""
ORACLES = {
    "month_states": f"WITH {_MS} SELECT account, currency, strftime(m, '%Y-%m') AS month, CASE WHEN n IS NULL THEN CASE WHEN lo <= hi AND e < DATE '1998-07-15' THEN 'missing' ELSE 'none' END WHEN coalesce(gap, false) THEN 'partial' WHEN NOT v THEN 'unverified' WHEN NOT a THEN 'unapproved' ELSE 'ok' END AS state, coalesce(n, 0) AS statements, coalesce(flags, '') AS flags FROM d LEFT JOIN gap USING (account, currency, m) LEFT JOIN per USING (account, currency, m) LEFT JOIN fg USING (account, currency, m)",
    "overview_groups": f"WITH RECURSIVE {_OVERVIEW} SELECT * FROM gr",
    "overview_lists": f"WITH RECURSIVE {_OVERVIEW} SELECT list, count(*) AS groups FROM (SELECT unnest(string_split(lists, ',')) AS list FROM gr UNION ALL SELECT 'all' FROM gr) WHERE list <> '' GROUP BY 1",
    "invoice_timing": f"WITH RECURSIVE {_OVERVIEW} SELECT * FROM tm",
    "settled_rests": f"WITH inv AS ({_I}), p AS (SELECT invoice_id, CAST(amount * 100 AS BIGINT) AS c, (CAST(amount * 100 AS BIGINT) + 1) // 2 AS part FROM inv), x AS (SELECT *, invoice_id * 2 AS seq, 1 AS n FROM p UNION ALL SELECT *, invoice_id * 2 + 1, 2 FROM p WHERE invoice_id % 3 = 0 UNION ALL SELECT *, invoice_id * 2 + 10000000, 3 FROM p WHERE invoice_id % 6 = 0) SELECT seq, invoice_id, CASE n WHEN 1 THEN part <= c WHEN 2 THEN 2 * part <= c ELSE (CASE WHEN 2 * part <= c THEN 3 ELSE 2 END) * part <= c END AS counts FROM x",
    "credit_note_cancel": f"WITH RECURSIVE i0 AS ({_I}), i AS (SELECT *, round(CAST(amount AS DOUBLE) / 10000) AS a FROM i0), k AS (SELECT partner, currency, a, list((invoice_id, issue_date + 400) ORDER BY invoice_id) FILTER (WHERE invoice_id % 13 = 0) AS notes, list((invoice_id, issue_date) ORDER BY invoice_id) FILTER (WHERE invoice_id % 13 <> 0) AS invs FROM i GROUP BY ALL HAVING count(*) FILTER (WHERE invoice_id % 13 = 0) > 0 AND count(*) FILTER (WHERE invoice_id % 13 <> 0) > 0), r AS (SELECT notes, invs, 0 AS step, CAST([] AS BIGINT[]) AS taken, CAST([] AS BIGINT[]) AS by_note FROM k UNION ALL SELECT notes, invs, step + 1, CASE WHEN len(f) = 1 AND f[1] % 6 <> 1 THEN list_append(taken, f[1]) ELSE taken END, CASE WHEN len(f) = 1 AND f[1] % 6 <> 1 THEN list_append(by_note, n) ELSE by_note END FROM (SELECT *, notes[step + 1][1] AS n, list_transform(list_filter(invs, lambda v: v[2] <= notes[step + 1][2] AND NOT list_contains(taken, v[1])), lambda v: v[1]) AS f FROM r WHERE step < len(notes))), z AS (SELECT taken, by_note FROM r WHERE step = len(notes)) SELECT unnest(taken) AS invoice_id, unnest(by_note) AS note_id FROM z",
    "reconcile_candidates": f"WITH {_CAND} SELECT * FROM cand",
    "reconcile_named_first": f"WITH {_CAND} SELECT line_id, invoice_id FROM nf WHERE proposed",
    "reconcile_multiplicity": f"WITH {_CAND} SELECT line_id, invoice_id, proposed, amount_only, (proposed AND (count(*) FILTER (WHERE proposed) OVER (PARTITION BY line_id) > 1 OR count(*) FILTER (WHERE proposed) OVER (PARTITION BY invoice_id) > 1)) OR (amount_only AND (count(*) FILTER (WHERE proposed OR amount_only) OVER (PARTITION BY line_id) > 1 OR count(*) FILTER (WHERE proposed OR amount_only) OVER (PARTITION BY invoice_id) > 1)) AS multiple_candidates FROM lf",
    "combined_payment": f"WITH {_CAND}, g AS (SELECT line_id, sum(inv.amount) AS total, count(*) AS n, string_agg(CAST(invoice_id AS VARCHAR), ',' ORDER BY issue_date, invoice_id) AS invoice_ids FROM nf JOIN inv USING (invoice_id) WHERE named AND NOT equal AND line_id NOT IN (SELECT line_id FROM nf WHERE proposed) GROUP BY line_id) SELECT line_id, invoice_ids FROM g JOIN pay USING (line_id) WHERE n BETWEEN 2 AND 6 AND total = pay.amount",
    "repeated_payments": f"WITH {_CAND} SELECT invoice_id, string_agg(DISTINCT CAST(line_id AS VARCHAR), ',' ORDER BY CAST(line_id AS VARCHAR)) AS lines FROM cand WHERE equal AND NOT amount_only GROUP BY 1 HAVING count(DISTINCT line_id) >= 2",
    "reconcile_status": f"WITH {_CAND}, per AS (SELECT invoice_id, bool_or(proposed) AS proposed, bool_or(amount_only) AS amount_only FROM lf GROUP BY 1), z AS (SELECT inv.invoice_id, inv.amount, per.*, CASE WHEN inv.invoice_id % 10 = 3 THEN CASE WHEN inv.invoice_id % 20 = 3 THEN inv.amount ELSE 1 END END AS paid FROM inv LEFT JOIN per ON inv.invoice_id = per.invoice_id) SELECT invoice_id, CASE WHEN invoice_id % 97 = 0 THEN 'excluded' WHEN paid >= amount THEN 'confirmed' WHEN invoice_id % 50 = 7 THEN 'credited' WHEN proposed THEN 'proposed' WHEN amount_only THEN 'amount_only' WHEN paid > 0 THEN 'partly_paid' WHEN proposed IS NOT NULL THEN 'amount_differs' WHEN invoice_id % 4 = 0 AND invoice_id % 3 = 2 THEN 'rate_missing' WHEN invoice_id % 3 = 0 THEN 'no_payment_found' WHEN invoice_id % 3 = 1 THEN 'partly_covered' ELSE 'not_covered' END AS status FROM z",
    "range_join_months": f"WITH inv AS ({_I}), pay AS ({_L}) SELECT line_id, invoice_id FROM inv JOIN pay ON inv.currency = pay.currency AND account = partner AND booking_date BETWEEN issue_date - 3 AND due_date + 10",
    "preselect_topk": f"WITH inv AS ({_I}), pay AS ({_L}), x AS (SELECT line_id, invoice_id, row_number() OVER (PARTITION BY line_id ORDER BY round(CAST(abs(pay.amount - inv.amount) AS DOUBLE) / CAST(inv.amount AS DOUBLE), 6), issue_date, invoice_id) AS rank FROM pay JOIN inv ON account = partner WHERE abs(pay.amount - inv.amount) <= inv.amount * 0.10) SELECT line_id, rank, invoice_id FROM x WHERE rank <= 3",
    "overview_components": f"WITH RECURSIVE {_CAND}, e AS (SELECT 'i' || lpad(CAST(invoice_id AS VARCHAR), 12, '0') AS a, 'l' || lpad(CAST(line_id AS VARCHAR), 12, '0') AS b, line_id, invoice_id FROM nf WHERE proposed), ed AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS n, a AS m FROM ed UNION SELECT reach.n, ed.b FROM reach JOIN ed ON reach.m = ed.a), root AS (SELECT n, min(m) AS root FROM reach GROUP BY n), z AS (SELECT CAST(substr(root, 2) AS BIGINT) AS component, count(DISTINCT e.line_id) AS lines, count(DISTINCT e.invoice_id) AS invoices, bool_or(booking_date > due_date) AS late FROM e JOIN root ON e.a = root.n JOIN inv USING (invoice_id) JOIN pay USING (line_id) GROUP BY 1) SELECT component, lines, invoices, CASE WHEN lines = 1 AND invoices = 1 THEN 'single' WHEN lines = 1 THEN 'combined' WHEN invoices = 1 THEN 'split' ELSE 'mixed' END AS kind, late FROM z",
    "nearest_anchor": f"WITH inv AS ({_I}), pay AS ({_L}) SELECT line_id, arg_min(invoice_id, (abs(booking_date - due_date), invoice_id)) AS invoice_id FROM pay JOIN inv ON account = partner GROUP BY line_id",
    "learned_names": "WITH n AS (SELECT lower(p_type) AS name_key, p_brand AS partner FROM part) SELECT trim(regexp_replace(name_key, '[^a-z]+', ' ', 'g')) AS name_key, partner, count(*) AS n FROM n GROUP BY 1, 2 HAVING count(*) >= 3",
    "common_words": "WITH k AS (SELECT DISTINCT list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 4 AND NOT regexp_matches(w, '[0-9]'))) AS k FROM part), w AS (SELECT unnest(k) AS word FROM k) SELECT word, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 3",
    "line_match_nth": "WITH a AS (SELECT l_orderkey, l_returnflag AS flag, l_linenumber AS pos, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS n FROM lineitem), b AS (SELECT l_orderkey, l_returnflag AS flag, l_linenumber - 1 AS new_pos, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS n FROM lineitem WHERE l_linenumber > 1) SELECT l_orderkey, flag, pos, new_pos FROM a JOIN b USING (l_orderkey, flag, n)",
    "line_occurrence": "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber) - 1 AS occurrence FROM lineitem",
    "fx_asof_rate": f"WITH {_DAYS}, inv AS ({_I}), x AS (SELECT invoice_id, issue_date, back, issue_date - back AS d FROM inv, (SELECT unnest([0, 1, 2, 3]) AS back) WHERE currency = 'EUR'), y AS (SELECT x.*, i, i % 7 NOT IN (5, 6) AND i % 100 NOT BETWEEN 40 AND 45 AS pub, coalesce(i % 100 NOT BETWEEN 40 AND 45, false) AS known FROM x LEFT JOIN days ON days.day = x.d), z AS (SELECT invoice_id, min(CASE WHEN pub THEN back END) AS hit, min(CASE WHEN NOT coalesce(pub, false) AND NOT known THEN back END) AS gap, any_value(issue_date) AS day FROM y GROUP BY 1), f AS (SELECT invoice_id, CASE WHEN hit IS NOT NULL AND (gap IS NULL OR hit < gap) THEN day - hit END AS rate_day FROM z) SELECT invoice_id, CAST(390 + i % 50 AS DOUBLE) AS rate, rate_day FROM f LEFT JOIN days ON days.day = rate_day",
    "fx_convert_band": f"WITH inv AS ({_I}), x AS (SELECT invoice_id, CAST(amount * 390 AS DECIMAL(18,2)) AS converted, round_even(CAST(amount * (380 + invoice_id % 21) AS DOUBLE) / CAST(amount * 390 AS DOUBLE) - 1, 4) AS d FROM inv WHERE currency = 'EUR') SELECT invoice_id, converted, CASE WHEN d >= -0.01 AND d <= 0.02 THEN 'fx_within' ELSE 'fx_outside' END AS relation FROM x",
    "missing_spans": "WITH ev AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), ed AS (SELECT user_id, min(day) AS a, max(day) AS b FROM ev GROUP BY 1), al AS (SELECT user_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM ed), ms AS (SELECT * FROM al WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.user_id = al.user_id AND ev.day = al.day)), g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS g FROM ms), h AS (SELECT *, floor((row_number() OVER (PARTITION BY user_id, g ORDER BY day) - 1) / 10) AS c FROM g) SELECT user_id, min(day) AS start, max(day) AS \"end\", count(*) AS days FROM h GROUP BY user_id, g, c",
    "coverage_merge": f"WITH {_P}, {_MERGE.format(src='p')} SELECT account, s AS start, e AS \"end\" FROM merged",
    "coverage_contains": f"WITH {_P}, q AS (SELECT * FROM p WHERE statement % 3 <> 0), {_MERGE.format(src='q')}, inv AS ({_I}), w AS (SELECT partner AS account, invoice_id, issue_date AS ws, due_date + 20 AS we FROM inv) SELECT w.account, invoice_id, CASE max(CASE WHEN s <= ws AND we <= e THEN 2 WHEN s <= we AND ws <= e THEN 1 ELSE 0 END) WHEN 2 THEN 'full' WHEN 1 THEN 'partial' ELSE 'none' END AS covered FROM w LEFT JOIN merged ON w.account = merged.account GROUP BY 1, 2",
    "statement_overlap_pairs": f"WITH {_P}, {_OVER} SELECT * FROM ov",
    "replacement_chain": f"WITH RECURSIVE {_P}, {_OVER}, nx AS (SELECT a AS node, min(b) AS nxt FROM ov GROUP BY 1), c AS (SELECT node, nxt AS cur FROM nx UNION ALL SELECT c.node, nx.nxt FROM c JOIN nx ON c.cur = nx.node) SELECT node, max(cur) AS \"end\" FROM c GROUP BY 1",
    "monthly_allocation": "WITH o AS (SELECT o_orderkey AS statement, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) AS e FROM orders), d AS (SELECT statement, amount, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS day FROM o), m AS (SELECT statement, amount, strftime(day, '%Y-%m') AS month, count(*) AS n FROM d GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY statement) AS total, row_number() OVER (PARTITION BY statement ORDER BY month DESC) AS r FROM m), x AS (SELECT *, CAST(CAST((CAST(amount * 100 AS HUGEINT) * n * 2 + total) // (total * 2) AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2)) AS sh FROM t) SELECT statement, month, CAST(CASE WHEN r = 1 THEN amount - coalesce((SELECT sum(y.sh) FROM x y WHERE y.statement = x.statement AND y.r > 1), 0) ELSE sh END AS DECIMAL(18,2)) AS share FROM x",
    "account_month_grid": f"WITH {_P}, d AS (SELECT account, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS day FROM p), h AS (SELECT account, day, count(*) AS n FROM d GROUP BY 1, 2), sp AS (SELECT account, CAST(unnest(generate_series(min(s), max(e), INTERVAL 1 DAY)) AS DATE) AS day FROM p GROUP BY account) SELECT sp.account, strftime(sp.day, '%Y-%m') AS month, CASE WHEN max(coalesce(n, 0)) = 0 THEN 'missing' WHEN max(coalesce(n, 0)) > 1 THEN 'overlap' WHEN min(coalesce(n, 0)) = 0 THEN 'partial' ELSE 'ok' END AS status FROM sp LEFT JOIN h ON sp.account = h.account AND sp.day = h.day GROUP BY 1, 2",
    "balance_breaks": "SELECT o_custkey AS account, o_orderkey AS statement, coalesce(lag(CAST(round(o_totalprice) AS BIGINT) + o_orderkey % 3) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) <> CAST(round(o_totalprice) AS BIGINT), false) AS broken FROM orders",
    "months_between": f"WITH inv AS ({_I}), x AS (SELECT invoice_id, list_transform(generate_series(date_trunc('month', issue_date), date_trunc('month', due_date), INTERVAL 1 MONTH), lambda d: strftime(d, '%Y-%m')) AS m FROM inv) SELECT invoice_id, CAST(len(m) AS BIGINT) AS n, array_to_string(m, ',') AS months FROM x",
    "duplicate_pairs": _DUP,
    "duplicate_kinds": f"SELECT kind, count(*) AS n FROM ({_DUP}) GROUP BY 1",
    "duplicate_clusters": f"WITH {_REG}, k AS (SELECT *, upper(regexp_replace(number, '[^0-9A-Za-z]', '', 'g')) AS nk FROM reg), g AS (SELECT min(invoice_id) OVER (PARTITION BY nk, partner) AS cluster, count(*) OVER (PARTITION BY nk, partner) AS n, invoice_id FROM k) SELECT invoice_id, cluster FROM g WHERE n > 1",
    "routing_proposal": f"WITH {_P}, inv AS ({_I}) SELECT invoice_id, CASE WHEN count(*) = 1 THEN min(statement) END AS package, count(*) AS n FROM inv JOIN p ON partner = account WHERE issue_date BETWEEN s AND e GROUP BY 1",
}
