"""Queries of checks, rules, prices, evaluations and costs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evals, relations, rules, validate
from ..operators.rules import Module, Row, Table, Tariff
from .staging import table

#: Derived tables; the same text serves both engines.
CALLS = """SELECT event_id AS call_id, ts, user_id AS scope, event_type AS provider, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'reserved' WHEN 2 THEN 'uncertain' ELSE 'succeeded' END AS status,
    CASE WHEN event_id % 5 IN (1, 2) THEN NULL ELSE CAST(value / 100 AS DECIMAL(18,4)) END AS cost, CAST(value / 50 AS DECIMAL(18,4)) AS max_cost, event_id % 40 AS request FROM {events}"""
JUDGED = """SELECT CAST(floor(event_id / 15) AS BIGINT) AS case_id, CASE WHEN user_id % 2 = 0 THEN 'S' ELSE 'G' END AS flow, event_type AS question, CAST(event_id % 3 + 1 AS INT) AS run_no, CAST(event_id * 37 % 1001 AS DOUBLE) / 1000 AS p,
    CAST(event_id * 53 % 1001 AS DOUBLE) / 1000 AS confidence, concat('L', CAST(event_id % 4 AS STRING)) AS label, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 7 < 5 END AS correct, event_id % 2 = 0 AS flagged FROM {events}"""
LINES = """SELECT l_orderkey AS statement, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS line_no, CASE WHEN l_returnflag = 'R' THEN 'debit' ELSE 'credit' END AS direction, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM {lineitem}"""


def calls(spark, sf):
    return spark.sql(CALLS, events=table(spark, sf, "events"))


def judged(spark, sf):
    return spark.sql(JUDGED, events=table(spark, sf, "events"))


def statement_lines(spark, sf):
    """Lines with the balance printed behind each; every 17th statement has one line's balance misprinted."""
    lines = spark.sql(LINES, lineitem=table(spark, sf, "lineitem"))
    signed = F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    so_far = F.sum(signed).over(Window.partitionBy("statement").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    wrong = F.when((F.col("statement") % 17 == 0) & (F.col("line_no") >= 2), F.lit(5)).otherwise(F.lit(0))
    return lines.withColumn("opening", F.lit(1000).cast("decimal(18,2)")).withColumn("running_balance", (F.lit(1000) + so_far + wrong).cast("decimal(18,2)"))


def running_balance(spark, sf):
    return validate.running_balance(statement_lines(spark, sf), "statement", "line_no", "opening")


def closing_balance(spark, sf):
    lines = statement_lines(spark, sf)
    last = F.max_by("running_balance", "line_no").over(Window.partitionBy("statement"))
    return validate.closing_balance(lines.withColumn("closing", last), "statement", "opening", "closing")


def direction_totals(spark, sf):
    return validate.direction_totals(statement_lines(spark, sf), "statement")


def direction_from_balance(spark, sf):
    rows = validate.directions_from_balances(statement_lines(spark, sf).where("statement % 17 <> 0"), "statement", "line_no")
    return rows.groupBy("direction", "derived").agg(F.count("*").alias("n"))


def _items(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")).alias("n"), F.col("l_quantity").cast("decimal(18,2)").alias("quantity"), F.col("l_extendedprice").cast("decimal(18,2)").alias("net"), F.col("l_tax").cast("decimal(6,4)").alias("vat"), F.col("l_discount").cast("decimal(6,4)").alias("discount"))


def line_total_check(spark, sf):
    items = _items(spark, sf).withColumn("net", F.when((F.col("doc") % 29 == 0) & (F.col("n") == 1), None).otherwise(F.col("net")))
    heads = _items(spark, sf).groupBy("doc").agg((F.sum("net") + F.when(F.col("doc") % 23 == 0, 1).otherwise(0)).cast("decimal(18,2)").alias("total"))
    more = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc")).join(heads, "doc", "left").withColumn("total", F.coalesce("total", F.lit(0).cast("decimal(18,2)")))
    return validate.line_sum(more, items, "doc", "total", "net")


def line_arithmetic(spark, sf):
    i = _items(spark, sf)
    price = (F.round(F.col("net") / F.col("quantity"), 2)).cast("decimal(18,2)")
    gross = F.round(F.col("net") * (1 + F.col("vat")), 2).cast("decimal(18,2)") + F.when(F.col("doc") % 31 == 0, F.col("net") / 20).otherwise(0).cast("decimal(18,2)")
    return i.select("doc", "n", validate.line_arithmetic((price * F.col("quantity")).cast("decimal(28,4)"), F.col("net")).alias("price_ok"), validate.line_arithmetic((F.col("net") * (1 + F.col("vat"))).cast("decimal(28,6)"), gross.cast("decimal(18,2)")).alias("gross_ok"))


def vat_consistency(spark, sf):
    i = _items(spark, sf).groupBy("doc").agg(F.sum("net").cast("decimal(18,2)").alias("net"), F.sum(F.round(F.col("net") * F.col("vat"), 2)).cast("decimal(18,2)").alias("vat"))
    gross = F.when(F.col("doc") % 19 == 0, None).otherwise(F.col("net") + F.col("vat") + F.when(F.col("doc") % 13 == 0, 1).otherwise(0))
    return i.select("doc", validate.vat_code(F.col("net"), F.col("vat"), gross).alias("code"))


def date_order_check(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.to_date("o_orderdate").alias("issue"), F.when(F.col("o_orderkey") % 5 > 0, F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 20 - 3).cast("int"))).alias("due"))
    return o.select("doc", validate.date_order_code(F.col("issue"), F.col("due")).alias("strict"), validate.date_order_code(F.col("issue"), F.col("due"), True).alias("optional"))


def list_checks(spark, sf):
    i = _items(spark, sf).select("doc", F.struct("n", F.when(F.col("n") % 5 == 0, None).otherwise(F.col("quantity")).alias("quantity"), (F.col("net") - 2000).alias("net")).alias("r"))
    grouped = i.groupBy("doc").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    got = validate.list_checks(F.col("rows"), 3, ["quantity"], ["net"])
    return grouped.select("doc", got.alias("g")).select("doc", "g.*")


CUSTOMER_RULES = [
    Row({"balance": {"lt": 0}}, {"verdict": "decline", "reason": "debt"}), Row({"segment": {"in": ["BUILDING", "MACHINERY"]}, "balance": {"gte": 5000}}, {"verdict": "accept", "limit": 9000, "reason": "industry"}),
    Row({"balance": {"between": [1000, 4999]}}, {"verdict": "refer", "limit": 3000, "reason": "middle"}), Row({"segment": {"present": True}, "nation": {"not_in": [3, 7]}}, {"verdict": "accept", "limit": 1000, "reason": "known"}),
]


def _customer_facts(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.when(F.col("c_custkey") % 10 > 0, F.round("c_acctbal").cast("long")).alias("balance"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation"))


def decision_table_first(spark, sf):
    got = Table(CUSTOMER_RULES).decide(_customer_facts(spark, sf))
    return got.select("c_custkey", F.array_join(F.col("matched").cast("array<string>"), ",").alias("matched"), "missing", "verdict", F.col("limit").cast("long").alias("limit"))


def decision_table_collect(spark, sf):
    t = Table(CUSTOMER_RULES, "collect", {"verdict": "worst", "limit": "min", "reason": "union"}, {"verdict": ["accept", "refer", "decline"]})
    got = t.decide(_customer_facts(spark, sf))
    return got.select("c_custkey", F.array_join(F.col("matched").cast("array<string>"), ",").alias("matched"), "missing", "verdict", F.col("limit").cast("long").alias("limit"), F.array_join("reason", ",").alias("reasons"))


def rule_preview(spark, sf):
    """What a candidate version of the rules changes among the decisions made."""
    facts = _customer_facts(spark, sf)
    now, then = Table(CUSTOMER_RULES).decide(facts).select("c_custkey", "verdict"), Table(CUSTOMER_RULES[:2] + CUSTOMER_RULES[3:]).decide(facts).select("c_custkey", F.col("verdict").alias("new_verdict"))
    change = F.when(F.col("verdict").eqNullSafe(F.col("new_verdict")), "same").otherwise("changed")
    return now.join(then, "c_custkey").groupBy(change.alias("change"), "verdict", "new_verdict").agg(F.count("*").alias("n"))


TARIFF = Tariff(
    {"fire": Module("site", "sum_insured", "1.5", ("size",), "100"), "theft": Module("item", "value", "4", (), None)},
    {"size": ("size", [({"lt": 10}, "0.9"), ({"between": [10, 40]}, "1.0"), ({"gt": 40}, "1.25")])}, "1", "10", "500",
)


def _units(spark, sf):
    p = table(spark, sf, "part").select((F.col("p_partkey") % 300).alias("policy"), F.col("p_partkey").alias("unit_id"), F.when(F.col("p_partkey") % 3 == 0, "site").otherwise("item").alias("level"), F.when(F.col("p_partkey") % 47 > 0, F.col("p_size")).alias("size"), (F.round("p_retailprice") * 100).cast("decimal(18,2)").alias("v"))
    return p.select("policy", "unit_id", "level", "size", F.when(F.col("level") == "site", F.col("v")).alias("sum_insured"), F.when(F.col("level") == "item", F.when(F.col("unit_id") % 5 == 0, F.lit(0)).otherwise(F.col("v")).cast("decimal(18,2)")).alias("value"))


def tariff_premium(spark, sf):
    return TARIFF.totals(_units(spark, sf))


def inherited_facts(spark, sf):
    region = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("unit_id"), F.lit(None).cast("string").alias("parent_id"))
    nation = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("unit_id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_id"))
    customer = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("unit_id"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent_id"))
    facts = region.select("unit_id", F.lit("zone").alias("name"), F.col("unit_id").alias("value")).unionByName(nation.where("unit_id like '%1'").select("unit_id", F.lit("zone").alias("name"), F.col("unit_id").alias("value"))).unionByName(customer.where("unit_id like '%7'").select("unit_id", F.lit("zone").alias("name"), F.col("unit_id").alias("value")))
    seen = rules.inherited(region.unionByName(nation).unionByName(customer), facts)
    return seen.where("unit_id like 'c%'").select("unit_id", "value")


TIERS = "SELECT * FROM (VALUES ('Brand#1', 10, 5.00), ('Brand#1', 30, 12.50), ('Brand#2', 20, 7.00), ('Brand#3', 45, 20.00)) AS t(brand, min_quantity, percent)"


def _quote(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("p_brand").alias("brand"), F.col("l_quantity").cast("decimal(10,2)").alias("quantity"), F.col("p_retailprice").cast("decimal(18,2)").alias("unit_price"))
    tiers = spark.sql(TIERS).select("brand", "min_quantity", F.col("percent").cast("decimal(5,2)").alias("percent"))
    return rules.tier_percent(rows, tiers, "brand", "quantity")


def tier_discount(spark, sf):
    return _quote(spark, sf).select("l_orderkey", "l_linenumber", "percent")


def price_quote(spark, sf):
    return rules.price(_quote(spark, sf), "l_orderkey")


def word_options(spark, sf):
    """All parts against the price list, which has one item for each type of parts."""
    p = table(spark, sf, "part")
    wanted = p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    items = p.groupBy("p_type").agg(F.min("p_partkey").alias("sku"))
    return rules.word_options(wanted, items, "p_partkey", "text", "sku", "p_type", 3)


def confidence_band(spark, sf):
    j = judged(spark, sf)
    probs = F.create_map(F.lit("a"), F.col("p"), F.lit("b"), F.round(1 - F.col("p"), 3))
    return j.select("case_id", "question", "run_no", rules.noul_band(F.col("p")).alias("noul"), rules.choice_band(F.col("confidence"), probs).alias("choice")).groupBy("noul", "choice").agg(F.count("*").alias("n"))


def band_by_prefix(spark, sf):
    bands = spark.sql("SELECT * FROM (VALUES ('MACH'), ('MACHINERY'), ('A'), ('AUTO'), ('')) AS t(prefix)")
    c = table(spark, sf, "customer")
    return rules.longest_prefix(c.select("c_custkey", "c_mktsegment"), "c_mktsegment", bands, "prefix").groupBy("c_mktsegment", "prefix").agg(F.count("*").alias("n"))


def review_route(spark, sf):
    j = judged(spark, sf)
    reasons = rules.latch(F.when(F.col("confidence") < 0.6, "low_confidence"), F.when(~F.coalesce("correct", F.lit(True)), "check_failed"), F.when(F.col("flagged"), "flagged"), F.when(F.col("p") < 0.1, "low_confidence"))
    return j.select(F.array_join(reasons, ",").alias("reasons"), rules.route(reasons).alias("route")).groupBy("reasons", "route").agg(F.count("*").alias("n"))


def quick_review_groups(spark, sf):
    o = table(spark, sf, "orders")
    group = rules.first_group([("sure_pairs", F.col("o_orderkey") % 3 == 0), ("earlier", F.col("o_orderpriority") == "1-URGENT"), ("expects_invoice", F.col("o_totalprice") > 200000)])
    return o.groupBy(group.alias("group"), F.col("o_orderstatus").alias("currency")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("total"))



def eval_per_question(spark, sf):
    return evals.per_question(judged(spark, sf), rules.choice_band(F.col("confidence")))


EDGES = [0.0, 0.2, 0.4, 0.6, 0.7, 0.8, 0.9, 1.0]


def calibration_bins(spark, sf):
    return evals.calibration(judged(spark, sf), EDGES, ["flow"])


def calibration_ece(spark, sf):
    return calibration_bins(spark, sf).groupBy("flow").agg(F.round(F.sum("weighted_gap"), 4).alias("ece"), F.sum("n").alias("n"))


def determinism(spark, sf):
    return evals.determinism(judged(spark, sf))


def silent_errors(spark, sf):
    return evals.silent_errors(judged(spark, sf))


def policy_reeval(spark, sf):
    return evals.policy_reeval(judged(spark, sf), rules.choice_band(F.col("confidence")))


def confidence_gap(spark, sf):
    return evals.confidence_gap(judged(spark, sf), 0.6)


def token_confidence(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("field"), F.col("event_id").alias("pos"), (-F.col("value") / 1000).alias("logprob"))
    return evals.token_confidence(e, ["user_id", "field"])


def field_scoring(spark, sf):
    o = table(spark, sf, "orders")
    want = relations.long_form(o.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string").alias("o_custkey")), ["o_orderkey"], ["o_orderstatus", "o_orderpriority", "o_custkey"]).withColumnRenamed("value", "want")
    got = want.where("o_orderkey % 10 <> 3").withColumn("have", F.when(F.col("o_orderkey") % 4 == 0, F.lower("want")).when(F.col("o_orderkey") % 9 == 0, F.lit("x")).otherwise(F.col("want"))).select("o_orderkey", "field", "have")
    return evals.field_scores(want, got, ["o_orderkey"], F.lower("want") == F.lower("have"))


def lenient_scoring(spark, sf):
    """Suppliers' names, addresses and balances as recognised: without accents, in capitals, with other signs, wrong, or missing."""
    u, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    shown = F.concat(F.lit("Árvíztűrő "), "s_name", F.lit(", Kft."))
    misread = F.concat(F.lit("ARVIZTURO "), F.upper("s_name"), F.lit(" KFT"))
    seen = F.when(k % 4 == 0, misread).when(k % 4 == 1, shown).when(k % 4 == 2, F.concat(F.lit("x"), shown))
    fields = [F.struct(F.lit(kind).alias("field"), shown.alias("want"), seen.alias("have")) for kind in ("name", "address", "iban")]
    rows = u.select("s_suppkey", F.explode(F.array(*fields)).alias("f")).select("s_suppkey", "f.*")
    strict = F.col("want") == F.col("have")
    want, got = rows.select("s_suppkey", "field", "want"), rows.where("have is not null").select("s_suppkey", "field", "have")
    exact = evals.field_scores(want, got, ["s_suppkey"], strict).select("field", "n", "found", F.col("right").alias("strict"))
    loose = evals.field_scores(want, got, ["s_suppkey"], evals.lenient_equal(F.col("field"), F.col("want"), F.col("have"), strict)).select("field", F.col("right").alias("lenient"))
    return exact.join(loose, "field")


def cost_rollup(spark, sf):
    return evals.costs(calls(spark, sf), ["scope", "provider"])


def plan_vs_actual(spark, sf):
    c = calls(spark, sf)
    plan = c.where("call_id % 2 = 0 and provider <> 'signup'").groupBy("provider").agg(F.sum("max_cost").cast("decimal(18,4)").alias("planned"))
    actual = c.where("provider <> 'view'").groupBy("provider").agg(F.sum("cost").cast("decimal(18,4)").alias("actual"))
    return plan.join(actual, "provider", "full")


def budget_commitment(spark, sf):
    budgets = table(spark, sf, "customer").where("c_custkey <= 150").select(F.col("c_custkey").alias("scope"), F.round("c_acctbal").cast("decimal(18,4)").alias("limit_usd"))
    return evals.committed(calls(spark, sf), budgets, ["scope"])


def calls_per_minute(spark, sf):
    return evals.calls_in_window(calls(spark, sf), "scope", "ts", 86400).select("call_id", "recent")


def call_reuse_lookup(spark, sf):
    return evals.reused(calls(spark, sf), ["request", "provider"], "ts", "call_id").select("call_id", "reused_from")


def budget_replay(spark, sf):
    return evals.replay_budget(calls(spark, sf), "scope", ["call_id"], "40").groupBy("scope").agg(F.count_if("granted").alias("granted"), F.count("*").alias("n"))


def group_counts(spark, sf):
    return calls(spark, sf).groupBy("provider", "status").agg(F.count("*").alias("n"), F.max("call_id").alias("last"), F.min("call_id").alias("first"))


def having_all_removed(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_orderkey").agg(F.every(F.col("l_returnflag") == "R").alias("all_removed")).where("all_removed").select("l_orderkey")


def distinct_counts(spark, sf):
    return calls(spark, sf).groupBy("provider").agg(F.countDistinct("scope").alias("scopes"), F.countDistinct("request").alias("requests"))


def conditional_aggregates(spark, sf):
    return calls(spark, sf).groupBy("scope").agg(F.count_if(F.col("status") == "reserved").alias("open"), F.round(F.avg(F.when(F.col("status") == "succeeded", F.col("cost").cast("double"))), 4).alias("mean_cost"))


def group_concat_ordered(spark, sf):
    return spark.sql("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {n} GROUP BY n_regionkey", n=table(spark, sf, "nation"))


def state_counts(spark, sf):
    return calls(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        running_balance, closing_balance, direction_totals, direction_from_balance, line_total_check, line_arithmetic, vat_consistency, date_order_check, list_checks, decision_table_first, decision_table_collect, rule_preview,
        tariff_premium, inherited_facts, tier_discount, price_quote, word_options, confidence_band, band_by_prefix, review_route, quick_review_groups, eval_per_question, calibration_bins, calibration_ece, determinism, silent_errors,
        policy_reeval, confidence_gap, token_confidence, field_scoring, lenient_scoring, cost_rollup, plan_vs_actual, budget_commitment, calls_per_minute, call_reuse_lookup, budget_replay, group_counts, having_all_removed, distinct_counts,
        conditional_aggregates, group_concat_ordered, state_counts,
    )
}

_C, _J = f"c AS ({CALLS.format(events='events')})", f"j AS ({JUDGED.format(events='events')})"
_L = f"""l0 AS ({LINES.format(lineitem='lineitem')}), l AS (SELECT *, CAST(1000 + sum(CASE direction WHEN 'credit' THEN amount ELSE -amount END) OVER (PARTITION BY statement ORDER BY line_no) + CASE WHEN statement % 17 = 0 AND line_no >= 2 THEN 5 ELSE 0 END AS DECIMAL(18,2)) AS bal FROM l0)"""
_IT = "i AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n, CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS net, CAST(l_tax AS DECIMAL(6,4)) AS vat FROM lineitem)"
_F = "f AS (SELECT c_custkey, CASE WHEN c_custkey % 10 > 0 THEN CAST(round(c_acctbal) AS BIGINT) END AS b, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS s, c_nationkey AS n FROM customer), r AS (SELECT *, b < 0 AS r1, s IN ('BUILDING', 'MACHINERY') AND b >= 5000 AS r2, b BETWEEN 1000 AND 4999 AS r3, s IS NOT NULL AND n NOT IN (3, 7) AS r4 FROM f)"
_FIRST = "d AS (SELECT c_custkey, CASE WHEN r1 IS NULL THEN 0 WHEN r1 THEN 1 WHEN r2 IS NULL THEN 0 WHEN r2 THEN 2 WHEN r3 IS NULL THEN 0 WHEN r3 THEN 3 WHEN r4 THEN 4 ELSE 9 END AS k FROM r)"
_FIRST2 = "d2 AS (SELECT c_custkey, CASE WHEN r1 IS NULL THEN 0 WHEN r1 THEN 1 WHEN r2 IS NULL THEN 0 WHEN r2 THEN 2 WHEN r4 THEN 4 ELSE 9 END AS k FROM r)"
_V = "CASE {} WHEN 1 THEN 'decline' WHEN 2 THEN 'accept' WHEN 3 THEN 'refer' WHEN 4 THEN 'accept' END"
_BANDS = "CASE WHEN confidence < 0.6 THEN 'human' WHEN confidence < 0.85 THEN 'uncertain' ELSE 'auto' END"
_BIN = "CASE WHEN p = 1.0 THEN 6 WHEN p < 0.2 THEN 0 WHEN p < 0.4 THEN 1 WHEN p < 0.6 THEN 2 WHEN p < 0.7 THEN 3 WHEN p < 0.8 THEN 4 WHEN p < 0.9 THEN 5 ELSE 6 END"
_CAL = f"WITH {_J}, b AS (SELECT flow, CAST({_BIN} AS BIGINT) AS bin, count(*) AS n, avg(p) AS m, avg(CAST(correct AS INT)) AS h FROM j WHERE run_no = 1 AND correct IS NOT NULL GROUP BY 1, 2)"
_Q = f"""t AS ({TIERS}), q AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DECIMAL(10,2)) AS quantity, CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price, CAST(coalesce((SELECT max(percent) FROM t WHERE t.brand = p_brand AND l_quantity >= min_quantity), 0) AS DECIMAL(5,2)) AS percent FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_U = "u AS (SELECT p_partkey % 300 AS policy, p_partkey % 3 = 0 AS site, CASE WHEN p_partkey % 47 > 0 THEN p_size END AS size, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 = 0 THEN 0 ELSE round(p_retailprice) * 100 END AS v FROM part)"
ORACLES = {
    "running_balance": f"WITH {_L}, x AS (SELECT statement, CAST(line_no AS INT) AS line_no, abs(1000 + sum(CASE direction WHEN 'credit' THEN amount ELSE -amount END) OVER (PARTITION BY statement ORDER BY line_no) - bal) > 0.01 AS off FROM l) SELECT statement, min(CASE WHEN off THEN line_no END) AS first_break FROM x GROUP BY 1",
    "closing_balance": f"WITH {_L}, x AS (SELECT statement, CAST(1000 + sum(CASE direction WHEN 'credit' THEN amount ELSE -amount END) - arg_max(bal, line_no) AS DECIMAL(18,2)) AS difference FROM l GROUP BY 1) SELECT statement, abs(difference) <= 0.01 AS ok, difference FROM x",
    "direction_totals": f"WITH {_L} SELECT statement, CAST(coalesce(sum(amount) FILTER (WHERE direction = 'debit'), 0) AS DECIMAL(18,2)) AS total_debit, CAST(coalesce(sum(amount) FILTER (WHERE direction = 'credit'), 0) AS DECIMAL(18,2)) AS total_credit FROM l GROUP BY 1",
    "direction_from_balance": f"WITH {_L}, x AS (SELECT direction, bal - lag(bal) OVER (PARTITION BY statement ORDER BY line_no) AS s FROM l WHERE statement % 17 <> 0) SELECT direction, CASE WHEN s > 0 THEN 'credit' WHEN s < 0 THEN 'debit' END AS derived, count(*) AS n FROM x GROUP BY 1, 2",
    "line_total_check": f"WITH {_IT}, h AS (SELECT doc, sum(net) + CASE WHEN doc % 23 = 0 THEN 1 ELSE 0 END AS total FROM i GROUP BY doc), s AS (SELECT doc, sum(CASE WHEN doc % 29 = 0 AND n = 1 THEN NULL ELSE net END) AS s, count(*) AS k, count(CASE WHEN doc % 29 = 0 AND n = 1 THEN NULL ELSE net END) AS g FROM i GROUP BY doc) SELECT o_orderkey AS doc, CASE WHEN k IS NULL THEN 'lines.none' WHEN g < k THEN 'lines.incomplete' WHEN abs(s - total) <= greatest(0.02, 0.005 * k) THEN 'lines.total_ok' ELSE 'lines.total_mismatch' END AS code, CAST(s - total AS DECIMAL(18,2)) AS difference FROM orders LEFT JOIN h ON h.doc = o_orderkey LEFT JOIN s ON s.doc = o_orderkey",
    "line_arithmetic": f"WITH {_IT}, x AS (SELECT *, CAST(round(CAST(net AS DOUBLE) / CAST(quantity AS DOUBLE), 2) AS DECIMAL(18,2)) AS price, CAST(round(net * (1 + vat), 2) + CASE WHEN doc % 31 = 0 THEN CAST(CAST(net AS DOUBLE) / 20 AS DECIMAL(18,2)) ELSE 0 END AS DECIMAL(18,2)) AS gross FROM i) SELECT doc, CAST(n AS INT) AS n, abs(price * quantity - net) <= greatest(1, net / 100) AS price_ok, abs(net * (1 + vat) - gross) <= greatest(1, gross / 100) AS gross_ok FROM x",
    "vat_consistency": f"WITH {_IT} SELECT doc, CASE WHEN doc % 19 = 0 THEN 'totals.unparseable' WHEN doc % 13 = 0 THEN 'totals.mismatch' ELSE 'totals.ok' END AS code FROM (SELECT DISTINCT doc FROM i)",
    "date_order_check": "WITH o AS (SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 20 - 3 END AS d FROM orders) SELECT doc, CASE WHEN d IS NULL THEN 'dates.unparseable' WHEN d < 0 THEN 'dates.due_before_issue' ELSE 'dates.ok' END AS strict, CASE WHEN d IS NULL THEN 'dates.no_due' WHEN d < 0 THEN 'dates.due_before_issue' ELSE 'dates.ok' END AS optional FROM o",
    "list_checks": f"WITH {_IT}, r AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY n) AS k, n % 5 = 0 AS miss, net - 2000 <= 0 AS low FROM i) SELECT doc, count(*) >= 3 AS enough, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (WHERE miss), '') AS missing, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (WHERE low), '') AS not_positive FROM r GROUP BY 1",
    "decision_table_first": f"WITH {_F}, {_FIRST} SELECT c_custkey, CASE WHEN k BETWEEN 1 AND 4 THEN CAST(k AS VARCHAR) ELSE '' END AS matched, k = 0 AS missing, {_V.format('k')} AS verdict, CAST(CASE k WHEN 2 THEN 9000 WHEN 3 THEN 3000 WHEN 4 THEN 1000 END AS BIGINT) AS \"limit\" FROM d",
    "decision_table_collect": f"WITH {_F}, c AS (SELECT c_custkey, CASE WHEN r1 IS NULL THEN 0 WHEN r2 IS NULL THEN 1 WHEN r3 IS NULL THEN 2 ELSE 4 END AS upto, r1, r2, r3, r4 FROM r), g AS (SELECT c_custkey, upto < 4 AS missing, r1 AND upto >= 1 AS a, r2 AND upto >= 2 AS b, r3 AND upto >= 3 AS c, r4 AND upto >= 4 AS d FROM c) SELECT c_custkey, concat_ws(',', CASE WHEN a THEN '1' END, CASE WHEN b THEN '2' END, CASE WHEN c THEN '3' END, CASE WHEN d THEN '4' END) AS matched, missing, CASE WHEN a THEN 'decline' WHEN c THEN 'refer' WHEN b OR d THEN 'accept' END AS verdict, CAST(CASE WHEN d THEN 1000 WHEN c THEN 3000 WHEN b THEN 9000 END AS BIGINT) AS \"limit\", concat_ws(',', CASE WHEN a THEN 'debt' END, CASE WHEN b THEN 'industry' END, CASE WHEN d THEN 'known' END, CASE WHEN c THEN 'middle' END) AS reasons FROM g",
    "rule_preview": f"WITH {_F}, {_FIRST}, {_FIRST2} SELECT CASE WHEN {_V.format('d.k')} IS NOT DISTINCT FROM {_V.format('d2.k')} THEN 'same' ELSE 'changed' END AS change, {_V.format('d.k')} AS verdict, {_V.format('d2.k')} AS new_verdict, count(*) AS n FROM d JOIN d2 USING (c_custkey) GROUP BY ALL",
    "tariff_premium": f"WITH {_U}, x AS (SELECT policy, site, CASE WHEN site THEN CASE WHEN size IS NULL THEN NULL ELSE round(v * 1.5 / 1000 * CASE WHEN size < 10 THEN 0.9 WHEN size <= 40 THEN 1.0 ELSE 1.25 END) END ELSE round(v * 4 / 1000) END AS a FROM u WHERE v <> 0), m AS (SELECT policy, site, sum(a) AS s, bool_or(a IS NULL) AS b FROM x GROUP BY 1, 2), w AS (SELECT policy, site FROM (SELECT DISTINCT policy FROM u), (SELECT unnest([true, false]) AS site)), t AS (SELECT policy, sum(greatest(s, CASE WHEN site THEN 100 ELSE 0 END)) AS st, bool_or(coalesce(b, true)) AS blocked FROM w LEFT JOIN m USING (policy, site) GROUP BY 1) SELECT policy, CASE WHEN NOT blocked THEN CAST(st AS DECIMAL(18,2)) END AS subtotal, CASE WHEN NOT blocked THEN CAST(greatest(round(st / 10) * 10, 500) AS DECIMAL(18,2)) END AS total, NOT blocked AND round(st / 10) * 10 < 500 AS minimum_applied, blocked FROM t",
    "inherited_facts": "SELECT 'c' || c_custkey AS unit_id, CASE WHEN c_custkey % 10 = 7 THEN 'c' || c_custkey WHEN n_nationkey % 10 = 1 THEN 'n' || n_nationkey ELSE 'r' || n_regionkey END AS value FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "tier_discount": f"WITH {_Q} SELECT l_orderkey, l_linenumber, percent FROM q",
    "price_quote": f"WITH {_Q}, n AS (SELECT l_orderkey, CAST(sum(round(unit_price * quantity * (100 - percent) * 0.01, 2)) AS DECIMAL(18,2)) AS net FROM q GROUP BY 1) SELECT l_orderkey, net, CAST(round(net * 0.27, 2) AS DECIMAL(18,2)) AS vat, CAST(net + round(net * 0.27, 2) AS DECIMAL(18,2)) AS gross FROM n",
    "word_options": "WITH a AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part), b AS (SELECT min(p_partkey) AS sku, unnest(string_split(lower(p_type), ' ')) AS w FROM part GROUP BY p_type), c AS (SELECT p_partkey, sku, count(*) AS shared FROM a JOIN (SELECT DISTINCT * FROM b) b USING (w) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY shared DESC, sku) AS rank FROM c) SELECT p_partkey, rank, sku, shared FROM r WHERE rank <= 3",
    "confidence_band": f"WITH {_J} SELECT CASE WHEN p < 0.3 THEN 'no' WHEN p > 0.7 THEN 'yes' ELSE 'uncertain' END AS noul, CASE WHEN confidence < 0.6 THEN 'human' WHEN abs(p - round(1 - p, 3)) < 0.2 THEN 'uncertain' WHEN confidence < 0.85 THEN 'uncertain' ELSE 'auto' END AS choice, count(*) AS n FROM j GROUP BY 1, 2",
    "band_by_prefix": "SELECT c_mktsegment, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'MACHINERY' WHEN c_mktsegment LIKE 'AUTO%' THEN 'AUTO' WHEN c_mktsegment LIKE 'A%' THEN 'A' ELSE '' END AS prefix, count(*) AS n FROM customer GROUP BY 1, 2",
    "review_route": f"WITH {_J}, x AS (SELECT concat_ws(',', CASE WHEN confidence < 0.6 THEN 'low_confidence' END, CASE WHEN NOT correct THEN 'check_failed' END, CASE WHEN flagged THEN 'flagged' END, CASE WHEN p < 0.1 AND confidence >= 0.6 THEN 'low_confidence' END) AS reasons FROM j) SELECT reasons, CASE WHEN reasons = '' THEN 'auto' ELSE 'human' END AS route, count(*) AS n FROM x GROUP BY 1",
    "quick_review_groups": "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'sure_pairs' WHEN o_orderpriority = '1-URGENT' THEN 'earlier' WHEN o_totalprice > 200000 THEN 'expects_invoice' ELSE 'rest' END AS \"group\", o_orderstatus AS currency, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total FROM orders GROUP BY 1, 2",
    "eval_per_question": f"WITH {_J}, x AS (SELECT *, {_BANDS} AS band FROM j WHERE run_no = 1) SELECT flow, question, count(*) AS n, count(correct) AS n_scored, count(*) FILTER (WHERE correct) AS correct, round(count(*) FILTER (WHERE correct) / count(correct), 4) AS accuracy, round(avg(p), 4) AS mean, round(stddev_pop(p), 4) AS std, "
    + ", ".join(f"count(*) FILTER (WHERE band = '{b}') AS n_{b}, round(count(*) FILTER (WHERE band = '{b}' AND correct) / count(correct) FILTER (WHERE band = '{b}'), 4) AS accuracy_{b}" for b in ("human", "uncertain", "auto"))
    + " FROM x GROUP BY 1, 2",
    "calibration_bins": f"{_CAL} SELECT flow, bin, n, round(m, 4) AS mean_p, round(h, 4) AS hit_rate, round(n / sum(n) OVER (PARTITION BY flow) * abs(h - m), 6) AS weighted_gap FROM b",
    "calibration_ece": f"{_CAL}, g AS (SELECT flow, n, round(n / sum(n) OVER (PARTITION BY flow) * abs(h - m), 6) AS g FROM b) SELECT flow, round(sum(g), 4) AS ece, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1",
    "determinism": f"WITH {_J}, s AS (SELECT flow, question, case_id, stddev_pop(p) AS s, count(DISTINCT label) AS k FROM j GROUP BY ALL HAVING count(*) > 1) SELECT flow, question, count(*) AS series, round(avg(s), 4) AS mean_std, round(max(s), 4) AS max_std, count(*) FILTER (WHERE k > 1) AS flips FROM s GROUP BY 1, 2",
    "silent_errors": f"WITH {_J}, x AS (SELECT *, NOT correct AND NOT flagged AS q FROM j WHERE run_no = 1 AND correct IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY flow, q ORDER BY case_id, question) AS rn FROM x) SELECT flow, count(*) AS scored, count(*) FILTER (WHERE NOT correct) AS wrong, count(*) FILTER (WHERE NOT correct AND flagged) AS flagged, count(*) FILTER (WHERE q) AS silent, coalesce(string_agg(case_id || ' ' || question, ',' ORDER BY rn) FILTER (WHERE q AND rn <= 10), '') AS silent_cases FROM r GROUP BY 1",
    "policy_reeval": f"WITH {_J}, x AS (SELECT flow, case_id, bool_or(b = 'human') AS h, bool_or(b = 'uncertain') AS u, count(*) FILTER (WHERE b = 'uncertain' AND correct) AS r, count(correct) FILTER (WHERE b = 'uncertain') AS s FROM (SELECT *, {_BANDS} AS b FROM j WHERE run_no = 1) GROUP BY 1, 2) SELECT flow, count(*) AS cases, count(*) FILTER (WHERE h) AS cases_human, count(*) FILTER (WHERE NOT h AND u) AS cases_uncertain_only, round(sum(r) FILTER (WHERE NOT h AND u) / sum(s) FILTER (WHERE NOT h AND u), 4) AS uncertain_only_accuracy FROM x GROUP BY 1",
    "confidence_gap": f"WITH {_J} SELECT flow, count(*) AS n, round(avg(abs(confidence - p)), 4) AS mean_abs_diff, round(max(abs(confidence - p)), 4) AS max_abs_diff, count(*) FILTER (WHERE (confidence < 0.6) <> (p < 0.6)) AS band_differs FROM j WHERE run_no = 1 GROUP BY 1",
    "token_confidence": "SELECT user_id, event_type AS field, round(exp(sum(-value / 1000)), 6) AS joint, round(exp(min(-value / 1000)), 6) AS least, round(exp(arg_min(-value / 1000, event_id)), 6) AS first, count(*) AS n FROM events GROUP BY 1, 2",
    "lenient_scoring": "SELECT f.field, count(*) AS n, count(*) FILTER (WHERE s_suppkey % 4 < 3) AS found, count(*) FILTER (WHERE s_suppkey % 4 = 1) AS strict, count(*) FILTER (WHERE s_suppkey % 4 = 1 OR (s_suppkey % 4 = 0 AND f.field <> 'iban')) AS lenient FROM supplier, (SELECT unnest(['name', 'address', 'iban']) AS field) f GROUP BY 1",
    "field_scoring": "WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 10 <> 3) AS found, count(*) FILTER (WHERE o_orderkey % 10 <> 3 AND NOT (o_orderkey % 9 = 0 AND o_orderkey % 4 <> 0)) AS hit FROM orders) SELECT f.field, n, found, hit AS \"right\", round(hit / n, 4) AS accuracy FROM n, (SELECT unnest(['o_orderstatus', 'o_orderpriority', 'o_custkey']) AS field) f",
    "cost_rollup": f"WITH {_C} SELECT scope, provider, count(*) AS calls, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status IN ('reserved', 'uncertain')) AS open, CAST(coalesce(sum(cost), 0) AS DECIMAL(18,4)) AS usd, CAST(coalesce(sum(max_cost) FILTER (WHERE cost IS NULL), 0) AS DECIMAL(18,4)) AS held_usd FROM c GROUP BY 1, 2",
    "plan_vs_actual": f"WITH {_C}, p AS (SELECT provider, CAST(sum(max_cost) AS DECIMAL(18,4)) AS planned FROM c WHERE call_id % 2 = 0 AND provider <> 'signup' GROUP BY 1), a AS (SELECT provider, CAST(sum(cost) AS DECIMAL(18,4)) AS actual FROM c WHERE provider <> 'view' GROUP BY 1) SELECT coalesce(p.provider, a.provider) AS provider, planned, actual FROM p FULL JOIN a ON p.provider = a.provider",
    "budget_commitment": f"WITH {_C}, u AS (SELECT scope, sum(coalesce(cost, max_cost)) AS s FROM c GROUP BY 1) SELECT c_custkey AS scope, CAST(round(c_acctbal) AS DECIMAL(18,4)) AS limit_usd, CAST(coalesce(s, 0) AS DECIMAL(18,4)) AS committed, CAST(CAST(round(c_acctbal) AS DECIMAL(18,4)) - coalesce(s, 0) AS DECIMAL(18,4)) AS \"left\" FROM customer LEFT JOIN u ON scope = c_custkey WHERE c_custkey <= 150",
    "calls_per_minute": f"WITH {_C}, s AS (SELECT call_id, scope, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM c) SELECT call_id, count(*) OVER (PARTITION BY scope ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent FROM s",
    "call_reuse_lookup": f"WITH {_C}, s AS (SELECT *, CASE WHEN status = 'succeeded' THEN call_id END AS ok FROM c) SELECT call_id, last_value(ok IGNORE NULLS) OVER (PARTITION BY request, provider ORDER BY ts, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reused_from FROM s",
    "group_counts": f"WITH {_C} SELECT provider, status, count(*) AS n, max(call_id) AS last, min(call_id) AS first FROM c GROUP BY 1, 2",
    "having_all_removed": "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'R') = count(*)",
    "distinct_counts": f"WITH {_C} SELECT provider, count(DISTINCT scope) AS scopes, count(DISTINCT request) AS requests FROM c GROUP BY 1",
    "conditional_aggregates": f"WITH {_C} SELECT scope, count(*) FILTER (WHERE status = 'reserved') AS open, round(avg(CAST(cost AS DOUBLE)) FILTER (WHERE status = 'succeeded'), 4) AS mean_cost FROM c GROUP BY 1",
    "group_concat_ordered": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1",
    "state_counts": f"WITH {_C} SELECT status, count(*) AS n FROM c GROUP BY 1",
}
