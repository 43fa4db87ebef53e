"""Queries of evidence: names, tokens, locations, matched lines, tasks, replayed decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import evidence, finders, quotations, rules
from .staging import table


def legal_form_trim(spark, sf):
    s = table(spark, sf, "supplier")
    name = F.concat("s_name", F.when(F.col("s_suppkey") % 3 == 0, F.lit(" Kft. 1111 Budapest")).when(F.col("s_suppkey") % 3 == 1, F.lit(" GmbH")).otherwise(F.lit("")))
    return s.select("s_suppkey", evidence.trim_after_legal_form(name).alias("name"))


def placeholder_values(spark, sf):
    p = table(spark, sf, "part")
    v = F.when(F.col("p_partkey") % 4 == 0, "N/A").when(F.col("p_partkey") % 4 == 1, " -- ").otherwise(F.col("p_name"))
    unit = F.when(F.col("p_partkey") % 2 == 0, "kWh").otherwise("m3")
    return p.select("p_partkey", evidence.placeholder(v).alias("placeholder"), evidence.quantity_issue(F.col("p_size"), unit, {"electricity": ["kwh"], "gas": ["m3", "mj"]}, F.when(F.col("p_partkey") % 3 == 0, "electricity").when(F.col("p_partkey") % 3 == 1, "gas").otherwise("water")).alias("wrong_unit"))


def whole_tokens(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("t"))
    raw = F.left("t", F.length("t") - 3)
    line = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("sum "), raw, F.lit(" end"))).otherwise(F.concat(F.lit("sum "), F.col("t")))
    return o.select("o_orderkey", evidence.whole_token(raw, line).alias("whole"))


def field_equality(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("m"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), "o_orderpriority")
    k = F.element_at(F.array(*[F.lit(x) for x in ("money", "date", "name", "id", "text")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    got = F.when(k == "money", F.concat("m", F.lit("00"))).when(k == "date", F.concat("d", F.lit("T00:00"))).when(k == "name", F.lower("o_orderpriority")).when(k == "id", F.replace("o_orderpriority", F.lit("-"), F.lit(" "))).otherwise(F.lower("o_orderpriority"))
    want = F.when(k == "money", F.col("m")).when(k == "date", F.col("d")).otherwise(F.col("o_orderpriority"))
    return o.select(k.alias("kind"), evidence.field_equal(k, got, want).alias("equal")).groupBy("kind", "equal").agg(F.count("*").alias("n"))


def value_locations(spark, sf):
    d = table(spark, sf, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    values = d.select("doc_id", F.explode(F.array(F.get(words, F.lit(2)), F.concat_ws(" ", F.get(words, F.lit(5)), F.get(words, F.lit(6))), F.array_join(F.slice(words, 10, 6), " "))).alias("value"))
    return evidence.value_locations(lines, values, "doc_id", "line_no", "line").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("line_no").cast("long").alias("first_line"))


def read_values(spark, sf):
    """Orders' totals and days, printed in many notations, found by what they read as."""
    o = table(spark, sf, "orders")
    k, t, d = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)"), F.to_date("o_orderdate")
    english = F.format_number(t, 2)
    money = F.when(k % 4 == 0, F.translate(english, ",.", " ,")).when(k % 4 == 1, F.translate(english, ",.", ".,")).when(k % 4 == 2, english).otherwise(t.cast("string"))
    day = F.when(k % 3 == 0, d.cast("string")).when(k % 3 == 1, F.date_format(d, "yyyy.MM.dd.")).otherwise(F.concat(F.dayofmonth(d).cast("string"), F.lit(" March "), F.year(d).cast("string")))
    lines = o.select("o_orderkey", F.lit(0).alias("line_no"), F.concat_ws(" ", F.lit("please pay"), F.concat(F.lit("("), money, F.lit(");")), F.lit("until"), day, F.lit("ok")).alias("line"))
    march = F.when(k % 3 == 2, F.make_date(F.year(d), F.lit(3), F.dayofmonth(d))).otherwise(d)
    values = o.select("o_orderkey", F.explode(F.array(F.struct(t.cast("string").alias("value"), F.lit("money").alias("kind")), F.struct(march.cast("string").alias("value"), F.lit("day").alias("kind")))).alias("x")).select("o_orderkey", "x.value", "x.kind")
    return evidence.read_locations(lines, values, "o_orderkey", "line_no", "line").select("o_orderkey", "value", F.col("first_word").cast("long").alias("first_word"), F.col("words").cast("long").alias("words"))


def labelled_locations(spark, sf):
    """Net and gross amounts on one line, each with the label nearest before it."""
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") * 3 + 10).cast("string").alias("net"), (F.col("c_custkey") * 3 + 11).cast("string").alias("gross"))
    lines = c.select("c_custkey", F.lit(0).alias("line_no"), F.concat_ws(" ", F.lit("for you net"), "net", F.lit("and so gross"), "gross").alias("line"))
    values = c.select("c_custkey", F.explode(F.array("net", "gross")).alias("value"))
    found = evidence.value_locations(lines, values, "c_custkey", "line_no", "line")
    labels = c.select("c_custkey", F.lit(0).alias("line_no"), F.explode(F.array(F.struct(F.lit(2).alias("at"), F.lit("net").alias("label")), F.struct(F.lit(6).alias("at"), F.lit("gross").alias("label")))).alias("x")).select("c_custkey", "line_no", "x.at", "x.label")
    return evidence.nearest_label(found, labels, "c_custkey").select("c_custkey", "value", "label")


def statement_line_match(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("statement"), (F.col("l_orderkey") * 100_000 + F.col("l_partkey")).alias("id"), F.col("l_returnflag").alias("flag"), F.concat_ws(" ", F.lit("part"), F.col("l_partkey").cast("string"), "l_linestatus").alias("text")).dropDuplicates(["id"])
    new = li.where("id % 11 <> 0").withColumn("id", F.col("id") + 1_000_000_000_000)
    return evidence.match_lines(li, new, ["flag"]).groupBy((F.col("new_id") - F.col("old_id") == 1_000_000_000_000).alias("own")).agg(F.count("*").alias("n"))


def _tasks(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("mail_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("task_id"), F.when(F.col("turn") % 5 == 4, "/nowhere").otherwise("/body").alias("pointer"), F.when(F.col("turn") % 3 == 0, F.lit("not there at all")).otherwise(F.left("text", F.lit(12))).alias("quote"), F.lit("reply").alias("action"), F.lit("2026-01-01").alias("deadline"), F.col("role").alias("assignee"), F.concat(F.lit(" Title"), (F.col("turn") % 4).cast("string")).alias("title"))


def _mails(spark, sf):
    c = table(spark, sf, "conversations")
    return c.groupBy(F.col("conv_id").alias("mail_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("body"), F.lit("subject").alias("subject"))


def task_gate(spark, sf):
    return evidence.gate(_tasks(spark, sf), _mails(spark, sf))


def task_merge(spark, sf):
    return evidence.merged_tasks(_tasks(spark, sf).withColumn("quote", F.concat_ws(" ", "quote", F.col("task_id").cast("string")))).groupBy("mail_id").agg(F.count("*").alias("tasks"), F.sum("merged").alias("merged"))


def decision_replay(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", F.when(F.col("value") < 20, "no").when(F.col("value") > 60, "yes").otherwise("uncertain").alias("outcome"))
    return evidence.replay(e, F.when(F.col("value") < 25, "no").when(F.col("value") > 60, "yes").otherwise("uncertain")).groupBy("change", "outcome", "now").agg(F.count("*").alias("n"))


def decision_journal(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("revision"), F.round("value").cast("long").alias("value"))
    return evidence.journal_state(e, ["user_id", "event_type"], "revision")


def versions_active(spark, sf):
    """The active version of each thing: the latest that is neither draft nor retired."""
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("version"), F.element_at(F.array(F.lit("draft"), F.lit("active"), F.lit("superseded"), F.lit("retired")), (F.col("event_id") % 4 + 1).cast("int")).alias("state"))
    return e.groupBy("user_id").agg(F.max("version").alias("latest"), F.max(F.when(F.col("state") == "active", F.col("version"))).alias("active"))


def quotes_on_pages(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    part = F.substring("text", F.floor(F.length("text") / 2).cast("int") + 1, F.lit(40))  # from the middle of the page
    quote = F.when(F.col("doc_id") % 3 == 0, part).when(F.col("doc_id") % 3 == 1, F.regexp_replace(part, " ", "- ")).otherwise(F.lit("nowhere to be found 12345"))
    return d.select("doc_id", finders.quote_on_page(quote, F.col("text")).alias("found"))


def rough_quotes(spark, sf):
    """A misread passage of every document, sought on all pages of its source: no SQL, as its edits are counted letter by letter; the tests count them plainly."""
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    part = F.substring("text", F.floor(F.length("text") / 2).cast("int") + 1, F.lit(60))
    misread = F.replace(F.replace(F.regexp_replace(part, " ", "- "), F.lit("m"), F.lit("rn")), F.lit("l"), F.lit("1"))
    quotes = d.select(F.col("doc_id").alias("quote_id"), "source", misread.alias("quote"))
    return quotations.rough_quotes(quotes, d.select(F.col("doc_id").alias("page_id"), "source", F.col("text").alias("page")), "source")


def local_day_bounds(spark, sf):
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    b = dates.day_bounds(F.col("day"), "Asia/Tokyo")
    return o.select("day", F.date_format(b["start"], "yyyy-MM-dd HH:mm").alias("start"), F.date_format(b["end"], "yyyy-MM-dd HH:mm").alias("end"))


def predicate_operators(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 6 > 0, F.col("c_nationkey")).alias("n"), F.array("c_mktsegment", F.lit("X")).alias("codes"))
    tests = {"eq": ("n", 5, 0), "ne": ("n", 5, 0), "in": ("n", [1, 2], 0), "not_in": ("n", [1, 2], 0), "lt": ("n", 5, 0), "lte": ("n", 5, 0), "gt": ("n", 5, 0), "gte": ("n", 5, 0), "between": ("n", [3, 9], 0), "present": ("n", True, 0), "absent": ("n", True, 0)}
    out = None
    for op, (name, want, as_list) in [*tests.items(), ("set_in", ("codes", ["BUILDING", "Y"], 1)), ("set_not_in", ("codes", ["BUILDING", "Y"], 1))]:
        one = c.agg(F.count_if(F.coalesce(rules.holds(op.removeprefix("set_"), F.col(name), want, bool(as_list)), F.lit(False))).alias("n")).select(F.lit(op).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def combined_fx_split(spark, sf):
    """A line's amount shared among invoices in proportion to their converted amounts; rounding goes to the last."""
    from pyspark.sql import Window

    li = table(spark, sf, "lineitem").select("l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")).alias("n"), F.col("l_extendedprice").cast("decimal(18,2)").alias("w"))
    w = Window.partitionBy("l_orderkey")
    share = F.bround((F.lit(100).cast("decimal(9,2)") * F.col("w")).cast("decimal(28,4)") / F.sum("w").over(w).cast("decimal(18,2)"), 2).cast("decimal(18,2)")
    rows = li.withColumn("last", F.col("n") == F.max("n").over(w)).withColumn("share", share)
    before = F.sum(F.when(~F.col("last"), F.col("share")).otherwise(0)).over(w)
    return rows.select("l_orderkey", "n", F.when(F.col("last"), 100 - before).otherwise(F.col("share")).cast("decimal(18,2)").alias("share")).groupBy("l_orderkey").agg(F.sum("share").cast("decimal(18,2)").alias("total"), F.min("share").cast("decimal(18,2)").alias("least"))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}

ORACLES = {
    "read_values": "WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS t, CAST(o_orderdate AS DATE) AS d FROM orders), m AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 1 + (length(CAST(CAST(floor(t) AS BIGINT) AS VARCHAR)) - 1) // 3 ELSE 1 END AS n FROM o) SELECT o_orderkey, CAST(t AS VARCHAR) AS value, CAST(2 AS BIGINT) AS first_word, n AS words FROM m UNION ALL SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 2 THEN make_date(year(d), 3, day(d)) ELSE d END AS VARCHAR), 3 + n, CASE WHEN o_orderkey % 3 = 2 THEN 3 ELSE 1 END FROM m",
    "legal_form_trim": "SELECT s_suppkey, s_name || CASE s_suppkey % 3 WHEN 0 THEN ' Kft.' WHEN 1 THEN ' GmbH' ELSE '' END AS name FROM supplier",
    "placeholder_values": "SELECT p_partkey, p_partkey % 4 < 2 AS placeholder, CASE p_partkey % 3 WHEN 0 THEN p_partkey % 2 <> 0 WHEN 1 THEN p_partkey % 2 = 0 END AS wrong_unit FROM part",
    "whole_tokens": "SELECT o_orderkey, o_orderkey % 2 = 0 AS whole FROM orders",
    "field_equality": "SELECT kind, equal, count(*) AS n FROM (SELECT ['money', 'date', 'name', 'id', 'text'][o_orderkey % 5 + 1] AS kind, CASE WHEN o_orderkey % 5 < 4 THEN true ELSE lower(o_orderpriority) = o_orderpriority END AS equal FROM orders) GROUP BY 1, 2",
    "value_locations": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), x AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, list_transform(list_filter(regexp_split_to_array(unnest(ls), '\\s+'), lambda w: w <> ''), lambda w: lower(regexp_replace(w, '[^\\pL\\pN]', '', 'g'))) AS w FROM l), r AS (SELECT doc_id, line_no, i, n, array_to_string(w[i + 1 : i + n], '') AS k FROM (SELECT doc_id, line_no, w, unnest(range(len(w))) AS i FROM x), range(1, 13) u(n) WHERE i + n <= len(w) AND w[i + 1] <> '' AND w[i + n] <> ''), d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents), v AS (SELECT DISTINCT doc_id, v AS value, lower(regexp_replace(v, '[^\\pL\\pN]', '', 'g')) AS k FROM (SELECT doc_id, unnest([w[3], concat_ws(' ', w[6], w[7]), array_to_string(w[10:15], ' ')]) AS v FROM d) WHERE v IS NOT NULL) SELECT r.doc_id, count(*) AS n, min(line_no) AS first_line FROM r JOIN v ON r.doc_id = v.doc_id AND r.k = v.k AND v.k <> '' GROUP BY 1",
    "labelled_locations": "SELECT c_custkey, CAST(c_custkey * 3 + 10 AS VARCHAR) AS value, 'net' AS label FROM customer UNION ALL SELECT c_custkey, CAST(c_custkey * 3 + 11 AS VARCHAR), 'gross' FROM customer",
    "task_gate": "SELECT conv_id * 1000 + turn AS task_id, NOT (turn % 5 = 4 OR turn % 3 = 0) AS accepted, CASE WHEN turn % 5 = 4 THEN 'bad_pointer' WHEN turn % 3 = 0 THEN 'quote_absent' ELSE '' END AS reasons FROM conversations",
    "decision_replay": "WITH e AS (SELECT CASE WHEN value < 20 THEN 'no' WHEN value > 60 THEN 'yes' ELSE 'uncertain' END AS outcome, CASE WHEN value < 25 THEN 'no' WHEN value > 60 THEN 'yes' ELSE 'uncertain' END AS now FROM events) SELECT CASE WHEN outcome = now THEN 'same' ELSE 'changed' END AS change, outcome, now, count(*) AS n FROM e GROUP BY ALL",
    "decision_journal": "SELECT user_id, event_type, max(event_id) AS revision, CAST(arg_max(round(value), event_id) AS BIGINT) AS value FROM events GROUP BY 1, 2",
    "versions_active": "SELECT user_id, max(event_id) AS latest, max(event_id) FILTER (WHERE event_id % 4 = 1) AS active FROM events GROUP BY 1",
    "quotes_on_pages": "WITH d AS (SELECT doc_id, text, substr(text, length(text) // 2 + 1, 40) AS part FROM documents) SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'printed' WHEN 1 THEN CASE WHEN contains(text, replace(part, ' ', '- ')) THEN 'printed' WHEN regexp_matches(part, '[\\pL\\pN]') THEN 'joined' ELSE 'absent' END ELSE 'absent' END AS found FROM d",
    "local_day_bounds": "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, strftime(CAST(o_orderdate AS DATE) - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS start, strftime(CAST(o_orderdate AS DATE) + INTERVAL 15 HOUR, '%Y-%m-%d %H:%M') AS \"end\" FROM orders",
    "predicate_operators": "WITH c AS (SELECT CASE WHEN c_custkey % 6 > 0 THEN c_nationkey END AS n, c_mktsegment = 'BUILDING' AS b FROM customer), x AS (SELECT unnest([{'op': 'eq', 'h': n = 5}, {'op': 'ne', 'h': n <> 5}, {'op': 'in', 'h': n IN (1, 2)}, {'op': 'not_in', 'h': n NOT IN (1, 2)}, {'op': 'lt', 'h': n < 5}, {'op': 'lte', 'h': n <= 5}, {'op': 'gt', 'h': n > 5}, {'op': 'gte', 'h': n >= 5}, {'op': 'between', 'h': n BETWEEN 3 AND 9}, {'op': 'present', 'h': n IS NOT NULL}, {'op': 'absent', 'h': n IS NULL}, {'op': 'set_in', 'h': b}, {'op': 'set_not_in', 'h': NOT b}]) AS s FROM c) SELECT s.op AS op, count(*) FILTER (WHERE s.h) AS n FROM x GROUP BY 1",
    "combined_fx_split": "WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n, CAST(l_extendedprice AS DECIMAL(18,2)) AS w FROM lineitem), s AS (SELECT *, round_even(100.0 * CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY l_orderkey) AS DOUBLE), 2) AS sh, n = max(n) OVER (PARTITION BY l_orderkey) AS last FROM l), t AS (SELECT l_orderkey, CASE WHEN last THEN 100 - coalesce(sum(CASE WHEN NOT last THEN sh END) OVER (PARTITION BY l_orderkey), 0) ELSE sh END AS share FROM s) SELECT l_orderkey, CAST(100 AS DECIMAL(18,2)) AS total, CAST(round(min(share), 2) AS DECIMAL(18,2)) AS least FROM t GROUP BY 1",
}
