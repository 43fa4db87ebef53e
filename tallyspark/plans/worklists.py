"""Queries of worklists: reasons, waiting, activity, settings, measure rounds, surveys, mails, releases, verifier probes, cases, price codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import finders, worklists
from .staging import table


def open_reasons(spark, sf):
    """One open item a subject, with its reasons; later sign-ups close what is prefixed signup, some clicks close all of one producer."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    k = F.col("event_id")
    reasons = e.where("event_type in ('error', 'signup')").select(F.col("user_id").alias("subject"), F.concat("event_type", F.lit(":"), (k % 4).cast("string")).alias("reason"), F.concat(F.lit("p"), (k % 2).cast("string")).alias("producer"), k.alias("at"))
    closings = e.where("event_type = 'purchase'").select(F.col("user_id").alias("subject"), F.when(k % 3 == 0, "signup").otherwise("error:1").alias("prefix"), F.when(k % 2 == 0, "p1").alias("producer"), k.alias("at"))
    return worklists.open_items(reasons, closings)


def waiting_list(spark, sf):
    o, e = table(spark, sf, "orders"), table(spark, sf, "events")
    sources = {
        "order": o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("subject"), F.col("o_orderdate").cast("timestamp").alias("since"), F.when(F.col("o_orderkey") % 3 == 0, "anna").when(F.col("o_orderkey") % 3 == 1, "bela").alias("assignee")),
        "event": e.where("event_type = 'error'").select(F.col("event_id").alias("subject"), F.col("ts").cast("timestamp").alias("since"), F.when(F.col("event_id") % 2 == 0, "anna").alias("assignee")),
    }
    return worklists.waiting(sources, "anna").select("kind", "subject", F.date_format("since", "yyyy-MM-dd").alias("since"), "assignee")


def activity_of_day(spark, sf):
    """What every actor did on the last day of all."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("actor"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("at"))
    day = e.agg(F.max(F.to_date("at"))).first()[0]
    return worklists.activity(e, F.lit(day)).select("actor", "kind", "n", F.date_format("first", "HH:mm:ss").alias("first"), F.date_format("last", "HH:mm:ss").alias("last"))


def settings_layers(spark, sf):
    """Settings by product in three layers; some are taken away again."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    rows = p.select(F.col("p_brand").alias("name"), (k % 3).cast("int").alias("layer"), F.when(k % 4 > 0, F.col("p_size").cast("string")).alias("value"), k)
    one = rows.groupBy("name", "layer").agg(F.max_by("value", "p_partkey").alias("value"))
    return worklists.layered(one)


def rule_versions(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select((F.col("user_id") % 50).alias("path"), F.col("event_id").alias("at"), "event_type").withColumn("content", F.concat(F.lit("rule "), "event_type")).drop("event_type")
    return worklists.versions(rows)


def _golden(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    kinds = F.explode(F.array(F.struct(F.lit("total").alias("field"), F.lit("money").alias("kind"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("value")), F.struct(F.lit("phone").alias("field"), F.lit("phone").alias("kind"), F.concat(F.lit("+36 1 "), F.lpad((k % 10_000_000).cast("string"), 7, "0")).alias("value")), F.struct(F.lit("clerk").alias("field"), F.lit("text").alias("kind"), F.col("o_orderpriority").alias("value"))))
    golden = o.select(k.alias("case_id"), kinds.alias("g")).select("case_id", "g.*")
    n, f = F.col("case_id"), F.col("field")
    value = F.when(n % 9 == 0, F.concat(F.lit("9"), "value")).when(f == "money", F.concat("value", F.lit("0"))).when(f == "phone", F.concat(F.lit("06-1-"), F.right("value", F.lit(7)))).otherwise(F.lower("value"))
    return golden, golden.where(n % 7 > 0).select("case_id", "field", value.alias("value"))


def measure_rounds(spark, sf):
    golden, answers = _golden(spark, sf)
    return worklists.measure_round(golden, answers, ["", "1", "32/total"])


def quote_scores(spark, sf):
    golden, answers = _golden(spark, sf)
    return worklists.field_accuracy(golden, answers)


def statement_survey(spark, sf):
    o = table(spark, sf, "orders")
    found = o.select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("statement"), F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 90).cast("int")).alias("end"))
    held = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("statement"))
    return worklists.survey(found.unionByName(found.where("statement % 5 = 0")), held, F.lit("1995-02-01").cast("date"), F.lit("1996-03-31").cast("date"))


def email_route(spark, sf):
    c = table(spark, sf, "conversations")
    mails = c.groupBy(F.col("conv_id").alias("mail_id")).agg(F.max(F.length("text")).alias("n")).select("mail_id", F.when(F.col("n") % 3 == 0, "order").when(F.col("n") % 3 == 1, "question").otherwise("other").alias("intent"), (F.col("n") % 10 / 10).alias("confidence"))
    words = c.select(F.col("conv_id").alias("mail_id"), F.when(F.contains(F.lower("text"), F.lit("password")), "secret").when(F.length("text") % 50 == 0, "phishing").alias("signal")).where("signal is not null")
    files = c.where("conv_id % 3 > 0").select(F.col("conv_id").alias("mail_id"), F.when(F.col("turn") % 4 == 0, "pdf").otherwise("image").alias("kind"))
    got = worklists.mail_route(mails, words, files, {"phishing": "security", "secret": "privacy"}, {"order": "orders", "question": "desk"}, {"pdf": "documents", "image": "scans"})
    return got.groupBy("route", "by").agg(F.count("*").alias("n"))


def release_marks(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    items = o.select(F.col("o_custkey").alias("package"), k.alias("item"), F.col("o_orderstatus").alias("result"), (k % 5 > 0).alias("releasable"))
    last = worklists.release_state(items, items.select("package", F.lit(1).alias("version"), F.lit("").alias("mark")).limit(0)).where("mark is not null")
    released = last.where("package % 3 > 0").select("package", F.lit(1).alias("version"), F.lit("old").alias("mark")).unionByName(last.where("package % 3 = 1").select("package", F.lit(2).alias("version"), "mark"))
    return worklists.release_state(items, released)


def perturbed_records(spark, sf):
    """A verifier that holds records against the printed lines, probed with broken ones."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("total"), F.to_date("o_orderdate").alias("day"), "o_orderpriority")
    printed = o.select(F.col("o_orderkey").alias("k"), F.concat_ws(" ", F.lit("total"), F.col("total").cast("string"), F.lit("on"), F.date_format("day", "yyyy-MM-dd"), F.lit("for"), "o_orderpriority", F.lit("end")).alias("line"))
    broken = worklists.broken_variants(o, "total", "day", "o_orderpriority").join(printed, F.col("o_orderkey") == F.col("k"))
    stands = lambda x: F.coalesce(F.contains("line", F.concat(F.lit(" "), x, F.lit(" "))), F.lit(False))
    flag = ~(stands(F.col("total").cast("string")) & stands(F.date_format("day", "yyyy-MM-dd")) & stands(F.col("o_orderpriority")))
    return worklists.flag_rates(broken.select("variant", flag.alias("flag")))


def case_lists(spark, sf):
    c, e = table(spark, sf, "customer"), table(spark, sf, "events")
    cases = c.select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("opened_by"))
    moves = e.where("event_type = 'click'").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("at"), F.concat(F.lit("desk"), (F.col("event_id") % 5).cast("string")).alias("to"))
    facts = e.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("name"))
    return worklists.case_list(cases, moves, facts, ["purchase", "signup", "error"])


def price_code_match(spark, sf):
    """Order lines that write a part's code, some of them two codes and some only a piece of one."""
    o, p = table(spark, sf, "orders"), table(spark, sf, "part")
    k = F.col("o_orderkey") % 200 + 1
    code = lambda x: F.concat(F.lit("AX "), x.cast("string"))
    said = F.when(k % 5 == 0, F.concat(F.lit("we want ax-"), k.cast("string"), F.lit(" and AX "), (k + 1).cast("string"))).when(k % 5 == 1, F.concat(F.lit("ax"), k.cast("string"))).otherwise(F.concat(F.lit("3 pieces of ("), code(k), F.lit(").")))
    lines = o.select(F.col("o_orderkey").alias("line_id"), said.alias("text"))
    return worklists.code_match(lines, p.select(code(F.col("p_partkey")).alias("sku")))


def candidate_recall(spark, sf):
    """Mails and dates planted behind a document's lines: how many the finders' candidates hold."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    truth = d.select("doc_id", F.explode(F.array(F.struct(F.lit("email").alias("kind"), F.concat(F.lit("p"), k.cast("string"), F.lit("@example.org")).alias("label")), F.struct(F.lit("date").alias("kind"), F.concat(F.lit("2031-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("label")))).alias("t")).select("doc_id", "t.*")
    lines = truth.where((F.col("kind") == "email") | (F.col("doc_id") % 4 > 0)).select("doc_id", F.when(F.col("kind") == "email", 0).otherwise(1).alias("line_no"), F.concat(F.lit("see "), "label").alias("line"))
    return worklists.recall(finders.candidates(lines, "doc_id", "line_no", "line"), truth)


QUERIES = {
    f.__name__: f
    for f in (
        open_reasons, waiting_list, activity_of_day, settings_layers, rule_versions, measure_rounds, quote_scores, statement_survey, email_route, release_marks, perturbed_records, case_lists, price_code_match,
        candidate_recall,
    )
}

_G = "o AS (SELECT o_orderkey AS k, 'total' AS field FROM orders UNION ALL SELECT o_orderkey, 'phone' FROM orders UNION ALL SELECT o_orderkey, 'clerk' FROM orders), g AS (SELECT k, field, k % 7 > 0 AS has, k % 7 > 0 AND (k % 9 > 0 OR field = 'phone') AS ok FROM o)"
ORACLES = {
    "open_reasons": "WITH r AS (SELECT user_id AS s, event_type || ':' || event_id % 4 AS reason, 'p' || event_id % 2 AS producer, event_id AS tick FROM events WHERE event_type IN ('error', 'signup')), c AS (SELECT user_id AS s, CASE WHEN event_id % 3 = 0 THEN 'signup' ELSE 'error:1' END AS prefix, CASE WHEN event_id % 2 = 0 THEN 'p1' END AS producer, event_id AS tick FROM events WHERE event_type = 'purchase') SELECT s AS subject, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, min(tick) AS since FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.s = r.s AND starts_with(r.reason, c.prefix) AND (c.producer IS NULL OR c.producer = r.producer) AND c.tick >= r.tick) GROUP BY 1",
    "waiting_list": "SELECT 'order' AS kind, CAST(o_orderkey AS VARCHAR) AS subject, strftime(o_orderdate, '%Y-%m-%d') AS since, CASE WHEN o_orderkey % 3 = 0 THEN 'anna' END AS assignee FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 3 <> 1 UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), strftime(ts, '%Y-%m-%d'), CASE WHEN event_id % 2 = 0 THEN 'anna' END FROM events WHERE event_type = 'error'",
    "activity_of_day": "SELECT user_id AS actor, event_type AS kind, count(*) AS n, strftime(min(ts), '%H:%M:%S') AS first, strftime(max(ts), '%H:%M:%S') AS last FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY 1, 2",
    "settings_layers": "WITH r AS (SELECT p_brand AS name, CAST(p_partkey % 3 AS INT) AS layer, arg_max(CASE WHEN p_partkey % 4 > 0 THEN CAST(p_size AS VARCHAR) ELSE '-' END, p_partkey) AS v FROM part GROUP BY 1, 2), t AS (SELECT name, max(layer) AS layer, arg_max(v, layer) AS v FROM r GROUP BY 1) SELECT name, v AS value, layer FROM t WHERE v <> '-'",
    "rule_versions": "WITH e AS (SELECT user_id % 50 AS path, event_id AS tick, sha256('rule ' || event_type) AS sha256 FROM events), c AS (SELECT *, sha256 IS DISTINCT FROM lag(sha256) OVER (PARTITION BY path ORDER BY tick) AS fresh FROM e) SELECT path, row_number() OVER (PARTITION BY path ORDER BY tick) AS version, sha256, tick AS since FROM c WHERE fresh",
    "measure_rounds": f"WITH {_G}, s AS (SELECT unnest(['', '1', '32/total']) AS selector) SELECT selector, count(DISTINCT k) AS cases, count(*) FILTER (WHERE has) AS answered, count(*) FILTER (WHERE ok) AS right, CASE WHEN count(*) FILTER (WHERE has) > 0 THEN round(count(*) FILTER (WHERE ok) / count(*) FILTER (WHERE has), 4) END AS scored FROM g JOIN s ON starts_with(k || '/' || field, selector) GROUP BY 1",
    "quote_scores": f"WITH {_G} SELECT field, count(*) AS n, count(*) FILTER (WHERE ok) AS right, round(count(*) FILTER (WHERE ok) / count(*), 4) AS share FROM g GROUP BY 1",
    "statement_survey": "WITH f AS (SELECT o_custkey AS account, o_orderkey AS k, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) AS e FROM orders) SELECT account, count(*) AS statements, count(*) FILTER (WHERE k % 3 = 0) AS held, count(*) FILTER (WHERE k % 3 <> 0) AS fresh, min(s) AS first, max(e) AS last FROM f WHERE s <= DATE '1996-03-31' AND e >= DATE '1995-02-01' GROUP BY 1",
    "email_route": "WITH m AS (SELECT conv_id, max(length(text)) AS n, bool_or(length(text) % 50 = 0 AND NOT contains(lower(text), 'password')) AS phishing, bool_or(contains(lower(text), 'password')) AS secret, bool_or(turn % 4 = 0) AS pdf FROM conversations GROUP BY 1), r AS (SELECT CASE WHEN phishing THEN 'security' WHEN secret THEN 'privacy' END AS s, CASE WHEN n % 10 >= 6 THEN CASE n % 3 WHEN 0 THEN 'orders' WHEN 1 THEN 'desk' END END AS i, CASE WHEN conv_id % 3 > 0 THEN CASE WHEN pdf THEN 'documents' ELSE 'scans' END END AS a FROM m) SELECT coalesce(s, i, a, 'none') AS route, CASE WHEN s IS NOT NULL THEN 'signal' WHEN i IS NOT NULL THEN 'intent' WHEN a IS NOT NULL THEN 'attachment' ELSE 'none' END AS by, count(*) AS n FROM r GROUP BY 1, 2",
    "release_marks": "WITH p AS (SELECT o_custkey AS package, string_agg(o_orderkey || '=' || o_orderstatus, ';' ORDER BY o_orderkey || '=' || o_orderstatus) FILTER (WHERE o_orderkey % 5 > 0) AS content FROM orders GROUP BY 1) SELECT package, sha256(content) AS mark, CASE WHEN content IS NULL THEN 'nothing' WHEN package % 3 = 0 THEN 'new' WHEN package % 3 = 1 THEN 'current' ELSE 'changed' END AS state FROM p",
    "perturbed_records": "WITH o AS (SELECT CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS t, strftime(o_orderdate, '%Y-%m-%d') AS d, extract(day FROM o_orderdate) AS dd, extract(month FROM o_orderdate) AS mm FROM orders), x AS (SELECT unnest([{'v': 'same', 'f': false}, {'v': 'scaled', 'f': true}, {'v': 'missing', 'f': true}, {'v': 'digits', 'f': t[1] <> t[2]}, {'v': 'month', 'f': dd <= 12 AND dd <> mm}, {'v': 'cut', 'f': true}]) AS s FROM o) SELECT s.v AS variant, count(*) AS n, count(*) FILTER (WHERE s.f) AS flagged, round(count(*) FILTER (WHERE s.f) / count(*), 4) AS rate FROM x GROUP BY 1",
    "case_lists": "WITH h AS (SELECT user_id, arg_max('desk' || event_id % 5, event_id) AS holder, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), f AS (SELECT user_id, bool_or(event_type = 'error') AS e, bool_or(event_type = 'purchase') AS p, bool_or(event_type = 'signup') AS s FROM events GROUP BY 1) SELECT c_custkey AS case_id, coalesce(holder, c_mktsegment) AS holder, coalesce(n, 0) AS handovers, concat_ws(',', CASE WHEN NOT coalesce(e, false) THEN 'error' END, CASE WHEN NOT coalesce(p, false) THEN 'purchase' END, CASE WHEN NOT coalesce(s, false) THEN 'signup' END) AS missing FROM customer LEFT JOIN h ON h.user_id = c_custkey LEFT JOIN f ON f.user_id = c_custkey",
    "price_code_match": "WITH o AS (SELECT o_orderkey AS line_id, o_orderkey % 200 + 1 AS k FROM orders) SELECT line_id, CASE WHEN k NOT IN (SELECT p_partkey FROM part) OR k % 5 = 1 OR (k % 5 = 0 AND k + 1 IN (SELECT p_partkey FROM part)) THEN NULL ELSE 'AX ' || k END AS sku FROM o",
    "candidate_recall": "SELECT 'email' AS kind, count(*) AS wanted, count(*) AS found, CAST(1.0 AS DOUBLE) AS recall FROM documents UNION ALL SELECT 'date', count(*), count(*) FILTER (WHERE doc_id % 4 > 0), round(count(*) FILTER (WHERE doc_id % 4 > 0) / count(*), 4) FROM documents",
}
