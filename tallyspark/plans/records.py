"""Queries of nested records, journals, replaced statements, names and copies, rule changes, lost workers, wrapped values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records, relations, worklists
from ..sources import documents
from ..streaming import jobs
from .staging import table


def mask_nested(spark, sf):
    """Texts in lists and maps are masked; a number of sixteen digits and a map's key that looks like a card stay."""
    c = table(spark, sf, "customer")
    card = F.concat(F.lit("4"), F.lpad((F.col("c_custkey") * 15485863).cast("string"), 15, "0"))
    rows = c.select("c_custkey", card.alias("n"), F.struct(F.array(F.concat(F.lit("pays by "), card, F.lit(" or "), card), F.lit("else")).alias("notes"), F.create_map(card, F.struct(card.alias("v"), F.lit(1).alias("k"))).alias("more"), card.cast("long").alias("number")).alias("x"))
    x = records.mask_nested(rows, "x")
    return x.select("c_custkey", F.get("x.notes", F.lit(0)).alias("note"), F.try_element_at("x.more", F.col("n")).getField("v").alias("card"), F.col("x.number").alias("number"))


def deep_diff(spark, sf):
    """Two versions of each document's record, nested and of other kinds here and there: the paths at which they differ."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    row = lambda n, x: F.struct(x.alias("v"), F.struct(F.array(F.lit(n), k % 2).alias("q")).alias("in"))
    head = [k.alias("id"), "lang", F.length("text").alias("n")]
    old = F.to_json(F.struct(*head, F.array(row(0, k % 3), row(1, k % 5)).alias("rows"), F.when(k % 11 == 0, F.lit(1)).alias("more")))
    new = F.to_json(F.struct(*head, F.array(row(0, k % 3), row(1, k % 4), F.when(k % 13 == 0, row(2, k))).alias("rows"), F.when(k % 7 == 0, F.struct(F.lit(1).alias("x"))).alias("more")))
    rows = d.select("doc_id", old.alias("old"), new.alias("new"))
    return records.deep_diff(rows, ["doc_id"], "old", "new")


def journal_conflicts(spark, sf):
    """Every third decision was made on the revision before the one that counted."""
    e = table(spark, sf, "events")
    n = F.row_number().over(relations.Window.partitionBy("user_id").orderBy("event_id"))
    rows = e.select(F.col("user_id").alias("subject"), F.col("event_id").alias("revision"), n.alias("n"))
    last = F.max(F.when(F.col("n") % 3 > 0, F.col("revision"))).over(relations.Window.partitionBy("subject").orderBy("n").rowsBetween(relations.Window.unboundedPreceding, -1))
    rows = rows.withColumn("base", F.when(F.col("n") % 3 > 0, last).otherwise(F.lit(-1)))
    return records.journal(rows)


_STATEMENTS = """SELECT o_orderkey AS statement, o_custkey AS account, CASE WHEN o_orderkey % 10 = 0 THEN 'EUR' ELSE 'HUF' END AS currency, CAST(o_orderdate AS DATE) AS start,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey * 7 % 300 AS INT) AS `end`, o_orderkey % 3 AS rank, o_orderkey % 10 AS seq, o_orderkey % 17 = 0 AS suspicious, o_orderkey % 5 = 0 AS trusted FROM {orders}
    UNION ALL SELECT o_orderkey + 1000000000, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'EUR' ELSE 'HUF' END, CAST(o_orderdate AS DATE),
    CAST(o_orderdate AS DATE) + CAST(o_orderkey * 7 % 300 AS INT), o_orderkey % 3, o_orderkey % 4, o_orderkey % 13 = 0, false FROM {orders} WHERE o_orderkey % 6 = 1"""


def _statements(spark, sf):
    """Statements of accounts, some read twice, with the account's booking of every ninth day on those that hold it (some lack one)."""
    st = spark.sql(_STATEMENTS, orders=table(spark, sf, "orders"))
    day = F.unix_date("day")
    lines = st.select("statement", "account", F.explode(F.sequence("start", "end")).alias("day")).where((day % 9 == F.col("account") % 9) & ((day + F.col("statement") % 1_000_000_000) % 61 != 0))
    lines = lines.select("statement", (F.col("statement") * 100_000 + day).alias("id"), F.concat(F.lit("booking "), day.cast("string")).alias("text"), F.col("day").cast("string").alias("booking_date"), (day % 7).alias("amount"))
    return st, lines


def replacement_resolve(spark, sf):
    """What stands for what, undecided pairs, lines found again and lines left over. Persons choose for and against, also in circles."""
    st, lines = _statements(spark, sf)
    pairs = records.intervals.overlapping(st, ["account", "currency"], "statement").where("(a + b) % 5 = 0")
    choices = pairs.select("a", "b", F.when((F.col("a") + F.col("b")) % 10 == 0, F.col("a")).otherwise(F.col("b")).alias("kept"), F.lit(1).alias("seq"))
    choices = choices.unionByName(pairs.where("a % 7 = 0").select("a", "b", F.col("a").alias("kept"), F.lit(2).alias("seq")))
    got = records.resolved(st, choices, lines, ["booking_date", "amount"])
    none = F.lit(None).cast("string")
    rows = got.replaced.select(F.lit("replaced").alias("kind"), F.col("statement").alias("a"), F.col("stands").alias("b"), "how")
    rows = rows.unionByName(got.conflicts.select(F.lit("conflict").alias("kind"), "a", "b", none.alias("how")))
    rows = rows.unionByName(got.line_map.select(F.lit("line").alias("kind"), F.col("old_id").alias("a"), F.col("new_id").alias("b"), none.alias("how")))
    return rows.unionByName(got.orphans.select(F.lit("orphan").alias("kind"), F.col("line_id").alias("a"), F.col("statement").alias("b"), none.alias("how")))


def name_patterns(spark, sf):
    o = table(spark, sf, "orders")
    values = {"day": F.date_format("o_orderdate", "yyyy-MM-dd"), "status": F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")), "priority": F.regexp_replace("o_orderpriority", "^[0-9]-", "")}
    return o.select("o_orderkey", records.rendered("{day} {status} - {priority}", values, 60).alias("name"))


def copies_manifest(spark, sf):
    p = table(spark, sf, "part")
    got = records.named_copies(p.select("p_partkey", F.lit("out").alias("folder"), F.concat("p_type", F.lit(".pdf")).alias("name")), "p_partkey", "folder", "name", 24)
    return got.select("p_partkey", "path", "manifest")


def rule_change_set(spark, sf):
    """Rule files as of two moments."""
    e = table(spark, sf, "events")
    rows = e.select((F.col("user_id") % 50).alias("path"), F.col("event_id").alias("at"), F.concat(F.lit("rule "), "event_type").alias("content"))
    as_of = lambda most: relations.latest(worklists.versions(rows.where(F.col("at") % 1000 < most)), ["path"], [F.desc("version")])
    return records.rule_changes(as_of(300).where("path % 10 > 0"), as_of(700).where("path % 10 < 9"))


def queue_recovered(spark, sf):
    e = table(spark, sf, "events")
    event = F.when(F.col("event_id") % 4 == 0, "enqueued").when(F.col("event_id") % 4 == 3, "completed").otherwise("claimed")
    log = e.select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 3).cast("long").alias("job_id"), event.alias("event"), F.timestamp_seconds(F.col("event_id") * 60).alias("at"))
    now = F.timestamp_seconds(F.lit(500 * 60))
    return records.recovered(jobs.queue_state(log), log, now, 3600).select("job_id", "status")


def wrapped_values(spark, sf):
    """Names of customers broken over two lines."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    lines = c.select("c_custkey", F.posexplode(F.array(F.concat(F.lit("to Alma "), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise("none")), F.concat(F.lit("Kft. no "), k.cast("string")))).alias("line_no", "line"))
    values = c.select("c_custkey", F.concat(F.lit("Alma "), "c_mktsegment", F.lit(" KFT")).alias("value"))
    return records.wrapped_locations(lines, values, "c_custkey", "line_no", "line").select("c_custkey", F.col("line_no").cast("long").alias("line_no"), F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"))


def stratified_sample(spark, sf):
    return relations.stratified_sample(table(spark, sf, "documents"), "lang", "doc_id", 100).select("doc_id", "lang")


def rates_from_soap(spark, sf):
    """Rates in an answer whose XML is a text inside an envelope."""
    inner = F.concat(F.lit('<R><Day date="'), F.to_date("o_orderdate").cast("string"), F.lit('"><Rate curr="EUR" unit="1">'), (F.lit(380) + F.col("o_orderkey") % 20).cast("string"), F.lit(",5</Rate></Day></R>"))
    escaped = F.replace(F.replace(F.replace(inner, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    answers = table(spark, sf, "orders").select(F.concat(F.lit('<s:Envelope xmlns:s="http://schemas.xmlsoap.org/soap/envelope/"><s:Body><GetRatesResponse><GetRatesResult>'), escaped, F.lit("</GetRatesResult></GetRatesResponse></s:Body></s:Envelope>")).alias("answer"))
    return documents.rates_from_xml(answers.select(documents.soap_result(F.col("answer"), "GetRatesResult").alias("x")), "x").groupBy("currency").agg(F.count("*").alias("n"), F.round(F.avg(F.col("rate").cast("double")), 6).alias("rate"))


QUERIES = {
    f.__name__: f
    for f in (mask_nested, deep_diff, journal_conflicts, replacement_resolve, name_patterns, copies_manifest, rule_change_set, queue_recovered, wrapped_values, stratified_sample, rates_from_soap)
}

_CARD = "c AS (SELECT c_custkey, '4' || lpad(CAST(c_custkey * 15485863 AS VARCHAR), 15, '0') AS n FROM customer), d AS (SELECT c_custkey, n, i, CAST(substr(n, 17 - i, 1) AS INT) AS d FROM c, range(1, 17) t(i)), s AS (SELECT c_custkey, n, sum(CASE WHEN i % 2 = 1 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END) AS s FROM d GROUP BY 1, 2), m AS (SELECT c_custkey, CASE WHEN s % 10 = 0 THEN left(n, 6) || 'xxxxxx' || right(n, 4) ELSE n END AS m FROM s)"
_VERSION = "SELECT user_id % 50 AS path, arg_max('rule ' || event_type, event_id) AS c FROM events WHERE event_id % 1000 < {most} GROUP BY 1"
ORACLES = {
    "mask_nested": f"WITH {_CARD} SELECT c_custkey, 'pays by ' || m || ' or ' || m AS note, m AS card, CAST('4' || lpad(CAST(c_custkey * 15485863 AS VARCHAR), 15, '0') AS BIGINT) AS number FROM m",
    "stratified_sample": "WITH c AS (SELECT lang, count(*) AS c, min(doc_id) AS f FROM documents GROUP BY 1), k AS (SELECT *, least(c, greatest(2, CAST(round_even(100.0 * c / (SELECT count(*) FROM documents), 0) AS BIGINT))) AS k FROM c), z AS (SELECT lang, least(k, 100 - coalesce(sum(k) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS k FROM k), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS n FROM documents) SELECT doc_id, lang FROM r JOIN z USING (lang) WHERE n <= k",
    "deep_diff": "WITH d AS (SELECT doc_id, doc_id % 5 AS a, doc_id % 4 AS b FROM documents) SELECT doc_id, '$.rows[1].v' AS path, CAST(a AS VARCHAR) AS before, CAST(b AS VARCHAR) AS after FROM d WHERE a <> b UNION ALL SELECT doc_id, '$.rows[2]', 'null', '<object>' FROM d WHERE doc_id % 13 = 0 UNION ALL SELECT doc_id, '$.more', CASE WHEN doc_id % 11 = 0 THEN '1' ELSE 'null' END, CASE WHEN doc_id % 7 = 0 THEN '<object>' ELSE 'null' END FROM d WHERE doc_id % 7 = 0 OR doc_id % 11 = 0",
    "journal_conflicts": "WITH e AS (SELECT user_id AS subject, event_id AS revision, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT subject, revision, n % 3 > 0 AS accepted FROM e",
    "replacement_resolve": f"""WITH RECURSIVE p AS ({_STATEMENTS.format(orders="orders").replace("`", '"')}),
        ln AS (SELECT statement, statement * 100000 + (day - DATE '1970-01-01') AS id, day FROM (SELECT statement, account, CAST(unnest(generate_series(start, "end", INTERVAL 1 DAY)) AS DATE) AS day FROM p)
            WHERE (day - DATE '1970-01-01') % 9 = account % 9 AND ((day - DATE '1970-01-01') + statement % 1000000000) % 61 <> 0),
        ov AS (SELECT x AS x, y AS y, x.statement AS a, y.statement AS b, x.rank AS ra, y.rank AS rb FROM p x JOIN p y ON x.account = y.account AND x.currency = y.currency AND x.statement < y.statement AND x.start <= y."end" AND y.start <= x."end"
            WHERE NOT ((y.start = x."end" AND x.start < y.start AND y."end" > x."end") OR (x.start = y."end" AND y.start < x.start AND x."end" > y."end"))),
        lk AS (SELECT ov.*, NOT EXISTS (SELECT 1 FROM ln l WHERE l.statement = a AND NOT EXISTS (SELECT 1 FROM ln m WHERE m.statement = b AND m.day = l.day)) AS b_has_a, NOT EXISTS (SELECT 1 FROM ln l WHERE l.statement = b AND NOT EXISTS (SELECT 1 FROM ln m WHERE m.statement = a AND m.day = l.day)) AS a_has_b FROM ov),
        pk AS (SELECT *, CASE WHEN (a + b) % 5 = 0 THEN CASE WHEN a % 7 = 0 OR (a + b) % 10 = 0 THEN a ELSE b END END AS person,
            CASE WHEN ra = rb AND x.start = y.start AND x."end" = y."end" AND a_has_b AND b_has_a AND NOT (x.suspicious AND y.suspicious) THEN CASE WHEN x.suspicious THEN b WHEN y.suspicious THEN a WHEN (x.seq, a) > (y.seq, b) THEN a ELSE b END END AS again,
            CASE WHEN ra < rb AND x.start <= y.start AND x."end" >= y."end" AND NOT x.suspicious AND (a_has_b OR x.trusted) THEN a WHEN rb < ra AND y.start <= x.start AND y."end" >= x."end" AND NOT y.suspicious AND (b_has_a OR y.trusted) THEN b END AS ruled FROM lk),
        w AS (SELECT a, b, ra, rb, coalesce(person, again, ruled) AS winner, CASE WHEN person IS NOT NULL THEN 'person' WHEN again IS NOT NULL THEN 'reread' ELSE 'rule' END AS how FROM pk),
        e AS (SELECT CASE WHEN winner = a THEN b ELSE a END AS node, winner, how, row_number() OVER (PARTITION BY CASE WHEN winner = a THEN b ELSE a END ORDER BY how <> 'person', CASE WHEN winner = a THEN ra ELSE rb END, winner) AS k FROM w WHERE winner IS NOT NULL),
        walk AS (SELECT node AS s, winner AS cur, how, [k] AS ks, [node, winner] AS seen FROM e UNION ALL SELECT s, e.winner, walk.how, list_append(ks, e.k), list_append(seen, e.winner) FROM walk JOIN e ON walk.cur = e.node AND NOT list_contains(seen, e.winner)),
        z AS (SELECT s, arg_min(cur, ks) AS stands, arg_min(how, ks) AS how FROM walk WHERE cur NOT IN (SELECT node FROM e) GROUP BY 1)
        SELECT 'replaced' AS kind, s AS a, stands AS b, how FROM z UNION ALL SELECT 'conflict', a, b, NULL FROM w WHERE winner IS NULL AND a NOT IN (SELECT s FROM z) AND b NOT IN (SELECT s FROM z)
        UNION ALL SELECT CASE WHEN m.id IS NULL THEN 'orphan' ELSE 'line' END, l.id, coalesce(m.id, l.statement), NULL FROM z JOIN ln l ON l.statement = s LEFT JOIN ln m ON m.statement = stands AND m.day = l.day""",
    "name_patterns": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' ' || CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus || ' ' ELSE '' END || trim(regexp_replace(o_orderpriority, '^[0-9]-', '')) AS name FROM orders",
    "copies_manifest": "WITH p AS (SELECT p_partkey, left(p_type, 11) || '.pdf' AS name FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY p_partkey) AS n FROM p), u AS (SELECT p_partkey, 'out/' || CASE WHEN n = 1 THEN name ELSE regexp_replace(name, '\\.pdf$', '') || '__' || n || '.pdf' END AS path FROM n) SELECT p_partkey, path, sha256(p_partkey || '|' || path) AS manifest FROM u",
    "rule_change_set": f"WITH a AS (SELECT * FROM ({_VERSION.format(most=300)}) WHERE path % 10 > 0), b AS (SELECT * FROM ({_VERSION.format(most=700)}) WHERE path % 10 < 9), f AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.c IS NULL THEN 'added' WHEN b.c IS NULL THEN 'removed' WHEN a.c <> b.c THEN 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path) SELECT * FROM f WHERE change IS NOT NULL",
    "queue_recovered": "WITH l AS (SELECT event_id AS seq, event_id // 3 AS job_id, CASE event_id % 4 WHEN 0 THEN 'enqueued' WHEN 3 THEN 'completed' ELSE 'claimed' END AS event FROM events), s AS (SELECT job_id, arg_max(event, seq) AS event, max(seq) FILTER (WHERE event = 'claimed') AS claimed FROM l GROUP BY 1) SELECT CAST(job_id AS BIGINT) AS job_id, CASE event WHEN 'enqueued' THEN 'queued' WHEN 'completed' THEN 'done' ELSE CASE WHEN (500 - claimed) * 60 > 3600 THEN 'queued' ELSE 'claimed' END END AS status FROM s",
    "wrapped_values": "SELECT c_custkey, CAST(0 AS BIGINT) AS line_no, CAST(2 AS BIGINT) AS before, CAST(1 AS BIGINT) AS after FROM customer WHERE c_custkey % 2 = 0",
    "rates_from_soap": "SELECT 'EUR' AS currency, count(*) AS n, round(avg(380 + o_orderkey % 20 + 0.5), 6) AS rate FROM orders",
}
