"""Queries of parties: register match, suggestions, orientation, own party, direction, marks. Parties are made from customers and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import parties
from .staging import table

#: Words of made-up names by key (fixed values).
_WORDS = ("alder", "birch", "cedar", "daisy", "elder", "fern", "gorse")


def _name(key):
    """A name of words and of letters that spell the key, so that keys and names go together."""
    letters = F.translate(key.cast("string"), "0123456789", "abcdefghij")
    return F.concat_ws(" ", F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (key % 7 + 1).cast("int")), F.concat(F.lit("x"), letters, F.lit("x")))


def _tax(key):
    return F.concat(F.lpad((key + 10_000_000).cast("string"), 8, "0"), F.lit("-2-41"))


def _documents(spark, sf):
    """An invoice for each order: its supplier by the order's key, its buyer by the customer's nation."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_orderkey").alias("invoice_id"), (F.col("o_custkey") % 97).alias("supplier"), (F.col("c_nationkey") + 200).cast("long").alias("buyer"))


def priority_join(spark, sf):
    """Parties to partners: by number, else by name if that is unique."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    who = s.select(k.alias("party_id"), F.when(k % 3 > 0, _tax(k % 40)).alias("tax_number"), _name(k % 50).alias("name"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    partners = n.select(F.col("k").alias("partner_id"), _tax(F.col("k")).alias("tax_number"), _name(F.col("k") + 10).alias("name"))
    twice = n.where("k < 5").select((F.col("k") + 100).alias("partner_id"), F.lit(None).cast("string").alias("tax_number"), _name(F.col("k") + 10).alias("name"))
    return parties.match(who, partners.unionByName(twice))


def partner_suggestions(spark, sf):
    d = _documents(spark, sf)
    k = F.col("supplier")
    seen = d.select(F.col("invoice_id").alias("doc_id"), _tax(k).alias("tax_number"), F.when(F.col("invoice_id") % 3 == 0, F.upper(_name(k))).otherwise(_name(k)).alias("name"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    partners = n.select(F.when(F.col("k") % 2 == 0, _tax(F.col("k"))).alias("tax_number"), _name(F.col("k")).alias("name"))
    dismissed = n.select(parties.tax_key(_tax(F.col("k") + 30)).alias("tax_key"))
    return parties.suggestions(seen, partners, dismissed)


def party_orientation(spark, sf):
    d = _documents(spark, sf)
    flip = F.col("invoice_id") % 3 == 0
    return parties.orientation(d.select(F.when(flip, F.col("buyer")).otherwise(F.col("supplier")).alias("supplier"), F.when(flip, F.col("supplier")).otherwise(F.col("buyer")).alias("buyer")))


def own_party_suggestion(spark, sf):
    """Buyers' numbers, of which one in forty is misread by a digit."""
    d = _documents(spark, sf)
    k = F.col("buyer")
    tax = F.when(F.col("invoice_id") % 40 == 0, _tax(k + 5000)).otherwise(_tax(k))
    return parties.own_suggestion(d.select(F.col("invoice_id").alias("doc_id"), tax.alias("tax_number"), _name(k).alias("name")))


def direction_evidence(spark, sf):
    d = _documents(spark, sf)
    k = F.col("invoice_id")
    own = spark.createDataFrame([(203,), (204,), (7,), (8,)], "k long").select(_tax(F.col("k")).alias("tax_number"), _name(F.col("k")).alias("name"))
    rows = d.select("invoice_id", F.when(k % 2 == 0, _tax(F.col("supplier"))).alias("supplier_tax"), _name(F.col("supplier")).alias("supplier_name"), F.when(k % 3 == 0, _tax(F.col("buyer"))).alias("buyer_tax"), F.when(k % 5 > 0, _name(F.col("buyer"))).alias("buyer_name"))
    return parties.direction(rows, own)


def marks_by_partner(spark, sf):
    o = table(spark, sf, "orders")
    return parties.marks(o.select(F.col("o_orderkey").alias("line_id"), F.col("o_custkey").alias("key"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).alias("category")))


QUERIES = {f.__name__: f for f in (priority_join, partner_suggestions, party_orientation, own_party_suggestion, direction_evidence, marks_by_partner)}

_D = "d AS (SELECT o_orderkey AS id, o_custkey % 97 AS s, c_nationkey + 200 AS b FROM orders JOIN customer ON o_custkey = c_custkey)"
_N = lambda k: f"['alder', 'birch', 'cedar', 'daisy', 'elder', 'fern', 'gorse'][CAST(({k}) % 7 + 1 AS INT)] || ' x' || translate(CAST({k} AS VARCHAR), '0123456789', 'abcdefghij') || 'x'"
_T = lambda k: f"CAST({k} + 10000000 AS VARCHAR)"
ORACLES = {
    "priority_join": "WITH p AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 40 END AS t, s_suppkey % 50 AS n FROM supplier), x AS (SELECT id, CASE WHEN t < 25 THEN t END AS p1, CASE WHEN n BETWEEN 15 AND 34 THEN n - 10 END AS p2 FROM p) SELECT id AS party_id, coalesce(p1, p2) AS partner_id, CASE WHEN p1 IS NOT NULL THEN 'tax_number' WHEN p2 IS NOT NULL THEN 'name' END AS by FROM x",
    "partner_suggestions": f"WITH {_D}, x AS (SELECT s, CASE WHEN id % 3 = 0 THEN upper({_N('s')}) ELSE {_N('s')} END AS name, count(*) AS k FROM d WHERE s >= 25 AND NOT (s BETWEEN 30 AND 54) GROUP BY 1, 2) SELECT {_T('s')} AS tax_key, arg_max(name, (k, name)) AS label, CAST(sum(k) AS BIGINT) AS documents FROM x GROUP BY s",
    "party_orientation": f"WITH {_D}, v AS (SELECT s AS a, b, count(*) FILTER (WHERE id % 3 <> 0) AS x, count(*) FILTER (WHERE id % 3 = 0) AS y FROM d GROUP BY 1, 2 HAVING count(*) >= 2) SELECT a, b, CASE WHEN x > y THEN a WHEN y > x THEN b END AS supplier FROM v",
    "own_party_suggestion": f"WITH {_D}, r AS (SELECT b, CASE WHEN id % 40 = 0 THEN b + 5000 ELSE b END AS t, count(*) AS k FROM d GROUP BY 1, 2), m AS (SELECT *, max(k) OVER (PARTITION BY b) AS most FROM r) SELECT {_T('t')} AS tax_key, {_N('b')} AS label, k AS documents FROM m WHERE k >= 0.1 * most",
    "direction_evidence": f"WITH {_D}, x AS (SELECT id, CASE WHEN b IN (203, 204) THEN CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN id % 5 > 0 THEN 1 ELSE 0 END ELSE 0 END - CASE WHEN s IN (7, 8) THEN CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END + 1 ELSE 0 END AS net FROM d) SELECT id AS invoice_id, CASE WHEN net > 0 THEN 'incoming' WHEN net < 0 THEN 'outgoing' END AS direction, CAST(abs(net) AS INT) AS support FROM x",
    "marks_by_partner": "WITH o AS (SELECT o_orderkey AS id, o_custkey AS k, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS c FROM orders), n AS (SELECT k, c, count(*) AS n FROM o WHERE c IS NOT NULL GROUP BY 1, 2), x AS (SELECT o.id, n.c, n.n - CASE WHEN o.c = n.c THEN 1 ELSE 0 END AS n FROM o JOIN n USING (k)) SELECT o.id AS line_id, coalesce(string_agg(x.c || ':' || x.n, ',' ORDER BY x.n DESC, x.c) FILTER (WHERE x.n > 0), '') AS marks FROM o LEFT JOIN x USING (id) GROUP BY 1",
}
