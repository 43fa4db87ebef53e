"""Queries of utility costs over bills derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import utility
from .staging import table

#: Bills by the month, some yearly settlements; some lack a period or an amount, some stand there twice. The same text serves both engines.
_BILL = """SELECT o_orderkey + {add} AS item_id, CASE WHEN o_custkey % 50 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN concat('1111 Budapest, XV. ker. Minta utca ', CAST(o_custkey % 40 AS STRING), '.') ELSE concat('1111 BUDAPEST Minta utca ', CAST(o_custkey % 40 AS STRING)) END AS address,
    CASE o_orderkey % 3 WHEN 0 THEN 'water' WHEN 1 THEN 'gas' ELSE 'power' END AS utility, CASE WHEN o_orderkey % 29 > 0 THEN CAST(o_orderdate AS DATE) END AS start,
    CASE WHEN o_orderkey % 47 = 0 THEN CAST(o_orderdate AS DATE) - 3 WHEN o_orderkey % 23 = 0 THEN CAST(o_orderdate AS DATE) + 365 ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey * 7 % 12 AS INT) END AS `end`,
    CASE WHEN o_orderkey % 31 > 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS amount, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 700 AS DECIMAL(18,2)) END AS consumption,
    concat('Supplier ', CAST(o_orderkey % 4 AS STRING)) AS supplier, o_orderkey % 3 = 2 AS summary_only, CASE WHEN o_orderkey % 11 > 0 THEN concat('n', CAST(o_orderkey AS STRING)) END AS copy_key, {confirmed} AS confirmed FROM {orders} WHERE {where}"""
_BILLS = " UNION ALL ".join(_BILL.replace("{add}", a).replace("{confirmed}", c).replace("{where}", w) for a, c, w in (("0", "o_orderkey % 74 = 0", "true"), ("1000000000", "false", "o_orderkey % 37 = 0"), ("2000000000", "false", "o_orderkey % 111 = 0")))


def _grid(spark, sf):
    o = table(spark, sf, "orders")
    told = o.where("o_orderkey % 185 = 0").select((F.col("o_orderkey") + 1_000_000_000).alias("a"), F.col("o_orderkey").alias("b"))
    return utility.grid(spark.sql(_BILLS, orders=o), told)


def utility_grid(spark, sf):
    """The grid in long form: place, utility and month."""
    return _grid(spark, sf).cells


def utility_sources(spark, sf):
    """What each cell is made of, and the bills that have no place with their reasons."""
    return _grid(spark, sf).sources


def utility_series(spark, sf):
    """A place's and utility's totals, and the grand total without what is for information only."""
    g = _grid(spark, sf)
    none = F.lit(None).cast("string")
    return g.series.select("place", "utility", "total", "bills", "suppliers").unionByName(g.grand_total.select(F.lit("all").alias("place"), none.alias("utility"), F.col("grand_total").alias("total"), F.lit(None).cast("long").alias("bills"), none.alias("suppliers")))


QUERIES = {f.__name__: f for f in (utility_grid, utility_sources, utility_series)}

_B = _BILLS.replace("{orders}", "orders").replace("STRING", "VARCHAR").replace("`", '"')
_GRID = f"""b0 AS ({_B}), b1 AS (SELECT *, CASE WHEN address IS NULL THEN '(unknown place)' ELSE '1111 budapest minta utca ' || regexp_extract(address, 'utca ([0-9]+)', 1) END AS place, CASE WHEN start IS NULL OR "end" < start THEN 'no_period' WHEN amount IS NULL THEN 'no_amount' END AS reason FROM b0),
    b2 AS (SELECT *, item_id % 1000000000 AS k, row_number() OVER (PARTITION BY item_id % 1000000000 ORDER BY confirmed, item_id) AS n, count(*) OVER (PARTITION BY item_id % 1000000000) AS c FROM b1 WHERE reason IS NULL),
    b3 AS (SELECT *, copy_key IS NOT NULL AND n > 1 AND NOT (k % 185 = 0 AND (n = 2 AND NOT (k % 74 = 0 AND c = 3) OR n = c AND k % 74 = 0)) AS is_copy FROM b2),
    g AS (SELECT * FROM b3 WHERE NOT is_copy), s AS (SELECT *, EXISTS (SELECT 1 FROM g o WHERE o.place = g.place AND o.utility = g.utility AND g.start <= o.start AND o."end" <= g."end" AND (o.start, o."end") <> (g.start, g."end")) AS settlement FROM g),
    d AS (SELECT item_id, place, utility, amount, consumption, CAST(unnest(generate_series(start, "end", INTERVAL 1 DAY)) AS DATE) AS day FROM s WHERE NOT settlement),
    h AS (SELECT place, utility, day, count(*) AS n FROM d GROUP BY ALL), sp AS (SELECT place, utility, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM h GROUP BY place, utility),
    st AS (SELECT sp.place, sp.utility, strftime(sp.day, '%Y-%m') AS month, CASE WHEN max(coalesce(n, 0)) = 0 THEN 'missing' WHEN max(coalesce(n, 0)) > 1 THEN 'overlap' WHEN min(coalesce(n, 0)) = 0 THEN 'partial' ELSE 'ok' END AS status FROM sp LEFT JOIN h ON sp.place = h.place AND sp.utility = h.utility AND sp.day = h.day GROUP BY ALL),
    m AS (SELECT item_id, place, utility, amount, consumption, strftime(day, '%Y-%m') AS month, count(*) AS n FROM d GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY item_id) AS total, row_number() OVER (PARTITION BY item_id ORDER BY month DESC) AS r FROM m),
    x AS (SELECT *, CAST((CAST(amount * 100 AS HUGEINT) * n * 2 + total) // (total * 2) AS DECIMAL(18,2)) / 100 AS sa, CAST((CAST(consumption * 100 AS HUGEINT) * n * 2 + total) // (total * 2) AS DECIMAL(18,2)) / 100 AS sc FROM t),
    y AS (SELECT item_id, place, utility, month, CAST(CASE WHEN r = 1 THEN amount - coalesce(sum(sa) FILTER (WHERE r > 1) OVER (PARTITION BY item_id), 0) ELSE sa END AS DECIMAL(18,2)) AS amount, CAST(CASE WHEN r = 1 THEN consumption - coalesce(sum(sc) FILTER (WHERE r > 1) OVER (PARTITION BY item_id), 0) ELSE sc END AS DECIMAL(18,2)) AS consumption, false AS settlement FROM x
        UNION ALL SELECT item_id, place, utility, strftime("end", '%Y-%m'), amount, NULL, true FROM s WHERE settlement),
    u AS (SELECT place, utility, month, CAST(sum(amount) AS DECIMAL(18,2)) AS amount, CAST(sum(consumption) AS DECIMAL(18,2)) AS consumption, bool_or(settlement) AS settlement, count(*) AS bills FROM y GROUP BY ALL),
    ce AS (SELECT coalesce(st.place, u.place) AS place, coalesce(st.utility, u.utility) AS utility, coalesce(st.month, u.month) AS month, coalesce(status, 'ok') AS status, amount, consumption, coalesce(settlement, false) AS settlement, coalesce(st.utility, u.utility) = 'power' AS summary_only, coalesce(bills, 0) AS bills FROM st FULL JOIN u ON st.place = u.place AND st.utility = u.utility AND st.month = u.month)"""
ORACLES = {
    "utility_grid": f"WITH {_GRID} SELECT * FROM ce",
    "utility_sources": f"WITH {_GRID} SELECT y.place, y.utility, y.month, CASE WHEN y.settlement THEN 'settlement' ELSE status END AS status, y.amount, item_id FROM y JOIN ce USING (place, utility, month) UNION ALL SELECT NULL, NULL, NULL, reason, NULL, item_id FROM b1 WHERE reason IS NOT NULL UNION ALL SELECT NULL, NULL, NULL, 'duplicate', NULL, item_id FROM b3 WHERE is_copy",
    "utility_series": f"WITH {_GRID}, z AS (SELECT place, utility, CAST(sum(amount) AS DECIMAL(18,2)) AS total, count(*) AS bills, string_agg(DISTINCT supplier, ', ' ORDER BY supplier) AS suppliers FROM g GROUP BY ALL) SELECT * FROM z UNION ALL SELECT 'all', NULL, CAST(sum(total) FILTER (WHERE utility <> 'power') AS DECIMAL(18,2)), NULL, NULL FROM z",
}
