"""Queries of a package's statement and of what changed since its approval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statement
from . import ledger
from .staging import table

_INV = """SELECT invoice_id, number, amount, issue_date, CASE invoice_id % 9 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'credited' WHEN 2 THEN 'partly_paid' WHEN 3 THEN 'amount_differs' WHEN 4 THEN 'excluded' WHEN 5 THEN 'no_payment_found' ELSE 'proposed' END AS state, invoice_id % 12 > 0 AS own FROM ({invoices}) i"""
_LINES = """SELECT line_id, memo, amount, booking_date, CASE line_id % 7 WHEN 0 THEN 'marked' WHEN 1 THEN 'excluded' WHEN 2 THEN 'partly_allocated' WHEN 3 THEN 'open' WHEN 4 THEN 'proposed' ELSE 'allocated' END AS state FROM ({lines}) l"""
_ALLOC = "SELECT line_id, CAST(floor(line_id / 10) AS BIGINT) AS invoice_id, amount AS line_amount, CAST(CASE WHEN line_id % 3 = 0 THEN amount ELSE amount - 10 END AS DECIMAL(18,2)) AS invoice_amount FROM ({lines}) l WHERE line_id < 1000000000 AND floor(line_id / 10) % 10 = 3"


def _parts(spark, sf):
    fill = lambda t: spark.sql(t.replace("{lines}", ledger._lines("interval 1200 days")).replace("{invoices}", ledger.INVOICES), orders=table(spark, sf, "orders"))
    return fill(_INV), fill(_LINES), fill(_ALLOC)


def statement_results(spark, sf):
    """Every invoice and line with its result and what is allocated to it."""
    return statement.build(*_parts(spark, sf)).select("section", "item_id", "result", "allocated")


def statement_changes(spark, sf):
    """What is added, removed or changed since a version in which some allocations and memos were others."""
    inv, lines, parts = _parts(spark, sf)
    new = statement.build(inv, lines, parts)
    old = statement.build(inv.where("invoice_id % 101 > 0"), lines.withColumn("memo", F.when(F.col("line_id") % 210 == 11, F.lit("else")).otherwise(F.col("memo"))), parts.where("invoice_id % 50 <> 3"))
    return statement.changes(old, statement.tree(old), new, statement.tree(new))


QUERIES = {f.__name__: f for f in (statement_results, statement_changes)}

_duck = lambda t: t.replace("{lines}", ledger._L).replace("{invoices}", ledger._I)
_P = f"""i AS ({_duck(_INV)}), l AS ({_duck(_LINES)}), a AS ({_duck(_ALLOC)}), ai AS (SELECT invoice_id, CAST(sum(invoice_amount) AS DECIMAL(18,2)) AS s, bool_or(invoice_id % 50 = 3) AS late FROM a GROUP BY 1), al AS (SELECT line_id, CAST(sum(line_amount) AS DECIMAL(18,2)) AS s, bool_or(invoice_id % 50 = 3) AS late FROM a GROUP BY 1)"""
ORACLES = {
    "statement_results": f"WITH {_P} SELECT 'invoices' AS section, i.invoice_id AS item_id, CASE WHEN state = 'credited' THEN 'credited' WHEN state = 'confirmed' OR (amount > 0 AND coalesce(s, 0) >= amount) THEN 'paid' WHEN coalesce(s, 0) > 0 THEN 'partly_paid' WHEN state IN ('proposed', 'amount_differs') THEN 'undecided' WHEN state IN ('partly_paid', 'no_payment_found') THEN state ELSE 'not_covered' END AS result, CAST(coalesce(s, 0) AS DECIMAL(18,2)) AS allocated FROM i LEFT JOIN ai USING (invoice_id) WHERE own OR s IS NOT NULL UNION ALL SELECT 'lines', l.line_id, CASE state WHEN 'marked' THEN 'needs_no_invoice' WHEN 'excluded' THEN 'left_out' WHEN 'partly_allocated' THEN 'partly_paired' WHEN 'allocated' THEN 'paired' ELSE 'open' END, CAST(coalesce(s, 0) AS DECIMAL(18,2)) FROM l LEFT JOIN al USING (line_id)",
    "statement_changes": f"WITH {_P} SELECT 'invoices' AS section, i.invoice_id AS item_id, CASE WHEN i.invoice_id % 101 = 0 OR (NOT own AND late) THEN 'added' ELSE 'changed' END AS change FROM i LEFT JOIN ai USING (invoice_id) WHERE (own OR s IS NOT NULL) AND (i.invoice_id % 101 = 0 OR coalesce(late, false)) UNION ALL SELECT 'lines', line_id, 'changed' FROM l LEFT JOIN al USING (line_id) WHERE coalesce(late, false) OR line_id % 210 = 11",
}
