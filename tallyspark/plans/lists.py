"""Queries of the list operator, of scans and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import datasets, listquery, relations
from ..operators.listquery import Column, Filter, ListQuery, Query, Sort
from .staging import table

STATUS = {"F": "Finished", "O": "Open", "P": "Partial"}
ORDERS = ListQuery(
    [
        Column("o_orderkey", "Order", "id"), Column("o_orderstatus", "Status", "enum", STATUS), Column("o_totalprice", "Total", "money"),
        Column("o_orderdate", "Day", "date"), Column("o_orderpriority", "Priority", "enum"), Column("c_name", "Customer", "text"), Column("urgent", "Urgent", "bool"),
    ],
    "o_orderkey",
)
_ORDERS_SQL = """o AS (SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, c_name, o_orderpriority LIKE '1-%' AS urgent
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def orders(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"), "c_name", F.col("o_orderpriority").startswith("1-").alias("urgent"),
    )


def list_query_page(spark, sf):
    q = Query(q="customer", filters=[Filter("o_totalprice", "gte", "50 000"), Filter("o_orderstatus", "neq", "p")], sort=[Sort("o_orderpriority"), Sort("o_totalprice", True)], offset=20, limit=50, fields=["o_orderkey", "o_orderpriority", "o_totalprice", "c_name"])
    return ORDERS.page(orders(spark, sf), q)


def list_counts(spark, sf):
    return ORDERS.counts(orders(spark, sf), Query(q="finished", filters=[Filter("o_orderdate", "gte", "1995-01-01")]))


def list_filter_ops(spark, sf):
    rows, out = orders(spark, sf), None
    for name, f in {
        "contains": Filter("o_orderstatus", "contains", "FINI"), "eq": Filter("o_orderpriority", "eq", "1-urgent"), "neq": Filter("o_orderpriority", "neq", "1-URGENT"), "in": Filter("o_orderstatus", "in", ["O", "P"]),
        "gte": Filter("o_totalprice", "gte", 100000), "lte": Filter("o_orderdate", "lte", "1996-06-30"), "empty": Filter("o_orderpriority", "empty"), "notempty": Filter("o_orderpriority", "notempty"),
    }.items():
        one = ORDERS.counts(rows, Query(filters=[f])).select(F.lit(name).alias("op"), "total", "matched")
        out = one if out is None else out.unionByName(one)
    return out


def list_keys(spark, sf):
    return ORDERS.page(orders(spark, sf), Query(keys=["1", "7", "32", "33", "999999999"], fields=["o_orderkey", "c_name"]))


def list_group_counts(spark, sf):
    return ORDERS.groups(orders(spark, sf), Query(group="o_orderpriority", filters=[Filter("o_orderstatus", "eq", "f")]))


def list_group_page(spark, sf):
    return ORDERS.page(orders(spark, sf), Query(group="o_orderpriority", sort=[Sort("o_totalprice", True)], limit=100, fields=["o_orderkey", "o_orderpriority", "o_totalprice"]))


def list_facets(spark, sf):
    return ORDERS.facets(orders(spark, sf))


def list_labels(spark, sf):
    return orders(spark, sf).groupBy(ORDERS.shown("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


def list_search_folded(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.where(F.contains(text.fold(F.col("text")), text.fold(F.lit("ÉREAU")))).select("doc_id", "lang")


def hu_sort_key(spark, sf):
    """Of every word of the documents."""
    words = table(spark, sf, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{L}+)")))).alias("word")).distinct()
    return words.select("word", text.hu_base(F.col("word")).alias("base"), text.hu_accents(F.col("word")).alias("accents"))


def list_export_csv(spark, sf):
    """The rows of the exported file: BOM, semicolons and decimal commas are the writer's (sources.files)."""
    q = Query(filters=[Filter("o_orderstatus", "eq", "p")], fields=["o_orderkey", "o_orderstatus", "o_totalprice", "c_name"])
    return ORDERS.export(orders(spark, sf), q).withColumn("o_totalprice", F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(",")))


def formula_guard(spark, sf):
    docs = table(spark, sf, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    cell = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" ="), "line")).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("-"), F.col("line_no").cast("string"))).otherwise(F.col("line"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), text.guarded(cell).alias("cell"))


def scan_change_mark(spark, sf):
    o = table(spark, sf, "orders")
    return o.agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"), F.sum(F.conv(F.left(F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus")), F.lit(8)), 16, 10).cast("long")).alias("mark"))


def key_prefix_range(spark, sf):
    return listquery.by_prefix(table(spark, sf, "customer"), "c_name", "Customer#00000001").select("c_custkey", "c_name")


def unique_prefix(spark, sf):
    c = table(spark, sf, "customer").select(F.md5(F.col("c_custkey").cast("string")).alias("digest"))
    wanted = c.select(F.left("digest", F.lit(3)).alias("prefix")).distinct().unionByName(spark.createDataFrame([("zzz",)], "prefix string"))
    return listquery.unique_prefix(c, "digest", wanted, "prefix")


def _registry():
    found = datasets.Registry()
    found.add(datasets.Dataset("orders", orders, required=("o_orderstatus",), optional=("o_orderpriority", "urgent")))
    found.add(datasets.Dataset("customers", lambda spark, sf: table(spark, sf, "customer"), one_of=("c_nationkey", "c_mktsegment")))
    found.add(datasets.Dataset("events", lambda spark, sf: table(spark, sf, "events"), optional=("event_type",)))
    return found


REGISTRY = _registry()


def scope_filter(spark, sf):
    return REGISTRY.rows(spark, sf, "orders", o_orderstatus="O", o_orderpriority="2-HIGH").select("o_orderkey", "c_name")


def registered_datasets(spark, sf):
    """How many rows each registered dataset has in a scope."""
    out = None
    for name, scope in (("orders", {"o_orderstatus": "F", "urgent": True}), ("customers", {"c_mktsegment": ["BUILDING", "MACHINERY"]}), ("events", {})):
        one = REGISTRY.rows(spark, sf, name, **scope).agg(F.count("*").alias("n")).select(F.lit(name).alias("dataset"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def dataset_kept(spark, sf):
    """Rows read from what is kept while the change mark stands still, and made anew when it moves."""
    mark = str(scan_change_mark(spark, sf).first().asDict())
    kept = [REGISTRY.current(spark, sf, "customers", m, c_nationkey=3) for m in (mark, mark, mark + "+")]
    flags = ",".join("kept" if was else "made" for _, was in kept[1:])
    return kept[1][0].groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("how", F.lit(flags))


def naming_unique(spark, sf):
    """Names of several folders, of which some look as if they were numbered already."""
    k = F.col("p_partkey")
    stem = F.concat(text.safe_part(F.get(F.split("p_type", " "), F.lit(0)), 20), F.when(k % 3 == 0, F.concat(F.lit("__"), (k % 9).cast("string"))).otherwise(""), F.when(k % 15 == 0, F.lit("__2")).otherwise(""))
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("export"), F.col("p_size").cast("string")).alias("folder"), F.concat(F.when(k % 2 == 0, F.lower(stem)).otherwise(stem), F.lit(".pdf")).alias("name"))
    return relations.unique_names(p, "folder", "name", "p_partkey").select("p_partkey", "unique_name")


def stratified_sample_sizes(spark, sf):
    return relations.stratified_sample(table(spark, sf, "documents"), "lang", "doc_id", 100).groupBy("lang").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        list_query_page, list_counts, list_filter_ops, list_keys, list_group_counts, list_group_page, list_facets, list_labels, list_search_folded, hu_sort_key,
        list_export_csv, formula_guard, scan_change_mark, key_prefix_range, unique_prefix, scope_filter, registered_datasets, dataset_kept, naming_unique, stratified_sample_sizes,
    )
}

#: Without this library's table: DuckDB's own accents.
_FOLD = "replace(strip_accents(lower({})), 'ß', 'ss')"
ORACLES = {
    "list_query_page": f"WITH {_ORDERS_SQL} SELECT o_orderkey, o_orderpriority, o_totalprice, c_name FROM o WHERE lower(concat_ws(' ', CAST(o_orderkey AS VARCHAR), CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE 'Partial' END, o_orderdate, o_orderpriority, c_name)) LIKE '%customer%' AND o_totalprice >= 50000 AND o_orderstatus <> 'P' ORDER BY o_orderpriority IS NULL, o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 20",
    "list_counts": f"WITH {_ORDERS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderdate >= '1995-01-01') AS matched FROM o",
    "list_filter_ops": f"WITH {_ORDERS_SQL}, x AS (SELECT unnest([{{'op': 'contains', 'hit': o_orderstatus = 'F'}}, {{'op': 'eq', 'hit': o_orderpriority = '1-URGENT'}}, {{'op': 'neq', 'hit': o_orderpriority <> '1-URGENT'}}, {{'op': 'in', 'hit': o_orderstatus IN ('O', 'P')}}, {{'op': 'gte', 'hit': o_totalprice >= 100000}}, {{'op': 'lte', 'hit': o_orderdate <= '1996-06-30'}}, {{'op': 'empty', 'hit': o_orderpriority IS NULL}}, {{'op': 'notempty', 'hit': o_orderpriority IS NOT NULL}}]) AS s FROM o) SELECT s.op AS op, count(*) AS total, count(*) FILTER (WHERE s.hit) AS matched FROM x GROUP BY 1",
    "list_keys": f"WITH {_ORDERS_SQL} SELECT o_orderkey, c_name FROM o WHERE o_orderkey IN (1, 7, 32, 33, 999999999)",
    "list_group_counts": f"WITH {_ORDERS_SQL} SELECT o_orderpriority AS value, count(*) AS count FROM o WHERE o_orderstatus = 'F' GROUP BY 1",
    "list_group_page": f"WITH {_ORDERS_SQL} SELECT o_orderkey, o_orderpriority, o_totalprice FROM o ORDER BY o_orderpriority NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 100",
    "list_facets": f"WITH {_ORDERS_SQL} SELECT DISTINCT 'o_orderstatus' AS column, o_orderstatus AS value FROM o UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM o WHERE o_orderpriority IS NOT NULL UNION ALL SELECT DISTINCT 'urgent', CASE WHEN urgent THEN 'true' ELSE 'false' END FROM o",
    "list_labels": "SELECT CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' WHEN 'P' THEN 'Partial' ELSE o_orderstatus END AS status, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "list_search_folded": "SELECT doc_id, lang FROM documents WHERE contains(" + _FOLD.format("text") + ", 'ereau')",
    "scan_change_mark": "SELECT count(*) AS n, max(o_orderkey) AS last, CAST(sum(CAST('0x' || left(md5(o_orderkey || '|' || o_orderstatus), 8) AS BIGINT)) AS BIGINT) AS mark FROM orders",
    "hu_sort_key": "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\pL+')) AS word FROM documents), l AS (SELECT word, lower(word) AS w FROM w) SELECT word, " + _FOLD.format("regexp_replace(regexp_replace(w, '[öő]', 'o￿', 'g'), '[üű]', 'u￿', 'g')") + " AS base, regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '[áéíóú]', '1', 'g'), '[öü]', '2', 'g'), '[őű]', '3', 'g'), '[^123]', '0', 'g') AS accents FROM l",
    "list_export_csv": f"WITH {_ORDERS_SQL} SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, 'Partial' AS o_orderstatus, replace(CAST(o_totalprice AS VARCHAR), '.', ',') AS o_totalprice, c_name FROM o WHERE o_orderstatus = 'P'",
    "formula_guard": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), x AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM l), c AS (SELECT doc_id, line_no, CASE WHEN doc_id % 5 = 0 THEN ' =' || line WHEN doc_id % 5 = 1 THEN '-' || CAST(line_no AS VARCHAR) ELSE line END AS cell FROM x) SELECT doc_id, line_no, CASE WHEN regexp_matches(ltrim(cell, ' '), '^[=+@\\t-]') AND NOT regexp_matches(cell, '^\\s*-?[0-9]+([.,][0-9]+)?\\s*$') THEN '''' || cell ELSE cell END AS cell FROM c",
    "key_prefix_range": "SELECT c_custkey, c_name FROM customer WHERE c_name >= 'Customer#00000001' AND c_name < 'Customer#00000002'",
    "unique_prefix": "WITH c AS (SELECT md5(CAST(c_custkey AS VARCHAR)) AS digest FROM customer), g AS (SELECT left(digest, 3) AS prefix, CASE WHEN count(*) = 1 THEN max(digest) END AS key FROM c GROUP BY 1) SELECT prefix, key FROM g UNION ALL SELECT 'zzz', NULL",
    "scope_filter": f"WITH {_ORDERS_SQL} SELECT o_orderkey, c_name FROM o WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'",
    "registered_datasets": "SELECT 'orders' AS dataset, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1-%' UNION ALL SELECT 'customers', count(*) FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'events', count(*) FROM events",
    "dataset_kept": "SELECT c_mktsegment, count(*) AS n, 'kept,made' AS how FROM customer WHERE c_nationkey = 3 GROUP BY 1",
    "naming_unique": """WITH RECURSIVE p AS (SELECT p_partkey, p_size, split_part(p_type, ' ', 1) || CASE WHEN p_partkey % 3 = 0 THEN '__' || (p_partkey % 9) ELSE '' END || CASE WHEN p_partkey % 15 = 0 THEN '__2' ELSE '' END AS s, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS i FROM part),
        q AS (SELECT p_partkey, p_size, i, CASE WHEN p_partkey % 2 = 0 THEN lower(s) ELSE s END AS s FROM p),
        r AS (SELECT p_size, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS p_partkey, '' AS name, CAST([] AS VARCHAR[]) AS used FROM (SELECT DISTINCT p_size FROM part)
            UNION ALL SELECT p_size, i, p_partkey, name, list_append(used, lower(name)) FROM (SELECT q.p_size, q.i, q.p_partkey, used, list_filter(list_transform(range(1, len(used) + 3), lambda n: CASE n WHEN 1 THEN s || '.pdf' ELSE s || '__' || n || '.pdf' END), lambda c: NOT list_contains(used, lower(c)))[1] AS name FROM r JOIN q ON q.p_size = r.p_size AND q.i = r.i + 1))
        SELECT p_partkey, name AS unique_name FROM r WHERE i > 0""",
    "stratified_sample_sizes": "WITH c AS (SELECT lang, count(*) AS c, min(doc_id) AS f FROM documents GROUP BY 1), k AS (SELECT *, least(c, greatest(2, CAST(round_even(100.0 * c / (SELECT count(*) FROM documents), 0) AS BIGINT))) AS k FROM c) SELECT lang, CAST(least(k, 100 - coalesce(sum(k) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS n FROM k QUALIFY n > 0",
}
