"""A package's statement: its invoices and lines with their results, and what changed since it was approved, by a tree of digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import written

#: Results by the state of the pairing, where no allocation decides (fixed values).
INVOICE_RESULTS = {
    "confirmed": "paid", "credited": "credited", "partly_paid": "partly_paid", "proposed": "undecided", "amount_only": "undecided", "amount_differs": "undecided",
    "rate_missing": "undecided", "no_payment_found": "no_payment_found", "partly_covered": "not_covered", "not_covered": "not_covered",
}
LINE_RESULTS = {"allocated": "paired", "partly_allocated": "partly_paired", "marked": "needs_no_invoice", "excluded": "left_out", "proposed": "open", "amount_only": "open", "open": "open"}
#: Leaves of the tree of a section; every level above has one digest for FAN of the level below.
LEAVES, FAN = 4096, 64


def _mapped(state: Column, table: dict[str, str], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), state), F.lit(other))


def build(invoices: DataFrame, lines: DataFrame, allocations: DataFrame) -> DataFrame:
    """(section, item_id, result, allocated, content): the statement's parts; content is what a digest is taken of.

    An invoice of another party (own false) only if a line of the package paid it. invoices: invoice_id, state, amount, own and facts to be
    shown; lines: line_id, state and facts; allocations: line_id, invoice_id, line_amount, invoice_amount.
    """
    def paid(key, part):
        return allocations.groupBy(key).agg(F.sum(part).cast("decimal(18,2)").alias("allocated"), F.array_sort(F.collect_list(F.struct("line_id", "invoice_id", "line_amount", "invoice_amount"))).alias("parts"))

    zero = F.lit(0).cast("decimal(18,2)")
    inv = invoices.join(paid("invoice_id", "invoice_amount"), "invoice_id", "left").where(F.coalesce("own", F.lit(True)) | F.col("parts").isNotNull()).withColumn("allocated", F.coalesce("allocated", zero))
    full = (F.col("amount") > 0) & (F.col("allocated") >= F.col("amount"))
    result = F.when(F.col("state") == "credited", "credited").when((F.col("state") == "confirmed") | F.coalesce(full, F.lit(False)), "paid").when(F.col("allocated") > 0, "partly_paid").otherwise(_mapped(F.col("state"), INVOICE_RESULTS, "not_covered"))
    told = lines.join(paid("line_id", "line_amount"), "line_id", "left").withColumn("allocated", F.coalesce("allocated", zero))

    def part(df, section, key, result):
        rows = df.withColumn("result", result)
        facts = [c for c in sorted(rows.columns) if c != key]
        return rows.select(F.lit(section).alias("section"), F.col(key).alias("item_id"), "result", "allocated", F.to_json(F.struct(*facts), {"ignoreNullFields": "false"}).alias("content"))

    return part(inv, "invoices", "invoice_id", result).unionByName(part(told, "lines", "line_id", _mapped(F.col("state"), LINE_RESULTS, "open")))


def tree(parts: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """(section, level, node, digest) of a statement: level 0 has the leaves, to which items are dealt by their ids; the root is the last level.

    A leaf's digest is made of the number of its items and the sums (exclusive or) of their SHA-256, which is combined before the shuffle
    and needs no order, so a leaf of any size is never gathered; levels above hash FAN digests in order. Write it with the approved version.
    """
    sha = F.sha2(F.concat_ws("|", F.col("item_id").cast("string"), "content"), 256)
    words = [F.conv(F.substring(sha, 1 + 15 * k, 15), 16, 10).cast("long") for k in range(4)]
    leaf = parts.select("section", F.pmod(F.xxhash64("item_id"), F.lit(leaves)).alias("node"), *[w.alias(f"w{k}") for k, w in enumerate(words)])
    level = leaf.groupBy("section", "node").agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[F.bit_xor(f"w{k}").cast("string") for k in range(4)]), 256).alias("digest"))
    out, n, size = None, 0, leaves
    while True:
        level = written(level.select("section", F.lit(n).alias("level"), "node", "digest"), "digests")
        out = level if out is None else out.unionByName(level)
        if size == 1:
            return out
        up = F.floor(F.col("node") / FAN)
        level = level.groupBy("section", up.alias("node")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat_ws(":", x["node"].cast("string"), x["digest"])), "|"), 256).alias("digest"))
        n, size = n + 1, -(-size // FAN)


def changed_leaves(old: DataFrame, new: DataFrame) -> DataFrame:
    """(section, node): leaves whose digests differ, found from the roots down; where two nodes are equal nothing below is looked at."""
    top = max(old.agg(F.max("level")).first()[0] or 0, new.agg(F.max("level")).first()[0] or 0)
    open_ = None
    for level in range(top, -1, -1):
        a, b = (df.where(F.col("level") == level).select("section", "node", F.col("digest").alias(c)) for df, c in ((old, "a"), (new, "b")))
        both = a.join(b, ["section", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("section", "node")
        if open_ is not None:
            both = both.withColumn("_up", F.floor(F.col("node") / FAN)).join(open_.withColumnRenamed("node", "_up"), ["section", "_up"], "left_semi").drop("_up")
        open_ = written(both, "open-nodes")
    return open_


def changes(old: DataFrame, old_tree: DataFrame, new: DataFrame, new_tree: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """(section, item_id, change): added, removed or changed since the approved version; only items of changed leaves are compared."""
    found = changed_leaves(old_tree, new_tree)
    at = F.pmod(F.xxhash64("item_id"), F.lit(leaves))
    mine = lambda df, c: df.withColumn("node", at).join(found, ["section", "node"], "left_semi").select("section", "item_id", F.sha2("content", 256).alias(c))
    both = mine(old, "a").join(mine(new, "b"), ["section", "item_id"], "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("section", "item_id", change.alias("change")).where("change is not null")
