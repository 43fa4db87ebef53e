"""A statement's parts and the tree of its digests."""

from pyspark.sql import functions as F

from tallyspark.operators import statement


def test_only_changed_leaves_are_looked_at(spark):
    rows = [("lines" if n % 2 else "invoices", n, "r", None, f"c{n}") for n in range(400)]
    schema = "section string, item_id long, result string, allocated decimal(18,2), content string"
    old = spark.createDataFrame(rows, schema)
    new = old.where("item_id <> 7").withColumn("content", F.when(F.col("item_id") == 8, "else").otherwise(F.col("content"))).unionByName(spark.createDataFrame([("other", 1, "r", None, "x")], schema))
    trees = [statement.tree(df, 512) for df in (old, new, old.repartition(7))]
    assert statement.changed_leaves(trees[0], trees[2]).count() == 0  # whatever the order and partitions
    found = statement.changed_leaves(trees[0], trees[1]).collect()
    assert len(found) == 3 and {r["section"] for r in found} == {"lines", "invoices", "other"}
    got = {tuple(r) for r in statement.changes(old, trees[0], new, trees[1], 512).collect()}
    assert got == {("lines", 7, "removed"), ("invoices", 8, "changed"), ("other", 1, "added")}
    levels = trees[0].groupBy("level").agg(F.max("node").alias("n")).orderBy("level").collect()
    assert [r["level"] for r in levels] == [0, 1, 2] and levels[-1]["n"] == 0
    none = statement.tree(old.limit(0), 512)
    assert none.count() == 0 and statement.changes(old.limit(0), none, old, trees[0], 512).count() == 400
