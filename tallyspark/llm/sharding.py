"""Sharding by fixed virtual slots. DataFrame functions only.

Every record hashes to one of thousands of fixed slots by its key; the bytes of each slot are summed; a versioned map, stored in the
shared folder, says which shard owns each slot. Rebalancing edits the map, so that only the rows of the slots that change hands
move: version 1 is even in slots, version 2 even in the bytes found. Under the law `bytes` a slot of several rows that holds more
than HOT even shares (a key that repeats, or rows without one) has its rows dealt over all slots, by text and row.

Defined results. Null text: no bytes. Null doc_id: hashed like a value of its own. Rows with equal doc_id share a slot unless it is
hot. Groups of equal texts are not kept together: each row goes by its own key, so a group of any size spreads evenly. A slot without
rows belongs to some shard of the map nonetheless. Empty table: no rows (the map is even).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, fresh_path, text_of, written
from .fingerprints import let

SLOTS = 4096
SHARDS = 40
#: Bytes that a record takes besides its text.
OVERHEAD = 16
#: Even shares of the bytes beyond which a slot's rows are dealt over all slots.
HOT = 8
#: Rows that one task ranks at once; slots of more are ranked in parts.
RANK_ROWS = 100_000


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, row, vslot): what sharding needs of every document. row tells rows apart; write it before use."""
    text = text_of(docs)
    key = docs["doc_id"]
    return docs.select(key.alias("doc_id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"), slot_of(key, slots).alias("vslot"))


def spread_hot(recs: DataFrame, sizes: DataFrame, slots: int = SLOTS, hot: int = HOT) -> DataFrame:
    """The records, those of hot slots dealt over all slots."""
    most = F.lit(sizes.agg(F.sum("bytes")).first()[0] * hot / slots)
    heavy = sizes.where((F.col("rows") > 1) & (F.col("bytes") > most)).select("vslot", F.lit(True).alias("hot"))
    again = F.pmod(F.xxhash64("doc_id", "text_crc32", "row"), F.lit(slots)).cast("int")
    marked = recs.join(F.broadcast(heavy), "vslot", "left")  # fewer rows than slots
    return marked.select("doc_id", "size", "text_crc32", "row", F.when(F.col("hot"), again).otherwise(F.col("vslot")).alias("vslot"))


def slot_sizes(recs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, rows, bytes) of all slots, also those without rows."""
    every = recs.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    sums = recs.groupBy("vslot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    return every.join(sums, "vslot", "left").select("vslot", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def _lightest(load: Column) -> Column:
    return (F.array_position(load, F.array_min(load)) - 1).cast("int")


def _deal(sizes: DataFrame, load: Column) -> DataFrame:
    """(vslot, shard): slots by falling bytes, each to the shard with the least so far, beginning with the loads given.

    One row holds the slots; their number is a constant.
    """
    ordered = sizes.agg(F.sort_array(F.collect_list(F.struct(F.col("bytes").alias("b"), (-F.col("vslot")).alias("v"))), asc=False).alias("slots"))
    start = F.struct(load.alias("load"), F.array().cast("array<int>").alias("to"))

    def step(acc, s):
        return let(_lightest(acc["load"]), lambda p: F.struct(F.transform(acc["load"], lambda x, i: F.when(i == p, x + s["b"]).otherwise(x)).alias("load"), F.array_append(acc["to"], p).alias("to")))

    dealt = ordered.select(F.arrays_zip(F.col("slots"), F.aggregate("slots", start, step)["to"].alias("to")).alias("z")).select(F.explode("z").alias("z"))
    return dealt.select((-F.col("z")["slots"]["v"]).alias("vslot"), F.col("z")["to"].alias("shard"))


def even_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1 of a map that knows no sizes yet: (version, vslot, shard), as many slots to each shard."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(F.lit(1).alias("version"), slot.alias("vslot"), (slot % shards).alias("shard"))


def slot_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 of a map made for known sizes: the bytes of the shards are near equal."""
    return _deal(sizes, F.array_repeat(F.lit(0).cast("long"), shards)).select(F.lit(1).alias("version"), "vslot", "shard")


def rebalance(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for `shards` shards: slots of shards that go, and as many slots of shards above an
    even share as exceed it, are dealt again (largest first, to the lightest shard); all others stay."""
    owned = current.join(sizes, "vslot")
    even = F.sum("bytes").over(Window.partitionBy()) / shards
    before = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot"))
    marked = written(owned.withColumn("stays", (F.col("shard") < shards) & (before <= even)), "slots")
    kept = marked.where("stays").groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    loads = kept.agg(F.map_from_entries(F.collect_list(F.struct("shard", "bytes"))).alias("m")).select(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("load"))
    moving = marked.where("not stays").select("vslot", "bytes")
    load = F.array(*[F.lit(x).cast("long") for x in loads.first()["load"]])  # one number for each shard
    version = current.agg(F.max("version")).first()[0] + 1  # the number of rows of the map is a constant
    again = _deal(moving, load)
    return marked.where("stays").select(F.lit(version).alias("version"), "vslot", "shard").unionByName(again.select(F.lit(version).alias("version"), "vslot", "shard"))


def store_map(slots: DataFrame, path: str) -> None:
    """Append a version to the stored map; earlier versions stay readable."""
    slots.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the latest by default."""
    found = spark.read.parquet(path)
    if version is None:
        version = found.agg(F.max("version")).first()[0]
    return found.where(F.col("version") == version).select("version", "vslot", "shard")


def placed(recs: DataFrame, slots: DataFrame, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Every record with its shard and its place there (gapless from 0).

    Places follow the slots, then the parts that a slot of more than rank_rows rows is ranked in, then the rank in the part.
    """
    most = recs.groupBy("vslot").count().agg(F.max("count")).first()[0] or 0
    part = F.pmod(F.xxhash64("row", "doc_id"), F.lit(-(-most // rank_rows) or 1)).cast("int")
    recs = recs.withColumn("part", part)
    counts = recs.groupBy("vslot", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    table = counts.join(slots.select("vslot", "shard"), "vslot").select("vslot", "part", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "size", "text_crc32", "row")) - 1
    out = recs.withColumn("rank", rank).join(bounded(written(table, "places")), ["vslot", "part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot"), "vslot")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """All documents with shard and place under version 2 of a map stored at path (a new path of the shared folder by default)."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "slot-map")
    store_map(even_map(spark, shards, slots), path)
    first = written(records(docs, slots), "records")
    recs = written(spread_hot(first, written(slot_sizes(first, slots), "sizes"), slots), "records")
    sizes = written(slot_sizes(recs, slots), "sizes")
    store_map(rebalance(load_map(spark, path), sizes, shards), path)
    return placed(recs, load_map(spark, path))
