"""Mixing sources to target weights by temperature. DataFrame functions only.

Token shares p of the sources are raised to an exponent a in [0, 1] and normalised: w ~ p ** a. The exponent is found
by bisection: the smallest (flattest mixture) under which no source is repeated more often than a limit, or the one at which the
entropy of w meets a target. Weights are realised as a token budget for each source, spent on permutations of its documents:
whole passes (epochs), each in an order of its own, and of the last one a beginning that the budget covers. A source of
the least repetition is passed once, so no document is lost.

A pass is dealt into blocks; whole blocks are taken while the budget lasts and of one block only a beginning. So the running sums
are over the table of blocks and within a block, never over a source, however large.

Defined results. Null text: no tokens. Null source: a source of its own. Sources without tokens are passed once.
Empty table: no rows. Rows with equal ids are told apart by their texts' hashes; exact repeats are interchangeable.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

LIMIT = 2.0
GRID, ROUNDS = 33, 10
SEED = 17
#: Documents that one block of a pass should hold.
BLOCK_ROWS = 4096
#: What the mixture adds to the columns of its input (such columns of the input are replaced).
COLUMNS = ("mix_tokens", "mix_weight", "mix_passes", "mix_epoch", "mix_block", "mix_order")


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long")


def _moments(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent a the sums of p ** a and of p ** a * ln p over the table of shares: one aggregate."""
    p = F.col("share")
    row = shares.agg(*[x for a in exponents for x in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.ln(p)))]).first()
    return list(zip(row[::2], row[1::2], strict=True))


def _bisect(fits) -> float:
    """The least exponent in [0, 1] that fits, where larger ones than a fitting one fit too. fits answers for several at once.

    Every round cuts the interval into GRID parts.
    """
    if fits([0.0])[0]:
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * k / GRID for k in range(1, GRID)]
        first = next((k for k, ok in enumerate(fits(grid)) if ok), len(grid))
        lo, hi = (grid[first - 1] if first else lo), (grid[first] if first < len(grid) else hi)
    return hi


def weights(counts: DataFrame, limit: float | None = LIMIT, target_entropy: float | None = None) -> DataFrame:
    """(source, tokens, share, exponent, weight, passes) from counts(source, tokens). Give a limit or a target entropy (nats).

    What is found of the table of sources, however long, are sums, the least and the greatest share.
    """
    counts = written(counts.select("source", "tokens"), "counts")
    total = counts.agg(F.sum("tokens")).first()[0] or 0
    share = F.when(F.col("tokens") > 0, F.col("tokens") / F.lit(total)) if total else F.lit(None).cast("double")
    shares = counts.select(share.alias("share")).where("share > 0")
    least, most = shares.agg(F.min("share"), F.max("share")).first()
    if not total:
        exponent = 1.0
    elif target_entropy is None:
        # the most passes of any source, the least passed one being passed once; it falls with the exponent
        exponent = _bisect(lambda grid: [(most / least) ** (1 - a) <= limit for a in grid])
    else:
        exponent = _bisect(lambda grid: [math.log(z) - a * m / z <= target_entropy for a, (z, m) in zip(grid, _moments(shares, grid), strict=True)])
    everything = _moments(shares, [exponent])[0][0] if total else 1.0
    power = F.pow("share", F.lit(exponent))
    rate = F.pow("share", F.lit(exponent - 1)) / F.lit(most ** (exponent - 1)) if total else F.lit(1.0)
    out = counts.withColumn("share", share)
    return out.select("source", "tokens", F.coalesce("share", F.lit(0.0)).alias("share"), F.lit(exponent).alias("exponent"), F.coalesce(power / F.lit(everything), F.lit(0.0)).alias("weight"), F.coalesce(F.round(rate, 9), F.lit(1.0)).alias("passes"))


def mix(docs: DataFrame, limit: float | None = LIMIT, target_entropy: float | None = None, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The mixture: every row of docs once for each pass that reaches it, with mix_* columns.

    mix_tokens, mix_weight, mix_passes (of its source), mix_epoch (from 0), mix_block (its block's place in the epoch's
    permutation), mix_order (a hash that orders rows within a block). Sort by epoch, block and order to read it.
    """
    kept = [c for c in docs.columns if c not in COLUMNS]
    text, source = text_of(docs), docs["source"].cast("string")
    id_hash = F.xxhash64(docs["doc_id"], text)
    narrow = written(docs.select(source.alias("source"), tokens(text).alias("tokens"), id_hash.alias("id")), "mix")
    counts = narrow.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    table = written(weights(counts.select("source", "tokens"), limit, target_entropy).join(counts.select(F.col("source").alias("_s"), "rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "weights")
    table = table.withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("int"))
    last = F.floor("passes").cast("int")  # the epoch that is only begun
    # the last epoch: blocks in their permutation, whole ones while the budget lasts
    dealt = narrow.join(table, narrow["source"].eqNullSafe(table["source"])).select(table["source"], narrow["tokens"], "id", "passes", last.alias("epoch"), "blocks", table["tokens"].alias("total"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), "blocks").cast("int"))
    sums = dealt.groupBy("source", "block", "epoch").agg(F.sum("tokens").alias("tokens"), F.first("passes").alias("passes"), F.first("total").alias("total"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", "epoch", F.lit(seed)), "block")
    budget = F.round((F.col("passes") - F.col("epoch")) * F.col("total")).cast("long")
    place = F.row_number().over(order) - 1
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = written(sums.select("source", "block", place.alias("place"), (budget - before).alias("room"), "tokens"), "blocks")
    room = room.select(F.col("source").alias("_rs"), F.col("block").alias("_rb"), "place", "room", F.col("tokens").alias("block_tokens"))
    part = dealt.join(room.where("room > 0 and block_tokens > room"), dealt["source"].eqNullSafe(F.col("_rs")) & (dealt["block"] == F.col("_rb")))
    inner = Window.partitionBy("source", "block").orderBy(F.xxhash64("id", F.lit(seed), "epoch"), "id")
    cut = part.withColumn("upto", F.sum("tokens").over(inner)).where("upto <= room")
    cut = cut.groupBy(F.col("source").alias("_cs"), F.col("block").alias("_cb")).agg(F.max(F.struct(F.xxhash64("id", F.lit(seed), "epoch").alias("key"), "id")).alias("upto"))
    cut = written(room.join(cut, F.col("_rs").eqNullSafe(F.col("_cs")) & (F.col("_rb") == F.col("_cb")), "left").select("_rs", "_rb", "place", ((F.col("room") > 0) & (F.col("room") >= F.col("block_tokens"))).alias("whole"), "upto"), "cut")
    # back to the documents: one join to a table of sources, one to a table of blocks
    full = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept]).alias("_row"), source.alias("_source"), tokens(text).alias("mix_tokens"), id_hash.alias("_id"))
    sources = table.select(F.col("source").alias("_ts"), F.col("weight").alias("mix_weight"), F.col("passes").alias("mix_passes"), "blocks", last.alias("_last"))
    full = full.join(sources, F.col("_source").eqNullSafe(F.col("_ts"))).withColumn("_block", F.pmod(F.xxhash64("_id", F.lit(seed)), "blocks").cast("int"))
    full = full.join(cut, F.col("_source").eqNullSafe(F.col("_rs")) & (F.col("_block") == F.col("_rb")))
    key = F.struct(F.xxhash64("_id", F.lit(seed), "_last").alias("key"), F.col("_id").alias("id"))
    also = F.col("whole") | F.coalesce(key <= F.col("upto"), F.lit(False))
    epochs = F.when(also, F.sequence(F.lit(0), F.col("_last"))).otherwise(F.sequence(F.lit(0), F.col("_last") - 1))
    out = full.withColumn("mix_epoch", F.explode(epochs))
    out = out.withColumn("mix_block", F.when(F.col("mix_epoch") == F.col("_last"), F.col("place")).otherwise(F.pmod(F.col("_block") + F.xxhash64("mix_epoch", F.lit(seed)), "blocks").cast("int")))
    return out.withColumn("mix_order", F.xxhash64("_id", F.lit(seed), "mix_epoch")).select("_row.*", *COLUMNS)
