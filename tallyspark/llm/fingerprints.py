"""Document fingerprints: bottom-k sketches of five-word shingle hashes. DataFrame functions only.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a text's shingles. Sketches of parts merge into
the sketch of the whole, and two of them estimate resemblance, containment and the number of distinct shingles.

Defined results. Null text: as the empty text, whose sketch is empty. Fewer than five words: one shingle of them all.
Two empty sketches resemble each other wholly (1), an empty and another one not at all (0). Texts that are equal have
equal sketches. Very long texts are hashed whole. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, text_of, written

K = 128
WORDS = 5
#: Rows that one block of neighbours should hold; blocks are ranges of doc_id.
BLOCK_ROWS = 2000
#: Ranges that are cut at quantiles. Each of them is cut again, into as many parts of even width as its rows ask for.
RANGES = 1024


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """The hash of every shingle of a text that is not null, repeats included."""
    tokens = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    empty = F.array().cast("array<bigint>")

    def whole(h):
        return F.when(F.size(h) == 0, empty).otherwise(F.array(F.aggregate(h, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x))))

    def rolling(h):
        at = F.sequence(F.lit(0), F.size(h) - words)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) < words, whole(h)).otherwise(rolling(h)))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    return bottom(shingle_hashes(text, words), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, by: list[str], name: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each group: the k smallest hashes are kept per task first, so a hot group never meets whole."""
    hashes = df.select(*by, F.explode(name).alias("_hash")).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_hash"))
    least = hashes.withColumn("_rank", rank).where(F.col("_rank") <= k)
    merged = least.groupBy(*by).agg(F.sort_array(F.collect_list("_hash")).alias(name))
    groups = df.select(*by).distinct()
    on = [groups[c].eqNullSafe(merged[c]) for c in by]
    return groups.join(merged, on, "left").select(*[groups[c] for c in by], F.coalesce(merged[name], F.array().cast("array<bigint>")).alias(name))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the union's k smallest hashes that both have."""
    share = let(merge(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(share).cast("double")


def distinct_count(a: Column, k: int = K) -> Column:
    """Distinct shingles: exact below k, else from the k-th smallest hash as a share of the range."""
    kth = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: resemblance times the union's size over a's, at most 1."""
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    return F.concat_ws("", F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, sketch, distinct_shingles): the sketch of every document."""
    made = docs.select(docs["doc_id"].alias("doc_id"), sketch(text_of(docs), k).alias("sketch"))
    return made.withColumn("distinct_shingles", distinct_count(F.col("sketch"), k))


def ranges(ids: DataFrame, block_rows: int, most: int = RANGES) -> Column:
    """The block of a doc_id, a number that grows with it: a range between quantiles and a part of that range.

    Quantiles are at most `most` numbers, each range's rows are counted, and its parts are of even width; so blocks grow in number
    with the rows, while what a task is given stays of constant size.
    """
    rows = ids.count()
    want = min(most, rows // block_rows)
    if not want:
        return F.lit(0).cast("long")
    cuts = sorted({int(c) for c in ids.select(F.col("doc_id").cast("double").alias("_id")).approxQuantile("_id", [i / (want + 1) for i in range(1, want + 1)], 1 / (8 * (want + 1)))})
    points = F.array(*[F.lit(c) for c in cuts])
    at = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(points, lambda c: c <= F.col("doc_id"))))
    found = {r["at"]: r for r in ids.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect()}  # at most `most` + 1 rows
    parts, lows, widths = [], [], []
    for k in range(len(cuts) + 1):
        r = found.get(k)
        n = -(-r["n"] // block_rows) if r and r["lo"] is not None else 1
        parts.append(n)
        lows.append(r["lo"] if r and r["lo"] is not None else 0)
        widths.append(max(1, -(-(r["hi"] - r["lo"] + 1) // n)) if r and r["lo"] is not None else 1)
    number = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    first = [sum(parts[:k]) for k in range(len(parts))]
    one = lambda k: F.get(number(first), k) + F.coalesce(F.floor((F.col("doc_id") - F.get(number(lows), k)) / F.get(number(widths), k)), F.lit(0)).cast("long")
    return let(at, one)


def with_next(docs: DataFrame) -> DataFrame:
    """(block, guest, doc_id, text, next_text): each document beside its successor by descending doc_id, cyclically.

    Documents are dealt into ranges of doc_id, each sorted on its own. A range's
    first document also goes, as a guest, to the range above, whose last document precedes it; the overall first goes to the
    lowest range. So texts are shuffled once and no task sees more than its range. Guests are returned too.
    Rows of one doc_id are ordered by text; a null doc_id counts as the smallest.
    """
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"))
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("block", ranges(ids, BLOCK_ROWS))
    heads = base.groupBy("block").agg(F.max("doc_id").alias("head"))  # one row a block
    above = F.lead("block").over(Window.orderBy("block"))
    lowest = F.min("block").over(Window.partitionBy())
    heads = heads.select("block", "head", F.coalesce(above, lowest).alias("target")).withColumnRenamed("block", "of")
    heads = bounded(written(heads, "heads"))
    on = (base["block"] == heads["of"]) & base["doc_id"].eqNullSafe(heads["head"])
    place = lambda b, g: F.struct(b.alias("block"), F.lit(g).alias("guest"))
    placed = base.join(heads, on, "left").select(
        F.explode(F.when(F.col("target").isNull(), F.array(place(F.col("block"), 0))).otherwise(F.array(place(F.col("block"), 0), place(F.col("target"), 1)))).alias("at"), "doc_id", "text"
    )
    return placed.select("at.block", "at.guest", "doc_id", "text").withColumn("next_text", F.lead("text").over(neighbours()))


def neighbours() -> Window:
    return Window.partitionBy("block").orderBy("guest", F.desc_nulls_last("doc_id"), "text")


def edited_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch) of every document.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many of the next document.
    """
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.expr("left(next_text, cast(floor(char_length(text) / 2) as int))"))
    rows = with_next(docs).withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    made = rows.select("block", "guest", "doc_id", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text"), k).alias("sketch"), F.when(F.col("guest") == 0, sketch(F.col("edited"), k)).alias("edited_sketch"))
    out = made.withColumn("next_sketch", F.lead("sketch").over(neighbours()))
    return out.where("guest = 0").select("doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", "next_sketch")
