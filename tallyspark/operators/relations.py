"""Relational patterns: latest rows, n-th occurrence, overlays, wide and long forms, differences, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.staging import written


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the order given (end it with a unique column)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def occurrence(df: DataFrame, keys: list[str], order: list[Column], name: str = "occurrence") -> DataFrame:
    """Number equal rows from 0 in the order given."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def nth_join(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[Column], right_order: list[Column], how: str = "inner") -> DataFrame:
    """The n-th row of a key on one side with the n-th on the other: no pair is used twice."""
    a = occurrence(left, keys, left_order, "_n")
    b = occurrence(right, keys, right_order, "_n")
    return a.join(b, [*keys, "_n"], how).drop("_n")


def overlay(base: DataFrame, corrections: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values of base replaced by those of corrections where they are given (one row a key)."""
    fixed = corrections.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = base.join(fixed, key, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; a value that is given anew wins over the stored one, null never does."""
    a, b = old.alias("a"), new.alias("b")
    columns = [c for c in old.columns if c != key]
    return a.join(b, key, "full").select(key, *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in columns])


def long_form(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each field that has a value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(*keys, pairs.alias("_p")).select(*keys, "_p.field", "_p.value").where("value is not null")


def differences(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, change, fields): rows that were added, removed or changed, and which fields differ (null-safe)."""
    a = before.select(*keys, F.struct(*columns).alias("_a"))
    b = after.select(*keys, F.struct(*columns).alias("_b"))
    both = a.join(b, keys, "full")
    fields = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns]))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(fields) > 0, "changed")
    return both.select(*keys, change.alias("change"), F.when(change == "changed", F.array_join(fields, ",")).otherwise("").alias("fields")).where("change is not null")


def stratified_sample(df: DataFrame, by: str, key: str, n: int, seed: int = 7, least: int = 2) -> DataFrame:
    """At most n rows in proportion to the groups (a half goes to the even number), of each group `least` if it has them; a group's
    rows in the order of a digest of seed and key. Groups take part in the order of their smallest keys while there is room.

    The size is the feature. Every group takes a row at least, so only the first n groups matter: the sums run over n rows.
    """
    counts = df.groupBy(by).agg(F.count("*").alias("_c"), F.min(key).alias("_first"))
    total = F.lit(df.count())
    first = counts.orderBy(F.asc_nulls_last("_first"), by).limit(n)
    share = F.least(F.greatest(F.lit(least), F.bround(F.lit(n) * F.col("_c") / total)).cast("long"), F.col("_c"))
    ahead = F.coalesce(F.sum("_k").over(Window.orderBy(F.asc_nulls_last("_first"), by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = first.withColumn("_k", share).withColumn("_k", F.least(F.col("_k"), F.lit(n) - ahead)).where("_k > 0").select(F.col(by).alias("_by"), "_k")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key))
    return df.withColumn("_n", rank).join(F.broadcast(room), F.col(by).eqNullSafe(F.col("_by"))).where("_n <= _k").drop("_n", "_k", "_by")


def unique_names(df: DataFrame, folder: str, name: str, key: str) -> DataFrame:
    """File names made unique within a folder, ignoring case: each row, in the order of key (unique), takes its name, or the first
    free one of stem__2.ext, stem__3.ext and so on.

    A numbered name can only be taken by a row of that very name (the first of them asks for it), never by one numbered from
    another stem. So rows start with their number among equal names, which is the least that they can get, and only rows of a name that
    others hold numbered have to move: whoever asks for a name with the smallest key holds it, the others take a later number,
    and those behind them in their name move on with them. A name once asked for is never free again, so this ends where a pass
    through the rows one by one would. Stretches of numbers that are taken for certain are jumped over at once. Everything
    is windows and joins on names; a folder or a name with a third of all rows is only a sort key.
    """
    low = lambda x: F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))
    cut = r"^(\.*[^.].*)(\.[^.]*)$"
    has = F.col("_name").rlike(cut)
    rows = df.select(F.col(folder).alias("_folder"), F.col(name).alias("_name"), F.col(key).alias("_key"))
    rows = rows.withColumn("_stem", F.when(has, F.regexp_extract("_name", cut, 1)).otherwise(F.col("_name"))).withColumn("_ext", F.when(has, F.regexp_extract("_name", cut, 2)).otherwise(F.lit("")))
    rows = rows.withColumn("_low", low(F.col("_name"))).withColumn("_at", low(F.concat("_folder", F.lit("/"), "_stem", F.lit("|"), "_ext")))
    same = Window.partitionBy("_folder", "_low").orderBy("_key")
    rows = rows.withColumn("_j", F.row_number().over(same).cast("long")).withColumn("_no", F.col("_j"))
    # names that look numbered: (family, number) and the smallest key that asks for each; stretches of following numbers
    looks = r"^(.+)__([1-9][0-9]{0,8})$"
    literal = rows.where(F.col("_j") == 1).where(F.col("_stem").rlike(looks)).where(F.regexp_extract("_stem", looks, 2).cast("long") >= 2)
    literal = literal.select(low(F.concat("_folder", F.lit("/"), F.regexp_extract("_stem", looks, 1), F.lit("|"), "_ext")).alias("_at"), F.regexp_extract("_stem", looks, 2).cast("long").alias("_n"), F.col("_key").alias("_holder"))
    literal = literal.groupBy("_at", "_n").agg(F.min("_holder").alias("_holder"))
    island = F.col("_n") - F.row_number().over(Window.partitionBy("_at").orderBy("_n"))
    behind = Window.partitionBy("_at", "_island").orderBy("_n").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    taken = written(literal.withColumn("_island", island).withColumn("_last", F.max("_n").over(behind)).withColumn("_most", F.max("_holder").over(behind)).drop("_island"), "taken")
    state = written(rows, "names")
    if not taken.isEmpty():
        shown = F.when(F.col("_no") == 1, F.col("_low")).otherwise(low(F.concat("_stem", F.lit("__"), F.col("_no").cast("string"), "_ext")))
        while True:
            asked = state.withColumn("_asked", shown).withColumn("_lost", F.col("_key") != F.min("_key").over(Window.partitionBy("_folder", "_asked"))).drop("_asked")
            asked = written(asked, "names")
            if asked.where("_lost").isEmpty():
                break
            over = taken.select(F.col("_at").alias("_a"), F.col("_n").alias("_b"), "_last", "_most")
            jump = F.when(F.col("_lost"), F.when(F.col("_most") < F.col("_key"), F.col("_last") + 1).otherwise(F.col("_no") + 1)).otherwise(F.col("_no"))
            moved = asked.join(over, (F.col("_at") == F.col("_a")) & (F.col("_no") == F.col("_b")), "left").withColumn("_to", F.coalesce(jump, F.col("_no") + 1))
            upto = Window.partitionBy("_folder", "_low").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            state = moved.withColumn("_no", F.col("_j") + F.max(F.col("_to") - F.col("_j")).over(upto)).drop("_a", "_b", "_last", "_most", "_to", "_lost")
            state = written(state, "names")
    final = F.when(F.col("_no") == 1, F.col("_name")).otherwise(F.concat("_stem", F.lit("__"), F.col("_no").cast("string"), "_ext"))
    return df.join(state.select("_key", final.alias("unique_name")), F.col(key) == F.col("_key")).drop("_key")


def semi(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_semi")


def anti(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_anti")


def _without_one(c: Column) -> Column:
    n = F.length(c)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.left(c, i - 1), F.substring(c, i + 1, n)))


def _without_two(c: Column) -> Column:
    n = F.length(c)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.concat(F.left(c, i - 1), F.substring(c, i + 1, j - i - 1), F.substring(c, j + 1, n))))
    return F.when(n >= 2, F.flatten(pairs)).otherwise(F.array().cast("array<string>"))


def fuzzy_pairs(left: DataFrame, right: DataFrame, word: str, least: int = 5, prefix_share: float = 0.6, ratio: float = 0.85) -> DataFrame:
    """(a, b): all pairs of different words that text.fuzzy_word accepts, without comparing all with all.

    Where one word begins the other, they meet on the beginning: the shorter one whole, the longer one's beginnings of every length.
    Words of a ratio of 0.85 or more and lengths that differ by 2 at most are the same but for a few letters left out on either side: their
    share of all letters is 1 - ratio at most. Up to three in all (words of up to some 13 letters) they meet on what is left: every word
    gives out what remains of it without one letter, or two, marked with how many each side leaves out, so that only pairs that may leave
    out so many meet. Longer ones share a run of three letters (two, if a smaller ratio brings in words of up to 9) and meet on such runs.
    An edit distance that the ratio allows is asked for before the ratio itself.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few words make many keys: sizes in bytes do not tell the work
    a, b = (df.select(F.col(word).alias(c)).where(F.length(c) >= 1).distinct().repartition(tasks) for df, c in ((left, "a"), (right, "b")))
    begins = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.left(c, n)))
    # a begins b
    found = a.withColumn("k", F.col("a")).join(b.withColumn("k", begins(F.col("b"))), "k").select("a", "b")
    # b begins a and holds enough of it
    shorter = b.where(F.length("b") >= least).withColumn("k", F.col("b")).join(a.withColumn("k", begins(F.col("a"))), "k")
    found = found.unionByName(shorter.where(F.length("b") >= prefix_share * F.length("a")).select("a", "b"))

    def runs(c):
        of = lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))
        none = F.array().cast("array<string>")
        return F.explode(F.array_distinct(F.concat(F.when(F.length(c) <= 9, of(2)).otherwise(none), F.when(F.length(c) >= 8, of(3)).otherwise(none))))

    most = lambda both: F.floor((1 - ratio) * both + 1e-9)  # noqa: E731 - letters left out, of two words' letters
    cuts = {0: lambda c: F.array(c), 1: _without_one, 2: _without_two}

    def rests(c, mine):
        n, out = F.length(c), [F.array().cast("array<string>")]
        for gone in ((0, 1), (1, 0), (1, 1), (0, 2), (2, 0), (1, 2), (2, 1)):
            here, there = gone[mine], gone[1 - mine]
            may = most(2 * n - here + there)
            fits = (may >= here + there) & (may <= 3) & (F.least(n, n - here + there) >= least)
            out.append(F.when(fits, F.transform(cuts[here](c), lambda r: F.concat(F.lit(f"{gone[0]}{gone[1]}|"), r))).otherwise(out[0]))
        return F.explode(F.array_distinct(F.concat(*out)))

    near = a.withColumn("k", rests(F.col("a"), 0)).join(b.withColumn("k", rests(F.col("b"), 1)), "k")
    long = lambda c: (F.length(c) >= least) & (most(2 * F.length(c) + 2) > 3)
    far = a.where(long("a")).withColumn("k", runs(F.col("a"))).join(b.where(long("b")).withColumn("k", runs(F.col("b"))), "k").where(most(F.length("a") + F.length("b")) > 3)
    near = near.unionByName(far).where(F.abs(F.length("a") - F.length("b")) <= 2).where(F.levenshtein("a", "b") <= (1 - ratio) * (F.length("a") + F.length("b")) + 1e-9).select("a", "b").distinct()
    near = near.repartition(tasks).where(text.likeness(F.col("a"), F.col("b")) >= ratio)
    return found.unionByName(near).where("a <> b").distinct()
