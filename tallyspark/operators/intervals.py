"""Periods: merging, coverage, overlap, missing spans, day-proportional months, as-of lookup, chains of replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Periods joined where they overlap or follow without a day between: a new island begins after the running last day."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = df.withColumn("_new", F.when(F.col(start) <= F.date_add(before, 1), 0).otherwise(1))
    island = fresh.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def covered(wanted: DataFrame, periods: DataFrame, keys: list[str], ident: str, start: str = "start", end: str = "end") -> DataFrame:
    """(keys, ident, covered): full, partial or none, by merged periods (which do not overlap).

    A wanted period is full if the last period that begins on or before its start ends with it or later, and partial if the last one that
    begins on or before its end ends on or after its start. Both are found by one window over each key's days, so a key's wanted and
    merged periods do not meet pairwise.
    """
    none = F.lit(None).cast("date")
    rows = wanted.select(*keys, F.col(ident).alias("_id"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    events = periods.select(*keys, F.col(start).alias("_day"), F.col(end).alias("_pe"), F.lit(None).cast(dict(wanted.dtypes)[ident]).alias("_id"), none.alias("_s"), none.alias("_e"), F.lit(0).alias("_at"))
    asked = rows.select(*keys, F.explode(F.array(F.struct(F.col("_s").alias("_day"), F.lit(1).alias("_at")), F.struct(F.col("_e").alias("_day"), F.lit(2).alias("_at")))).alias("_x"), "_id", "_s", "_e")
    events = events.unionByName(asked.select(*keys, "_x._day", none.alias("_pe"), "_id", "_s", "_e", "_x._at"))
    last = F.last("_pe", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_day", F.col("_at") > 0).rowsBetween(Window.unboundedPreceding, 0))
    seen = events.withColumn("_last", last).where("_at > 0")
    full, some = F.max((F.col("_at") == 1) & (F.col("_last") >= F.col("_e"))), F.max((F.col("_at") == 2) & (F.col("_last") >= F.col("_s")))
    got = seen.groupBy(*keys, F.col("_id").alias(ident)).agg(full.alias("_f"), some.alias("_p"))
    return got.select(*keys, ident, F.when(F.col("_f"), "full").when(F.col("_p"), "partial").otherwise("none").alias("covered"))


def month_range_join(left: DataFrame, right: DataFrame, keys: list[str], day: str, lo: str, hi: str) -> DataFrame:
    """Rows of left whose day lies in right's [lo, hi], keys being equal: an equality join on months, then the exact test.

    right is replicated once for each month of its range, so the cost follows the ranges' lengths, not the product of both sides.
    """
    a = left.withColumn("_month", F.trunc(day, "MM"))
    b = right.where(F.col(lo) <= F.col(hi)).withColumn("_month", F.explode(F.sequence(F.trunc(lo, "MM"), F.trunc(hi, "MM"), F.expr("interval 1 month"))))
    return a.join(b, [*keys, "_month"]).where((F.col(day) >= F.col(lo)) & (F.col(day) <= F.col(hi))).drop("_month")


def overlapping(df: DataFrame, keys: list[str], ident: str, start: str = "start", end: str = "end") -> DataFrame:
    """(keys, a, b): pairs of periods of one key that book the same days. Sharing only the day on which one ends and the
    next begins is no overlap. Bucketed by month, so long histories do not meet pairwise."""
    spread = F.explode(F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month")))
    rows = df.where(F.col(start) <= F.col(end)).select(*keys, F.col(ident).alias("i"), F.col(start).alias("s"), F.col(end).alias("e"), spread.alias("m"))
    a = rows.select(*keys, "m", *[F.col(c).alias(f"{c}1") for c in "ise"])
    b = rows.select(*keys, "m", *[F.col(c).alias(f"{c}2") for c in "ise"])
    both = a.join(b, [*keys, "m"]).where("i1 < i2 and s1 <= e2 and s2 <= e1")
    touching = "(s2 = e1 and s1 < s2 and e2 > e1) or (s1 = e2 and s2 < s1 and e1 > e2)"
    first = both.where(f"not ({touching})").where("m = trunc(greatest(s1, s2), 'MM')")  # in the month in which they meet
    return first.select(*keys, F.col("i1").alias("a"), F.col("i2").alias("b"))


def spans(days: DataFrame, keys: list[str], day: str, longest: int) -> DataFrame:
    """(keys, start, end, days): runs of consecutive days, cut after `longest`."""
    order = Window.partitionBy(*keys).orderBy(day)
    run = days.select(*keys, day).distinct().withColumn("_g", F.date_sub(F.col(day), F.row_number().over(order)))
    at = F.floor((F.row_number().over(Window.partitionBy(*keys, "_g").orderBy(day)) - 1) / longest)
    return run.withColumn("_c", at).groupBy(*keys, "_g", "_c").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count("*").alias("days")).drop("_g", "_c")


def as_of(asked: DataFrame, published: DataFrame, covered_days: DataFrame, keys: list[str], day: str, value: str, lookback: int) -> DataFrame:
    """asked with (value, value_day): that of the latest published day within the lookback; null across a day never fetched.

    published(keys, day, value) and covered_days(keys, day) have a row a day. Each asked row looks at lookback + 1 days by an
    equality join, whatever the histories' lengths.
    """
    ident = "_row"
    rows = asked.select(*keys, day).distinct().withColumn(ident, F.xxhash64(*keys, day))
    looked = rows.withColumn("_back", F.explode(F.sequence(F.lit(0), F.lit(lookback)))).withColumn("_d", F.date_sub(F.col(day), F.col("_back")))
    p = published.select(*keys, F.col(day).alias("_d"), F.col(value).alias("_v"))
    c = covered_days.select(*keys, F.col(day).alias("_d"), F.lit(True).alias("_known")).distinct()
    seen = looked.join(p, [*keys, "_d"], "left").join(c, [*keys, "_d"], "left")
    hit = F.min(F.when(F.col("_v").isNotNull(), F.struct("_back", "_v", "_d")))
    gap = F.min(F.when(F.col("_v").isNull() & F.col("_known").isNull(), F.col("_back")))
    found = seen.groupBy(*keys, day).agg(hit.alias("_h"), gap.alias("_g"))
    fine = F.col("_g").isNull() | (F.col("_h._back") < F.col("_g"))
    found = found.select(*keys, day, F.when(fine, F.col("_h._v")).alias(value), F.when(fine, F.col("_h._d")).alias(f"{value}_day"))
    return asked.join(found, [*keys, day], "left")


def by_month(df: DataFrame, start: str, end: str, amount: str) -> DataFrame:
    """df times the months of its period with (month, share): the amount in proportion to days, rounded half up to cents;
    what rounding leaves goes to the last month, so the shares add up exactly."""
    first, last = F.trunc(start, "MM"), F.trunc(end, "MM")
    rows = df.where(F.col(start) <= F.col(end)).withColumn("_months", F.sequence(first, last, F.expr("interval 1 month")))
    total = F.datediff(F.col(end), F.col(start)) + 1
    days = lambda m: F.datediff(F.least(F.last_day(m), F.col(end)), F.greatest(m, F.col(start))) + 1
    share = lambda m: F.round((F.col(amount) * days(m)).cast("decimal(28,2)") / total.cast("decimal(9,0)"), 2).cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")
    rows = rows.withColumn("_shares", F.transform(F.slice("_months", F.lit(1), F.size("_months") - 1), share))
    rest = (F.col(amount) - F.aggregate("_shares", zero, lambda a, x: (a + x).cast("decimal(18,2)"))).cast("decimal(18,2)")
    rows = rows.withColumn("_all", F.arrays_zip(F.col("_months").alias("m"), F.array_append("_shares", rest).alias("s")))
    return rows.withColumn("_z", F.explode("_all")).withColumn("month", F.date_format("_z.m", "yyyy-MM")).withColumn("share", F.col("_z.s")).drop("_months", "_shares", "_all", "_z")


def month_status(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, month, status): missing, overlap, partial or ok, from how many periods hold each day between the first and the last.

    Days are never listed: stretches of equal cover lie between the days on which a period begins or has ended, and each stretch is
    set against the months that it touches.
    """
    rows = df.where(F.col(start) <= F.col(end))
    turns = rows.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("day"), F.lit(1).alias("step")), F.struct(F.date_add(end, 1).alias("day"), F.lit(-1).alias("step")))).alias("t"))
    turns = turns.groupBy(*keys, F.col("t.day").alias("day")).agg(F.sum("t.step").alias("step"))
    order = Window.partitionBy(*keys).orderBy("day")
    stretches = turns.withColumn("n", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("last", F.date_sub(F.lead("day").over(order), 1)).where("last is not null")
    months = stretches.withColumn("m", F.explode(F.sequence(F.trunc("day", "MM"), F.trunc("last", "MM"), F.expr("interval 1 month"))))
    cells = months.groupBy(*keys, F.date_format("m", "yyyy-MM").alias("month")).agg(F.max("n").alias("hi"), F.min("n").alias("lo"))
    return cells.select(*keys, "month", F.when(F.col("hi") == 0, "missing").when(F.col("hi") > 1, "overlap").when(F.col("lo") == 0, "partial").otherwise("ok").alias("status"))


def month_states(accounts: DataFrame, statements: DataFrame, first: Column, last: Column, today: Column) -> DataFrame:
    """(account, currency, month, state, statements, flags): every account's months from the first to the last, up to yesterday.

    none (before it was opened, after it was closed, or not over yet), missing, partial (a day of the month that has passed, within the account's
    life, is on no statement), unverified, unapproved, ok. flags: overlap in the months that two following statements both book, break where
    one opens with another balance than the one before closed with. A month's state needs its own days only: whether its statements cover
    it is the window of covered(), over an account's months and merged periods.
    accounts: account, currency, opened, closed (nulls: open ends). statements: statement, account, currency, start, end, verified, approved, opening, closing.
    """
    keys, step = ["account", "currency"], F.expr("interval 1 month")
    dated = statements.where("start <= end")
    yesterday = F.date_sub(today, 1)
    cells = accounts.select(*keys, "opened", "closed", F.explode(F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), step)).alias("_m"))
    cells = cells.withColumn("_end", F.last_day("_m")).withColumn("start", F.greatest("_m", "opened")).withColumn("end", F.least("_end", "closed", yesterday)).withColumn("month", F.date_format("_m", "yyyy-MM"))
    lasting = cells.where("start <= end").select(*keys, "month", "start", "end")
    held = covered(lasting, merged(dated.select(*keys, "start", "end"), keys), keys, "month").select(*keys, "month", F.col("covered").alias("_covered"))
    touched = dated.withColumn("month", F.explode(F.transform(F.sequence(F.trunc("start", "MM"), F.trunc("end", "MM"), step), lambda m: F.date_format(m, "yyyy-MM"))))
    per = touched.groupBy(*keys, "month").agg(F.count("*").alias("_n"), F.min(F.coalesce("verified", F.lit(False))).alias("_verified"), F.min(F.coalesce("approved", F.lit(False))).alias("_approved"))
    order = Window.partitionBy(*keys).orderBy("start", "end", "statement")
    before = dated.withColumn("_b", F.lag(F.struct("start", "end", "closing")).over(order)).where("_b is not null")
    both = (F.col("start") <= F.col("_b.end")) & ~((F.col("start") == F.col("_b.end")) & (F.col("_b.start") < F.col("start")) & (F.col("end") > F.col("_b.end")))
    over = before.where(both).select(*keys, F.explode(F.transform(F.sequence(F.trunc("start", "MM"), F.trunc(F.least("end", "_b.end"), "MM"), step), lambda m: F.date_format(m, "yyyy-MM"))).alias("month"), F.lit("overlap").alias("flag"))
    broken = before.where(~both & F.col("start").isin(F.col("_b.end"), F.date_add("_b.end", 1)) & (F.col("opening") != F.col("_b.closing"))).select(*keys, F.date_format("start", "yyyy-MM").alias("month"), F.lit("break").alias("flag"))
    flags = over.unionByName(broken).groupBy(*keys, "month").agg(F.array_join(F.array_sort(F.collect_set("flag"), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)), ",").alias("flags"))
    rows = cells.join(per, [*keys, "month"], "left").join(held, [*keys, "month"], "left").join(flags, [*keys, "month"], "left")
    lives = F.col("start") <= F.col("end")
    state = (
        F.when(F.col("_n").isNull(), F.when(lives & (F.col("_end") < today), "missing").otherwise("none")).when(lives & (F.col("_covered") != "full"), "partial").when(~F.col("_verified"), "unverified")
        .when(~F.col("_approved"), "unapproved").otherwise("ok")
    )
    return rows.select(*keys, "month", state.alias("state"), F.coalesce("_n", F.lit(0)).alias("statements"), F.coalesce("flags", F.lit("")).alias("flags"))


def chain_ends(edges: DataFrame, steps: int = 32) -> DataFrame:
    """(node, end) from edges(node, next): where chains of replacement end, by pointer jumping; nodes that lead into a cycle are left out.

    Reach doubles each step, so 32 steps follow chains of any length that fits a table.
    """
    from ..plans.staging import written

    at = written(edges.select("node", F.col("next").alias("end")), "chain")
    rows = at.count()
    reach = 1
    for _ in range(steps):
        over = at.select(F.col("node").alias("end"), F.col("end").alias("beyond"))
        at = written(at.join(over, "end", "left").select("node", F.coalesce("beyond", "end").alias("end"), F.col("beyond").isNotNull().alias("more")), "chain")
        reach *= 2
        if at.where("more").isEmpty() or reach > 2 * rows:
            break
        at = at.drop("more")
    return at.join(edges.select(F.col("node").alias("end")).distinct(), "end", "left_anti").select("node", "end")
