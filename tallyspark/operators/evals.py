"""Reports on judgements: accuracy, calibration, repeatability, silent errors, re-evaluation; costs and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def ratio(n: Column, d: Column) -> Column:
    return F.round(F.try_divide(n.cast("double"), d.cast("double")), 4)


def per_question(js: DataFrame, band: Column) -> DataFrame:
    """(flow, question, n, n_scored, correct, accuracy, mean, std, bands...): first runs only. js: flow, question, run_no, p, correct."""
    rows = js.where("run_no = 1").withColumn("band", band)
    right = F.count_if("correct")
    agg = [F.count("*").alias("n"), F.count("correct").alias("n_scored"), right.alias("correct"), ratio(right, F.count("correct")).alias("accuracy"), F.round(F.avg("p"), 4).alias("mean"), F.round(F.stddev_pop("p"), 4).alias("std")]
    agg += [F.count_if(F.col("band") == b).alias(f"n_{b}") for b in ("human", "uncertain", "auto")]
    agg += [ratio(F.count_if((F.col("band") == b) & F.col("correct")), F.count(F.when(F.col("band") == b, F.col("correct")))).alias(f"accuracy_{b}") for b in ("human", "uncertain", "auto")]
    return rows.groupBy("flow", "question").agg(*agg)


def bin_of(p: Column, edges: list[float]) -> Column:
    """The number of p's bin from 0; the last bin holds its upper edge, and what lies outside has none."""
    out = F.when(p == edges[-1], len(edges) - 2)
    for n, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        out = out.when((p >= lo) & (p < hi), n)
    return out


def calibration(js: DataFrame, edges: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, bin, n, mean_p, hit_rate, weighted_gap): the sum of weighted_gap is the expected calibration error."""
    by = by or []
    rows = js.where("run_no = 1 and correct is not null and p is not null").withColumn("bin", bin_of(F.col("p"), edges))
    total = F.sum("n").over(Window.partitionBy(*by))
    bins = rows.where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("m"), F.avg(F.col("correct").cast("int")).alias("h"))
    return bins.withColumn("g", F.col("n") / total * F.abs(F.col("h") - F.col("m"))).select(*by, F.col("bin").cast("long").alias("bin"), "n", F.round("m", 4).alias("mean_p"), F.round("h", 4).alias("hit_rate"), F.round("g", 6).alias("weighted_gap"))


def determinism(js: DataFrame) -> DataFrame:
    """(flow, question, series, mean_std, max_std, flips) over cases with several runs."""
    series = js.groupBy("flow", "question", "case_id").agg(F.count("*").alias("runs"), F.stddev_pop("p").alias("s"), F.countDistinct("label").alias("labels")).where("runs > 1")
    return series.groupBy("flow", "question").agg(F.count("*").alias("series"), F.round(F.avg("s"), 4).alias("mean_std"), F.round(F.max("s"), 4).alias("max_std"), F.count_if(F.col("labels") > 1).alias("flips"))


def silent_errors(js: DataFrame, examples: int = 10) -> DataFrame:
    """(flow, scored, wrong, flagged, silent, silent_cases): wrong answers that no to-do pointed at. Examples: the first few."""
    rows = js.where("run_no = 1 and correct is not null and flagged is not null")
    quiet = ~F.col("correct") & ~F.col("flagged")
    counts = rows.groupBy("flow").agg(F.count("*").alias("scored"), F.count_if(~F.col("correct")).alias("wrong"), F.count_if(~F.col("correct") & F.col("flagged")).alias("flagged"), F.count_if(quiet).alias("silent"))
    rank = F.row_number().over(Window.partitionBy("flow").orderBy("case_id", "question"))
    some = rows.where(quiet).withColumn("n", rank).where(F.col("n") <= examples).groupBy("flow").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.concat_ws(" ", F.col("case_id").cast("string"), "question").alias("t")))), lambda x: x["t"]), ",").alias("silent_cases"))
    return counts.join(some, "flow", "left").withColumn("silent_cases", F.coalesce("silent_cases", F.lit("")))


def policy_reeval(js: DataFrame, band: Column) -> DataFrame:
    """(flow, cases, cases_human, cases_uncertain_only, uncertain_only_accuracy): what reviewing uncertain answers would add."""
    case = js.where("run_no = 1").withColumn("band", band).groupBy("flow", "case_id").agg(F.max(F.col("band") == "human").alias("h"), F.max(F.col("band") == "uncertain").alias("u"), F.count_if((F.col("band") == "uncertain") & F.col("correct")).alias("r"), F.count(F.when(F.col("band") == "uncertain", F.col("correct"))).alias("s"))
    only = ~F.col("h") & F.col("u")
    return case.groupBy("flow").agg(F.count("*").alias("cases"), F.count_if("h").alias("cases_human"), F.count_if(only).alias("cases_uncertain_only"), ratio(F.sum(F.when(only, F.col("r"))), F.sum(F.when(only, F.col("s")))).alias("uncertain_only_accuracy"))


def confidence_gap(js: DataFrame, threshold: float) -> DataFrame:
    """(flow, n, mean_abs_diff, max_abs_diff, band_differs) between a stated confidence and the top probability."""
    d = F.abs(F.col("confidence") - F.col("p"))
    return js.where("run_no = 1 and confidence is not null and p is not null").groupBy("flow").agg(F.count("*").alias("n"), F.round(F.avg(d), 4).alias("mean_abs_diff"), F.round(F.max(d), 4).alias("max_abs_diff"), F.count_if((F.col("confidence") < threshold) != (F.col("p") < threshold)).alias("band_differs"))


def token_confidence(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, joint, least, first, n) of the tokens' log-probabilities of a field."""
    return tokens.groupBy(*keys).agg(F.round(F.exp(F.sum("logprob")), 6).alias("joint"), F.round(F.exp(F.min("logprob")), 6).alias("least"), F.round(F.exp(F.min_by("logprob", "pos")), 6).alias("first"), F.count("*").alias("n"))


def field_scores(expected: DataFrame, got: DataFrame, keys: list[str], equal: Column) -> DataFrame:
    """(field, n, found, right, accuracy): expected(keys, field, kind, want) against got(keys, field, have)."""
    both = expected.join(got, [*keys, "field"], "left")
    hit = F.coalesce(equal, F.lit(False))
    return both.groupBy("field").agg(F.count("*").alias("n"), F.count("have").alias("found"), F.count_if(hit).alias("right"), ratio(F.count_if(hit), F.count("*")).alias("accuracy"))


def lenient_equal(kind: Column, want: Column, have: Column, strict: Column) -> Column:
    """Equal as the kind says (strict), or, for names, addresses and texts, but for accents, case, punctuation and blanks: what a recognition
    loses. A missing value is right by neither, unless strict says so."""
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(text.fold(x), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    loose = kind.isin("name", "address", "text") & (bare(want) == bare(have))
    return F.coalesce(strict, F.lit(False)) | F.coalesce(loose, F.lit(False))


_PAID = ("succeeded", "failed", "reserved", "uncertain")


def costs(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, failed, open, known cost and reserved maximum of each group. calls: status, cost, max_cost."""
    status = F.col("status")
    return calls.groupBy(*by).agg(
        F.count("*").alias("calls"), F.count_if(status == "failed").alias("failed"), F.count_if(status.isin("reserved", "uncertain")).alias("open"),
        F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(18,4)").alias("usd"), F.coalesce(F.sum(F.when(F.col("cost").isNull(), F.col("max_cost"))), F.lit(0)).cast("decimal(18,4)").alias("held_usd"),
    )


def committed(calls: DataFrame, budgets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, limit_usd, committed, left): the actual cost where known, else the reserved maximum."""
    used = calls.groupBy(*keys).agg(F.sum(F.coalesce("cost", "max_cost")).alias("c"))
    c = F.coalesce("c", F.lit(0)).cast("decimal(18,4)")
    return budgets.join(used, keys, "left").select(*keys, "limit_usd", c.alias("committed"), (F.col("limit_usd") - c).cast("decimal(18,4)").alias("left"))


def calls_in_window(calls: DataFrame, key: str, at: str, seconds: int = 60) -> DataFrame:
    """calls with the number of the key's calls in the seconds up to each."""
    w = Window.partitionBy(key).orderBy(F.unix_seconds(F.col(at).cast("timestamp"))).rangeBetween(-seconds, 0)
    return calls.withColumn("recent", F.count("*").over(w))


def reused(calls: DataFrame, keys: list[str], at: str, ident: str) -> DataFrame:
    """calls with the latest earlier call of the same question that succeeded (null: none)."""
    w = Window.partitionBy(*keys).orderBy(at, ident).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("reused_from", F.last(F.when(F.col("status") == "succeeded", F.col(ident)), ignorenulls=True).over(w))


def replay_budget(calls: DataFrame, key: str, order: list[str], limit: str) -> DataFrame:
    """calls with granted: in order, a call whose maximum no longer fits is refused and uses nothing up.

    Sequential by nature, so each scope is one group's fold over numbers only; scopes run side by side.
    """
    rows = calls.select(key, *order, F.col("max_cost").cast("double").alias("m"), F.coalesce("cost", "max_cost").cast("double").alias("c"))

    def fold(pdf):
        pdf = pdf.sort_values(order)
        used, out = 0.0, []
        for m, c in zip(pdf["m"], pdf["c"], strict=True):
            fits = used + m <= float(limit) + 1e-9
            used += c if fits else 0.0
            out.append(fits)
        return pdf[[key, *order]].assign(granted=out)

    schema = rows.select(key, *order).withColumn("granted", F.lit(True)).schema
    return rows.groupBy(key).applyInPandas(fold, schema)
