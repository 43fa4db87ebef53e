"""Lists that people work from: open reasons, waiting items, activity, settings in layers, measure rounds, surveys, releases, cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def open_items(reasons: DataFrame, closings: DataFrame) -> DataFrame:
    """(subject, reasons, since): one open item a subject with its distinct reasons, without those closed later.

    reasons: subject, reason, producer, at. closings: subject, prefix (of reasons; null: all), producer (null: any), at.
    """
    r = reasons.select("subject", "reason", "producer", "at", F.xxhash64("subject", "reason", "producer", "at").alias("_id"))
    c = closings.select(F.col("subject").alias("_s"), F.coalesce("prefix", F.lit("")).alias("_p"), F.col("producer").alias("_by"), F.col("at").alias("_at"))
    closes = (F.col("subject") == F.col("_s")) & F.col("reason").startswith(F.col("_p")) & (F.col("_by").isNull() | (F.col("_by") == F.col("producer"))) & (F.col("_at") >= F.col("at"))
    left = r.join(c, closes, "left_anti")
    return left.groupBy("subject").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.min("at").alias("since"))


def waiting(sources: dict[str, DataFrame], actor: str | None = None) -> DataFrame:
    """(kind, subject, since, assignee): what waits, of all kinds; with an actor, what is theirs or nobody's. sources: kind to
    DataFrame(subject, since, assignee)."""
    out = None
    for kind, df in sources.items():
        one = df.select(F.lit(kind).alias("kind"), F.col("subject").cast("string").alias("subject"), "since", "assignee")
        out = one if out is None else out.unionByName(one)
    return out if actor is None else out.where(F.col("assignee").isNull() | (F.col("assignee") == actor))


def activity(events: DataFrame, day: Column, actor: Column | None = None) -> DataFrame:
    """(actor, kind, n, first, last) of one day (or of one actor): events(actor, kind, at)."""
    rows = events.where(F.to_date("at") == day)
    rows = rows if actor is None else rows.where(F.col("actor") == actor)
    return rows.groupBy("actor", "kind").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))


def layered(settings: DataFrame) -> DataFrame:
    """(name, value, layer): settings in force: of each name that of the highest layer; null takes a setting away. settings: name, layer, value."""
    top = settings.groupBy("name").agg(F.max(F.struct("layer", "value")).alias("s"))
    return top.select("name", "s.value", "s.layer").where("value is not null")


def versions(contents: DataFrame) -> DataFrame:
    """(path, version, sha256, since): a rule file's contents as versions; the same content again, unchanged, is no new one. contents: path, at, content."""
    rows = contents.withColumn("sha256", F.sha2("content", 256))
    order = Window.partitionBy("path").orderBy("at", "sha256")
    changed = rows.withColumn("_new", ~F.col("sha256").eqNullSafe(F.lag("sha256").over(order))).where("_new")
    return changed.select("path", F.row_number().over(order).cast("long").alias("version"), "sha256", F.col("at").alias("since"))


def field_right(kind: Column, got: Column, want: Column) -> Column:
    """Whether an answer is right as its kind means it: phones by their digits, money by value, else folded text."""
    digits = lambda x: F.right(F.regexp_replace(x, "[^0-9]", ""), F.lit(9))
    money = lambda x: F.regexp_replace(x, "[  ]", "").try_cast("decimal(30,6)")
    same = F.when(kind == "phone", digits(got) == digits(want)).when(kind == "money", money(got) == money(want)).otherwise(text.normalize(got) == text.normalize(want))
    return F.coalesce(same, got.isNull() & want.isNull())


def measure_round(golden: DataFrame, answers: DataFrame, selectors: list[str]) -> DataFrame:
    """(selector, cases, answered, right, scored): golden(case_id, field, kind, value) whose "case/field" begins with a selector.

    scored: the share of right ones among the answered."""
    rows = golden.join(answers.select("case_id", "field", F.col("value").alias("got"), F.lit(True).alias("_has")), ["case_id", "field"], "left")
    path = F.concat_ws("/", F.col("case_id").cast("string"), "field")
    hit = F.filter(F.array(*[F.lit(s) for s in selectors]), lambda s: path.startswith(s))
    rows = rows.withColumn("selector", F.explode(hit)).withColumn("ok", F.coalesce(F.col("_has"), F.lit(False)) & field_right(F.col("kind"), F.col("got"), F.col("value")))
    out = rows.groupBy("selector").agg(F.countDistinct("case_id").alias("cases"), F.count("_has").alias("answered"), F.count_if("ok").alias("right"))
    return out.withColumn("scored", F.when(F.col("answered") > 0, F.round(F.col("right") / F.col("answered"), 4)))


def field_accuracy(expected: DataFrame, got: DataFrame) -> DataFrame:
    """(field, n, right, share): expected(case_id, field, kind, value) against got(case_id, field, value)."""
    both = expected.join(got.select("case_id", "field", F.col("value").alias("got")), ["case_id", "field"], "left")
    out = both.groupBy("field").agg(F.count("*").alias("n"), F.count_if(field_right(F.col("kind"), F.col("got"), F.col("value"))).alias("right"))
    return out.withColumn("share", F.round(F.col("right") / F.col("n"), 4))


def survey(found: DataFrame, held: DataFrame, start: Column, end: Column) -> DataFrame:
    """(account, statements, held, fresh, first, last): statements in files whose period touches [start, end], by account, and which of
    them are held already. found: account, statement, start, end. held: statement."""
    rows = found.where((F.col("start") <= end) & (F.col("end") >= start)).dropDuplicates(["statement"])
    rows = rows.join(held.select("statement", F.lit(True).alias("_held")).distinct(), "statement", "left")
    return rows.groupBy("account").agg(F.count("*").alias("statements"), F.count("_held").alias("held"), F.count_if(F.col("_held").isNull()).alias("fresh"), F.min("start").alias("first"), F.max("end").alias("last"))


def mail_route(mails: DataFrame, signals: DataFrame, attachments: DataFrame, routes: dict[str, str], intents: dict[str, str], kinds: dict[str, str], sure: float = 0.6) -> DataFrame:
    """(mail_id, route, by): a signal's route outweighs the intent's (if it is sure enough), and that the attachments'.

    mails: mail_id, intent, confidence. signals: mail_id, signal. attachments: mail_id, kind. Of several signals or kinds the first of
    the given order counts."""
    def first(df: DataFrame, column: str, table: dict[str, str]) -> DataFrame:
        rank = F.create_map(*[F.lit(x) for n, k in enumerate(table) for x in (k, n)])
        name = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
        hit = df.where(F.col(column).isin(*table)).groupBy("mail_id").agg(F.min_by(column, F.try_element_at(rank, F.col(column))).alias("_k"))
        return hit.select("mail_id", F.try_element_at(name, F.col("_k")).alias(f"_{column}"))

    by_intent = F.create_map(*[F.lit(x) for pair in intents.items() for x in pair])
    rows = mails.join(first(signals, "signal", routes), "mail_id", "left").join(first(attachments, "kind", kinds), "mail_id", "left")
    intent = F.when(F.col("confidence") >= sure, F.try_element_at(by_intent, F.col("intent")))
    by = F.when(F.col("_signal").isNotNull(), "signal").when(intent.isNotNull(), "intent").when(F.col("_kind").isNotNull(), "attachment").otherwise("none")
    return rows.select("mail_id", F.coalesce("_signal", intent, "_kind", F.lit("none")).alias("route"), by.alias("by"))


def release_state(items: DataFrame, released: DataFrame) -> DataFrame:
    """(package, mark, state): a digest of what a package would release now against its last release: new, current or changed; 'nothing'
    if no item may go. items: package, item, result, releasable. released: package, version, mark."""
    seen = F.when(F.col("releasable"), F.concat_ws("=", F.col("item").cast("string"), "result"))
    now = items.groupBy("package").agg(F.array_join(F.array_sort(F.collect_list(seen)), ";").alias("content"))
    last = released.groupBy("package").agg(F.max_by("mark", "version").alias("last"))
    mark = F.when(F.col("content") != "", F.sha2("content", 256))
    state = F.when(mark.isNull(), "nothing").when(F.col("last").isNull(), "new").when(F.col("last") == mark, "current").otherwise("changed")
    return now.join(last, "package", "left").select("package", mark.alias("mark"), state.alias("state"))


def broken_variants(records: DataFrame, amount: str, day: str, name: str) -> DataFrame:
    """records once as they are and once for each way to break them (variant): a decimal place lost, the amount missing, digits swapped,
    day and month swapped, the name cut."""
    a, d, n = F.col(amount), F.col(day), F.col(name)
    shown = a.cast("string")
    swapped = F.concat(F.substring(shown, 2, 1), F.substring(shown, 1, 1), F.substring(shown, F.lit(3), F.length(shown))).cast(dict(records.dtypes)[amount])
    other = F.try_to_date(F.concat_ws("-", F.date_format(d, "yyyy"), F.date_format(d, "dd"), F.date_format(d, "MM")), "yyyy-MM-dd")
    made = {
        "same": (a, d, n), "scaled": ((a * 10).cast(dict(records.dtypes)[amount]), d, n), "missing": (F.lit(None).cast(dict(records.dtypes)[amount]), d, n),
        "digits": (swapped, d, n), "month": (a, F.coalesce(other, d), n), "cut": (a, d, F.left(n, F.floor(F.length(n) / 2).cast("int"))),
    }
    every = F.array(*[F.struct(F.lit(v).alias("variant"), x.alias("a"), y.alias("d"), z.alias("n")) for v, (x, y, z) in made.items()])
    rest = [c for c in records.columns if c not in (amount, day, name)]
    rows = records.select(*rest, a.alias("_a"), F.explode(every).alias("_v"))
    return rows.select(*rest, "_v.variant", F.col("_v.a").alias(amount), F.col("_v.d").alias(day), F.col("_v.n").alias(name))


def flag_rates(flagged: DataFrame) -> DataFrame:
    """(variant, n, flagged, rate) of flagged(variant, flag): how often a verifier objects; for 'same' these are false alarms."""
    out = flagged.groupBy("variant").agg(F.count("*").alias("n"), F.count_if("flag").alias("flagged"))
    return out.withColumn("rate", F.round(F.col("flagged") / F.col("n"), 4))


def case_list(cases: DataFrame, handovers: DataFrame, facts: DataFrame, required: list[str]) -> DataFrame:
    """(case_id, holder, handovers, missing): who holds each case after its last handover and which required facts it lacks.

    cases: case_id, opened_by. handovers: case_id, at, to. facts: case_id, name."""
    last = handovers.groupBy("case_id").agg(F.max_by("to", F.struct("at", "to")).alias("to"), F.count("*").alias("n"))
    known = facts.where(F.col("name").isin(*required)).groupBy("case_id").agg(F.collect_set("name").alias("known"))
    rows = cases.join(last, "case_id", "left").join(known, "case_id", "left")
    need = F.array(*[F.lit(r) for r in sorted(required)])
    missing = F.array_except(need, F.coalesce("known", F.array().cast("array<string>")))
    return rows.select("case_id", F.coalesce("to", "opened_by").alias("holder"), F.coalesce("n", F.lit(0)).alias("handovers"), F.array_join(missing, ",").alias("missing"))


def code_match(lines: DataFrame, prices: DataFrame) -> DataFrame:
    """(line_id, sku): the one price-list item whose code stands in a line's text as a whole word; null if none or several do.

    lines: line_id, text. prices: sku. Codes of several words meet on their last word (which tells them apart most), then are sought whole."""
    p = prices.select("sku", text.normalize(F.col("sku")).alias("code")).where("code <> ''").withColumn("w", F.substring_index("code", " ", -1))
    rows = lines.select("line_id", text.normalize(F.col("text")).alias("t"))
    hits = rows.select("line_id", "t", F.explode(F.array_distinct(F.split("t", " "))).alias("w")).join(p, "w").where(text.has_words(F.col("t"), F.col("code")))
    one = hits.groupBy("line_id").agg(F.count_distinct("sku").alias("n"), F.min("sku").alias("sku")).where("n = 1").drop("n")
    return lines.select("line_id").join(one, "line_id", "left")


def recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(kind, wanted, found, recall): how many true values are among the candidates. candidates: doc_id, kind, label. truth: doc_id, kind, label."""
    hit = candidates.select("doc_id", "kind", "label", F.lit(True).alias("_hit")).distinct()
    out = truth.join(hit, ["doc_id", "kind", "label"], "left").groupBy("kind").agg(F.count("*").alias("wanted"), F.count("_hit").alias("found"))
    return out.withColumn("recall", F.round(F.col("found") / F.col("wanted"), 4))
