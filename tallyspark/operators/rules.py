"""Decision tables, confidence bands, tariffs and price lists, given as data and compiled to expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import written

def holds(op: str, have: Column, want: Any, is_list: bool = False) -> Column:
    """One comparison; a list of codes is compared as a set. Null where the fact is missing, but for present and absent."""
    if op in ("present", "absent"):
        return have.isNotNull() if (op == "present") == bool(want) else have.isNull()
    if is_list:
        given = want if isinstance(want, list) else [want]
        meets = F.arrays_overlap(have, F.array(*[F.lit(w) for w in given]))
        return meets if op in ("in", "eq") else ~meets
    if op in ("in", "not_in"):
        return have.isin(want) if op == "in" else ~have.isin(want)
    if op == "between":
        return have.between(*want)
    return {"eq": have == want, "ne": have != want, "lt": have < want, "lte": have <= want, "gt": have > want, "gte": have >= want}[op]


@dataclass(frozen=True)
class Row:
    when: dict[str, dict[str, Any]]
    then: dict[str, Any]


@dataclass(frozen=True)
class Table:
    """Rows of conditions and outcomes. hit: first (the first row that holds) or collect (all rows; `combine` says how)."""

    rows: list[Row]
    hit: str = "first"
    combine: dict[str, str] = field(default_factory=dict)
    options: dict[str, list[str]] = field(default_factory=dict)
    lists: frozenset[str] = frozenset()

    def _fits(self, row: Row) -> Column:
        """Three-valued: false whatever is missing if a condition is false, null if one is open, else true."""
        out = F.lit(True)
        for name, condition in row.when.items():
            for op, want in condition.items():
                out = out & holds(op, F.col(name), want, name in self.lists)
        return out

    def decide(self, df: DataFrame) -> DataFrame:
        """df with matched (row numbers), missing (whether an open row stopped it) and a column for each outcome.

        Rows are read in order up to the first open one, or the first that holds in a table of kind first.
        """
        fits = [self._fits(r) for r in self.rows]
        names = list(dict.fromkeys(n for r in self.rows for n in r.then))
        states = F.array(*[F.coalesce(f.cast("int"), F.lit(2)) for f in fits])
        stop = F.array_position(F.transform(states, lambda s: (s == 2) | ((s == 1) & F.lit(self.hit == "first"))), True)
        df = df.withColumn("_states", states).withColumn("_stop", F.when(stop == 0, len(self.rows)).otherwise(stop))
        seen = F.filter(F.transform("_states", lambda s, i: F.when((s == 1) & (i < F.col("_stop")), i + 1)), lambda i: i.isNotNull())
        df = df.withColumn("matched", seen).withColumn("missing", F.element_at("_states", F.col("_stop").cast("int")) == 2)
        for n in names:
            given = F.array_compact(F.array(*[F.when(F.array_contains("matched", k), F.lit(r.then[n])) for k, r in enumerate(self.rows, 1) if n in r.then]))
            df = df.withColumn(n, combined(given, self.combine.get(n, "one") if self.hit == "collect" else "one", self.options.get(n)))
        return df.drop("_states", "_stop")


def combined(values: Column, how: str, options: list[str] | None = None) -> Column:
    """Several values of one outcome: worst (by the options' order), max, min, union (a sorted list), or one (null if they clash)."""
    if how == "worst":
        order = F.array(*[F.lit(o) for o in options or []])
        return F.try_element_at(F.array_sort(values, lambda a, b: (F.array_position(order, b) - F.array_position(order, a)).cast("int")), F.lit(1)) if options else F.array_max(values)
    if how in ("max", "min"):
        return F.array_max(values) if how == "max" else F.array_min(values)
    if how == "union":
        return F.array_sort(F.array_distinct(values))
    distinct = F.array_distinct(values)
    return F.when(F.size(distinct) == 1, F.try_element_at(distinct, F.lit(1)))


def noul_band(p: Column, low: float = 0.3, high: float = 0.7) -> Column:
    return F.when(p < low, "no").when(p > high, "yes").otherwise("uncertain")


def choice_band(confidence: Column, probabilities: Column | None = None, human: float = 0.6, auto: float = 0.85, gap: float = 0.2) -> Column:
    """human, uncertain or auto, by confidence and by how far the second option lies behind."""
    out = F.when(confidence < human, "human")
    if probabilities is not None:
        top = F.sort_array(F.map_values(probabilities), False)
        out = out.when((F.size(top) > 1) & (F.get(top, F.lit(0)) - F.get(top, F.lit(1)) < gap), "uncertain")
    return out.when(confidence < auto, "uncertain").otherwise("auto")


def longest_prefix(df: DataFrame, site: str, bands: DataFrame, prefix: str) -> DataFrame:
    """df with the band whose prefix is the longest that begins the site's name ."""
    sites = df.select(site).distinct()
    hit = sites.select(site, F.explode(F.transform(F.sequence(F.lit(0), F.length(site)), lambda n: F.left(site, n))).alias("_begins")).join(bands.withColumn("_begins", F.col(prefix)), "_begins").drop("_begins")
    best = hit.groupBy(site).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return df.join(best, site, "left")


def latch(*reasons: Column) -> Column:
    """A review's reasons, added up without repeats; the route follows from whether there are any."""
    return F.array_distinct(F.array_compact(F.array(*reasons)))


def route(reasons: Column) -> Column:
    return F.when(F.size(reasons) > 0, "human").otherwise("auto")


@dataclass(frozen=True)
class Module:
    level: str
    basis: str
    per_mille: str
    factors: tuple[str, ...] = ()
    minimum: str | None = None


@dataclass(frozen=True)
class Tariff:
    """Modules priced on units by basis times rate times factors; factors are tables of (condition, value) on a fact."""

    modules: dict[str, Module]
    factors: dict[str, tuple[str, list[tuple[dict[str, Any], str]]]]
    line_unit: str = "1"
    total_unit: str = "10"
    minimum: str = "0"

    def factor(self, name: str) -> Column:
        fact, table = self.factors[name]
        out = F.lit(None).cast("decimal(9,4)")
        for condition, value in reversed(table):
            fits = F.lit(True)
            for op, want in condition.items():
                fits = fits & holds(op, F.col(fact), want)
            out = F.when(fits, F.lit(Decimal(value)).cast("decimal(9,4)")).otherwise(out)
        return F.when(F.col(fact).isNotNull(), out)

    def lines(self, units: DataFrame) -> DataFrame:
        """(policy, unit_id, module, amount, blocked): a line for each unit a module prices. A basis of zero takes no part."""
        from ..functions.numbers import round_to

        out = None
        for code, m in self.modules.items():
            amount = (F.col(m.basis) * F.lit(Decimal(m.per_mille)) / 1000).cast("decimal(28,8)")
            for f in m.factors:
                amount = (amount * self.factor(f)).cast("decimal(28,8)")
            one = units.where((F.col("level") == m.level) & (F.col(m.basis).isNull() | (F.col(m.basis) != 0)))
            one = one.select("policy", "unit_id", F.lit(code).alias("module"), round_to(amount, self.line_unit).alias("amount"))
            out = one if out is None else out.unionByName(one)
        return out.withColumn("blocked", F.col("amount").isNull())

    def totals(self, units: DataFrame) -> DataFrame:
        """(policy, subtotal, total, minimum_applied, blocked): no total if anything is blocked or a module prices no unit."""
        from ..functions.numbers import round_to

        wanted = units.select("policy").distinct().withColumn("module", F.explode(F.array(*[F.lit(c) for c in self.modules])))
        per = self.lines(units).groupBy("policy", "module").agg(F.sum("amount").alias("s"), F.max("blocked").alias("b"))
        minimum = F.coalesce(*[F.when(F.col("module") == c, F.lit(Decimal(m.minimum)).cast("decimal(28,2)")) for c, m in self.modules.items() if m.minimum], F.lit(Decimal(0)).cast("decimal(28,2)"))
        rows = wanted.join(per, ["policy", "module"], "left").withColumn("b", F.coalesce("b", F.lit(True))).withColumn("t", F.greatest("s", minimum))
        sums = rows.groupBy("policy").agg(F.sum("t").alias("subtotal"), F.max("b").alias("blocked"))
        total = F.greatest(round_to(F.col("subtotal"), self.total_unit), F.lit(Decimal(self.minimum)).cast("decimal(18,2)"))
        open_ = ~F.col("blocked")
        return sums.select("policy", F.when(open_, F.col("subtotal").cast("decimal(18,2)")).alias("subtotal"), F.when(open_, total).alias("total"), (open_ & (round_to(F.col("subtotal"), self.total_unit) < F.lit(Decimal(self.minimum)))).alias("minimum_applied"), "blocked")


def inherited(units: DataFrame, facts: DataFrame) -> DataFrame:
    """(unit_id, name, value): what each unit sees: its own facts over its ancestors', however deep the tree. A unit that is its own
    ancestor (a tree with a cycle) is refused."""
    parents = written(units.select(F.col("unit_id").alias("at"), "parent_id"), "units")
    up = parents.select(F.col("at").alias("unit"), "at", F.lit(0).alias("depth"))
    every, depth, most = up, 0, parents.count()
    while True:
        depth += 1
        up = written(up.join(parents, "at").where("parent_id is not null").select("unit", F.col("parent_id").alias("at"), F.lit(depth).alias("depth")), "ancestors")
        if up.isEmpty():
            break
        if depth > most:
            raise ValueError("units contain a cycle")
        every = every.unionByName(up)
    seen = every.join(facts.withColumnRenamed("unit_id", "at"), "at")
    return seen.groupBy(F.col("unit").alias("unit_id"), "name").agg(F.min_by("value", "depth").alias("value"))


def tier_percent(lines: DataFrame, tiers: DataFrame, category: str, quantity: str) -> DataFrame:
    """lines with percent: the largest of the category's tiers whose quantity is reached, 0 without one (tiers: a price list)."""
    steps = tiers.groupBy(category).agg(F.collect_list(F.struct("min_quantity", "percent")).alias("_tiers"))  # a row a category
    reached = F.filter("_tiers", lambda t: F.col(quantity) >= t["min_quantity"])
    percent = F.coalesce(F.array_max(F.transform(reached, lambda t: t["percent"])), F.lit(0).cast("decimal(5,2)"))
    return lines.join(steps, category, "left").withColumn("percent", percent).drop("_tiers")


def price(lines: DataFrame, key: str, vat: str = "27", unit: str = "0.01") -> DataFrame:
    """(key, net, vat, gross): rounded lines summed, VAT on the net total rounded once. lines(key, quantity, unit_price, percent)."""
    from ..functions.numbers import round_to

    net = round_to((F.col("unit_price") * F.col("quantity") * (100 - F.col("percent")) / 100).cast("decimal(28,6)"), unit)
    sums = lines.groupBy(key).agg(F.sum(net).cast("decimal(18,2)").alias("net"))
    tax = round_to((F.col("net") * F.lit(Decimal(vat)) / 100).cast("decimal(28,6)"), unit)
    return sums.select(key, "net", tax.alias("vat"), (F.col("net") + tax).cast("decimal(18,2)").alias("gross"))


def first_group(rules: list[tuple[str, Column]], otherwise: str = "rest") -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for name, fits in reversed(rules):
        out = F.when(F.coalesce(fits, F.lit(False)), name).otherwise(out)
    return out


def word_options(wanted: DataFrame, items: DataFrame, key: str, text: str, item: str, name: str, k: int = 5) -> DataFrame:
    """(key, rank, item, shared): items by the number of words they share with a text, then by item. Joined on words, each pair counted."""
    words = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), r"[^\p{L}0-9]+")))
    a = wanted.select(key, words(F.col(text)).alias("w")).where("w <> ''")
    b = items.select(item, words(F.col(name)).alias("w")).where("w <> ''")
    shared = a.join(b, "w").groupBy(key, item).agg(F.count("*").alias("shared"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("shared"), item))
    return shared.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select(key, "rank", item, "shared")
