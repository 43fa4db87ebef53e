"""The uniform list query: keys, search, typed filters, stable sorts with empties last, groups, facets, page, export.

A request is a flat object that is checked against the columns and then compiled to DataFrame operations; nothing is collected.
Numbers are compared exactly, days and ids as text, all else folded.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, text

KINDS = ("text", "number", "money", "date", "datetime", "enum", "bool", "id")
OPS = ("contains", "eq", "neq", "in", "gte", "lte", "empty", "notempty")
MAX_FACET, MAX_FILTERS, MAX_SORTS, MAX_KEYS, MAX_LIMIT, MAX_FIELDS = 250, 50, 5, 10_000, 1000, 30
NUMERIC = ("number", "money")
#: What no text holds and no column is named with.
_APART = "\x01"


class RequestError(ValueError):
    """A request that does not fit the columns."""


@dataclass(frozen=True)
class Column:
    key: str
    label: str = ""
    kind: str = "text"
    labels: dict[str, str] | None = None


@dataclass(frozen=True)
class Filter:
    col: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Sort:
    col: str
    desc: bool = False


@dataclass(frozen=True)
class Query:
    q: str | None = None
    filters: list[Filter] = field(default_factory=list)
    sort: list[Sort] = field(default_factory=list)
    offset: int = 0
    limit: int = 100
    keys: list[str] | None = None
    group: str | None = None
    fields: list[str] | None = None


class ListQuery:
    """Compiles requests over one table. key: the column that identifies a row and settles ties."""

    def __init__(self, columns: list[Column], key: str):
        self.columns, self.key = {c.key: c for c in columns}, key
        if unknown := {c.kind for c in columns} - set(KINDS):
            raise RequestError(f"unknown kinds: {sorted(unknown)}")

    def column(self, name: str) -> Column:
        if name not in self.columns:
            raise RequestError(f"unknown column: {name}")
        return self.columns[name]

    def check(self, q: Query) -> None:
        sizes = ((q.filters, MAX_FILTERS), (q.sort, MAX_SORTS), (q.keys or [], MAX_KEYS), (q.fields or [], MAX_FIELDS))
        if any(len(x) > most for x, most in sizes) or not 1 <= q.limit <= MAX_LIMIT or q.offset < 0:
            raise RequestError("the request exceeds its bounds")
        for name in [*(f.col for f in q.filters), *(s.col for s in q.sort), *(q.fields or []), *([q.group] if q.group else [])]:
            self.column(name)
        for f in q.filters:
            if f.op not in OPS:
                raise RequestError(f"unknown comparison: {f.op}")

    def shown(self, name: str) -> SparkColumn:
        """The value as displayed: an enum's caption."""
        labels = self.column(name).labels
        value = F.col(name).cast("string")
        if not labels:
            return value
        captions = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
        return F.coalesce(F.try_element_at(captions, value), value)

    def empty(self, name: str) -> SparkColumn:
        return text.is_empty(F.col(name).cast("string"))

    def number(self, name: str) -> SparkColumn:
        """An exact number; text as people type it, without guessing."""
        s = F.regexp_replace(F.col(name).cast("string"), "[  ]", "")
        pointed = F.when(F.contains(s, F.lit(",")) & ~F.contains(s, F.lit(".")), F.replace(s, F.lit(","), F.lit("."))).otherwise(s)
        return pointed.try_cast("decimal(38,6)")

    def _literal(self, f: Filter):
        """A numeric filter's value, refused if it can be read in two ways."""
        if isinstance(f.value, str):
            from pyspark.sql import SparkSession

            got = SparkSession.active().range(1).select(numbers.read_input(F.lit(f.value))).first()[0]
            if got is None:
                raise RequestError(f"the filter of {self.column(f.col).label or f.col} is not one number: {f.value}")
            return F.lit(got)
        return F.lit(f.value).cast("decimal(38,6)")

    def condition(self, f: Filter) -> SparkColumn:
        kind, empty = self.column(f.col).kind, self.empty(f.col)
        if f.op == "empty":
            return empty
        if f.op == "notempty":
            return ~empty
        if f.op == "contains":
            got = F.contains(text.fold(self.shown(f.col)), text.fold(F.lit(str(f.value or ""))))
        elif f.op == "in":
            wanted = f.value if isinstance(f.value, list) else [f.value]
            got = F.col(f.col).cast("string").isin([str(w) for w in wanted])
        else:
            if kind in NUMERIC:
                a, b = self.number(f.col), self._literal(f)
            elif kind in ("date", "datetime", "id"):
                a, b = F.col(f.col).cast("string"), F.lit(str(f.value))
            else:
                a, b = text.fold(F.col(f.col)), text.fold(F.lit(str(f.value)))
            got = {"eq": a == b, "neq": a != b, "gte": a >= b, "lte": a <= b}[f.op]
        return ~empty & F.coalesce(got, F.lit(False))

    def found(self, q: str) -> SparkColumn:
        """Whether what is searched stands in any displayed column: their texts are put side by side and folded once."""
        shown = F.concat_ws(_APART, *[self.shown(c) for c in self.columns])
        return F.contains(text.fold(shown), text.fold(F.lit(q.strip().replace(_APART, ""))))

    def matched(self, rows: DataFrame, q: Query) -> DataFrame:
        """The rows that fit, in no order."""
        self.check(q)
        if q.keys is not None:
            rows = rows.where(F.col(self.key).cast("string").isin([str(k) for k in q.keys]))
        if q.q and q.q.strip():
            rows = rows.where(self.found(q.q))
        for f in q.filters:
            rows = rows.where(self.condition(f))
        return rows

    def order(self, name: str, desc: bool = False) -> list[tuple[SparkColumn, bool]]:
        """Sort keys, each with whether it falls: empties last in either direction; numbers before text; text in Hungarian order."""
        kind, value = self.column(name).kind, self.shown(name)
        if kind == "bool":
            return [(self.empty(name), False), (F.col(name).cast("boolean"), desc)]
        plain = F.trim(value).rlike(r"^-?[0-9]+(?:[.,][0-9]+)?$")
        n = self.number(name) if kind in NUMERIC else F.when(plain, F.replace(F.trim(value), F.lit(","), F.lit(".")).try_cast("decimal(38,6)")) if kind == "text" else F.lit(None).cast("decimal(38,6)")
        number = [(n.isNull(), False), (n, desc)]
        if kind in NUMERIC:
            return [(self.empty(name), False), *number]
        return [(self.empty(name), False), *(number if kind == "text" else []), (text.hu_base(value), desc), (text.hu_accents(value), desc)]

    def ordered(self, rows: DataFrame, q: Query) -> DataFrame:
        """rows in the order asked for. Keys are made once a row, as columns, not again in each comparison."""
        keys = self.order(q.group) if q.group else []
        for s in q.sort:
            keys += self.order(s.col, s.desc)
        made = rows.withColumns({f"{_APART}{n}": c for n, (c, _) in enumerate(keys)})
        way = [F.col(f"{_APART}{n}").desc_nulls_last() if desc else F.col(f"{_APART}{n}").asc_nulls_last() for n, (_, desc) in enumerate(keys)]
        return made.orderBy(*way, F.col(self.key).asc())

    def page(self, rows: DataFrame, q: Query) -> DataFrame:
        """One page with only the fields asked for (and those that begin with an underscore). Top rows only are kept and sorted."""
        kept = [c for c in rows.columns if q.fields is None or c in q.fields or c.startswith("_")]
        return self.ordered(self.matched(rows, q), q).offset(q.offset).limit(q.limit).select(*kept)

    def counts(self, rows: DataFrame, q: Query) -> DataFrame:
        """(total, matched) in one pass over the rows."""
        self.check(q)
        fits = F.lit(True)
        if q.keys is not None:
            fits = fits & F.col(self.key).cast("string").isin([str(k) for k in q.keys])
        if q.q and q.q.strip():
            fits = fits & self.found(q.q)
        for f in q.filters:
            fits = fits & self.condition(f)
        return rows.agg(F.count("*").alias("total"), F.count_if(F.coalesce(fits, F.lit(False))).alias("matched"))

    def groups(self, rows: DataFrame, q: Query) -> DataFrame:
        """(value, count) over all matched rows, the empty group as null."""
        value = F.when(~self.empty(q.group), F.col(q.group).cast("string"))
        return self.matched(rows, q).groupBy(value.alias("value")).agg(F.count("*").alias("count"))

    def facets(self, rows: DataFrame) -> DataFrame:
        """(column, value): the choices of enum and yes/no columns over all rows, by caption, MAX_FACET of each."""
        names = [c.key for c in self.columns.values() if c.kind in ("enum", "bool")]
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("string").alias("value"), self.shown(n).alias("caption")) for n in names]))
        distinct = rows.select(pairs.alias("p")).select("p.*").where(~text.is_empty(F.col("value"))).distinct()
        rank = F.row_number().over(Window.partitionBy("column").orderBy(text.hu_base(F.col("caption")), text.hu_accents(F.col("caption")), "value"))
        return distinct.withColumn("n", rank).where(F.col("n") <= MAX_FACET).select("column", "value")

    def export(self, rows: DataFrame, q: Query, which: str = "filtered") -> DataFrame:
        """Rows for a file: all, filtered or selected (by keys), with text cells guarded against formulas."""
        got = {"all": lambda: rows, "filtered": lambda: self.matched(rows, q), "selected": lambda: self.matched(rows, Query(keys=q.keys or []))}[which]()
        kept = [c for c in (q.fields or [c for c in rows.columns if not c.startswith("_")])]
        return got.select(*[text.guarded(self.shown(c)).alias(c) if self.column(c).kind not in NUMERIC else F.col(c) for c in kept])


def by_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose key begins with a prefix; reaches the scan as a pushed filter."""
    return rows.where(F.col(column).startswith(prefix))


def unique_prefix(rows: DataFrame, column: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """(prefix, key): the one key that a prefix stands for; null if there are several or none. Prefixes of one length join by equality."""
    lengths = [r[0] for r in prefixes.select(F.length(prefix)).distinct().collect()]
    hits = None
    for n in lengths:
        one = prefixes.where(F.length(prefix) == n).join(rows.select(F.col(column).alias("_key"), F.left(F.col(column), F.lit(n)).alias("_p")).distinct(), F.col(prefix) == F.col("_p"), "left")
        hits = one if hits is None else hits.unionByName(one)
    return hits.groupBy(prefix).agg(F.when(F.count("_key") == 1, F.max("_key")).alias("key"))
