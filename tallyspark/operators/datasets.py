"""A registry of datasets: builders with columns and scopes, resolved strictly; results kept by the mark of what they read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import fresh_path


@dataclass(frozen=True)
class Dataset:
    """build(spark, dir) gives the rows. A scope names columns and values: all of `required`, exactly one of `one_of` (if there are
    any), any of `optional`."""

    name: str
    build: Callable[[SparkSession, str], DataFrame]
    required: tuple[str, ...] = ()
    one_of: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()


@dataclass
class Registry:
    datasets: dict[str, Dataset] = field(default_factory=dict)
    kept: dict[tuple, tuple[str, str]] = field(default_factory=dict)

    def add(self, dataset: Dataset) -> None:
        if dataset.name in self.datasets:
            raise ValueError(f"dataset {dataset.name} is registered already")
        self.datasets[dataset.name] = dataset

    def rows(self, spark: SparkSession, directory: str, name: str, **scope) -> DataFrame:
        """The dataset's rows within a scope. An unknown dataset or column, or a scope that is not complete, is refused."""
        if name not in self.datasets:
            raise ValueError(f"unknown dataset {name}")
        d = self.datasets[name]
        unknown = set(scope) - {*d.required, *d.one_of, *d.optional}
        lacking = [c for c in d.required if scope.get(c) is None]
        chosen = [c for c in d.one_of if scope.get(c) is not None]
        if unknown or lacking or (d.one_of and len(chosen) != 1):
            raise ValueError(f"{name}: unknown {sorted(unknown)}, lacking {lacking}, of {list(d.one_of)} given {chosen}")
        out = d.build(spark, directory)
        for column, value in scope.items():
            if value is not None:
                out = out.where(F.col(column).isin(value) if isinstance(value, (list, tuple)) else F.col(column) == value)
        return out

    def current(self, spark: SparkSession, directory: str, name: str, mark: str, **scope) -> tuple[DataFrame, bool]:
        """(rows, kept): rows written once for each mark of the sources (as of a change mark) and read again while it is unchanged."""
        key = (directory, name, repr(sorted(scope.items())))
        if key in self.kept and self.kept[key][0] == mark:
            return spark.read.parquet(self.kept[key][1]), True
        path = fresh_path(spark, f"dataset-{name}")
        self.rows(spark, directory, name, **scope).write.parquet(path)
        self.kept[key] = (mark, path)
        return spark.read.parquet(path), False
