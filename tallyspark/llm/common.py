"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..plans.staging import fresh_path, shared_dir, written

__all__ = ["bounded", "components", "fresh_path", "shared_dir", "text_of", "written"]

#: Rows (of one number each) up to which a table is broadcast.
BROADCAST_ROWS = 1_000_000


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column with null as the empty string."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def bounded(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of ids, to be broadcast if it is counted to have few rows; beyond, joins shuffle both sides."""
    return F.broadcast(ids) if ids.count() <= rows else ids
