"""All registered queries of the library with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import decisions, flows, ledger, lists, pairing, parties, proofs, records, statements, texts, utilities, worklists

FLAGSHIP = "list_query_page"
MODULES = (lists, ledger, pairing, parties, utilities, statements, worklists, records, decisions, texts, flows, proofs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
