"""The catalogue of the library's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobsieve.plans import changes, display, documents, gate, landed, levels, relational, streams, texts, training

FLAGSHIP = "dedup_best_url"
MODULES = (relational, texts, gate, documents, display, landed, changes, levels, streams, training)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.oracle_sql().items()}
