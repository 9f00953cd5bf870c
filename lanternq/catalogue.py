"""All queries of the engine outside the corpus subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES and ORACLE_SQL.
MODULES = ("lanternq.plans.pages", "lanternq.plans.documents", "lanternq.plans.analytics", "lanternq.plans.audits")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(m).ORACLE_SQL.items()}
