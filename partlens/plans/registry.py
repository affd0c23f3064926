"""Collects the registered queries of the engine's own families: name, DataFrame function, SQL oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of ``partlens.plans`` that each hold QUERIES and ORACLE_SQL.
FAMILIES: tuple[str, ...] = ("valuation", "relational", "aggregates", "text_rules", "decisions", "cleaning", "pricing", "ingest", "review", "collection", "profile", "streams")


def _modules():
    return [importlib.import_module(f"partlens.plans.{name}") for name in FAMILIES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.ORACLE_SQL.items()}
