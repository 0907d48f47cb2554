"""Registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of quarry.plans with a dict QUERIES {name: (function, SQL or None)}.
MODULES: list[str] = ["metrics", "preprocess", "linear", "neighbors", "cluster", "trees", "streams", "kernel", "pairs", "rules", "numeric", "relations", "more"]
FLAGSHIP = "regression_report"


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(f"quarry.plans.{m}").QUERIES
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
