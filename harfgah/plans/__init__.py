"""The queries of the engine itself: each module has QUERIES (name to function) and ORACLES (name to DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("words", "corpus", "candidates", "model", "metrics", "statistics", "conversion", "artifacts", "passes")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out |= import_module(f"harfgah.plans.{m}").QUERIES
    return out


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"harfgah.plans.{m}").ORACLES
    return out
