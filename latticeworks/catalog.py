"""All registered queries of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from latticeworks.plans import evaluation, matching, modes, numeric, relational, signals, splits, text  # noqa: F401
from latticeworks.registry import ORACLE, QUERIES
from latticeworks.streaming import incremental  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
