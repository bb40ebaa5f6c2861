"""The jobs as registered queries, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import label_pools, series_store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (label_pools.job1_label_pools, series_store.job2_series_store)}


def oracle_sql() -> dict[str, str]:
    return {"job1_label_pools": label_pools.ORACLE_SQL, "job2_series_store": series_store.ORACLE_SQL}
