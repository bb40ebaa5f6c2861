"""Joins, de-duplication and set operators with the semantics that the engine's pipelines rely on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; unlike dropDuplicates the choice is fixed."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join on which null keys match null keys; key columns come from the left."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
    return left.join(right, on, how).drop(*(f"_r_{k}" for k in keys))


def one_to_one_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that fails at run time if a key repeats on either side."""

    def unique(df: DataFrame, side: str) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(key))
        message = F.concat(F.lit(f"repeated key on the {side}: "), F.col(key).cast("string"))
        return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("_n")

    return unique(left, "left").join(unique(right, "right"), key, "left")


def flag_membership(df: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """Adds a boolean: whether the row's key is among keys."""
    marked = keys.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(marked, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def first_match(df: DataFrame, key: str, candidates: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Prioritised lookup: for each key the match of the first candidate table that has one, with that table's name as method.

    Each candidate table has ``key`` and ``match``, one row a key at most.
    """
    out = df
    for i, (_, table) in enumerate(candidates):
        out = out.join(table.select(key, F.col("match").alias(f"_m{i}")), key, "left")
    found = [F.col(f"_m{i}").isNotNull() for i in range(len(candidates))]
    method = F.coalesce(*(F.when(c, F.lit(name)) for c, (name, _) in zip(found, candidates, strict=True)))
    match = F.coalesce(*(F.col(f"_m{i}") for i in range(len(candidates))))
    return out.withColumns({"match": match, "method": method}).drop(*(f"_m{i}" for i in range(len(candidates))))


def columns_missing(df: DataFrame, wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    """Wanted columns that are not there, and those there that were not wanted."""
    return [c for c in wanted if c not in df.columns], [c for c in df.columns if c not in wanted]


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """Fails if the two tables share a key."""
    shared = a.select(key).intersect(b.select(key)).limit(5).collect()  # five examples for the message
    if shared:
        raise AssertionError(f"{key} on both sides: {[r[0] for r in shared]}")
