"""Evaluation aggregates: masked accuracies, set-based F1, calibration, two-sample statistics. All are plain aggregates or windows over counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeworks.operators.ranks import running_sums
from latticeworks.operators.relational import null_safe_join


def masked_mean(value: Column, mask: Column) -> Column:
    """Mean of value over rows with the mask; null if there are none."""
    return F.avg(F.when(mask, value.cast("double")))


def micro_f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 from summed counts, with denominators kept off zero."""
    p = F.sum(tp) / F.greatest(F.sum(tp + fp), F.lit(1))
    r = F.sum(tp) / F.greatest(F.sum(tp + fn), F.lit(1))
    return 2 * p * r / F.greatest(p + r, F.lit(1e-9))


def set_counts(predicted: Column, true: Column) -> tuple[Column, Column, Column]:
    """(tp, fp, fn) of two sets of one row."""
    return F.size(F.array_intersect(predicted, true)), F.size(F.array_except(predicted, true)), F.size(F.array_except(true, predicted))


def by_value(df: DataFrame, value: str, side: Column, *keys: str) -> DataFrame:
    """Counts of each side at each distinct value, with running counts up to it: what KS, AUC and ROC need.

    Values are counted first and ordered in buckets, so no task orders all of them.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(side).alias("n1"), F.count_if(~side).alias("n0"))
    totals = counts.groupBy(*keys).agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    run = running_sums(counts, value, {"c1": F.col("n1"), "c0": F.col("n0")}, keys)
    return null_safe_join(run, totals, keys, "inner") if keys else run.join(F.broadcast(totals))


def ks_statistic(df: DataFrame, value: str, side: Column, *keys: str) -> DataFrame:
    """Largest distance of the two sides' distribution functions; null where a side has no rows."""
    return by_value(df, value, side, *keys).groupBy(*keys).agg(F.max(F.abs(F.col("c1") / F.nullif("t1", F.lit(0)) - F.col("c0") / F.nullif("t0", F.lit(0)))).alias("ks"), F.max("t1").alias("n1"), F.max("t0").alias("n0"))


def roc_auc(df: DataFrame, score: str, positive: Column, *keys: str) -> DataFrame:
    """Area under the ROC curve by ranks; ties count half."""
    v = by_value(df, score, positive, *keys)
    wins = F.sum(F.col("n1") * (F.col("c0") - F.col("n0") + F.col("n0") / 2))
    return v.groupBy(*keys).agg((wins / F.nullif(F.max("t1") * F.max("t0"), F.lit(0))).alias("auc"), F.max("t1").alias("n1"), F.max("t0").alias("n0"))


def calibrated_threshold(scored: DataFrame, p: str, positive: Column, least: float, fallback: float, thresholds: Sequence[float]) -> DataFrame:
    """One row: the first threshold at which the share of positives among rows with p above it reaches ``least``, its precision, and whether there is none and ``fallback`` stands in.

    Rows are counted by the number of thresholds they exceed, so a handful of counts says all.
    """
    marks = sorted(thresholds)
    level = F.size(F.filter(F.array(*(F.lit(float(t)) for t in marks)), lambda t: t < F.col(p)))
    counts = scored.where(F.col(p).isNotNull()).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("right"))
    above = lambda c, k: F.coalesce(F.sum(F.when(F.col("level") > k, F.col(c))), F.lit(0))
    swept = counts.agg(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), (above("right", k) / F.greatest(above("n", k), F.lit(1))).alias("precision")) for k, t in enumerate(marks))).alias("all"))
    first = F.try_element_at(F.filter("all", lambda x: x["precision"] >= least), F.lit(1))
    return swept.select(first.alias("f")).select(F.coalesce("f.threshold", F.lit(fallback)).alias("threshold"), F.col("f.precision").alias("precision"), F.col("f").isNull().alias("is_fallback"))
