"""Greedy tolerance clustering of the distinct values of a column, of any number.

A value joins the current cluster while it lies within ``max(atol, rtol * |centre|)`` of its running mean; the first
that doesn't starts the next cluster. The rule is sequential, but not everywhere: beyond some gap a value starts a
cluster whatever the mean is. Values are therefore put in order in ranges, cut into runs at such gaps, and each run is
folded by itself as a stream, with a mean and a count as all its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeworks.operators.ranks import ordered_ranges, percentiles, running_sums


def sure_gap(value: Column, atol: float, rtol: float) -> Column:
    """A gap after ``value`` beyond which the next value starts a cluster.

    Let c be the mean before ``value`` joined: |c| <= |value| + max(atol, rtol * |c|), so |c| <= (|value| + atol) / (1 - rtol),
    and the mean afterwards is between the two.
    """
    return F.greatest(F.lit(atol), rtol * (F.abs(value) + atol) / (1 - rtol))


def runs_of(distinct: DataFrame, atol: float, rtol: float) -> DataFrame:
    """(value, w, run): values between sure gaps share a run."""
    cut = ordered_ranges(distinct, ["value"])
    ends = cut.groupBy("_part").agg(F.max("value").alias("end"))
    ends = ends.select("_part", F.lag("end").over(Window.orderBy("_part")).alias("before"))  # a row a range
    inside = F.lag("value").over(Window.partitionBy("_part").orderBy("value"))
    last = F.coalesce(inside, F.col("before"))
    first = cut.join(ends, "_part").withColumn("last", last).withColumn("first", (F.col("last").isNull() | (F.col("value") - F.col("last") > sure_gap(F.col("last"), atol, rtol))).cast("long"))
    return running_sums(first.select("value", "w", "first"), "value", {"run": F.col("first")}).select("value", "w", "run")


def fold_runs(runs: DataFrame, atol: float, rtol: float) -> DataFrame:
    """(value, w, run, turn): the number of the value's cluster in its run, from 0. A task reads its runs one after another, in order."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, total, n, turn = None, 0.0, 0, 0
        for batch in batches:
            turns = np.empty(batch.num_rows, np.int64)
            for at, (value, own) in enumerate(zip(batch.column("value").to_pylist(), batch.column("run").to_pylist(), strict=True)):
                if own != run:
                    run, total, n, turn = own, 0.0, 0, 0
                elif abs(value - total / n) > max(atol, rtol * abs(total / n)):
                    total, n, turn = 0.0, 0, turn + 1
                total, n = total + value, n + 1
                turns[at] = turn
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(turns)], names=[*batch.schema.names, "turn"])

    return runs.select("value", "w", "run").repartition("run").sortWithinPartitions("run", "value").mapInArrow(fold, "value double, w long, run long, turn long")


def cluster_values(df: DataFrame, value: str, weight: str, atol: float, rtol: float = 0.0) -> DataFrame:
    """(value, cluster, representative): clusters count from 0 in rising order; the representative is the value of most weight, the median of ties. Nulls are left out."""
    if not 0 <= rtol < 1:
        raise ValueError("rtol must be at least 0 and less than 1")
    distinct = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value")).agg(F.sum(weight).cast("long").alias("w"))
    rows = fold_runs(runs_of(distinct, atol, rtol), atol, rtol)
    counts = rows.groupBy("run").agg((F.max("turn") + 1).alias("n"))
    starts = running_sums(counts, "run", {"upto": F.col("n")}).select("run", (F.col("upto") - F.col("n")).alias("start"))
    rows = rows.join(starts, "run").select("value", "w", (F.col("start") + F.col("turn")).cast("int").alias("cluster"))
    top = rows.groupBy("cluster").agg(F.max("w").alias("top"))
    best = percentiles(rows.join(top, "cluster").where("w = top"), "value", {"representative": 0.5}, ["cluster"])
    return rows.join(best, "cluster").select("value", "cluster", "representative")
