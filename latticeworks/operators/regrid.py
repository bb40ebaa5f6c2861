"""Measured series on the common grid by monotone cubic interpolation, as a plan: slopes are windows over neighbouring
points, and each interval makes the grid's places inside it.

Points are rows (s, i, x, y), i their order of arrival. Defined results: null, NaN and infinite points are left out; of
equal x the first stands; negative y counts as 0; a series fails with fewer than two points, overall or within the grid's
range, or if no place of the grid lies between its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeworks.operators.relational import keep_one

#: Places of the common grid, and its last one.
BINS, TOP = 4096, 90.0
STEP = TOP / (BINS - 1)

#: Series whose values are made at once.
SERIES = 64


def place(b: Column) -> Column:
    """x of a place of the grid."""
    return F.when(b == BINS - 1, F.lit(TOP)).otherwise(b * F.lit(STEP))


def cleaned(points: DataFrame) -> DataFrame:
    """Finite points, the first of equal x."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    own = points.select("s", "i", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return keep_one(own.where(finite("x") & finite("y")), ["s", "x"], [F.col("i").asc()])


def _end(a: Column, b: Column, near: Column, far: Column) -> Column:
    """Slope at an end: from the two nearest intervals, without leaving the shape of the first."""
    s = ((2 * a + b) * near - a * far) / (a + b)
    return F.when(s * near <= 0, 0.0).when((near * far <= 0) & (F.abs(s) > 3 * F.abs(near)), 3 * near).otherwise(s)


def _slopes(points: DataFrame) -> DataFrame:
    """Adds to each point its slope, a harmonic mean of the neighbouring ones where these agree in sign, and the next point."""
    by = Window.partitionBy("s").orderBy("x")
    at = {f"{c}{n}": (F.lead(c, n) if n > 0 else F.lag(c, -n)).over(by) for n in (-2, -1, 1, 2) for c in "xy"}
    p = points.withColumns(at)
    h = lambda n: F.col(f"x{n + 1}" if n + 1 else "x") - F.col(f"x{n}" if n else "x")
    d = lambda n: (F.col(f"y{n + 1}" if n + 1 else "y") - F.col(f"y{n}" if n else "y")) / h(n)
    w1, w2 = 2 * h(0) + h(-1), h(0) + 2 * h(-1)
    inner = F.when(d(-1) * d(0) > 0, (w1 + w2) / (w1 / d(-1) + w2 / d(0))).otherwise(0.0)
    first = F.when(F.col("x2").isNull(), d(0)).otherwise(_end(h(0), h(1), d(0), d(1)))
    last = F.when(F.col("x-2").isNull(), d(-1)).otherwise(_end(h(-1), h(-2), d(-1), d(-2)))
    slope = F.when(F.col("x-1").isNull(), first).when(F.col("x1").isNull(), last).otherwise(inner)
    m = p.withColumn("m", slope)
    return m.withColumn("m1", F.lead("m").over(by))


_POINT = ("x", "y", "m", "x1", "y1", "m1")


def _curve(x, y, m, x1, y1, m1, g):
    """Value at ``g`` between a point and the next one: for columns and for numpy's arrays alike."""
    h, u = x1 - x, (g - x) / (x1 - x)
    return y * (1 + 2 * u) * (1 - u) * (1 - u) + h * m * u * (1 - u) * (1 - u) + y1 * u * u * (3 - 2 * u) + h * m1 * u * u * (u - 1)


def _intervals(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(s, n, x_min, x_max, lo, hi, failed) of every series, and (s, x, y, m, x1, y1, m1, first, last): each point but the last with the next one and the places of the grid from it up to the next."""
    clean = cleaned(points)
    inside = F.col("x").between(0.0, TOP)
    root = F.sqrt(F.greatest("y", F.lit(0.0)))
    heads = clean.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_in"), *(f(F.when(inside, F.col("x"))).alias(c) for c, f in (("x_min", F.min), ("x_max", F.max))), F.max(F.when(inside, root)).alias("top"))
    fine = heads.where("n_in >= 2")
    scaled = clean.where(inside).join(fine.select("s", "top"), "s").select("s", "x", F.when(F.col("top") > 0, root / F.col("top")).otherwise(0.0).alias("y"))
    cut = _slopes(scaled).where("x1 is not null")
    # A quotient may come out beside the place that it is.
    below, above = F.floor(F.col("x") / STEP), F.least(F.ceil(F.col("x1") / STEP), F.lit(BINS - 1))
    holds = lambda b: (place(b) < F.col("x1")) | F.col("x2").isNull() & (place(b) <= F.col("x1"))
    first = F.when(place(below) >= F.col("x"), below).otherwise(below + 1)
    last = F.when(holds(above), above).when(holds(above - 1), above - 1).otherwise(above - 2)
    cut = cut.select("s", "x", "y", "m", "x1", "y1", "m1", first.cast("int").alias("first"), last.cast("int").alias("last")).where("first <= last")
    lo, hi = F.ceil(F.col("x_min") / STEP), F.floor(F.col("x_max") / STEP)
    lo = F.when(place(lo - 1) >= F.col("x_min"), lo - 1).when(place(lo) < F.col("x_min"), lo + 1).otherwise(lo)
    hi = F.when((hi < BINS - 1) & (place(hi + 1) <= F.col("x_max")), hi + 1).when(place(hi) > F.col("x_max"), hi - 1).otherwise(hi)
    ok = (F.col("n_in") >= 2) & (lo <= hi)
    spans = {"lo": F.when(ok, lo).otherwise(0).cast("int"), "hi": F.when(ok, hi).otherwise(-1).cast("int")}
    kept = lambda c: F.when(F.col("n_in") >= 2, F.col(c)).alias(c)
    heads = heads.withColumns(spans).select("s", F.when(F.col("n_in") >= 2, F.col("n")).otherwise(0).alias("n"), kept("x_min"), kept("x_max"), "lo", "hi", (F.col("hi") < 0).alias("failed"))
    return heads, cut


def on_grid(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(s, n, x_min, x_max, lo, hi, failed) of every series, and (s, bin, value) at the places between a series' ends: roots over their maximum."""
    heads, cut = _intervals(points)
    g = cut.withColumn("bin", F.explode(F.sequence("first", "last")))
    v = _curve(*(F.col(c) for c in _POINT), place(F.col("bin")))
    return heads, g.select("s", "bin", F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)).cast("float").cast("double").alias("value"))


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns lists of intervals (cut) into lists of their values (v), a few series at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SERIES):
            part = batch.slice(at, SERIES)
            cut = part.column("cut").flatten()
            of = lambda c: cut.field(c).to_numpy()  # noqa: E731, B023
            sizes = of("last").astype(np.int64) - of("first") + 1
            ends = np.cumsum(sizes)
            bins = np.arange(ends[-1]) + np.repeat(of("first") - (ends - sizes), sizes)
            g = np.where(bins == BINS - 1, TOP, bins * STEP)
            v = np.clip(_curve(*(np.repeat(of(c), sizes) for c in _POINT), g), 0.0, 1.0).astype(np.float32).astype(np.float64)
            offsets = np.concatenate([[0], np.cumsum(part.column("n").to_numpy())]).astype(np.int32)
            kept = [c for c in part.schema.names if c != "cut"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.ListArray.from_arrays(offsets, v)], names=[*kept, "v"])


def spread(points: DataFrame, s: str) -> DataFrame:
    """Points by series, in partitions that aren't joined for the few bytes they hold. What orders a series' points needs no other exchange, if it comes after this one."""
    return points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), s)


def arrays_on_grid(points: DataFrame, low: int = 0, high: int = BINS - 1) -> DataFrame:
    """(s, lo, hi, a, n, v): the n values between places ``low`` and ``high`` of each series that has any, the first at place a, as one array, which is no longer than the grid.

    Only intervals that hold a place of the grid are gathered, so there are no more of them than places; their values are
    made in the row, so that the points are all that is exchanged: few bytes for much work, so they had better come by
    ``spread``.
    """
    heads, cut = _intervals(points)
    cut = cut.withColumns({"first": F.greatest("first", F.lit(low)), "last": F.least("last", F.lit(high))}).where("first <= last")
    own = cut.groupBy("s").agg(F.min("first").alias("a"), F.sum(F.col("last") - F.col("first") + 1).cast("int").alias("n"), F.sort_array(F.collect_list(F.struct("first", "last", *_POINT))).alias("cut"))
    own = own.join(heads.select("s", "lo", "hi"), "s").select("s", "lo", "hi", "a", "n", "cut")
    return own.mapInArrow(_filled, f"s {own.schema['s'].dataType.simpleString()}, lo int, hi int, a int, n int, v array<double>")


def dense(heads: DataFrame, values: DataFrame) -> DataFrame:
    """Adds the array ``y`` of all places of the grid: as long as the grid, whatever the series."""
    listed = values.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("bin", "value"))).alias("m"))
    y = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)).cast("float"))
    return heads.join(listed, "s", "left").withColumn("y", y).drop("m")
