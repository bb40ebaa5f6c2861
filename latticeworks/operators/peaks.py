"""Peaks of series: local maxima, suppression by distance, prominence and width, as plans.

Points are rows (s, i, y): a series, a place in it counted without gaps, a value. Prominence and width ask, from a peak to
either side, for the nearest point beyond a value and for the least value on the way there. A series may be of any
length, so no array holds one: points are kept in blocks of ``BLOCK`` in order, blocks in blocks of blocks with their
greatest and least value, and so on until one block holds what is left of every series. A search looks through its own
block, goes up while there is nothing beyond the value, and down again into the block that has it: two joins a level, and
levels grow with the logarithm of the longest series.

Defined results: rows without a series, place or value are left out; flat tops count once, at their middle; points at the
ends of a series are no peaks; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeworks.sources.scratch import written

#: Points of a block, and blocks of a block of blocks.
BLOCK = 64


def turns(points: DataFrame) -> DataFrame:
    """(s, i, y, middle, top): where a series turns or ends, runs of equal values by their first point. A top is higher than the values on either side; its middle stands for it."""
    by = Window.partitionBy("s").orderBy("i")
    runs = points.dropna(subset=["s", "i", "y"]).select("s", "i", "y", F.lag("y").over(by).alias("b")).where("b is null or y <> b")
    runs = runs.select("s", "i", "y", F.lead("i").over(by).alias("end"), F.lag("y").over(by).alias("a"), F.lead("y").over(by).alias("b"))
    turned = runs.where("a is null or b is null or (y > a) = (y > b)")
    return turned.select("s", "i", "y", F.floor((F.col("i") + F.col("end") - 1) / 2).alias("middle"), F.coalesce(F.expr("y > a and y > b"), F.lit(False)).alias("top"))


def tops_of(turned: DataFrame) -> DataFrame:
    return turned.where("top").select("s", F.col("middle").alias("i"), "y")


def local_maxima(points: DataFrame) -> DataFrame:
    """(s, i, y): runs of equal values that are higher than the values on either side, by their middle point."""
    return tops_of(turns(points))


def suppress(peaks: DataFrame, distance: int) -> DataFrame:
    """The peaks that stay if they are taken from the highest down, the last of equals first, and each takes the place of those nearer than ``distance``.

    Peaks on either side of a gap of ``distance`` have nothing to do with one another, so the rule is a fold over each run
    of near peaks.
    """
    by = Window.partitionBy("s").orderBy("i")
    apart = F.coalesce(F.col("i") - F.lag("i").over(by) >= distance, F.lit(True)).cast("long")
    runs = peaks.withColumn("apart", apart).withColumn("run", F.sum("apart").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    falling = F.reverse(F.sort_array(F.collect_list(F.struct("y", "i"))))
    near = lambda kept, p: F.exists(kept, lambda q: F.abs(q["i"] - p["i"]) < distance)
    none = F.array().cast("array<struct<y:double,i:bigint>>")
    kept = F.aggregate("peaks", none, lambda kept, p: F.when(near(kept, p), kept).otherwise(F.concat(kept, F.array(p))))
    listed = runs.select("s", "run", F.col("y").cast("double").alias("y"), F.col("i").cast("long").alias("i")).groupBy("s", "run").agg(falling.alias("peaks"))
    return listed.select("s", F.explode(kept).alias("p")).select("s", "p.i", "p.y")


def blocks(points: DataFrame, size: int | None = None) -> list[DataFrame]:
    """Levels of blocks, written: (s, b, es) with es the entries (k, most, least) of block b in order."""
    size = size or BLOCK
    own = points.dropna(subset=["s", "i", "y"]).select("s", F.col("i").cast("long").alias("k"), F.col("y").cast("double").alias("most"), F.col("y").cast("double").alias("least"))
    out = []
    while True:
        entries = F.sort_array(F.collect_list(F.struct("k", "most", "least")))
        level = written(own.groupBy("s", F.floor(F.col("k") / size).alias("b")).agg(entries.alias("es")), "blocks")
        out.append(level)
        if level.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return out
        of = lambda f, name: f(F.transform("es", lambda e: e[name]))
        own = level.select("s", F.col("b").alias("k"), of(F.array_max, "most").alias("most"), of(F.array_min, "least").alias("least"))


def nearest(levels: list[DataFrame], queries: DataFrame, above: bool, left: bool, size: int | None = None) -> DataFrame:
    """For each query (s, i, v, ...) the nearest place before i (after it, if not ``left``) with a value above v (at most v, if not ``above``) as ``at``, null if there is none, and the least value between the two as ``low``."""
    size = size or BLOCK
    columns = queries.columns

    def beyond(e: Column) -> Column:
        return e["most"] > F.col("v") if above else e["least"] <= F.col("v")

    def before(a: Column, b: Column) -> Column:
        return a < b if left else a > b

    def look(df: DataFrame, level: DataFrame, block: Column, limit: bool) -> DataFrame:
        """Looks through a block: ``near`` is the nearest entry beyond v, ``passed`` the least value on the way."""
        met = df.withColumn("b", block).join(level, ["s", "b"], "left")  # a block without entries is passed over
        side = F.filter("es", lambda e: before(e["k"], F.col("at"))) if limit else F.col("es")
        hits = F.transform(F.filter("side", beyond), lambda e: e["k"])
        met = met.withColumn("side", side).withColumn("near", F.array_max(hits) if left else F.array_min(hits))
        way = F.filter("side", lambda e: F.col("near").isNull() | before(F.col("near"), e["k"]))
        return met.withColumn("low", F.least("low", F.array_min(F.transform(way, lambda e: e["least"]))))

    rest = queries.withColumns({"at": F.col("i").cast("long"), "low": F.lit(None).cast("double")})
    ends = []
    for n, level in enumerate(levels):
        met = look(rest, level, F.floor(F.col("at") / size), True)
        found = met.where("near is not null").select(*columns, F.col("near").alias("at"), "low")
        for below in reversed(levels[:n]):
            found = look(found, below, F.col("at"), False).select(*columns, F.col("near").alias("at"), "low")
        ends.append(found)
        rest = met.where("near is null").select(*columns, F.col("b").alias("at"), "low")
    out = rest.select(*columns, F.lit(None).cast("long").alias("at"), "low")
    for found in ends:
        out = out.unionByName(found)
    return out


def prominences(levels: list[DataFrame], peaks: DataFrame) -> DataFrame:
    """Adds ``prominence``: the height over the higher of the two least values up to the nearest higher points (or the series' ends). The points where the series turns or ends are enough: the least values are among them."""
    asked = peaks.withColumn("v", F.col("y"))
    low = lambda left, name: nearest(levels, asked, True, left).select("s", "i", F.coalesce(F.least("y", "low"), "y").alias(name))
    both = low(True, "_l").join(low(False, "_r"), ["s", "i"])
    return peaks.join(both, ["s", "i"]).select(*peaks.columns, (F.col("y") - F.greatest("_l", "_r")).alias("prominence"))


def _values(level: DataFrame, df: DataFrame, at: str, name: str, size: int) -> DataFrame:
    """Adds the value at a place of the series, from its block; null where there is none."""
    own = df.withColumn("_b", F.floor(F.col(at) / size))
    met = own.join(level.select("s", F.col("b").alias("_b"), "es"), ["s", "_b"], "left")
    return met.withColumn(name, F.get(F.filter("es", lambda e: e["k"] == F.col(at)), F.lit(0))["most"]).drop("_b", "es")


def widths(levels: list[DataFrame], peaks: DataFrame, share: float = 0.5, size: int | None = None) -> DataFrame:
    """Adds ``width``, in points: between the two places where the series, interpolated, falls to ``share`` of the prominence below the peak. The levels are those of all points."""
    size = size or BLOCK
    asked = peaks.withColumn("v", F.col("y") - F.col("prominence") * share)

    def edge(left: bool) -> DataFrame:
        step = 1 if left else -1
        own = nearest(levels, asked, False, left).select("s", "i", "v", F.coalesce("at", "i").alias("at"))
        own = own.withColumn("_next", F.col("at") + step)
        met = _values(levels[0], _values(levels[0], own, "at", "_at", size), "_next", "_in", size)
        part = F.when(F.col("_at") < F.col("v"), (F.col("v") - F.col("_at")) / (F.col("_in") - F.col("_at"))).otherwise(F.lit(0.0))
        return met.select("s", "i", (F.col("at") + step * part).alias("_left" if left else "_right"))

    both = edge(True).join(edge(False), ["s", "i"])
    return peaks.join(both, ["s", "i"]).select(*peaks.columns, (F.col("_right") - F.col("_left")).alias("width"))


def find_peaks(points: DataFrame, prominence: float | DataFrame, distance: int = 1) -> DataFrame:
    """(s, i, y, prominence, width) of the peaks that are left by distance and then stand out by ``prominence``: a number, or a table (s, least) of one for each series."""
    turned = written(turns(points), "turns")
    tall = prominences(blocks(turned.select("s", "i", "y")), suppress(tops_of(turned), distance))
    if isinstance(prominence, DataFrame):
        tall = tall.join(prominence.select("s", "least"), "s").where("prominence >= least").drop("least")
    else:
        tall = tall.where(F.col("prominence") >= prominence)
    tall = written(tall, "peaks")
    return widths(blocks(points), tall)


# --- peaks of arrays of bounded length -------------------------------------------------------------------------------


def peaks_of(y: np.ndarray, least: float, distance: int) -> list[tuple[int, float, float, float]]:
    """``find_peaks`` inside a task, for a series that is an array of bounded length, such as one on a grid: (i, y, prominence, width), places from 0. A peak costs a pass over the array."""
    step = np.flatnonzero(np.diff(y)) + 1
    if len(step) < 2:
        return []
    first, end, value = step[:-1], step[1:], y[step[:-1]]  # runs of equal values but for those at the ends
    top = (value > y[first - 1]) & (value > y[end])
    at = (first[top] + end[top] - 1) // 2
    kept = np.zeros(len(y) + 2 * distance, bool)
    for k in np.lexsort((at, y[at]))[::-1]:
        near = kept[at[k] + 1 : at[k] + 2 * distance]  # places nearer than the distance
        near[distance - 1] = not near.any()
    out = []
    for i in at[kept[at + distance]].tolist():
        before, after = y[i::-1], y[i:]
        lows = []
        for side in (before, after):
            higher = side > y[i]
            upto = int(higher.argmax())
            lows.append(side[: upto if higher[upto] else len(side)].min())
        prominence = float(y[i] - max(lows))
        if prominence < least:
            continue
        line, width = y[i] - prominence * 0.5, 0.0
        for side in (before, after):
            k = int((side <= line).argmax())
            width += k - ((line - side[k]) / (side[k - 1] - side[k]) if side[k] < line else 0.0)
        out.append((i, float(y[i]), prominence, float(width)))
    return out
