"""Running sums, ranks and hash quotas over whole tables without a window that holds one.

A table is cut into ranges or hash buckets, as many as its size asks for; their sums, a short table, say where each
begins, and windows run inside them only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeworks.operators.relational import null_safe_join
from latticeworks.sources.scratch import written


#: Rows of a range, about: as many as one task orders without effort.
RANGE_ROWS = 1_000_000


def ordered_ranges(df: DataFrame, by: Sequence[Column | str], rows: int | None = None, least: int = 1) -> DataFrame:
    """The table, written, cut into ranges of about half ``rows`` rows at most in the order of ``by``; ``_part`` rises with the order.

    Spark's own range exchange draws the splitters, for any types that can be ordered, a hundred samples a range. Rows
    that are equal in ``by`` must not be many: callers put a key that tells them apart at its end.
    """
    n = df.count()
    parts = max(least, -(-2 * n // (rows or RANGE_ROWS)))
    dealt = df.repartitionByRange(parts, *by) if parts > 1 else df.coalesce(1)
    return written(dealt.withColumn("_part", F.spark_partition_id()), "ranges")


def running_sums(df: DataFrame, value: str, sums: dict[str, Column], keys: Sequence[str] = (), ties: Sequence[str] = (), n: int = 1, rows: int | None = None) -> DataFrame:
    """Adds sums up to and including each row, in rising order of value and then ties, for each key; null keys are a key of their own, null values come first.

    Equal rows are one row with their number first. The different ones are cut into ranges of bounded size (``n`` at
    least) by key, value, ties and a hash of the row, so that a value which is half of the table is many ranges. Windows
    run inside ranges; sums of ranges, a short table, say where each begins. Values of any ordered type will do.
    """
    own = [f"_{k}" for k in sums]
    one = written(df.withColumns({f"_{k}": c for k, c in sums.items()}).groupBy(*df.columns, *own).agg(F.count(F.lit(1)).alias("_m")), "different")
    one = one.withColumn("_h", F.xxhash64(*df.columns))
    cut = ordered_ranges(one, [*keys, value, *ties, "_h"], rows, n)
    totals = cut.groupBy(*keys, "_part").agg(*(F.sum(F.col(f"_{k}") * F.col("_m")).alias(f"_t_{k}") for k in sums))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_part", *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in sums))
    inside = Window.partitionBy(*keys, "_part").orderBy(value, *ties, "_h").rowsBetween(Window.unboundedPreceding, 0)
    run = cut.withColumns({f"_r_{k}": F.sum(F.col(f"_{k}") * F.col("_m")).over(inside) for k in sums})
    out = null_safe_join(run, starts, [*keys, "_part"], "inner")
    copies = out.withColumn("_after", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    return copies.select(*df.columns, *((F.col(f"_s_{k}") + F.col(f"_r_{k}") - F.col("_after") * F.col(f"_{k}")).alias(k) for k in sums))


def take_by_hash(df: DataFrame, digest: str, ties: Sequence[str], quota: Callable[[Column], Column], strata: Sequence[str] = (), flag: str = "taken") -> DataFrame:
    """Adds a boolean: whether the row is among the first quota(n) of its stratum's n rows in order of a hexadecimal digest.

    Only the bucket in which the quota falls is ranked; buckets below it are taken as a whole.
    """
    own = df.withColumn("_bucket", F.substring(digest, 1, 3))
    sizes = own.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_k"))
    upto = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_k").over(upto), F.lit(0)), "_n": F.sum("_k").over(Window.partitionBy(*strata))})
    placed = null_safe_join(own, sizes, [*strata, "_bucket"], "inner") if strata else own.join(F.broadcast(sizes), "_bucket")
    placed = placed.withColumn("_quota", quota(F.col("_n")))  # 4,096 buckets
    edge = (F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("_k") > F.col("_quota"))
    rank = F.row_number().over(Window.partitionBy(*strata, "_bucket").orderBy(digest, *ties))
    ranked = placed.where(edge).withColumn(flag, F.col("_before") + rank <= F.col("_quota"))
    whole = placed.where(~edge).withColumn(flag, F.col("_before") + F.col("_k") <= F.col("_quota"))
    return whole.unionByName(ranked).select(*df.columns, flag)


def percentiles(df: DataFrame, value: str, points: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles, interpolated between neighbours, of each key: a row a key, a column a point; nulls are left out.

    Distinct values are counted first and ordered in buckets; only those at the wanted ranks are kept, two a point.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    upto = running_sums(counts, "_v", {"_to": F.col("_c")}, keys)
    upto = null_safe_join(upto, totals, keys, "inner") if keys else upto.join(F.broadcast(totals))
    # A value takes the ranks from _to - _c up to _to; rank r is at (n - 1) * p.
    at = {n: (F.col("_n") - 1) * F.lit(float(x)) for n, x in points.items()}
    holds = lambda r: (F.col("_to") - F.col("_c") <= r) & (r < F.col("_to"))
    low, high = ({n: holds(f(r)) for n, r in at.items()} for f in (F.floor, F.ceil))
    wanted = upto.where(F.greatest(*(F.greatest(low[n], high[n]) for n in points))) if len(points) > 1 else upto.where(next(iter(low.values())) | next(iter(high.values())))
    pick = lambda cond: F.max(F.when(cond, F.col("_v")))
    out = wanted.groupBy(*keys).agg(*((pick(low[n]) + (pick(high[n]) - pick(low[n])) * F.max(at[n] - F.floor(at[n]))).alias(n) for n in points))
    return out
