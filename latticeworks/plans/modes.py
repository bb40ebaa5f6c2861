"""Acquisition modes: grid statistics of each series, wavelength rules, tolerance clusters and the mode table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from latticeworks.operators.clustering import cluster_values
from latticeworks.operators.relational import null_safe_join
from latticeworks.plans.common import SERIES_SQL, by_user, hash_unit, series
from latticeworks.registry import Tables, query

_GRID_SQL = f"""
s AS ({SERIES_SQL}),
d AS (SELECT user_id, x, x - lag(x) OVER (PARTITION BY user_id ORDER BY i) AS dx FROM s),
g AS (SELECT user_id, count(*) AS n_points, min(x) AS x_min, max(x) AS x_max, quantile_cont(dx, 0.5) FILTER (WHERE dx > 0) AS step FROM d GROUP BY user_id)"""

#: Slices of [0, 1) in which drawn numbers meet the modes' intervals.
SLICES = 1024


def grid_stats(t: Tables):
    d = series(t).withColumn("dx", F.col("x") - F.lag("x").over(by_user()))
    return d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_points"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.percentile(F.when(F.col("dx") > 0, F.col("dx")), F.lit(0.5)).alias("step"))


@query(f"WITH {_GRID_SQL} SELECT user_id, n_points, round(x_min, 6) AS x_min, round(x_max, 6) AS x_max, round(step, 6) AS step FROM g")
def grid_stats_per_series(t):
    return grid_stats(t).select("user_id", "n_points", *(F.round(c, 6).alias(c) for c in ("x_min", "x_max", "step")))


_KEYED_SQL = f"""{_GRID_SQL},
k AS (SELECT user_id, CAST(nullif(user_id % 3, 0) AS DOUBLE) AS l1, CAST(nullif(user_id % 2, 0) AS DOUBLE) AS l2,
  round_even(x_min, 0) AS lo, round_even(x_max, 0) AS hi, round_even(step, 1) AS st, user_id % 5 = 0 AS labelled FROM g)"""


def _keyed(t: Tables):
    key = lambda n: F.nullif(F.col("user_id") % n, F.lit(0)).cast("double")
    return grid_stats(t).select("user_id", key(3).alias("l1"), key(2).alias("l2"), F.bround("x_min", 0).alias("lo"), F.bround("x_max", 0).alias("hi"), F.bround("step", 1).alias("st"), (F.col("user_id") % 5 == 0).alias("labelled"))


_KEY = ["l1", "l2", "lo", "hi", "st"]
_MODES_SQL = f"""{_KEYED_SQL},
a AS (SELECT l1, l2, lo, hi, st, count(*) AS count_all FROM k GROUP BY ALL),
f AS (SELECT l1, l2, lo, hi, st, count(*) AS count_ft FROM k WHERE labelled GROUP BY ALL),
j AS (SELECT a.*, coalesce(f.count_ft, 0) AS count_ft FROM a LEFT JOIN f ON a.l1 IS NOT DISTINCT FROM f.l1 AND a.l2 IS NOT DISTINCT FROM f.l2
  AND a.lo IS NOT DISTINCT FROM f.lo AND a.hi IS NOT DISTINCT FROM f.hi AND a.st IS NOT DISTINCT FROM f.st),
m AS (SELECT *, count_all / (SELECT sum(count_all) FROM j)::DOUBLE AS fraction_all, count_ft / greatest((SELECT sum(count_ft) FROM j), 1)::DOUBLE AS fraction_ft,
  row_number() OVER w - 1 AS mode_id, sum(count_all) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM j
  WINDOW w AS (ORDER BY count_all DESC, l1 NULLS LAST, l2 NULLS LAST, lo NULLS LAST, hi NULLS LAST, st NULLS LAST))"""


def modes(t: Tables):
    """Mode table: keys that hold nulls are grouped and joined as equal. The windows run over modes, not over series."""
    keyed = _keyed(t)
    every = keyed.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("count_all"))
    some = keyed.where("labelled").groupBy(*_KEY).agg(F.count(F.lit(1)).alias("count_ft"))
    joined = null_safe_join(every, some, _KEY).withColumn("count_ft", F.coalesce("count_ft", F.lit(0).cast("long")))
    whole = Window.partitionBy()
    order = Window.orderBy(F.desc("count_all"), *(F.asc_nulls_last(c) for c in _KEY))
    return joined.select(
        *_KEY, "count_all", "count_ft", (F.col("count_all") / F.sum("count_all").over(whole)).alias("fraction_all"), (F.col("count_ft") / F.greatest(F.sum("count_ft").over(whole), F.lit(1))).alias("fraction_ft"),
        (F.row_number().over(order) - 1).cast("long").alias("mode_id"), F.sum("count_all").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
    )


@query(f"WITH {_MODES_SQL} SELECT l1, l2, lo, hi, st, count_all, count_ft, round(fraction_all, 6) AS fraction_all, round(fraction_ft, 6) AS fraction_ft, mode_id, round(upto / (SELECT sum(count_all) FROM m)::DOUBLE, 6) AS cumulative FROM m")
def modes_table(t):
    total = F.sum("count_all").over(Window.partitionBy())
    return modes(t).select(*_KEY, "count_all", "count_ft", F.round("fraction_all", 6).alias("fraction_all"), F.round("fraction_ft", 6).alias("fraction_ft"), "mode_id", F.round(F.col("upto") / total, 6).alias("cumulative"))


@query(f"WITH {_MODES_SQL}, ks(k) AS (VALUES (1), (3), (5), (10), (20), (50), (100), (200), (500)) SELECT k, round(upto / (SELECT sum(count_all) FROM m)::DOUBLE, 6) AS coverage FROM ks JOIN m ON mode_id = k - 1")
def mode_topk_coverage(t):
    ks = t.spark.createDataFrame([(k,) for k in (1, 3, 5, 10, 20, 50, 100, 200, 500)], "k int")
    own = modes(t).withColumn("coverage", F.round(F.col("upto") / F.sum("count_all").over(Window.partitionBy()), 6))
    return own.join(F.broadcast(ks), F.col("mode_id") == F.col("k") - 1).select("k", "coverage")


_PAIR_SQL = "SELECT l_orderkey, l_partkey, nullif(l_tax, 0) AS p, nullif(l_discount, 0) AS s, l_quantity AS q, l_extendedprice AS e FROM lineitem"


def _pair(t: Tables):
    return t.lineitem.select("l_orderkey", "l_partkey", F.nullif("l_tax", F.lit(0.0)).alias("p"), F.nullif("l_discount", F.lit(0.0)).alias("s"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("e"))


@query(f"""SELECT l_orderkey, l_partkey, q, e, CASE WHEN p IS NOT NULL AND s IS NOT NULL THEN least(p, s) ELSE p END AS fix_1, CASE WHEN p IS NOT NULL AND s IS NOT NULL THEN greatest(p, s) ELSE s END AS fix_2,
CASE WHEN s IS NULL THEN p WHEN p IS NULL THEN NULL ELSE least(p, s) END AS mode_1, CASE WHEN s IS NULL OR p IS NULL THEN NULL ELSE greatest(p, s) END AS mode_2 FROM ({_PAIR_SQL})""")
def wavelength_order_fix(t):
    """Two rules: one orders a pair when both are known and leaves the rest; the other also drops a lone secondary."""
    both = F.col("p").isNotNull() & F.col("s").isNotNull()
    low, high = F.least("p", "s"), F.greatest("p", "s")
    return _pair(t).select("l_orderkey", "l_partkey", "q", "e", F.when(both, low).otherwise(F.col("p")).alias("fix_1"), F.when(both, high).otherwise(F.col("s")).alias("fix_2"), F.when(F.col("s").isNull(), F.col("p")).when(both, low).alias("mode_1"), F.when(both, high).alias("mode_2"))


@query(f"""SELECT count(*) AS n, count(*) FILTER (WHERE p IS NOT NULL AND s IS NOT NULL) AS n_both, count(*) FILTER (WHERE p IS NOT NULL AND s IS NULL) AS only_1, count(*) FILTER (WHERE p IS NULL AND s IS NOT NULL) AS only_2,
count(*) FILTER (WHERE p IS NULL AND s IS NULL) AS neither, count(*) FILTER (WHERE p > s) AS swapped FROM ({_PAIR_SQL})""")
def wavelength_presence_audit(t):
    p, s = F.col("p").isNotNull(), F.col("s").isNotNull()
    return _pair(t).agg(F.count(F.lit(1)).alias("n"), F.count_if(p & s).alias("n_both"), F.count_if(p & ~s).alias("only_1"), F.count_if(~p & s).alias("only_2"), F.count_if(~p & ~s).alias("neither"), F.count_if(F.col("p") > F.col("s")).alias("swapped"))


# The running mean makes the rule sequential: in SQL it is a recursion over the sorted values.
_CLUSTER_SQL = """
WITH RECURSIVE w AS (SELECT s_acctbal AS v, count(*) AS w FROM supplier GROUP BY 1), o AS (SELECT v, w, row_number() OVER (ORDER BY v) AS r FROM w),
c(r, v, k, total, n) AS (
  SELECT r, v, 0, v, 1 FROM o WHERE r = 1
  UNION ALL
  SELECT o.r, o.v, CASE WHEN abs(o.v - total / n) <= greatest(50.0, 0.02 * abs(total / n)) THEN k ELSE k + 1 END,
    CASE WHEN abs(o.v - total / n) <= greatest(50.0, 0.02 * abs(total / n)) THEN total + o.v ELSE o.v END,
    CASE WHEN abs(o.v - total / n) <= greatest(50.0, 0.02 * abs(total / n)) THEN n + 1 ELSE 1 END
  FROM c JOIN o ON o.r = c.r + 1),
x AS (SELECT c.v AS value, k AS cluster, w FROM c JOIN o USING (r)),
b AS (SELECT cluster, quantile_cont(value, 0.5) AS representative FROM (SELECT *, max(w) OVER (PARTITION BY cluster) AS m FROM x) WHERE w = m GROUP BY cluster)
SELECT value, cluster, round(representative, 6) AS representative FROM x JOIN b USING (cluster)"""


@query(_CLUSTER_SQL)
def tolerance_clusters(t):
    weighted = t.supplier.withColumn("w", F.lit(1))
    return cluster_values(weighted, "s_acctbal", "w", atol=50.0, rtol=0.02).withColumn("representative", F.round("representative", 6))


@query(_CLUSTER_SQL.split("SELECT value, cluster, round")[0] + "SELECT cluster, round(representative, 6) AS representative, count(*) AS members FROM x JOIN b USING (cluster) GROUP BY ALL")
def cluster_representative(t):
    return tolerance_clusters(t).groupBy("cluster", "representative").agg(F.count(F.lit(1)).alias("members"))


@query(f"WITH {_GRID_SQL} SELECT user_id, CAST(coalesce(x_min >= 1 AND x_max <= 89, false) AS INTEGER) AS in_window FROM g")
def angle_window_flag(t):
    return grid_stats(t).select("user_id", F.coalesce(((F.col("x_min") >= 1) & (F.col("x_max") <= 89)).cast("int"), F.lit(0)).alias("in_window"))


@query(f"""WITH {_MODES_SQL}, c AS (SELECT mode_id, sum(fraction_all) OVER (ORDER BY mode_id ROWS UNBOUNDED PRECEDING) AS hi, fraction_all FROM m),
u AS (SELECT c_custkey, CAST('0x' || substr(md5('draw|' || c_custkey), 1, 6) AS BIGINT) / 16777216.0::DOUBLE AS u FROM customer)
SELECT c_custkey, min(mode_id) AS mode_id FROM u JOIN c ON u < hi + 1e-12 GROUP BY c_custkey""")
def weighted_mode_draw(t):
    """Inverse-distribution draw: each row's hashed number falls into one mode's interval. Intervals and numbers meet by slices of [0, 1), so that a row sees a few modes, however many there are."""
    by_id = Window.orderBy("mode_id").rowsBetween(Window.unboundedPreceding, 0)  # the mode table, a row a mode
    hi = F.sum("fraction_all").over(by_id) + 1e-12
    cut = modes(t).select("mode_id", hi.alias("hi"), (hi - F.col("fraction_all")).alias("lo"))
    cut = cut.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("mode_id")), F.lit(0.0)))
    of = lambda c: F.least(F.floor(c * SLICES), F.lit(SLICES - 1))
    sliced = cut.select("mode_id", "lo", "hi", F.explode(F.sequence(of(F.col("lo")), of(F.col("hi")))).alias("slice"))
    drawn = t.customer.select("c_custkey", hash_unit("draw", "c_custkey").alias("u")).withColumn("slice", of(F.col("u")))
    return drawn.join(sliced, "slice").where("lo <= u and u < hi").select("c_custkey", "mode_id")


@query(f"""WITH s AS ({SERIES_SQL}), r AS (SELECT user_id, x, y, row_number() OVER (PARTITION BY user_id, round_even(x, 0) ORDER BY i) AS turn FROM s) SELECT user_id, round(x, 6) AS x, y FROM r WHERE turn = 1""")
def strict_increasing(t):
    """The first point of each equal (rounded) x."""
    turn = F.row_number().over(Window.partitionBy("user_id", F.bround("x", 0)).orderBy("i"))
    return series(t).withColumn("turn", turn).where("turn = 1").select("user_id", F.round("x", 6).alias("x"), "y")
