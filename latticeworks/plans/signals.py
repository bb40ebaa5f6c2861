"""Features of series and vectors that have a relational form: differences, moments, noise, averages, peaks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from latticeworks.operators import peaks, regrid, series_features
from latticeworks.plans.common import SERIES_SQL, by_user, series
from latticeworks.registry import query
from latticeworks.sources.scratch import written

_S = f"s AS ({SERIES_SQL})"
_W = "PARTITION BY user_id ORDER BY i"


@query(f"WITH {_S} SELECT user_id, i, round(y - lag(y) OVER ({_W}), 6) AS d1, round(y - 2 * lag(y) OVER ({_W}) + lag(y, 2) OVER ({_W}), 6) AS d2 FROM s")
def differences(t):
    y, back = F.col("y"), lambda k: F.lag("y", k).over(by_user())
    return series(t).select("user_id", "i", F.round(y - back(1), 6).alias("d1"), F.round(y - 2 * back(1) + back(2), 6).alias("d2"))


@query(f"WITH {_S}, d AS (SELECT user_id, y, y - lag(y) OVER ({_W}) AS d FROM s) SELECT user_id, round(avg(abs(d)), 6) AS mean_step, round(sum(abs(d)) / sum(y), 6) AS relative FROM d GROUP BY user_id")
def total_variation(t):
    d = series(t).withColumn("d", F.abs(F.col("y") - F.lag("y").over(by_user())))
    return d.groupBy("user_id").agg(F.round(F.avg("d"), 6).alias("mean_step"), F.round(F.sum("d") / F.sum("y"), 6).alias("relative"))


@query(f"WITH {_S}, c AS (SELECT user_id, y, sum(y) OVER (PARTITION BY user_id ORDER BY y, i ROWS UNBOUNDED PRECEDING) AS cum FROM s), n AS (SELECT user_id, count(*) AS n, sum(y) AS total, sum(cum) AS cums FROM c GROUP BY 1) SELECT user_id, round((n + 1 - 2 * cums / total) / n, 6) AS gini FROM n")
def gini(t):
    up = Window.partitionBy("user_id").orderBy("y", "i").rowsBetween(Window.unboundedPreceding, 0)
    n = series(t).withColumn("cum", F.sum("y").over(up)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"), F.sum("cum").alias("cums"))
    return n.select("user_id", F.round((F.col("n") + 1 - 2 * F.col("cums") / F.col("total")) / F.col("n"), 6).alias("gini"))


@query(f"WITH {_S}, d AS (SELECT user_id, y - lag(y) OVER ({_W}) AS d FROM s), m AS (SELECT user_id, quantile_cont(d, 0.5) AS m FROM d GROUP BY 1) SELECT user_id, round(1.4826 * quantile_cont(abs(d - m), 0.5), 6) AS noise FROM d JOIN m USING (user_id) GROUP BY user_id")
def mad_noise(t):
    d = series(t).select("user_id", (F.col("y") - F.lag("y").over(by_user())).alias("d"))
    m = d.groupBy("user_id").agg(F.percentile("d", F.lit(0.5)).alias("m"))
    return d.join(m, "user_id").groupBy("user_id").agg(F.round(1.4826 * F.percentile(F.abs(F.col("d") - F.col("m")), F.lit(0.5)), 6).alias("noise"))


@query(f"WITH {_S}, l AS (SELECT user_id, y, lag(y) OVER ({_W}) AS a, lag(y, 3) OVER ({_W}) AS b FROM s) SELECT user_id, round(corr(y, a), 6) AS lag1, round(corr(y, b), 6) AS lag3 FROM l GROUP BY user_id")
def lag_autocorr(t):
    lagged = series(t).select("user_id", "y", F.lag("y").over(by_user()).alias("a"), F.lag("y", 3).over(by_user()).alias("b"))
    return lagged.groupBy("user_id").agg(F.round(F.corr("y", "a"), 6).alias("lag1"), F.round(F.corr("y", "b"), 6).alias("lag3"))


@query(f"""WITH {_S}, m AS (SELECT user_id, avg(y) AS mu, stddev_pop(y) AS sd FROM s GROUP BY 1)
SELECT user_id, round(avg(pow((y - mu) / sd, 3)), 5) AS skew, round(avg(pow((y - mu) / sd, 4)) - 3, 5) AS excess, round(avg(pow((y - mu) / (sd + 1e-6), 3)), 5) AS z3, round(avg(pow((y - mu) / (sd + 1e-6), 4)), 5) AS z4 FROM s JOIN m USING (user_id) GROUP BY user_id""")
def moments(t):
    """Two conventions: population skewness and excess kurtosis, and raw standardised moments with a guarded deviation."""
    s = series(t)
    m = s.groupBy("user_id").agg(F.avg("y").alias("mu"), F.stddev_pop("y").alias("sd"))
    z = (F.col("y") - F.col("mu")) / (F.col("sd") + 1e-6)
    return s.join(m, "user_id").groupBy("user_id").agg(F.round(F.skewness("y"), 5).alias("skew"), F.round(F.kurtosis("y"), 5).alias("excess"), F.round(F.avg(F.pow(z, 3)), 5).alias("z3"), F.round(F.avg(F.pow(z, 4)), 5).alias("z4"))


@query(f"WITH {_S} SELECT user_id, round(avg(CAST(y > 10 AS INTEGER)), 6) AS above, round(avg(CAST(y < 1 AS INTEGER)), 6) AS below FROM s GROUP BY 1")
def fraction_thresholds(t):
    return series(t).groupBy("user_id").agg(F.round(F.avg((F.col("y") > 10).cast("int")), 6).alias("above"), F.round(F.avg((F.col("y") < 1).cast("int")), 6).alias("below"))


@query(f"WITH {_S} SELECT user_id, i, round(coalesce(sum(y) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 0) / 7, 6) AS mean7 FROM s")
def moving_average(t):
    """Seven-point mean with zeros beyond the ends: the divisor stays 7."""
    return series(t).select("user_id", "i", F.round(F.sum("y").over(by_user().rowsBetween(-3, 3)) / 7, 6).alias("mean7"))


def _reflected_sql(size: int) -> str:
    h = size // 2
    return f"""WITH {_S}, n AS (SELECT user_id, count(*) AS n, list(y ORDER BY i) AS ys FROM s GROUP BY 1), k AS (SELECT user_id, n, ys, unnest(range(1, n + 1)) AS i FROM n)
SELECT user_id, i, round(list_sum(list_transform(range(i - {h} - 1, i + {h}), lambda j: ys[CASE WHEN (j % (2 * n) + 2 * n) % (2 * n) < n THEN (j % (2 * n) + 2 * n) % (2 * n) + 1 ELSE 2 * n - (j % (2 * n) + 2 * n) % (2 * n) END])) / {size}, 6) AS mean{size} FROM k"""


def _reflected_mean(t, size: int):
    """Centred mean with the ends mirrored, edge points repeated, however short the series: each point stands at all its places up to half the width beyond the ends, 2n apart and mirrored, so that one frame serves every point; only the series itself is exchanged."""
    h = size // 2
    i, n = F.col("i"), F.col("n")
    s = series(t).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    # The places a + 2nk between 1 - h and n + h, for a = i and, mirrored, a = 1 - i.
    turns = lambda a: F.transform(F.sequence(F.ceil((1 - h - a) / (2 * n)), F.floor((n + h - a) / (2 * n))), lambda k: a + 2 * n * k)
    back = F.when(F.floor((n + h - 1 + i) / (2 * n)) >= F.ceil((i - h) / (2 * n)), turns(1 - i))
    places = s.select("user_id", "n", "y", F.explode(F.concat(turns(i), F.coalesce(back, F.array().cast("array<bigint>")))).alias("i"))
    total = places.withColumn("total", F.sum("y").over(by_user().rowsBetween(-h, h)))
    return total.where((i >= 1) & (i <= n)).select("user_id", "i", F.round(F.col("total") / size, 6).alias(f"mean{size}"))


@query(_reflected_sql(7))
def moving_average_reflect(t):
    return _reflected_mean(t, 7)


@query(_reflected_sql(181))
def moving_average_reflect_wide(t):
    return _reflected_mean(t, 181)


@query(f"""WITH {_S}, g AS (SELECT user_id, CASE WHEN lag(y) OVER ({_W}) IS NULL THEN lead(y) OVER ({_W}) - y WHEN lead(y) OVER ({_W}) IS NULL THEN y - lag(y) OVER ({_W}) ELSE (lead(y) OVER ({_W}) - lag(y) OVER ({_W})) / 2 END AS g FROM s) SELECT user_id, round(max(abs(g)), 6) AS steepest FROM g GROUP BY 1""")
def gradient_max(t):
    a, b = F.lag("y").over(by_user()), F.lead("y").over(by_user())
    g = F.when(a.isNull(), b - F.col("y")).when(b.isNull(), F.col("y") - a).otherwise((b - a) / 2)
    return series(t).select("user_id", F.abs(g).alias("g")).groupBy("user_id").agg(F.round(F.max("g"), 6).alias("steepest"))


_PEAKS_SQL = f"{_S}, p AS (SELECT *, lag(y) OVER ({_W}) AS a, lead(y) OVER ({_W}) AS b FROM s), k AS (SELECT user_id, i, x, y FROM p WHERE y > a AND y > b)"


def _peaks(t):
    p = series(t).withColumns({"a": F.lag("y").over(by_user()), "b": F.lead("y").over(by_user())})
    return p.where("y > a and y > b").select("user_id", "i", "x", "y")


@query(f"WITH {_PEAKS_SQL} SELECT user_id, i, round(x, 6) AS x, y FROM k")
def local_maxima(t):
    return _peaks(t).select("user_id", "i", F.round("x", 6).alias("x"), "y")


_TOPS_SQL = f"""{_S}, flat AS (SELECT user_id, i, y FROM (SELECT *, lag(y) OVER ({_W}) AS b FROM s) WHERE b IS NULL OR y <> b),
k AS (SELECT user_id, (i + "end" - 1) // 2 AS i, y FROM (SELECT *, lead(i) OVER ({_W}) AS "end", lag(y) OVER ({_W}) AS a, lead(y) OVER ({_W}) AS b FROM flat) WHERE y > a AND y > b)"""

# Greedy, so in SQL a recursion over each user's peaks from the highest down.
_APART_SQL = f"""{_TOPS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY y DESC, i DESC) AS r FROM k),
g(user_id, r, kept) AS (
  SELECT user_id, r, [i] FROM o WHERE r = 1
  UNION ALL
  SELECT o.user_id, o.r, CASE WHEN len(list_filter(kept, lambda q: abs(q - o.i) < 3)) > 0 THEN kept ELSE list_append(kept, o.i) END FROM g JOIN o ON o.user_id = g.user_id AND o.r = g.r + 1),
d AS (SELECT user_id, unnest(max_by(kept, r)) AS i FROM g GROUP BY user_id), t AS (SELECT user_id, i, y FROM d JOIN k USING (user_id, i))"""

_HEIGHT_SQL = """
h AS (
  SELECT t.user_id, t.i, t.y, coalesce((SELECT max(s.i) FROM s WHERE s.user_id = t.user_id AND s.i < t.i AND s.y > t.y), 0) AS l,
    coalesce((SELECT min(s.i) FROM s WHERE s.user_id = t.user_id AND s.i > t.i AND s.y > t.y), 1000000000) AS r FROM {peaks} t),
p AS (
  SELECT h.user_id, h.i, h.y, h.y - greatest(min(s.y) FILTER (WHERE s.i <= h.i), min(s.y) FILTER (WHERE s.i >= h.i)) AS prominence
  FROM h JOIN s ON s.user_id = h.user_id AND s.i > l AND s.i < r GROUP BY h.user_id, h.i, h.y)"""


def _points(t):
    return series(t).select(F.col("user_id").alias("s"), "i", "y")


@query(f"WITH {_TOPS_SQL}, {_HEIGHT_SQL.format(peaks='k')} SELECT user_id, i, y, round(prominence, 6) AS prominence FROM p")
def peak_prominence(t):
    """Every local maximum with its height over its surroundings: up to the nearest higher point on either side, found through blocks of blocks."""
    turned = written(peaks.turns(_points(t)), "turns")
    found = peaks.prominences(peaks.blocks(turned), peaks.tops_of(turned))
    return found.select(F.col("s").alias("user_id"), "i", "y", F.round("prominence", 6).alias("prominence"))


@query(f"WITH RECURSIVE {_APART_SQL} SELECT user_id, i, y FROM t")
def peak_distance(t):
    """The peaks left when higher ones take the place of those nearer than three points."""
    return peaks.suppress(peaks.local_maxima(_points(t)), 3).select(F.col("s").alias("user_id"), "i", "y")


@query(f"""WITH RECURSIVE {_APART_SQL}, {_HEIGHT_SQL.format(peaks='t')},
q AS (SELECT *, y - prominence * 0.5 AS line FROM p WHERE prominence >= 20),
e AS (
  SELECT *, (SELECT max(s.i) FROM s WHERE s.user_id = q.user_id AND s.i < q.i AND s.y <= line) AS l, (SELECT min(s.i) FROM s WHERE s.user_id = q.user_id AND s.i > q.i AND s.y <= line) AS r FROM q)
SELECT e.user_id, e.i, e.y, round(prominence, 6) AS prominence,
  round(r - CASE WHEN b.y < line THEN (line - b.y) / (b1.y - b.y) ELSE 0 END - (l + CASE WHEN a.y < line THEN (line - a.y) / (a1.y - a.y) ELSE 0 END), 6) AS width
FROM e JOIN s a ON a.user_id = e.user_id AND a.i = l JOIN s a1 ON a1.user_id = e.user_id AND a1.i = l + 1 JOIN s b ON b.user_id = e.user_id AND b.i = r JOIN s b1 ON b1.user_id = e.user_id AND b1.i = r - 1""")
def peak_widths(t):
    """Peaks three points apart that stand out by twenty, with their widths at half that height."""
    found = peaks.find_peaks(_points(t), 20.0, 3)
    return found.select(F.col("s").alias("user_id"), "i", "y", F.round("prominence", 6).alias("prominence"), F.round("width", 6).alias("width"))


@query(f"WITH {_PEAKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY y DESC, i) AS r, max(y) OVER (PARTITION BY user_id) AS top FROM k) SELECT user_id, i, y, r AS rank FROM r WHERE r <= 5 AND y >= 0.05 * top")
def top_n_peaks(t):
    own = Window.partitionBy("user_id")
    r = _peaks(t).withColumns({"rank": F.row_number().over(own.orderBy(F.desc("y"), "i")).cast("long"), "top": F.max("y").over(own)})
    return r.where("rank <= 5 and y >= 0.05 * top").select("user_id", "i", "y", "rank")


@query(f"WITH {_PEAKS_SQL}, g AS (SELECT user_id, lead(x) OVER (PARTITION BY user_id ORDER BY i) - x AS gap FROM k) SELECT user_id, round(avg(CAST(gap BETWEEN 0.5 AND 2.0 AS INTEGER)), 6) AS doublets FROM g WHERE gap IS NOT NULL GROUP BY 1")
def adjacent_gap_fraction(t):
    gap = F.lead("x").over(by_user()) - F.col("x")
    return _peaks(t).select("user_id", gap.alias("gap")).where("gap is not null").groupBy("user_id").agg(F.round(F.avg(F.col("gap").between(0.5, 2.0).cast("int")), 6).alias("doublets"))


@query(f"WITH {_PEAKS_SQL} SELECT k.user_id, k.i, count(s.x) FILTER (WHERE s.y / k.y BETWEEN 0.25 AND 0.75) > 0 AS shoulder FROM k LEFT JOIN s ON s.user_id = k.user_id AND s.x BETWEEN k.x + 0.5 AND k.x + 2.5 GROUP BY k.user_id, k.i")
def shoulder_probe(t):
    """A point at a quarter to three quarters of the peak's height, just after it: a band join by slices as wide as the band, so that a peak looks into two, and a semi join, so that the first point found is enough."""
    low, high = 0.5, 2.5
    of = lambda x: F.floor(x / (high - low))
    s = series(t)
    tops = _peaks(t).withColumn("slice", F.explode(F.array_distinct(F.array(of(F.col("x") + low), of(F.col("x") + high)))))
    after = s.select(F.col("user_id").alias("u"), of(F.col("x")).alias("at"), F.col("x").alias("px"), F.col("y").alias("py"))
    on = (F.col("user_id") == F.col("u")) & (F.col("slice") == F.col("at")) & F.col("px").between(F.col("x") + low, F.col("x") + high) & F.try_divide("py", "y").between(0.25, 0.75)
    found = tops.join(after, on, "left_semi").select("user_id", "i").distinct().withColumn("shoulder", F.lit(True))
    return _peaks(t).select("user_id", "i").join(found, ["user_id", "i"], "left").select("user_id", "i", F.coalesce("shoulder", F.lit(False)).alias("shoulder"))


@query(f"""WITH {_S}, h AS (SELECT user_id, max(CAST(floor(x / 3) AS INTEGER)) AS top FROM s GROUP BY 1), b AS (SELECT user_id, CAST(floor(x / 3) AS INTEGER) AS bin, avg(y) AS y FROM s GROUP BY 1, 2), p AS (SELECT a.user_id AS one, c.user_id AS other, corr(a.y, c.y) AS r, count(*) AS n FROM b a JOIN b c ON a.bin = c.bin AND c.user_id = a.user_id + 1 GROUP BY 1, 2) SELECT one, other, round(r, 6) AS r, n FROM p""")
def profile_correlation(t):
    """Correlation of each binned series with the next one's."""
    b = series(t).groupBy("user_id", F.floor(F.col("x") / 3).cast("int").alias("bin")).agg(F.avg("y").alias("y"))
    a = b.select(F.col("user_id").alias("one"), (F.col("user_id") + 1).alias("other"), "bin", F.col("y").alias("a"))
    c = b.select(F.col("user_id").alias("other"), "bin", F.col("y").alias("c"))
    return a.join(c, ["other", "bin"]).groupBy("one", "other").agg(F.round(F.corr("a", "c"), 6).alias("r"), F.count(F.lit(1)).alias("n"))


# --- series on the common grid ---------------------------------------------------------------------------------------


def _end_sql(a: str, b: str, near: str, far: str) -> str:
    own = f"((2 * {a} + {b}) * {near} - {a} * {far}) / ({a} + {b})"
    return f"CASE WHEN {own} * {near} <= 0 THEN 0 WHEN {near} * {far} <= 0 AND abs({own}) > 3 * abs({near}) THEN 3 * {near} ELSE {own} END"


_GRIDDED_SQL = f"""{_S},
c AS (SELECT user_id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY user_id, x ORDER BY i) AS r FROM s WHERE isfinite(x) AND isfinite(y)) WHERE r = 1),
h AS (
  SELECT user_id, count(*) AS n, count(*) FILTER (WHERE x BETWEEN 0 AND 90) AS n_in, min(x) FILTER (WHERE x BETWEEN 0 AND 90) AS x_min, max(x) FILTER (WHERE x BETWEEN 0 AND 90) AS x_max,
    max(sqrt(greatest(y, 0))) FILTER (WHERE x BETWEEN 0 AND 90) AS top FROM c GROUP BY 1),
k AS (SELECT user_id, x, CASE WHEN top > 0 THEN sqrt(greatest(y, 0)) / top ELSE 0 END AS y FROM c JOIN h USING (user_id) WHERE x BETWEEN 0 AND 90 AND n_in >= 2),
p AS (
  SELECT *, lag(x, 2) OVER w AS xz, lag(x) OVER w AS xa, lead(x) OVER w AS xb, lead(x, 2) OVER w AS xc, lag(y, 2) OVER w AS yz, lag(y) OVER w AS ya, lead(y) OVER w AS yb, lead(y, 2) OVER w AS yc
  FROM k WINDOW w AS (PARTITION BY user_id ORDER BY x)),
q AS (SELECT *, xa - xz AS hz, x - xa AS ha, xb - x AS hb, xc - xb AS hc, (ya - yz) / (xa - xz) AS dz, (y - ya) / (x - xa) AS da, (yb - y) / (xb - x) AS db, (yc - yb) / (xc - xb) AS dc FROM p),
m AS (
  SELECT *, CASE WHEN xa IS NULL THEN CASE WHEN xc IS NULL THEN db ELSE {_end_sql("hb", "hc", "db", "dc")} END WHEN xb IS NULL THEN CASE WHEN xz IS NULL THEN da ELSE {_end_sql("ha", "hz", "da", "dz")} END
    WHEN da * db > 0 THEN 3 * (ha + hb) / ((2 * hb + ha) / da + (hb + 2 * ha) / db) ELSE 0 END AS m FROM q),
i AS (SELECT *, lead(m) OVER (PARTITION BY user_id ORDER BY x) AS mb FROM m),
b AS (SELECT *, unnest(range(CAST(floor(x / (90.0::DOUBLE / 4095)) AS BIGINT), least(CAST(ceil(xb / (90.0::DOUBLE / 4095)) AS BIGINT), 4095) + 1)) AS bin FROM i WHERE xb IS NOT NULL),
u AS (SELECT *, (g - x) / hb AS u FROM (SELECT *, CASE WHEN bin = 4095 THEN 90.0::DOUBLE ELSE bin * (90.0::DOUBLE / 4095) END AS g FROM b) WHERE g >= x AND (g < xb OR xc IS NULL AND g <= xb)),
v AS (
  SELECT user_id, CAST(bin AS INTEGER) AS bin, CAST(CAST(least(greatest(y * (1 + 2 * u) * (1 - u) * (1 - u) + hb * m * u * (1 - u) * (1 - u) + yb * u * u * (3 - 2 * u) + hb * mb * u * u * (u - 1), 0), 1) AS FLOAT) AS DOUBLE) AS value FROM u)"""


def gridded(t):
    """Every user's series on the common grid: heads and values."""
    return regrid.on_grid(series(t).select(F.col("user_id").alias("s"), "i", "x", "y"))


@query(f"""WITH {_GRIDDED_SQL}, t AS (SELECT user_id, min(bin) AS lo, max(bin) AS hi, round(avg(value), 6) AS level, round(max(value), 6) AS most FROM v GROUP BY 1)
SELECT user_id, CASE WHEN n_in >= 2 THEN n ELSE 0 END AS n, CASE WHEN n_in >= 2 THEN round(x_min, 6) END AS x_min, CASE WHEN n_in >= 2 THEN round(x_max, 6) END AS x_max, coalesce(lo, 0) AS lo, coalesce(hi, -1) AS hi, lo IS NULL AS failed, level, most
FROM h LEFT JOIN t USING (user_id)""")
def preprocess_series(t):
    """What becomes of each series: its points, ends and places on the grid, whether it failed, mean and maximum of its values."""
    heads, values = gridded(t)
    sums = values.groupBy("s").agg(F.round(F.avg("value"), 6).alias("level"), F.round(F.max("value"), 6).alias("most"))
    return heads.join(sums, "s", "left").select(F.col("s").alias("user_id"), "n", F.round("x_min", 6).alias("x_min"), F.round("x_max", 6).alias("x_max"), "lo", "hi", "failed", "level", "most")


@query(f"WITH {_GRIDDED_SQL} SELECT user_id, bin, round(value, 5) AS value FROM v WHERE value > 0.00001")
def regrid_pchip(t):
    """The regridded series in long form: every value of the common grid that is not zero."""
    return gridded(t)[1].where("value > 0.00001").select(F.col("s").alias("user_id"), "bin", F.round("value", 5).alias("value"))


def _features(t, make, low=0, high=regrid.BINS - 1):
    points = series(t, regrid.spread).select(F.col("user_id").alias("s"), "i", "x", "y")
    return make(regrid.arrays_on_grid(points, low, high)).withColumnRenamed("s", "user_id")


@query()
def feature_set_a(t):
    return _features(t, series_features.set_a, *series_features.window_places())


@query()
def feature_set_b(t):
    return _features(t, series_features.set_b)


@query()
def feature_set_c(t):
    return _features(t, series_features.set_c, *series_features.window_places())
