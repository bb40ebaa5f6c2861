"""Three sets of features of gridded series, as expressions on one array a series (s, lo, hi, a, n, v), no longer than the
grid: ``operators.arrays``, and peaks by ``operators.peaks``. No set exchanges a value of the grid.

Each set has a row for every series it applies to; a feature that isn't defined is null. Values near the ends of a moving
mean are those of the mirrored series in sets A and C, and zeros beyond the ends in set B.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeworks.operators import arrays as A
from latticeworks.operators.peaks import peaks_of
from latticeworks.operators.regrid import BINS, SERIES, STEP, place

#: Fixed value: the window in which sets A and C look.
WINDOW = (10.0, 70.0)


def window_places() -> tuple[int, int]:
    """First and last place of the grid in the window."""
    inside = [b for b in range(BINS) if WINDOW[0] <= b * STEP <= WINDOW[1]]
    return inside[0], inside[-1]


def listed(heads: DataFrame, values: DataFrame, low: int = 0, high: int = BINS - 1) -> DataFrame:
    """(s, lo, hi, a, n, v) from rows (s, bin, value), as ``regrid.arrays_on_grid`` gives it from points."""
    v = F.transform(F.sort_array(F.collect_list(F.struct("bin", "value"))), lambda e: e["value"])
    own = values.where(F.col("bin").between(low, high)).groupBy("s").agg(F.min("bin").alias("a"), F.count(F.lit(1)).cast("int").alias("n"), v.alias("v"))
    return own.join(heads.select("s", "lo", "hi"), "s")


def features_a(heads: DataFrame, values: DataFrame) -> DataFrame:
    return set_a(listed(heads, values, *window_places()))


def features_b(heads: DataFrame, values: DataFrame) -> DataFrame:
    return set_b(listed(heads, values))


def features_c(heads: DataFrame, values: DataFrame) -> DataFrame:
    return set_c(listed(heads, values, *window_places()))


def _shaped(series: DataFrame, means: dict[str, tuple[int, bool]], of: str, least: Callable[[float], float], distance: int, lags: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds the deviation and central moments (sd, m3, m4), the median distance of steps from their median (mad), correlations with what comes ``lags`` later among values (v) or steps (d), moving means by name, and the peaks (tops) of one of the arrays that stand out by ``least(mad)``; then the values in order (o) and steps (d)."""
    numbers = ("sd", "m3", "m4", "mad", *lags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SERIES):
                part = batch.slice(first, SERIES)
                rows, found, arrays = [], [], {name: [] for name in means}
                for values in part.column("v"):
                    v = values.values.to_numpy()
                    own = {"v": v} | {name: A.moving(v, *how) for name, how in means.items()}
                    own["d"] = d = np.diff(v)
                    mad = float(np.median(np.abs(d - np.median(d))))
                    rows.append((*A.moments(v), mad, *(A.lagged(own[name], k) for name, k in lags.values())))
                    found.append(peaks_of(own[of], least(mad), distance))
                    for name in means:
                        arrays[name].append(own[name])
                peak = pa.struct([("i", pa.int64()), ("y", pa.float64()), ("prominence", pa.float64()), ("width", pa.float64())])
                found = [[dict(zip(("i", "y", "prominence", "width"), t, strict=True)) for t in own] for own in found]
                added = {name: pa.array(column, pa.float64()) for name, column in zip(numbers, zip(*rows, strict=True), strict=True)}
                added |= {name: pa.array(each, pa.list_(pa.float64())) for name, each in arrays.items()} | {"found": pa.array(found, pa.list_(peak))}
                yield pa.RecordBatch.from_arrays([*part.columns, *added.values()], names=[*part.schema.names, *added])

    kinds = ", ".join(f"{c} {kind}" for c, kind in (*series.dtypes, *((name, "double") for name in numbers), *((name, "array<double>") for name in means), ("found", "array<struct<i:bigint,y:double,prominence:double,width:double>>")))
    out = series.mapInArrow(run, kinds)
    return out.withColumns({"o": F.sort_array("v"), "d": A.steps(F.col("v")), "tops": F.transform("found", _top)}).drop("found")


def _top(t: Column) -> Column:
    """A peak with its place and its width at half its prominence, both in degrees."""
    return F.struct(t["i"].alias("i"), t["y"].alias("y"), t["prominence"].alias("prominence"), place(F.col("a") + t["i"]).alias("at"), (t["width"] * STEP).alias("fwhm"))


def _each(tops: Column | str, name: str) -> Column:
    return F.transform(tops, lambda t: t[name])


def _steepest() -> Column:
    """The steepest slope, one-sided at the ends."""
    inner = A.let(A.steps(F.col("v"), 2), lambda two: F.greatest(F.array_max(two), -F.array_min(two)) / 2)
    return F.greatest(F.abs(F.get("d", F.lit(0))), F.abs(F.element_at("d", -1)), inner)


def set_a(series: DataFrame) -> DataFrame:
    """The part of the window that a series covers, at least 100 places."""
    lo, hi = window_places()
    v, d, n = F.col("v"), F.col("d"), F.col("n")
    own = _shaped(series.where("n >= 100"), {"wide": (100, True), "near": (3, True)}, "near", lambda mad: 5 * (1.4826 * mad + 1e-6), 3, {"lag1": ("d", 1)})
    own = own.withColumn("fine", F.filter("tops", lambda t: (t["fwhm"] > 0.005) & (t["fwhm"] < 5)))
    own = own.withColumns({"sides": F.struct(F.filter("fine", lambda t: t["at"] < 40).alias("lo"), F.filter("fine", lambda t: t["at"] >= 40).alias("hi"))})
    own = own.withColumns({f"p{k}": A.at(F.col("o"), p) for k, p in enumerate((0.05, 0.25, 0.5, 0.95, 0.999))})
    own = own.withColumns({"level": F.col("p2") + 1e-6, "fwhm_lo": A.median(_each("sides.lo", "fwhm"), 3), "fwhm_hi": A.median(_each("sides.hi", "fwhm"), 3)})
    level = F.col("level")
    width = place(F.col("a") + n - 1) - place(F.col("a"))
    doublet = A.share(A.steps(_each("sides.hi", "at")), lambda gap: (gap > 0.05) & (gap < 0.4))
    return own.select(
        "s", ((F.col("hi") + 1 - F.col("lo")) / BINS).alias("coverage"), (1.4826 * F.col("mad") / level).alias("noise_roughness"), F.col("lag1").alias("noise_lag1_autocorr"),
        (F.greatest(F.array_max("d"), -F.array_min("d")) / level).alias("peak_sharpness"), (A.total(d, F.abs) / (A.total(v) + 1e-6)).alias("total_variation"),
        *((F.col(c) / level).alias(name) for c, name in (("p0", "bg_p05"), ("p1", "bg_p25"), ("p2", "int_median"), ("p3", "int_p95"))), *((F.col(f"m{k}") / F.pow(F.col("sd") + 1e-6, k)).alias(name) for k, name in ((3, "int_skew"), (4, "int_kurtosis"))),
        *(A.share(v, lambda x, least=least: x > least).alias(name) for least, name in ((0.1, "frac_gt_01"), (0.3, "frac_gt_03"), (0.5, "frac_gt_05"))), A.gini(F.col("o"), F.lit(0.0)).alias("gini"), A.share(v, lambda x: x < 0.01).alias("sparsity"),
        (F.size("tops") / (width + 1e-6)).alias("peak_density"), A.median(_each("fine", "fwhm")).alias("fwhm_median"), "fwhm_lo", "fwhm_hi", (F.col("fwhm_hi") - F.col("fwhm_lo")).alias("fwhm_trend"),
        ((F.array_max("wide") - A.q(F.col("wide"), 0.1)) / level).alias("halo_strength"), F.coalesce(doublet, F.lit(0.0)).alias("doublet_frac"), (F.col("p4") / (F.col("p0") + 1e-6)).alias("dyn_range"), (n / (hi - lo + 1)).alias("win_cover"),
    )


def set_b(series: DataFrame) -> DataFrame:
    """All places that a series covers, at least 20."""
    v, d, n, none = F.col("v"), F.col("d"), F.col("n"), F.lit(None).cast("double")
    half = lambda degrees: max(3, round(degrees / STEP) // 2 * 2 + 1) // 2
    own = _shaped(series.where("n >= 20"), {"narrow": (half(0.5), False), "wide": (half(4.0), False)}, "v", lambda mad: 0.05, 3, {})
    own = own.withColumn("bend", F.transform(A.steps(d), F.abs))
    names = {"p05": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    own = own.withColumns({name: A.at(F.col("o"), p) for name, p in names.items()} | {"third": F.greatest(F.lit(3), F.floor(n / 3)).cast("int"), "fwhm": _each("tops", "fwhm"), "at": _each("tops", "at"), "peaks": F.size("tops")})
    narrow, wide, sd, third, peaks = (F.col(c) for c in ("narrow", "wide", "sd", "third", "peaks"))
    flat = A.let(A.median(F.col("bend")), lambda m: A.median(F.filter("bend", lambda x: x <= m), 11))
    width = place(F.col("a") + n - 1) - place(F.col("a"))
    by_noise = F.greatest(n * 0.5 / (F.pi() * F.sqrt(A.mean(d, lambda x: x * x) + 1e-12)), F.lit(1.0))
    return own.select(
        "s", *names, A.mean(v).alias("mean_i"), sd.alias("std_i"), F.when(sd > 0, F.col("m3") / F.pow(sd, 3)).alias("skew_i"), F.when(sd > 0, F.col("m4") / F.pow(sd, 4) - 3).alias("kurt_i"),
        A.share(v, lambda x: x > 0.1).alias("frac_gt_01"), A.share(v, lambda x: x > 0.3).alias("frac_gt_03"), A.mean(d, F.abs).alias("total_variation"), (1.4826 * flat / F.greatest("p50", F.lit(1e-6))).alias("roughness"),
        A.deviation(F.zip_with(v, narrow, lambda x, y: x - y)).alias("hf_noise"), _steepest().alias("max_slope"), A.q(narrow, 0.1).alias("bg_p10"), (A.q(A.cut(narrow, 0, third), 0.1) - A.q(A.cut(narrow, n - third, third), 0.1)).alias("bg_curvature"),
        A.gini(F.col("o"), none).alias("gini"), (10 * peaks / F.greatest(width, F.lit(1.0))).alias("n_peaks"), (peaks / by_noise).alias("peak_density_ratio"), A.median(F.col("fwhm"), 3).alias("median_fwhm"), F.when(peaks >= 3, A.q(F.col("fwhm"), 0.9)).alias("p90_fwhm"),
        F.when((peaks >= 3) & (A.deviation(F.col("at")) > 1), A.correlation(F.col("at"), F.col("fwhm"), none)).alias("fwhm_theta_corr"),
        A.let(F.sort_array(wide), lambda o: (F.array_max(o) - A.at(o, 0.1)) / F.greatest(A.at(o, 0.5), F.lit(1e-6))).alias("halo_bump"), (n / BINS).alias("mask_frac"),
    )


def set_c(series: DataFrame) -> DataFrame:
    """The whole window, which a series must cover."""
    lo, hi = window_places()
    n, v = hi - lo + 1, F.col("v")
    noise_of = lambda mad: 1.4826 * mad / 2.0**0.5 + 1e-9
    own = _shaped(series.where((F.col("lo") <= lo) & (F.col("hi") >= hi)), {"nine": (4, True), "wide": (90, True)}, "nine", lambda mad: max(6 * noise_of(mad), 0.01), 5, {"lag1": ("v", 1), "lag3": ("v", 3)})
    own = own.withColumns({"noise_pt": noise_of(F.col("mad")), "top": F.greatest(F.array_max("nine"), F.lit(1e-6)), "w_max": F.array_max("wide")})
    own = own.withColumns({f"p{k}": A.at(F.col("o"), p) for k, p in enumerate((0.1, 0.25, 0.5, 0.75, 0.95))} | {"halo_height": F.col("w_max") - A.q(F.col("wide"), 0.5), "fwhm": _each("tops", "fwhm")})
    own = own.withColumn("height", A.let(F.col("top"), lambda most: F.transform("tops", lambda t: t["y"] / most)))
    sd, top, fwhm, noise, quarter = F.col("sd"), F.col("top"), F.col("fwhm"), F.col("noise_pt"), n // 4
    # Beside strong peaks at wide angles: the highest of at least three places between two distances after them.
    near, end = int(0.10 / STEP), int(0.45 / STEP)
    beside = lambda t: A.cut(F.col("nine"), (t["i"] + near).cast("int"), end - near + 1)
    strong = A.let(top, lambda most: F.filter("tops", lambda t: (t["y"] / most > 0.25) & (t["at"] > 50)))
    doublet = A.share(strong, lambda t: (F.size(beside(t)) >= 3) & F.array_max(beside(t)).between(0.25 * t["y"], 0.75 * t["y"]))
    trend = A.median(_each(F.filter("tops", lambda t: t["at"] >= 40), "fwhm"), 2) - A.median(_each(F.filter("tops", lambda t: t["at"] < 40), "fwhm"), 2)
    return own.select(
        "s", "noise_pt", A.mean(F.col("d"), F.abs).alias("roughness_tv"), *(F.coalesce(c, F.lit(0.0)).alias(name) for c, name in (("lag1", "autocorr_1"), ("lag3", "autocorr_3"))), ((A.q(F.col("nine"), 0.995) - F.col("p0")) / noise).alias("snr"), F.col("p0").alias("bg_p10"),
        (A.q(A.cut(v, 0, quarter), 0.1) - A.q(A.cut(v, n - quarter, quarter), 0.1)).alias("bg_curv"), F.when(sd > 0, F.col("m3") / F.pow(sd, 3)).alias("skew"), F.when(sd > 0, F.col("m4") / F.pow(sd, 4) - 3).alias("kurtosis"),
        A.gini(F.col("o"), F.lit(0.0)).alias("gini"), (F.col("p3") - F.col("p1")).alias("iqr"), A.let(F.col("p0"), lambda p: A.share(v, lambda x: x < 1.3 * p)).alias("frac_low"), (F.size("tops") / (n * STEP)).alias("n_peaks_per_deg"),
        A.q(fwhm, 0.5).alias("fwhm_median"), A.q(fwhm, 0.25).alias("fwhm_p25"), A.q(fwhm, 0.75).alias("fwhm_p75"), trend.alias("fwhm_trend"), (A.mean(_each("tops", "prominence")) / top).alias("mean_prom_rel"), A.mean(F.col("height")).alias("peak_h_mean"),
        A.q(F.col("height"), 0.25).alias("peak_h_p25"), _steepest().alias("max_slope"), "halo_height", (F.col("halo_height") / F.greatest("w_max", F.lit(1e-6))).alias("halo_frac"), doublet.alias("doublet_frac"),
        ((F.col("p4") - F.col("p2")) / (F.col("p2") + 1e-6)).alias("p95_p50"), A.let(top, lambda most: F.size(F.filter("tops", lambda t: t["prominence"] / most > 0.15))).cast("double").alias("n_strong_peaks"),
    )
