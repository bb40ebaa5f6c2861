"""Array kernels on measured series, in numpy over Arrow batches: monotone cubic regridding, peaks and feature sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The common grid, and the window in which two of the feature sets look.
GRID = np.linspace(0.0, 90.0, 4096)
WINDOW = (10.0, 70.0)
STEP = float(GRID[1] - GRID[0])


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone piecewise cubic interpolation (Fritsch and Butland's slopes); NaN outside [x[0], x[-1]]."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        slope = np.array([d[0], d[0]])
    else:
        slope = np.zeros(len(x))
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        same = d[:-1] * d[1:] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            slope[1:-1] = np.where(same, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)
        for end, near, far, a, b in ((0, 0, 1, h[0], h[1]), (-1, -1, -2, h[-1], h[-2])):
            s = ((2 * a + b) * d[near] - a * d[far]) / (a + b)
            if s * d[near] <= 0:
                s = 0.0
            elif d[near] * d[far] <= 0 and abs(s) > 3 * abs(d[near]):
                s = 3 * d[near]
            slope[end] = s
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    u = (at - x[k]) / h[k]
    out = y[k] * (1 + 2 * u) * (1 - u) ** 2 + h[k] * slope[k] * u * (1 - u) ** 2 + y[k + 1] * u**2 * (3 - 2 * u) + h[k] * slope[k + 1] * u**2 * (u - 1)
    return np.where((at < x[0]) | (at > x[-1]), np.nan, out)


def clean_series(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Finite points in order of x, the first of equal x."""
    fine = np.isfinite(x) & np.isfinite(y)
    x, y = x[fine], y[fine]
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    first = np.ones(len(x), bool)
    first[1:] = np.diff(x) > 0
    return x[first], y[first]


def preprocess_one(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, int, int, float, float, int] | None:
    """Series on the grid: values in [0, 1], first and last bin of the mask, first and last x, points; None if it fails."""
    x, y = clean_series(x, y)
    n = len(x)
    if n < 2:
        return None
    y = np.maximum(y, 0)
    inside = (x >= GRID[0]) & (x <= GRID[-1])
    x, y = x[inside], y[inside]
    if len(x) < 2:
        return None
    y = np.sqrt(y)
    y = y / y.max() if y.max() > 0 else np.zeros_like(y)
    grid = np.clip(np.nan_to_num(pchip(x, y, GRID)), 0, 1)
    mask = np.flatnonzero((GRID >= x[0]) & (GRID <= x[-1]))
    lo, hi = (int(mask[0]), int(mask[-1])) if len(mask) else (0, -1)
    grid[:lo] = 0
    grid[hi + 1 :] = 0
    return grid, lo, hi, float(x[0]), float(x[-1]), n


def arrays_of(column: pa.Array) -> list[np.ndarray]:
    """The float arrays of a list column; a null list is empty, a null value NaN."""
    values, at = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else values[:0] for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), valid.tolist(), strict=True)]


def list_column(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column of equally long rows."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel(), kind))


def preprocess(df: DataFrame, key: str) -> DataFrame:
    """key, y (4096 floats), lo, hi, x_min, x_max, n, failed for rows with arrays x and y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for a, b in zip(arrays_of(part.column("x")), arrays_of(part.column("y")), strict=True):
                    n = min(len(a), len(b))
                    out.append(preprocess_one(a[:n], b[:n]) or (np.zeros(len(GRID)), 0, -1, None, None, 0))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), list_column(np.array(columns[0], np.float32), pa.float32()), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32()), strict=True)), pa.array([h < 0 for h in columns[2]])],
                    names=[key, "y", "lo", "hi", "x_min", "x_max", "n", "failed"],
                )

    kind = dict(df.dtypes)[key]
    return df.select(key, "x", "y").mapInArrow(run, f"{key} {kind}, y array<float>, lo int, hi int, x_min double, x_max double, n int, failed boolean")


# --- peaks ---------------------------------------------------------------------------------------------------------


def prominences(y: np.ndarray, peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Height of each peak over the higher of its two lowest surroundings, and that base."""
    out, bases = np.empty(len(peaks)), np.empty(len(peaks))
    for k, p in enumerate(peaks):
        higher = np.flatnonzero(y[:p] > y[p])
        left = y[(higher[-1] if len(higher) else 0) : p + 1].min()
        higher = np.flatnonzero(y[p + 1 :] > y[p])
        right = y[p : (p + 1 + higher[0] if len(higher) else len(y))].min()
        bases[k] = max(left, right)
        out[k] = y[p] - bases[k]
    return out, bases


def find_peaks(y: np.ndarray, prominence: float, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of local maxima (middle of plateaus) at least ``distance`` apart, highest first, with their prominences and half-prominence widths."""
    change = np.flatnonzero(np.diff(y) != 0)
    starts, ends = np.concatenate([[0], change + 1]), np.concatenate([change, [len(y) - 1]])
    inner = (starts > 0) & (ends < len(y) - 1)
    a, b = starts[inner], ends[inner]
    top = (y[a - 1] < y[a]) & (y[b + 1] < y[b])
    peaks = (a[top] + b[top]) // 2
    keep = np.ones(len(peaks), bool)
    for k in np.argsort(y[peaks], kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(peaks - peaks[k]) < distance
            near[k] = False
            keep &= ~near
    peaks = peaks[keep]
    height, bases = prominences(y, peaks)
    fine = height >= prominence
    peaks, height = peaks[fine], height[fine]
    widths = np.empty(len(peaks))
    for k, p in enumerate(peaks):
        level = y[p] - height[k] / 2
        i = p
        while i > 0 and y[i] > level:
            i -= 1
        left = i + (level - y[i]) / (y[i + 1] - y[i]) if y[i] < level else float(i)
        j = p
        while j < len(y) - 1 and y[j] > level:
            j += 1
        right = j - (level - y[j]) / (y[j - 1] - y[j]) if y[j] < level else float(j)
        widths[k] = right - left
    return peaks, height, widths


def smooth(y: np.ndarray, size: int, edges: str) -> np.ndarray:
    """Moving mean over an odd ``size``; beyond the ends the series is mirrored (``reflect``) or zero (``zero``, as long as the longer of series and window)."""
    if edges == "zero":
        return np.convolve(y, np.ones(size) / size, mode="same")
    pad = np.pad(y, size // 2, mode="symmetric")
    sums = np.concatenate([[0.0], np.cumsum(pad)])
    return (sums[size:] - sums[:-size]) / size


def gini(y: np.ndarray, empty: float) -> float:
    total = y.sum()
    if not len(y) or total <= 0:
        return empty
    return float((len(y) + 1 - 2 * (np.cumsum(np.sort(y)) / total).sum()) / len(y))


def _corr(a: np.ndarray, b: np.ndarray, flat: float = np.nan) -> float:
    """Correlation; ``flat`` if one side doesn't vary."""
    return float(np.corrcoef(a, b)[0, 1]) if len(a) > 1 and a.std() >= 1e-12 and b.std() >= 1e-12 else flat


def _moment(y: np.ndarray, k: int, guard: float = 0.0) -> float:
    """Standardised central moment; NaN of a constant series without a guard."""
    sd = y.std() + guard
    return float((((y - y.mean()) / sd) ** k).mean()) if sd > 0 else np.nan


def _median(x: np.ndarray, least: int = 1) -> float:
    return float(np.median(x)) if len(x) >= least else np.nan


def features_a(y: np.ndarray, lo: int, hi: int) -> dict[str, float] | None:
    """Set A: the masked part of the window, at least 100 points. Widths and doublet gaps are those of peaks with a plausible width."""
    x = GRID[lo : hi + 1]
    inside = (x >= WINDOW[0]) & (x <= WINDOW[1])
    v, x = y[lo : hi + 1][inside], x[inside]
    if len(v) < 100:
        return None
    level, d = np.median(v) + 1e-6, np.diff(v)
    mad = np.median(np.abs(d - np.median(d)))
    peaks, _, widths = find_peaks(smooth(v, 7, "reflect"), 5 * (1.4826 * mad + 1e-6), 3)
    fwhm, at = widths * STEP, x[peaks]
    fine = (fwhm > 0.005) & (fwhm < 5)
    fwhm, at = fwhm[fine], at[fine]
    f_lo, f_hi = _median(fwhm[at < 40], 3), _median(fwhm[at >= 40], 3)
    gaps = np.diff(at[at >= 40])
    wide = smooth(v, 201, "reflect")
    p = np.percentile(v, [5, 25, 50, 95, 99.9])
    return {
        "coverage": (hi + 1 - lo) / len(GRID), "noise_roughness": 1.4826 * mad / level, "noise_lag1_autocorr": _corr(d[:-1], d[1:]), "peak_sharpness": np.abs(d).max() / level,
        "total_variation": np.abs(d).sum() / (v.sum() + 1e-6), "bg_p05": p[0] / level, "bg_p25": p[1] / level, "int_median": p[2] / level, "int_p95": p[3] / level, "int_skew": _moment(v, 3, 1e-6),
        "int_kurtosis": _moment(v, 4, 1e-6), "frac_gt_01": (v > 0.1).mean(), "frac_gt_03": (v > 0.3).mean(), "frac_gt_05": (v > 0.5).mean(), "gini": gini(v, 0.0), "sparsity": (v < 0.01).mean(),
        "peak_density": len(peaks) / (x[-1] - x[0] + 1e-6), "fwhm_median": _median(fwhm), "fwhm_lo": f_lo, "fwhm_hi": f_hi, "fwhm_trend": f_hi - f_lo,
        "halo_strength": (wide.max() - np.percentile(wide, 10)) / level, "doublet_frac": float(((gaps > 0.05) & (gaps < 0.4)).mean()) if len(gaps) else 0.0, "dyn_range": p[4] / (p[0] + 1e-6),
        "win_cover": len(v) / ((GRID >= WINDOW[0]) & (GRID <= WINDOW[1])).sum(),
    }


def features_b(y: np.ndarray, lo: int, hi: int) -> dict[str, float] | None:
    """Set B: all masked points, at least 20. Peak density is relative to the maxima that noise of the same step size would make."""
    v, x = y[lo : hi + 1], GRID[lo : hi + 1]
    if len(v) < 20:
        return None
    d, bend = np.diff(v), np.abs(np.diff(v, 2))
    flat = bend[bend <= np.median(bend)]
    narrow, wide = (smooth(v, max(3, round(degrees / STEP) // 2 * 2 + 1), "zero") for degrees in (0.5, 4.0))
    third = max(3, len(narrow) // 3)
    peaks, _, widths = find_peaks(v, 0.05, 3)
    enough, fwhm, at = len(peaks) >= 3, widths * STEP, x[peaks]
    by_noise = max(len(v) * 0.5 / (np.pi * np.sqrt((d**2).mean() + 1e-12)), 1)
    p = np.percentile(v, [5, 10, 25, 50, 75, 90])
    return dict(zip(("p05", "p10", "p25", "p50", "p75", "p90"), p.tolist(), strict=True)) | {
        "mean_i": v.mean(), "std_i": v.std(), "skew_i": _moment(v, 3), "kurt_i": _moment(v, 4) - 3, "frac_gt_01": (v > 0.1).mean(), "frac_gt_03": (v > 0.3).mean(), "total_variation": np.abs(d).mean(),
        "roughness": 1.4826 * np.median(flat) / max(p[3], 1e-6) if len(flat) > 10 else np.nan, "hf_noise": (v - narrow[: len(v)]).std(), "max_slope": np.abs(np.gradient(v)).max(), "bg_p10": np.percentile(narrow, 10),
        "bg_curvature": np.percentile(narrow[:third], 10) - np.percentile(narrow[-third:], 10), "gini": gini(v, np.nan), "n_peaks": 10 * len(peaks) / max(x[-1] - x[0], 1), "peak_density_ratio": len(peaks) / by_noise,
        "median_fwhm": _median(fwhm, 3), "p90_fwhm": float(np.percentile(fwhm, 90)) if enough else np.nan, "fwhm_theta_corr": _corr(at, fwhm) if enough and at.std() > 1 else np.nan,
        "halo_bump": (wide.max() - np.percentile(wide, 10)) / max(np.median(wide), 1e-6), "mask_frac": len(v) / len(GRID),
    }


def features_c(y: np.ndarray, lo: int, hi: int) -> dict[str, float] | None:
    """Set C: the whole window, which the mask must cover. Peak heights and prominences are relative to the smoothed maximum; doublets are looked for beside strong peaks at wide angles."""
    pick = np.flatnonzero((GRID >= WINDOW[0]) & (GRID <= WINDOW[1]))
    if lo > pick[0] or hi < pick[-1]:
        return None
    v, n = y[pick], len(pick)
    d = np.diff(v)
    noise = 1.4826 * np.median(np.abs(d - np.median(d))) / np.sqrt(2) + 1e-9
    quarter = n // 4
    p = np.percentile(v, [10, 25, 50, 75, 95])
    nine, wide = smooth(v, 9, "reflect"), smooth(v, 181, "reflect")
    top, halo = max(nine.max(), 1e-6), wide.max() - np.median(wide)
    peaks, prominence, widths = find_peaks(nine, max(6 * noise, 0.01), 5)
    fwhm, at, height = widths * STEP, GRID[pick[peaks]], nine[peaks] / top
    low, high = fwhm[at < 40], fwhm[at >= 40]
    strong = peaks[(height > 0.25) & (at > 50)]
    near, far = int(0.10 / STEP), int(0.45 / STEP) + 1
    beside = [nine[k + near : min(k + far, n)] for k in strong]
    doublets = [len(z) >= 3 and 0.25 * nine[k] <= z.max() <= 0.75 * nine[k] for k, z in zip(strong, beside, strict=True)]
    q = lambda z, p_: float(np.percentile(z, p_)) if len(z) else np.nan
    return {
        "noise_pt": noise, "roughness_tv": np.abs(d).mean(), "autocorr_1": _corr(v[:-1], v[1:], 0.0), "autocorr_3": _corr(v[:-3], v[3:], 0.0), "snr": (np.percentile(nine, 99.5) - p[0]) / noise, "bg_p10": p[0],
        "bg_curv": np.percentile(v[:quarter], 10) - np.percentile(v[-quarter:], 10), "skew": _moment(v, 3), "kurtosis": _moment(v, 4) - 3, "gini": gini(v, 0.0), "iqr": p[3] - p[1], "frac_low": (v < 1.3 * p[0]).mean(),
        "n_peaks_per_deg": len(peaks) / (n * STEP), "fwhm_median": _median(fwhm), "fwhm_p25": q(fwhm, 25), "fwhm_p75": q(fwhm, 75), "fwhm_trend": _median(high, 2) - _median(low, 2),
        "mean_prom_rel": float(prominence.mean() / top) if len(peaks) else np.nan, "peak_h_mean": float(height.mean()) if len(peaks) else np.nan, "peak_h_p25": q(height, 25), "max_slope": np.abs(np.gradient(v)).max(),
        "halo_height": halo, "halo_frac": halo / max(wide.max(), 1e-6), "doublet_frac": float(np.mean(doublets)) if doublets else np.nan, "p95_p50": (p[4] - p[2]) / (p[2] + 1e-6), "n_strong_peaks": float((prominence / top > 0.15).sum()),
    }


#: Names, limits and orders of the three sets.
SETS = {"a": features_a, "b": features_b, "c": features_c}


def features(df: DataFrame, key: str, which: str) -> DataFrame:
    """key and one double column a feature for preprocessed rows (y, lo, hi); all null where the set doesn't apply."""
    f = SETS[which]
    probe = np.abs(np.sin(np.arange(len(GRID)) / 37.0))
    names = list(f(probe, 0, len(GRID) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for y, lo, hi in zip(arrays_of(part.column("y")), part.column("lo").to_pylist(), part.column("hi").to_pylist(), strict=True):
                    own = (f(y, lo, hi) if len(y) == len(GRID) and lo is not None and hi is not None else None) or {}
                    rows.append([None if own.get(n) is None or not np.isfinite(own[n]) else float(own[n]) for n in names])
                yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array(c, pa.float64()) for c in zip(*rows, strict=True))], names=[key, *names])

    kind = dict(df.dtypes)[key]
    return df.select(key, "y", "lo", "hi").mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))
