from __future__ import annotations

import math

import numpy as np
import pytest

import array_kernels as K
from latticeworks.functions import profile as R


def test_pchip_goes_through_nodes_and_stays_monotone():
    x, y = np.array([0.0, 1, 2.5, 4, 7]), np.array([0.0, 1, 1, 5, 9])
    np.testing.assert_allclose(K.pchip(x, y, x), y)
    fine = K.pchip(x, y, np.linspace(0, 7, 500))
    assert (np.diff(fine) >= -1e-12).all()
    assert np.isnan(K.pchip(x, y, np.array([-1.0, 8.0]))).all()


def test_pchip_of_two_points_is_a_line():
    np.testing.assert_allclose(K.pchip(np.array([0.0, 2]), np.array([1.0, 5]), np.array([0.5, 1])), [2, 3])


def test_clean_series_sorts_drops_and_keeps_first():
    x, y = K.clean_series(np.array([3.0, 1, np.nan, 1, 2]), np.array([9.0, 5, 1, 7, np.nan]))
    assert x.tolist() == [1, 3] and y.tolist() == [5, 9]


@pytest.mark.parametrize("x,y", [([], []), ([1.0], [2.0]), ([100.0, 120.0], [1.0, 2.0])])
def test_preprocess_needs_two_points_in_range(x, y):
    assert K.preprocess_one(np.array(x), np.array(y)) is None


def test_preprocess_scales_to_one_and_masks():
    grid, lo, hi, a, b, n = K.preprocess_one(np.array([10.0, 20, 30]), np.array([0.0, 4, -1]))
    assert (a, b, n) == (10, 30, 3) and grid.max() <= 1 and grid[:lo].sum() == 0 and grid[hi + 1 :].sum() == 0
    assert K.GRID[lo] >= 10 and K.GRID[hi] <= 30


def test_peaks_by_prominence_distance_and_width():
    y = np.zeros(60)
    y[20], y[19], y[21], y[40] = 1.0, 0.5, 0.5, 0.2
    peaks, height, width = K.find_peaks(y, 0.1, 3)
    assert peaks.tolist() == [20, 40] and height.tolist() == [1.0, 0.2]
    assert width[0] == pytest.approx(2.0)
    assert K.find_peaks(y, 0.5, 3)[0].tolist() == [20]
    assert K.find_peaks(y, 0.1, 30)[0].tolist() == [20]


def test_gini_and_smoothing():
    assert K.gini(np.ones(10), 0.0) == pytest.approx(0, abs=1e-12)
    assert K.gini(np.array([]), 0.5) == 0.5
    np.testing.assert_allclose(K.smooth(np.ones(20), 7, "reflect"), 1)
    assert K.smooth(np.ones(20), 7, "zero")[0] == pytest.approx(4 / 7)


# --- the feature sets, once more, in plain Python ------------------------------------------------------------------


def pct(v, p):
    v, at = sorted(v), (len(v) - 1) * p / 100
    low = int(at)
    return v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low)


def mean(v):
    return sum(v) / len(v)


def sd(v):
    return math.sqrt(mean([(x - mean(v)) ** 2 for x in v]))


def moment(v, k, guard=0.0):
    m, s = mean(v), sd(v) + guard
    return mean([((x - m) / s) ** k for x in v])


def correlation(a, b):
    x, y = mean(a), mean(b)
    return mean([(p - x) * (q - y) for p, q in zip(a, b, strict=True)]) / (sd(a) * sd(b))


def gini(v):
    v, total, run, out = sorted(v), sum(v), 0.0, 0.0
    for x in v:
        run += x
        out += run / total
    return (len(v) + 1 - 2 * out) / len(v)


def moving(v, size, mirror):
    half, n = size // 2, len(v)
    get = lambda i: v[i] if 0 <= i < n else (v[-i - 1] if i < 0 else v[2 * n - 1 - i]) if mirror else 0.0
    return [sum(get(j) for j in range(i - half, i + half + 1)) / size for i in range(n)]


def peaks_of(v, prominence, distance):
    """(position, prominence, width at half prominence) of each peak."""
    top, i = [], 1
    while i < len(v) - 1:
        j = i
        while j < len(v) - 1 and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j < len(v) - 1 and v[j + 1] < v[i]:
            top.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(top, key=lambda p: -v[p]):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        bases = []
        for step in (-1, 1):
            low, q = v[p], p
            while 0 <= q < len(v) and v[q] <= v[p]:
                low, q = min(low, v[q]), q + step
            bases.append(low)
        height = v[p] - max(bases)
        if height < prominence:
            continue
        level, ends = v[p] - height / 2, []
        for step in (-1, 1):
            q = p
            while 0 <= q + step < len(v) and v[q] > level:
                q += step
            ends.append(q - step * (level - v[q]) / (v[q - step] - v[q]) if v[q] < level else q)
        out.append((p, height, ends[1] - ends[0]))
    return out


def diff(v):
    return [b - a for a, b in zip(v, v[1:], strict=False)]


def slopes(v):
    return max(abs(x) for x in [v[1] - v[0], v[-1] - v[-2], *((c - a) / 2 for a, c in zip(v, v[2:], strict=False))])


def middle(v, least=1):
    return pct(v, 50) if len(v) >= least else math.nan


def share(v, test):
    return mean([float(test(x)) for x in v])


def slow_a(y, lo, hi):
    x, v = zip(*((g, y[i]) for i, g in enumerate(K.GRID) if lo <= i <= hi and 10 <= g <= 70), strict=True)
    d, level = diff(v), middle(v) + 1e-6
    mid = middle(d)
    mad = middle([abs(z - mid) for z in d])
    found = peaks_of(moving(v, 7, True), 5 * (1.4826 * mad + 1e-6), 3)
    fine = [(x[p], w * K.STEP) for p, _, w in found if 0.005 < w * K.STEP < 5]
    low, high, wide = [w for a, w in fine if a < 40], [w for a, w in fine if a >= 40], moving(v, 201, True)
    gaps = diff([a for a, _ in fine if a >= 40])
    return {
        "coverage": (hi - lo + 1) / 4096, "noise_roughness": 1.4826 * mad / level, "noise_lag1_autocorr": correlation(d[:-1], d[1:]), "peak_sharpness": max(map(abs, d)) / level, "total_variation": sum(map(abs, d)) / (sum(v) + 1e-6),
        "bg_p05": pct(v, 5) / level, "bg_p25": pct(v, 25) / level, "int_median": middle(v) / level, "int_p95": pct(v, 95) / level, "int_skew": moment(v, 3, 1e-6), "int_kurtosis": moment(v, 4, 1e-6),
        "frac_gt_01": share(v, lambda z: z > 0.1), "frac_gt_03": share(v, lambda z: z > 0.3), "frac_gt_05": share(v, lambda z: z > 0.5), "gini": gini(v), "sparsity": share(v, lambda z: z < 0.01),
        "peak_density": len(found) / (x[-1] - x[0] + 1e-6), "fwhm_median": middle([w for _, w in fine]), "fwhm_lo": middle(low, 3), "fwhm_hi": middle(high, 3), "fwhm_trend": middle(high, 3) - middle(low, 3),
        "halo_strength": (max(wide) - pct(wide, 10)) / level, "doublet_frac": share(gaps, lambda g: 0.05 < g < 0.4) if gaps else 0.0, "dyn_range": pct(v, 99.9) / (pct(v, 5) + 1e-6), "win_cover": len(v) / sum(10 <= g <= 70 for g in K.GRID),
    }


def slow_b(y, lo, hi):
    x, v = K.GRID[lo : hi + 1].tolist(), list(y[lo : hi + 1])
    d, bend = diff(v), [abs(z) for z in diff(diff(v))]
    limit = middle(bend)
    flat = [z for z in bend if z <= limit]
    narrow, wide = moving(v, 23, False), moving(v, 183, False)
    third, found = max(3, len(v) // 3), peaks_of(v, 0.05, 3)
    widths, at = [w * K.STEP for _, _, w in found], [x[p] for p, _, _ in found]
    noise = max(len(v) * 0.5 / (math.pi * math.sqrt(mean([z * z for z in d]) + 1e-12)), 1)
    return {f"p{p:02d}": pct(v, p) for p in (5, 10, 25, 50, 75, 90)} | {
        "mean_i": mean(v), "std_i": sd(v), "skew_i": moment(v, 3), "kurt_i": moment(v, 4) - 3, "frac_gt_01": share(v, lambda z: z > 0.1), "frac_gt_03": share(v, lambda z: z > 0.3), "total_variation": mean([abs(z) for z in d]),
        "roughness": 1.4826 * middle(flat) / max(middle(v), 1e-6), "hf_noise": sd([a - b for a, b in zip(v, narrow, strict=True)]), "max_slope": slopes(v), "bg_p10": pct(narrow, 10), "bg_curvature": pct(narrow[:third], 10) - pct(narrow[-third:], 10),
        "gini": gini(v), "n_peaks": 10 * len(found) / max(x[-1] - x[0], 1), "peak_density_ratio": len(found) / noise, "median_fwhm": middle(widths, 3), "p90_fwhm": pct(widths, 90) if len(found) >= 3 else math.nan,
        "fwhm_theta_corr": correlation(at, widths) if len(found) >= 3 and sd(at) > 1 else math.nan, "halo_bump": (max(wide) - pct(wide, 10)) / max(middle(wide), 1e-6), "mask_frac": len(v) / 4096,
    }


def slow_c(y, lo, hi):
    x, v = zip(*((g, y[i]) for i, g in enumerate(K.GRID) if 10 <= g <= 70), strict=True)
    v, d, n = list(v), diff(v), len(v)
    mid = middle(d)
    noise = 1.4826 * middle([abs(z - mid) for z in d]) / math.sqrt(2) + 1e-9
    nine, wide = moving(v, 9, True), moving(v, 181, True)
    found, top = peaks_of(nine, max(6 * noise, 0.01), 5), max(max(nine), 1e-6)
    widths, heights = [w * K.STEP for _, _, w in found], [nine[p] / top for p, _, _ in found]
    strong = [p for p, _, _ in found if nine[p] / top > 0.25 and x[p] > 50]
    beside = [(nine[p], nine[p + 4 : min(p + 21, n)]) for p in strong]  # 0.10 and 0.45 degrees in steps of 0.022
    low, high = [w for w, (p, _, _) in zip(widths, found, strict=True) if x[p] < 40], [w for w, (p, _, _) in zip(widths, found, strict=True) if x[p] >= 40]
    p10, halo = pct(v, 10), max(wide) - middle(wide)
    return {
        "noise_pt": noise, "roughness_tv": mean([abs(z) for z in d]), "autocorr_1": correlation(v[:-1], v[1:]), "autocorr_3": correlation(v[:-3], v[3:]), "snr": (pct(nine, 99.5) - p10) / noise, "bg_p10": p10,
        "bg_curv": pct(v[: n // 4], 10) - pct(v[-(n // 4) :], 10), "skew": moment(v, 3), "kurtosis": moment(v, 4) - 3, "gini": gini(v), "iqr": pct(v, 75) - pct(v, 25), "frac_low": share(v, lambda z: z < 1.3 * p10),
        "n_peaks_per_deg": len(found) / (n * K.STEP), "fwhm_median": middle(widths), "fwhm_p25": pct(widths, 25) if widths else math.nan, "fwhm_p75": pct(widths, 75) if widths else math.nan, "fwhm_trend": middle(high, 2) - middle(low, 2),
        "mean_prom_rel": mean([h for _, h, _ in found]) / top if found else math.nan, "peak_h_mean": mean(heights) if found else math.nan, "peak_h_p25": pct(heights, 25) if found else math.nan, "max_slope": slopes(v),
        "halo_height": halo, "halo_frac": halo / max(max(wide), 1e-6), "doublet_frac": mean([float(len(z) >= 3 and 0.25 * h <= max(z) <= 0.75 * h) for h, z in beside]) if strong else math.nan,
        "p95_p50": (pct(v, 95) - middle(v)) / (middle(v) + 1e-6), "n_strong_peaks": float(sum(h / top > 0.15 for _, h, _ in found)),
    }


def pattern(seed, doublets):
    """Noise, a halo and peaks, some of them with a neighbour."""
    rng = np.random.default_rng(seed)
    y = 0.05 + 0.03 * np.exp(-((K.GRID - 28) ** 2) / 60) + rng.normal(0, 0.003, len(K.GRID))
    for at in rng.uniform(12, 68, 25):
        for shift, share_ in ((0, 1.0), (0.25, 0.5 * doublets)):
            y += rng.uniform(0.1, 0.8) * share_ * np.exp(-((K.GRID - at - shift) ** 2) / (2 * rng.uniform(0.03, 0.12) ** 2))
    return np.clip(y / y.max(), 0, 1)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("which,slow", [("a", slow_a), ("b", slow_b), ("c", slow_c)])
def test_feature_sets_equal_their_definitions(which, slow, seed):
    y, lo, hi = pattern(seed, seed % 2), [0, 300, 400, 0][seed], [4095, 3900, 3500, 4095][seed]
    got, want = K.SETS[which](y, lo, hi), slow(y, lo, hi)
    assert list(got) == list(want)
    for name, value in want.items():
        assert float(got[name]) == pytest.approx(value, rel=1e-9, abs=1e-12, nan_ok=True), name


def test_feature_sets_apply_their_conditions():
    y = np.abs(np.sin(np.arange(len(K.GRID)) / 50))
    assert K.features_a(y, 0, 50) is None and K.features_b(y, 0, 5) is None and K.features_c(y, 1000, 4095) is None
    assert len(K.features_a(y, 0, 4095)) == 25 and len(K.features_b(y, 0, 4095)) == 26 and len(K.features_c(y, 0, 4095)) == 26
    still = K.features_b(np.full(len(K.GRID), 0.5), 0, 4095)
    assert math.isnan(still["skew_i"]) and math.isnan(still["median_fwhm"]) and still["n_peaks"] == 0


def test_cubic_reflections_have_known_multiplicities():
    ops = []
    for p in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)):
        for s in range(8):
            m = np.zeros((3, 3), int)
            for i, j in enumerate(p):
                m[i, j] = -1 if s >> i & 1 else 1
            ops.append(m)
    hkl, d, mult = R.reflections(np.array([4.0, 4, 4, 90, 90, 90]), np.array(ops), 1.5406, 60)
    by = {tuple(sorted(np.abs(h))): m for h, m in zip(hkl.tolist(), mult, strict=True)}
    assert by[(0, 0, 1)] == 6 and by[(0, 1, 1)] == 12 and by[(1, 1, 1)] == 8
    np.testing.assert_allclose(d, 4 / np.sqrt((hkl**2).sum(axis=1)))


CELL, SITES, ELEMENTS, ONE = np.array([5.0, 5, 5, 90, 90, 90]), np.array([[0, 0, 0], [0.5, 0.5, 0.5]]), ["Na", "Cl"], np.eye(3, dtype=int)[None]


def test_profile_is_the_mean_of_peaks_over_bins():
    grid = np.arange(10, 80, 0.05)
    centres, amps, widths = np.array([30.0, 30.2, 60]), np.array([2.0, 1.0, 0.5]), np.array([0.1, 0.3, 0.2])
    got = R.integrate(centres, amps, widths, 0.4, grid)
    want = np.zeros(len(grid))
    for i, g in enumerate(grid):
        x = np.linspace(g - 0.05, g, 101)[1:]
        for c, a, w in zip(centres, amps, widths, strict=True):
            u = (x - c) / (w / 2)
            want[i] += (a * (0.4 / (1 + u**2) + 0.6 * np.exp(-np.log(2) * u**2)) * (np.abs(x - c) < 25 * w)).mean()
    np.testing.assert_allclose(got[1:], want[1:], atol=0.12 * want.max())
    assert got.sum() == pytest.approx(want.sum(), rel=0.01)
    assert not R.integrate(np.empty(0), np.empty(0), np.empty(0), 0.5, grid).any()


def test_generator_repeats_and_follows_its_mode():
    mode = R.Mode(1.5406, None, 5, 90, 0.02)
    one, two = (R.generate(CELL, SITES, ELEMENTS, ONE, mode, 7) for _ in range(2))
    np.testing.assert_array_equal(one[1], two[1])
    assert (one[1] != R.generate(CELL, SITES, ELEMENTS, ONE, mode, 8)[1]).any()
    assert len(one[0]) == 4251 and one[1].min() >= 0 and 10**1.9 <= one[2]["counts"] <= 10**3.1
    both = R.Mode(1.5406, 1.5444, 5, 90, 0.02)
    assert R.generate(CELL, SITES, ELEMENTS, ONE, both, 7)[2]["n_peaks"] > one[2]["n_peaks"]
    assert 10**3 <= R.generate(CELL, SITES, ELEMENTS, ONE, R.Mode(1.5406, None, 5, 90, 0.02, "broad"), 7)[2]["counts"] <= 10**4
    for bad in (R.Mode(1.5406, None, 5, 90, 0.0), R.Mode(1.5406, None, 5, 5.01, 0.02), R.Mode(1.5406, None, 5, 90, float("nan"))):
        with pytest.raises(ValueError):
            R.generate(CELL, SITES, ELEMENTS, ONE, bad, 7)


def test_peaks_have_the_positions_widths_and_heights_of_their_terms():
    mode = R.Mode(1.5406, 1.5444, 20, 80, 0.02)
    for seed in range(20):
        centres, amps, widths, drawn = R.peaks(CELL, SITES, ELEMENTS, ONE, mode, np.random.default_rng(seed))
        assert 10 <= drawn["size"] <= 200 and 0 <= drawn["strain"] <= 3e-3 and 0.75 <= drawn["texture"] <= 1.35 and abs(drawn["zero_shift"]) <= 0.04 and abs(drawn["displacement"]) <= 0.06
        lines = {round(np.degrees(2 * np.arcsin(w * np.sqrt(n) / 10)), 6) for w in (1.5406, 1.5444) for n in range(1, 60) if w * np.sqrt(n) < 10}
        assert {round(c, 6) for c in centres} <= lines and ((centres >= 18.5) & (centres <= 81.5)).all()
        size = np.degrees(0.9 * 1.5406 / (10 * drawn["size"] * np.cos(np.radians(centres / 2))))
        strain = np.degrees(4 * drawn["strain"] * np.tan(np.radians(centres / 2)))
        assert (widths >= np.minimum(np.hypot(size, strain), 2) * 0.999).all() and (widths >= 0.03).all() and (widths <= 2).all()


def test_thermal_motion_and_factor_tables():
    hkl, d, mult = R.reflections(CELL, ONE, 1.5406, 60)
    fixed, drawn = R.intensities(hkl, d, mult, SITES, ELEMENTS, 1.5406), R.intensities(hkl, d, mult, SITES, ELEMENTS, 1.5406, np.random.default_rng(1))
    s2 = 1 / (4 * d * d)
    b = np.random.default_rng(1).uniform(0.5, 3.0, 2)  # chlorine, then sodium
    f = {e: R.STRENGTH[e] * np.interp(s2, R.FACTOR_NODES, np.exp(-3 * R.FACTOR_NODES)) for e in ELEMENTS}
    sign = np.cos(np.pi * hkl.sum(axis=1))
    t = np.arcsin(1.5406 / (2 * d))
    lp = mult * (1 + np.cos(2 * t) ** 2) / (np.sin(t) ** 2 * np.cos(t))
    np.testing.assert_allclose(fixed, lp * ((f["Na"] + sign * f["Cl"]) * np.exp(-1.5 * s2)) ** 2)
    np.testing.assert_allclose(drawn, lp * (f["Na"] * np.exp(-b[1] * s2) + sign * f["Cl"] * np.exp(-b[0] * s2)) ** 2)
    flat = R.intensities(hkl, d, mult, SITES, ELEMENTS, 1.5406, factors={"Na": np.full(601, 2.0), "Cl": np.full(601, 1.0)})
    np.testing.assert_allclose(flat, lp * ((2 + sign) * np.exp(-1.5 * s2)) ** 2)


def test_noise_saturates_and_strikes_as_often_as_it_should():
    y, rng = np.full(500, 1.0), np.random.default_rng(0)
    made = [R.noisy(y, rng, 1e4) for _ in range(600)]
    assert 0.08 < np.mean([m.min() == m.max() or np.sum(m == np.sort(m)[-5]) > 50 for m in made]) < 0.17
    assert 0.10 < np.mean([m.max() > 1.25e4 for m in made]) < 0.20 and max((m > 1.25e4).sum() for m in made) <= 2
