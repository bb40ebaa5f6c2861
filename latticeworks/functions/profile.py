"""Diffraction profiles: reflections of a structure, intensity integration over bins, and a seeded generator, in numpy."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def arrays_of(column: pa.Array) -> list[np.ndarray]:
    """The float arrays of a list column; a null list is empty, a null value NaN."""
    values, at = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else values[:0] for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), valid.tolist(), strict=True)]


#: Demonstration scattering strengths at zero angle (atomic numbers). Real tables are given by the caller.
STRENGTH = {"H": 1, "C": 6, "N": 7, "O": 8, "Na": 11, "Mg": 12, "Al": 13, "Si": 14, "S": 16, "Cl": 17, "K": 19, "Ca": 20, "Ti": 22, "Fe": 26, "Cu": 29, "Zn": 30}

# Fixed values of the generator. Angles are in degrees of two theta, sizes in nanometres.
FACTOR_NODES = np.linspace(0.0, 1.5, 601)  # (sin theta / wavelength) squared
B_RANGE, B_FIXED = (0.5, 3.0), 1.5
SCHERRER, SIZE_LOG_SD, SIZE_LIMITS = 0.9, 0.7, (10.0, 200.0)
U_RANGE, V_RANGE, WIDTH_LIMITS = (0.0, 4e-3), (-2e-3, 4e-3), (0.03, 2.0)
STRAIN_SD, STRAIN_MOST = 1.2e-3, 3e-3
ETA_RANGE, JITTER_SD = (0.3, 0.7), 0.25
LEAST_INTENSITY, MOST_PEAKS = 0.05, 4000
TEXTURE_SHARE, TEXTURE_RANGE = 0.28, (0.75, 1.35)
SECOND_WEIGHT = 0.5
ZERO_SHIFT, DISPLACEMENT = 0.04, 0.06
SLOPE_RANGE, CURVE_RANGE = (-0.03, 0.03), (-0.02, 0.02)
HALO_CENTRE, HALO_WIDTH = (12.0, 32.0), (4.0, 9.0)
SATURATION_SHARE, SATURATION_LEVEL = 0.12, (0.85, 0.99)
ZINGER_SHARE, ZINGER_NUMBER, ZINGER_HEIGHT = 0.15, (1, 3), (0.3, 1.2)
MARGIN = 1.5


@dataclass(frozen=True)
class Instrument:
    """What differs between families of instruments: mean log size, the constant width term, background, halo, and log10 of the counts at the maximum."""

    size_log_mean: float
    w: tuple[float, float]
    background: tuple[float, float]
    halo_share: float
    halo_height: tuple[float, float]
    counts: tuple[float, float]


#: Fixed values of two families: few counts and narrow peaks, many counts and broad ones.
FAMILIES = {
    "narrow": Instrument(4.381, (4e-4, 3.6e-3), (0.003, 0.04), 0.10, (0.01, 0.05), (1.9, 3.1)),
    "broad": Instrument(3.401, (1.2e-3, 8e-3), (0.04, 0.18), 0.18, (0.02, 0.08), (3.0, 4.0)),
}


@dataclass(frozen=True)
class Mode:
    """How a pattern was taken: one or two wavelengths, the grid, and the family."""

    lambda_1: float
    lambda_2: float | None
    x_min: float
    x_max: float
    step: float
    family: str = "narrow"

    def grid(self) -> np.ndarray:
        if not (math.isfinite(self.step) and self.step > 0):
            raise ValueError("step")
        out = np.arange(self.x_min, self.x_max + self.step * 0.25, self.step)
        if len(out) < 5:
            raise ValueError("grid")
        return out


def lattice(cell: np.ndarray) -> np.ndarray:
    """Rows are the cell's vectors."""
    a, b, c = cell[:3]
    x, y, z = np.cos(np.radians(cell[3:]))
    s = np.sin(np.radians(cell[5]))
    cy = (x - y * z) / s
    return np.array([[a, 0, 0], [b * z, b * s, 0], [c * y, c * cy, c * np.sqrt(max(1 - y * y - cy * cy, 1e-12))]])


def reciprocal(cell: np.ndarray) -> np.ndarray:
    """Rows are the reciprocal vectors, without a factor of two pi."""
    return np.linalg.inv(lattice(cell)).T


def reflections(cell: np.ndarray, rotations: np.ndarray, wavelength: float, top: float, bottom: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hkl, d, multiplicity): one index triple for each orbit under the rotations and inversion, two theta from bottom to top."""
    low = wavelength / (2 * np.sin(np.radians(min(top, 179.9) / 2)))
    high = wavelength / (2 * np.sin(np.radians(max(bottom, 0.05) / 2)))
    span = np.floor(np.linalg.norm(lattice(cell), axis=1) / low).astype(int) + 1
    hkl = np.stack(np.meshgrid(*(np.arange(-n, n + 1) for n in span), indexing="ij"), -1).reshape(-1, 3)
    q = np.linalg.norm(hkl @ reciprocal(cell), axis=1)
    hkl = hkl[(q > 1e-9) & (q <= 1 / low + 1e-9)]
    ops = np.concatenate([rotations, -rotations]).astype(int)
    images = np.einsum("nj,kjl->nkl", hkl, ops)
    base = 2 * int(np.abs(images).max(initial=1)) + 1
    codes = ((images[..., 0] * base) + images[..., 1]) * base + images[..., 2]
    orbit, first, count = np.unique(codes.max(axis=1), return_index=True, return_counts=True)
    d = 1 / np.linalg.norm(hkl[first] @ reciprocal(cell), axis=1)
    inside = (d <= high) & (wavelength < 2 * d)
    return hkl[first][inside], d[inside], count[inside]


def form_factor(element: str, s2: np.ndarray, factors: Mapping[str, np.ndarray] | None = None) -> np.ndarray:
    """Scattering factor of an element, interpolated on the 601 nodes of its table. Without tables a single Gaussian stands in."""
    table = factors[element] if factors else STRENGTH.get(element, 10) * np.exp(-3.0 * FACTOR_NODES)
    return np.interp(s2, FACTOR_NODES, table)


def intensities(hkl: np.ndarray, d: np.ndarray, mult: np.ndarray, sites: np.ndarray, elements: list[str], wavelength: float, rng: np.random.Generator | None = None, factors: Mapping[str, np.ndarray] | None = None) -> np.ndarray:
    """Multiplicity, squared structure factor and Lorentz-polarisation factor of each reflection. Thermal motion has one B an element: drawn, or 1.5 without a generator."""
    s2 = 1 / (4 * d * d)
    damped = {}
    for e in sorted(set(elements)):
        damped[e] = form_factor(e, s2, factors) * np.exp(-(rng.uniform(*B_RANGE) if rng else B_FIXED) * s2)
    f = np.array([damped[e] for e in elements])
    phase = np.exp(2j * np.pi * (sites @ hkl.T))
    t = np.arcsin(np.clip(wavelength / (2 * d), 0, 1))
    lp = (1 + np.cos(2 * t) ** 2) / (np.sin(t) ** 2 * np.cos(t))
    return mult * np.abs((f * phase).sum(axis=0)) ** 2 * lp


def pseudo_voigt(x: np.ndarray, centre: float, width: float, eta: float) -> np.ndarray:
    """Of height 1 and of one width at half maximum."""
    u = (x - centre) / (width / 2)
    return eta / (1 + u * u) + (1 - eta) * np.exp(-math.log(2) * u * u)


def integrate(centres: np.ndarray, amps: np.ndarray, widths: np.ndarray, eta: float, grid: np.ndarray) -> np.ndarray:
    """Mean of all peaks over each bin (grid[i - 1], grid[i]]: sub-bins of a quarter of the narrowest width, 40 at most; a peak reaches 25 widths."""
    if not len(centres):
        return np.zeros(len(grid))
    step = grid[1] - grid[0]
    n = int(np.clip(np.ceil(step / max(widths.min() / 4, 1e-4)), 1, 40))
    fine = np.arange(grid[0] - step / 2, grid[-1] + step / 2 + step / n / 2, step / n)
    y = np.zeros(len(fine))
    for c, a, w in zip(centres, amps, widths, strict=True):
        lo, hi = np.searchsorted(fine, (c - 25 * w, c + 25 * w))
        y[lo:hi] += a * pseudo_voigt(fine[lo:hi], c, w, eta)
    ends = np.searchsorted(fine, grid, side="right")
    sums = np.concatenate([[0.0], np.cumsum(y)])
    starts = np.append(0, ends[:-1])
    return np.maximum((sums[ends] - sums[starts]) / np.maximum(ends - starts, 1), 0)


def seed_of(source: str, sample: object) -> int:
    return zlib.crc32(f"{source}:{sample}".encode())


def noisy(y: np.ndarray, rng: np.random.Generator, counts: float) -> np.ndarray:
    """Counts with Poisson noise, ``counts`` expected at the maximum; sometimes a saturated detector, sometimes single bins struck."""
    out = rng.poisson(y * (counts / y.max())).astype(float)
    if rng.random() < SATURATION_SHARE:
        out = np.minimum(out, counts * rng.uniform(*SATURATION_LEVEL))
    if rng.random() < ZINGER_SHARE:
        for _ in range(int(rng.integers(*ZINGER_NUMBER))):
            out[int(rng.integers(0, len(out)))] += counts * rng.uniform(*ZINGER_HEIGHT)
    return out


def peaks(cell: np.ndarray, sites: np.ndarray, elements: list[str], rotations: np.ndarray, mode: Mode, rng: np.random.Generator, factors: Mapping[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, float]]:
    """Centres, heights and widths of a sample's peaks before shifts, for each wavelength, and what was drawn for the sample."""
    own, grid = FAMILIES[mode.family], mode.grid()
    size = float(np.clip(rng.lognormal(own.size_log_mean, SIZE_LOG_SD), *SIZE_LIMITS))
    w, u, v = rng.uniform(*own.w), rng.uniform(*U_RANGE), rng.uniform(*V_RANGE)
    strain = min(abs(rng.normal(0, STRAIN_SD)), STRAIN_MOST)
    eta = rng.uniform(*ETA_RANGE)
    texture = rng.uniform(*TEXTURE_RANGE) if rng.random() < TEXTURE_SHARE else 1.0
    axis = rng.normal(size=3)
    axis /= np.linalg.norm(axis)
    zero, shift = rng.uniform(-ZERO_SHIFT, ZERO_SHIFT), rng.uniform(-DISPLACEMENT, DISPLACEMENT)
    found = []
    for wavelength, weight in [(mode.lambda_1, 1.0)] + ([(mode.lambda_2, SECOND_WEIGHT)] if mode.lambda_2 else []):
        hkl, d, mult = reflections(cell, rotations, wavelength, grid[-1] + MARGIN, grid[0] - MARGIN)
        if not len(hkl):
            continue
        strength = intensities(hkl, d, mult, sites, elements, wavelength, rng, factors)
        keep = np.flatnonzero(strength >= LEAST_INTENSITY * strength.max())
        keep = keep[np.argsort(-strength[keep], kind="stable")[:MOST_PEAKS]]
        tt = np.degrees(2 * np.arcsin(wavelength / (2 * d[keep])))
        tan, cos = np.tan(np.radians(tt / 2)), np.cos(np.radians(tt / 2))
        squares = np.maximum(u * tan**2 + v * tan + w, 1e-6) + np.degrees(SCHERRER * wavelength / (10 * size * cos)) ** 2 + np.degrees(4 * strain * tan) ** 2
        way = hkl[keep] @ reciprocal(cell)
        along = ((way / np.linalg.norm(way, axis=1, keepdims=True)) @ axis) ** 2
        preferred = (texture**2 * along + (1 - along) / texture) ** -1.5
        found.append((tt, strength[keep] * weight * rng.lognormal(0, JITTER_SD, len(keep)) * preferred, np.clip(np.sqrt(squares), *WIDTH_LIMITS)))
    centres, amps, widths = (np.concatenate(x)[:MOST_PEAKS] for x in zip(*found, strict=True)) if found else [np.empty(0)] * 3
    return centres, amps, widths, {"size": size, "strain": strain, "eta": eta, "texture": texture, "zero_shift": zero, "displacement": shift}


def generate(cell: np.ndarray, sites: np.ndarray, elements: list[str], rotations: np.ndarray, mode: Mode, seed: int, factors: Mapping[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """A whole simulated pattern: the grid, counts on it, and what was drawn."""
    rng = np.random.default_rng(seed)
    own, grid = FAMILIES[mode.family], mode.grid()
    centres, amps, widths, drawn = peaks(cell, sites, elements, rotations, mode, rng, factors)
    y = integrate(centres + drawn["zero_shift"] - drawn["displacement"] * np.cos(np.radians(centres / 2)), amps, widths, drawn["eta"], grid)
    scale = max(y.max(), 1e-6)
    background = [rng.uniform(*own.background), rng.uniform(*SLOPE_RANGE), *(rng.uniform(*CURVE_RANGE) for _ in range(4))]
    y = y + np.maximum(np.polynomial.chebyshev.chebval(np.linspace(-1, 1, len(grid)), background) * scale, 0)
    if rng.random() < own.halo_share:
        centre, width, height = rng.uniform(*HALO_CENTRE), rng.uniform(*HALO_WIDTH), rng.uniform(*own.halo_height) * scale
        y = y + height * np.exp(-0.5 * ((grid - centre) / width) ** 2)
    if y.max() <= 0:
        y = np.full(len(grid), 1e-6)
    counts = 10 ** rng.uniform(*own.counts)
    return grid, noisy(y, rng, counts), drawn | {"n_peaks": len(centres), "counts": counts}


def simulate(structures: DataFrame, key: str, factors: Mapping[str, np.ndarray] | None = None, source: str = "demo") -> DataFrame:
    """key, seed, x, y, n_peaks and status for rows with cell, sites (flat), elements, rotations (flat), lambda_1, lambda_2, x_min, x_max, step and family. A row that fails has its reason as status; the others go on."""
    kinds = (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float32()), pa.int32(), pa.string())
    plain = ["elements", "lambda_1", "lambda_2", "x_min", "x_max", "step", "family"]

    def one(r: dict, cell: np.ndarray, sites: np.ndarray, rotations: np.ndarray) -> tuple:
        seed = seed_of(source, r[key])
        try:
            mode = Mode(*(r[c] for c in plain[1:]))
            x, y, drawn = generate(cell, sites.reshape(-1, 3), r["elements"], rotations.reshape(-1, 3, 3), mode, seed, factors)
            return seed, x, y.astype(np.float32), drawn["n_peaks"], "ok"
        except (ValueError, TypeError, KeyError, IndexError, FloatingPointError, np.linalg.LinAlgError) as e:
            return seed, None, None, None, f"error:{type(e).__name__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                arrays = (arrays_of(part.column(c)) for c in ("cell", "sites", "rotations"))
                out = [one(r, *own) for r, *own in zip(part.select([key, *plain]).to_pylist(), *arrays, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=[key, "seed", "x", "y", "n_peaks", "status"])

    kind = dict(structures.dtypes)[key]
    return structures.select(key, "cell", "sites", "rotations", *plain).mapInArrow(run, f"{key} {kind}, seed long, x array<double>, y array<float>, n_peaks int, status string")
