"""Diffraction physics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell_volume(a: Column, b: Column, c: Column, al: Column, be: Column, ga: Column) -> Column:
    """Volume of a cell with angles in degrees; the root's argument is kept positive."""
    x, y, z = (F.cos(F.radians(g)) for g in (al, be, ga))
    return a * b * c * F.sqrt(F.greatest(1 - x * x - y * y - z * z + 2 * x * y * z, F.lit(1e-12)))


def reciprocal(a: Column, b: Column, c: Column, al: Column, be: Column, ga: Column) -> dict[str, Column]:
    """The reciprocal cell, without a factor of two pi: lengths ``ra``, ``rb``, ``rc`` and the cosines of its angles, for cells of any angles in degrees."""
    x, y, z = (F.cos(F.radians(g)) for g in (al, be, ga))
    sx, sy, sz = (F.sin(F.radians(g)) for g in (al, be, ga))
    v = cell_volume(a, b, c, al, be, ga)
    return {"ra": b * c * sx / v, "rb": a * c * sy / v, "rc": a * b * sz / v, "cos_ra": (y * z - x) / (sy * sz), "cos_rb": (x * z - y) / (sx * sz), "cos_rc": (x * y - z) / (sx * sy)}


def bragg(wavelength: Column, d: Column) -> Column:
    """Two theta in degrees; null where the reflection can't be reached."""
    s = wavelength / (2 * d)
    return F.when(s <= 1, F.degrees(2 * F.asin(F.when(s <= 1, s))))


def lorentz_polarisation(two_theta: Column) -> Column:
    t = F.radians(two_theta / 2)
    return (1 + F.pow(F.cos(2 * t), 2)) / (F.pow(F.sin(t), 2) * F.cos(t))


def fwhm(two_theta: Column, u: float, v: float, w: float, size_nm: Column, strain: Column, wavelength: Column) -> Column:
    """Instrument (Caglioti), size (Scherrer, K = 0.9) and strain widths in squares, within [0.03, 2] degrees."""
    t = F.radians(two_theta / 2)
    tan = F.tan(t)
    instrument = F.greatest(u * tan * tan + v * tan + w, F.lit(1e-6))
    size = F.degrees(0.9 * wavelength / (10 * size_nm * F.cos(t)))
    widening = F.degrees(4 * strain * tan)
    return F.least(F.greatest(F.sqrt(instrument + size * size + widening * widening), F.lit(0.03)), F.lit(2.0))


def pseudo_voigt(x: Column, centre: Column, width: Column, eta: Column) -> Column:
    """Mixture of a Lorentzian (share eta) and a Gaussian, both of height 1 and of one width at half maximum."""
    u = (x - centre) / (width / 2)
    return eta / (1 + u * u) + (1 - eta) * F.exp(-F.ln(F.lit(2.0)) * u * u)


def march_dollase(alpha: Column, r: Column) -> Column:
    """Texture factor for the angle alpha (radians) to the preferred direction."""
    return F.pow(r * r * F.pow(F.cos(alpha), 2) + F.pow(F.sin(alpha), 2) / r, -1.5)


def shifted(two_theta: Column, zero: Column, displacement: Column) -> Column:
    """Position after zero shift and sample displacement."""
    return two_theta + zero - displacement * F.cos(F.radians(two_theta / 2))


def chebyshev(x: Column, coefficients: list[Column]) -> Column:
    """Clenshaw's sum of Chebyshev polynomials for x in [-1, 1], not under 0."""
    b1, b2 = F.lit(0.0), F.lit(0.0)
    for c in reversed(coefficients[1:]):
        b1, b2 = c + 2 * x * b1 - b2, b1
    return F.greatest(coefficients[0] + x * b1 - b2, F.lit(0.0))


def gaussian_halo(x: Column, centre: Column, width: Column, height: Column) -> Column:
    return height * F.exp(-0.5 * F.pow((x - centre) / width, 2))


def symop_rotation(op: Column) -> Column:
    """Nine integers of an operator like ``x,-y,z+1/2``: rows are its components, columns x, y, z."""
    parts = F.transform(F.split(F.lower(F.regexp_replace(op, r"\s", "")), ","), lambda p: p)
    sign = lambda p, a: F.when(p.rlike(rf"-{a}"), -1).when(p.rlike(a), 1).otherwise(0)
    return F.flatten(F.transform(parts, lambda p: F.array(*(sign(p, a) for a in "xyz"))))


def symop_translation(op: Column) -> Column:
    """Three shifts of an operator like ``x,-y+1/4,z+0.5``: fractions or decimals, 0 where there is none."""
    parts = F.split(F.regexp_replace(op, r"\s", ""), ",")
    fraction = r"([+-]?\d+)/(\d+)"
    whole = lambda p: F.try_divide(F.regexp_extract(p, fraction, 1).try_cast("double"), F.regexp_extract(p, fraction, 2).try_cast("double"))
    return F.transform(parts, lambda p: F.coalesce(whole(p), F.regexp_extract(p, r"([+-]?\d*\.\d+)", 1).try_cast("double"), F.lit(0.0)))


def inverse_d_squared(h: Column, k: Column, l: Column, r: dict[str, Column]) -> Column:  # noqa: E741
    """1 / d^2 of a reflection from the reciprocal cell that ``reciprocal`` gives."""
    a, b, c = r["ra"], r["rb"], r["rc"]
    mixed = k * l * b * c * r["cos_ra"] + h * l * a * c * r["cos_rb"] + h * k * a * b * r["cos_rc"]
    return h * h * a * a + k * k * b * b + l * l * c * c + 2 * mixed


def interpolate(nodes: Column, position: Column) -> Column:
    """Linear interpolation in an array of nodes at positions 0, 1, 2, ...; beyond either end the last value holds."""
    at = F.least(F.greatest(position, F.lit(0.0)), (F.size(nodes) - 1).cast("double"))
    k = F.least(F.floor(at), (F.size(nodes) - 2).cast("long")).cast("int")
    w = at - k
    return F.when(F.size(nodes) == 1, F.get(nodes, F.lit(0))).otherwise(F.get(nodes, k) * (1 - w) + F.get(nodes, k + 1) * w)
