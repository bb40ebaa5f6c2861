"""Column expressions on arrays of bounded length: sums, moments, exact percentiles, steps, moving means.

An array is that of a series on a grid, so its length has a bound and a row holds it. Nothing is exchanged for any of
these. Arrays hold doubles without nulls; what isn't defined is null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import mul

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with the value worked out once, however often and deep inside ``make`` it is used."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def total(v: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    """Sum over an array, of a function of its values."""
    return F.aggregate(v, F.lit(0.0), lambda t, x: t + of(x))


def mean(v: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    """Null of an empty array."""
    return let(v, lambda a: F.try_divide(total(a, of), F.size(a)))


def share(v: Column, cond: Callable[[Column], Column]) -> Column:
    """Share of the values that meet a condition; null of an empty array."""
    return mean(v, lambda x: F.when(cond(x), 1.0).otherwise(0.0))


def moment(v: Column, k: int) -> Column:
    """Central moment."""
    return let(v, lambda a: let(mean(a), lambda m: mean(a, lambda x: reduce(mul, [x - m] * k))))


def deviation(v: Column) -> Column:
    """Standard deviation; exactly 0 where nothing varies."""
    return let(v, lambda a: F.when(F.array_min(a) == F.array_max(a), F.lit(0.0)).otherwise(F.sqrt(moment(a, 2))))


def correlation(a: Column, b: Column, flat: Column) -> Column:
    """Correlation of two arrays of one length; ``flat`` where one of them doesn't vary."""

    def of(p: Column) -> Column:
        known = F.struct(mean(p["a"]).alias("ma"), mean(p["b"]).alias("mb"), deviation(p["a"]).alias("sa"), deviation(p["b"]).alias("sb"))
        both = lambda k: mean(F.zip_with(p["a"], p["b"], lambda x, y: (x - k["ma"]) * (y - k["mb"])))
        return let(known, lambda k: F.when((k["sa"] >= 1e-12) & (k["sb"] >= 1e-12), both(k) / (k["sa"] * k["sb"])).otherwise(flat))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def at(ordered: Column, p: float) -> Column:
    """The percentile of an array in order, interpolated; null of an empty one."""
    place = (F.size(ordered) - 1) * F.lit(p)
    k = F.greatest(F.floor(place), F.lit(0)).cast("int")
    low = F.get(ordered, k)
    return low + (F.coalesce(F.get(ordered, k + 1), low) - low) * (place - k)


def q(v: Column, p: float) -> Column:
    """An exact percentile."""
    return let(F.sort_array(v), lambda o: at(o, p))


def median(v: Column, least: int = 1) -> Column:
    """Median, if there are ``least`` values."""
    return F.when(F.size(v) >= least, q(v, 0.5))


def cut(v: Column, first: int | Column, length: int | Column) -> Column:
    """``length`` values from place ``first``, counted from 0; none where that is less than 1."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.slice(v, F.lit(first) + 1 if isinstance(first, int) else first + 1, F.greatest(length, F.lit(0)))


def steps(v: Column, by: int = 1) -> Column:
    """Differences of values ``by`` places apart."""
    return F.zip_with(cut(v, by, F.size(v) - by), cut(v, 0, F.size(v) - by), lambda b, a: b - a)


def gini(ordered: Column, empty: Column) -> Column:
    """From an array in order; ``empty`` where nothing is above zero."""
    ranks = F.aggregate(F.zip_with(ordered, F.sequence(F.lit(1), F.size(ordered)), lambda x, r: x * r), F.lit(0.0), lambda t, x: t + x)
    n = F.size(ordered)

    def of(t: Column) -> Column:
        # The sum of running sums counts the value of rank r for n + 1 - r of them.
        return F.when(t > 0, (n + 1 - 2 * (((n + 1) * t - ranks) / t)) / n).otherwise(empty)

    return let(total(ordered), of)


def moments(v: np.ndarray) -> tuple[float, float, float]:
    """``deviation`` and the third and fourth central ``moment`` of an array in one go. For use inside tasks."""
    x = v - v.mean()
    xx = x * x
    return float(np.sqrt(xx.mean())) if v.min() < v.max() else 0.0, float((xx * x).mean()), float((xx * xx).mean())


def lagged(v: np.ndarray, k: int) -> float | None:
    """``correlation`` of an array with itself ``k`` places on, if both parts vary. For use inside tasks."""
    a, b = v[:-k], v[k:]
    if not len(a) or a.min() == a.max() or b.min() == b.max():
        return None
    a, b = a - a.mean(), b - b.mean()
    sa, sb = np.sqrt((a * a).mean()), np.sqrt((b * b).mean())
    return float((a * b).mean() / (sa * sb)) if min(sa, sb) >= 1e-12 else None


def moving(v: np.ndarray, h: int, mirrored: bool) -> np.ndarray:
    """Means over ``h`` places on either side; beyond its ends an array is mirrored, or zero. For use inside tasks."""
    sums = np.concatenate([[0.0], np.cumsum(np.pad(v, h, mode="symmetric" if mirrored else "constant"))])
    return (sums[2 * h + 1 :] - sums[: -2 * h - 1]) / (2 * h + 1)
