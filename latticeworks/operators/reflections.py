"""Reflections of crystal structures: index triples within reach, grouped into orbits under symmetry.

A structure is a row (id, a, b, c, al, be, ga, ops): a cell with angles in degrees and the rotations of its operators, nine
integers each, which form a group as those of a structure file do. An orbit holds a triple's images under all rotations and their negatives. The largest triple of an orbit
stands for it, and every triple knows its own orbit, so that a row keeps itself or goes: nothing is visited twice,
remembered or shuffled. The triples of one structure are made one first index at a time, dealt over the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeworks.functions.crystal import bragg, inverse_d_squared, reciprocal

_CELL = ("a", "b", "c", "al", "be", "ga")


def orbit(ops: Column, h: Column, k: Column, l: Column) -> Column:  # noqa: E741
    """The different images of a triple under the rotations, and their negatives."""
    images = F.transform(ops, lambda r: F.array(*((F.get(r, F.lit(3 * i)) * h + F.get(r, F.lit(3 * i + 1)) * k + F.get(r, F.lit(3 * i + 2)) * l).cast("int") for i in range(3))))
    return F.array_distinct(F.concat(images, F.transform(images, lambda v: F.transform(v, lambda x: -x))))


def reflections(structures: DataFrame, wavelength: float, low: float, high: float) -> DataFrame:
    """(id, h, k, l, multiplicity, d, two_theta): one triple, the largest, of each orbit between two angles. Without operators only a triple and its negative are one.

    An index is at most the length of its axis over the least spacing, whatever the angles are.
    """
    least, most = (wavelength / (2 * F.sin(F.radians(F.lit(x / 2)))) for x in (min(high, 179.9), max(low, 0.05)))
    reach = lambda c: F.floor(F.col(c) / least).cast("int")
    every = lambda n: F.sequence(-n, n)
    ops = F.coalesce("ops", F.array().cast("array<array<int>>"))
    identity = F.array(*(F.lit(int(i % 4 == 0)) for i in range(9)))
    own = structures.select("id", *_CELL, F.when(F.size(ops) > 0, ops).otherwise(F.array(identity)).alias("ops"))
    first = own.withColumn("h", F.explode(every(reach("a")))).repartition("id", "h")
    triples = first.withColumn("k", F.explode(every(reach("b")))).withColumn("l", F.explode(every(reach("c")))).where("h <> 0 or k <> 0 or l <> 0")
    spaced = triples.withColumn("d", F.try_divide(F.lit(1.0), F.sqrt(inverse_d_squared(F.col("h"), F.col("k"), F.col("l"), reciprocal(*(F.col(c) for c in _CELL))))))
    near = spaced.where((F.col("d") >= least) & (F.col("d") <= most)).withColumn("orbit", orbit(F.col("ops"), F.col("h"), F.col("k"), F.col("l")))
    one = near.where(F.array_max("orbit") == F.array("h", "k", "l"))
    return one.select("id", "h", "k", "l", F.size("orbit").cast("long").alias("multiplicity"), "d", bragg(F.lit(wavelength), F.col("d")).alias("two_theta"))
