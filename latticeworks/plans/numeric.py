"""Diffraction queries: cells, reflections, structure factors, profiles. Cells and wavelengths come from ``part``."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from latticeworks.functions import crystal as X
from latticeworks.functions import profile as R
from latticeworks.operators import domains
from latticeworks.operators.metrics import roc_auc
from latticeworks.operators.ranks import running_sums
from latticeworks.operators.reflections import reflections
from latticeworks.registry import query

#: Shuffles of each feature that permutation importance averages over.
REPEATS = 5

_CELL_SQL = "SELECT p_partkey, 3 + p_size / 10.0::DOUBLE AS a, 4 + p_size % 7 / 2.0::DOUBLE AS b, 5.0::DOUBLE AS c, 90.0::DOUBLE AS al, 90.0 + p_size % 10::DOUBLE AS be, CASE WHEN p_size % 3 = 0 THEN 120.0 ELSE 90.0 END::DOUBLE AS ga FROM part"


def _cells(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", (3 + s / 10.0).alias("a"), (4 + (s % 7) / 2.0).alias("b"), F.lit(5.0).alias("c"), F.lit(90.0).alias("al"), (90.0 + (s % 10)).alias("be"), F.when(s % 3 == 0, 120.0).otherwise(90.0).alias("ga"))


_VOLUME = "a * b * c * sqrt(greatest(1 - cos(radians(al))*cos(radians(al)) - cos(radians(be))*cos(radians(be)) - cos(radians(ga))*cos(radians(ga)) + 2*cos(radians(al))*cos(radians(be))*cos(radians(ga)), 1e-12))"


@query(f"SELECT p_partkey, round({_VOLUME}, 5) AS volume, round(ln({_VOLUME}), 6) AS log_volume FROM ({_CELL_SQL})")
def cell_volume(t):
    v = X.cell_volume(*(F.col(c) for c in ("a", "b", "c", "al", "be", "ga")))
    return _cells(t).select("p_partkey", F.round(v, 5).alias("volume"), F.round(F.ln(v), 6).alias("log_volume"))


_RECIPROCAL_SQL = f"""SELECT p_partkey, round(b * c * sin(radians(al)) / v, 6) AS ra, round(a * c * sin(radians(be)) / v, 6) AS rb, round(a * b * sin(radians(ga)) / v, 6) AS rc,
  round((cos(radians(be)) * cos(radians(ga)) - cos(radians(al))) / (sin(radians(be)) * sin(radians(ga))), 6) AS cos_ra, round((cos(radians(al)) * cos(radians(ga)) - cos(radians(be))) / (sin(radians(al)) * sin(radians(ga))), 6) AS cos_rb,
  round((cos(radians(al)) * cos(radians(be)) - cos(radians(ga))) / (sin(radians(al)) * sin(radians(be))), 6) AS cos_rc FROM (SELECT *, {_VOLUME} AS v FROM ({_CELL_SQL}))"""


@query(_RECIPROCAL_SQL)
def reciprocal_vectors(t):
    own = X.reciprocal(*(F.col(c) for c in ("a", "b", "c", "al", "be", "ga")))
    return _cells(t).select("p_partkey", *(F.round(v, 6).alias(n) for n, v in own.items()))


_HKL_SQL = """h AS (SELECT h, k, l, h*h + k*k + l*l AS n FROM (SELECT unnest(range(-3, 4)) AS h), (SELECT unnest(range(-3, 4)) AS k), (SELECT unnest(range(-3, 4)) AS l) WHERE h <> 0 OR k <> 0 OR l <> 0)"""


def _hkl(spark, top: int = 3):
    """All index triples up to ``top``: a fixed table of 342 rows."""
    axis = F.sequence(F.lit(-top).cast("long"), F.lit(top).cast("long"))
    out = spark.range(1).select(F.explode(axis).alias("h")).select("h", F.explode(axis).alias("k")).select("h", "k", F.explode(axis).alias("l"))
    return out.where("h <> 0 or k <> 0 or l <> 0").withColumn("n", F.expr("h*h + k*k + l*l"))


_ORBIT_SQL = f"""{_HKL_SQL}, o AS (SELECT list_sort([abs(h), abs(k), abs(l)]) AS key, n FROM h), u AS (SELECT key[3] AS h, key[2] AS k, key[1] AS l, n, count(*) AS multiplicity FROM o GROUP BY ALL)"""


def _orbits(spark):
    """Cubic orbits: triples equal up to order and signs, with their number."""
    key = F.array_sort(F.array(F.abs("h"), F.abs("k"), F.abs("l")))
    return _hkl(spark).select(key.alias("key"), "n").groupBy(F.col("key")[2].alias("h"), F.col("key")[1].alias("k"), F.col("key")[0].alias("l"), "n").agg(F.count(F.lit(1)).alias("multiplicity"))


#: Rotations of three classes of structures: none but the identity, a fourfold axis, a threefold axis along the diagonal.
_OPS = (
    ((1, 0, 0, 0, 1, 0, 0, 0, 1),),
    ((1, 0, 0, 0, 1, 0, 0, 0, 1), (0, -1, 0, 1, 0, 0, 0, 0, 1), (-1, 0, 0, 0, -1, 0, 0, 0, 1), (0, 1, 0, -1, 0, 0, 0, 0, 1)),
    ((1, 0, 0, 0, 1, 0, 0, 0, 1), (0, 0, 1, 1, 0, 0, 0, 1, 0), (0, 1, 0, 0, 0, 1, 1, 0, 0)),
)

_STRUCTURE_SQL = f"""
c AS (
  SELECT p_partkey AS id, p_size % 3 AS class, 3 + p_size / 25.0::DOUBLE AS a, 3 + (p_size + CASE WHEN p_size % 3 = 0 THEN p_size % 7 ELSE 0 END) / 25.0::DOUBLE AS b,
    3 + (p_size + CASE WHEN p_size % 3 < 2 THEN p_size % 5 ELSE 0 END) / 25.0::DOUBLE AS c, CASE WHEN p_size % 3 = 0 THEN 85.0 + p_size % 4 ELSE 90 END::DOUBLE AS be FROM part),
o AS (SELECT c.*, CASE class {" ".join(f"WHEN {k} THEN {[list(r) for r in ops]}" for k, ops in enumerate(_OPS))} END AS ops, a * b * c * sin(radians(be)) AS v, 1.5406 / (2 * sin(radians(30))) AS least FROM c),
t AS (SELECT * FROM (SELECT *, unnest(range(-CAST(floor(a / least) AS INTEGER), CAST(floor(a / least) AS INTEGER) + 1)) AS h FROM o)),
t2 AS (SELECT *, unnest(range(-CAST(floor(b / least) AS INTEGER), CAST(floor(b / least) AS INTEGER) + 1)) AS k FROM t),
t3 AS (SELECT *, unnest(range(-CAST(floor(c / least) AS INTEGER), CAST(floor(c / least) AS INTEGER) + 1)) AS l FROM t2),
s AS (
  SELECT *, 1 / sqrt(pow(h / (a * sin(radians(be))), 2) + pow(k / b, 2) + pow(l / (c * sin(radians(be))), 2) - 2 * h * l * cos(radians(be)) / (a * c * pow(sin(radians(be)), 2))) AS d
  FROM t3 WHERE h <> 0 OR k <> 0 OR l <> 0),
i AS (
  SELECT *, list_transform(ops, lambda r: [r[1] * h + r[2] * k + r[3] * l, r[4] * h + r[5] * k + r[6] * l, r[7] * h + r[8] * k + r[9] * l]) AS images
  FROM s WHERE d >= least AND d <= 1.5406 / (2 * sin(radians(5)))),
r AS (SELECT *, list_distinct(list_concat(images, list_transform(images, lambda x: [-x[1], -x[2], -x[3]]))) AS orbit FROM i)"""


def structures(t):
    """(id, cell, ops): a structure for each part, of one of three classes by its size."""
    size, kind = F.col("p_size"), F.col("p_size") % 3
    edge = lambda extra: 3 + (size + extra) / 25.0
    listed = [F.array(*(F.array(*(F.lit(x) for x in r)) for r in ops)) for ops in _OPS]
    ops = F.when(kind == 0, listed[0]).when(kind == 1, listed[1]).otherwise(listed[2])
    b, c = edge(F.when(kind == 0, size % 7).otherwise(0)), edge(F.when(kind < 2, size % 5).otherwise(0))
    right = F.lit(90.0)
    return t.part.select(F.col("p_partkey").alias("id"), edge(0).alias("a"), b.alias("b"), c.alias("c"), right.alias("al"), F.when(kind == 0, 85.0 + size % 4).otherwise(90.0).alias("be"), right.alias("ga"), ops.alias("ops"))


@query(f"WITH {_STRUCTURE_SQL} SELECT id AS p_partkey, h, k, l, len(orbit) AS multiplicity, round(d, 6) AS d, round(degrees(2 * asin(1.5406 / (2 * d))), 5) AS two_theta FROM r WHERE [h, k, l] = list_max(orbit)")
def hkl_enumeration(t):
    """The reflections of every part's structure between 10 and 60 degrees, one triple an orbit."""
    found = reflections(structures(t), 1.5406, 10.0, 60.0)
    return found.select(F.col("id").alias("p_partkey"), *(F.col(c).cast("long").alias(c) for c in "hkl"), "multiplicity", F.round("d", 6).alias("d"), F.round("two_theta", 5).alias("two_theta"))


_BRAGG_SQL = f"{_ORBIT_SQL}, d AS (SELECT DISTINCT 3 + p_size / 10.0::DOUBLE AS a FROM part), b AS (SELECT a, h, k, l, n, multiplicity, a / sqrt(n) AS d, 1.5406 / (2 * a / sqrt(n)) AS s FROM d, u)"


def _bragg(t):
    """Reflections of each different cell edge; the orbit table is fixed and small."""
    edges = t.part.select((3 + F.col("p_size") / 10.0).alias("a")).distinct()
    both = edges.join(F.broadcast(_orbits(t.spark)))
    d = F.col("a") / F.sqrt("n")
    return both.withColumn("d", d).withColumn("two_theta", X.bragg(F.lit(1.5406), d)).where("two_theta is not null")


@query(f"WITH {_BRAGG_SQL} SELECT a, h, k, l, round(d, 6) AS d, round(degrees(2 * asin(s)), 6) AS two_theta FROM b WHERE s <= 1")
def bragg_positions(t):
    return _bragg(t).select("a", "h", "k", "l", F.round("d", 6).alias("d"), F.round("two_theta", 6).alias("two_theta"))


# Rock salt: four metal and four halide sites; the structure factor is a sum of cosines and sines over sites.
_SITES = [(e, x, y, z) for e, sx in ((11.0, 0.0), (17.0, 0.5)) for x, y, z in ((sx, 0.0, 0.0), (sx, 0.5, 0.5), (sx + 0.5 if sx == 0 else 0.0, 0.0, 0.5), (sx + 0.5 if sx == 0 else 0.0, 0.5, 0.0))]
_SITES_SQL = "t(f, x, y, z) AS (VALUES " + ", ".join(f"({f}::DOUBLE, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for f, x, y, z in _SITES) + ")"


@query(f"""WITH {_BRAGG_SQL}, {_SITES_SQL}, f AS (SELECT a, h, k, l, any_value(s) AS s, any_value(d) AS d, any_value(multiplicity) AS m, sum(f * exp(-1.5 / (4 * d * d)) * cos(2 * pi() * (h * x + k * y + l * z))) AS re, sum(f * exp(-1.5 / (4 * d * d)) * sin(2 * pi() * (h * x + k * y + l * z))) AS im FROM b, t WHERE s <= 1 GROUP BY a, h, k, l)
SELECT a, h, k, l, round(re * re + im * im, 4) AS f2, round(m * (re * re + im * im) * (1 + pow(cos(2 * asin(s)), 2)) / (s * s * cos(asin(s))), 2) AS intensity FROM f""")
def structure_factor(t):
    """Sites are a fixed array, so the sum is an array fold in each row; no row is made for a site."""
    sites = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip("fxyz", s, strict=True))) for s in _SITES))
    damp = F.exp(-1.5 / (4 * F.col("d") * F.col("d")))
    phase = lambda s: 2 * F.pi() * (F.col("h") * s["x"] + F.col("k") * s["y"] + F.col("l") * s["z"])
    part = lambda g: F.aggregate(F.transform(sites, lambda s: s["f"] * damp * g(phase(s))), F.lit(0.0), lambda a, v: a + v)
    f = _bragg(t).withColumns({"re": part(F.cos), "im": part(F.sin)}).withColumn("f2", F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return f.select("a", "h", "k", "l", F.round("f2", 4).alias("f2"), F.round(F.col("multiplicity") * F.col("f2") * X.lorentz_polarisation(F.col("two_theta")), 2).alias("intensity"))


@query("""SELECT p_partkey, round(18 * (1 - w) * exp(-3.0 * (k / 150.0)) + 18 * w * exp(-3.0 * ((k + 1) / 150.0)), 6) AS f FROM (SELECT p_partkey, floor(p_size / 100.0 * 150) AS k, p_size / 100.0::DOUBLE * 150 - floor(p_size / 100.0::DOUBLE * 150) AS w FROM part)""")
def form_factor_interp(t):
    """Linear interpolation in a table on 601 nodes by index arithmetic."""
    at = F.col("p_size") / 100.0 * 150
    k = F.floor(at)
    w = at - k
    node = lambda i: F.exp(F.lit(-3.0) * (i / 150.0))
    return t.part.select("p_partkey", F.round(18 * (1 - w) * node(k) + 18 * w * node(k + 1), 6).alias("f"))


@query("""WITH n AS (SELECT DISTINCT p_brand, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS z FROM part), q AS (SELECT p_partkey, p_brand, p_retailprice % 700 AS pos FROM part)
SELECT p_partkey, round(CASE WHEN pos >= 600 THEN z * exp(-3.0) ELSE z * exp(-3.0 * (floor(pos) / 600)) * (1 - (pos - floor(pos))) + z * exp(-3.0 * ((floor(pos) + 1) / 600)) * (pos - floor(pos)) END, 6) AS f FROM q JOIN n USING (p_brand)""")
def form_factor_table(t):
    """Interpolation in a table that the caller gives: 601 nodes for each element (here a curve for each brand), joined by element."""
    z = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    nodes = F.transform(F.sequence(F.lit(0), F.lit(600)), lambda i: z * F.exp(-3.0 * (i / 600.0)))
    table = t.part.select("p_brand").distinct().select("p_brand", nodes.alias("nodes"))
    own = t.part.select("p_partkey", "p_brand", (F.col("p_retailprice") % 700).alias("at")).join(table, "p_brand")
    return own.select("p_partkey", F.round(X.interpolate(F.col("nodes"), F.col("at")), 6).alias("f"))


_TT = "(20.0::DOUBLE + p_size)"


@query(f"""SELECT p_partkey, round(least(greatest(sqrt(greatest(2e-3 * pow(tan(radians({_TT} / 2)), 2) - 1e-3 * tan(radians({_TT} / 2)) + 3e-3, 1e-6) + pow(degrees(0.9 * 1.5406 / (10 * (20.0::DOUBLE + p_size % 9) * cos(radians({_TT} / 2)))), 2) + pow(degrees(4 * 1e-3 * tan(radians({_TT} / 2))), 2)), 0.03), 2.0), 6) AS fwhm FROM part""")
def fwhm_model(t):
    w = X.fwhm(20.0 + F.col("p_size"), 2e-3, -1e-3, 3e-3, 20.0 + F.col("p_size") % 9, F.lit(1e-3), F.lit(1.5406))
    return t.part.select("p_partkey", F.round(w, 6).alias("fwhm"))


@query("SELECT p_partkey, round(0.4 / (1 + pow((p_size / 50.0::DOUBLE - 0.5) / 0.25, 2)) + 0.6 * exp(-ln(2) * pow((p_size / 50.0::DOUBLE - 0.5) / 0.25, 2)), 6) AS y FROM part")
def pseudo_voigt(t):
    return t.part.select("p_partkey", F.round(X.pseudo_voigt(F.col("p_size") / 50.0, F.lit(0.5), F.lit(0.5), F.lit(0.4)), 6).alias("y"))


@query("SELECT p_partkey, round(pow(0.64 * pow(cos(p_size / 32.0::DOUBLE), 2) + pow(sin(p_size / 32.0::DOUBLE), 2) / 0.8, -1.5), 6) AS texture FROM part")
def march_dollase(t):
    return t.part.select("p_partkey", F.round(X.march_dollase(F.col("p_size") / 32.0, F.lit(0.8)), 6).alias("texture"))


@query(f"SELECT p_partkey, round({_TT} + 0.02 - 0.05 * cos(radians({_TT} / 2)), 6) AS position FROM part")
def peak_shift(t):
    return t.part.select("p_partkey", F.round(X.shifted(20.0 + F.col("p_size"), F.lit(0.02), F.lit(0.05)), 6).alias("position"))


@query("WITH x AS (SELECT p_partkey, p_size / 25.0::DOUBLE - 1 AS x FROM part) SELECT p_partkey, round(greatest(0.1 + 0.05 * x - 0.08 * (2*x*x - 1) + 0.02 * (4*x*x*x - 3*x), 0), 6) AS background FROM x")
def chebyshev_background(t):
    return t.part.select("p_partkey", F.round(X.chebyshev(F.col("p_size") / 25.0 - 1, [F.lit(c) for c in (0.1, 0.05, -0.08, 0.02)]), 6).alias("background"))


@query("SELECT p_partkey, round(0.3 * exp(-0.5 * pow((p_size - 24.0::DOUBLE) / 6, 2)), 6) AS halo FROM part")
def halo(t):
    return t.part.select("p_partkey", F.round(X.gaussian_halo(F.col("p_size").cast("double"), F.lit(24.0), F.lit(6.0), F.lit(0.3)), 6).alias("halo"))


_OP_SQL = """
p AS (SELECT p_partkey, ['x', 'y', 'z'] AS axes, p_partkey % 3 AS turn, p_size FROM part),
o AS (
  SELECT p_partkey, array_to_string(list_transform([1, 2, 3], lambda i: CASE WHEN (p_size + i) % 3 = 0 THEN '-' ELSE '' END || axes[(turn + i) % 3 + 1]
    || CASE WHEN (p_size + i) % 4 = 0 THEN ' + 1/2' WHEN (p_size + i) % 4 = 1 THEN '-1/' || (p_partkey % 5 + 2) WHEN (p_size + i) % 7 = 0 THEN '+0.25' ELSE '' END), ', ') AS op FROM p)"""


def _operators(t):
    """An operator for each part, written with signs, fractions, decimals and blanks."""
    axis = lambda i: F.get(F.array(F.lit("x"), F.lit("y"), F.lit("z")), ((F.col("p_partkey") % 3 + i) % 3).cast("int"))
    at = lambda i: F.col("p_size") + i
    shift = lambda i: F.when(at(i) % 4 == 0, " + 1/2").when(at(i) % 4 == 1, F.concat(F.lit("-1/"), (F.col("p_partkey") % 5 + 2).cast("string"))).when(at(i) % 7 == 0, "+0.25").otherwise("")
    parts = [F.concat(F.when(at(i) % 3 == 0, "-").otherwise(""), axis(i), shift(i)) for i in (1, 2, 3)]
    return t.part.select("p_partkey", F.concat_ws(", ", *parts).alias("op"))


@query(f"""WITH {_OP_SQL}, c AS (SELECT p_partkey, op, unnest(string_split(replace(op, ' ', ''), ',')) AS c, unnest([1, 2, 3]) AS i FROM o),
v AS (
  SELECT p_partkey, op, i, array_to_string(list_transform(['x', 'y', 'z'], lambda a: CASE WHEN contains(c, '-' || a) THEN '-1' WHEN contains(c, a) THEN '1' ELSE '0' END), ',') AS row,
    CASE WHEN contains(c, '/') THEN CAST(regexp_extract(c, '([+-][0-9]+)/', 1) AS DOUBLE) / CAST(regexp_extract(c, '/([0-9]+)', 1) AS DOUBLE) WHEN contains(c, '.') THEN 0.25 ELSE 0 END AS shift FROM c)
SELECT p_partkey, op, string_agg(row, ',' ORDER BY i) AS rotation, round(sum(shift), 6) AS shift, round(max(shift), 6) AS most FROM v GROUP BY p_partkey, op""")
def symop_parse(t):
    """Rotations and shifts of the operators of all parts."""
    shifts = X.symop_translation(F.col("op"))
    rotation = F.array_join(F.transform(X.symop_rotation(F.col("op")), lambda v: v.cast("string")), ",")
    return _operators(t).select("p_partkey", "op", rotation.alias("rotation"), F.round(F.aggregate(shifts, F.lit(0.0), lambda a, v: a + v), 6).alias("shift"), F.round(F.array_max(shifts), 6).alias("most"))


def _structures(t):
    cubic = [[1, 0, 0, 0, 1, 0, 0, 0, 1], [-1, 0, 0, 0, -1, 0, 0, 0, 1], [0, 1, 0, 0, 0, 1, 1, 0, 0], [0, 0, 1, 1, 0, 0, 0, 1, 0]]
    numbers = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    a = 4 + F.col("p_size") / 25.0
    sites = numbers([0, 0, 0, 0.5, 0.5, 0.5])
    one = t.part.groupBy("p_size").agg(F.min("p_partkey").alias("p_partkey"))  # parts of one size are one structure
    mode = {"lambda_1": F.lit(1.540562), "lambda_2": F.when(F.col("p_size") % 2 == 0, F.lit(1.544398)), "x_min": F.lit(5.0), "x_max": F.lit(90.0), "step": F.lit(0.02), "family": F.when(F.col("p_size") % 3 == 0, "broad").otherwise("narrow")}
    cell = F.array(a, a, a, F.lit(90.0), F.lit(90.0), F.lit(90.0))
    return one.select("p_partkey", cell.alias("cell"), sites.alias("sites"), F.array(F.lit("Na"), F.lit("Cl")).alias("elements"), F.array(*(F.lit(float(v)) for op in cubic for v in op)).alias("rotations"), *(v.alias(n) for n, v in mode.items()))


@query()
def generator(t):
    """A simulated pattern for each different structure, seeded by its id; every second one has a second wavelength, every third a broad instrument."""
    return R.simulate(_structures(t), "p_partkey").select("p_partkey", "seed", "status", "n_peaks", F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 3).alias("counts"), F.size("y").alias("bins"))


def _bins(t):
    own = R.simulate(_structures(t), "p_partkey").withColumn("top", F.array_max("y"))
    return own.select("p_partkey", "top", F.explode(F.arrays_zip("x", "y")).alias("p")).select("p_partkey", "top", "p.x", "p.y")


@query()
def counting_noise(t):
    """Bins of the simulated patterns over half of the maximum."""
    return _bins(t).where("y > 0.5 * top").select("p_partkey", F.round("x", 2).alias("x"), "y")


@query()
def profile_integration(t):
    """Where the pattern's mass lies: the mean count over ten-degree bands."""
    return _bins(t).groupBy("p_partkey", F.floor(F.col("x") / 10).alias("band")).agg(F.avg("y").alias("mean"))


def _domains(t):
    """Two domains told apart by label parity, a feature for each vector component."""
    f = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", (F.col("label") % 2).cast("double").alias("label"), array_to_vector(f).alias("features"), f.alias("f"))


@query()
def domain_gbt(t):
    """A boosted-tree classifier of the two domains, trained on hashed three quarters; its AUC on the rest."""
    own = _domains(t)
    test = F.pmod(F.xxhash64("vec_id"), F.lit(4)) == 0
    model = GBTClassifier(maxIter=20, maxDepth=3, seed=0).fit(own.where(~test))
    auc = BinaryClassificationEvaluator().evaluate(model.transform(own.where(test)))
    return t.spark.createDataFrame([(float(auc), model.getNumTrees)], "auc double, trees int")


@query()
def permutation_importance(t):
    """Loss of AUC on the test part when one feature is shuffled among its rows, mean of REPEATS shuffles, for every vector component.

    The score is the mean difference direction of the two domains in the other rows. A shuffle gives the row of each
    rank by id the feature of the row of that rank by a seeded hash; both ranks are without gaps.
    """
    f = F.transform("embedding", lambda x: x.cast("double"))
    own = t.embeddings.select("vec_id", (F.col("label") % 2).cast("double").alias("label"), f.alias("f")).where("label is not null and f is not null and forall(f, x -> x is not null and not isnan(x))")
    test = F.pmod(F.xxhash64("vec_id"), F.lit(4)) == 0
    mean = own.where(~test).select("label", F.posexplode("f").alias("k", "v")).groupBy("k").agg((F.avg(F.when(F.col("label") == 1, F.col("v"))) - F.avg(F.when(F.col("label") == 0, F.col("v")))).alias("w"))
    weights = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]).alias("w"))  # one number a component
    rows = own.where(test).withColumn("h", F.xxhash64("f"))
    dot = F.aggregate(F.zip_with("f", "w", lambda x, w: x * w), F.lit(0.0), lambda a, v: a + v)
    scored = rows.join(F.broadcast(weights)).withColumn("s", dot)
    placed = running_sums(scored, "vec_id", {"rank": F.lit(1)}, ties=["h", "label"])
    drawn = rows.select("vec_id", "h", F.col("f").alias("g"), F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("repeat"))
    drawn = running_sums(drawn.withColumn("draw", F.xxhash64("vec_id", "h", "repeat")), "draw", {"rank": F.lit(1)}, ["repeat"], ["vec_id", "h"])
    both = placed.join(drawn.select("rank", "repeat", "g"), "rank")
    changes = F.zip_with(F.zip_with("f", "g", lambda x, y: y - x), "w", lambda d, w: d * w)
    changed = both.select("label", "s", "repeat", F.posexplode(changes).alias("k", "d")).select("label", (F.col("s") + F.col("d")).alias("s"), "k", "repeat")
    auc = roc_auc(changed, "s", F.col("label") == 1, "k", "repeat")
    whole = roc_auc(scored.select("label", "s"), "s", F.col("label") == 1).select(F.col("auc").alias("whole"))
    return auc.join(F.broadcast(whole)).groupBy("k").agg(F.round(F.avg(F.col("whole") - F.col("auc")), 6).alias("loss"))


@query("""WITH l AS (SELECT label % 2 AS side, vec_id % 3 AS pair, k, CAST(x AS DOUBLE) AS v FROM (SELECT label, vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS k FROM embeddings)), c AS (SELECT pair, k, v, count(*) FILTER (WHERE side = 1) AS n1, count(*) FILTER (WHERE side = 0) AS n0 FROM l GROUP BY ALL),
u AS (SELECT *, coalesce(sum(n0) OVER (PARTITION BY pair, k ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM c)
SELECT pair, k, round(sum(n1 * (under + n0 / 2.0::DOUBLE)) / (sum(n1) * sum(n0)), 6) AS auc, CAST(sum(n1) AS BIGINT) AS n_real, CAST(sum(n0) AS BIGINT) AS n_synth FROM u GROUP BY pair, k HAVING sum(n1) >= 10 AND sum(n0) >= 10""")
def domain_report(t):
    """AUC of every feature for each pair of domains with enough rows."""
    long = t.embeddings.select((F.col("label") % 2 == 1).alias("side"), (F.col("vec_id") % 3).alias("pair"), F.posexplode("embedding").alias("k", "v")).withColumns({"k": F.col("k").cast("long"), "v": F.col("v").cast("double")})
    return roc_auc(long, "v", F.col("side"), "pair", "k").where("n1 >= 10 and n0 >= 10").select("pair", "k", F.round("auc", 6).alias("auc"), F.col("n1").alias("n_real"), F.col("n0").alias("n_synth"))


@query()
def domain_model_report(t):
    """Pairs of domains told apart by boosted trees over all vector components: AUC over folds, rows on either side, the five features that carry it."""
    size = 64  # components of these vectors
    features = [f"f{k:02}" for k in range(size)]
    rows = t.embeddings.select((F.col("vec_id") % 2).alias("pair"), F.col("vec_id").alias("id"), (F.col("label") % 2 == 1).alias("side"), *(F.get("embedding", F.lit(k)).cast("double").alias(f) for k, f in enumerate(features)))
    found = domains.report(rows, features, folds=2, repeats=3, trees=8, depth=3, least=20)
    return found.select("pair", F.round("auc", 6).alias("auc"), F.col("n1").alias("n_real"), F.col("n0").alias("n_synth"), "top_features", "verdict")
