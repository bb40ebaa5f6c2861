"""Reflections and orbits against enumeration with matrices, operators and tables; sources that had no test of their own."""

from __future__ import annotations

import gzip
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeworks import catalog
from latticeworks.functions import crystal as X
from latticeworks.operators.reflections import reflections
from latticeworks.sources import files, indexed
from test_oracle import SF
from test_stores import files as parquet_files

IDENTITY = (1, 0, 0, 0, 1, 0, 0, 0, 1)
THREEFOLD = ((0, -1, 0, 1, -1, 0, 0, 0, 1), (-1, 1, 0, -1, 0, 0, 0, 0, 1))  # on a hexagonal cell
CELLS = [(1, 4.0, 5.0, 6.0, 90.0, 90.0, 90.0, None), (2, 3.5, 4.5, 5.5, 75.0, 100.0, 95.0, [IDENTITY]), (3, 4.9, 4.9, 5.4, 90.0, 90.0, 120.0, [IDENTITY, *THREEFOLD]), (4, 2.0, 2.0, 2.0, 90.0, 90.0, 90.0, []), (5, 4.0, 4.0, 4.0, 60.0, 60.0, 60.0, [IDENTITY, (0, 0, 1, 1, 0, 0, 0, 1, 0), (0, 1, 0, 0, 0, 1, 1, 0, 0)])]


def lattice(a, b, c, al, be, ga):
    al, be, ga = np.radians([al, be, ga])
    cx = np.cos(be)
    cy = (np.cos(al) - np.cos(be) * np.cos(ga)) / np.sin(ga)
    return np.array([[a, 0, 0], [b * np.cos(ga), b * np.sin(ga), 0], [c * cx, c * cy, c * np.sqrt(1 - cx**2 - cy**2)]])


def enumerated(cell, ops, wavelength, low, high):
    """Orbits as sets, from all triples in a generous box."""
    back, out, done = np.linalg.inv(lattice(*cell)), {}, set()
    for v in itertools.product(range(-9, 10), repeat=3):
        if not any(v) or v in done:
            continue
        orbit = {tuple(int(x) for x in np.array(r).reshape(3, 3) @ v) for r in (ops or [IDENTITY])}
        orbit |= {tuple(-x for x in w) for w in orbit}
        done |= orbit
        d = 1 / np.linalg.norm(back @ np.array(v))
        s = wavelength / (2 * d)
        if s <= 1 and low <= 2 * np.degrees(np.arcsin(s)) <= high:
            out[max(orbit)] = (len(orbit), round(d, 8))
    return out


def test_reflections_against_matrices(spark):
    df = spark.createDataFrame(CELLS, "id int, a double, b double, c double, al double, be double, ga double, ops array<array<int>>")
    got: dict[int, dict] = {}
    for r in reflections(df, 1.5406, 5.0, 75.0).collect():
        got.setdefault(r.id, {})[r.h, r.k, r.l] = (r.multiplicity, round(r.d, 8))
        assert r.two_theta == pytest.approx(2 * np.degrees(np.arcsin(1.5406 / (2 * r.d))))
    for key, *cell, ops in CELLS:
        assert got.get(key, {}) == enumerated(cell, ops, 1.5406, 5.0, 75.0), key
    assert reflections(df.where("false"), 1.5406, 5.0, 75.0).count() == 0


def test_operators_with_shifts(spark):
    df = spark.createDataFrame([("x, -y+1/4 , z - 2/3",), ("1/2+x,y+0.125,-.5-z",), ("-Y,X,Z",)], "op string")
    got = df.select(X.symop_rotation(F.col("op")).alias("r"), X.symop_translation(F.col("op")).alias("t")).collect()
    assert [list(r.t) for r in got] == [[0.0, 0.25, pytest.approx(-2 / 3)], [0.5, 0.125, -0.5], [0.0, 0.0, 0.0]]
    assert [list(r.r) for r in got] == [[1, 0, 0, 0, -1, 0, 0, 0, 1], [1, 0, 0, 0, 1, 0, 0, 0, -1], [0, -1, 0, 1, 0, 0, 0, 0, 1]]


def test_interpolation_in_a_table(spark):
    nodes = [3.0, 5.0, 1.0, 1.5]
    at = [-1.0, 0.0, 0.25, 1.0, 1.5, 2.75, 3.0, 9.0]
    df = spark.createDataFrame([(x,) for x in at], "at double").withColumn("nodes", F.array(*(F.lit(v) for v in nodes)))
    assert [r[0] for r in df.select(X.interpolate(F.col("nodes"), F.col("at"))).collect()] == pytest.approx(list(np.interp(at, range(4), nodes)))
    assert df.select(X.interpolate(F.array(F.lit(2.0)), F.col("at"))).distinct().collect()[0][0] == 2.0


def test_row_seeds_are_those_of_zlib(spark):
    """Both seeds of each row in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()
    got = {r["doc_id"]: (r["seed"], r["second"]) for r in catalog.queries()["row_seed"](spark, SF).collect()}
    own = {r.doc_id: zlib.crc32(f"{r.source}:{r.doc_id}".encode()) for r in docs}
    assert got == {i: (seed, seed ^ 0x9E3779B9) for i, seed in own.items()}


def test_compressed_sources_read_as_they_are(spark, tmp_path):
    """A compressed file of JSON or CSV needs no copy beside it: the codec goes by the name."""
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('[{"k": 1, "v": "é"}, {"k": 2, "v": null}]')
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("k,v\n1,é\n2,\n")
    for got in (files.read_json_array(spark, f"file://{tmp_path}/a.json.gz", "k int, v string"), files.read_csv(spark, f"file://{tmp_path}/a.csv.gz", "k int, v string")):
        assert sorted((r.k, r.v) for r in got.collect()) == [(1, "é"), (2, None)]


def test_ragged_peaks_round_trip(spark, tmp_path):
    """Peaks of each row as one column of structs, written and read again, of any number."""
    rng = random.Random(1)
    rows = [(i, *[[rng.random() for _ in range(n)] for _ in range(4)]) for i, n in enumerate([0, 1, 7, 300])]
    df = spark.createDataFrame(rows, "id int, centre array<double>, amp array<double>, fwhm array<double>, eta array<double>")
    df.select("id", files.peak_rows([F.col(c) for c in ("centre", "amp", "fwhm", "eta")]).alias("peaks")).write.parquet(f"file://{tmp_path}/p")
    got = {r.id: [tuple(p) for p in r.peaks] for r in spark.read.parquet(f"file://{tmp_path}/p").collect()}
    assert got == {i: list(zip(*own, strict=True)) for i, *own in rows}
    flat = spark.read.parquet(f"file://{tmp_path}/p").select("id", F.posexplode("peaks").alias("n", "p")).select("id", "n", "p.*")
    assert flat.count() == 308 and flat.columns == ["id", "n", "centre", "amp", "fwhm", "eta"]


def test_sampled_shards_are_all_that_is_read(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    indexed.write_shards(spark.range(5000).select("id", (F.col("id") * 7).alias("v")), path, "id", 250)
    got = indexed.sample_shards(spark, path, 3, 20, ["id"])
    rows = sorted(map(tuple, got.select("shard", "id", "v").collect()))
    assert len(rows) == 60 and len({s for s, *_ in rows}) == 3 and all(i // 250 == s and v == 7 * i for s, i, v in rows)
    assert rows == sorted(map(tuple, indexed.sample_shards(spark, path, 3, 20, ["id"]).select("shard", "id", "v").collect()))
    assert rows != sorted(map(tuple, indexed.sample_shards(spark, path, 3, 20, ["id"], seed="other").select("shard", "id", "v").collect()))
    read = {f.rpartition("/shard=")[2].partition("/")[0] for f in got.where("true").inputFiles()}
    assert len(parquet_files(tmp_path / "s")) == 20 and len(read) >= 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.partition("PartitionFilters: [")[2].partition("]")[0]
    assert indexed.sample_shards(spark, path, 0, 20, ["id"]).count() == 0
