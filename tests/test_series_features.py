"""Regridding and feature sets as plans against array code written from the same definitions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import array_kernels as K
from latticeworks import catalog
from latticeworks.operators import regrid
from latticeworks.operators import series_features as S

NAN = float("nan")


def patterns():
    """Sums of peaks over backgrounds, with noise; short, flat, empty, repeated and out-of-range series."""
    rng = np.random.default_rng(3)
    out = []
    for k in range(7):
        x = np.sort(rng.uniform(4 + k, 88 - 2 * k, 700))
        y = 20 + 30 * np.exp(-x / 20)
        for _ in range(14):
            centre, width = rng.uniform(8, 80), rng.uniform(0.15, 1.2)
            y = y + rng.uniform(20, 900) * np.exp(-(((x - centre) / width) ** 2))
        out.append((x, rng.poisson(y).astype(float)))
    order = rng.permutation(300)
    out.append((np.linspace(0, 90, 300)[order], (np.linspace(0, 90, 300) ** 1.5)[order]))
    out.append((np.linspace(5, 85, 200), np.full(200, 3.0)))
    out.append((np.linspace(5, 85, 200), np.zeros(200)))
    out.append((np.array([10.0, 10.0, 30.0, 20.0, NAN, 40.0, 95.0]), np.array([1.0, 9.0, -4.0, 4.0, 1.0, float("inf"), 50.0])))
    out += [(np.array([1.0, 89.0]), np.array([1.0, 4.0])), (np.array([5.0]), np.array([1.0])), (np.array([20.0, 20.001]), np.array([1.0, 2.0])), (np.array([91.0, 95.0, 99.0]), np.ones(3)), (np.array([0.0, 45.0, 90.0]), np.array([1.0, 0.0, 4.0])), (np.linspace(30, 33.5, 60), rng.random(60)), (np.linspace(30, 31.0, 60), rng.random(60))]
    return out


@pytest.fixture(scope="module")
def gridded(spark):
    rows = [(s, i, float(a), float(b)) for s, (x, y) in enumerate(patterns()) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(0, 9999, None, 1.0), (0, 9998, 1.0, None)]
    points = spark.createDataFrame(rows, "s int, i long, x double, y double").repartition(5)
    heads, values = regrid.on_grid(points)
    return heads.cache(), values.cache()


@pytest.fixture(scope="module")
def expected():
    return {s: K.preprocess_one(x, y) for s, (x, y) in enumerate(patterns())}


def test_regridding(gridded, expected):
    heads, values = gridded
    got, rows = {r.s: r for r in heads.collect()}, {}
    for r in values.collect():
        rows.setdefault(r.s, {})[r.bin] = r.value
    for s, want in expected.items():
        if want is None:
            assert got[s].failed and s not in rows
            continue
        y, lo, hi, x_min, x_max, n = want
        assert (got[s].lo, got[s].hi, got[s].x_min, got[s].x_max, got[s].n, got[s].failed) == (lo, hi, x_min, x_max, n, hi < 0), s
        assert sorted(rows.get(s, {})) == list(range(lo, hi + 1))
        np.testing.assert_allclose([rows[s][b] for b in range(lo, hi + 1)] if hi >= 0 else [], y[lo : hi + 1], atol=2e-7)
    dense = {r.s: r for r in regrid.dense(heads, values).where("not failed").collect()}
    assert all(len(r.y) == 4096 for r in dense.values())
    np.testing.assert_allclose(dense[0].y, expected[0][0], atol=2e-7)


@pytest.mark.parametrize("which", ["a", "b", "c"])
def test_feature_sets(gridded, expected, which):
    heads, values = gridded
    got = {r.s: r.asDict() for r in getattr(S, f"features_{which}")(heads, values).collect()}
    applied = 0
    for s, own in expected.items():
        # Peaks hang on the last digit of the grid's values, which are kept as floats.
        want = K.SETS[which](own[0].astype(np.float32).astype(float), own[1], own[2]) if own and own[2] >= 0 else None
        if s >= len(patterns()) - 2 and which == "b":
            continue  # narrower than the wide mean of set B
        assert (want is None) == (s not in got), s
        if want is None:
            continue
        applied += 1
        assert set(got[s]) == {"s", *want}
        for name, value in want.items():
            if value is None or not math.isfinite(value):
                assert got[s][name] is None, (s, name, got[s][name])
            else:
                assert got[s][name] == pytest.approx(value, rel=1e-5, abs=1e-6), (s, name)
    assert applied >= 6


def test_nothing(spark):
    none = spark.createDataFrame([], "s int, i long, x double, y double")
    heads, values = regrid.on_grid(none)
    assert heads.count() == 0 and values.count() == 0
    assert S.features_a(heads, values).count() == S.features_b(heads, values).count() == S.features_c(heads, values).count() == 0


def test_grid_places(spark):
    places = [r[0] for r in spark.range(4096).select(regrid.place(F.col("id"))).collect()]
    assert places == K.GRID.tolist() and S.window_places() == (int(np.flatnonzero(K.GRID >= 10)[0]), int(np.flatnonzero(K.GRID <= 70)[-1]))


def test_arrays_are_the_rows(spark):
    """The array of a series holds what its rows on the grid do, to the last digit, and so in a part of the grid."""
    rows = [(s, i, float(a), float(b)) for s, (x, y) in enumerate(patterns()) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    points = spark.createDataFrame(rows, "s int, i long, x double, y double").repartition(5)
    heads, values = regrid.on_grid(points)
    for low, high in ((0, 4095), S.window_places()):
        got = {r.s: r.asDict() for r in regrid.arrays_on_grid(points, low, high).collect()}
        want = {r.s: r.asDict() for r in S.listed(heads, values, low, high).collect()}
        assert got == want and all(r["n"] == len(r["v"]) for r in got.values())
        assert len(got) >= 10


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A folder with events of forty users, sixty each."""
    folder = str(tmp_path_factory.mktemp("events"))
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 1_000_003 * 1000).cast("timestamp_ntz")
    spark.range(2400).select(F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 40).alias("user_id"), (F.rand(1) * 100).alias("value")).write.parquet(f"{folder}/events.parquet")
    return folder


def exchanged(spark, df) -> tuple[int, int]:
    """Rows that a query exchanges, and rows that it writes aside, besides those of its result."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    none, quantiles = gateway.jvm.java.util.ArrayList(), gateway.new_array(gateway.jvm.double, 0)

    def stages():
        found = store.stageList(none, False, False, quantiles, none)
        return {(s.stageId(), s.attemptId()): s for s in (found.apply(k) for k in range(found.size()))}

    before = stages()
    df().write.format("noop").mode("overwrite").save()
    new = [s for k, s in stages().items() if k not in before]
    return sum(s.shuffleWriteRecords() for s in new), sum(s.outputRecords() for s in new if s.outputBytes() > 0)


@pytest.mark.parametrize("name", ["feature_set_b", "feature_set_c", "feature_set_a"])
def test_feature_sets_exchange_points_only(spark, events, name):
    """A series has up to 4,096 values on the grid: none of them is exchanged or written aside, only its points are."""
    moved, written = exchanged(spark, lambda: catalog.queries()[name](spark, events))
    assert 2400 <= moved <= 5 * 2400 and written == 0


def disk_bytes(spark, run):
    """What ``run`` gives, and the bytes that it exchanges, spills and writes aside."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    none, quantiles = gateway.jvm.java.util.ArrayList(), gateway.new_array(gateway.jvm.double, 0)

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(none, False, False, quantiles, none)
        return {(s.stageId(), s.attemptId()): s for s in (found.apply(k) for k in range(found.size()))}

    before = stages()
    out = run()
    return out, sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for k, s in stages().items() if k not in before)


def test_feature_set_c_takes_disk_by_points(spark, events, tmp_path):
    """Copies of the events under other keys take so many bytes more as they have points, a few tens of bytes each, and every copy has the features of the first."""
    own = spark.read.parquet(f"{events}/events.parquet").crossJoin(spark.range(5).withColumnRenamed("id", "k"))
    own.selectExpr("event_id + 2400 * k AS event_id", "ts", "user_id + 40 * k AS user_id", "value").write.parquet(f"{tmp_path}/events.parquet")
    of = lambda folder: disk_bytes(spark, lambda: {r[0]: r[1:] for r in catalog.queries()["feature_set_c"](spark, folder).collect()})
    (one, small), (five, large) = of(events), of(str(tmp_path))
    assert 0 < small <= 100 * 2400 and large <= 5.5 * small
    assert len(one) == 40 and five == {u + 40 * k: r for u, r in one.items() for k in range(5)}


@pytest.mark.parametrize("name", ["feature_set_b", "feature_set_c", "feature_set_a"])
def test_feature_sets_keep_their_partitions(spark, events, name):
    """The points of many series are few bytes, but hours of work: their partitions aren't joined into one, nor exchanged twice."""
    df = catalog.queries()[name](spark, events)
    df.write.format("noop").mode("overwrite").save()
    assert df.rdd.getNumPartitions() == 4
    assert df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 1


def test_moments_and_lags_are_those_of_columns(spark):
    """The numbers worked out inside tasks are those of the expressions on arrays: of noise, a ramp, a flat array, short ones."""
    from latticeworks.operators import arrays as A

    own = [np.random.default_rng(1).random(500), np.linspace(0, 1, 50), np.full(9, 0.1), np.array([0.5, 0.25]), np.array([0.5])]
    v, n = F.col("v"), F.size("v")
    lag = lambda k: A.correlation(A.cut(v, 0, n - k), A.cut(v, k, n - k), F.lit(None).cast("double"))
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(own)], "i int, v array<double>")
    rows = df.select("i", A.deviation(v), A.moment(v, 3), A.moment(v, 4), lag(1), lag(3)).orderBy("i").collect()
    for row, a in zip(rows, own, strict=True):
        for want, got in zip(row[1:], (*A.moments(a), A.lagged(a, 1), A.lagged(a, 3)), strict=True):
            assert (got is None) == (want is None) and (want is None or got == pytest.approx(want, rel=1e-9, abs=1e-15))


def test_reflected_mean_takes_a_pass(spark, events):
    """A wide mean of short series makes no row for each pair of places: of 60 points and 181 places, some four rows a point pass through the frame."""
    from latticeworks.plans import signals
    from latticeworks.registry import Tables

    for size in (7, 181):
        df = signals._reflected_mean(Tables(spark, events), size)
        ys = {}
        for r in signals.series(Tables(spark, events)).orderBy("user_id", "i").collect():
            ys.setdefault(r.user_id, []).append(r.y)
        got = {(r[0], r[1]): r[2] for r in df.collect()}
        assert len(got) == 2400
        for u, y in ys.items():
            wide = np.pad(y, size // 2, mode="symmetric")
            for i in range(len(y)):
                assert got[u, i + 1] == pytest.approx(wide[i : i + size].mean(), abs=2e-6)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("Aggregate") == 0
