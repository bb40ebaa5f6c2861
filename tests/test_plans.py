"""Plans: no cross products, filters and columns reach the scans; ranks and quotas in buckets; invariances."""

from __future__ import annotations

import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticeworks import catalog
import array_kernels as K
from latticeworks.operators.ranks import running_sums, take_by_hash

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


#: Queries that join one row, or a fixed few (thresholds, orbits, intervals), to every row without a key.
ONE_OR_FEW_ROWS = set(
    "bragg_positions coverage_filters impute ks_statistic permutation_importance pseudo_label_assign pseudo_label_registry quantile_trim roc_auc roc_curve sg_system_range_join standardise_train_only structure_factor threshold_calibration".split()
)


@tables
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - {"stream_window_counts", "domain_gbt"}))
def test_no_cross_products(spark, name):
    text = plan(catalog.queries()[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text or name in ONE_OR_FEW_ROWS


@tables
def test_scans_read_what_is_asked(spark):
    text = plan(catalog.queries()["band_pair_select"](spark, SF))
    assert "PushedFilters: [Or(" in text and "l_extendedprice" not in text
    text = plan(catalog.queries()["dup_count"](spark, SF))
    assert "n_chars" not in text and "source" not in text


def test_running_sums_equal_a_window(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), float(v), i) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500), strict=True))]
    df = spark.createDataFrame(rows, "k int, v double, i int").repartition(5)
    got = {r.i: r.s for r in running_sums(df, "v", {"s": F.col("i")}, ["k"], ["i"], n=8).collect()}
    for k in range(3):
        total = 0
        for v, i in sorted((v, i) for kk, v, i in rows if kk == k):
            total += i
            assert got[i] == total
    assert running_sums(df.where("k > 9"), "v", {"s": F.lit(1)}).count() == 0


def test_quotas_take_the_smallest_hashes(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).alias("s"), F.md5(F.col("id").cast("string")).alias("h"))
    taken = take_by_hash(df, "h", ["id"], lambda n: F.floor(n * 0.1), ["s"])
    rows = taken.collect()
    for s in range(7):
        own = sorted((r.h, r.id) for r in rows if r.s == s)
        assert {r.id for r in rows if r.s == s and r.taken} == {i for _, i in own[: len(own) // 10]}
    assert sum(r.taken for r in take_by_hash(df, "h", ["id"], lambda n: F.lit(5)).collect()) == 5
    assert sum(r.taken for r in take_by_hash(df, "h", ["id"], lambda n: F.lit(0)).collect()) == 0


@tables
@pytest.mark.parametrize("name", ["modes_table", "gini", "stratified_group_split", "threshold_calibration", "roc_curve"])
def test_partitioning_does_not_matter(spark, name, tmp_path):
    for t in ("events", "part", "labels", "documents"):
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(7).write.parquet(str(tmp_path / f"{t}.parquet"))
    run = catalog.queries()[name]
    assert sorted(map(repr, run(spark, SF).collect())) == sorted(map(repr, run(spark, str(tmp_path)).collect()))


def test_permutation_importance_of_every_feature(spark, tmp_path):
    """Ids with gaps and neighbours of one label, one repeated row: only the tenth of ten features tells the domains apart."""
    rng = np.random.default_rng(1)
    rows = [(i * 10, int(i >= 300), [*rng.normal(size=9).tolist(), float(rng.normal() + 4 * (i >= 300))]) for i in range(600)]
    spark.createDataFrame([*rows, rows[0]], "vec_id long, label int, embedding array<float>").repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.k: r.loss for r in catalog.queries()["permutation_importance"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(10))
    assert got[9] > 0.3 and all(abs(got[k]) < 0.05 for k in range(9))


def test_ordering_a_pair_twice_changes_nothing(spark):
    pairs = spark.createDataFrame([(1.5, 1.2), (None, 1.2), (1.2, None), (1.0, 2.0), (None, None)], "p double, s double")
    both = F.col("p").isNotNull() & F.col("s").isNotNull()
    fix = lambda df: df.select(F.when(both, F.least("p", "s")).otherwise(F.col("p")).alias("p"), F.when(both, F.greatest("p", "s")).otherwise(F.col("s")).alias("s"))
    assert fix(fix(pairs)).collect() == fix(pairs).collect()


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(st.floats(-5, 95), st.floats(-10, 1e6)), max_size=40))
def test_preprocessing_stays_in_range(points):
    x, y = (np.array([p[i] for p in points], float) for i in (0, 1))
    found = K.preprocess_one(x, y)
    if found:
        grid, lo, hi, *_ = found
        assert np.isfinite(grid).all() and grid.min() >= 0 and grid.max() <= 1 and not grid[:lo].any() and not grid[hi + 1 :].any()
