"""Lookups, shards, merges in place, symbols by a table function, and the domain report."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from latticeworks.operators import domains, symbols
from latticeworks.sources import indexed


def files(path) -> set[str]:
    return {os.path.join(a, f) for a, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def scanned(df) -> int:
    """Rows that the scans of a query gave, after row groups and pages were skipped."""
    df.count()
    plan = df._jdf.queryExecution().executedPlan()
    rows, stack = 0, [plan]
    while stack:
        node = stack.pop()
        if "Scan" in node.nodeName():
            rows += node.metrics().apply("numOutputRows").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return rows


def test_lookup_reads_a_small_share(spark, tmp_path):
    path, n = f"file://{tmp_path}/t", 400_000
    table = spark.range(n).select((F.col("id") * 3).alias("k"), F.concat(F.lit("value "), F.col("id")).alias("v")).orderBy(F.xxhash64("k"))
    indexed.write_indexed(table, path, "k", files=4, page_rows=500)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan that ran, without wrappers
    try:
        keys = [3 * random.Random(1).randrange(n) for _ in range(1)] + [3 * (7919 * i % n) for i in range(99)]
        found = indexed.point_lookup(spark, path, "k", [*keys, keys[0], None, 1, 3 * n])
        # The rows that a scan gives beyond a filter's pages are counted on the scan without the filter above it.
        assert {r.k: r.v for r in found.collect()} == {k: f"value {k // 3}" for k in keys}
        assert scanned(found) < n / 4
        one = indexed.point_lookup(spark, path, "k", [keys[5]])
        assert one.count() == 1 and scanned(one) <= 1000
        assert scanned(indexed.point_lookup(spark, path, "k", [keys[5] + 1])) <= 1000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    many = indexed.lookup_many(spark, path, spark.createDataFrame([(k,) for k in [*keys, keys[0], None]], "k long"), "k")
    assert sorted(r.k for r in many.collect()) == sorted(set(keys))
    assert indexed.lookup_many(spark, path, spark.createDataFrame([], "k long"), "k").count() == 0
    assert indexed.point_lookup(spark, path, "k", []).count() == 0


def test_shards_are_numbered_and_repeatable(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    rows = [(i % 90, i, "x") for i in range(1003)] + [(5, 5, "x")] * 40
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, i int, shard string").drop("shard").repartition(6)
    indexed.write_shards(df, path, "k", 100, ["i"])
    first = sorted((r.shard, r.rows, r.first, r.last) for r in indexed.shard_index(spark, path, "k").collect())
    assert [r[:2] for r in first] == [(k, 100) for k in range(10)] + [(10, 43)]
    assert all(a[3] <= b[2] for a, b in zip(first, first[1:], strict=False))
    content = lambda: sorted(map(tuple, spark.read.parquet(path).select("shard", "k", "i").collect()))
    held = content()
    indexed.write_shards(df.repartition(3), path, "k", 100, ["i"])
    assert content() == held and [r[1:] for r in held] == sorted((k, i) for k, i, _ in rows)


def test_shards_as_row_groups(spark, tmp_path):
    """Many shards make few files; each is one row group, and a sample is that of shards in folders."""
    df = spark.range(10_050).select("id", (F.col("id") * 7).alias("v")).repartition(6)
    for name, folders in (("folders", True), ("groups", False)):
        indexed.write_shards(df, f"file://{tmp_path}/{name}", "id", 100, folders=folders)
    found = list((tmp_path / "groups").rglob("*.parquet"))
    assert len(found) == 1
    meta = pq.ParquetFile(found[0]).metadata
    assert [meta.row_group(k).num_rows for k in range(meta.num_row_groups)] == [100] * 100 + [50]
    read = lambda name, f: sorted(tuple(r[c] for c in ("shard", "id", "v")) for r in f(f"file://{tmp_path}/{name}").collect())
    for f in (spark.read.parquet, lambda path: indexed.sample_shards(spark, path, 3, 20, ["id"])):
        assert read("groups", f) == read("folders", f)


def test_merge_touches_only_partitions_with_retries(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    rows = [(i, i % 5, None if i % 7 == 0 else float(i), i % 7 == 0) for i in range(100)]
    spark.createDataFrame(rows, "id int, part int, v double, failed boolean").write.partitionBy("part").parquet(path)
    before = files(tmp_path / "m")
    new = spark.createDataFrame([(7, 2, 70.0, False), (14, 4, None, True), (8, 3, 80.0, False), (999, 2, 1.0, False)], "id int, part int, v double, failed boolean")
    for _ in range(2):  # the second merge finds no failed row that the retries could mend further
        indexed.merge_in_place(spark, path, new, "id", F.col("failed"), "part")
        got = {r.id: (r.v, r.failed) for r in spark.read.parquet(path).collect()}
        assert len(got) == 100 and got[7] == (70.0, False) and got[14] == (None, True) and got[8] == (8.0, False) and got[0] == (None, True)
        after = files(tmp_path / "m")
        kept = lambda fs, parts: {f for f in fs if any(f"part={p}/" in f for p in parts)}
        assert kept(before, (0, 1)) == kept(after, (0, 1)) and not kept(before, (2, 3, 4)) & kept(after, (2, 3, 4))


def test_symbols(spark):
    assert symbols.listed("P 21/c (P21/n) | Fm-3m;Ia , P 21/c, (x) ; a (b) c,") == ["P 21/c", "P21/n", "Fm-3m", "Ia", "(x)", "a (b) c"]
    assert symbols.listed(None) == [] and symbols.listed(" ; ") == []
    assert symbols.spellings("P2₁_/c?") == ["P21_/c", "P21/c"] and symbols.spellings("Ｆｍ−3 m.") == ["Fm-3 m", "Fm-3m"] and symbols.spellings("?.") == []
    df = spark.createDataFrame([(1, "P2_1/c; X"), (1, "Fm−3m"), (2, "x y_z"), (3, None), (4, "nothing"), (None, "Fm-3m")], "id long, s string")
    got = sorted((str(r.key), r["rank"], r.candidate) for r in symbols.candidates(df, "id", "s").collect())
    assert got == [("1", 1, "Fm-3m"), ("1", 2, "P2_1/c"), ("1", 3, "P21/c"), ("1", 4, "X"), ("2", 1, "x y_z"), ("2", 2, "x yz"), ("2", 3, "xyz"), ("4", 1, "nothing"), ("None", 1, "Fm-3m")]
    table = spark.createDataFrame([("P21/c", 14), ("xyz", 9), ("x yz", 8), ("X", 1)], "symbol string, number long")
    assert sorted((r.key, r.number, r.candidate) for r in symbols.resolve(df, "id", "s", table).collect()) == [(1, 14, "P21/c"), (2, 8, "x yz")]
    symbols.register(spark)
    assert spark.sql("SELECT count(*) AS n FROM symbol_candidates(TABLE(SELECT CAST(id AS BIGINT) AS key, 'a_b; c' AS text FROM range(50)) PARTITION BY key)").first().n == 150


def auc(scores, sides):
    pos, neg = scores[sides == 1], scores[sides == 0]
    return float(np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])))


@pytest.fixture(scope="module")
def two_pairs(spark):
    """Pair 1 differs in ``b`` alone, pair 2 in nothing, pair 3 has too few rows; some values are missing."""
    rng = np.random.default_rng(0)
    rows = []
    for pair, n in ((1, 240), (2, 240), (3, 12)):
        for i in range(n):
            side = bool(i % 2)
            values = rng.normal(size=3) + np.array([0, 2.0 * side * (pair == 1), 0])
            rows.append((pair, 1000 * pair + i, side, *(None if rng.random() < 0.05 else float(v) for v in values)))
    return spark.createDataFrame([*rows, (None, 1, True, 1.0, 1.0, 1.0), (1, 2, None, 1.0, 1.0, float("nan"))], "pair int, id long, side boolean, a double, b double, c double").repartition(4)


def test_domain_report(spark, two_pairs):
    features = ["a", "b", "c"]
    scores = domains.scored(two_pairs, features, folds=2, repeats=3, least=50, trees=5, depth=2).cache()
    rows = scores.toPandas()
    # Each row once as it is, and once for each feature and repeat; every shuffle keeps its fold's rows.
    assert rows[rows.feature.isna()].groupby("pair").size().to_dict() == {1: 240, 2: 240}
    assert len(rows) == 480 * (1 + 3 * 3)
    found = {(r.pair, r.feature): r for r in domains.importances(scores, features).collect()}
    for pair in (1, 2):
        own = rows[rows.pair == pair]
        whole = {k: auc(g.score.to_numpy(), g._side.to_numpy()) for k, g in own[own.feature.isna()].groupby("fold")}
        assert found[pair, "a"].auc == pytest.approx(np.mean(list(whole.values())))
        for k, name in enumerate(features):
            lost = [whole[fold] - auc(g.score.to_numpy(), g._side.to_numpy()) for (fold, _), g in own[own.feature == k].groupby(["fold", "repeat"])]
            assert found[pair, name].loss == pytest.approx(np.mean(lost))
    report = {r.pair: r for r in domains.report(two_pairs, features, top=2, folds=2, repeats=3, least=50, trees=5, depth=2).collect()}
    assert set(report) == {1, 2} and report[1].auc > 0.85 and report[1].verdict == "wide gap" and report[1].top_features.startswith("b; ") and (report[1].n1, report[1].n0) == (120, 120)
    assert 0.3 < report[2].auc < 0.65 and report[2].verdict == "close"
    assert found[1, "b"].loss > 0.2 and abs(found[1, "a"].loss) < 0.08


def test_shuffles_are_permutations(spark):
    rows = spark.createDataFrame([(1, i % 2, i, float(i % 3 == 0), float(i), float(-i)) for i in range(60)], "pair int, fold int, id long, _side double, a double, b double")
    got = domains.stacked(rows, ["a", "b"], 2).collect()
    for fold in (0, 1):
        ids = [i for i in range(60) if i % 2 == fold]
        for repeat in (1, 2):
            a = [r.f for r in got if (r.fold, r.feature, r.repeat) == (fold, 0, repeat)]
            assert sorted(f[0] for f in a) == [float(i) for i in ids] and sorted(-f[1] for f in a) == [float(i) for i in ids]
            assert sum(f[0] != -f[1] for f in a) > len(ids) // 2


def test_domain_report_of_nothing(spark, two_pairs):
    assert domains.report(two_pairs.where("pair = 3"), ["a", "b", "c"], least=50).count() == 0
