"""Ordered operators of any size: ranges with a bound, hot values, text keys, tolerance clusters as runs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from latticeworks.operators import clustering, ranks
from latticeworks.operators.clustering import cluster_values
from latticeworks.operators.folds import group_folds
from latticeworks.operators.ranks import ordered_ranges, percentiles, running_sums


def test_no_range_exceeds_its_bound_with_one_value_on_half_the_rows(spark, monkeypatch):
    """A million rows; half of them have one value and are told apart by their id only."""
    n, bound, seen = 1_000_000, 50_000, []
    df = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.xxhash64("id") % 1000).alias("v"))
    real = ranks.ordered_ranges

    def spy(*args, **kwargs):
        seen.append(real(*args, **kwargs))
        return seen[-1]

    monkeypatch.setattr(ranks, "ordered_ranges", spy)
    got = running_sums(df, "v", {"rank": F.lit(1)}, ties=["id"], rows=bound)
    checked = got.agg(F.count(F.lit(1)), F.count_distinct("rank"), F.min("rank"), F.max("rank")).first()
    assert checked[:] == (n, n, 1, n)
    wrong = got.select(F.struct("v", "id").alias("o"), "rank").withColumn("slice", F.floor(F.col("rank") / 1000)).groupBy("slice").agg(F.min("o").alias("lo"), F.max("o").alias("hi")).orderBy("slice").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(wrong, wrong[1:], strict=False))
    sizes = [r["count"] for r in seen[0].groupBy("_part").count().collect()]
    assert sum(sizes) == n and max(sizes) <= bound


def test_equal_rows_are_one_row_with_their_number(spark):
    rows = [("a", 1.0, 2)] * 400 + [("a", 1.0, 3)] * 3 + [("b", None, 5), ("b", 0.5, 1), (None, 2.0, 4), (None, 2.0, 4)]
    df = spark.createDataFrame(rows, "k string, v double, w int").repartition(5)
    for least in (1, 6):
        got = running_sums(df, "v", {"s": F.col("w"), "n": F.lit(1)}, ["k"], ["w"], n=least).collect()
        assert sorted(r.n for r in got if r.k == "a") == list(range(1, 404))
        assert sorted(r.s for r in got if r.k == "a") == [*range(2, 802, 2), 803, 806, 809]
        assert sorted((r.v is None, r.s) for r in got if r.k == "b") == [(False, 6), (True, 5)]
        assert sorted(r.s for r in got if r.k is None) == [4, 8]


def test_ranks_over_texts(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, i int").repartition(4)
    got = {r.i: r.rank for r in running_sums(df, "w", {"rank": F.lit(1)}, ties=["i"], n=9).collect()}
    want = sorted(range(len(words)), key=lambda i: (words[i].encode(), i))
    assert [got[i] for i in want] == list(range(1, len(words) + 1))


def test_percentiles_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 50)
    rng = random.Random(4)
    values = [rng.gauss(0, 1) for _ in range(901)] + [0.25] * 450
    got = percentiles(spark.createDataFrame([(v,) for v in values], "v double").repartition(5), "v", {"q": 0.37, "m": 0.5}).first()
    at = lambda p: (s := sorted(values), x := (len(s) - 1) * p, s[int(x)] + (s[min(int(x) + 1, len(s) - 1)] - s[int(x)]) * (x - int(x)))[2]
    assert got["q"] == pytest.approx(at(0.37)) and got["m"] == pytest.approx(at(0.5))


def folded(sizes: dict[str, int], k: int) -> dict[str, int]:
    loads, out = [0] * k, {}
    for key in sorted(sizes, key=lambda g: (-sizes[g], g)):
        out[key] = loads.index(min(loads))
        loads[out[key]] += sizes[key]
    return out


def test_folds_of_text_keys(spark, monkeypatch):
    """Many groups of one row, ranked in ranges: none holds all groups of a size."""
    monkeypatch.setattr(ranks, "RANGE_ROWS", 200)
    rng = random.Random(6)
    sizes = {f"key {i:05}": 1 for i in range(1500)} | {f"big {i}": rng.randint(2, 40) for i in range(30)}
    rows = [(g, j) for g, n in sizes.items() for j in range(n)]
    rng.shuffle(rows)
    got = {r.g: r.fold for r in group_folds(spark.createDataFrame(rows, "g string, j int"), "g", 5).collect()}
    assert got == folded(sizes, 5)


def greedy(values, atol, rtol):
    out, total, n, k = {}, 0.0, 0, -1
    for v in sorted(set(values)):
        if n and abs(v - total / n) <= max(atol, rtol * abs(total / n)):
            total, n = total + v, n + 1
        else:
            total, n, k = v, 1, k + 1
        out[v] = k
    return out


@pytest.mark.parametrize("atol,rtol", [(0.5, 0.0), (0.01, 0.08), (2.0, 0.3), (0.0, 0.0)])
def test_clusters_are_those_of_the_greedy_rule(spark, monkeypatch, atol, rtol):
    """Values of either sign, over many ranges, in runs that are folded apart."""
    monkeypatch.setattr(ranks, "RANGE_ROWS", 60)
    rng = random.Random(8)
    values = [round(rng.choice([rng.gauss(0, 1), rng.gauss(40, 6), rng.gauss(-90, 9), rng.uniform(-200, 200)]), 3) for _ in range(700)]
    df = spark.createDataFrame([(v, 1) for v in values], "v double, w int").repartition(6)
    got = {r.value: r.cluster for r in cluster_values(df, "v", "w", atol, rtol).collect()}
    assert got == greedy(values, atol, rtol)


def test_runs_are_short_where_gaps_are_wide(spark):
    """Separate groups of values are separate runs, whatever their number: no task or array holds them all."""
    df = spark.range(5000).select((F.col("id").cast("int") / 10 + F.floor(F.col("id") / 10)).alias("value"), F.lit(1).cast("long").alias("w"))
    sizes = clustering.runs_of(df, 0.3, 0.0).groupBy("run").count().collect()
    assert len(sizes) == 500 and {r["count"] for r in sizes} == {10}
