"""The jobs: growing input in two runs, reruns, hand-made cases, and their command lines."""

from __future__ import annotations

import datetime as dt
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobs import catalog, label_pools, series_store
from jobs.common import settings
from test_oracle import SF, ordered

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def files(path) -> set[str]:
    return {os.path.join(a, f) for a, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows(df) -> list[str]:
    return sorted(map(repr, df.collect()))


@needs_tables
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_registered_job_equals_its_sql(spark, name):
    before = sorted(spark.sql("SET").collect())
    got = ordered(catalog.queries()[name](spark, SF).toPandas())
    con = duckdb.connect()
    for t in ("documents", "labels", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = ordered(con.sql(catalog.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6)
    assert sorted(spark.sql("SET").collect()) == before


# --- series store --------------------------------------------------------------------------------------------------

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def at(day: int, hour: float) -> dt.datetime:
    return dt.datetime(2024, 1, day) + dt.timedelta(hours=hour)


FIRST = [(1, at(1, 0), 7, "a", 1.0, None), (2, at(1, 6), 7, "a", None, None), (3, at(1, 12), 7, "a", 3.0, None), (4, at(2, 1), 7, "b", 5.0, "{}"), (5, at(3, 1), None, None, 2.0, None), (None, at(1, 1), 7, "a", 9.0, None), (6, None, 7, "a", 9.0, None), (3, at(1, 12), 7, "a", 3.0, None)]
#: A retry that came through, one that failed again, a repeated point, a late point of a day long gone, a new day.
SECOND = [(2, at(1, 6), 7, "a", 2.0, None), (4, at(2, 1), 7, "b", None, None), (1, at(1, 0), 7, "a", 1.0, None), (8, at(1, 18), 7, "a", float("nan"), None), (9, at(4, 1), 8, "a", 4.0, None)]


@pytest.fixture
def store(spark, tmp_path):
    def put(points) -> None:
        spark.createDataFrame(points, EVENT).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    def run():
        return series_store.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint", settings("series_store"))

    return put, run, tmp_path


def test_store_takes_only_what_is_new(spark, store, tmp_path):
    put, run, _ = store
    put(FIRST)
    first = {(r["day"], r["user_id"]): r for r in run().collect()}
    assert set(first) == {("2024-01-01", 7), ("2024-01-02", 7), ("2024-01-03", None)}
    day = first["2024-01-01", 7]
    assert (day["n_points"], day["n_failed"], day["least"], day["most"], day["first_angle"], day["last_angle"], day["step"]) == (2, 1, 1.0, 3.0, 0.0, 45.0, 45.0)
    arrived, points, profile = (files(tmp_path / "out" / x) for x in ("arrived", "points", "profile"))
    put(SECOND)
    second = {(r["day"], r["user_id"]): r for r in run().collect()}
    day = second["2024-01-01", 7]
    assert (day["n_points"], day["n_failed"], day["mean"], day["last_angle"], day["step"]) == (3, 1, 2.0, 45.0, 22.5)
    assert second["2024-01-02", 7] == first["2024-01-02", 7] and second["2024-01-04", 8]["n_points"] == 1
    # What had arrived stays as it is; a day without new points keeps its files.
    assert arrived <= files(tmp_path / "out" / "arrived")
    kept = lambda old, part: {f for f in old if "day=2024-01-03" in f} <= files(tmp_path / "out" / part)
    assert kept(points, "points") and kept(profile, "profile")
    assert not {f for f in profile if "day=2024-01-01" in f} & files(tmp_path / "out" / "profile")
    new = spark.read.parquet(f"file://{tmp_path}/out/arrived").where("batch = 1")
    assert new.count() == len(SECOND)
    # One run over everything gives the same, and a third run changes nothing.
    everything = files(tmp_path / "out")
    assert rows(run()) == sorted(map(repr, second.values())) and files(tmp_path / "out") == everything
    whole = series_store.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/other", f"file://{tmp_path}/other-checkpoint", settings("series_store"))
    assert rows(whole) == sorted(map(repr, second.values()))


def test_batch_that_broke_off_is_made_good(spark, store, tmp_path, monkeypatch):
    """A failure between the two tables of a batch: the next run takes the batch again under its number."""
    put, run, _ = store
    put(FIRST)
    run()
    put(SECOND)
    real, calls = series_store.restated, []

    def breaking(df, path):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("lost")
        real(df, path)

    monkeypatch.setattr(series_store, "restated", breaking)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(series_store, "restated", real)
    got = rows(run())
    assert spark.read.parquet(f"file://{tmp_path}/out/arrived").count() == len(FIRST) + len(SECOND)
    whole = series_store.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/other", f"file://{tmp_path}/other-checkpoint", settings("series_store"))
    assert got == rows(whole)


def test_store_of_no_points(store):
    put, run, _ = store
    put([])
    assert run().count() == 0
    put(FIRST[:1])
    assert run().count() == 1


# --- label pools ---------------------------------------------------------------------------------------------------

LONG = "words that are long enough to be kept by the rule on short texts, number "


@pytest.fixture
def corpus(spark, tmp_path):
    docs = [(i, f"{LONG}{i}", "en", f"s{i % 3}", 1, "x") for i in range(200)]
    docs += [(300 + i, f"{LONG}7", "en", "s1", 1, "x") for i in range(100)]  # copies of one text are a third of all rows
    docs += [(500, f"{LONG.upper()} -- 8!", "de", "s2", 1, "x"), (501, None, None, None, None, None), (502, "", "en", "s0", 0, "x"), (None, f"{LONG}9", "en", "s0", 1, "x"), (503, "é" * 60, None, None, 60, None), (10, f"{LONG}10", "en", "s1", 1, "x"), (10, f"{LONG}10", "en", "s1", 1, "x")]
    labels = [(0, 1, 0), (1, None, 1), (7, 1, 0), (300, 0, 0), (301, 1, None), (8, 0, 0), (500, 1, 1), (999, 1, 1), (2, 0, 1), (2, 0, 1), (None, 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, key string").repartition(3).write.parquet(f"file://{tmp_path}/documents")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels")
    return tmp_path


def test_label_pools(spark, corpus):
    run = lambda: label_pools.run(spark, f"file://{corpus}/documents", f"file://{corpus}/labels", f"file://{corpus}/out", settings("label_pools"))
    pool = run()
    got = {r["doc_id"]: r for r in pool.collect()}
    assert len(got) == 202 and not {300, 501, 502, None} & set(got) and got[503]["source"] == "unknown"
    assert got[7]["copies"] == 101 and got[10]["copies"] == 3
    assert (got[7]["quality"], got[7]["m_quality"], got[7]["toxic"]) == (None, 0, 0)  # its copies disagree on one head only
    assert (got[2]["quality"], got[2]["toxic"], got[2]["role"]) == (0, 1, "labelled") and got[3]["role"] == "unlabelled"
    assert got[8]["split"] == got[500]["split"] and (got[8]["quality"], got[500]["quality"]) == (0, 1)
    assert {r["split"] for r in got.values()} == {"train", "val", "test"}
    sizes = [sum(r["fold"] == f for r in got.values()) for f in range(5)]
    assert max(sizes) - min(sizes) <= 1 and all((r["fold"] is None) == (r["split"] != "train") for r in got.values())
    reasons = {r["reason"]: r["count"] for r in spark.read.parquet(f"file://{corpus}/out/index").groupBy("reason").count().collect()}
    assert reasons == {None: 304, "too_short": 2, "no_id": 1}
    summary = spark.read.parquet(f"file://{corpus}/out/summary")
    assert summary.agg(F.sum("rows"), F.sum("copies")).first()[:] == (202, 304)
    assert os.path.isdir(corpus / "out/pool/role=labelled/split=train")
    first = rows(pool)
    assert rows(run()) == first


def test_label_pools_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels")
    assert label_pools.run(spark, f"file://{tmp_path}/documents", f"file://{tmp_path}/labels", f"file://{tmp_path}/out", settings("label_pools")).count() == 0


def test_settings_are_checked(tmp_path):
    (tmp_path / "c.json").write_text('{"folds": 3}')
    assert settings("label_pools", str(tmp_path / "c.json"))["folds"] == 3
    (tmp_path / "c.json").write_text('{"fold": 3}')
    with pytest.raises(ValueError, match="fold"):
        settings("label_pools", str(tmp_path / "c.json"))


@needs_tables
def test_command_lines(tmp_path):
    """Each job as a process of its own, which makes and stops its session."""
    os.makedirs(tmp_path / "in")
    os.symlink(f"{SF}/events.parquet", tmp_path / "in/events.parquet")
    calls = [["jobs.label_pools", "--documents", f"{SF}/documents.parquet", "--labels", f"{SF}/labels.parquet", "--out", f"{tmp_path}/a"], ["jobs.series_store", "--events", f"{tmp_path}/in", "--out", f"{tmp_path}/b", "--checkpoint", f"{tmp_path}/c"]]
    environment = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false --conf spark.checkpoint.dir=file://{tmp_path}/shared pyspark-shell"}
    for call in calls:
        done = subprocess.run([sys.executable, "-m", *call], cwd=REPO, env=environment, capture_output=True, text=True, timeout=600)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "read " in done.stderr and ("wrote " in done.stderr or "holds " in done.stderr)
    assert files(tmp_path / "a/pool") and files(tmp_path / "b/profile")
