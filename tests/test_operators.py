from __future__ import annotations

import os
import signal
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeworks.functions import crystal as X
from latticeworks.functions import strings as S
from latticeworks.functions.isolated import isolated
from latticeworks.operators.clustering import cluster_values
from latticeworks.operators.folds import group_folds, turns
from latticeworks.operators.metrics import calibrated_threshold, ks_statistic, micro_f1, roc_auc, set_counts
from latticeworks.operators.ranks import percentiles, running_sums, take_by_hash
from latticeworks.operators.relational import assert_disjoint, columns_missing, first_match, keep_one, null_safe_join, one_to_one_left
from latticeworks.schema import SAMPLE, systems
from latticeworks.sources import files
from latticeworks.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_null_keys_join(spark):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k int, a int")
    b = spark.createDataFrame([(None, 10)], "k int, b int")
    assert sorted((r.a, r.b) for r in null_safe_join(a, b, ["k"]).collect()) == [(1, 10), (2, None)]


def test_one_to_one_refuses_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "z")], "k int, b string")
    assert one_to_one_left(b, a.where("a = 'x'"), "k").count() == 1
    with pytest.raises(Exception, match="repeated key"):
        one_to_one_left(a, b, "k").collect()


def test_keep_one_first_match_and_disjoint(spark):
    df = spark.createDataFrame([(1, 3), (1, 2), (2, 5)], "k int, v int")
    assert sorted(r.v for r in keep_one(df, ["k"], [F.asc("v")]).collect()) == [2, 5]
    a = spark.createDataFrame([(1, "a")], "k int, match string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "k int, match string")
    got = {(r.k, r.match, r.method) for r in first_match(df.select("k").distinct(), "k", [("one", a), ("two", b)]).collect()}
    assert got == {(1, "a", "one"), (2, "b", "two")}
    assert columns_missing(df, ["k", "w"]) == (["w"], ["v"])
    with pytest.raises(AssertionError):
        assert_disjoint(df, df, "k")


def test_tolerance_clusters(spark):
    rows = [(1.54050, 1), (1.54056, 9), (1.54060, 1), (1.540598, 1), (1.54439, 4), (None, 3)]
    got = cluster_values(spark.createDataFrame(rows, "v double, w long"), "v", "w", atol=5e-4).collect()
    assert {r.cluster for r in got} == {0, 1} and {r.representative for r in got} == {1.54056, 1.54439}
    assert cluster_values(spark.createDataFrame([], "v double, w long"), "v", "w", 1.0).count() == 0


def test_folds_keep_groups_whole_and_even(spark):
    df = spark.createDataFrame([(g, i) for g in range(13) for i in range(g + 1)], "g int, i int")
    folds = {r.g: r.fold for r in group_folds(df, "g", 5).collect()}
    loads = [sum(g + 1 for g, f in folds.items() if f == k) for k in range(5)]
    assert len(folds) == 13 and max(loads) - min(loads) <= 13


def test_auc_and_ks_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(float(v), bool(s)) for v, s in zip(rng.integers(0, 8, 80), rng.random(80) < 0.4, strict=True)]
    df = spark.createDataFrame(rows, "v double, s boolean")
    pos, neg = [v for v, s in rows if s], [v for v, s in rows if not s]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    ks = max(abs(np.mean([p <= x for p in pos]) - np.mean([n <= x for n in neg])) for x in range(9))
    assert roc_auc(df, "v", F.col("s")).first().auc == pytest.approx(auc)
    assert ks_statistic(df, "v", F.col("s")).first().ks == pytest.approx(ks)


def test_micro_f1_guards(spark):
    df = spark.createDataFrame([([], []), ([], ["a"])], "p array<string>, t array<string>")
    tp, fp, fn = set_counts(F.col("p"), F.col("t"))
    c = df.select(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    assert c.agg(micro_f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f")).first().f == 0


def test_text_functions(spark):
    cell = F.lit("a: 4.2244(9) b: 6.9297(7) alpha: 90 beta: 99.65(1) crystal system: Monoclinic")
    assert one(spark, S.number_field(cell, "beta")) == 99.65 and one(spark, S.number_field(cell, "c")) is None
    assert one(spark, S.number_field(F.lit("alpha: 90"), "a")) is None and one(spark, S.number_field(F.lit("alpha: 90"), "a", anchored=False)) == 90
    assert one(spark, S.word_field(cell, "crystal system")) == "monoclinic"
    assert one(spark, S.tuple_of(F.lit("(1, 2.5, x)"), 3)) is None and one(spark, S.tuple_of(F.lit("(1, 2.5)"), 2)) == [1, 2.5]
    assert one(spark, S.formula_elements(F.lit("Ca2 Xy SiO4 Ca"))) == ["Ca", "Si", "O"]
    assert one(spark, S.symbols(F.lit("P2_1/c | Pnma; C2/c (I2/a), Pnma"))) == ["P2_1/c", "Pnma", "C2/c", "I2/a"]
    assert one(spark, S.canonical_symbol(F.lit("P2_1/c.?"))) == "P21/c"
    assert one(spark, S.plain_name(F.lit("Écran-Ü (x)"))) == "ecranux"
    assert one(spark, S.clean_list(F.array(F.lit("nan"), F.lit(None)))) is None
    assert [one(spark, S.crystal_system(F.lit(n))) for n in (0, 1, 2, 3, 75, 167, 168, 195, 230, 231)] == [None, "triclinic", "triclinic", "monoclinic", "tetragonal", "trigonal", "hexagonal", "cubic", "cubic", None]
    assert {r.system for r in systems(spark).collect()} >= {"cubic"}


def test_physics_expressions(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, X.cell_volume(*lit(2, 3, 4, 90, 90, 90))) == pytest.approx(24)
    assert one(spark, X.bragg(F.lit(2.0), F.lit(0.5))) is None and one(spark, X.bragg(F.lit(1.0), F.lit(1.0))) == pytest.approx(60)
    assert one(spark, X.symop_rotation(F.lit("-x, y-x, z+1/2"))) == [-1, 0, 0, -1, 1, 0, 0, 0, 1]
    assert one(spark, X.march_dollase(F.lit(0.3), F.lit(1.0))) == pytest.approx(1)
    assert one(spark, F.crc32(F.lit("demo:7").cast("binary"))) == __import__("zlib").crc32(b"demo:7")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "p/q").mkdir(parents=True)
    label = '{"xray_info": "{\\"primary_wavelength\\": 1.5}", "phases": ["{\\"spacegroup\\": 14, \\"phase_fraction\\": 0.5}"], "is_simulated": false}'
    import json

    (tmp_path / "p/q/pattern_1.json").write_text(json.dumps({"x": [1, 2], "label": label}))
    (tmp_path / "p/pattern_2.json").write_text("{broken")
    (tmp_path / "p/other.json").write_text("{}")
    got = files.decode_label(files.read_json_tree(spark, str(tmp_path / "p"), "x array<double>, label string", "pattern_*.json")).collect()
    assert len(got) == 1 and got[0].primary_wavelength == 1.5 and got[0].phases[0].spacegroup == 14 and got[0].secondary_wavelength is None
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_json_array(spark, str(tmp_path / "a.json"), "a int").count() == 2
    (tmp_path / "b.csv").write_bytes("﻿name,n\nx,1\n".encode())
    assert files.read_csv(spark, str(tmp_path / "b.csv"), "name string, n int").first() == ("x", 1)
    np.save(tmp_path / "one.npy", np.array([[1.0, 2, 3], [4, 5, 6]]))
    np.save(tmp_path / "two.npy", np.array([[1.0, 4], [2, 5], [3, 6]]))
    (tmp_path / "bad.npy").write_bytes(b"no")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_npy(spark, str(tmp_path)).collect()}
    assert rows["one.npy"].y == rows["two.npy"].y == [4, 5, 6] and rows["bad.npy"].status.startswith("error")
    out = str(tmp_path / "t")
    files.write_table(spark.range(10), out, rows_per_file=4)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        files.write_table(spark.range(3), out)
    files.write_table(spark.range(3), out, force=True)
    assert files.read_parquet(spark, out, ["id"]).count() == 3
    some = {r.id for r in files.sampled_buckets(spark.range(1000), F.col("id"), 10, 3).collect()}
    assert some == {r.id for r in files.sampled_buckets(spark.range(1000).repartition(7), F.col("id"), 10, 3).collect()} and 200 < len(some) < 400
    assert '"config_hash"' in one(spark, files.manifest({"a": 1}))
    assert len(SAMPLE) == 31


def test_stream_append_resume_and_retries(spark, tmp_path):
    rows = spark.sql("select id as event_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id) as ts, if(id % 2 = 0, 'a', 'b') as event_type from range(48)")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        incremental.append_batches(incremental.event_stream(spark, str(tmp_path / "in"), max_files=1), str(tmp_path / "out"), str(tmp_path / "check"), "event_id")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 48
    assert incremental.resume(rows, rows.where("event_id < 40"), "event_id").count() == 8
    old = spark.createDataFrame([(1, "x", True), (2, "y", False)], "k int, v string, failed boolean")
    new = spark.createDataFrame([(1, "z", False), (2, "q", False)], "k int, v string, failed boolean")
    merged = incremental.merge_retries(old, new, "k", "failed")
    assert sorted(map(tuple, merged.collect())) == [(1, "z", False), (2, "y", False)]
    assert sorted(map(tuple, incremental.merge_retries(merged, new, "k", "failed").collect())) == [(1, "z", False), (2, "y", False)]


def test_database_matrix_log_and_id_cache(spark, tmp_path):
    import sqlite3

    place = str(tmp_path / "s.db")
    with sqlite3.connect(place) as db:
        db.execute("create table cells (id text, a real, n integer)")
        db.executemany("insert into cells values (?, ?, ?)", [(f"s{i}", i / 2, None if i == 3 else i) for i in range(100)])
        db.execute("create table none (id text)")
    cells = files.read_sqlite(spark, place, "cells", "id string, a double, n long", 7)
    assert cells.count() == 100 and cells.where("n is null").first().id == "s3"
    assert files.read_sqlite(spark, place, "none", "id string").count() == 0
    asked = spark.createDataFrame([("s4",), ("s4",), ("other",), (None,)], "id string")
    assert [tuple(r) for r in files.lookup(cells, asked, "id").collect()] == [("s4", 2.0, 4)]

    np.arange(12, dtype=np.float32).reshape(4, 3).tofile(tmp_path / "m.bin")
    rows = files.matrix_rows(spark.createDataFrame([(2, "x"), (9, "y"), (None, "z")], "row_idx long, k string"), str(tmp_path / "m.bin"), 3).collect()
    assert {r.k: r["values"] for r in rows} == {"x": [6.0, 7.0, 8.0], "y": None, "z": None}

    log, todo = str(tmp_path / "log"), spark.range(10)
    files.log_progress(todo.where("id < 4"), log, "id", F.when(F.col("id") < 2, F.concat(F.lit("big:"), F.col("id").cast("string"))))
    files.log_progress(todo.where("id = 5"), log, "id", F.lit("short"))
    seen = spark.read.parquet(log)
    assert sorted(r.id for r in files.still_to_do(todo, seen, "id").collect()) == [4, 6, 7, 8, 9]
    assert {tuple(r) for r in files.skip_reasons(seen).collect()} == {("big", 2), ("short", 1)}

    ids = str(tmp_path / "ids")
    assert files.cached_ids(spark.range(5), ids, "id").count() == 5
    assert files.cached_ids(spark.range(99), ids, "id").count() == 5


def test_turns_equal_the_sequential_rule():
    import random

    rng = random.Random(1)
    for _ in range(400):
        k = rng.randint(1, 6)
        loads = [rng.randint(0, 40) for _ in range(k)]
        plain, size, n = list(loads), rng.randint(1, 9), rng.randint(1, 60)
        want = []
        for _ in range(n):
            f = plain.index(min(plain))
            want.append(f)
            plain[f] += size
        runs = turns(loads, size, n)
        got = [folds[(i - first) % len(folds)] for (first, folds), end in zip(runs, [*(a for a, _ in runs[1:]), n], strict=True) for i in range(first, end)]
        assert got == want and loads == plain
    loads = [0, 10**12, 5]
    assert len(turns(loads, 1, 10**12)) < 20  # no loop over groups


def test_percentiles_equal_those_of_the_whole_table(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 900), rng.integers(0, 200, 900), strict=True)] + [(0, None), (7, 1.5), (8, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    for keys in ([], ["k"]):
        got = {tuple(r[c] for c in keys): (r.a, r.b, r.c) for r in percentiles(df, "v", {"a": 0.0, "b": 0.37, "c": 0.995}, keys).collect()}
        groups = {}
        for k, v in rows:
            if v is not None:
                groups.setdefault((k,) if keys else (), []).append(v)
        assert set(got) == set(groups)
        for g, v in groups.items():
            assert got[g] == pytest.approx(tuple(np.percentile(v, [0, 37, 99.5])))
    assert [r.a for r in percentiles(df.where("k > 99"), "v", {"a": 0.5}).collect()] == [None]


def test_stream_keeps_the_last_state_of_each_key(spark, tmp_path):
    rows = spark.sql("select id as event_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id) as ts, 'a' as event_type from range(72)")
    for n in range(3):  # three files in order of time, each a batch of its own
        rows.where(f"event_id between {n * 24 - 6} and {n * 24 + 17}").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{n}"))
    stream = incremental.event_stream(spark, str(tmp_path / "in" / "*"), max_files=1)
    got = incremental.latest(incremental.windowed_counts(stream, delay="2 days"), ["start", "event_type"], str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.n for r in got.collect()) == [18, 24, 24]
    assert len(list((tmp_path / "out").glob("batch=*"))) >= 3


def test_calibrated_threshold_and_its_fallback(spark):
    marks = [0.5 + 0.1 * i for i in range(5)]
    rows = [(i / 1000, i >= 720 or i % 3 == 0) for i in range(1000)] + [(None, True)]
    df = spark.createDataFrame(rows, "p double, right boolean")
    first = next(t for t in marks if (lambda xs: sum(xs) / max(len(xs), 1))([r for p, r in rows if p is not None and p > t]) >= 0.9)
    got = calibrated_threshold(df, "p", F.col("right"), 0.9, 0.85, marks).first()
    assert got.threshold == first and got.precision >= 0.9 and not got.is_fallback
    none = calibrated_threshold(df.withColumn("right", F.lit(False)), "p", F.col("right"), 0.9, 0.85, marks).first()
    assert (none.threshold, none.precision, none.is_fallback) == (0.85, None, True)
    assert calibrated_threshold(df.limit(0), "p", F.col("right"), 0.9, 0.85, marks).first().is_fallback


def test_plain_names_are_decomposed(spark):
    import unicodedata

    names = ["Écran-Ü (x)", "Žižka ŁÓDŹ", "ﬁve ﬂoors Ⅷ", "Ａｂｃ１２", "x² + H₂O", "ǅ ǆ", "𝔸𝒷𝕔 𝟙", "ｶﾞ µ ß ø æ", "İstanbul", "", "plain name 7", "e\u0301a\u0308", "Ångström \u212b", "½ ¼", "№ ㎏"]
    got = [r.v for r in spark.createDataFrame(list(enumerate(names)), "i int, n string").orderBy("i").select(S.plain_name(F.col("n")).alias("v")).collect()]
    assert got == ["".join(c for c in unicodedata.normalize("NFKD", n).lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789") for n in names]
    assert spark.range(1).select(S.plain_name(F.lit(None).cast("string")).alias("v")).first().v is None


def test_null_keys_are_a_key(spark):
    rows = [(k, float(v), i) for i, (k, v) in enumerate([(None, 3), (None, 1), ("a", 2), ("a", 8), (None, 5), ("b", 4)])]
    df = spark.createDataFrame(rows, "k string, v double, i int")
    assert {r.i: r.s for r in running_sums(df, "v", {"s": F.lit(1)}, ["k"]).collect()} == {1: 1, 0: 2, 4: 3, 2: 1, 3: 2, 5: 1}
    assert {r.k: r.m for r in percentiles(df, "v", {"m": 0.5}, ["k"]).collect()} == {None: 3.0, "a": 5.0, "b": 4.0}
    taken = take_by_hash(df.withColumn("d", F.md5(F.col("i").cast("string"))), "d", ["i"], lambda n: F.least(n, F.lit(1)), ["k"])
    assert taken.count() == 6 and sorted(str(r.k) for r in taken.where("taken").collect()) == ["None", "a", "b"]
    assert {r.k: r.n1 for r in ks_statistic(df, "v", F.col("i") % 2 == 0, "k").collect()} == {None: 2, "a": 1, "b": 0}


def test_only_the_row_at_fault_is_lost(spark):
    def f(row):
        if row["i"] in (0, 7, 8, 39):
            os.kill(os.getpid(), signal.SIGKILL)
        return {"square": [row["i"] ** 2] * 2} if row["i"] != 3 else {"square": [1 // 0]}

    got = {r.i: (r.value and r.value.square, r.status) for r in isolated(spark.range(40).selectExpr("cast(id as int) as i").repartition(2), f, "i", "struct<square:array<long>>").collect()}
    assert got == {i: (None, "died") if i in (0, 7, 8, 39) else (None, "error:ZeroDivisionError") if i == 3 else ([i * i] * 2, "ok") for i in range(40)}
    assert isolated(spark.range(0), lambda row: 1, "id", "long").count() == 0


def test_row_seeds(spark):
    df = spark.createDataFrame([("src", 12), (None, 5), ("é", None)], "s string, i long")
    got = [(r.a, r.b) for r in df.select(S.row_seed("s", "i").alias("a"), S.row_seed("s", "i", second=True).alias("b")).collect()]
    want = [zlib.crc32(x.encode()) for x in ("src:12", "5", "é")]
    assert got == [(x, x ^ 0x9E3779B9) for x in want]
