"""Importance resampling against a plain computation from its definition, and its merge against sorting."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from samples import messy_rows

from latticeworks.llm import resample
from latticeworks.llm.resample import Draw

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets_of(text, draw):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % draw.buckets for n in range(1, draw.run + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, draw):
    """Rows are (doc_id, text): (doc_id, n_features, weight, score, rank), in order of rank."""
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(buckets_of(text, draw))
    for text in target:
        t.update(buckets_of(text, draw))
    k, all_s, all_t = draw.buckets, sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in rows:
        found = buckets_of(text, draw)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (all_s + k) / ((s[b] + 1.0) * (all_t + k)))) for b in found)
        h = int(hashlib.sha256(f"{draw.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    enough = sorted((r for r in out if r[5] >= draw.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(enough[: len(enough) * draw.percent // 100]):
        row[4] = rank + 1
    return [tuple(r[:5]) for r in out]


def ordered(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


TARGET = ["la la Ab cd", "abc éñ dd 12", None, ""]


@pytest.mark.parametrize("draw", [Draw(), Draw(percent=50, buckets=97), Draw(percent=100, least_words=1), Draw(run=3, percent=40, seed=7)])
def test_against_definition(spark, messy, draw):
    target = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TARGET)], "item_id long, text string, score int")
    got = resample.resample(messy.withColumnsRenamed({"size": "weight", "bucket": "score"}), target, draw).collect()
    assert ordered(got) == ordered(brute([r[:2] for r in messy_rows()], TARGET, draw))


def test_many_runs_ranges_and_copies(spark, monkeypatch):
    """Short blocks, many ranges, one row a third of all, and ties of all kinds."""
    monkeypatch.setattr(resample, "BLOCK_ROWS", 3)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "cd", "12", "é", "xyz"]) for _ in range(rng.randint(15, 60))) for _ in range(900)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 900 + [(None, texts[8])] * 90 + [(9, t) for t in texts[:60]]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(11)
    target = spark.createDataFrame([("ab ab 12",)], "text string")
    for percent in (30, 70):
        draw = Draw(percent=percent, buckets=1000)
        assert ordered(resample.resample(docs, target, draw).collect()) == ordered(brute(rows, ["ab ab 12"], draw))


def test_empty_tables(spark, nothing, messy):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(nothing, none).count() == 0
    got = resample.resample(messy, none, Draw(percent=30)).collect()
    assert ordered(got) == ordered(brute([r[:2] for r in messy_rows()], [], Draw(percent=30)))


def test_very_long_texts(spark):
    rows = [(1, "word " * 300_000), (2, "é" * 2_000_000), (3, "a b " * 40), (4, "A B " * 41)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    draw = Draw(percent=50)
    got = resample.resample(docs, spark.createDataFrame([("a b",)], "text string"), draw).collect()
    assert ordered(got) == ordered(brute(rows, ["a b"], draw))


def test_merge_is_sorting_until_the_quota():
    rng = random.Random(1)
    for quota in (0, 1, 37, 200, 10_000):
        runs = [sorted(((rng.choice([None, *range(40)]), 1, 1, rng.randint(0, 60), rng.randint(1, 3)) for _ in range(rng.randint(1, 60))), key=resample._order) for _ in range(rng.randint(1, 9))]
        blocks = [(n, run[i : i + 4]) for n, run in enumerate(runs) for i in range(0, len(run), 4)]
        blocks.sort(key=lambda b: resample._order(b[1][0]))
        got = [row for part in resample.merged(iter(blocks), quota) for row in part]
        want = sorted((row for run in runs for row in run), key=resample._order)
        assert sorted(map(repr, got)) == sorted(map(repr, want))
        before = 0
        for a, b in zip(got, want, strict=True):
            if before >= quota:
                break
            assert resample._order(a) == resample._order(b)
            before += a[4]
