"""Peaks as plans against the definitions, written out on arrays."""

from __future__ import annotations

import random

import pytest

from latticeworks.operators import peaks as P


def maxima(y):
    out, i = [], 1
    while i < len(y) - 1:
        j = i
        while j < len(y) - 1 and y[j + 1] == y[i]:
            j += 1
        if j < len(y) - 1 and y[i - 1] < y[i] > y[j + 1]:
            out.append((i + j) // 2)
        i = j + 1
    return out


def described(y, least, distance):
    """(place, prominence, width) by walking from each peak."""
    kept = []
    for p in sorted(maxima(y), key=lambda p: (-y[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        lows = []
        for step in (-1, 1):
            i, low = p, y[p]
            while 0 <= i < len(y) and y[i] <= y[p]:
                low, i = min(low, y[i]), i + step
            lows.append(low)
        height = y[p] - max(lows)
        if height < least:
            continue
        line, ends = y[p] - height * 0.5, []
        for step in (-1, 1):
            i = p
            while y[i] > line:
                i += step
            ends.append(i - step * (line - y[i]) / (y[i - step] - y[i]) if y[i] < line else i)
        out.append((p, height, ends[1] - ends[0]))
    return out


def series():
    rng = random.Random(1)
    out = [[rng.choice([0.0, 1.0, 2.0, 3.0, 3.0]) for _ in range(rng.randint(1, 90))] for _ in range(12)]
    out += [[rng.gauss(0, 1) for _ in range(300)], [float(x) for x in range(150)] + [float(x) for x in range(150, 0, -1)], [float(i % 2) for i in range(120)], [float((i % 2) * i) for i in range(140)]]
    return out + [[1.0], [], [2.0] * 50, [0.0, 5.0, 5.0, 5.0, 5.0, 0.0], [(i % 7) * 1.0 + (i // 60) for i in range(260)]]


@pytest.mark.parametrize("size,least,distance", [(256, 0.0, 1), (4, 0.0, 1), (4, 1.5, 3), (16, 0.5, 5)])
def test_peaks_against_the_definition(spark, monkeypatch, size, least, distance):
    """With small blocks the searches climb several levels."""
    monkeypatch.setattr(P, "BLOCK", size)
    every = series()
    rows = [(s, i + 1, v) for s, y in enumerate(every) for i, v in enumerate(y)] + [(None, 1, 1.0), (99, 1, None), (99, 2, 5.0)]
    random.Random(2).shuffle(rows)
    points = spark.createDataFrame(rows, "s int, i long, y double").repartition(5)
    got = sorted((r.s, r.i - 1, round(r.prominence, 9), round(r.width, 9)) for r in P.find_peaks(points.where("s is not null"), least, distance).collect())
    want = sorted((s, p, round(h, 9), round(w, 9)) for s, y in enumerate(every) for p, h, w in described(y, least, distance))
    assert got == want
    if size == 4:
        assert len(P.blocks(points)) >= 4


def test_no_block_holds_a_series(spark):
    points = spark.range(70_000).selectExpr("'one' as s", "id as i", "cast(xxhash64(id) % 1000 as double) as y")
    levels = P.blocks(points)
    assert len(levels) == 3 and all(level.selectExpr("max(size(es)) as n").first().n <= P.BLOCK for level in levels)


def test_peaks_of_nothing(spark):
    assert P.find_peaks(spark.createDataFrame([], "s int, i long, y double"), 0.1, 3).count() == 0
