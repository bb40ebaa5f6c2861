"""Search, sharding, packing, mixing, near-dedup, fixity and the pipeline against brute force, on messy rows."""

from __future__ import annotations

import os
import random
import time
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from samples import messy_rows, prose
from pyspark.sql import functions as F

from latticeworks.llm import fixity, mixing, neardup, packing, queries, sharding, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_row(rows):
    return sorted(map(repr, rows))


# --- top-k ---------------------------------------------------------------------------------------------------------


def top_brute(rows, k):
    ints = [(i, None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows]
    ints = [(i, v) for i, v in ints if i is not None and v is not None]
    out = []
    for i, q in ints:
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ints if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("shard_rows,scale", [(16_384, 1.0), (40, 1.0), (40, 0.004), (60, 3e5)])
def test_top_k(spark, monkeypatch, shard_rows, scale):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 2)
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=6) * scale).tolist()) for i in range(320)]
    rows[5], rows[6], rows[7], rows[8] = (5, None), (6, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (7, [float("nan")] * 6), (8, [float("inf")] * 6)
    rows += [(None, [0.5] * 6), (300, [1.0, 2.0]), (301, [1.0, 2.0]), (302, []), (310, rows[9][1]), (310, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"uid": F.lit("x"), "shard": F.lit(1)})
    got = topk.top_k(df).collect()
    want = top_brute(rows, 10)
    assert by_row(map(tuple, got)) == by_row(want)


def test_blocks_meet_pages_by_slices(spark, monkeypatch):
    """All vectors have one dimension; blocks of queries and pages of boxes still have many keys to meet by, a few rows each."""
    for name, value in {"SHARD_ROWS": 40, "BLOCK_ROWS": 2, "LEAF_ROWS": 8, "PAGE_SHARDS": 4, "SLICE_BLOCKS": 3}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(0, 3000, 2)]
    joined = []
    real = type(spark.range(0)).join

    def spy(self, other, on=None, how=None):
        if on == ["dim", "page", "slice"]:
            joined.append((self.groupBy(*on).count().agg(F.max("count"), F.count(F.lit(1))).first()[:], other.groupBy(*on).count().agg(F.max("count")).first()[0]))
        return real(self, other, on, how)

    monkeypatch.setattr(type(spark.range(0)), "join", spy)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert by_row(map(tuple, got)) == by_row(top_brute(rows, 10))
    assert len(joined) == 2 and all(most <= 8 and keys >= 12 and pages == 1 for (most, keys), pages in joined)


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- sharding ------------------------------------------------------------------------------------------------------


def check_shards(docs, rows, n):
    got = sharding.with_law(sharding.shard_by_bytes(docs, n)).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert by_row((r.doc_id, r["size"], r.text_crc32) for r in got) == by_row((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    return [load[i] for i in range(n)]


def test_sharding_of_messy_rows(spark, messy, nothing):
    check_shards(messy, [(r[0], r[1]) for r in messy_rows()], 40)
    assert sharding.shard_by_bytes(nothing).count() == 0


def test_sharding_evens_out_hot_texts(spark):
    rng = random.Random(1)
    hot = prose(rng, 50)
    rows = [(i, hot if i % 3 == 0 else prose(rng, rng.randint(5, 80))) for i in range(6000)]
    load = check_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows, 40)
    assert max(load) - min(load) < 0.05 * sum(load) / 40
    small = [(i, f"text {i % 50}") for i in range(500)]
    sharded = sharding.shard_by_bytes(spark.createDataFrame(small, "doc_id long, text string"), 4)
    assert sharded.groupBy("text_crc32").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() <= 3  # only at cuts


def test_sharding_of_equal_rows(spark):
    rows = [(None, "same")] * 900 + [(1, None)] * 100
    load = check_shards(spark.createDataFrame(rows, "doc_id long, text string"), rows, 10)
    assert max(load) - min(load) <= 64


# --- packing -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", [True, False])
def test_packing(spark, messy, keep):
    slow = packing._encoder(*queries.vocabulary())[0]
    more = [(500, "a <|endoftext|> b"), (501, prose(random.Random(5), 60_000)), (502, "x" * 300_000)]
    rows = [(r[0], r[1]) for r in messy_rows()] + more
    docs = messy.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = []
    for d, t in rows:
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        cuts = ([0] if head else []) + list(range(head, len(ids), 1024))
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
            want.append((d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = packing.pack(docs, *queries.vocabulary(), keep_ids=keep).collect()
    assert by_row((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == by_row(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        assert not keep or (len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024


def test_packing_plans(nothing):
    rng = random.Random(1)
    for n in (0, 1, 5, 300, 20_000):
        counts = Counter(min(1024, max(1, int(rng.lognormvariate(5.5, 1)))) for _ in range(n))
        plan = packing.plan(dict(counts), 1024)
        used = Counter()
        for lengths, times in plan:
            assert sum(lengths) <= 1024
            for x in lengths:
                used[x] += times
        assert used == counts
        bins, least = sum(t for _, t in plan), -(-sum(k * v for k, v in counts.items()) // 1024)
        assert bins <= least * 1.02 + 2
    assert packing.pack(nothing, *queries.vocabulary()).count() == 0


def test_both_tokenizers_agree():
    slow, fast = packing._encoder(*queries.vocabulary())
    rng = random.Random(3)
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}1{chr(c)}'s" for c in range(1, 0xD800, 7)]
    texts += ["".join(chr(rng.choice([32, 10, 9, 0x2003, 0x85, 0xA0, 0x41, 0x30, 0x3B1, 0x4E00, 0x1F600, 39])) for _ in range(30)) for _ in range(300)]
    assert all(e.ids == fast.encode_ordinary(t) for e, t in zip(slow.encode_batch(texts, add_special_tokens=False), texts, strict=True))


# --- mixing --------------------------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])
    assert sum(mixing.targets([1, 1, 1000, 0], [5, 2, 1, 5])) == pytest.approx(1002)
    assert mixing.targets([0, 0], [5, 2]) == [0, 0] and mixing.targets([], []) == []


def test_flow_shares_overlapping_sources_at_least_cost():
    # The overlap belongs to both sources; single use of everything is enough, so nothing is repeated.
    got = mixing.flow([((0,), 50), ((1,), 10), ((0, 1), 40)], [60.0, 40.0])
    assert sum(g.get(0, 0) for g in got) == pytest.approx(60) and sum(g.get(1, 0) for g in got) == pytest.approx(40)
    assert [sum(g.values()) for g in got] == pytest.approx([50, 10, 40])
    # Convex costs spread repeats: both patterns twice before one three times.
    got = mixing.flow([((0,), 10), ((0,), 10)], [40.0])
    assert [sum(g.values()) for g in got] == pytest.approx([20, 20])


def test_shares_equal_the_flow_and_take_many_sources():
    rng = random.Random(3)
    patterns = [((i,), rng.randrange(0, 900)) for i in range(12)] + [((0, 1), 300), ((1, 2), 50), ((8, 9, 10), 70)]
    sizes = [sum(n for own, n in patterns if s in own) for s in range(12)]
    quotas = mixing.targets(sizes, [5, 2, 1] * 4, 3, sum(n for _, n in patterns))
    whole = [sum(x.values()) for x in mixing.flow(patterns, quotas)]
    assert sum(mixing.shares(patterns, quotas)) == pytest.approx(sum(whole))
    assert mixing.shares(patterns, quotas)[3:8] == pytest.approx(whole[3:8]) and mixing.shares(patterns, quotas)[11] == pytest.approx(whole[11])
    many = [((i,), 10 + i % 977) for i in range(100_000)]
    start = time.process_time()
    quotas = mixing.targets([n for _, n in many], [(5, 2, 1)[i % 3] for i in range(len(many))])
    given = mixing.shares(many, quotas)
    assert time.process_time() - start < 10 and sum(given) == pytest.approx(sum(n for _, n in many))


def test_every_pattern_of_the_query_goes_through_the_flow(spark, messy, monkeypatch):
    """Single sources too: their words are what the flow routes, part by part."""
    real, seen = mixing.flow, []

    def spy(patterns, quotas, most=mixing.MAX_REPEATS):
        given = real(patterns, quotas, most)
        seen.extend((size, sum(g.values())) for (_, size), g in zip(patterns, given, strict=True))
        return given

    monkeypatch.setattr(mixing, "flow", spy)
    rows = mixing.mix(messy).collect()
    by_source = {}
    for r in rows:
        by_source.setdefault(r.sources[0], []).append(r)
    assert sorted(size for size, _ in seen) == sorted(sum(r["size"] for r in own) for own in by_source.values())
    assert sorted(round(words, 6) for _, words in seen) == sorted(round(own[0].target, 6) for own in by_source.values())
    assert mixing.connected([((0,), 1), ((1, 2), 1), ((), 1), ((2, 4), 1), ((3,), 1), ((4,), 1)], 5) == [[0], [1, 3, 5], [4]]


def test_mix_without_broadcasts(spark, messy, monkeypatch):
    want = by_row(map(tuple, mixing.mix(messy).drop("sources").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert by_row(map(tuple, mixing.mix(messy).drop("sources").collect())) == want


def test_mix(spark, messy, nothing):
    got = mixing.mix(messy, keep_rows=True).collect()
    rows = messy_rows()
    size = lambda t: len(WORD.findall(t or ""))
    by_source = Counter()
    for r in rows:
        by_source[r[3]] += size(r[1])
    names = sorted((s for s in by_source if s is not None)) + ([None] if None in by_source else [])
    want = dict(zip(names, mixing.targets([by_source[s] for s in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))]), strict=True))
    assert by_row((r.doc_id, r["size"], r.source_size) for r in got) == by_row((r[0], size(r[1]), by_source[r[3]]) for r in rows)
    taken = Counter()
    for r in got:
        (source,) = r.sources
        assert r.target == pytest.approx(want[source]) and 0 <= r.taken <= 3 * r["size"] and r.taken == r.repeats * r["size"] and r.row.doc_id == r.doc_id
        taken[source] += r.taken
    largest = {s: max(size(r[1]) for r in rows if r[3] == s) for s in names}
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in names)
    again = mixing.mix(messy.repartition(5)).collect()
    assert by_row((r.doc_id, r.taken) for r in again) == by_row((r.doc_id, r.taken) for r in got)
    assert mixing.mix(nothing).count() == 0


def test_mix_comes_near_on_many_documents(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(1, 60)), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(8000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("sources").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 40 for r in got)


def test_mix_of_overlapping_sources(spark):
    rng = random.Random(3)
    kinds = [["a"], ["b"], ["a", "b"], ["b", "a", "b"], [], None, ["c", None]]
    rows = [(i, prose(rng, rng.randint(20, 60)), kinds[i % len(kinds)]) for i in range(700)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    total = sum(r["size"] for r in got)
    taken = Counter()
    for r in got:
        assert r.taken <= 3 * r["size"] and (r.sources or r.taken == 0)
        taken[tuple(r.sources)] += r.taken
    assert abs(sum(taken.values()) - total) < 0.02 * total and len({tuple(r.sources) for r in got}) == 6


# --- near duplicates -----------------------------------------------------------------------------------------------


def near_brute(rows, n, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            low[root(i)].append(d)
    name = lambda i: min((d for d in low[root(i)] if d is not None), default=None) if sets[i] else rows[i][0]
    return [(rows[i][0], len(sets[i]), name(i)) for i in range(len(rows))]


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates(messy, n, percent):
    got = neardup.near_duplicates(messy, neardup.Similarity(n, percent)).collect()
    assert by_row((r.doc_id, r.n_shingles, r.component_id) for r in got) == by_row(near_brute([(r[0], r[1]) for r in messy_rows()], n, percent))


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A large group of edited copies, with all blocks tiny, keeps exactly the components of all links."""
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 7)
    monkeypatch.setattr(neardup, "CLUSTER_BLOCK", 9)
    monkeypatch.setattr(neardup, "FOREST_IDS", 20)
    rng = random.Random(8)
    base = prose(rng, 160).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, prose(rng, 60)) for i in range(60)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.Similarity(3, 85)).collect()
    assert by_row((r.doc_id, r.n_shingles, r.component_id) for r in got) == by_row(near_brute(rows, 3, 85))


@pytest.mark.parametrize("spread", [2, 9, 30, 64])
def test_leaders_connect_all_near_pairs(spread):
    """Groups around a few centres, tight or wide: the forest has the components of all near pairs."""
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 2**16, (4, neardup.SYMBOLS), dtype=np.uint16)
    sig = centres[rng.integers(0, 4, 300)]
    for x in sig:
        at = rng.choice(neardup.SYMBOLS, rng.integers(0, spread + 1), replace=False)
        x[at] = rng.integers(0, 2**16, len(at), dtype=np.uint16)
    size = rng.integers(80, 120, 300)
    forest, all_pairs = neardup.Forest(), neardup.Forest()
    for a, b in zip(*neardup.near_edges(sig, size, 24, 85), strict=True):
        assert (sig[a] != sig[b]).sum() <= 24 and min(size[a], size[b]) * 100 >= max(size[a], size[b]) * 85
        forest.join(int(a), int(b))
    for a in range(300):
        for b in range(a):
            if (sig[a] != sig[b]).sum() <= 24 and min(size[a], size[b]) * 100 >= max(size[a], size[b]) * 85:
                all_pairs.join(a, b)
    assert [forest.root(x) for x in range(300)] == [all_pairs.root(x) for x in range(300)]


def test_rows_of_a_large_group_are_in_proportion(spark, monkeypatch):
    """Of 20,000 near copies in twenty blocks, each is compared in its own block, and few visit others."""
    dealt = []
    rng = np.random.default_rng(4)
    sig = np.tile(rng.integers(0, 2**16, neardup.SYMBOLS, dtype=np.uint16), (20_000, 1))
    sig[np.arange(20_000), rng.integers(0, neardup.SYMBOLS, 20_000)] = rng.integers(0, 2**16, 20_000)
    sig[:40] = rng.integers(0, 2**16, (40, neardup.SYMBOLS), dtype=np.uint16)  # near nothing
    classes = spark.createDataFrame([(i, 200, x.tobytes()) for i, x in enumerate(sig)], "id long, n_shingles long, sig binary").cache()
    members = classes.selectExpr("1L as key", "id", "int(id % 20) as block", "20 as blocks")

    def edges(df):
        dealt.append(df.count())
        return neardup._near_forest(df, classes, neardup.Similarity(3, 85))

    found = neardup._connected(members, edges, "test")
    comps = neardup.components(classes.select("id"), found)
    assert comps.groupBy("comp").count().count() == 41
    assert sum(dealt) <= 2.1 * 20_000


def test_pigeonhole_covers_every_pair_within_the_distance():
    like = neardup.Similarity(3, 85)
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, 2**16, neardup.SYMBOLS, dtype=np.uint16)
        b = a.copy()
        at = rng.choice(neardup.SYMBOLS, like.distance, replace=False)
        b[at] ^= rng.integers(1, 2**16, like.distance, dtype=np.uint16)
        keys = neardup.bucket_keys(np.stack([a, b]), like.chunks)
        assert (keys[0] == keys[1]).any()


def test_near_duplicates_of_nothing(nothing):
    assert neardup.near_duplicates(nothing).count() == 0


def test_components_of_long_chains(spark):
    ids = spark.range(200)
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 120)] + [(150, 199), (199, 160)], "a long, b long").repartition(4)
    got = {r.id: r.comp for r in neardup.components(ids, links).collect()}
    assert all(got[i] == 0 for i in range(121)) and got[199] == got[160] == got[150] == 150 and got[130] == 130 and len(got) == 200


# --- fixity --------------------------------------------------------------------------------------------------------


def test_audit_finds_exactly_the_corruption(spark, monkeypatch):
    monkeypatch.setattr(fixity, "FILE_RECORDS", 60)
    rng = random.Random(4)
    rows = [(i, f"http://h/{i}", prose(rng, rng.randint(0, 30))) for i in range(400)] + [(None, None, None), (7, "http://h/7", "again"), (7, "http://h/7", "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit("clash"))
    other = [(i, u, t + "x" if i in (3, 77) else t) for i, u, t in rows if i != 200]
    other.remove((7, "http://h/7", "again"))  # one of two equal records is lost
    replica = spark.createDataFrame([*other, (7, "http://h/7", "more"), (999, "u", "extra"), (None, None, "extra")], "page_id long, url string, html string")
    got = fixity.audit(pages, replica).collect()
    assert len(got) == 403 and sorted(r.page_id for r in got if r.corrupt) == [3, 7, 77, 200]
    assert {r.page_id: r.records for r in fixity.extra(pages, replica).collect()} == {999: 1, None: 1}
    ends = defaultdict(list)
    for r in got:
        ends[r.file].append((r.leaf, r.start, r.end))
    for x in ends.values():
        x.sort()
        assert [a for a, _, _ in x] == list(range(len(x))) and x[0][1] == 0 and all(p[2] == q[1] for p, q in zip(x, x[1:], strict=False))
    assert not any(r.corrupt for r in fixity.audit(pages, pages).collect())
    assert all(r.corrupt for r in fixity.audit(pages, pages.limit(0)).collect())


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert fixity.audit(none, none).count() == fixity.extra(none, none).count() == 0
    assert fixity.audit(none, spark.createDataFrame([(1, "u", "h")], none.schema)).count() == 0


def test_descent_reads_only_below_differing_nodes(spark):
    """Of 65,536 leaves under one root and one damaged leaf, each level compares sixteen nodes."""
    leaves = spark.range(1 << 16).select(F.lit(0).cast("long").alias("file"), F.col("id").alias("node"), F.md5(F.col("id").cast("string")).alias("hash"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"))
    other = leaves.withColumn("hash", F.when(F.col("node") == 4711, F.lit("damaged")).otherwise(F.col("hash")))
    one, two = fixity.tree(leaves), fixity.tree(other)
    read = []
    for level in range(4, 0, -1):
        bad = fixity.differing(one[level:], two[level:]).select("file", F.col("node").alias("up"))
        read.append(one[level - 1].withColumn("up", F.floor(F.col("node") / fixity.FANOUT)).join(bad, ["file", "up"], "left_semi").count())
    assert read == [16] * 4
    assert [tuple(r) for r in fixity.differing(one, two).collect()] == [(0, 4711)]


# --- SQL and pipeline ----------------------------------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]
    assert by_row(map(tuple, got.values.tolist())) == by_row(map(tuple, want.values.tolist()))


def test_one_of_each_group_stays_without_usual_ids(spark):
    """Near copies with null ids, with one id for different texts, and with both."""
    stage = pytest.importorskip("corpus_pipeline").keep_one_of_each_group
    rng = random.Random(12)
    a, b, c, alone = (prose(rng, 200) for _ in range(4))
    rows = [(None, a), (None, a + " more"), (None, a + " most"), (5, b), (5, b + " more"), (5, b), (6, b + " most"), (None, c), (9, c + " more"), (7, alone), (None, ""), (8, None)]
    got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    groups = {a[:50]: [None], b[:50]: [5], c[:50]: [9], alone[:50]: [7], "": [None, 8]}
    for start, ids in groups.items():
        assert sorted((r.doc_id for r in got if (r.text or "")[:50] == start), key=str) == sorted(ids, key=str)


def test_pipeline_stages(spark, messy, nothing, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    base = prose(rng, 200)
    rows = [(i, prose(rng, 120), "en", f"s{i % 3}", 1) for i in range(60)] + [(100, base, "en", "s0", 1), (101, base + " more", "en", "s1", 1), (102, base, "en", "s1", 1), (103, "short", "en", "s1", 1), (104, prose(rng, 90) + " token=abcdef0123456789 " + prose(rng, 50), "en", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    (_, q), (_, d), (_, s), (_, m), (_, p) = pipeline.STAGES
    one = q(spark, docs, SF)
    assert one.columns == docs.columns and {r.doc_id for r in docs.subtract(one).collect()} == {103}
    two = d(spark, one, SF)
    assert two.columns == docs.columns and {r.doc_id for r in one.collect()} - {r.doc_id for r in two.collect()} == {101, 102}
    three = s(spark, two, SF)
    assert three.columns == docs.columns and three.count() == two.count() and "abcdef0123456789" not in " ".join(r.text for r in three.collect())
    four = m(spark, three, SF)
    counts = Counter(r.doc_id for r in four.collect())
    assert four.columns == docs.columns and max(counts.values()) <= 3 and set(counts) <= {r.doc_id for r in three.collect()}
    five = p(spark, four, SF)
    assert five.where("piece = 0").count() == four.count()
    for df in (messy, nothing):
        for _, stage in pipeline.STAGES:
            df = stage(spark, df, SF)
        df.count()
