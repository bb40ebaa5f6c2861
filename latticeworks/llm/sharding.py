"""Sharding by sampled splitters, in DataFrame operations only.

Law ``bytes``: records are put in the order of a composite key (hash of the text, hash of the record), which keeps
equal texts side by side. A size-weighted sample of keys gives quantile boundaries; records are range-partitioned by
them, ranges that turn out overfull are subdivided on the second part of the key, exact range sizes give every record
its place in the byte order, and 40 equal cuts of that order are the shards.

Scale: texts are read once and never shuffled; what moves is about 50 bytes a record. The sample and the boundaries
are bounded by ``max_ranges``, whatever the input. No window covers more than one range, and a text that fills many
ranges (a hot group of copies) is spread over them. A group of equal texts stays in one shard unless a cut of the byte
order falls into it and the group holds more than 1/64 of a shard.

Defined results: a null text has size 16 and crc32 0, like an empty one; null or repeated ``doc_id`` rows are records
of their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeworks.llm._store import materialize

OVERHEAD = 16
#: Ranges for each shard, and at most in all; records aimed at in a range.
RANGES_PER_SHARD, MAX_RANGES, RANGE_ROWS = 8, 16_384, 20_000
#: Draws for each range, on average.
DRAWS = 16
_LOW = -(2**63)


def _records(docs: DataFrame) -> DataFrame:
    """One row a record without its text: doc_id, size, crc, composite key (k1, k2) and a row number that makes k2 differ on repeated rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("crc"),
        F.xxhash64(text).alias("k1"),
        F.monotonically_increasing_id().alias("uid"),
    ).withColumn("k2", F.xxhash64("doc_id", "uid"))


def _unit(*columns: str) -> Column:
    """A number in [0, 1) that the columns and a seed decide."""
    return F.pmod(F.xxhash64(*columns, F.lit(20_240_601)), F.lit(1 << 40)).cast("double") / float(1 << 40)


def boundaries(records: DataFrame, total: int, n_ranges: int) -> list[tuple[int, int]]:
    """Lower bounds of all ranges but the first, by quantiles of a size-weighted sample.

    A record is drawn if its unit number is under its share of the draws. A key that only one boundary falls on keeps
    its records together: its boundary starts at the key itself. A key with several boundaries, a hot group, gets
    ranges of its own that its second key divides.
    """
    chance = F.col("size").cast("double") * float(n_ranges * DRAWS) / float(max(total, 1))
    drawn = records.where(_unit("k1", "k2") < chance).select("k1", "k2", F.greatest(chance, F.lit(1.0)).alias("w"))
    sample = sorted((r.k1, r.k2, r.w) for r in drawn.collect())  # n_ranges * DRAWS on average, whatever the input
    weight = sum(w for _, _, w in sample)
    cuts, seen = [], 0.0
    for k1, k2, w in sample:
        if len(cuts) + 1 < n_ranges and seen + w >= weight * (len(cuts) + 1) / n_ranges:
            cuts.append((k1, k2))
        seen += w
    hot = {k for k, n in Counter(k for k, _ in cuts).items() if n > 1}
    out = {(k1, k2) if k1 in hot else (k1, _LOW) for k1, k2 in cuts}
    for k in hot:
        out |= {(k, _LOW)} | ({(k + 1, _LOW)} if k < 2**63 - 1 else set())
    return sorted(out)


def _with_range(records: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Adds ``r``, the number of bounds at or below the record's key.

    Bounds are grouped by the top bits of k1, so that each record is compared with the few bounds of its own slice.
    The table of slices has 2 ** bits rows and holds each bound once: its size is bounded by MAX_RANGES.
    """
    spark = records.sparkSession
    bits = min(12, max(1, len(bounds).bit_length()))
    per: dict[int, list[tuple[int, int]]] = {}
    for b in bounds:
        per.setdefault(b[0] >> (64 - bits), []).append(b)
    rows, before = [], 0
    for s in range(-(1 << (bits - 1)), 1 << (bits - 1)):
        own = per.get(s, [])
        rows.append((s, before, own))
        before += len(own)
    slices = spark.createDataFrame(rows, "s long, before long, own array<struct<a:long,b:long>>")
    below = F.filter("own", lambda x: (x["a"] < F.col("k1")) | ((x["a"] == F.col("k1")) & (x["b"] <= F.col("k2"))))
    return records.withColumn("s", F.shiftright("k1", 64 - bits)).join(F.broadcast(slices), "s").withColumn("r", F.col("before") + F.size(below)).drop("s", "before", "own")


def _sizes(ranged: DataFrame, keys: list[str]) -> DataFrame:
    return ranged.groupBy(*keys).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def shard_by_bytes(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every record; shards hold equal bytes up to about a record."""
    spark = docs.sparkSession
    records = materialize(_records(docs), "shard-records")
    total, rows = records.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    n_ranges = min(MAX_RANGES, max(n_shards * RANGES_PER_SHARD, rows // RANGE_ROWS))
    bounds = boundaries(records, total, n_ranges)
    ranged = _with_range(records, bounds)
    # Overfull ranges are cut again into equal slices: of the second key where a range is one text, else of the first.
    goal = max(1, total // n_ranges)
    pieces = {x.r: min(4096, -(-x.bytes // goal)) for x in _sizes(ranged, ["r"]).where(F.col("bytes") > 3 * goal).collect()}
    table = []
    for r, n in pieces.items():
        low, high = bounds[r - 1][0] if r else _LOW, bounds[r][0] if r < len(bounds) else 2**63 - 1
        table.append((r, n, low, float(max(1, high - low)), high - low <= 1))
    table = spark.createDataFrame(table, "r long, n long, low long, width double, lone boolean")
    share = F.when(F.col("lone"), F.shiftrightunsigned("k2", 32).cast("double") / float(1 << 32)).otherwise((F.col("k1").cast("double") - F.col("low").cast("double")) / F.col("width"))
    cut = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor(share * F.col("n")))))
    ranged = ranged.join(F.broadcast(table), "r", "left").withColumn("p", cut.cast("long")).drop("n", "low", "width", "lone")

    # Exact starts of all ranges: a table of at most MAX_RANGES rows and their subdivisions.
    at_rows, at_bytes = 0, 0
    starts = []
    for x in sorted(_sizes(ranged, ["r", "p"]).collect(), key=lambda x: (x.r, x.p)):
        starts.append((x.r, x.p, at_bytes, at_rows))
        at_bytes, at_rows = at_bytes + x.bytes, at_rows + x.rows
    starts = F.broadcast(spark.createDataFrame(starts, "r long, p long, byte0 long, row0 long"))

    own = Window.partitionBy("r", "p").orderBy("k1", "k2", "uid")
    group = Window.partitionBy("r", "p", "k1")
    placed = ranged.join(starts, ["r", "p"]).withColumns({"start": F.col("byte0") + F.sum("size").over(own) - F.col("size"), "place": F.col("row0") + F.row_number().over(own) - 1})
    placed = placed.withColumns({"g0": F.min("start").over(group), "g": F.sum("size").over(group)})
    small = F.col("g") * 64 * n_shards <= F.lit(total)
    middle = F.when(small, F.col("g0") * 2 + F.col("g")).otherwise(F.col("start") * 2 + F.col("size"))
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle.cast("double") * n_shards / float(2 * max(total, 1)))).cast("int"))
    placed = materialize(placed.select("doc_id", "size", "crc", "shard", "place"), "shard-places")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    # Places rise with shards, so a record's slot is its distance from the first place of its shard: 40 rows to broadcast.
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("first")).alias("slot"))


def with_law(sharded: DataFrame) -> DataFrame:
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
