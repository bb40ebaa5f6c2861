"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Each pattern offers its words once
at no cost, a second time at cost 1, a third time at cost 3: convex, so that nothing is repeated before everything in
reach was used. Successive shortest paths route this capacity to the sources' quotas, in each connected part of the
graph of patterns and sources by itself. A pattern's flow is then turned into documents: whole repetitions for all of
them, and a seeded choice for the rest.

Scale: one pass over the texts that keeps a few numbers a document; the graph has a node for each pattern and source,
not for documents, and its parts are as small as sources are apart; the driver holds a row a pattern, and the plan is broadcast only if small. The choice compares seeded hashes: sums over hash buckets say which bucket the limit falls in, and
only that bucket's few thousand documents are looked at one by one. No source, however large, meets in one task.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are
taken 0 words; null or repeated ``doc_id`` rows are documents of their own; of repeated rows, which have equal hashes, any
may be the ones taken once more; texts of any length are counted whole; extra columns are ignored, or come along in
``row``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticeworks.llm._store import materialize
from latticeworks.llm._text import text_slices, words_of

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Documents of a source expected in a hash bucket.
BUCKET_ROWS = 2048
#: Patterns whose plan is broadcast.
BROADCAST_ROWS = 10_000


def targets(sizes: list[int], weights: list[float], most: int = MAX_REPEATS, total: int | None = None) -> list[float]:
    """Shares of the total (the sum of sizes, if not given) by weight; a share stops at ``most`` times its size and the excess is shared anew among the others, until none is above."""
    out = [0.0] * len(sizes)
    open_, rest = list(range(len(sizes))), float(sum(sizes) if total is None else total)
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * unit > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = float(most * sizes[i])
            rest -= out[i]
        open_ = [i for i in open_ if i not in full]
    return out


def flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[float], most: int = MAX_REPEATS) -> list[dict[int, float]]:
    """Words that each pattern gives to each of its sources: a flow of least cost among those that fill most quota.

    Successive shortest paths on residual arcs. Costs are small integers, one for each repetition, so distances are
    found by Dijkstra's method with potentials; each path empties an arc or a quota.
    """
    n, m = len(patterns), len(quotas)
    arcs: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, r: float, c: int) -> None:
        for x, y, q, w in ((a, b, r, c), (b, a, 0.0, -c)):
            arcs[x].append(len(to))
            to.append(y)
            room.append(q)
            cost.append(w)

    source, sink = n + m, n + m + 1
    for i, (members, size) in enumerate(patterns):
        for k in range(most):
            arc(source, i, float(size), k * (k + 1) // 2)
        for s in members:
            arc(i, n + s, float(most * size), 0)
    for s, q in enumerate(quotas):
        arc(n + s, sink, q, 0)
    potential = [0] * (n + m + 2)
    eps = 1e-9 * max(1.0, sum(quotas))
    while True:
        best: dict[int, int] = {source: 0}
        via: dict[int, int] = {}
        heap = [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > best[a]:
                continue
            for e in arcs[a]:
                if room[e] > eps and (x := d + cost[e] + potential[a] - potential[to[e]]) < best.get(to[e], 1 << 60):
                    best[to[e]], via[to[e]] = x, e
                    heapq.heappush(heap, (x, to[e]))
        if sink not in best:
            break
        for a in range(len(potential)):
            potential[a] += best.get(a, best[sink])
        path, a = [], sink
        while a != source:
            path.append(via[a])
            a = to[via[a] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    return [{to[e] - n: room[e ^ 1] for e in arcs[i] if e % 2 == 0 and room[e ^ 1] > eps} for i in range(n)]


def connected(patterns: list[tuple[tuple[int, ...], int]], sources: int) -> list[list[int]]:
    """Patterns that share sources, directly or through others, as lists of their numbers; those of no source are left out."""
    up = list(range(sources))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for members, _ in patterns:
        for s in members[1:]:
            up[top(s)] = top(members[0])
    out: dict[int, list[int]] = {}
    for i, (members, _) in enumerate(patterns):
        if members:
            out.setdefault(top(members[0]), []).append(i)
    return list(out.values())


def shares(patterns: list[tuple[tuple[int, ...], int]], quotas: list[float], most: int = MAX_REPEATS) -> list[float]:
    """Words that each pattern gives in all: a flow of least cost over all patterns. Parts of the graph that share no source have nothing to do with one another, so each is solved by itself; where no document has two sources a part is one pattern and its quota."""
    out = [0.0] * len(patterns)
    for part in connected(patterns, len(quotas)):
        names = sorted({s for i in part for s in patterns[i][0]})
        number = {s: k for k, s in enumerate(names)}
        given = flow([(tuple(number[s] for s in patterns[i][0]), patterns[i][1]) for i in part], [quotas[s] for s in names], most)
        for i, words in zip(part, given, strict=True):
            out[i] = sum(words.values())
    return out


def sizes_of(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``size``, the number of words; the text is dropped."""
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("size", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sizes = pa.array(words_of(batch.column("text")).counts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), sizes], names=[*keep, "size"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def _small(table: DataFrame, rows: int) -> DataFrame:
    """The table, to be broadcast if it has BROADCAST_ROWS or less; else the optimizer chooses by its size."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _choose(sized: DataFrame, rest: list[tuple[int, float]], rows: dict[int, int], seed: int) -> DataFrame:
    """Adds ``extra``: 1 for documents chosen so that each pattern's chosen sizes come near its rest, else 0.

    Documents in buckets of hashed ids below the limit's bucket are chosen, those above aren't; inside the limit's
    bucket they are taken in hash order as long as they fit, and one more if that comes nearer.
    """
    spark = sized.sparkSession
    wanted = spark.createDataFrame([(p, r, max(1, rows[p] // BUCKET_ROWS)) for p, r in rest if r > 0], "pattern int, rest double, buckets long")
    keyed = sized.join(_small(wanted, len(rest)), "pattern", "left").withColumn("h", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(1 << 40)))
    keyed = keyed.withColumn("bucket", F.when(F.col("rest").isNotNull(), F.floor(F.col("h").cast("double") / float(1 << 40) * F.col("buckets"))).cast("long"))
    upto = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = keyed.where("bucket is not null").groupBy("pattern", "bucket", "rest").agg(F.sum("size").alias("size")).withColumn("seen", F.sum("size").over(upto))
    limit = sums.where("seen > rest and seen - size <= rest").select("pattern", F.col("bucket").alias("at"), (F.col("rest") - F.col("seen") + F.col("size")).alias("gap"))
    keyed = keyed.join(_small(limit, len(rest)), "pattern", "left")  # a row for each pattern at most
    below = F.col("bucket").isNotNull() & (F.col("at").isNull() | (F.col("bucket") < F.col("at")))
    sure = keyed.where("at is null or bucket is null or bucket <> at").withColumn("extra", below.cast("int"))

    base = sized.columns
    schema = T.StructType([*sized.schema.fields, T.StructField("extra", T.IntegerType())])

    def fill(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [("h", "ascending"), ("size", "ascending")]))
        sizes, gap = group.column("size").to_pylist(), group.column("gap")[0].as_py()
        extra = []
        for s in sizes:
            extra.append(int(s <= gap))
            gap -= s * extra[-1]
        left = [(abs(s - gap), i) for i, s in enumerate(sizes) if not extra[i] and s < 2 * gap]
        if left:
            extra[min(left)[1]] = 1
        return group.select(base).append_column("extra", pa.array(extra, pa.int32()))

    edge = keyed.where("bucket = at").groupBy("pattern").applyInArrow(fill, schema)
    return sure.select(*base, "extra").unionByName(edge)


def _members(docs: DataFrame, source: str) -> Column:
    """The sources of a row as a sorted array without repeats: one for a plain column, any number for an array column."""
    if isinstance(docs.schema[source].dataType, T.ArrayType):
        return F.array_sort(F.array_distinct(F.coalesce(F.col(source).cast("array<string>"), F.array(F.lit(None).cast("string")))))
    return F.array(F.col(source).cast("string"))


def _in_order(name: str | None) -> tuple[bool, bytes]:
    """Code point order, null last."""
    return name is None, (name or "").encode("utf-32-be", "surrogatepass")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_REPEATS, seed: int = 20_240_602, keep_rows: bool = False, source: str = "source") -> DataFrame:
    """doc_id, sources, size, source_size, target, taken and repeats of every document: taken is its size times its repeats.

    ``source`` names a column with one source, or an array of those that a document belongs to; source_size and target
    are those of the first. With ``keep_rows`` the whole input row comes along as the struct ``row``.
    """
    spark = docs.sparkSession
    doc_id, members = F.col("doc_id").cast("long"), _members(docs, source)
    rows_kept = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if keep_rows else []
    base = docs.select(doc_id.alias("doc_id"), members.alias("sources"), F.to_json(members).alias("own"), "text", F.xxhash64(doc_id, F.to_json(members), "text").alias("uid"), *rows_kept)
    sized = materialize(sizes_of(base, ["doc_id", "sources", "own", "uid", *(["row"] if keep_rows else [])]), "mix-sizes")
    # One row for each membership pattern: what the flow works on.
    found = sized.groupBy("own").agg(F.first("sources").alias("sources"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    found.sort(key=lambda x: x.own)
    names = sorted({s for x in found for s in x.sources}, key=_in_order)
    number = {s: i for i, s in enumerate(names)}
    patterns = [(tuple(number[s] for s in x.sources), x["size"] or 0) for x in found]
    sizes = [0] * len(names)
    for own, n in patterns:
        for s in own:
            sizes[s] += n
    quotas = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(names))], most, sum(n for _, n in patterns))
    given = shares(patterns, quotas, most)
    plan, rest, rows = [], [], {}
    for i, x in enumerate(found):
        words, (own, size) = given[i], patterns[i]
        whole = min(most, int(words // size)) if size else 0
        first = min(own, default=None)
        plan.append((i, x.own, sizes[first] if own else None, quotas[first] if own else None, whole))
        rest.append((i, words - whole * size if whole < most else 0.0))
        rows[i] = x["rows"]
    table = _small(spark.createDataFrame(plan, "pattern int, own string, source_size long, target double, whole int"), len(plan))
    chosen = _choose(sized.join(table, "own"), rest, rows, seed)
    repeats = F.col("whole") + F.col("extra")
    return chosen.select("doc_id", "sources", "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.alias("repeats"), *(["row"] if keep_rows else []))
