"""Exact top-k inner products with a KD-tree for each shard.

Vectors become integers, ``floor(1024 * x)``. The top of one KD-tree, fitted on a bounded sample, deals all vectors to
shards that are boxes in space; each shard of about SHARD_ROWS vectors goes on with a KD-tree of its own, by median
splits on its widest dimension, each node with the tight box of its points. A query is answered best-first: a node's
bound is the largest inner product any point of its box could have, nodes are opened by falling bound, and the search
ends when the next bound is under the kth score so far. Each query first searches the shard with the best bound; the
kth score found there goes with it to the others, and it visits only those whose root box could hold something better.

Scale: queries travel in blocks of bounded size, so one task holds one shard's tree and one block; the shards' root
boxes are read in pages. A shard that many equal vectors overfill is dealt on by hash. Scores are exact: products are
summed in doubles while they stay below 2**53, else in Python's integers.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no part;
vectors of another length than the query's aren't compared with it; a candidate with the query's own id is the query's
own; repeated rows are candidates of their own; extra columns are ignored; an empty table gives an empty result. A
component of 2**53 or more is floored to the nearest long; a score beyond 64 bits is held at the largest or smallest
long.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticeworks.llm._store import materialize

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 16_384, 1_024, 256
#: Vectors in the sample that the top of the tree is fitted on, at most; root boxes in a page.
SAMPLE_ROWS, PAGE_SHARDS = 1 << 16, 2_048
#: Blocks of queries that meet a page in one task.
SLICE_BLOCKS = 16
_SUB = 1 << 20
_HITS = "quid long, query_id long, vec_id long, score long"


def _save(**arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each in the narrowest type that holds it."""
    out = io.BytesIO()
    np.savez(out, **{k: _narrow(v) for k, v in arrays.items()})
    return out.getvalue()


def _narrow(x: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if x.size and np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def _load(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as x:
        return {k: x[k] for k in x.files}


def build(ids: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """A KD-tree as arrays: node i covers rows first[i]:last[i], its children are left[i] and left[i] + 1 (-1: a leaf)."""
    order = np.arange(len(ids))
    first, last, left, low, high = [0], [len(ids)], [-1], [], []
    i = 0
    while i < len(first):
        a, b = first[i], last[i]
        own = points[order[a:b]]
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        spread = high[-1].astype(np.float64) - low[-1]
        if b - a > leaf_rows and spread.max() > 0:
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, int(spread.argmax())], middle)]
            left[i] = len(first)
            first += [a, a + middle]
            last += [a + middle, b]
            left += [-1, -1]
        i += 1
    return {"ids": ids[order], "points": points[order], "first": np.array(first), "last": np.array(last), "left": np.array(left), "low": np.array(low), "high": np.array(high)}


def _exact(*arrays: np.ndarray) -> type:
    """The number type in which sums of products of two arrays' rows are exact."""
    largest = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in arrays]
    return np.float64 if arrays[0].shape[1] * largest[0] * largest[-1] < 2**53 else object


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query (rows) with any point of each box (columns)."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


class Splits:
    """The top of a KD-tree: median splits of a sample on the widest dimension, until there are ``leaves`` parts."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.cuts: list[tuple[int, int, int, int]] = []  # dimension, threshold, and the nodes under and from it; below 0: a leaf
        self.leaves = 0
        self.root = self._split(sample, leaves)

    def _split(self, rows: np.ndarray, leaves: int) -> int:
        if leaves > 1 and len(rows) > 1:
            spread = rows.max(axis=0).astype(np.float64) - rows.min(axis=0)
            k = int(spread.argmax())
            cut = int(np.sort(rows[:, k])[len(rows) // 2])
            under = rows[:, k] < cut
            if not under.any():  # the lower half is one value
                cut += 1
                under = rows[:, k] < cut
            if under.any() and not under.all():
                at = len(self.cuts)
                self.cuts.append((k, cut, 0, 0))
                self.cuts[at] = (k, cut, self._split(rows[under], leaves // 2), self._split(rows[~under], leaves - leaves // 2))
                return at
        self.leaves += 1
        return -self.leaves

    def find(self, rows: np.ndarray) -> np.ndarray:
        """The part that each row lies in, from 0."""
        out, todo = np.empty(len(rows), np.int64), [(self.root, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                out[own] = -node - 1
            elif len(own):
                k, cut, under, over = self.cuts[node]
                low = rows[own, k] < cut
                todo += [(under, own[low]), (over, own[~low])]
        return out


def search(tree: dict[str, np.ndarray], query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """The best k (score, id) of each query, best first, ties by smaller id; scores under kth may be missing."""
    kind = _exact(queries, tree["points"])
    points, queries = tree["points"].astype(kind), queries.astype(kind)
    bounds = box_bounds(queries, tree["low"].astype(kind), tree["high"].astype(kind))
    first, last, left, ids = tree["first"].tolist(), tree["last"].tolist(), tree["left"].tolist(), tree["ids"]
    out = []
    for q, own in enumerate(query_ids.tolist()):
        bound, query, limit = bounds[q], queries[q], int(kth[q])
        scores, found = np.empty(0, kind), np.empty(0, np.int64)
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < limit:
                break
            if left[node] >= 0:
                for child in (left[node], left[node] + 1):
                    if bound[child] >= limit:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = first[node], last[node]
            new = points[a:b] @ query
            near = np.flatnonzero((new >= limit) & (ids[a:b] != own))
            if len(near):
                scores, found = np.concatenate([scores, new[near]]), np.concatenate([found, ids[a:b][near]])
                best = np.lexsort((found, -scores))[:k]
                scores, found = scores[best], found[best]
                if len(found) == k:
                    limit = max(limit, int(scores[-1]))
        out.append([(max(-(2**63), min(2**63 - 1, int(s))), int(i)) for s, i in zip(scores, found, strict=True)])
    return out


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, uid, dim and the integer vector of the rows that take part."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("uid"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good).select("vec_id", "uid", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * 1024.0)).alias("v"))


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _row(schema: str, **values) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.table({n: pa.array([values[n]], kinds[t]) for n, t in (c.split() for c in schema.split(", "))})


def _dealt(ints: DataFrame, rows: int, shard_rows: int) -> DataFrame:
    """``ints`` with ``shard``: parts of space of about ``shard_rows`` vectors; fuller ones are dealt on by hash."""
    every = max(1, -(-rows // SAMPLE_ROWS))
    sample = ints.where(F.pmod(F.xxhash64("uid"), F.lit(every)) == 0).select("dim", "v").toArrow()  # about SAMPLE_ROWS, as arrays
    splits = {}
    for dim in pc.unique(sample.column("dim")).to_pylist():
        own = sample.filter(pc.equal(sample.column("dim"), dim))
        splits[dim] = Splits(_matrix(own), -(-own.num_rows * every // shard_rows))
    del sample

    def find(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            leaf = np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                if dim in splits:
                    leaf[own] = splits[dim].find(_matrix(pa.Table.from_batches([batch.take(pa.array(own))])))
            yield batch.append_column("leaf", pa.array(leaf))

    own = ints.mapInArrow(find, T.StructType([*ints.schema.fields, T.StructField("leaf", T.LongType())]))
    own = materialize(own, "topk-leaves")
    full = own.groupBy("dim", "leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * shard_rows)).alias("subs"))
    sub = F.pmod(F.xxhash64("uid"), F.col("subs"))
    return own.join(full, ["dim", "leaf"]).withColumn("shard", F.col("leaf") * _SUB + sub).drop("leaf", "subs")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, which is each row whose id ``every`` divides."""
    ints = materialize(scaled(vectors, id_col, vector_col), "topk-vectors")
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    rows, asked = ints.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    n_blocks = max(1, -(-asked // BLOCK_ROWS))
    tree_schema, block_schema, page_schema = "shard long, dim int, tree binary, box binary", "block long, dim int, queries binary", "dim int, page long, boxes binary"
    visit_schema = "shard long, dim int, queries binary"

    def plant(key: tuple, table: pa.Table) -> pa.Table:
        tree = build(table.column("vec_id").to_numpy(), _matrix(table))
        return _row(tree_schema, shard=key[0].as_py(), dim=key[1].as_py(), tree=_save(**tree), box=_save(low=tree["low"][0], high=tree["high"][0]))

    def bundle(key: tuple, table: pa.Table) -> pa.Table:
        blob = _save(uid=table.column("uid").to_numpy(), ids=table.column("vec_id").to_numpy(), queries=_matrix(table))
        return _row(block_schema, block=key[0].as_py(), dim=key[1].as_py(), queries=blob)

    def page_up(key: tuple, table: pa.Table) -> pa.Table:
        own = [_load(x) for x in table.column("box").to_pylist()]
        low, high = (np.array([x[n] for x in own]).astype(np.int64) for n in ("low", "high"))
        return _row(page_schema, dim=key[0].as_py(), page=key[1].as_py(), boxes=_save(shard=table.column("shard").to_numpy(), low=low, high=high))

    def bounds(row: dict) -> tuple[dict, np.ndarray, np.ndarray]:
        q, boxes = _load(row["queries"]), _load(row["boxes"])
        kind = _exact(q["queries"], np.concatenate([boxes["low"], boxes["high"]]))
        return q, boxes["shard"], box_bounds(q["queries"].astype(kind), boxes["low"].astype(kind), boxes["high"].astype(kind))

    def nearest(batches):
        """For each query the shard of the page that has the best bound, with it as a double."""
        for batch in batches:
            for row in batch.to_pylist():
                q, shard, bound = bounds(row)
                best = bound.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(q["uid"].astype(np.int64)), pa.array(shard[best].astype(np.int64)), pa.array(bound[np.arange(len(best)), best].astype(np.float64))], names=["uid", "shard", "bound"])

    def visits(batches):
        """The queries of a block that a shard of the page can give something better, but for the shard they have been to."""
        for batch in batches:
            for row in batch.to_pylist():
                q, shard, bound = bounds(row)
                known = {x["quid"]: (x["kth"], x["shard"]) for x in row["known"] or []}
                kth, been = (np.array([known.get(u, (-(2**63), -1))[i] for u in q["uid"].tolist()], object) for i in (0, 1))
                for j, own in enumerate(shard.tolist()):
                    go = np.flatnonzero((bound[:, j] >= kth) & (been != own))
                    if len(go):
                        yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([row["dim"]], pa.int32()), pa.array([_save(uid=q["uid"][go], ids=q["ids"][go], queries=q["queries"][go], kth=kth[go].astype(np.int64))], pa.binary())], names=["shard", "dim", "queries"])

    def answer(batches):
        for batch in batches:  # at most 64 MB, by the session's maxBytesPerBatch
            for row in batch.to_pylist():
                q = _load(row["queries"])
                kth = q["kth"] if "kth" in q else np.full(len(q["uid"]), -(2**63), np.int64)
                hits = search(_load(row["tree"]), q["ids"], q["queries"], kth, k)
                flat = [(u, i, v, s) for u, i, found in zip(q["uid"].tolist(), q["ids"].tolist(), hits, strict=True) for s, v in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*flat, strict=True) if flat else [[]] * 4)], names=["quid", "query_id", "vec_id", "score"])

    placed = _dealt(ints, rows, SHARD_ROWS)
    trees = materialize(placed.groupBy("shard", "dim").applyInArrow(plant, tree_schema), "topk-trees")
    deal = lambda n: F.pmod(F.xxhash64("uid"), n).cast("long")
    queries = ints.where(is_query)
    blocks = materialize(queries.withColumn("block", deal(F.lit(n_blocks))).groupBy("block", "dim").applyInArrow(bundle, block_schema), "topk-blocks")
    n_pages = max(1, -(-trees.count() // PAGE_SHARDS))
    pages = trees.select("shard", "dim", "box").withColumn("page", F.pmod(F.xxhash64("shard"), F.lit(n_pages))).groupBy("dim", "page").applyInArrow(page_up, page_schema)
    pages = materialize(pages, "topk-pages")

    # Each block meets each page. Their pairs are what there is to do; they are dealt by page and by a slice of the blocks, so that no key has more than a few.
    slices = max(1, -(-n_blocks // SLICE_BLOCKS))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    held = pages.withColumn("slice", upto(slices))
    meet = lambda own: own.withColumn("page", upto(n_pages)).withColumn("slice", F.pmod("block", F.lit(slices))).join(held, ["dim", "page", "slice"])

    # First the shard with the best bound, in blocks of the queries that share it, to learn the kth scores; then the others.
    best = meet(blocks).mapInArrow(nearest, "uid long, shard long, bound double").groupBy("uid").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard"))
    best = materialize(best, "topk-nearest")
    crowd = best.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("parts"))
    one = queries.join(best, "uid").join(crowd, "shard").withColumn("block", F.col("shard") * F.lit(1 << 20) + deal(F.col("parts")))
    one = one.groupBy("block", "dim").applyInArrow(bundle, block_schema).withColumn("shard", F.floor(F.col("block") / (1 << 20))).drop("block")
    firsts = materialize(one.join(trees.drop("box"), ["shard", "dim"]).mapInArrow(answer, _HITS), "topk-first")
    kth = firsts.groupBy("quid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    kth = best.withColumnRenamed("uid", "quid").join(kth, "quid", "left").select("quid", "shard", F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(-(2**63))).alias("kth"))
    known = kth.groupBy(F.pmod(F.xxhash64("quid"), F.lit(n_blocks)).cast("long").alias("block")).agg(F.collect_list(F.struct("quid", "kth", "shard")).alias("known"))  # a block's queries
    rest = meet(blocks.join(known, "block", "left")).mapInArrow(visits, visit_schema)
    others = materialize(rest.join(trees.drop("box"), ["shard", "dim"]).mapInArrow(answer, _HITS), "topk-others")
    order = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id")
    return firsts.unionByName(others).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
