"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures, confirmed on full shingle sets.

Documents with equal shingle sets form a class at once; the rest works on one document a class. A signature holds 64
minima cut to 16 bits. Two sets of similarity s differ in about (1 - s) * 64 of them; the distance threshold is set so
that a pair at the similarity threshold exceeds it with a chance below 1e-6. By the pigeonhole principle a pair within
the threshold agrees, in one of the signature's chunks, but for as many symbols as errors are allowed there; every way
to leave out that many symbols of a chunk is indexed, so all pairs within the threshold meet in a bucket.

Buckets are read in order: a leader's near members form its tree, the triangle inequality of signature distances passes
over most other pairs, and each task gives a spanning forest of the pairs it found near, not the pairs. Components of
these forests are clusters; every link lies inside one. A cluster's shingle sets then meet once, where near pairs that
aren't connected yet are confirmed on the full sets; again only a spanning forest of links is given. A pair that is left
out is one whose documents are connected already, so the components are those of all links.

Scale: texts are read twice and shuffled once; index rows are 16 bytes and only those of shared buckets carry a
signature. Buckets and clusters beyond a block are cut into blocks; their largest trees are joined by their leaders, and
only members outside a group's largest component visit other blocks. So a group of copies makes rows in proportion to
its members; what grows faster are blocks full of documents that share a key and nothing else. Components are found by
star rounds over tables in the shared folder; nothing is collected. Blocks bound what a task holds. A document is known
by a 64-bit hash of its id and text.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; fewer words than a shingle
make one shingle; null ``doc_id`` rows are classes of their own if blank, else take part under the smallest id of
their class (null if there is none); repeated rows are one class; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeworks.llm._store import materialize, parts, remove
from latticeworks.llm._text import gram_hashes, mix64, odd_constants, text_slices, words_of

SYMBOLS = 64
#: Members of a bucket, documents and shingles of a cluster that meet in one block.
BUCKET_BLOCK, CLUSTER_BLOCK, CLUSTER_SHINGLES = 1 << 15, 1 << 14, 1 << 22
#: Members of a group whose pairs are all looked at.
SMALL = 48
#: Ids that a task joins before it gives its edges and begins anew.
FOREST_IDS = 1 << 20
_U = np.uint64


@dataclass(frozen=True)
class Similarity:
    """Words in a shingle and the least similarity of a link, in percent."""

    words: int = 5
    percent: int = 80

    @property
    def distance(self) -> int:
        """Most differing symbols of a pair to look at: a pair at the similarity threshold exceeds it with a chance under 1e-6."""
        p, tail = 1 - self.percent / 100, 0.0
        for d in range(SYMBOLS, -1, -1):
            tail += comb(SYMBOLS, d) * p**d * (1 - p) ** (SYMBOLS - d)
            if tail >= 1e-6:
                return d
        return 0

    @property
    def chunks(self) -> list[tuple[int, int]]:
        """(first symbol, end) of the chunks: as few as leave each pair within the distance a chunk with one error or none."""
        n = self.distance // 2 + 1
        edges = np.linspace(0, SYMBOLS, n + 1).round().astype(int)
        return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def shingles(words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each document, sorted within it, and their offsets."""
    values, offsets, counts = words.hashes(), words.offsets, words.counts
    if len(values) >= n:
        grams = gram_hashes(values, n)
        per = np.maximum(counts - n + 1, 0)
        doc = np.repeat(np.arange(len(counts)), per)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(offsets[:-1], per)
        grams = grams[at] if len(at) else np.empty(0, _U)
    else:
        doc, grams = np.empty(0, np.int64), np.empty(0, _U)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        own = []
        for d in short:
            run = values[offsets[d] : offsets[d + 1]]
            own.append(gram_hashes(run, len(run), seed=1000 + len(run))[0])
        doc, grams = np.concatenate([doc, short]), np.concatenate([grams, np.array(own, _U)])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    doc, grams = doc[first], grams[first]
    return grams, np.searchsorted(doc, np.arange(len(counts) + 1))


_A, _B = odd_constants(SYMBOLS, 11), odd_constants(SYMBOLS, 12)


def signatures(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash symbols, 16 bits each, of every document; zeros for empty sets."""
    n = len(offsets) - 1
    out = np.zeros((n, SYMBOLS), np.uint16)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        starts = offsets[:-1][full]
        for k in range(SYMBOLS):
            x = grams * _A[k] + _B[k]
            x ^= x >> _U(32)
            x *= _U(0x9E3779B97F4A7C15)
            low = np.minimum.reduceat(x, starts)
            out[full, k] = (mix64(low) & _U(0xFFFF)).astype(np.uint16)
    return out


def _set_ids(grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    sums = []
    for c in odd_constants(2, 13):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(mix64(grams * c), dtype=_U)])
        sums.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return sums[0], sums[1]


_SIGNED = "uid long, doc_id long, n_shingles long, s1 long, s2 long, sig binary"


def signed(docs: DataFrame, like: Similarity) -> DataFrame:
    """Set size, set fingerprint and signature of each document; ``docs`` has uid, doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            grams, offsets = shingles(words_of(batch.column("text"), lower=True), like.words)
            s1, s2 = _set_ids(grams, offsets)
            sig = [x.tobytes() for x in signatures(grams, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(s1), pa.array(s2), pa.array(sig, pa.binary())], names=["uid", "doc_id", "n_shingles", "s1", "s2", "sig"])

    return docs.select("uid", "doc_id", "text").mapInArrow(run, _SIGNED)


def bucket_keys(sig: np.ndarray, chunks: list[tuple[int, int]]) -> np.ndarray:
    """Keys of each signature: for each chunk and each of its symbols, the hash of the chunk without that symbol."""
    out = np.empty((len(sig), SYMBOLS), _U)
    salt = odd_constants(SYMBOLS, 14)
    parts_ = mix64((sig.astype(_U) + _U(1)) * odd_constants(SYMBOLS, 15))
    for a, b in chunks:
        whole = parts_[:, a:b].sum(axis=1, dtype=_U)
        for j in range(a, b):
            out[:, j] = mix64((whole - parts_[:, j]) * salt[j])
    return out


def _index(classes: DataFrame, like: Similarity) -> DataFrame:
    """(bucket, id) for every key of every class."""
    chunks = like.chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids = np.repeat(part.column("id").to_numpy(), SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(bucket_keys(_sigs(part), chunks).ravel().view(np.int64)), pa.array(ids)], names=["bucket", "id"])

    return classes.select("id", "sig").mapInArrow(run, "bucket long, id long")


def _sigs(batch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)


class Forest:
    """Union-find over ids; says whether an edge joins two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def batch(self) -> pa.RecordBatch:
        """Edges (a, b) from each id to its tree's smallest."""
        ids = list(self.up)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([self.root(x) for x in ids], pa.int64())], names=["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows that come by ``keys``; each holds one group or many small ones."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
            change[0] |= not held or held[-1].column(k)[-1].as_py() != x[0]
        starts = np.flatnonzero(change)
        if not len(starts):
            held.append(batch)
            continue
        if held or starts[-1] > 0:
            held.append(batch.slice(0, int(starts[-1])))
            yield pa.Table.from_batches(held)
        held = [batch.slice(int(starts[-1]))]
    if held:
        yield pa.Table.from_batches(held)


def near_edges(sig: np.ndarray, size: np.ndarray, limit: int, percent: int) -> tuple[list[int], list[int]]:
    """Edges that connect all pairs within ``limit`` differing symbols and alike in size, without looking at most of them.

    The first row left leads: rows near it form its tree. Distances obey the triangle inequality, so a row further than
    ``limit`` from the leader can only be near a member whose own distance makes up the difference; all others are
    passed over. Then the rows outside the tree go on with a leader among them.
    """
    alike = lambda i, to: np.minimum(size[i], size[to]) * 100 >= np.maximum(size[i], size[to]) * percent
    a, b, rest = [], [], np.arange(len(sig))
    while len(rest) > 1:
        first, others = rest[0], rest[1:]
        d = (sig[others] != sig[first]).sum(axis=1)
        near = (d <= limit) & alike(first, others)
        tree, reach, rest, far = others[near], d[near], others[~near], d[~near]
        a += [first] * len(tree)
        b += tree.tolist()
        for k in np.flatnonzero(far <= limit + reach.max(initial=-limit - 1)):
            to = tree[reach >= far[k] - limit]
            to = to[((sig[to] != sig[rest[k]]).sum(axis=1) <= limit) & alike(rest[k], to)]
            if len(to):
                a.append(rest[k])
                b.append(to[0])
    return a, b


def _near_forest(dealt: DataFrame, classes: DataFrame, like: Similarity) -> DataFrame:
    """(a, b): for each task a spanning forest of the pairs that are near by signature and alike in size, among the ids of each (key, block)."""
    limit, percent = like.distance, like.percent
    dealt = dealt.select("key", "block", "id").join(classes.select("id", "n_shingles", "sig"), "id").repartition(parts(dealt) * 2, "key", "block").sortWithinPartitions("key", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for table in _groups(batches, ["key", "block"]):
            key, block, ids, size = (table.column(c).to_numpy() for c in ("key", "block", "id", "n_shingles"))
            sig = _sigs(table)
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
            ends = np.append(starts[1:], len(ids))
            # Small groups side by side, row by row further apart; larger ones by leaders.
            span = np.where(ends - starts <= SMALL, ends, starts).repeat(ends - starts)
            for d in range(1, SMALL):
                x = np.flatnonzero(np.arange(len(ids)) + d < span)
                if not len(x):
                    break
                for at in range(0, len(x), 65_536):
                    p = x[at : at + 65_536]
                    q = p + d
                    p, q = (v[np.minimum(size[p], size[q]) * 100 >= np.maximum(size[p], size[q]) * percent] for v in (p, q))
                    near = (sig[p] != sig[q]).sum(axis=1) <= limit
                    for u, v in zip(ids[p[near]].tolist(), ids[q[near]].tolist(), strict=True):
                        forest.join(u, v)
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s > SMALL:
                    for u, v in zip(*near_edges(sig[s:e], size[s:e], limit, percent), strict=True):
                        forest.join(int(ids[s + u]), int(ids[s + v]))
            if len(forest.up) > FOREST_IDS:
                yield forest.batch()
                forest.up.clear()
        yield forest.batch()

    return dealt.mapInArrow(run, "a long, b long")


def _connected(members: DataFrame, edges: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """(a, b) that connect all related ids of each key; ``members`` has key, id, block and blocks, ``edges`` relates the ids of each (key, block).

    A key is cut into blocks of bounded size, and most need one. Of those with more, the largest trees of the blocks are
    related by their leaders first; then the ids of a key's largest component stay in their blocks, and only the others
    visit all blocks. So a group of near copies makes a row for each, and none for each pair of blocks.
    """
    inside = materialize(edges(members), f"{name}-inside")
    hot = materialize(members.where("blocks > 1"), f"{name}-hot")
    if hot.isEmpty():
        return inside
    ids = hot.select("id").distinct()
    largest = lambda by, found: found.groupBy(*by, "comp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).groupBy(*by).agg(F.max(F.struct("n", "comp", "id")).alias("top"))
    trees = largest(["key", "block"], hot.join(components(ids, inside), "id"))
    led = materialize(edges(trees.select("key", F.lit(0).alias("block"), F.col("top.id").alias("id"))), f"{name}-led")
    found = materialize(hot.join(components(ids, inside.union(led)), "id"), f"{name}-found")
    movers = found.join(largest(["key"], found).select("key", F.col("top.comp").alias("stay")), "key").where("comp <> stay")
    visits = movers.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id")
    return inside.union(led).union(materialize(edges(hot.select("key", "block", "id").union(visits).distinct()), f"{name}-across"))


def _thinned(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: neighbouring tasks' forests are read together and made one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for p, q in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                forest.join(p, q)
            if len(forest.up) > FOREST_IDS:
                yield forest.batch()
                forest.up.clear()
        yield forest.batch()

    return edges.coalesce(max(1, parts(edges) // 8)).mapInArrow(run, "a long, b long")


def _links(clusters: DataFrame, texts: DataFrame, like: Similarity) -> DataFrame:
    """(a, b): spanning forests of the links, confirmed on full sets made anew from the texts of clustered documents."""
    sizes = clusters.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CLUSTER_BLOCK), F.ceil(F.sum("n_shingles") / CLUSTER_SHINGLES)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("k")).where("k > 1")
    sizes = materialize(sizes, "neardup-sizes")  # a plain join follows, whose hot clusters can be split
    own = clusters.join(sizes, "cluster").select(F.col("cluster").alias("key"), "id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "blocks")
    return _connected(own, lambda dealt: _confirmed(dealt, texts, like), "neardup-links")


def _confirmed(dealt: DataFrame, texts: DataFrame, like: Similarity) -> DataFrame:
    """(a, b): for each (key, block) a spanning forest of the links among its ids."""
    limit, percent = like.distance, like.percent

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            grams, offsets = shingles(words_of(batch.column("text"), lower=True), like.words)
            raw = [grams[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "key", "block")] + [pa.array(raw, pa.binary())], names=["id", "key", "block", "grams"])

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        own = [np.frombuffer(x, _U) for x in table.column("grams").to_pylist()]
        sizes = np.array([len(x) for x in own], np.int64)
        ends = np.cumsum(sizes)
        flat = np.concatenate(own)
        sig = signatures(flat, np.append(0, ends))
        tree = np.arange(len(ids))  # label of each document's tree
        trees, a, b = len(ids), [], []
        for r in range(len(ids)):
            if trees == 1:
                break
            to = np.flatnonzero(tree[r + 1 :] != tree[r]) + r + 1
            to = to[np.minimum(sizes[r], sizes[to]) * 100 >= np.maximum(sizes[r], sizes[to]) * percent]
            to = to[(sig[to] != sig[r]).sum(axis=1) <= limit]
            for at in range(0, len(to), 1024):
                part = to[at : at + 1024]
                grams = np.concatenate([own[t] for t in part])
                place = np.minimum(np.searchsorted(own[r], grams), sizes[r] - 1)
                shared = np.add.reduceat((own[r][place] == grams).astype(np.int64), np.cumsum(sizes[part]) - sizes[part])
                for t in part[shared * 100 >= (sizes[r] + sizes[part] - shared) * percent]:
                    if tree[t] != tree[r]:
                        a.append(ids[r])
                        b.append(ids[t])
                        tree[tree == tree[t]] = tree[r]
                        trees -= 1
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    made = texts.join(dealt.select("key", "block", "id"), "id").dropDuplicates(["id", "key", "block"]).select("id", "key", "block", "text").mapInArrow(sets, "id long, key long, block int, grams binary")
    return made.groupBy("key", "block").applyInArrow(run, "a long, b long")


def components(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp) for all ids: the smallest id reachable over links. Large-star and small-star rounds, each written to the shared folder, until nothing changes."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "neardup-edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialize(small, "neardup-edges")
        state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        done = state(new) == state(edges)
        remove(edges)  # only the round before was read from it
        edges = new
        if done:
            break
    return ids.join(edges.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def row_id():
    """A number that a row's content decides, the same in every scan; equal only for repeated rows."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def near_duplicates(docs: DataFrame, like: Similarity = Similarity()) -> DataFrame:
    """uid, doc_id, n_shingles, component_id, component and kept of every row of ``docs``; uid is row_id().

    ``component`` names the group also where its ids are null or repeated: the smallest uid that stands for one of its classes.
    """
    base = docs.select(row_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_docs = materialize(signed(base, like), "neardup-signed")
    full = all_docs.where("n_shingles > 0")
    classes = materialize(full.groupBy("s1", "s2").agg(F.min("doc_id").alias("low"), F.min("uid").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")), "neardup-classes")
    index = _index(classes, like)
    shared = index.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    members = index.join(shared, "bucket").withColumn("blocks", F.ceil(F.col("k") / BUCKET_BLOCK).cast("int"))
    members = materialize(members.select(F.col("bucket").alias("key"), "id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "blocks"), "neardup-members")
    near = _connected(members, lambda dealt: _near_forest(dealt, classes, like), "neardup-near")
    clusters = components(classes.select("id", "n_shingles"), _thinned(near)).withColumnRenamed("comp", "cluster")
    texts = base.select(F.col("uid").alias("id"), "text")
    comps = components(classes.select("id"), _links(materialize(clusters, "neardup-clusters"), texts, like))

    named = classes.select("s1", "s2", "id", "low").join(comps, "id")
    lows = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "comp").select("s1", "s2", "component_id", F.col("comp").alias("component"))
    out = full.join(named, ["s1", "s2"]).select("uid", "doc_id", "n_shingles", "component_id", "component")
    out = out.unionByName(all_docs.where("n_shingles = 0").select("uid", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("uid").alias("component")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
