"""Importance resampling towards a target distribution.

Every document is weighed by how much likelier its hashed features are in the target texts than in the corpus, gets a
Gumbel noise that its id decides, and the highest sums are drawn, which draws without replacement in proportion to the
weights' exponentials.

Counts and weights are arrays: texts are cut into words a batch at a time, and each batch is a gather over the table of
gains, whose size is the number of buckets. The draw is an external merge. Each partition sorts its eligible rows, which
makes a run, and writes it as blocks, cut where the ranges of scores end. Ranges are merged apart, each by a tournament
tree over the runs that reach into it. Blocks are read in order of their first row, so that no more than one block of a
run is open, and a range's size costs time, not memory. Rows of a range begin at the rank where the ranges above it end;
the range in which the draw is complete stops there, and ranges below it are never merged.

Defined results: a null text has no words, no features and weight 0; a null ``doc_id`` counts as an empty text in the
noise's hash and comes after all others among equal scores; repeated rows are drawn one by one, with ranks of their own (a
run holds equal rows once, with their number); words of any length are hashed whole; extra columns are ignored, whatever
their names; with an empty target its counts are 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeworks.llm._store import materialize, parts
from latticeworks.llm._text import Words, gram_valid, per_doc, text_slices, words_of

#: Rows of a block of a run, each of five numbers.
BLOCK_ROWS = 1024


@dataclass(frozen=True)
class Draw:
    """Features are runs of 1 to ``run`` words in ``buckets``; of the documents with ``least_words`` words, ``percent`` in a hundred are drawn with the noise of ``seed``."""

    buckets: int = 10_000
    run: int = 1
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


# Digits, letters (lower case) and everything beyond ASCII belong to words; other bytes separate them.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def feature_words(text: pa.Array) -> Words:
    """Words of each row, in lower case."""
    text = pc.fill_null(text.cast(pa.string()), "")
    offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4) if len(text) else np.zeros(1, np.int32)
    if offsets[-1] == offsets[0]:
        return words_of(text)
    data = _FOLD[np.frombuffer(text.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0])]
    return words_of(pa.StringArray.from_buffers(len(text), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(data)))


def features(words: Words, run: int, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, document) of every feature, an entry for each length of run. The checksum of a longer run goes on from that of the run without its last word, and each different run is hashed once."""
    vocab = words.vocab.cast(pa.binary()).to_pylist()
    code, total, doc = words.ids.astype(np.int64), len(words.ids), words.doc
    sums = np.fromiter((zlib.crc32(w) for w in vocab), np.uint32, len(vocab))
    out = [(sums[code].astype(np.int64) % buckets, doc)]
    for n in range(2, run + 1):
        if total < n:
            break
        pairs, code = np.unique(code[:-1] * len(vocab) + words.ids[n - 1 :], return_inverse=True)
        sums = np.fromiter((zlib.crc32(b" " + vocab[p % len(vocab)], int(sums[p // len(vocab)])) for p in pairs.tolist()), np.uint32, len(pairs))
        own = gram_valid(words.offsets, n, total)
        out.append((sums[code[own]].astype(np.int64) % buckets, doc[: total - n + 1][own]))
    return out


def bucket_counts(docs: DataFrame, draw: Draw) -> np.ndarray:
    """Features of all texts in each bucket. A partition adds up its own first; the driver gets a row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(draw.buckets, np.int64)
        for batch in text_slices(batches):
            for bucket, _ in features(feature_words(batch.column("text")), draw.run, draw.buckets):
                total += np.bincount(bucket, minlength=draw.buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(draw.buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight, in thousandths."""
    k = float(len(corpus))
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """The first 32 bits of a hash of seed and id."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, draw: Draw) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words = feature_words(batch.column("text"))
            weight, n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for bucket, doc in features(words, draw.run, draw.buckets):
                own = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))])
                weight += per_doc(gain[bucket], own)
                n += np.diff(own)
            h = batch.column("h").to_numpy(zero_copy_only=False).astype(float)
            score = weight + np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (words.counts, n, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    own = docs.select(F.col("doc_id").cast("long"), noise(F.col("doc_id"), draw.seed).alias("h"), "text")
    return own.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


_ROW = ("doc_id", "n_features", "weight", "score")
_BLOCKS = "range long, run long, score long, no_id boolean, doc_id long, n long, rows array<struct<doc_id:long,n_features:long,weight:long,score:long,copies:long>>"
_STRUCT = pa.struct([(c, pa.int64()) for c in (*_ROW, "copies")])


def runs(eligible: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Blocks of sorted runs, one run a partition, written. ``bounds`` rise; range 0 holds the scores above the last of them. A block begins with its first row's order."""
    by = [F.desc("score"), F.col("doc_id").asc_nulls_last()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            score, missing = batch.column("score").to_numpy(), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            where = len(bounds) - np.searchsorted(bounds, score, side="right")
            columns = [score, missing, ids, batch.column("n_features").to_numpy(), batch.column("weight").to_numpy()]
            new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])  # equal rows are one, with their number
            first = np.flatnonzero(new)
            copies = np.diff(np.append(first, n))
            own = where[first]
            ahead = np.arange(len(first)) - np.searchsorted(own, own)  # rows before it in this batch's part of its range
            cut = np.flatnonzero(ahead % BLOCK_ROWS == 0)
            at = first[cut]
            offsets = pa.array(np.append(cut, len(first)).astype(np.int32))
            ids_of = pa.array(ids, mask=missing)
            rows = pa.StructArray.from_arrays([ids_of.take(pa.array(first)), *(pa.array(x) for x in (columns[3][first], columns[4][first], score[first], copies))], fields=list(_STRUCT))
            counts = np.add.reduceat(copies, cut)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x.astype(np.int64)) for x in (own[cut], np.zeros(len(cut)))), pa.array(score[at]), pa.array(missing[at]), ids_of.take(pa.array(at)), pa.array(counts), pa.ListArray.from_arrays(offsets, rows)],
                names=["range", "run", "score", "no_id", "doc_id", "n", "rows"],
            )

    sorted_runs = eligible.select(*_ROW).sortWithinPartitions(*by)
    return materialize(sorted_runs.mapInArrow(pack, _BLOCKS).withColumn("run", F.spark_partition_id().cast("long")), "resample-runs")


class Tournament:
    """A tree of matches between runs: each inner place holds the run whose next row comes first among those below it. A run without an open block has none."""

    def __init__(self, size: int = 2):
        self.size, self.slots, self.free = size, {}, (2,)
        self.keys: list[tuple] = [self.free] * size
        self.winner = [0] * size

    def _play(self, node: int) -> int:
        a, b = (x - self.size if x >= self.size else self.winner[x] for x in (2 * node, 2 * node + 1))
        return a if self.keys[a] <= self.keys[b] else b

    def _rebuild(self) -> None:
        self.keys += [self.free] * self.size
        self.size *= 2
        self.winner = [0] * self.size
        for node in range(self.size - 1, 0, -1):
            self.winner[node] = self._play(node)

    def put(self, run: int, key: tuple | None) -> None:
        """The run's next row, or None where it has none for now."""
        slot = self.slots.setdefault(run, len(self.slots))
        if slot >= self.size:
            self._rebuild()
        self.keys[slot] = self.free if key is None else key
        node = (slot + self.size) // 2
        while node:
            self.winner[node] = self._play(node)
            node //= 2

    def best(self) -> tuple[int, tuple, tuple]:
        """Slot and key of the first run, and the key of the one that comes next: the best that lost to it on its way up."""
        slot = self.winner[1]
        node, second = slot + self.size, self.free
        while node > 1:
            other = node ^ 1
            second = min(second, self.keys[other - self.size if other >= self.size else self.winner[other]])
            node //= 2
        return slot, self.keys[slot], second


def _order(row: tuple) -> tuple:
    """Sort key of (doc_id, n_features, weight, score, ...): higher scores first, then smaller ids, nulls last."""
    return (0, -row[3], row[0] is None, row[0] or 0)


def merged(blocks: Iterator[tuple[int, list[tuple]]], quota: int) -> Iterator[list[tuple]]:
    """Slices of rows from (run, rows) blocks, which come in order of their first rows: in order until they hold ``quota`` copies, then the others as they are."""
    tree, opened, names = Tournament(), {}, {}
    ahead = next(blocks, None)
    while True:
        if quota <= 0:
            yield from (rows[at:] for rows, at in opened.values())
            if ahead is not None:
                yield ahead[1]
            yield from (rows for _, rows in blocks)
            return
        head = (3,) if ahead is None else _order(ahead[1][0])
        slot, key, second = tree.best()
        if head <= key:
            if ahead is None:
                return
            run, rows = ahead
            if run in opened:  # its last block ends with the rows that this one begins with
                held, at = opened[run]
                rows = held[at:] + rows
            opened[run] = rows, 0
            tree.put(run, _order(rows[0]))
            names[tree.slots[run]] = run
            ahead = next(blocks, None)
            continue
        if key == tree.free:
            return
        run = names[slot]
        rows, at = opened[run]
        stop = max(at + 1, bisect_right(rows, min(second, head), lo=at, key=_order))
        yield rows[at:stop]
        quota -= sum(row[4] for row in rows[at:stop])
        if stop < len(rows):
            opened[run] = rows, stop
            tree.put(run, _order(rows[stop]))
        else:
            del opened[run]
            tree.put(run, None)


_DRAWN = "doc_id long, n_features long, weight long, score long, copies long, first long, drawn long"


def draw_ranges(blocks: DataFrame, starts: list[tuple[int, int]], quota: int) -> DataFrame:
    """Rows of all blocks; ``first`` is the rank of a row's first copy, ``drawn`` how many of its copies are drawn. ``starts`` has the ranks before each range: ranges that begin beyond the quota are only unpacked."""
    start = dict(starts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, tuple[int, list[tuple]]]]:
            for batch in batches:
                own = batch.column("rows")
                for i, (where, run) in enumerate(zip(batch.column("range").to_pylist(), batch.column("run").to_pylist(), strict=True)):
                    yield where, (run, [tuple(r.values()) for r in own[i].as_py()])

        source = rows()
        ahead = next(source, None)
        while ahead is not None:
            where, out, done = ahead[0], [], start[ahead[0]]

            def of_range(where: int = where) -> Iterator[tuple[int, list[tuple]]]:
                nonlocal ahead
                while ahead is not None and ahead[0] == where:
                    yield ahead[1]
                    ahead = next(source, None)

            for part in merged(of_range(), quota - done):
                for row in part:
                    drawn = max(0, min(row[4], quota - done))
                    out.append((*row, done + 1, drawn))
                    done += row[4]
                if len(out) >= 8192:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    wanted = [k for k, n in starts if n < quota]
    through = blocks.where(F.col("range") <= max(wanted, default=-1))
    dealt = through.repartition(parts(blocks), "range").sortWithinPartitions("range", F.desc("score"), "no_id", "doc_id", "run")
    rest = blocks.where(F.col("range") > max(wanted, default=-1)).select(F.explode("rows").alias("r")).select("r.*", F.lit(None).cast("long").alias("first"), F.lit(0).cast("long").alias("drawn"))
    return dealt.select("range", "run", "rows").mapInArrow(merge, _DRAWN).unionByName(rest)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*_ROW, "copies", "first", "drawn"])


def resample(docs: DataFrame, target: DataFrame, draw: Draw = Draw()) -> DataFrame:  # noqa: B008
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it isn't drawn. Among the n documents with enough words, n * percent // 100 are drawn."""
    gain = gains(bucket_counts(docs, draw), bucket_counts(target, draw))
    scored = materialize(weigh(docs, gain, draw), "resample-scores")
    enough = F.col("n_words") >= draw.least_words
    n = scored.where(enough).count()
    quota = n * draw.percent // 100
    # As many ranges as make their number and their size grow alike; the last bound lies a little below the draw's end.
    ranges = math.isqrt(quota // 64) + 1
    at = sorted({max(0.0, 1 - 1.01 * quota * i / (ranges * n)) for i in range(1, ranges + 1)}) if quota else []
    bounds = sorted({int(b) for b in scored.where(enough).agg(F.percentile_approx("score", at, max(10_000, 100 * ranges))).first()[0] or []}) if at else []
    blocks = runs(scored.where(enough), np.array(bounds, np.int64))
    sizes = {r["range"]: r["n"] for r in blocks.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # one row a range
    starts, before = [], 0
    for k in sorted(sizes):
        starts.append((k, before))
        before += sizes[k]
    # Copies of a row are one after another in rank.
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    drawn = draw_ranges(blocks, starts, quota).select(*_ROW, "first", "drawn", copy)
    ranked = drawn.select(*_ROW, F.when(F.col("copy") < F.col("drawn"), F.col("first") + F.col("copy")).alias("rank"))
    return ranked.unionByName(scored.where(~enough).select(*_ROW, F.lit(None).cast("long").alias("rank")))
