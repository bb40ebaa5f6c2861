"""Packing of token sequences by exact complements.

Documents are tokenized in one pass; only documents longer than a sequence are cut, and their full pieces are
sequences already. What is left is a histogram of lengths below the sequence size, 1,023 counts whatever the input.
On it, sums of one, two and three lengths are indexed by hash; combinations that fill a gap exactly are consumed as
often as the counts allow, longest pieces first, and the rest is packed best-fit. The result is a short list of
patterns with multiplicities. Each piece gets its rank among the pieces of its length by distributed prefix sums, and
the rank decides its pattern, sequence and offset.

Scale: tokens are made once and written with their pieces (if asked for) to the shared folder; everything after moves
the pieces that share a sequence only. Ranks use as many buckets of hashed rows as each length's count asks for, so that
no length is ranked in one task. The broadcast table of rank intervals is bounded by the number of patterns, at
most a few thousand.

Defined results: a null or empty text is the end token alone; null or repeated ``doc_id`` rows are packed as documents
of their own; extra columns are ignored; an empty table gives an empty result. ``<|endoftext|>`` in a text becomes the
special id, as the tokenizer file says.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticeworks.llm._store import materialize
from latticeworks.llm._text import text_slices

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
#: Pieces of one length that one window ranks.
BUCKET_ROWS = 1_000
#: Texts with this go to the tokenizer itself, which has it as a special token.
_SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def _encoder(json_path: str, ranks_path: str):
    """Two readers of one vocabulary: the tokenizer, and its merge ranks, which give the same ids four times faster.

    A test compares both on every seventh code point below the surrogates and on samples beyond them.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Tokenizer.from_file(json_path), tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, json_path: str, ranks_path: str) -> np.ndarray:
    """Ids of a text, without special tokens added."""
    slow, fast = _encoder(json_path, ranks_path)
    if _SPECIAL in text:
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
    return fast.encode_to_numpy(text).astype("<u4")


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; a shorter one comes first."""
    if length <= size:
        return [(0, length)]
    first = length % size
    return ([(0, first)] if first else []) + [(s, size) for s in range(first, length, size)]


def tokenize(docs: DataFrame, json_path: str, ranks_path: str, size: int, end_id: int, keep_ids: bool) -> DataFrame:
    """Pieces of every document, with their checksum and, if asked for, their ids as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            out: list[tuple] = []
            for uid, doc_id, text in zip(batch.column("uid").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or "", json_path, ranks_path), np.array([end_id], "<u4")).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), size)):
                    raw = ids[start : start + n].tobytes()
                    out.append((uid, doc_id, k, start, n, zlib.crc32(raw), raw if keep_ids else None))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    own = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, PIECES)


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence) with the number of sequences of each; every piece is used exactly once.

    Longest first: while pieces of a length are left, a combination of one, two or three shorter lengths that fills
    the gap exactly is looked up and consumed as often as counts allow. Pieces without such a combination are packed
    best-fit: the largest length that still fits, again and again.
    """
    left = {n: c for n, c in counts.items() if c > 0 and 0 < n <= size}
    out: list[tuple[tuple[int, ...], int]] = []

    def times(combination: tuple[int, ...]) -> int:
        return min(left.get(n, 0) // combination.count(n) for n in set(combination))

    def take(combination: tuple[int, ...], n: int) -> None:
        for x in combination:
            left[x] -= n
        for x in set(combination):
            if not left[x]:
                del left[x]
        out.append((combination, n))

    if size in left:
        take((size,), left[size])
    lengths = np.array(sorted(left), np.int64)
    pairs: dict[int, list[tuple[int, int]]] = {}
    for i, a in enumerate(lengths):
        for b in lengths[i:]:
            if a + b < size:
                pairs.setdefault(int(a + b), []).append((int(a), int(b)))

    def exact(n: int) -> tuple[int, ...] | None:
        """The combination that fills the gap beside n most often: a single, else a pair, else a triple."""
        gap, best, most = size - n, None, 0
        if gap in left and times((n, gap)):
            return (n, gap)
        for pair in reversed(pairs.get(gap, ())):
            if pair[0] in left and pair[1] in left and (k := times((n, *pair))) > most:
                best, most = (n, *pair), k
        if best:
            return best
        for a in sorted((x for x in left if x < gap), reverse=True):
            for pair in pairs.get(gap - a, ()):
                if pair[0] in left and pair[1] in left and times((n, a, *pair)):
                    return (n, a, *pair)
        return None

    for n in sorted(left, reverse=True):
        while n in left and (found := exact(n)):
            take(found, times(found))
    while left:
        gap, chosen = size, []
        while fit := max((x for x in left if x <= gap and left[x] > chosen.count(x)), default=0):
            chosen.append(fit)
            gap -= fit
        take(tuple(chosen), times(tuple(chosen)))
    return out


def _ranks(pieces: DataFrame, lengths: dict[int, int]) -> DataFrame:
    """Adds ``rank``: the number of a piece among those of its length, from 0, without gaps.

    Each length is divided into as many buckets of hashed rows as its count (``lengths``) asks for; a window ranks
    within a bucket, and the bucket's first rank is a prefix sum over the counts of buckets.
    """
    buckets = pieces.sparkSession.createDataFrame([(n, -(-c // BUCKET_ROWS)) for n, c in lengths.items()], "length long, buckets long")
    keyed = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("uid", "piece"), F.col("buckets"))).drop("buckets")
    counts = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "bucket").orderBy("uid", "piece")
    return keyed.withColumn("own", F.row_number().over(own) - 1).join(counts, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("own")).drop("bucket", "own", "first")


def _intervals(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """For each length the rank intervals (low, high, first sequence, offset): the pieces of an interval go to consecutive sequences."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for combination, n in patterns:
        offset = 0
        for x in combination:
            low = used.get(x, 0)
            rows.setdefault(x, []).append((low, low + n, sequence, offset))
            used[x] = low + n
            offset += x
        sequence += n
    return sorted(rows.items())


def pack(docs: DataFrame, json_path: str, ranks_path: str, size: int = 1024, end_id: int = 2, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    pieces = materialize(tokenize(docs, json_path, ranks_path, size, end_id, keep_ids), "pieces")
    counts = {x.length: x.n for x in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    # Full pieces are sequences as they are: any number of their own does, so they are neither ranked nor shuffled.
    full = pieces.where(F.col("length") == size).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    counts.pop(size, None)
    flat = [(length, *row) for length, rows in _intervals(plan(counts, size)) for row in rows]
    # A row for each length with its rank intervals, which don't overlap: as many as there are patterns, a few thousand.
    table = spark.createDataFrame(flat, "length long, low long, high long, sequence long, offset long")
    own = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "sequence", "offset"))).alias("intervals"))
    hit = F.element_at(F.filter("intervals", lambda x: (x["low"] <= F.col("rank")) & (F.col("rank") < x["high"])), 1)
    placed = _ranks(pieces.where(F.col("length") < size), counts).join(F.broadcast(own), "length").withColumn("hit", hit)
    return full.unionByName(placed.select(*columns, (F.col("hit.sequence") + F.col("rank") - F.col("hit.low")).alias("sequence_id"), F.col("hit.offset").alias("offset")))
