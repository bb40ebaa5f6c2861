"""Substring dedup with a compressed FM-index for each shard.

A window is ``width`` consecutive words. Every window is routed by its minimizer, the smallest hash of the word
GRAM-grams inside it, so equal windows meet in one shard, and each document is streamed to the shards that can hold
its matches instead of to all. Runs of windows with one minimizer are fragments. Fragments whose minimizer occurs once
in the corpus can't repeat and are dropped before any text moves.

A shard concatenates its fragments over an alphabet of its words, builds a suffix array, keeps the Burrows-Wheeler
transform as a wavelet tree (one bit vector with ranks a level) and drops the rest. All fragments are streamed through
it in step: backward search extends each match to the left; a match that falls below two occurrences says how far
the next search may jump, one that reaches the window reports it. The matching statistics above the threshold are the
reported intervals. They are joined back to the documents, which lose the covered words.

Scale: fragments with equal words are indexed once, or twice if they occur more often, so groups of copies and shared
passages don't gather in a shard. A minimizer with more than HOT different fragments is split: the windows of each
different fragment are routed one by one by their own hash, with the number of its copies. Texts are read twice and shuffled once; what else moves is about 40 bytes a fragment,
one for each dozen words.

Defined results: a null or empty text has no words and keeps none; documents shorter than a window are kept as they
are; null or repeated ``doc_id`` rows are documents of their own, and repeated texts count as occurrences; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeworks.llm._store import materialize
from latticeworks.llm._text import Rolling, gram_valid, text_slices, words_of

WIDTH, GRAM = 35, 8
#: Fragments of one minimizer that one shard takes; words in a shard.
HOT, SHARD_WORDS = 4096, 1 << 20
_U = np.uint64


# --- fragments -----------------------------------------------------------------------------------------------------


def window_minimizers(low: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The smallest of the gram hashes inside each window, by window start; document borders ignored."""
    span, size = width - gram + 1, 1
    while size < span:
        step = min(size, span - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    return low


def digests(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A digest of each run of word hashes. Unlike a running polynomial of 64 bits it has no patterns of words that any base maps to one value."""
    data = memoryview(np.ascontiguousarray(values)).cast("B")
    return np.fromiter((xxhash.xxh3_64_intdigest(data[8 * a : 8 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), _U, len(starts))


def fragments(values: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of windows with one minimizer: document, first word (in the batch), number of windows, minimizer, hash of the words, and whether the minimizer lies in the run more than once."""
    none = np.empty(0, np.int64)
    starts = np.flatnonzero(gram_valid(offsets, width, len(values))) if len(values) >= width else none
    if not len(starts):
        return {"doc": none, "start": none, "n": none, "m": np.empty(0, _U), "f": np.empty(0, _U), "again": np.empty(0, bool)}
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    hashes = Rolling(values)
    grams = hashes.grams(gram)
    own, at = window_minimizers(grams, width, gram)[starts], doc[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    start, m = starts[first], own[first]
    # Gram positions of each run, laid end to end.
    size = n + width - gram
    ends = np.cumsum(size)
    place = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(start, size)
    again = np.add.reduceat((grams[place] == np.repeat(m, size)).astype(np.int32), ends - size) > 1
    return {"doc": at[first], "start": start, "n": n, "m": m, "f": digests(values, start, start + n + width - 1), "again": again}


# --- FM-index ------------------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of text by their first ``depth`` symbols at least, by prefix doubling from three symbols."""
    n = len(text)
    pad = np.concatenate([text.astype(np.int64) + 1, np.zeros(2, np.int64)])
    top = int(pad.max()) + 1
    key, size = (pad[:n] * top + pad[1 : n + 1]) * top + pad[2:], 3
    while True:
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int64)
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if size >= depth or rank[order[-1]] == n:
            return order
        key = rank * (n + 2)
        key[: n - size] += rank[size:]
        size *= 2


class FMIndex:
    """Counts occurrences by backward search. The transform is a wavelet tree: a packed bit vector a level, with a rank every 64 bits."""

    def __init__(self, text: np.ndarray, depth: int):
        self.n = len(text)
        top = int(text.max()) + 1
        order = suffix_array(text, depth)
        last = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top))]).astype(np.int64)
        self.levels = max(1, (top - 1).bit_length())
        self.words, self.ranks, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (last >> level) & 1
            pad = np.zeros(-(-(self.n + 1) // 64) * 64, np.uint8)
            pad[: self.n] = bit
            words = np.packbits(pad, bitorder="little").view(_U)
            self.words.append(words)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64))
            self.zeros.append(int(self.n - bit.sum()))
            last = np.concatenate([last[bit == 0], last[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits of a level."""
        block = at >> 6
        mask = (_U(1) << (at & 63).astype(_U)) - _U(1)
        return self.ranks[level][block] + np.bitwise_count(self.words[level][block] & mask).astype(np.int64)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``at`` of the transform."""
        low, high = np.zeros_like(at), at
        for k in range(self.levels):
            bit = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = self._ones(k, low), self._ones(k, high)
            low = np.where(bit, self.zeros[k] + a, low - a)
            high = np.where(bit, self.zeros[k] + b, high - b)
        return high - low

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + match for matches with intervals [low, high)."""
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.before[symbol], 2)
        return both[: len(symbol)], both[len(symbol) :]


def repeated_windows(index: FMIndex, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, end) of windows with two occurrences or more; together they cover each word that any such window covers.

    All fragments text[start:end] advance in step. A probe begins at the end of a window and extends to the left.
    Windows that end at or before ``done`` are settled. If the match falls under two occurrences at position i, no
    window over text[i:right] repeats: those that end up to i + width are settled. If it reaches the window, the window
    is reported and the next probe is the window that begins where this one ends. Should that fail, the windows
    between are probed from the right (``back``); the first that repeats joins the one before without a gap, so those
    between add nothing, and the misses to its right are known up to ``far``.
    """
    live = np.flatnonzero(ends - starts >= width)
    done = starts[live] + width - 1
    right, at = done + 1, done + 1
    far, back = np.zeros(len(live), np.int64), np.zeros(len(live), bool)
    low, high = np.zeros(len(live), np.int64), np.full(len(live), index.n, np.int64)
    found_in, found_at = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(live):
        at = at - 1
        low, high = index.extend(text[at], low, high)
        miss = high - low < 2
        hit = ~miss & (right - at >= width)
        over = miss | hit
        if over.any():
            found_in.append(live[hit])
            found_at.append(right[hit])
            stop = ends[live]
            far = np.where(miss & ~back, at + width, far)
            more = miss & (right - 1 > done)  # windows between are still open
            jump = hit & ~back
            settled = over & ~more & ~jump  # a miss with none open, or a hit found from the right
            done = np.where(jump, right, np.where(settled, far, done))
            right = np.where(jump, np.minimum(right + width, stop), np.where(more, right - 1, np.where(settled, far + 1, right)))
            back = np.where(over, more, back)
            low, high, at = np.where(over, 0, low), np.where(over, index.n, high), np.where(over, right, at)
            stay = (right <= stop) & (right > done)
            if not stay.all():
                live, done, right, at, far, back, low, high = (x[stay] for x in (live, done, right, at, far, back, low, high))
    return np.concatenate(found_in), np.concatenate(found_at)


def shard_matches(texts: pa.Array, copies: np.ndarray, width: int) -> list[list[tuple[int, int]]]:
    """Word ranges of each fragment that repeated windows cover. A fragment with two copies or more is indexed twice."""
    words = words_of(texts)
    n, sizes = len(texts), words.counts
    # Symbol 0 ends each fragment. Fragments first, then second copies of those that have one.
    again = np.flatnonzero(copies > 1)
    take = np.concatenate([np.arange(n), again])
    ends = np.cumsum(sizes[take] + 1) - 1
    starts = ends - sizes[take]
    text = np.zeros(int(ends[-1]) + 1, np.int64)
    size = sizes[take]
    source = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    text[source + np.repeat(starts, size)] = words.ids[source + np.repeat(words.offsets[:-1][take], size)] + 1
    index = FMIndex(text, width)
    which, where = repeated_windows(index, text, starts[:n], ends[:n], width)
    order = np.lexsort((where, which))
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for f, b in zip(which[order].tolist(), (where - starts[which])[order].tolist(), strict=True):
        if out[f] and out[f][-1][1] >= b - width:
            out[f][-1] = (out[f][-1][0], b)
        else:
            out[f].append((b - width, b))
    return out


# --- the operator --------------------------------------------------------------------------------------------------


_PROFILE = "uid long, doc_id long, n_words long, sha string, runs array<struct<m:long,f:long,start:int,n:int,again:boolean>>"
_RUN = pa.struct([("m", pa.int64()), ("f", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("again", pa.bool_())])
_PIECE = "key long, f long, m0 long, f0 long, start int, hot boolean, copies long, n_words int, words string"
_SPANS = "array<struct<a:int,b:int>>"


def _joined(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").split())


def profiles(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """Word count, digest of all words and fragments of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words = words_of(batch.column("text"))
            found = fragments(words.hashes(), words.offsets, width, gram)
            local = found["start"] - words.offsets[found["doc"]]
            rows = pa.StructArray.from_arrays([pa.array(found["m"].view(np.int64)), pa.array(found["f"].view(np.int64)), pa.array(local.astype(np.int32)), pa.array(found["n"].astype(np.int32)), pa.array(found["again"])], fields=list(_RUN))
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(found["doc"], np.arange(batch.num_rows + 1)).astype(np.int32)), rows)
            sha = [hashlib.sha256(_joined(t or "")).hexdigest() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(words.counts), pa.array(sha), runs], names=["uid", "doc_id", "n_words", "sha", "runs"])

    return docs.select("uid", "doc_id", "text").mapInArrow(run, _PROFILE)


def _pieces(docs: DataFrame, width: int) -> DataFrame:
    """Texts to index from documents with ``asked`` fragments: whole fragments, and single windows of hot ones, which name their fragment (m0, f0) and where in it they begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            out: list[tuple] = []
            for text, asked in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                for x in asked:
                    a, n = x["start"], x["n"]
                    if not x["hot"]:
                        out.append((x["m"], x["f"], x["m"], x["f"], 0, False, x["copies"], n + width - 1, b" ".join(words[a : a + n + width - 1]).decode("utf-8", "surrogatepass")))
                        continue
                    for i in range(a, a + n):
                        window = b" ".join(words[i : i + width])
                        key = int.from_bytes(hashlib.blake2b(window, digest_size=16).digest()[:8], "big", signed=True)
                        out.append((key, key, x["m"], x["f"], i - a, True, x["copies"], width, window.decode("utf-8", "surrogatepass")))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.string())
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in _PIECE.split(", ")])

    return docs.select("text", "asked").mapInArrow(run, _PIECE)


def _matched(pieces: DataFrame, width: int) -> DataFrame:
    """(key, f, spans) of the indexed texts that hold a repeated window."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        texts = table.column("words").combine_chunks()
        spans = shard_matches(texts, table.column("copies").to_numpy(), width)
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        out = pa.table({"key": table.column("key"), "f": table.column("f"), "spans": pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], kind)})
        return out.filter(pc.greater(pc.list_value_length(out.column("spans")), 0))

    return pieces.groupBy("shard").applyInArrow(run, f"key long, f long, spans {_SPANS}")


def _cut(docs: DataFrame) -> DataFrame:
    """uid, n_removed and kept_sha256 of documents without the words of their spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            removed, sha = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                kept, at, n = [], 0, 0
                words = text.encode("utf-8", "surrogatepass").split()
                for a, b in sorted((x["a"], x["b"]) for x in spans):
                    if b > at:
                        a = max(a, at)
                        kept += words[at:a]
                        n, at = n + b - a, b
                removed.append(n)
                sha.append(hashlib.sha256(b" ".join(kept + words[at:])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(removed, pa.int64()), pa.array(sha)], names=["uid", "n_removed", "kept_sha256"])

    return docs.select("uid", "text", "spans").mapInArrow(run, "uid long, n_removed long, kept_sha256 string")


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles of all documents, the texts of those with a repeated minimizer, and (uid, spans): the word ranges to remove."""
    base = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_docs = materialize(profiles(base, width, gram), "substring-profiles")
    runs = all_docs.select("uid", F.explode("runs").alias("r")).select("uid", "r.m", "r.f", "r.start", "r.n", "r.again")
    often = runs.groupBy("m").agg(F.count(F.lit(1)).alias("c"), F.max("again").alias("again")).where("c > 1 or again").select("m")
    occurrences = materialize(runs.join(often, "m", "left_semi").drop("again"), "substring-occurrences")
    distinct = occurrences.groupBy("m", "f").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("uid", "start", "n")).alias("rep"))
    distinct = materialize(distinct, "substring-distinct")
    hot = distinct.groupBy("m").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT).select("m", F.lit(True).alias("hot"))
    # One document of each different fragment gives its text for all that have it; of hot minimizers window by window.
    piece = F.struct("m", "f", F.col("rep.start").alias("start"), F.col("rep.n").alias("n"), F.coalesce("hot", F.lit(False)).alias("hot"), "copies").alias("x")
    asked = distinct.join(hot, "m", "left").select("rep.uid", piece)
    others = occurrences.select("uid", F.lit(None).cast(asked.schema["x"].dataType).alias("x"))
    asked = asked.unionByName(others).groupBy("uid").agg(F.collect_set("x").alias("asked"))
    texts = materialize(base.select("uid", "text").join(asked, "uid").dropDuplicates(["uid"]), "substring-texts")
    pieces = materialize(_pieces(texts.where(F.size("asked") > 0), width), "substring-pieces")
    each = pieces.groupBy("key", "f").agg(F.sum("copies").alias("copies"), F.first("words").alias("words"), F.first("n_words").alias("n_words"))
    words = pieces.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    n_shards = max(1, -(-words // SHARD_WORDS))
    matched = materialize(_matched(each.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n_shards))), width), "substring-matches")
    shifted = lambda by: F.transform("spans", lambda x: F.struct((x["a"] + F.col(by)).alias("a"), (x["b"] + F.col(by)).alias("b")))
    cold = matched.select(F.col("key").alias("m"), "f", "spans")
    warm = pieces.where("hot").select("key", "f", "m0", "f0", "start").join(matched, ["key", "f"]).select(F.col("m0").alias("m"), F.col("f0").alias("f"), shifted("start").alias("spans"))
    warm = warm.groupBy("m", "f").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # a fragment's windows
    spans = occurrences.join(cold.unionByName(warm), ["m", "f"]).select("uid", shifted("start").alias("spans")).groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return all_docs, texts, spans


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    all_docs, texts, spans = repeated_spans(docs, width, gram)
    changed = _cut(texts.select("uid", "text").join(spans, "uid"))
    out = all_docs.select("uid", "doc_id", "n_words", "sha").join(changed, "uid", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
