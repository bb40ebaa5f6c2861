"""Word kernels over Arrow text columns: everything works on whole batches, never on single words.

A word is a maximal run of bytes outside ``0x20`` and ``0x09``-``0x0D``; these bytes never occur inside a
multi-byte UTF-8 character, so bytes and characters agree.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes that a kernel works on at a time.
SLICE_BYTES = 2 << 20

_U = np.uint64


def byte_sizes(text: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut the batches so that each holds about ``budget`` bytes of text, and one row at least."""
    try:
        for batch in batches:
            sizes = byte_sizes(batch.column(column))
            ends = np.cumsum(sizes + 64)
            start = 0
            while start < batch.num_rows:
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + budget, side="right")))
                yield batch.slice(start, stop - start)
                start = stop
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers stay while the executor's JVM goes on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@dataclass
class Words:
    """ids[offsets[d]:offsets[d + 1]] are the words of document d as indexes into vocab."""

    ids: np.ndarray
    offsets: np.ndarray
    vocab: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A stable 64-bit hash of each word occurrence."""
        own = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.vocab.cast(pa.binary()).to_pylist()), dtype=_U, count=len(self.vocab))
        return own[self.ids] if len(self.ids) else np.empty(0, _U)


def words_of(text: pa.Array, lower: bool = False) -> Words:
    """Words of each row; a null text has none."""
    text = pc.fill_null(text, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    offsets = kept[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int64)
    coded = flat.filter(full).dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), offsets, coded.dictionary)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=_U) | _U(1)


class Rolling:
    """Rolling hashes of a sequence of 64-bit values: a running polynomial, whose differences are brought to a common power. One pass serves runs of every length."""

    def __init__(self, values: np.ndarray, seed: int = 17):
        base = odd_constants(1, seed)[0]
        power = lambda x: np.concatenate([np.ones(1, _U), np.multiply.accumulate(np.full(len(values), x, _U))])
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(values.astype(_U, copy=False) * power(base)[:-1], dtype=_U)])
        self.back = power(_U(pow(int(base), -1, 2**64)))

    def grams(self, n: int) -> np.ndarray:
        """Hash of each run of n consecutive values, document borders ignored; len(values) - n + 1 of them."""
        if len(self.sums) <= n:
            return np.empty(0, _U)
        return mix64((self.sums[n:] - self.sums[:-n]) * self.back[: len(self.sums) - n] + _U(n))

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for each run."""
        return mix64((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(_U))


def gram_hashes(values: np.ndarray, n: int, seed: int = 17) -> np.ndarray:
    return Rolling(values, seed).grams(n)


def gram_valid(offsets: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each start of gram_hashes whether the run stays within one document."""
    out = np.zeros(max(0, total - n + 1), bool)
    if len(out):
        diff = np.zeros(total + 1, np.int32)
        starts, stops = offsets[:-1], offsets[1:] - n + 1
        ok = stops > starts
        np.add.at(diff, starts[ok], 1)
        np.add.at(diff, stops[ok], -1)
        out = np.cumsum(diff)[: len(out)] > 0
    return out


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over each document."""
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def cover(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask of positions inside any of the runs of length n that begin at starts."""
    diff = np.zeros(total + 1, np.int32)
    np.add.at(diff, starts, 1)
    np.add.at(diff, starts + n, -1)
    return np.cumsum(diff)[:total] > 0
