"""Quality rules by repetition coverage.

For several n-gram lengths, rolling hashes of the word sequence (one running polynomial serves all lengths) find the n-grams that occur more than once in a
document; the share of the document's word characters inside such n-grams is its coverage at that length. Lines
that repeat an earlier line are measured likewise. Equal hashes are confirmed on the words themselves.

One pass over the texts, no shuffle. Memory: a few MB of text at a time.

Defined results: a null or empty text has no words and is rejected (too few words); a null ``doc_id`` is carried
through; repeated rows are judged one by one; extra columns are carried through by ``filter_quality`` and ignored by
``quality_rules``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeworks.llm._text import Rolling, cover, gram_valid, mix64, per_doc, text_slices, words_of

_SYMBOLS = b"#*$%&|<>"
_SPACE = " \t\n\v\f\r"


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict; a document that exceeds any of them is rejected.

    The limits by n-gram length fall with the length: the longer a repeated n-gram, the less of it chance explains.
    Repeated lines count against a document only if they are many and hold much of its text.
    """

    min_words: int = 20
    base_window: int = 8
    base_percent: int = 30
    gram_limits: tuple[tuple[int, float], ...] = ((5, 0.35), (6, 0.33), (8, 0.30), (10, 0.28), (16, 0.25))
    line_limit: float = 0.30
    line_char_limit: float = 0.30
    symbols_per_word: float = 0.10


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, max_gram_coverage double, dup_line_chars long"


def repeated(hashes: Rolling, ids: np.ndarray, offsets: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words inside n-grams that occur at least twice in their document, the first included; ``hashes`` are those of the words."""
    total = len(ids)
    starts = np.flatnonzero(gram_valid(offsets, n, total))
    if len(starts) < 2:
        return np.zeros(total, bool)
    keys = mix64(hashes.grams(n)[starts] ^ (doc[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    left, right = starts[order[same]], starts[order[same + 1]]
    true = doc[left] == doc[right]
    for j in range(n):
        true &= ids[left + j] == ids[right + j]
    return cover(np.unique(np.concatenate([left[true], right[true]])), n, total)


def repeated_lines(text: str) -> tuple[int, int, int]:
    """Lines with a word, those equal to an earlier one, and the characters of the latter."""
    seen, lines, again, chars = set(), 0, 0, 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            lines += 1
            if line in seen:
                again += 1
                chars += len(line)
            seen.add(line)
    return lines, again, chars


def judge(batch: pa.RecordBatch, rules: Rules) -> dict[str, np.ndarray]:
    text = pc.fill_null(batch.column("text"), "")
    words = words_of(text)
    ids, offsets, doc, n_words = words.ids, words.offsets, words.doc, words.counts
    lengths = pc.utf8_length(words.vocab).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = lengths[ids] if len(ids) else np.zeros(0, np.int64)
    word_chars = per_doc(chars, offsets)
    raw = text.to_pylist()
    lines = np.array([repeated_lines(t) for t in raw], np.int64).reshape(len(raw), 3)
    symbols = np.array([len(b) - len(b.translate(None, _SYMBOLS)) for b in (t.encode("utf-8", "surrogatepass") for t in raw)], np.int64)
    hashes = Rolling(mix64(ids.astype(np.uint64) + np.uint64(1)))
    n_repeat = per_doc(repeated(hashes, ids, offsets, doc, rules.base_window), offsets)
    failed = (n_words < rules.min_words) | (100 * n_repeat > rules.base_percent * n_words)
    bad, most = np.zeros(len(raw), bool), np.zeros(len(raw))
    for n, limit in rules.gram_limits:
        share = per_doc(chars * repeated(hashes, ids, offsets, doc, n), offsets) / np.maximum(word_chars, 1)
        bad |= share > limit
        most = np.maximum(most, share)
    all_chars = np.maximum(pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64), 1)
    bad |= (lines[:, 1] > rules.line_limit * np.maximum(lines[:, 0], 1)) & (lines[:, 2] > rules.line_char_limit * all_chars)
    bad |= symbols > rules.symbols_per_word * n_words
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": lines[:, 1], "n_repeat_words": n_repeat, "base_failed": failed, "kept": ~failed & ~bad, "max_gram_coverage": most, "dup_line_chars": lines[:, 2]}


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Measures and verdict of every document: one row per input row, columns as in SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = judge(batch, rules)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(v) for v in found.values())], names=["doc_id", *found])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def filter_quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged. The verdict is taken in the same pass, without a join."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield batch.filter(pa.array(judge(batch, rules)["kept"]))

    return docs.mapInArrow(run, schema)
