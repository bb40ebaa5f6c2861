"""Symbols written in many ways, resolved against a table that the caller gives.

A text lists symbols; each is tried as it stands once compatibility forms, subscripts and dashes are plain, then without
underscores, then without blanks too. The candidates come from a table function, ``symbol_candidates``, which SQL calls on
a table with PARTITION BY: the candidates of a key are ranked over all its rows, and none comes twice.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Subscript digits, dashes, and marks at either end of a symbol.
_PLAIN = str.maketrans("₀₁₂₃₄₅₆₇₈₉−–", "0123456789--")
_MARKS = ".?"
_SEPARATOR = re.compile(r"[|;,]")
#: What writers add, in the order in which it is dropped.
_ADDED = (re.compile("_"), re.compile(r"\s+"))


def listed(text: str | None) -> list[str]:
    """Symbols of a text in order, each once: what stands in parentheses after a symbol is one of its own."""
    out: dict[str, None] = {}
    for part in _SEPARATOR.split(text or ""):
        main, opened, rest = part.strip().partition("(")
        inner, closed, after = rest.partition(")")
        paired = opened and closed and not after and main.strip() and inner.strip() and "(" not in inner and ")" not in main
        for symbol in (main, inner) if paired else (part,):
            if symbol.strip():
                out[symbol.strip()] = None
    return list(out)


def spellings(symbol: str) -> list[str]:
    """The spellings to try, in turn: each drops one more thing that writers add."""
    text = unicodedata.normalize("NFKC", symbol).translate(_PLAIN).strip().strip(_MARKS)
    tried = [text]
    for added in _ADDED:
        text = added.sub("", text)
        if text not in tried:
            tried.append(text)
    return [x for x in tried if x]


class SymbolCandidates:
    """(key, rank, candidate) of a table (key, text): one partition a key, its rows in the order that the call names."""

    def __init__(self):
        self.seen: set[str] = set()

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        keys, ranks, found = [], [], []
        for key, text in zip(rows.column("key").to_pylist(), rows.column("text").to_pylist(), strict=True):
            for candidate in (c for symbol in listed(text) for c in spellings(symbol)):
                if candidate not in self.seen:
                    self.seen.add(candidate)
                    keys.append(key)
                    ranks.append(len(self.seen))
                    found.append(candidate)
        yield pa.table({"key": pa.array(keys, pa.int64()), "rank": pa.array(ranks, pa.int32()), "candidate": pa.array(found, pa.string())})


def register(spark: SparkSession) -> None:
    """Makes ``symbol_candidates`` known to the session's SQL."""
    spark.udtf.register("symbol_candidates", F.arrow_udtf(SymbolCandidates, returnType="key long, rank int, candidate string"))


def candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rank, candidate) over all texts of each key, these in order."""
    spark = df.sparkSession
    register(spark)
    own = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return spark.sql("SELECT * FROM symbol_candidates(TABLE(SELECT key, text FROM {own}) PARTITION BY key ORDER BY text)", own=own)


def resolve(df: DataFrame, key: str, text: str, table: DataFrame) -> DataFrame:
    """(key, number, candidate): the first candidate of each key that the table (symbol, number) has; keys without any are left out."""
    met = candidates(df, key, text).join(table.select(F.col("symbol").alias("candidate"), "number"), "candidate")
    return met.groupBy("key").agg(F.min(F.struct("rank", "number", "candidate")).alias("first")).select("key", "first.number", "first.candidate")
