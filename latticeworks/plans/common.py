"""Frames that several queries start from, with their SQL forms.

Series: each user's events in time order; x runs from 0 to 90 over thirty days, y is the value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticeworks.registry import Tables

SERIES_SQL = """
SELECT user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 28800000000.0::DOUBLE AS x, value AS y,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events"""


def series(t: Tables, spread: Callable[[DataFrame, str], DataFrame] = lambda events, _: events) -> DataFrame:
    """(user_id, i, x, y): points of each user's series, i from 1; ``spread`` may say how events are exchanged by user."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = spread(t.events.select("user_id", "event_id", "ts", "value"), "user_id")
    return events.select("user_id", (micros / 28_800_000_000.0).cast("double").alias("x"), F.col("value").alias("y"), F.row_number().over(order).cast("long").alias("i"))


def by_user() -> Window:
    return Window.partitionBy("user_id").orderBy("i")


#: Deterministic predictions: confidence, truth and scores that hashes of ids decide.
PRED_SQL = """
SELECT l.doc_id, source, lang, quality AS truth, toxic,
  CAST('0x' || substr(md5('p|' || l.doc_id), 1, 6) AS BIGINT) / 16777216.0::DOUBLE AS p,
  CAST('0x' || substr(md5('f|' || l.doc_id), 1, 4) AS BIGINT) % 5 AS fold
FROM labels l JOIN documents d USING (doc_id)"""


def hash_unit(prefix: str, column: str, digits: int = 6):
    """A number in [0, 1) from the md5 of prefix and column."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{prefix}|"), F.col(column).cast("string"))), 1, digits), 16, 10).cast("long") / F.lit(float(16**digits))


def hash_mod(prefix: str, column: str, n: int, digits: int = 4):
    """A number from 0 to n - 1 from the md5 of prefix and column."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{prefix}|"), F.col(column).cast("string"))), 1, digits), 16, 10).cast("long") % n).cast("long")


def predictions(t: Tables) -> DataFrame:
    """Labelled documents with a hashed confidence p and fold."""
    docs = t.documents.select("doc_id", "source", "lang")
    return t.labels.join(docs, "doc_id").select("doc_id", "source", "lang", F.col("quality").alias("truth"), "toxic", hash_unit("p", "doc_id").alias("p"), hash_mod("f", "doc_id", 5).alias("fold"))
