"""The corpus pipeline: quality rules, near-dedup, secret redaction, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``; later stages work on all that earlier ones kept.

Defined results of every stage: a null text is an empty one; null and repeated ids are documents of their own; texts of any
length are taken whole; columns besides ``doc_id`` and ``text`` (and ``source``, for mixing) come along unread, whatever
their names; an empty table gives an empty result. Repeated rows stay apart but in near-dedup, which keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeworks.llm import mixing, neardup, packing, quality, secrets
from latticeworks.llm._store import materialize
from latticeworks.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: those with an empty text go."""
    return quality.filter_quality(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id (nulls last), of equal ids the one with the smallest uid, and of repeated rows one."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid"))
    kept = neardup.near_duplicates(docs).groupBy("component").agg(first.alias("first")).select("first.uid")
    # Repeated rows are one before they meet, so that a row which is a third of all is a few in each partition's share.
    keyed = docs.select(neardup.row_id().alias("uid"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).dropDuplicates(["uid"])
    return keyed.join(kept, "uid").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; a null text stays null."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as many times as it takes it; those without a word aren't taken."""
    taken = mixing.mix(docs, keep_rows=True).where("repeats > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "repeats"))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids, and their places in sequences of at most 1,024 tokens; an empty text is a piece of its end token."""
    return packing.pack(docs, *vocabulary())


STAGES = [
    ("quality rules", keep_quality),
    ("near-dedup", keep_one_of_each_group),
    ("secret scan", redact_secrets),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither signatures, nor the flow, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{number}")
    return docs
