"""Tables that are written once and looked into often, in Spark's own Parquet: sorted and with Bloom filters for lookups by
key, in numbered shards of one size, and in partitions of which a retry touches some."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticeworks.operators.ranks import running_sums
from latticeworks.sources.scratch import written

#: Values that Parquet compares one by one in a pushed filter; of a longer list only the range is pushed.
PUSHED = 10

#: Rows of a file that holds many shards, about.
FILE_ROWS = 250_000


def write_indexed(df: DataFrame, path: str, key: str, files: int, group_bytes: int = 16 << 20, page_rows: int = 2000) -> None:
    """Writes a table in order of key, with a Bloom filter over it in each row group, and pages of few rows with their bounds."""
    own = df.repartitionByRange(files, key).sortWithinPartitions(key)
    out = own.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", page_rows)
    out.option("parquet.block.row.count.limit", 50 * page_rows).parquet(path)


def point_lookup(spark: SparkSession, path: str, key: str, values: Sequence) -> DataFrame:
    """Rows of an indexed table for a list of keys. The keys are pushed down in short lists in order, so that row groups and pages without any are never read."""
    wanted = sorted({v for v in values if v is not None})
    table = spark.read.parquet(path)
    lists = [F.col(key).isin(wanted[i : i + PUSHED]) for i in range(0, len(wanted), PUSHED)]
    return table.where(reduce(lambda a, b: a | b, lists)) if lists else table.where("false")


def lookup_many(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """The same for a table of keys of any size: the range of the keys is pushed down, the rest is a semi join."""
    span = keys.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    table = spark.read.parquet(path)
    if span["a"] is None:
        return table.where("false")
    return table.where(F.col(key).between(span["a"], span["b"])).join(keys.select(key).distinct(), key, "left_semi")


def write_shards(df: DataFrame, path: str, order: str, rows: int, ties: Sequence[str] = (), folders: bool = True) -> None:
    """Writes a table in numbered shards of ``rows`` rows in order, the last one shorter: a folder a shard, or, without ``folders``, a row group a shard, many in a file, for tables of so many shards that files would be what costs. Numbers come from ranks, which are sums over ranges, so that they don't depend on who writes what; a second writing gives the same shards."""
    ranked = running_sums(df, order, {"_rank": F.lit(1)}, ties=ties)
    placed = ranked.withColumn("shard", F.floor((F.col("_rank") - 1) / rows))
    count = max(1, -(-df.count() // rows))
    if not folders:
        each = max(1, FILE_ROWS // rows)
        dealt = placed.repartition(min(-(-count // each), 10_000), F.floor(F.col("shard") / each))
        dealt.sortWithinPartitions("shard", "_rank").drop("_rank").write.mode("overwrite").option("parquet.block.row.count.limit", rows).parquet(path)
        return
    placed.repartition(min(count, 10_000), "shard").sortWithinPartitions("shard", "_rank").drop("_rank").write.mode("overwrite").partitionBy("shard").parquet(path)


def shard_index(spark: SparkSession, path: str, order: str) -> DataFrame:
    """(shard, rows, first, last): what each shard holds, from the files."""
    table = spark.read.parquet(path)
    return table.groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("first"), F.max(order).alias("last"))


def sample_shards(spark: SparkSession, path: str, shards: int, rows: int, ties: Sequence[str], seed: str = "sample") -> DataFrame:
    """``rows`` random rows of each of ``shards`` random shards of a table that ``write_shards`` wrote: the same for the same seed. Shards are chosen before any row is read, so what is read follows the sample, not the table."""
    table = spark.read.parquet(path)
    digest = lambda *c: F.md5(F.concat_ws("|", F.lit(seed), *(F.col(x).cast("string") for x in c)))
    chosen = [r["shard"] for r in table.select("shard").distinct().orderBy(digest("shard"), "shard").limit(shards).collect()]
    own = table.where(F.col("shard").isin(chosen)) if chosen else table.where("false")
    turn = F.row_number().over(Window.partitionBy("shard").orderBy(digest(*ties), *ties))
    return own.withColumn("_turn", turn).where(F.col("_turn") <= rows).drop("_turn")


def merge_in_place(spark: SparkSession, path: str, retries: DataFrame, key: str, failed: Column, by: str) -> None:
    """Replaces failed rows of a table partitioned by ``by`` with their retries, where there are any; a second merge changes nothing.

    Only the partitions that have retries are read and overwritten; all other files stay as they are. The merged rows are
    written aside first, so that a run that breaks off while it overwrites can be repeated from the retries and what stands.
    """
    table = spark.read.parquet(path)
    touched = retries.select(by).distinct()
    old = table.join(touched, by, "left_semi")
    values = [c for c in table.columns if c not in (key, by)]
    new = retries.select(by, key, *(F.col(c).alias(f"_new_{c}") for c in values), F.lit(True).alias("_retried"))
    use = failed & F.coalesce(F.col("_retried"), F.lit(False))
    merged = old.join(new, [by, key], "left").select(*(F.when(use, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))
    written(merged, "merge").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
