"""Restartable ingestion: streams over files with checkpoints, micro-batch appends, retries, and resumed batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticeworks.registry import Tables, query
from latticeworks.sources import indexed
from latticeworks.sources.indexed import merge_in_place
from latticeworks.sources.scratch import new_path


def event_stream(spark: SparkSession, folder: str, max_files: int = 4, glob: str = "*") -> DataFrame:
    """Events as a stream over a folder of Parquet files, a few files at a time. Their time has no zone, which watermarks refuse, so it is read as UTC time."""
    like = spark.read.option("pathGlobFilter", glob).parquet(folder)
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", glob).parquet(folder)
    return stream.withColumn("ts", F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp"))


def windowed_counts(stream: DataFrame, length: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and type; state older than the watermark is dropped."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def without_repeats(stream: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    """First arrivals by key within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def append_batches(stream: DataFrame, target: str, checkpoint: str, key: str) -> None:
    """Process what there is and stop. A batch is written as a whole under its number, so a batch that is run again after a failure replaces itself: nothing is lost or doubled."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return todo.join(done.select(key), key, "left_anti")


def merge_retries(old: DataFrame, new: DataFrame, key: str, failed: str) -> DataFrame:
    """Old rows, those that had failed replaced by their retry where there is one; a second merge of the same retries changes nothing."""
    columns = [c for c in old.columns if c != key]
    retry = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_retried"))
    use = F.col(failed) & F.coalesce(F.col("_retried"), F.lit(False))
    return old.join(retry, key, "left").select(key, *(F.when(use, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in columns))


def latest(stream: DataFrame, keys: list[str], target: str, checkpoint: str) -> DataFrame:
    """Runs a stream of updates to its end and gives each key's last state. Updates are written as files under the number of their batch, so a batch that is run again replaces itself."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    own = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", target).parquet(f"{target}/batch=*")
    values = [c for c in stream.columns if c not in keys]
    return own.groupBy(*keys).agg(*(F.max_by(c, "batch").alias(c) for c in values))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(t: Tables) -> DataFrame:
    """Daily counts by type, computed by the stream over the events file to its end; state older than the watermark is dropped."""
    place = new_path(t.spark, "window-counts")
    folder = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").inputFiles()[0].rsplit("/", 1)[0]
    # The table is one file beside others, or a folder of its own.
    own = event_stream(t.spark, folder) if folder.endswith("events.parquet") else event_stream(t.spark, t.sf_dir, glob="events.parquet")
    stream = windowed_counts(own)
    found = latest(stream, ["start", "event_type"], f"{place}/out", f"{place}/state")
    return found.withColumn("start", F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("start").cast("timestamp_ntz")))


@query("SELECT event_id, CASE WHEN event_id % 10 = 3 AND event_id % 4 <> 0 THEN round(value * 2, 4) ELSE round(value, 4) END AS value, event_id % 10 = 3 AND event_id % 4 = 0 AS failed FROM events")
def retry_merge(t: Tables) -> DataFrame:
    """Every tenth row had failed; three quarters of the retries came through."""
    bad = F.col("event_id") % 10 == 3
    old = t.events.select("event_id", F.col("value"), bad.alias("failed"))
    new = t.events.where(bad & (F.col("event_id") % 4 != 0)).select("event_id", (F.col("value") * 2).alias("value"), F.lit(False).alias("failed"))
    return merge_retries(old, new, "event_id", "failed").select("event_id", F.round("value", 4).alias("value"), "failed")


@query("SELECT event_id, CASE WHEN event_id % 10 = 3 AND event_id % 4 <> 0 THEN round(value * 2, 4) ELSE round(value, 4) END AS value, event_id % 10 = 3 AND event_id % 4 = 0 AS failed FROM events")
def retry_merge_in_place(t: Tables) -> DataFrame:
    """The same against a store by day: only the days with retries are written again."""
    path, bad = new_path(t.spark, "store"), F.col("event_id") % 10 == 3
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    t.events.select("event_id", "value", bad.alias("failed"), day).write.partitionBy("day").parquet(path)
    new = t.events.where(bad & (F.col("event_id") % 4 != 0)).select("event_id", (F.col("value") * 2).alias("value"), F.lit(False).alias("failed"), day)
    merge_in_place(t.spark, path, new, "event_id", F.col("failed"), "day")
    return t.spark.read.parquet(path).select("event_id", F.round("value", 4).alias("value"), "failed")


@query("SELECT * FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM (SELECT DISTINCT o_orderkey FROM orders) ORDER BY md5('k|' || o_orderkey), o_orderkey LIMIT 100)")
def point_lookup(t: Tables) -> DataFrame:
    """A hundred orders by key out of the whole table, written in order with Bloom filters."""
    path = new_path(t.spark, "orders")
    indexed.write_indexed(t.orders, path, "o_orderkey", files=8)
    keys = t.orders.select("o_orderkey").distinct().orderBy(F.md5(F.concat(F.lit("k|"), F.col("o_orderkey").cast("string"))), "o_orderkey").limit(100)
    return indexed.point_lookup(t.spark, path, "o_orderkey", [r[0] for r in keys.collect()])


@query("SELECT shard, count(*) AS rows, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey, o_custkey) - 1) // 400 AS shard FROM orders) GROUP BY shard")
def shard_index(t: Tables) -> DataFrame:
    """Orders in numbered shards of 400 rows, and what each holds."""
    path = new_path(t.spark, "shards")
    indexed.write_shards(t.orders, path, "o_orderkey", 400, ["o_custkey"], folders=False)
    return indexed.shard_index(t.spark, path, "o_orderkey")


@query("""WITH s AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey, o_custkey) - 1) // 400 AS shard FROM orders), c AS (SELECT DISTINCT shard FROM s ORDER BY md5('sample|' || shard), shard LIMIT 3)
SELECT shard, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY md5('sample|' || o_orderkey || '|' || o_custkey), o_orderkey, o_custkey) AS r FROM s JOIN c USING (shard)) WHERE r <= 20""")
def row_group_sample(t: Tables) -> DataFrame:
    """Twenty orders of each of three random shards; the other shards are not read."""
    path = new_path(t.spark, "shards")
    indexed.write_shards(t.orders, path, "o_orderkey", 400, ["o_custkey"], folders=False)
    return indexed.sample_shards(t.spark, path, 3, 20, ["o_orderkey", "o_custkey"]).select(F.col("shard").cast("long").alias("shard"), "o_orderkey", "o_totalprice")


@query("SELECT user_id, count(*) AS events, count(*) FILTER (WHERE gap > 86400) + 1 AS sessions FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000.0 AS gap FROM events) GROUP BY user_id")
def sessions(t: Tables) -> DataFrame:
    """Runs of a user's events without a gap over a day."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.expr("timestampdiff(MICROSECOND, before, ts)") / 1e6
    return t.events.withColumn("before", F.lag("ts").over(own)).withColumn("gap", gap).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), (F.count_if(F.col("gap") > 86400) + 1).alias("sessions"))
