"""A store of measured series that grows with its input: only files that weren't there before are taken.

    python -m jobs.series_store --events FOLDER --out PATH --checkpoint PATH [--config FILE]

Each file brings points (event_id, ts, user_id, event_type, value, props). A stream over the folder takes the new files and
stops; its checkpoint holds what was taken. A batch is first written to ``arrived`` under its number. Then the days that
it has points of are stated anew, from all that has arrived for them: ``points`` holds a point once, by id, and
``profile`` the acquisition profile of each series on that day. Only those days' partitions are overwritten.

A point without a value had failed; a later arrival with a value takes its place, a failed retry never does, and of
several good ones the last arrival counts, within one arrival the greatest. Late points simply state their day anew,
however late. A batch that is run again after a failure replaces itself under its number and states the same days, so
that the result is the same; so does a run that finds nothing new. A point without an id or time is set aside with the
reason and stays in ``arrived``. A point's day is part of what it is: one id on two days is two points.

Nothing is ordered in a window: all figures are aggregates that Spark adds up before it shuffles, so that one series may
be a third of all points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import arguments, log, settings, table_source
from latticeworks.sources.scratch import new_path

POINT = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, angle double, batch long, reason string, day string"
PROFILE = "user_id long, n_points long, n_failed long, first_angle double, last_angle double, step double, sparse boolean, least double, most double, mean double, spread double, day string"


def cleaned(batch: DataFrame, number: int) -> DataFrame:
    """Points of a batch: the angle is the place in the day from 0 to 90, a value that is no number is a failure."""
    ts = F.col("ts").cast("timestamp_ntz")
    micros = F.expr("timestampdiff(MICROSECOND, date_trunc('DAY', ts), ts)")
    value = F.when(~F.isnan(F.col("value").cast("double")), F.col("value").cast("double"))
    reason = F.when(F.col("event_id").isNull(), "no_id").when(F.col("ts").isNull(), "no_time")
    own = batch.withColumn("ts", ts).select(
        F.col("event_id").cast("long"), F.col("user_id").cast("long"), "ts", "event_type", value.alias("value"), (micros / 960_000_000.0).alias("angle"),
        F.lit(number).cast("long").alias("batch"), reason.alias("reason"), F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("unknown")).alias("day"),
    )
    return own


def points_of(arrived: DataFrame) -> DataFrame:
    """Each point once."""
    rest = [c for c in arrived.columns if c not in ("event_id", "day")]
    best = F.max(F.struct(F.col("value").isNotNull().alias("good"), *(F.col(c) for c in ["batch", *(c for c in rest if c != "batch")])))
    one = arrived.where("reason is null").groupBy("day", "event_id").agg(best.alias("p"))
    return one.select("event_id", *(F.col(f"p.{c}") for c in rest), "day").select(*arrived.columns)


def profiles_of(points: DataFrame, most_step_hours: float) -> DataFrame:
    """The profile of each series on each day; a series is sparse where its mean step is beyond ``most_step_hours``."""
    good = F.when(F.col("value").isNotNull(), F.col("angle"))
    own = points.groupBy("day", "user_id").agg(
        F.count("value").alias("n_points"), F.count_if(F.col("value").isNull()).alias("n_failed"), F.min(good).alias("first_angle"), F.max(good).alias("last_angle"),
        F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"),
    )
    step = F.when(F.col("n_points") > 1, (F.col("last_angle") - F.col("first_angle")) / (F.col("n_points") - 1))
    own = own.withColumn("step", step).withColumn("sparse", F.coalesce(F.col("step") > most_step_hours * 3.75, F.lit(True)))
    return own.select(*(c.split()[0] for c in PROFILE.split(", ")))


def restated(df: DataFrame, path: str) -> None:
    """Overwrites the days that df has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def take_batch(batch: DataFrame, number: int, out: str, most_step_hours: float) -> None:
    spark = batch.sparkSession
    own = f"{out}/arrived/batch={number}"
    cleaned(batch, number).drop("batch").write.mode("overwrite").partitionBy("day").parquet(own)
    new = spark.read.schema(POINT).option("basePath", f"{out}/arrived").parquet(own)
    seen = new.agg(F.count(F.lit(1)).alias("n"), F.count("reason").alias("aside"), F.count_distinct("day").alias("days"), F.min("day").alias("first"), F.max("day").alias("last")).first()
    # Days are partitions: the range leaves out folders when the scan is planned, the days in it when they are known.
    span = F.col("day").between(seen["first"] or "", seen["last"] or "")
    days = new.where(span).select("day").distinct()
    touched = lambda path: spark.read.schema(POINT).option("basePath", path).parquet(path).where(span).join(days, "day", "left_semi").select(*(c.split()[0] for c in POINT.split(", ")))
    restated(points_of(touched(f"{out}/arrived")).drop("reason"), f"{out}/points")
    restated(profiles_of(touched(f"{out}/points"), most_step_hours), f"{out}/profile")
    log.info("batch %s: took %s points, set %s aside, stated %s days anew", number, seen["n"], seen["aside"], seen["days"])


def run(spark: SparkSession, events: str, out: str, checkpoint: str, config: dict) -> DataFrame:
    """Takes what is new in the folder and gives the whole profile as it stands."""
    like = spark.read.option("pathGlobFilter", config["pattern"]).parquet(events)
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", config["max_files"]).option("pathGlobFilter", config["pattern"]).parquet(events)
    query = stream.writeStream.foreachBatch(lambda batch, number: take_batch(batch, number, out, config["most_step_hours"])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %s new points from %s in %s batches", sum(p["numInputRows"] for p in query.recentProgress), events, len(query.recentProgress))
    profile = spark.read.schema(PROFILE).parquet(f"{out}/profile")
    log.info("%s holds the profiles of %s days and series", out, profile.count())
    return profile


def job2_series_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the whole table into one new folder: the second finds nothing new."""
    place = new_path(spark, "job2")
    folder, pattern = table_source(spark, sf_dir, "events")
    for _ in range(2):
        profile = run(spark, folder, f"{place}/out", f"{place}/checkpoint", settings("series_store") | {"pattern": pattern})
    rounded = [F.round(c, 6).alias(c) for c in ("first_angle", "last_angle", "step", "least", "most", "mean", "spread")]
    return profile.select("day", "user_id", "n_points", "n_failed", "sparse", *rounded)


ORACLE_SQL = """
WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN NOT isnan(value) THEN value END AS v, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 960000000.0::DOUBLE AS angle FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day, event_id ORDER BY v IS NULL, user_id DESC NULLS LAST, ts DESC, event_type DESC NULLS LAST, v DESC) AS r FROM e) WHERE r = 1),
g AS (
  SELECT day, user_id, count(v) AS n_points, count(*) - count(v) AS n_failed, min(angle) FILTER (WHERE v IS NOT NULL) AS first_angle, max(angle) FILTER (WHERE v IS NOT NULL) AS last_angle,
    min(v) AS least, max(v) AS most, avg(v) AS mean, stddev_pop(v) AS spread FROM p GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN n_points > 1 THEN (last_angle - first_angle) / (n_points - 1) END AS step FROM g)
SELECT day, user_id, n_points, n_failed, coalesce(step > 90.0, true) AS sparse, round(first_angle, 6) AS first_angle, round(last_angle, 6) AS last_angle, round(step, 6) AS step,
  round(least, 6) AS least, round(most, 6) AS most, round(mean, 6) AS mean, round(spread, 6) AS spread FROM s
"""


def main() -> None:
    args = arguments("A store of series that takes what is new.", "events", "out", "checkpoint")
    spark = SparkSession.builder.appName("series-store").getOrCreate()
    try:
        run(spark, args.events, args.out, args.checkpoint, settings("series_store", args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
