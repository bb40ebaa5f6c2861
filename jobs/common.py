"""What the jobs share: settings, counted writes, places of tables and the folder of a registered run."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeworks.sources.scratch import new_path

log = logging.getLogger("jobs")


def settings(name: str, path: str | None = None) -> dict:
    """Settings of a job: those beside its code, changed by those of the file at ``path``."""
    own = json.loads((Path(__file__).parent / f"{name}.json").read_text())
    given = json.loads(Path(path).read_text()) if path else {}
    unknown = sorted(set(given) - set(own))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return own | given


def read(spark: SparkSession, path: str, form: str) -> DataFrame:
    """A table in any format that Spark reads; text formats take their column names from the file."""
    reader = spark.read.format(form)
    return (reader.option("header", True).option("inferSchema", True) if form == "csv" else reader).load(path)


def written(df: DataFrame, path: str, by: list[str], what: str) -> DataFrame:
    """Writes a table over what is there and gives it as read back; rows are counted from what was written."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    log.info("wrote %s rows of %s to %s", out.count(), what, path)
    return out


def counted(df: DataFrame, by: str, what: str) -> None:
    """Logs the number of rows of each value of a column with few values."""
    for row in df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(by).limit(100).collect():
        log.info("%s: %s %s", what, row["n"], row[by])


def table_source(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, str]:
    """(folder, pattern) of a table's files, which are a file beside others or a folder of its own."""
    folder = spark.read.parquet(f"{sf_dir}/{name}.parquet").inputFiles()[0].rsplit("/", 1)[0]
    return (folder, "*.parquet") if folder.endswith(f"{name}.parquet") else (sf_dir, f"{name}.parquet")


def arguments(description: str, *names: str):
    """Paths that a job is given, and its settings file."""
    import argparse

    parser = argparse.ArgumentParser(description=description)
    for name in names:
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help="settings that differ from those beside the job")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return parser.parse_args()
