"""Sources and sinks. Readers state their schemas where the format has none; bad files and rows become nulls or are left out, as said."""

from __future__ import annotations

import contextlib
import io
import os
import sqlite3
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A table, or some of its columns: the scan reads only those, row group by row group."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV file with a header, typed by name; a byte-order mark is ignored."""
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", enforceSchema=True)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One file with an array of records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_json_tree(spark: SparkSession, path: str, schema: T.StructType | str, glob: str = "*.json") -> DataFrame:
    """All matching files below a folder, one record a file, with their paths; a file that isn't JSON gives no row. Ids come from paths, not from the order of listing."""
    own = spark.createDataFrame([], schema).schema
    marked = T.StructType([*own.fields, T.StructField("_bad", T.StringType())])
    df = spark.read.schema(marked).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("columnNameOfCorruptRecord", "_bad").json(path, multiLine=True, mode="PERMISSIVE")
    return df.withColumn("path", F.input_file_name()).where("_bad is null").drop("_bad")


#: Fields of a pattern's label and of its phases.
LABEL = "xray_info string, phases array<string>, is_simulated boolean, crystallite_size_nm double, temp_K double"
XRAY, PHASE = "primary_wavelength double, secondary_wavelength double", "lattice string, spacegroup int, chemical_composition string, phase_fraction double"


def decode_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds the fields of a label that is JSON in a string, with JSON strings for the source and each phase inside."""
    parsed = df.withColumn("_l", F.from_json(label, LABEL)).withColumn("_x", F.from_json("_l.xray_info", XRAY))
    phases = F.transform("_l.phases", lambda p: F.from_json(p, PHASE))
    return parsed.select(*df.columns, "_x.primary_wavelength", "_x.secondary_wavelength", phases.alias("phases"), "_l.is_simulated", "_l.crystallite_size_nm", "_l.temp_K")


def two_rows(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x and y of an array that holds them as two columns or as two rows. Two by two is read by columns; three or more points decide by shape."""
    if values.ndim != 2 or 2 not in values.shape:
        raise ValueError(f"not a series: {values.shape}")
    return (values[:, 0], values[:, 1]) if values.shape[1] == 2 else (values[0], values[1])


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """path, md5 and arrays x and y of every .npy file below a folder; arrays of a file that can't be read are null, with the reason as status."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column("content").to_pylist():
                try:
                    x, y = two_rows(np.load(io.BytesIO(content), allow_pickle=False))
                    rows.append((x.astype(float), y.astype(float), "ok"))
                except (ValueError, EOFError, OSError) as e:
                    rows.append((None, None, f"error:{type(e).__name__}"))
            series = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("md5"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (series, series, pa.string()), strict=True))], names=["path", "md5", "x", "y", "status"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", F.md5("content").alias("md5"), "content").mapInArrow(run, "path string, md5 string, x array<double>, y array<double>, status string")


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, ranges: int = 8) -> DataFrame:
    """A table of an SQLite file that all executors see, read in ranges of its row numbers; write it as Parquet once and look rows up there."""
    own = spark.createDataFrame([], schema).schema
    columns = ", ".join(f'"{f.name}"' for f in own.fields)
    connect = f"file:{path}?mode=ro"
    with contextlib.closing(sqlite3.connect(connect, uri=True)) as db:
        low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    if low is None:
        return spark.createDataFrame([], own)
    width = -(-(high - low + 1) // ranges)
    kind = to_arrow_schema(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                with contextlib.closing(sqlite3.connect(connect, uri=True)) as db:
                    rows = db.execute(f'SELECT {columns} FROM "{table}" WHERE rowid >= ? AND rowid < ?', (low + k * width, low + (k + 1) * width))
                    while part := rows.fetchmany(4096):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), kind, strict=True)], schema=kind)

    return spark.range(0, ranges, 1, ranges).mapInArrow(run, own)


def lookup(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a table by key, one for each id asked for that the table has."""
    return table.join(ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi").dropDuplicates([key])


def matrix_rows(ids: DataFrame, path: str, columns: int, kind: str = "float32", key: str = "row_idx") -> DataFrame:
    """``values``, the row of a row-major matrix file that all executors see, for each row number; null beyond its ends. Only the rows asked for are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.memmap(path, np.dtype(kind), "r").reshape(-1, columns) if os.path.getsize(path) else np.empty((0, columns))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [np.asarray(matrix[i], np.float64) if i is not None and 0 <= i < len(matrix) else None for i in part.column(key).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*part.schema.names, "values"])

    schema = T.StructType([*ids.schema.fields, T.StructField("values", T.ArrayType(T.DoubleType()))])
    return ids.mapInArrow(run, schema)


def log_progress(done: DataFrame, path: str, key: str, reason: Column) -> None:
    """Appends to a progress log: the key of each row that was dealt with, why it was skipped (null: it wasn't) and when."""
    done.select(F.col(key).cast("string").alias("key"), reason.cast("string").alias("reason"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def still_to_do(todo: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Rows that no log entry names, skipped ones included."""
    return todo.join(log.select(F.col("key").alias("_done")).distinct(), F.col(key).cast("string") == F.col("_done"), "left_anti")


def skip_reasons(log: DataFrame) -> DataFrame:
    """reason and n: how many keys were skipped for each reason, by their last entry; what follows a colon is left out."""
    last = log.groupBy("key").agg(F.max_by("reason", "at").alias("reason"))
    return last.where("reason is not null").groupBy(F.substring_index("reason", ":", 1).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def cached_ids(ids: DataFrame, path: str, key: str) -> DataFrame:
    """The distinct ids as text, one a row: written once, read from there ever after."""
    spark = ids.sparkSession
    try:
        return spark.read.schema("id string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    ids.select(F.col(key).cast("string").alias("id")).where("id is not null").distinct().write.parquet(path)
    return spark.read.schema("id string").parquet(path)


def sampled_buckets(df: DataFrame, key: Column, buckets: int, keep: int, seed: str = "sample") -> DataFrame:
    """The rows in ``keep`` of ``buckets`` hash buckets of a key: a repeatable sample without a sort."""
    bucket = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(buckets))
    return df.where(bucket < keep)


def write_table(df: DataFrame, path: str, force: bool = False, fmt: str = "parquet", rows_per_file: int = 0, partition_by: Sequence[str] = ()) -> None:
    """Write a table; without ``force`` an existing one is an error. Shards hold at most ``rows_per_file`` rows, if given."""
    out = df.write.mode("overwrite" if force else "errorifexists").format(fmt)
    if fmt == "csv":
        out = out.option("header", True)
    if rows_per_file:
        out = out.option("maxRecordsPerFile", rows_per_file)
    (out.partitionBy(*partition_by) if partition_by else out).save(path)


def manifest(config: dict[str, object]) -> Column:
    """JSON of a run's settings with a short hash of them and the time in UTC."""
    text = F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in sorted(config.items()))))
    return F.to_json(F.struct(F.substring(F.md5(text), 1, 12).alias("config_hash"), F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).alias("created"), text.alias("config")))


def peak_rows(peaks: Sequence[Column]) -> Column:
    """Parallel peak arrays (centre, amplitude, width, share) as one array of structs: a ragged table in one column."""
    return F.arrays_zip(*peaks)
