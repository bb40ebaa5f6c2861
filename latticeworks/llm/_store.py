"""Materialisation in the folder that all executors share.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir``: that cuts the lineage, survives
the loss of any executor and is compressed, unlike an RDD checkpoint.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs on one machine."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        place = spark.conf.get("latticeworks.local.shared", None)
        if not place:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            place = "file://" + tempfile.mkdtemp(prefix="latticeworks-")
            spark.conf.set("latticeworks.local.shared", place)
    return place.rstrip("/")


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(df: DataFrame) -> int:
    """Number of partitions for a shuffle of this session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def remove(table: DataFrame) -> None:
    """Deletes the files of a table that ``materialize`` wrote and that nothing reads any more."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
