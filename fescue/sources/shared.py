"""Tables read and written, and lineage cut through the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Any format that Spark reads; a file's columns are read only as they are used."""
    return spark.read.format(kind).options(**options).load(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", **options) -> None:
    df.write.format(kind).mode(mode).options(**options).save(path)


def write_text(text: str, path: str) -> None:
    """A report of a few lines, made on the driver."""
    with open(path, "w") as out:
        out.write(text)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that the driver and all executors see: spark.checkpoint.dir, or one in the warehouse
    where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back, so that loops do not grow plans and lost executors cost no more than a read."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def uncut(*frames: DataFrame) -> None:
    for df in frames:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
