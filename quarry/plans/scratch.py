"""Settling an intermediate result: written once and read back, so that what follows plans over a plain table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only on a local master without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="quarry-"))
    return _LOCAL[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new name in that folder, removed when the JVM ends."""
    where = f"{folder(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in that folder."""
    spark = df.sparkSession
    where = scratch(spark, name)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)
