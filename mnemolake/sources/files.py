"""Folders of tables in any store that Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


def filesystem(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = filesystem(spark, path)
    return fs.exists(at)


def deleted(spark: SparkSession, path: str) -> None:
    at, fs = filesystem(spark, path)
    fs.delete(at, True)


def renamed(spark: SparkSession, old: str, new: str) -> bool:
    """Rename a folder or file; False, and nothing is done, if there is one of the new name."""
    a, fs = filesystem(spark, old)
    b, _ = filesystem(spark, new)
    return not fs.exists(b) and fs.rename(a, b)
