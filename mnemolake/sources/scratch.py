"""Tables written to the shared folder, to cut lineage in a way that survives lost executors."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; our own only where it is unset and all runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local:")) and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/mnemolake-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/mnemolake-plans/{tag}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, tag: str) -> DataFrame:
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep_plans(spark: SparkSession) -> None:
    """Delete all tables of materialised(). Call it when no frame that an operator returned is in use any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/mnemolake-plans")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def snapshot_key(spark: SparkSession, path: str) -> str:
    """A name for the state of a table's files: a digest of their names, sizes and times."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    said = sorted(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for f in files)
    return hashlib.sha256("\n".join(said).encode()).hexdigest()[:24]
