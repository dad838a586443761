"""Shared pieces of the training-data operators: scratch tables, models of workers, text bytes, column helpers."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on UTF-8 bytes; all other bytes stay, so no multi-byte character is touched.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: As LOWER, and every ASCII byte that is neither a letter nor a digit becomes a space.
ALNUM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER[:128]) + bytes(range(128, 256))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where it is unset and all runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local:")) and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/mnemolake-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/mnemolake"


def written(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends at the files,
    so that a lost executor costs only its own tasks and no later plan computes df again."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_scratch_path"] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from written() that nothing reads any more; its lineage must not be in use."""
    if path := df.__dict__.pop("_scratch_path", None):
        _delete(df.sparkSession, path)


def sweep_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables. Call it when no frame that an operator returned is in use any more."""
    _delete(spark, scratch_dir(spark))


_RESIDENT: dict = {}


def resident(key=None, make: Callable | None = None):
    """The one model that a Python worker keeps between tasks. Spark reuses workers from operator to operator;
    asking for another key (or none) drops the model before, so that what they keep does not add up."""
    if key not in _RESIDENT:
        if _RESIDENT:
            _RESIDENT.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)
        if make is None:
            return None
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bound what a task holds of its Arrow input: the session's batches have `rows` rows at most from now on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def free_name(taken: list[str], name: str) -> str:
    """name, with underscores in front until no column has it (columns compare without case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once even where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of integers under an associative `combine`.

    Two levels, blocks of about the root of the array's size: appending in one fold would copy the array at every step."""
    kind = "array<int>"

    def scanned(items: Column) -> Column:
        start = F.struct(F.lit(None).cast("int").alias("t"), F.array().cast(kind).alias("a"))

        def step(s: Column, x: Column) -> Column:
            t = F.when(s["t"].isNull(), x).otherwise(combine(s["t"], x)).cast("int")
            return F.struct(t.alias("t"), F.concat(s["a"], F.array(t)).alias("a"))

        return F.aggregate(items, start, step, lambda s: s["a"])

    def blocked(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        starts = F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1)
        parts = F.transform(starts, lambda j: scanned(F.slice(v, j * width + 1, width)))

        def joined(p: Column) -> Column:
            totals = scanned(F.transform(p, lambda x: F.element_at(x, -1)))
            return let(totals, lambda t: F.flatten(F.transform(p, lambda x, j: F.when(j == 0, x).otherwise(F.transform(x, lambda y: combine(F.get(t, j - 1), y).cast("int"))))))

        return let(parts, joined)

    return F.when(F.size(values) > 0, let(values, lambda v: F.when(F.size(v) <= 64, scanned(v)).otherwise(blocked(v)))).otherwise(F.array().cast(kind))
