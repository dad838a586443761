"""Structured Streaming: idempotent capture, cursors and call pairing on an event stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.sources.files import exists
from mnemolake.sources.scratch import shared_dir


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table as a stream; its time as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    out = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame) -> DataFrame:
    """All that the stream holds now, through the shared folder, exactly once."""
    spark = stream.sparkSession
    place = f"{shared_dir(spark)}/mnemolake-streams/{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def deduplicated(stream: DataFrame, *keys: str, delay: str = "1 hour") -> DataFrame:
    """One row for each key within the watermark: a replayed turn is captured once."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """window_start, event_type, n by event time; a window closes once the watermark passes it."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")


def paired_stream(requests: DataFrame, responses: DataFrame, within: str = "1 hour") -> DataFrame:
    """Requests with their responses (equal call_id, at most `within` later); state is dropped behind the watermark."""
    a, b = requests.withWatermark("ts", within).alias("a"), responses.withWatermark("ts", within).alias("b")
    met = F.expr(f"a.call_id = b.call_id and b.ts >= a.ts and b.ts <= a.ts + interval {within}")
    return a.join(b, met).select("a.call_id", (F.unix_micros("b.ts") - F.unix_micros("a.ts")).alias("latency_micros"))


def splitting_late(root: str, seconds: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that loses no late row: rows whose ts is more than `seconds` behind the greatest of all batches before go to root/late, the
    others to root/on_time, each batch to a folder of its own. root/marks has the greatest ts up to each batch and is written last, so a batch
    that is run again after a crash is split as before and takes the place of what it wrote: both sides have every row exactly once."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = None
        if number and exists(spark, f"{root}/marks/batch={number - 1}"):
            mark = spark.read.parquet(f"{root}/marks/batch={number - 1}").first()["most"]
        rows = batch.persist(StorageLevel.DISK_ONLY)
        late = F.lit(False) if mark is None else F.coalesce(F.unix_micros("ts") < mark - seconds * 1_000_000, F.lit(False))
        rows.where(~late).write.mode("overwrite").parquet(f"{root}/on_time/batch={number}")
        rows.where(late).write.mode("overwrite").parquet(f"{root}/late/batch={number}")
        most = F.max(F.unix_micros("ts"))
        rows.agg((most if mark is None else F.greatest(most, F.lit(mark))).alias("most")).write.mode("overwrite").parquet(f"{root}/marks/batch={number}")
        rows.unpersist()

    return each


def split_rows(spark: SparkSession, root: str, side: str, schema: str) -> DataFrame:
    """What splitting_late() has written to `on_time` or `late`, batches that are done only."""
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(f"{root}/{side}")
    done = spark.read.schema("most bigint, batch bigint").parquet(f"{root}/marks").select("batch")
    return rows.join(F.broadcast(done), "batch")  # a row a batch
