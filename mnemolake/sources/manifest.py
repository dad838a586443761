"""Tables behind a manifest: what a reader sees changes in one rename, and a merge rewrites only the buckets that it touches.

A folder has data folders, written once, and _manifest with a JSON file for each version. A version is written beside and renamed, so it
is there in whole or not at all; readers take the greatest. A crash before the rename leaves the old version, one after it the new one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.sources.files import deleted, exists, filesystem, renamed

#: Buckets of a keyed table. The manifest and the driver have a line for each; a table of 100 TB takes some ten thousand.
BUCKETS = 64
#: Versions whose data stays, so that a reader may end what it began.
KEPT_VERSIONS = 2


def versions(spark: SparkSession, root: str) -> list[int]:
    at, fs = filesystem(spark, f"{root}/_manifest")
    if not fs.exists(at):
        return []
    return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json"))


def load(spark: SparkSession, root: str, version: int) -> dict:
    at, fs = filesystem(spark, f"{root}/_manifest/{version:012d}.json")
    stream = fs.open(at)
    try:
        return json.loads(bytes(b & 255 for b in stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def current(spark: SparkSession, root: str) -> dict | None:
    """The newest version: what was published, and its number under `version`; None if there is none."""
    found = versions(spark, root)
    return load(spark, root, found[-1]) if found else None


def publish(spark: SparkSession, root: str, content: dict, after: int) -> dict:
    """Make content the version behind `after`. Fails if another writer was first. Data folders (`folders`) of versions long past are deleted."""
    version = after + 1
    content = content | {"version": version}
    side, final = f"{root}/_manifest/.{uuid.uuid4().hex}", f"{root}/_manifest/{version:012d}.json"
    at, fs = filesystem(spark, side)
    stream = fs.create(at, False)
    stream.write(bytearray(json.dumps(content, sort_keys=True), "utf-8"))
    stream.close()
    if not renamed(spark, side, final):
        deleted(spark, side)
        raise RuntimeError(f"{root} has a version {version} already: another writer was first")
    _clean(spark, root, version)
    return content


def _clean(spark: SparkSession, root: str, version: int) -> None:
    old = [v for v in versions(spark, root) if v <= version - KEPT_VERSIONS]
    if not old:
        return
    used = {f for v in versions(spark, root) if v not in old for f in load(spark, root, v).get("folders", [])}
    for v in old:
        for folder in set(load(spark, root, v).get("folders", [])) - used:
            deleted(spark, f"{root}/{folder}")
        deleted(spark, f"{root}/_manifest/{v:012d}.json")


def replace(df: DataFrame, root: str) -> None:
    """Make df the table at root in whole; df may read root."""
    spark = df.sparkSession
    before = (current(spark, root) or {"version": 0})["version"]
    folder = f"data/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{root}/{folder}")
    publish(spark, root, {"folders": [folder], "schema": df.schema.json()}, before)


def append(df: DataFrame, root: str) -> None:
    """Add df to the table at root; one writer at a time."""
    spark = df.sparkSession
    state = current(spark, root) or {"version": 0, "folders": [], "schema": df.schema.json()}
    folder = f"data/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{root}/{folder}")
    publish(spark, root, {"folders": [*state["folders"], folder], "schema": state["schema"]}, state["version"])


def _paths(state: dict, root: str, buckets: Iterable[int] | None = None) -> list[str]:
    if "buckets" not in state:
        return [f"{root}/{f}" for f in state["folders"]]
    wanted = None if buckets is None else set(buckets)
    return [f"{root}/{folder}/_bucket={b}" for b, folder in state["buckets"].items() if wanted is None or int(b) in wanted]


def read(spark: SparkSession, root: str, buckets: Iterable[int] | None = None) -> DataFrame | None:
    """The table at root as of its newest version; of a keyed table, certain buckets only. None if there is none."""
    from pyspark.sql.types import StructType

    if (state := current(spark, root)) is None:
        return None
    schema, paths = StructType.fromJson(json.loads(state["schema"])), _paths(state, root, buckets)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def bucket_of(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(n)).cast("int")


def merge(changes: DataFrame, root: str, keys: list[str], gone: DataFrame | None = None, buckets: int = BUCKETS) -> dict:
    """Put changes (one row a key) over the rows with their keys in the table at root, and take out those of `gone` (keys); a new table has `buckets` buckets.

    Only buckets with a key of either are read and written. Gives what was published."""
    spark = changes.sparkSession
    state = current(spark, root) or {"version": 0, "n": buckets, "buckets": {}, "schema": changes.schema.json()}
    n, names = state["n"], changes.columns
    touched = changes.select(*keys) if gone is None else changes.select(*keys).unionByName(gone.select(*keys))
    marks = [r["b"] for r in touched.select(bucket_of(keys, n).alias("b")).distinct().collect()]  # n rows at most
    old = read(spark, root, marks) if state["version"] else None
    rows = changes if old is None else old.select(*names).join(touched.distinct(), keys, "left_anti").select(*names).unionByName(changes)
    folder = f"data/{uuid.uuid4().hex}"
    rows.withColumn("_bucket", bucket_of(keys, n)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{root}/{folder}")
    table = state["buckets"] | {str(b): folder for b in marks}
    table = {b: f for b, f in table.items() if f != folder or exists(spark, f"{root}/{folder}/_bucket={b}")}  # a bucket may have lost all rows
    return publish(spark, root, {"n": n, "buckets": table, "folders": sorted(set(table.values())), "schema": state["schema"], "written": sorted(marks)}, state["version"])
