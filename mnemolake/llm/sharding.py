"""Sharding by fixed virtual slots, with DataFrame operations only.

A record's slot is a hash of its key and stays for good. Bytes are summed by slot, and a versioned map
from slots to shards, stored as a table, is dealt so that the shards' bytes are near equal: the
heaviest slot goes to the lightest shard. Rebalancing edits the map (only slots that must move do) and
stores it as the next version.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import written

#: Slots for all time; the map on the driver has so many rows, whatever the input.
SLOTS = 8192

MAP_SCHEMA = "map_version int, slot int, slot_bytes bigint, slot_rows bigint, shard int, first_row bigint"


def slot_sizes(records: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of the slots in use; SLOTS rows at most."""
    found = records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    return [(r["virtual_slot"], r["b"], r["n"]) for r in found.collect()]


def balanced_map(sizes: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """slot: shard. Heaviest slot first, each to the shard with the fewest bytes; ties by number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot, size, _ in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def rebalanced_map(sizes: list[tuple[int, int, int]], old: dict[int, int], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """The map edited: slots move from shards above the mean to those below (new ones start empty)
    until none has more than (1 + tolerance) times the mean bytes, or no move helps. New slots are dealt first."""
    out = {s: k for s, k in old.items() if k < shards}
    load = [0] * shards
    weight = {s: b for s, b, _ in sizes}
    for s, k in out.items():
        load[k] += weight.get(s, 0)
    for s in sorted((s for s in weight if s not in out), key=lambda s: (-weight[s], s)):
        k = min(range(shards), key=lambda k: (load[k], k))
        out[s] = k
        load[k] += weight[s]
    mean = sum(load) / shards
    own: dict[int, list[int]] = {k: [] for k in range(shards)}
    for s in sorted(weight, key=lambda s: (-weight[s], s)):
        own[out[s]].append(s)
    while True:
        high = max(range(shards), key=lambda k: (load[k], -k))
        low = min(range(shards), key=lambda k: (load[k], k))
        if load[high] <= (1 + tolerance) * mean:
            return out
        gap = (load[high] - load[low]) / 2
        move = next((s for s in own[high] if 0 < weight[s] <= gap), None)
        if move is None:
            return out
        own[high].remove(move)
        own[low].append(move)
        own[low].sort(key=lambda s: (-weight[s], s))
        out[move] = low
        load[high] -= weight[move]
        load[low] += weight[move]


def store_map(spark, sizes: list[tuple[int, int, int]], shard_of: dict[int, int], version: int) -> DataFrame:
    """The map as a table: also the number that a slot's first row has in its shard."""
    rows, taken = [], {}
    for slot, size, n in sorted(sizes):
        shard = shard_of[slot]
        rows.append((version, slot, size, n, shard, taken.get(shard, 0)))
        taken[shard] = taken.get(shard, 0) + n
    return written(spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1), f"slot-map-v{version}")


def records_of(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (bytes of the text, null: none, plus 1), text_crc32, virtual_slot; the text is read here only.

    The key is doc_id with the text's checksum, so that rows without an id spread over the slots.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return narrow.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, law ("bytes"), shard, slot (its number in the
    shard, gapless from 0), grown_shard (null under this law), virtual_slot, map_version.

    Null texts have size 1; repeated rows are numbered one by one, ties in any order among equal rows.
    An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    records = written(records_of(docs, slots), "shard-records")
    sizes = slot_sizes(records)
    stored = store_map(spark, sizes, balanced_map(sizes, shards), 1)
    return placed(records, stored)


def placed(records: DataFrame, stored: DataFrame) -> DataFrame:
    """records by a stored map. A slot's rows are ordered within the slot only, so no task sees a whole shard."""
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    one = stored.select(F.col("slot").alias("_slot"), "shard", "first_row", "map_version")
    joined = records.withColumn("_n", F.row_number().over(within) - 1).join(F.broadcast(one), F.col("virtual_slot") == F.col("_slot"))  # SLOTS rows at most
    return joined.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first_row") + F.col("_n")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
