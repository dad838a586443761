"""State over streams: results that age, late rows, and restarts from a checkpoint."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mnemolake.streaming import capture as C
from mnemolake.streaming import state as St


@pytest.fixture
def probes(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id < 40")
    return events.select(F.col("user_id").cast("string").alias("key"), "event_id", (F.col("event_type") != "error").alias("ok"), F.col("ts").cast("timestamp").alias("ts"))


def parts(rows, n, path):
    """Written one after another in order of time."""
    at = [r["ts"] for r in rows.select("ts").orderBy("ts").collect()]
    cuts = [at[len(at) * i // n] for i in range(1, n)]
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        own = rows.where((F.lit(True) if low is None else F.col("ts") >= low) & (F.lit(True) if high is None else F.col("ts") < high))
        yield own.coalesce(1), path


def test_a_restart_goes_on_from_its_state(spark, probes, tmp_path):
    """Two batches, a restart, two more: failures in a row go over the border; the aged result of each key is told once it is behind the watermark."""
    place, out = str(tmp_path / "in"), str(tmp_path / "out")
    want = {r["event_id"]: (r["failures"], r["ttl"]) for r in St.failure_runs(probes.withColumn("at", F.struct("ts", "event_id"))).select("event_id", "failures", St.result_ttl(F.col("ok"), F.col("failures")).alias("ttl")).collect()}
    for i, (part, path) in enumerate(parts(probes, 4, place)):
        part.write.mode("append").parquet(path)
        if i in (1, 3):
            stream = spark.readStream.schema(probes.schema).option("maxFilesPerTrigger", 1).parquet(place)
            with St.state_store(spark):
                St.ageing_results(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(out)
    checked = {r["event_id"]: (r["failures"], r["ttl"]) for r in found.where("state = 'checked'").collect()}
    assert checked == want and found.where("state = 'checked'").count() == len(want)
    aged = found.where("state = 'aged'").collect()
    assert aged and all(r["event_id"] in want for r in aged) and len({(r["key"], r["event_id"]) for r in aged}) == len(aged)
    assert spark.conf.get(St.ROCKS[0]) != St.ROCKS[1]


def test_a_stream_begins_with_known_failures(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, False, "2024-01-01 00:00:00"), ("b", 2, False, "2024-01-01 00:00:00"), ("a", 3, True, "2024-01-01 00:05:00")], "key string, event_id bigint, ok boolean, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("a", 3)], "key string, failures bigint")
    with St.state_store(spark):
        got = {r["event_id"]: (r["failures"], r["ttl"]) for r in C.drained(St.ageing_results(stream, known)).where("state = 'checked'").collect()}
    assert got == {1: (4, 480.0), 2: (1, 60.0), 3: (0, 900.0)}


def test_late_rows_are_kept_once(spark, tmp_path):
    split = C.splitting_late(str(tmp_path / "out"), 60)
    batches = [[(1, 100), (2, 200)], [(3, 130), (4, 141), (5, 500), (6, None)], [], [(7, 439), (8, 440)]]
    frames = [spark.createDataFrame(b, "id int, s bigint").select("id", F.timestamp_seconds("s").alias("ts")) for b in batches]
    for n, frame in enumerate(frames):
        split(frame, n)
        split(frame, n)  # run again, as after a crash
    side = lambda name: {r["id"] for r in C.split_rows(spark, str(tmp_path / "out"), name, "id int, ts timestamp").collect()}
    assert side("late") == {3, 7} and side("on_time") == {1, 2, 4, 5, 6, 8}


def test_messages_cut_at_every_byte(spark, tmp_path):
    """Chunks of one byte over four batches, some out of turn and some twice, give what all bytes at once do."""
    body = '{"id": "é", "method": "b"}'.encode()
    data = b'{"id": 1, "method": "a"}\n' + b"Content-Length: %d\r\n\r\n" % len(body) + body + b'\n\n{"id": null}\n{"id": 9'
    rows = [("c", i, data[i : i + 1]) for i in range(len(data))] + [("other", 1, b"\n"), ("other", 0, b'{"id": 5}')]
    batches = [[r for r in rows if r[1] % 4 == k] + rows[:3] for k in (3, 1, 0, 2)]
    for batch in batches:
        spark.createDataFrame(batch, "connection string, seq bigint, data binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("connection string, seq bigint, data binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with St.state_store(spark):
        got = sorted(tuple(r) for r in C.drained(St.framed_calls(stream)).collect())
    want = sorted(tuple(r) for r in St.decoded_calls(spark.createDataFrame(rows, "connection string, seq bigint, data binary")).collect())
    assert got == want and [r[:2] for r in got] == [("c", 0), ("c", 1), ("c", 2), ("other", 0)]


def test_chunks_that_wait_share_round_trips_to_the_state():
    """3000 chunks of a connection in three batches, the last first: far fewer accesses to the state than chunks, each message once."""
    import pandas as pd

    class State(dict):
        calls = 0

        def _of(self, key):
            State.calls += 1
            return super().get(key)

        get, getValue, containsKey = lambda self: self._of(0), _of, lambda self, key: self._of(key) is not None
        exists = lambda self: self._of(0) is not None

        def updateValue(self, key, value):
            State.calls += 1
            self[key] = value

        update = lambda self, value: self.updateValue(0, value)

        def removeKey(self, key):
            State.calls += 1
            self.pop(key, None)

    class Handle:
        getValueState = getMapState = lambda self, name, *schemas: State()

    data = "".join(f'{{"id": {i}, "method": "m"}}\n' for i in range(2000)).encode()
    chunks = [(i // 17, data[i : i + 17]) for i in range(0, len(data), 17)]
    framing, found = St.Framing(), []
    framing.init(Handle())
    for rest in (2, 0, 1):
        own = pd.DataFrame([c for c in chunks if c[0] % 3 == rest], columns=["seq", "data"])
        for out in framing.handleInputRows(("c",), iter([own.iloc[::-1], own.head(3)]), None):
            found += list(zip(out["place"], out["id"], strict=True))
    assert found == [(i, str(i)) for i in range(2000)] and len(chunks) > 2500 and State.calls < 40 and not framing.waiting
