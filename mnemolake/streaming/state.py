"""State over streams: turn boundaries by session, captures that are tried again, results that age, and framed messages."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mnemolake.sources import manifest

# Seconds that a good result stays, and a failed one the first time and at most; attempts of a capture.
GOOD_SECONDS, BAD_SECONDS, BAD_MOST, BAD_DOUBLINGS = 900, 60, 3600, 6
ATTEMPTS = 5


def result_ttl(ok: Column, failures: Column) -> Column:
    """Seconds for which a probe's result holds: 900 for a good one; for failures 60, doubled with each, 3600 at most."""
    doubled = F.pow(F.lit(2.0), F.least(F.greatest(failures, F.lit(1)) - 1, F.lit(BAD_DOUBLINGS)))
    return F.when(ok, GOOD_SECONDS).otherwise(F.least(BAD_SECONDS * doubled, F.lit(BAD_MOST))).cast("double")


def still_valid(checked_at: Column, ok: Column, failures: Column, now: Column) -> Column:
    """Whether a cached result may be used now: its age is not negative and below its time."""
    age = now - checked_at
    return F.coalesce((age >= 0) & (age < result_ttl(ok, failures)), F.lit(False))


def failure_runs(probes: DataFrame) -> DataFrame:
    """probes (key, at, ok) with failures: how many in a row up to each, 0 for a good one."""
    w = Window.partitionBy("key").orderBy("at")
    grouped = probes.withColumn("_g", F.sum(F.col("ok").cast("int")).over(w))
    run = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("key", "_g").orderBy("at"))
    return grouped.withColumn("failures", F.when(F.col("ok"), 0).otherwise(run)).drop("_g")


def session_state(turns: DataFrame, idle: str = "2 hours") -> DataFrame:
    """session_id, turn, messages, prompt, ended: a row for each turn that a stream of messages (session_id, ts, role, content) opens or goes on with.

    A session keeps its turn number, its message count and the turn's prompt. A user's message opens a turn, unless it is the prompt before with
    something put in front of it, which host plugins do: then the shorter, earlier wording stays. After `idle` a session's state goes."""
    out = "session_id string, turn bigint, messages bigint, prompt string, ended boolean"
    seconds = int(pd.Timedelta(idle).total_seconds())

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        session = key[0]
        turn, messages, prompt = state.get if state.exists else (0, 0, "")
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(session, turn, messages, prompt, True)], columns=["session_id", "turn", "messages", "prompt", "ended"])
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "role", "content"])
        touched: dict[int, tuple] = {}
        for role, content in zip(rows["role"], rows["content"], strict=True):
            text = (content or "").strip()
            if role == "user" and not (prompt and text.endswith(prompt)):
                turn, messages, prompt = turn + 1, 0, text
            messages += 1
            touched[turn] = (session, turn, messages, prompt, False)
        state.update((turn, messages, prompt))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + seconds * 1000)
        yield pd.DataFrame(list(touched.values()), columns=["session_id", "turn", "messages", "prompt", "ended"])

    watched = turns.select("session_id", "ts", "role", "content").withWatermark("ts", "10 minutes")
    return watched.groupBy("session_id").applyInPandasWithState(fold, out, "turn bigint, messages bigint, prompt string", "append", GroupStateTimeout.EventTimeTimeout)


def capturing(write: Callable[[DataFrame], None], pending: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: what `write` fails on goes to the table `pending` with the error and a count, and no batch stops the stream."""

    def each(batch: DataFrame, number: int) -> None:
        try:
            write(batch)
        except Exception as error:  # noqa: BLE001 a failed capture waits to be tried again
            failed = batch.withColumns({"error": F.lit(str(error)[:400]), "attempts": F.lit(1), "batch": F.lit(number).cast("bigint")})
            manifest.append(failed, pending)

    return each


def retry_pending(spark, pending: str, write: Callable[[DataFrame], None], attempts: int = ATTEMPTS) -> int:
    """Try all pending captures again, each failed batch on its own; what fails `attempts` times stays with its last error. Returns how many batches were written."""
    rows = manifest.read(spark, pending)
    if rows is None:
        return 0
    left, done = None, 0
    for (number,) in rows.where(F.col("attempts") < attempts).select("batch").distinct().orderBy("batch").collect():  # a row for each failed batch
        own = rows.where(F.col("batch") == number)
        try:
            write(own.drop("error", "attempts", "batch"))
            done += 1
        except Exception as error:  # noqa: BLE001
            again = own.withColumns({"error": F.lit(str(error)[:400]), "attempts": F.col("attempts") + 1})
            left = again if left is None else left.unionByName(again)
    given_up = rows.where(F.col("attempts") >= attempts)
    manifest.replace(given_up if left is None else given_up.unionByName(left), pending)
    return done


def wait_for(ready: Callable[[], bool], seconds: float = 8.0, every: float = 0.25) -> bool:
    """Ask until something is there, `seconds` at most: a reader's wait for a micro-batch to be committed."""
    end = time.monotonic() + seconds
    while not ready():
        if time.monotonic() >= end:
            return False
        time.sleep(every)
    return True


def frames(buffer: bytes) -> tuple[list[dict], bytes]:
    """Messages at the start of a byte stream, and the rest that is not whole yet: each is JSON on a line, or behind a Content-Length header. No byte is copied or searched twice."""
    found, start, marks = [], 0, {b"\r\n\r\n": -2, b"\n\n": -2}  # where a mark is next; -1: nowhere

    def ahead(mark: bytes) -> int:
        if marks[mark] != -1 and marks[mark] < start:
            marks[mark] = buffer.find(mark, start)
        return marks[mark]

    while True:
        while buffer[start : start + 1] in (b" ", b"\t", b"\r", b"\n"):
            start += 1
        if start >= len(buffer):
            return found, b""
        if buffer[start : start + 15].lower() == b"content-length:":
            mark = next((m for m in marks if ahead(m) >= 0), None)
            if mark is None:
                return found, buffer[start:]
            fields = dict(line.split(":", 1) for line in buffer[start : marks[mark]].decode("ascii", "replace").splitlines() if ":" in line)
            size = next(int(v) for k, v in fields.items() if k.strip().lower() == "content-length")
            begin = marks[mark] + len(mark)
            body, after = buffer[begin : begin + size], begin + size
            if len(body) < size:
                return found, buffer[start:]
        else:
            end = buffer.find(b"\n", start)
            if end < 0:
                return found, buffer[start:]
            body, after = buffer[start:end], end + 1
        found.append(json.loads(body))
        start = after


def decoded_calls(chunks: DataFrame) -> DataFrame:
    """connection, place, method, id, json of a stream's chunks (connection, seq, data: binary), put together in order of seq. A connection's chunks are one group."""
    names = ["connection", "place", "method", "id", "json"]

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        found, _ = frames(b"".join(map(bytes, pdf.sort_values("seq")["data"])))
        rows = [(pdf["connection"].iloc[0], i, m.get("method"), None if m.get("id") is None else str(m["id"]), json.dumps(m, sort_keys=True, ensure_ascii=False)) for i, m in enumerate(found)]
        return pd.DataFrame(rows, columns=names)

    return chunks.groupBy("connection").applyInPandas(whole, "connection string, place bigint, method string, id string, json string")


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def state_store(spark) -> Iterator[None]:
    """Streams that start within have the state store that Ageing needs; the session's setting is as before afterwards."""
    before = spark.conf.get(ROCKS[0])
    spark.conf.set(*ROCKS)
    try:
        yield
    finally:
        spark.conf.set(ROCKS[0], before)


AGED = "key string, event_id bigint, failures bigint, ttl double, state string, at timestamp"


class Ageing(StatefulProcessor):
    """Per key: the failures in a row (a value), the last good results (a map), and a timer at which the newest result has aged."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getValueState("failures", "n bigint")
        self.newest = handle.getMapState("newest", "ok boolean", "event_id bigint, until bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.failures.update((int(initialState["failures"].iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.failures.get()[0] if self.failures.exists() else 0
        own = pd.concat(rows).sort_values(["ts", "event_id"])  # a key's rows of one micro-batch
        out = []
        for ts, event, ok in zip(own["ts"], own["event_id"], own["ok"], strict=True):
            n = 0 if ok else n + 1
            seconds = GOOD_SECONDS if ok else min(BAD_SECONDS * 2 ** min(n - 1, BAD_DOUBLINGS), BAD_MOST)
            out.append((key[0], int(event), n, float(seconds), "checked", ts))
        self.failures.update((n,))
        until = int(ts.timestamp() * 1000 + seconds * 1000)
        self.newest.updateValue((bool(ok),), (int(event), until))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(until)
        yield pd.DataFrame(out, columns=["key", "event_id", "failures", "ttl", "state", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The newest result no longer holds: it is told, and forgotten; the count of failures stays for the next probe."""
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        n = self.failures.get()[0] if self.failures.exists() else 0
        gone = [(k, v) for k, v in self.newest.iterator() if v[1] <= expiredTimerInfo.getExpiryTimeInMs()]
        for k, _ in gone:
            self.newest.removeKey(k)
        yield pd.DataFrame([(key[0], int(v[0]), n, 0.0, "aged", at) for _, v in gone], columns=["key", "event_id", "failures", "ttl", "state", "at"])

    def close(self) -> None:
        pass


def ageing_results(probes: DataFrame, known: DataFrame | None = None, delay: str = "10 minutes") -> DataFrame:
    """A stream of probes (key string, event_id, ok, ts): key, event_id, failures, ttl, state, at; `checked` rows as they come, and an `aged` row once a key's newest
    result is older than its time by the watermark. known: key, failures to begin with. Needs the state store named in ROCKS."""
    watched = probes.withWatermark("ts", delay).groupBy("key")
    return watched.transformWithStateInPandas(Ageing(), AGED, "Append", "EventTime", None if known is None else known.groupBy("key"), "at")


MESSAGES = "connection string, place bigint, method string, id string, json string"
#: Chunks that wait in one entry of the state: each access to the state is a round trip to the JVM, which would take most of the time if each chunk had its own.
TOGETHER = 1024


class Framing(StatefulProcessor):
    """Per connection: the bytes of a message that is not whole yet, the chunk that comes next, and chunks that came before their turn, up to TOGETHER neighbours in an entry."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "rest binary, next bigint, place bigint, last bigint")  # last: no entry after it waits
        self.waiting = handle.getMapState("waiting", "of bigint", "seqs array<bigint>, data array<binary>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rest, following, place, last = self.at.get() or (b"", 0, 0, -1)
        came: dict[int, dict[int, bytes]] = {}
        for pdf in rows:
            for seq, data in zip(pdf["seq"].tolist(), pdf["data"], strict=True):
                if seq >= following:  # others were read already
                    came.setdefault(seq // TOGETHER, {})[seq] = bytes(data or b"")
        held: dict[int, bool] = {}  # entries that were looked at: whether the state has them

        def entry(of: int) -> dict[int, bytes]:
            """The chunks of an entry, of the state and of this batch."""
            own = came.setdefault(of, {})
            if of not in held:
                known = self.waiting.getValue((of,)) if of <= last else None
                held[of] = known is not None
                if known is not None:
                    came[of] = own = dict(zip(known[0], map(bytes, known[1]), strict=True)) | own
            return own

        parts = [bytes(rest)]
        if following in came.get(following // TOGETHER, {}):  # what comes next never waits in the state
            while (data := entry(following // TOGETHER).pop(following, None)) is not None:
                parts.append(data)
                following += 1
        for of in list(came):
            left = entry(of)
            if left:
                self.waiting.updateValue((of,), (list(left), list(left.values())))
                last = max(last, of)
            elif held[of]:
                self.waiting.removeKey((of,))
        found, rest = frames(b"".join(parts))
        self.at.update((rest, following, place + len(found), last))
        out = [(key[0], place + i, m.get("method"), None if m.get("id") is None else str(m["id"]), json.dumps(m, sort_keys=True, ensure_ascii=False)) for i, m in enumerate(found)]
        if out:
            yield pd.DataFrame(out, columns=["connection", "place", "method", "id", "json"])

    def close(self) -> None:
        pass


def framed_calls(chunks: DataFrame) -> DataFrame:
    """decoded_calls() over a stream of chunks (connection, seq from 0, data): a message may begin in one batch and end in a later one, chunks may come out
    of turn or again. A connection's chunks of one batch meet in one task; what waits of it is in the state. Needs the state store named in ROCKS."""
    return chunks.groupBy("connection").transformWithStateInPandas(Framing(), MESSAGES, "Append", "None")
