"""Capture of turns: boundaries by cursors, clean messages, each run once, and the candidate that an answer may leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import text as X
from mnemolake.functions.columns import let

# Bounds of a turn.
MESSAGES, CHARS, SESSION_CHARS, AGENT_CHARS, WORKSPACE_CHARS = 24, 12_000, 240, 120, 500
CANDIDATE_CONFIDENCE = 0.5


def after_cursors(messages: Column, start: Column, cursor: Column) -> Column:
    """Messages (role, content, timestamp) from place `start` on, if there are so many, then those later than the cursor (epoch seconds).

    Messages without a time stay, and where none has a time the cursor is not looked at."""
    at = lambda m: X.epoch_of(m["timestamp"])
    placed = F.when(start.isNotNull() & (start <= F.size(messages)), F.slice(messages, F.greatest(start, F.lit(0)) + 1, F.greatest(F.size(messages), F.lit(1)))).otherwise(messages)
    return let(placed, lambda own: F.when(cursor.isNotNull() & F.exists(own, lambda m: at(m).isNotNull()), F.filter(own, lambda m: at(m).isNull() | (at(m) > cursor))).otherwise(own))


def clean_messages(messages: Column, original: Column) -> Column:
    """The last 24 messages of users and assistants, without secrets and injected context, assistants' without code; the asker's own wording
    (`original`), where the host knows it, stands for the last user message. Empty ones go."""
    wording = X.redact(original, CHARS)

    def cleaned(own: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(own, lambda m, i: F.when(m["role"] == "user", i))), F.lit(-1))
        skip = F.greatest(F.size(own) - MESSAGES, F.lit(0))
        kept = F.filter(F.transform(own, lambda m, i: F.struct(F.trim(m["role"]).alias("role"), m["content"].alias("content"), i.alias("i"))), lambda m: (m["i"] >= skip) & m["role"].isin("user", "assistant"))
        said = lambda m: F.when((wording != "") & (m["i"] == last), wording).otherwise(X.redact(m["content"], CHARS))
        done = F.transform(kept, lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "assistant", X.assistant_text(said(m))).otherwise(said(m)).alias("content")))
        return F.filter(done, lambda m: m["content"] != "")

    return let(messages, cleaned)


def normalised_turns(payloads: DataFrame) -> DataFrame:
    """key, session_id, run_id, agent_id, workspace, messages, problem of turns as hosts send them.

    payloads: session_id, run_id, agent_id, workspace, original_user_text, original_user_message_count, after_timestamp, messages (array of role,
    content, timestamp). A turn needs a user's and an assistant's message, else problem says what is missing. key: of session and run, or of what was said."""
    cursor = X.epoch_of(F.col("after_timestamp"))
    base = payloads.withColumn("messages", clean_messages(after_cursors(F.coalesce("messages", F.array().cast(payloads.schema["messages"].dataType)), F.col("original_user_message_count"), cursor), F.col("original_user_text")))
    has = lambda role: F.exists("messages", lambda m: m["role"] == role)
    session = X.redact(F.coalesce(F.nullif("session_id", F.lit("")), F.lit("unnamed-session")), SESSION_CHARS)
    run = X.redact("run_id", SESSION_CHARS)
    basis = F.when(run != "", run).otherwise(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n"))
    return base.select(
        X.digest_key("", 64, session, basis).alias("key"), session.alias("session_id"), run.alias("run_id"), X.redact("agent_id", AGENT_CHARS).alias("agent_id"), X.redact("workspace", WORKSPACE_CHARS).alias("workspace"), "messages",
        F.when(~has("user"), "no user message").when(~has("assistant"), "no assistant message").alias("problem"),
    )


def fresh_turns(turns: DataFrame, ledger: DataFrame) -> DataFrame:
    """Good turns whose key is not in the ledger (key), each once."""
    return turns.where("problem is null").dropDuplicates(["key"]).join(ledger.select("key"), "key", "left_anti")


def turn_messages(turns: DataFrame) -> DataFrame:
    """session_id, message_index, role, content of turns: what ingest() takes."""
    return turns.select("session_id", F.posexplode("messages").alias("message_index", "m")).select("session_id", "message_index", "m.role", "m.content")


def turn_candidates(turns: DataFrame) -> DataFrame:
    """key, memory_id, memory_type, title, content, confidence, status, idempotency_key of the team candidates that durable answers leave."""
    answers = F.filter("messages", lambda m: m["role"] == "assistant")
    rows = turns.withColumn("answer", F.element_at(answers, -1)["content"]).where(X.is_durable("answer"))
    first = F.substring(F.get(F.split("answer", "\n"), 0), 1, 120)
    return rows.select(
        "key", F.lit(None).cast("string").alias("memory_id"), X.memory_type("answer").alias("memory_type"), first.alias("title"), F.col("answer").alias("content"), F.lit(CANDIDATE_CONFIDENCE).alias("confidence"), F.lit("candidate").alias("status"),
        F.concat(F.lit("capture:"), F.col("key")).alias("idempotency_key"), F.lit(None).cast("string").alias("supersedes"),
    )
