"""Chat formatting from an event log, with DataFrame operations only.

A log row is an event of a conversation: `message` opens a message, `delta` appends to the turn's
last message, `edit` replaces its text, `regenerate` empties it. Events are partitioned by conversation
and turn, sorted by sequence and folded into final messages; messages are rendered in parts of PART
turns, so that a very long conversation is spread over many rows until its parts are put together.

Template: <s>[ROLE]role[/ROLE]text</s> for each turn. In roles and texts a backslash becomes two, the
first character of a control string becomes \\l (for <) or \\b (for [); the reverse is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import let, running

#: Turn numbers that make up one rendered part.
PART = 64
LOSS_ROLES = ("assistant",)
EVENTS = ("message", "delta", "edit", "regenerate")


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.regexp_replace(out, r"<(?=/?s>)", r"\\l")
    return F.regexp_replace(out, r"\[(?=/?(?:ROLE|INST|SYS)\])", r"\\b")


def unescaped(text: Column) -> Column:
    pieces = F.transform(F.split(text, r"\\\\", -1), lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")))
    return F.array_join(pieces, "\\")


def folded(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, messages (array of role, text) for each conversation and turn.

    events: conv_id, turn, seq, event, role, text; other columns, whatever their names, are ignored. Null role and text are
    empty; null events are messages; null conv_id is a conversation and null turn or seq sorts first. Ties of seq are ordered by
    event, role and text, and equal rows all count. A delta, edit or regeneration of a turn without a message opens one. An
    empty log gives no rows. A turn's log is one row: its texts are joined once each, however many deltas there are.
    """
    one = F.struct(
        F.col("seq").cast("bigint").alias("seq"),
        F.array_position(F.array(*map(F.lit, EVENTS)), F.coalesce("event", F.lit("message"))).alias("kind"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def final(log: Column) -> Column:
        """A message: what follows the last event that sets its text, joined."""
        last = F.array_max(F.filter(F.transform(log, lambda e, i: F.when((i == 0) | (e["kind"] != 2), i).otherwise(-1)), lambda i: i >= 0))
        start = lambda at: F.when(F.get(log, at)["kind"] == 4, F.lit("")).otherwise(F.get(log, at)["text"])
        text = let(last, lambda at: F.concat(start(at), F.array_join(F.transform(F.slice(log, at + 2, F.size(log)), lambda e: e["text"]), "")))
        return F.struct(F.get(log, 0)["role"].alias("role"), text.alias("text"))

    def messages(log: Column) -> Column:
        opens = F.filter(F.transform(log, lambda e, i: F.when((i == 0) | (e["kind"] <= 1), i).otherwise(-1)), lambda i: i >= 0)

        def cut(at: Column) -> Column:
            until = lambda k: F.coalesce(F.get(at, k + 1), F.size(log))
            return F.transform(at, lambda a, k: let(F.slice(log, a + 1, until(k) - a), final))

        return let(opens, cut)

    grouped = events.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(one)).alias("log"))
    plain = F.transform("log", lambda e: F.struct(e["role"].alias("role"), e["text"].alias("text")))
    return grouped.select("conv_id", "turn", F.when(F.forall("log", lambda e: e["kind"] <= 1), plain).otherwise(let(F.col("log"), messages)).alias("messages"))


def rendered(messages: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, part, formatted, loss_spans (array of start, length in code points of formatted): what a trainer reads.

    A conversation's formatted text is that of its parts in ascending order."""
    bears = lambda m: m["role"].isin(*LOSS_ROLES)
    turn = lambda m: F.concat(F.lit("<s>[ROLE]"), escaped(m["role"]), F.lit("[/ROLE]"), escaped(m["text"]), F.lit("</s>"))
    lengths = F.transform(
        "turns",
        lambda m: F.struct(
            (F.length(escaped(m["role"])) + 16).alias("head"), F.length(escaped(m["text"])).alias("body"), bears(m).alias("loss")
        ),
    )
    def spans(sizes: Column) -> Column:
        ends = running(F.transform(sizes, lambda x: x["head"] + x["body"] + 4), lambda a, b: a + b)
        placed = F.transform(F.arrays_zip(ends.alias("end"), sizes.alias("x")), lambda s: F.struct((s["end"] - s["x"]["body"] - 4).alias("start"), s["x"]["body"].alias("length"), s["x"]["loss"].alias("loss")))
        return F.transform(F.filter(placed, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["length"]))

    groups = messages.withColumn("part", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / part)).groupBy("conv_id", "part")
    turns = groups.agg(F.sort_array(F.collect_list(F.struct("turn", "messages"))).alias("t")).select("conv_id", "part", F.flatten(F.col("t.messages")).alias("turns"))
    return turns.select("conv_id", "part", F.array_join(F.transform("turns", turn), "").alias("formatted"), let(lengths, spans).alias("loss_spans"))


def read_back(parts: DataFrame) -> DataFrame:
    """parts with turns (array of role, text, unescaped) and loss_texts (array, unescaped), read from formatted and loss_spans only."""
    pieces = F.transform(
        F.slice(F.split("formatted", "</s>", -1), 1, F.size(F.split("formatted", "</s>", -1)) - 1),
        lambda x: F.split(F.substring(x, 10, F.length(x)), r"\[/ROLE\]", 2),
    )
    turns = F.transform(pieces, lambda x: F.struct(unescaped(x[0]).alias("role"), unescaped(x[1]).alias("text")))
    losses = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return parts.select("conv_id", "part", "formatted", turns.alias("turns"), losses.alias("loss_texts"))


def format_conversations(events: DataFrame) -> DataFrame:
    """conv_id, part, formatted, loss_spans of an event log. An empty log gives no rows."""
    return rendered(folded(events))
