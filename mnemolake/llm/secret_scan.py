"""Secret scans through a trigram inverted index, with DataFrame operations only.

Each rule's regular expression is turned into a Boolean trigram query (an OR of ANDs over lower-cased
text). Postings (trigram, record) are built for the trigrams that some rule asks for, postings are
intersected by counting the distinct trigrams of each AND, and only records that satisfy a rule's query
are given to its expression. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import free_name, let, running


@dataclass(frozen=True)
class Rule:
    """pattern's group `group` has `least` characters or more, else the match is dropped (after it has used up its text)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, in the order in which they are listed.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)

#: Further kinds, of well-known public token formats. No expression repeats a group (Java's engine recurses there) or starts
#: anew all along a run that it has scanned to its end, so that each takes time in proportion to the text.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # the span begins with the run of characters in which the first header is, so that no place within the run is tried on its own
    Rule("web_token", r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?eyJ)[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
    Rule("live_key", r"sk_live_[0-9A-Za-z]{20,}"),
)
RULES = BASE + MORE

#: Alternatives that a query may have; beyond it, a part of the expression counts as anything.
MOST_BRANCHES = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of lower-case trigrams: a text that matches has all of one of them. None: no mandatory trigrams."""
    done = [(grams | _grams(run)) for grams, run in _walk(sre_parser.parse(pattern), [(frozenset(), "")])]
    if not all(done):
        return None
    unique = set(done)
    return sorted((x for x in unique if not any(y < x for y in unique)), key=sorted)


def _grams(run: str) -> frozenset[str]:
    return frozenset(run[i : i + 3] for i in range(len(run) - 2))


def _stop(states):
    return list(dict.fromkeys((grams | _grams(run), "") for grams, run in states))


def _walk(nodes, states):
    """states: (trigrams so far, literal run that goes on) of each alternative."""
    for op, arg in nodes:
        if op is sre.LITERAL:
            states = [(grams, run + chr(arg).lower()) for grams, run in states]
        elif op is sre.IN and len(arg) <= 6 and all(kind is sre.LITERAL for kind, _ in arg):
            states = [(grams, run + chr(c).lower()) for grams, run in states for _, c in arg]
        elif op is sre.SUBPATTERN:
            states = _walk(arg[-1], states)
        elif op is sre.BRANCH:
            states = [x for branch in arg[1] for x in _walk(branch, states)]
        elif op is sre.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
            states = states + _walk(arg[2], states)
        elif op is sre.MAX_REPEAT and arg[0] >= 1:
            states = _stop(_walk(arg[2], states))
        else:
            states = _stop(states)
        states = list(dict.fromkeys(states))
        if len(states) > MOST_BRANCHES:
            states = [(frozenset.intersection(*(grams | _grams(run) for grams, run in states)), "")]
    return states


SPAN = "struct<start:int,ord:int,kind:string,end:int>"


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, ord, kind, end) of the rule's matches in text, in code points, end exclusive.

    A match's end is the running total of the gaps and matches up to it, in which nothing is appended match by match."""
    lengths = lambda group: F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)), F.length)

    def placed(whole: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole)), F.length)
        ends = running(F.zip_with(gaps, whole, lambda g, w: g + w), lambda a, b: a + b)
        own = whole if not rule.group else lengths(rule.group)
        found = F.transform(
            F.arrays_zip(ends.alias("end"), whole.alias("whole"), own.alias("own")),
            lambda x: F.struct((x["end"] - x["whole"]).alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), x["end"].alias("end"), x["own"].alias("own")),
        )
        return F.transform(F.filter(found, lambda x: x["own"] >= rule.least), lambda x: F.struct(x["start"], x["ord"], x["kind"], x["end"])).cast(f"array<{SPAN}>")

    # a rule of one class has no match before one that is long enough for it
    fast = re.sub(r"\+$", f"{{{rule.least},}}", rule.pattern) if rule.pattern.startswith("[") and not rule.group else rule.pattern
    return F.when(text.rlike(fast), let(lengths(0), placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


def candidates(docs: DataFrame, key: Column, text: Column, rules: tuple[Rule, ...]) -> DataFrame:
    """key, rules (array of kinds whose trigram query the record satisfies), from the inverted index."""
    spark = docs.sparkSession
    branches = [(rule.kind, f"{rule.kind}{b}", gram, len(grams)) for rule in rules for b, grams in enumerate(trigram_query(rule.pattern) or ()) for gram in sorted(grams)]
    asked = sorted({gram for _, _, gram, _ in branches})
    low = docs.select(key.alias("key"), F.lower(text).alias("low"))
    postings = low.select("key", F.explode(F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in asked)))).alias("gram"))
    wanted = spark.createDataFrame(branches, "kind string, branch string, gram string, need int")  # a few rows for each rule
    met = postings.join(F.broadcast(wanted), "gram").groupBy("key", "kind", "branch").agg((F.size(F.collect_set("gram")) == F.max("need")).alias("met"))
    return met.where("met").groupBy("key").agg(F.collect_set("kind").alias("rules"))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the column spans behind its own: array of (start, ord, kind, end), by start, then rule.

    Null and empty texts have no spans; repeated rows each have theirs; an empty table gives no rows; a clashing
    name gets an underscore in front. A text of any length is scanned whole, in time about in proportion to it, with
    any number of matches. Matches of one rule that start together can't be; of several rules that do, the rule listed
    first comes first. The key of the index is a hash of doc_id and text: equal keys of different rows only add
    candidates, which are verified.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64("doc_id", "text")
    names = docs.columns
    own, found = free_name(names, "record_key"), free_name(names, "spans")
    indexed = tuple(r for r in rules if trigram_query(r.pattern) is not None)
    hits = candidates(docs, key, text, indexed)
    joined = docs.withColumn(own, key).join(hits.select(F.col("key").alias(own), F.col("rules").alias(own + "_rules")), own, "left")
    none = F.array().cast(f"array<{SPAN}>")
    lists = []
    for order, rule in enumerate(rules):
        spans = spans_of(text, rule, order)
        lists.append(F.when(F.array_contains(own + "_rules", rule.kind), spans).otherwise(none) if rule in indexed else spans)
    return joined.select(*(F.col(f"`{c}`") for c in names), F.sort_array(F.concat(*lists)).alias(found))


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Code points of the pieces in which a text is cut where spans are replaced, so that no step counts from its start.
PIECE = 1024
MARK = "[REDACTED]"


def kept_intervals(spans: Column, length: Column) -> Column:
    """Array of (a, b), start inclusive, end exclusive: what spans (sorted by start) leave of a text, before, between and after them.
    Overlapping spans are one; of neighbours, each is one."""

    def between(s: Column) -> Column:
        def parts(ends: Column) -> Column:
            places = F.sequence(F.lit(0), F.size(s) - 1)
            heads = F.filter(places, lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(ends, i - 1)))
            before = F.transform(heads, lambda i: F.struct(F.when(i == 0, 0).otherwise(F.get(ends, i - 1)).alias("a"), F.get(s, i)["start"].alias("b")))
            return F.concat(before, F.array(F.struct(F.element_at(ends, -1).alias("a"), length.alias("b"))))

        return let(running(F.transform(s, lambda x: x["end"]), lambda x, y: F.greatest(x, y)), parts)

    return let(spans, between)


def cut_to(text: Column, intervals: Column) -> Column:
    """Intervals of text with MARK between each two."""

    def joined(pieces: Column) -> Column:
        def interval(x: Column) -> Column:
            a, b = (F.floor(x[k] / PIECE).cast("int") for k in "ab")
            first = F.coalesce(F.get(pieces, a), F.lit(""))
            within = F.substring(first, x["a"] - a * PIECE + 1, x["b"] - x["a"])
            tail = F.substring(first, x["a"] - a * PIECE + 1, F.lit(PIECE))
            last = F.substring(F.coalesce(F.get(pieces, b), F.lit("")), F.lit(1), x["b"] - b * PIECE)
            return F.when(a == b, within).otherwise(F.array_join(F.concat(F.array(tail), F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), F.array(last)), ""))

        return F.array_join(F.transform(intervals, interval), MARK)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), joined)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span replaced by [REDACTED]; overlapping spans are one. n_chars, where there is one, follows the text.

    Texts without secrets, null and empty ones stay as they are; repeated rows each are redacted; an empty table gives no rows.
    The columns are those of docs, whatever their names. Texts of any length with any number of spans are cut in one go."""
    found = free_name(docs.columns, "spans")
    kept = free_name([*docs.columns, found], "kept")
    text = F.col("text").cast("string")
    scanned = scan_secrets(docs, rules)
    scanned = scanned.withColumn(kept, F.when(F.size(found) > 0, kept_intervals(F.col(found), F.length(text))))
    columns = []
    for c in docs.columns:
        old = F.col(f"`{c}`")
        if c == "text":
            columns.append(F.when(F.col(kept).isNull(), old).otherwise(cut_to(text, F.col(kept))).alias(c))
        elif c == "n_chars":
            length = F.aggregate(kept, F.lit(-len(MARK)), lambda n, x: n + x["b"] - x["a"] + len(MARK))
            columns.append(F.when(F.col(kept).isNull(), old).otherwise(length).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(old)
    return scanned.select(*columns)
