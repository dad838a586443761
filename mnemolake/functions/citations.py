"""Citations, lifecycle marks and result schema as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake.functions.columns import collapsed, let, lines_of, stripped, text_of

# Fixed values.
RAW_PREFIX = "raw/sources/"
NOT_FINAL = ("candidate", "pending", "inferred", "generated", "stale")
NATIVE_SOURCES = ("memory-service", "standalone-memory", "local-memory")
NATIVE_LAYERS = ("L0", "L1", "L2", "L3", "Skill")
#: Characters that make a line distinctive, and of it that are looked for.
DISTINCT_CHARS, NEEDLE_CHARS, WINDOW_LINES, START_LINES = 12, 120, 12, 8


def citation_path(x: Column | str) -> Column:
    """With forward slashes and without the raw-source prefix; null for an empty path."""
    p = F.replace(text_of(x), F.lit("\\"), F.lit("/"))
    return F.when(text_of(x) != "", F.regexp_replace(p, f"^{RAW_PREFIX}", ""))


def inside_root(path: Column) -> Column:
    """Whether a relative path stays below its root."""
    return path.isNotNull() & (path != "") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def located(text: Column, excerpt: Column) -> Column:
    """Struct of line_start and line_end of an excerpt in a text: where all of it stands; else from the first line that holds its
    longest line (of 12 characters or more), 12 lines at most; else the first 8 lines. Null ends for a text without lines."""
    kind = "struct<line_start:int,line_end:int>"

    def place(lines: Column) -> Column:
        n = F.size(lines)
        whole = F.regexp_replace(text_of(excerpt), "^\n+|\n+$", "")

        def known(e: Column) -> Column:
            at = F.call_function("locate", e, text_of(text))
            before = F.substring(text_of(text), F.lit(1), at - 1)
            start = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
            exact = F.struct(start.alias("line_start"), F.least(n, start + F.greatest(F.lit(1), F.size(lines_of(e))) - 1).alias("line_end"))
            own = F.filter(F.transform(lines_of(e), stripped), lambda line: line != "")
            longest = F.array_max(F.transform(own, lambda line, i: F.struct(F.length(line).alias("n"), (-i).alias("i"), line.alias("line"))))
            needle = F.when(longest["n"] >= DISTINCT_CHARS, F.substring(longest["line"], 1, NEEDLE_CHARS))
            hit = F.array_min(F.filter(F.transform(lines, lambda line, i: F.when(F.contains(line, needle), i + 1)), lambda i: i.isNotNull()))
            near = F.struct(hit.alias("line_start"), F.least(n, hit - 1 + F.greatest(F.lit(1), F.least(F.lit(WINDOW_LINES), F.size(own)))).alias("line_end"))
            first = F.struct(F.lit(1).alias("line_start"), F.least(n, F.lit(START_LINES)).alias("line_end"))
            return F.when((e != "") & (at > 0), exact.cast(kind)).when(hit.isNotNull(), near.cast(kind)).when(n > 0, first.cast(kind)).otherwise(F.lit(None).cast(kind))

        return let(whole, known)

    return let(lines_of(text), place)


def validation(text: Column, path: Column, start: Column, end: Column, excerpt: Column, commit: Column, expected: Column) -> Column:
    """Struct of valid, stale and reason of a citation: the path stays inside and has a text, the lines exist, one line of the excerpt of 12
    characters or more (or all of a short one) stands in the cited lines with white space evened out, and the commits do not differ."""
    fail = lambda why: F.struct(F.lit(False).alias("valid"), F.lit(False).alias("stale"), F.lit(why).alias("reason"))

    def judged(lines: Column) -> Column:
        evidence = stripped(excerpt)
        cited = collapsed(F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n"))
        own = F.filter(F.transform(lines_of(evidence), collapsed), lambda line: line != "")
        stale = (F.coalesce(commit, F.lit("")) != "") & (F.coalesce(expected, F.lit("")) != "") & (commit != expected)

        def matched(w: Column) -> Column:
            found = F.exists(own, lambda line: (F.length(line) >= DISTINCT_CHARS) & F.contains(w, line)) | F.contains(w, F.array_join(own, " "))
            return F.when(~found, fail("citation excerpt does not match cited lines")).when(stale, F.struct(F.lit(False).alias("valid"), F.lit(True).alias("stale"), F.lit("commit mismatch").alias("reason"))).otherwise(
                F.struct(F.lit(True).alias("valid"), F.lit(False).alias("stale"), F.lit(None).cast("string").alias("reason")))

        ranged = F.coalesce((start >= 1) & (start <= end) & (end <= F.greatest(F.lit(1), F.size(lines))), F.lit(False))
        return F.when(~ranged, fail("citation line range invalid")).when(evidence == "", fail("citation excerpt missing")).otherwise(let(cited, matched))

    missing = F.coalesce(path, F.lit("")) == ""
    return F.when(missing, fail("citation path missing")).when(~inside_root(path), fail("citation path must stay inside source root")).when(text.isNull(), fail("citation path unavailable")).otherwise(let(lines_of(text), judged))


def native_validation(source: Column, layer: Column, key: Column, evidence: Column) -> Column:
    """reason why a memory citation is not valid; null if it is: a known store, layer and id, and some evidence."""
    return (
        F.when(~F.coalesce(source, F.lit("")).isin(*NATIVE_SOURCES), "not a native memory citation").when(~F.coalesce(layer, F.lit("")).isin(*NATIVE_LAYERS) | (F.coalesce(key, F.lit("")) == ""), "native memory layer or id missing")
        .when(stripped(evidence) == "", "native memory evidence missing")
    )


def evidence_status(status: Column, generated: Column, accepted: Column) -> Column:
    """A status that is not final stays; else generated; else primary if accepted; else the status, or secondary."""
    s = F.lower(text_of(status))
    return F.when(s.isin(*NOT_FINAL), s).when(F.coalesce(generated, F.lit(False)), "generated").when(F.coalesce(accepted, F.lit(False)), "primary").when(s != "", s).otherwise("secondary")


def lifecycle_status(native: Column, status: Column, generated: Column, accepted: Column) -> Column:
    """Of a memory record: accepted, a status that is not final, generated, or verified; of anything else, its evidence status."""
    own = F.when(F.coalesce(accepted, F.lit(False)), "accepted").when(status.isin(*NOT_FINAL), status).when(F.coalesce(generated, F.lit(False)), "generated").otherwise("verified")
    return F.when(native, own).otherwise(status)


def lifecycle_mark(content: Column | str, default: str = "generated") -> Column:
    """Status that marker lines of a text say: accepted if any does, else the first known one."""
    found = F.transform(F.regexp_extract_all(text_of(content), F.lit(r"(?im)^\s*(?:memory_status|status|evidence_status)\s*:\s*([a-z_-]+)\s*$"), F.lit(1)), F.lower)
    known = F.filter(found, lambda s: s.isin("candidate", "pending", "generated", "inferred", "stale"))
    return F.when(F.array_contains(found, "accepted"), "accepted").otherwise(F.coalesce(F.get(known, 0), F.lit(default)))


def first_mark(content: Column | str, default: str = "verified") -> Column:
    """Status of the first `status:` line of a stored record."""
    found = F.lower(F.regexp_extract(text_of(content), r"(?im)^status:\s*(candidate|pending|accepted|generated|stale|verified)\s*$", 1))
    return F.when(found != "", found).otherwise(default)


def _marked(key: str, value: Column):
    line = rf"(?im)^\s*{key}\s*:[^\n]*$"

    def with_mark(x: Column) -> Column:
        head, old = F.regexp_extract(x, rf"(?im)^(\s*{key}\s*:\s*)[^\n]*$", 1), F.regexp_extract(x, line, 0)
        at = F.call_function("locate", old, x)
        new = F.concat(F.substring(x, F.lit(1), at - 1), head, value, F.substring(x, at + F.length(old), F.length(x)))
        return F.when(x.rlike(line), new).otherwise(F.concat(F.lit(f"{key}: "), value, F.lit("\n"), x))

    return with_mark


def with_marks(content: Column | str, status: str, layer: str, source: Column | None = None) -> Column:
    """A text whose marker lines say status and layer (and source_l2): the first of each is replaced, missing ones go in front."""
    out = F.regexp_replace(text_of(content), r"\s+$", "")
    marks = [("status", F.lit(status)), ("evidence_status", F.lit(status)), ("layer", F.lit(layer))] + ([("source_l2", source)] if source is not None else [])
    for key, value in marks:
        out = let(out, _marked(key, value))
    return F.concat(out, F.lit("\n"))


def promoted(accepted: Column, status: Column) -> Column:
    return F.coalesce(accepted, F.lit(False)) | F.lower(stripped(status)).isin("accepted", "verified")


def answerable(echo: Column, support: Column, role: Column) -> Column:
    """Not an echo, and the claim is carried whole, or in part by what an assistant said."""
    return ~echo & ((support == "direct") | ((F.lower(stripped(role)) == "assistant") & (support == "partial")))


def window_of(text: Column, start: Column, end: Column, most: int = 200) -> Column:
    """Struct of excerpt, line_start, line_end and truncated of cited lines; the first `most` lines where none are given."""

    def cut(lines: Column) -> Column:
        n = F.size(lines)
        asked = start.isNotNull() | end.isNotNull()
        a0 = F.greatest(F.lit(1), F.coalesce(start, F.lit(1)))
        b0 = F.greatest(a0, F.coalesce(end, F.least(F.lit(most), n)))
        a = F.when(asked, F.least(a0, F.greatest(n, F.lit(1)))).otherwise(1)
        b = F.when(asked, F.least(b0, F.when(n > 0, n).otherwise(a))).otherwise(F.least(n, F.lit(most)))
        window = F.slice(lines, a, F.greatest(b - a + 1, F.lit(0)))
        return F.struct(F.array_join(window, "\n").alias("excerpt"), a.cast("int").alias("line_start"), b.cast("int").alias("line_end"), (n > F.size(window)).alias("truncated"))

    return let(lines_of(text), cut)


def freshness(dirty: Column, fetch_error: Column, commit: Column) -> Column:
    return F.when(F.coalesce(dirty, F.lit(False)), "dirty").when(fetch_error.isNotNull(), "fallback").when(F.coalesce(commit, F.lit("")) != "", "fresh").otherwise("unknown")


def scale_class(documents: Column) -> Column:
    return F.when(documents < 1000, "small").when(documents < 10_000, "medium").otherwise("large")


def json_text(x: Column, path: str) -> Column:
    """Value at a dotted path of a JSON text; null where it is missing or the text is no JSON."""
    return F.get_json_object(x, "$." + path)


def json_or(x: Column, schema: str, default: Column) -> Column:
    """A JSON text by schema; default for a blank or unreadable one."""
    return F.coalesce(F.from_json(F.nullif(stripped(x), F.lit("")), schema), default)


def yaml_scalar(x: Column, kind: str) -> Column:
    """A value as YAML: null for none, JSON for texts, as it is for numbers; true and false."""
    if kind == "string":
        escaped = F.to_json(F.struct(x.alias("v")))
        return F.when(text_of(x) == "", "null").otherwise(F.substring(escaped, F.lit(6), F.length(escaped) - 6))
    return F.coalesce(F.lower(x.cast("string")), F.lit("null"))


def revision_id(origin: Column, revision: Column) -> Column:
    return F.concat_ws(":", F.when(text_of(origin) == "", "legacy").otherwise(origin), F.coalesce(revision, F.lit(1)).cast("string"))
