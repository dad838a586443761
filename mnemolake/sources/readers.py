"""Readers and scans: documents, sessions, records, bundles, canonical Markdown, and the projections of supplied tables."""

from __future__ import annotations

import subprocess

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions import text as X
from mnemolake.functions.columns import stripped

# Fixed values of the document scan.
SUFFIXES = ("md", "mdx", "txt", "rst", "yaml", "yml", "json")
EXCLUDED_DIRS = (".git", ".remember", ".cache", ".venv", "venv", "__pycache__", "output", "tmp", "node_modules", "build", "dist")
OPERATIONAL_DIRS = ("skills", "scripts", "tests", "test", "eval", "evals", "fixtures", "logs", "templates")
EXCLUDED_NAMES = ("template.md", "template.yaml", "template.yml")
MOST_BYTES, MOST_INDEX_BYTES = 512 * 1024, 8 * 1024 * 1024
FRONT_MATTER_KEYS = (
    "id", "layer", "status", "kind", "confidence", "valid_until", "accepted_at", "reviewed_by", "agent_id", "source_memory_id", "observed_at", "run_id", "session_id", "scope",
)
SUPPORTED_BUNDLES = (1, 2, 3)
REVIEWED_BUCKETS = ("l1/active", "l1/stale", "l2/accepted", "l3/accepted")
CANDIDATE_BUCKETS = ("inbox/", "l1/candidate", "l2/candidate", "l3/candidate")
MOST_CONTENT, SUMMARY_CHARS, NAMED_FAILURES = 12_000, 400, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scannable(path: Column, size: Column, text: Column, deep: bool = False) -> Column:
    """Whether the document scan takes a file: suffix, names, directories, size, NUL bytes, secrets."""
    parts, name = F.split(path, "/"), F.lower(F.element_at(F.split(path, "/"), -1))
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    ok = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*SUFFIXES) & ~X.is_secret_path(path)
    ok &= ~F.arrays_overlap(dirs, F.array(*map(F.lit, EXCLUDED_DIRS)))
    if not deep:
        ok &= ~F.arrays_overlap(dirs, F.array(*map(F.lit, OPERATIONAL_DIRS))) & ~name.isin(*EXCLUDED_NAMES)
    ok &= size <= F.when(name == "index.yaml", MOST_INDEX_BYTES).otherwise(MOST_BYTES)
    return ok & ~F.contains(text, F.lit("\0")) & ~X.has_secret(text)


def scan_files(spark: SparkSession, root: str, deep: bool = False) -> DataFrame:
    """path (below root), text and size of every file that the scan takes, from any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    text = F.decode("content", "UTF-8")
    start = F.locate(root.rstrip("/").split(":")[-1].lstrip("/") + "/", F.col("path")) + len(root.rstrip("/").split(":")[-1].lstrip("/")) + 1
    found = files.select(F.substring(F.col("path"), start, F.length("path")).alias("path"), text.alias("text"), F.col("length").alias("size"))
    return found.where(scannable(F.col("path"), F.col("size"), F.col("text"), deep))


def scan_tracked(spark: SparkSession, root: str, deep: bool = False) -> DataFrame:
    """path, text and size of the files that a Git checkout tracks and the scan takes. Git lists them on the driver; executors read them from the store."""
    listed = subprocess.run(["git", "-C", root, "ls-files", "-z"], check=True, capture_output=True).stdout.decode("utf-8", "surrogateescape")
    names = spark.createDataFrame([(x,) for x in listed.split("\0") if x], "path string")
    return scan_files(spark, root, deep).join(names, "path", "left_semi")


_HELD: dict[tuple[str, str, bool], DataFrame] = {}


def held_documents(spark: SparkSession, root: str, revision: str, deep: bool = False) -> DataFrame:
    """The scan of a root at a revision, kept in the executors' storage for further reads; another revision of the root lets go of it."""
    key = (root, revision, deep)
    if key not in _HELD:
        for old in [k for k in _HELD if k[0] == root and k[1] != revision]:
            _HELD.pop(old).unpersist()
        _HELD[key] = scan_files(spark, root, deep).persist(StorageLevel.MEMORY_AND_DISK)
    return _HELD[key]


def session_messages(sessions: DataFrame) -> DataFrame:
    """session_id, message_index, role, content, timestamp of sessions with an array `messages`; blank roles and contents go."""
    kept = F.filter("messages", lambda m: (F.trim(F.coalesce(m["role"], F.lit(""))) != "") & (F.trim(F.coalesce(m["content"], F.lit(""))) != ""))
    rows = sessions.select("session_id", F.posexplode(kept).alias("message_index", "m"))
    return rows.select("session_id", "message_index", F.col("m.role").alias("role"), F.col("m.content").alias("content"), F.coalesce(F.col("m.timestamp").cast("string"), F.lit("")).alias("timestamp"))


def _elements(j: Column) -> Column:
    """The elements of a JSON array, as JSON texts."""
    return F.from_json(j, "array<string>")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """session_id, messages of session payloads: {sessions: [...]}, {session_id, messages}, an array or lines of sessions with a sessionKey, or
    bare messages, which are one session of their file. Messages may stand in lists of lists. Broken JSON is an error."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("v"))
    whole = F.get_json_object("v", "$").isNotNull()
    at = lambda j, k: F.get_json_object(j, f"$.{k}")
    lines = F.filter(F.split("v", r"\r?\n"), lambda x: F.trim(x) != "")
    checked = F.transform(lines, lambda x, i: F.when(at(x, "role").isNotNull() | x.rlike(r"^\s*\{.*\}\s*$"), x).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: line "), (i + 1).cast("string")))))
    rows = F.when(whole & F.col("v").rlike(r"^\s*\["), _elements(F.col("v"))).when(whole & (F.size(lines) == 1) | whole & ~F.col("v").rlike(r"\}\s*\n\s*\{"), F.array("v")).otherwise(checked)
    own = files.select("file", F.posexplode(rows).alias("place", "row"))
    nested = own.where(at(F.col("row"), "sessions").isNotNull()).select("file", F.posexplode(_elements(at(F.col("row"), "sessions"))).alias("place", "row"))
    single = own.where(at(F.col("row"), "sessions").isNull())
    has = F.coalesce(at(F.col("row"), "messages"), at(F.col("row"), "conversations"))
    sessions = nested.unionByName(single.where(has.isNotNull())).select(F.coalesce(at(F.col("row"), "session_id"), at(F.col("row"), "sessionKey"), F.lit("local-session")).alias("session_id"), _elements(has).alias("m"))
    bare = single.where(has.isNull()).groupBy("file", F.coalesce(at(F.col("row"), "sessionKey"), F.lit("local-session")).alias("session_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "row"))), lambda x: x["row"]).alias("m")).drop("file")
    flat = F.when(F.exists("m", lambda x: x.startswith("[")), F.flatten(F.transform(F.filter("m", lambda x: x.startswith("[")), _elements))).otherwise(F.col("m"))
    message = lambda j: F.struct(at(j, "role").alias("role"), at(j, "content").alias("content"), at(j, "timestamp").alias("timestamp"))
    return sessions.unionByName(bare).select("session_id", F.transform(flat, message).alias("messages"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """place, json of a file of objects: an array, or an object a line. Anything else is an error that names its line."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    lines = F.split("v", r"\r?\n")
    rows = F.when(F.col("v").rlike(r"^\s*\["), _elements(F.col("v"))).otherwise(lines)
    each = files.select(F.posexplode(rows).alias("place", "json")).where(F.trim("json") != "")
    good = F.col("json").rlike(r"(?s)^\s*\{.*\}\s*$") & F.get_json_object("json", "$").isNotNull()
    return each.select("place", F.when(good, F.col("json")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: line "), (F.col("place") + 1).cast("string")))).alias("json"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_bundle(spark: SparkSession, path: str, kind: str, records: str, revisions: str, feedback: str) -> dict[str, DataFrame]:
    """The three lists of portable bundles of exactly this kind; another kind or version is an error."""
    raw = spark.read.schema(f"kind string, schema_version int, records array<struct<{records}>>, revisions array<struct<{revisions}>>, feedback array<struct<{feedback}>>").option("multiLine", True).json(path)
    known = (F.col("kind") == kind) & F.coalesce("schema_version", F.lit(1)).isin(*SUPPORTED_BUNDLES)
    if raw.where(~F.coalesce(known, F.lit(False))).head(1):
        raise ValueError("not a bundle of a known kind and version")
    return {name: raw.select(F.inline(name)) for name in ("records", "revisions", "feedback")}


def front_matter(text: Column) -> Column:
    """Map of the known keys of a `---` block at the start; `null` is empty."""
    block = F.when(text.startswith("---"), F.split(text, "---", 3)[1]).otherwise("")
    pairs = F.transform(F.filter(F.split(block, "\r?\n"), lambda line: F.contains(line, F.lit(":"))), lambda line: F.struct(F.trim(F.split(line, ":", 2)[0]).alias("key"), F.trim(F.split(line, ":", 2)[1]).alias("value")))
    known = F.filter(pairs, lambda p: p["key"].isin(*FRONT_MATTER_KEYS))
    clean = F.transform(known, lambda p: F.struct(p["key"].alias("key"), F.regexp_replace(F.regexp_replace(p["value"], '^"+|"+$', ""), "(?i)^null$", "").alias("value")))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(clean, lambda p: p["key"])), lambda k: F.element_at(F.filter(clean, lambda p: p["key"] == k), -1)))


def read_markdown_records(spark: SparkSession, path: str, candidates: bool = True) -> DataFrame:
    """path, id, layer, kind, status, title, summary, content, confidence, reviewed_by, accepted_at, canonical_status, failure of canonical Markdown files.

    Only files in the buckets of reviewed records (and, if asked for, of candidates) count; files without an id or with an unknown status are left
    out. A file that cannot be read as a record keeps its row with the reason in `failure`, and does not stop the others."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    buckets = "|".join((*REVIEWED_BUCKETS, *(CANDIDATE_BUCKETS if candidates else ())))
    place = F.regexp_extract("file", rf"((?:{buckets}).*\.md)$", 1)
    m = raw.withColumn("path", place).where("path <> ''").withColumn("f", front_matter(F.col("text"))).withColumn("body", F.when(F.size(F.split("text", "---", 3)) == 3, F.get(F.split("text", "---", 3), 2)).otherwise(F.col("text")))
    section = lambda name, until: stripped(F.regexp_extract("body", rf"(?s)(?:^|\n)## {name}\s*\n\s*(.*?)(?=\n## {until}\s*\n|\z)", 1))
    at = lambda k: F.try_element_at("f", F.lit(k))
    status = F.coalesce(F.nullif(at("status"), F.lit("")), F.lit("candidate"))
    now = F.when(status == "accepted", "active").otherwise(status)
    content = section("Content", "Evidence")
    confidence = F.coalesce(F.nullif(at("confidence"), F.lit("")), F.lit("0.5"))
    title = stripped(F.regexp_extract("body", r"(?m)^#\s+(.+)$", 1))
    failure = F.when(confidence.try_cast("double").isNull(), "confidence is no number").when(X.has_secret(F.concat(title, F.lit("\n"), content)), "a secret-like value")
    rows = m.where(now.isin("active", "candidate", "stale", "superseded") & (F.coalesce(at("id"), F.lit("")) != ""))
    return rows.select(
        "path", at("id").alias("id"), F.coalesce(at("layer"), F.lit("L1")).alias("layer"), F.coalesce(at("kind"), F.lit("discovery")).alias("kind"), F.when(now.isin("candidate", "active"), now).otherwise("candidate").alias("status"),
        F.when(title == "", at("id")).otherwise(title).alias("title"), F.when(section("Summary", "Content") == "", F.substring(content, 1, SUMMARY_CHARS)).otherwise(section("Summary", "Content")).alias("summary"),
        F.substring(F.when(content == "", stripped("body")).otherwise(content), 1, MOST_CONTENT).alias("content"), confidence.try_cast("double").alias("confidence"), at("reviewed_by").alias("reviewed_by"), at("accepted_at").alias("accepted_at"),
        now.alias("canonical_status"), failure.alias("failure"),
    )


def named_failures(records: DataFrame, most: int = NAMED_FAILURES) -> DataFrame:
    """path, failure of the first files that could not be read."""
    return records.where("failure is not null").select("path", "failure").orderBy("path").limit(most)


# Projections of the supplied tables onto the entities of the engine.


def documents_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, layer (first part), source, text, size; the path is lang/source/doc_<id>.md."""
    path = F.concat_ws("/", "lang", "source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.col("lang").alias("layer"), "source", "text", F.octet_length("text").cast("bigint").alias("size"))


def records_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, message_index, role, content of `conversations`."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("message_index"), "role", F.col("text").alias("content"))


def team_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels as team records."""
    kinds = F.array(*map(F.lit, ("evidence", "decision", "discovery", "failure", "solution", "handoff", "scenario")))
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "stale").when(F.col("quality") == 1, "active").when(F.col("quality") == 0, "superseded").otherwise("candidate")
    return joined.select(
        F.col("doc_id").alias("memory_id"), F.element_at(kinds, (F.col("doc_id") % 7 + 1).cast("int")).alias("memory_type"), status.alias("status"),
        (F.least(F.col("n_chars"), F.lit(4000)) / 4000.0).alias("confidence"), F.col("source").alias("repo"), F.col("text").alias("content"), (F.col("doc_id") % 50).alias("source_memory_id"),
    )


def feedback_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feedback: a rating for each event type."""
    rating = F.when(F.col("event_type") == "purchase", "helpful").when(F.col("event_type") == "click", "not_helpful").when(F.col("event_type") == "error", "wrong").when(F.col("event_type") == "signup", "stale")
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 200).alias("memory_id"), F.col("user_id").cast("string").alias("agent"), rating.alias("rating"), "ts").where("rating is not null")


def revisions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as revisions: memory_id, revision, parent (null for the first), payload_hash."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("memory_id"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    ranked = lines.withColumn("revision", F.expr("row_number() over (partition by memory_id order by line, part, supplier)"))
    return ranked.select("memory_id", "revision", F.when(F.col("revision") > 1, F.col("revision") - 1).alias("parent"), F.substring(F.sha2(F.concat_ws(":", "part", "supplier").cast("binary"), 256), 1, 16).alias("payload_hash"))


def questions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions: query_id, query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
