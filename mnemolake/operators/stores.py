"""Stores as tables: the document index, sources, scenarios, the core profile, bundles, logs; sinks replace whole tables at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolake.functions import citations as C
from mnemolake.functions import text as X
from mnemolake.functions.columns import lines_of, text_of
from mnemolake.sources import manifest

#: Version of the stored index, and the files and bytes of one upload.
INDEX_SCHEMA = 5
BATCH_FILES, BATCH_BYTES = 10, 4 << 20
LINKS_OF_A_DOCUMENT = 32


def replace_table(df: DataFrame, path: str) -> None:
    """Make df the table at path in whole: readers see the old table or the new one, whatever step fails, and df may read path."""
    manifest.replace(df, path)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that replace_table() made; None if there is none."""
    return manifest.read(spark, path)


def append_rows(df: DataFrame, path: str) -> None:
    """Add df to a log table."""
    df.write.mode("append").parquet(path)


# the document index


def resolved_targets(docs: DataFrame) -> DataFrame:
    """path, target: each document's explicit links to other known documents, the raw target first, then beside the document; in order, 32 at most."""
    raw = docs.select("path", F.posexplode(X.link_targets("text")).alias("at", "raw"))
    beside = X.posix_path(F.concat(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), F.col("raw")))
    both = raw.select("path", "at", F.posexplode(F.array(F.regexp_replace(X.posix_path(F.col("raw")), "^[./]+", ""), beside)).alias("way", "target"))
    known = both.join(docs.select(F.col("path").alias("target")), "target")
    first = known.withColumn("_n", F.row_number().over(Window.partitionBy("path", "at").orderBy("way"))).where("_n = 1 and target <> path")
    once = first.groupBy("path", "target").agg(F.min("at").alias("at"))
    return once.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("at", "target"))).where(F.col("_n") <= LINKS_OF_A_DOCUMENT).select("path", "target", F.col("_n").alias("place"))


def indexed(docs: DataFrame) -> DataFrame:
    """path, text, size, dates, links of documents (path, text): what an index holds."""
    links = resolved_targets(docs).groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "target"))), lambda x: x["target"]).alias("links"))  # 32 at most
    own = docs.select("path", "text", F.octet_length("text").cast("bigint").alias("size"), X.document_dates(F.col("path"), F.col("text")).alias("dates"))
    return own.join(links, "path", "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))


def index_header(index: DataFrame, source: str, commit: str, deep: bool) -> DataFrame:
    """One row about an index: version, source, commit, deep, document_count, text_bytes, scale_class."""
    sizes = index.agg(F.count("*").alias("document_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("text_bytes"))
    return sizes.select(F.lit(INDEX_SCHEMA).alias("schema_version"), F.lit(source).alias("source"), F.lit(commit).alias("commit"), F.lit(deep).alias("deep"), "document_count", "text_bytes", C.scale_class(F.col("document_count")).alias("scale_class"))


def index_path(root: str, source: str, commit: str, deep: bool) -> str:
    safe = "".join(c if c.isalnum() or c in "._-" else "_" for c in commit) or "unknown"
    return f"{root.rstrip('/')}/{source}/{safe}-{'deep' if deep else 'default'}"


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(documents, header) of a stored index of this version; None if there is none."""
    header = read_table(spark, f"{path}/header")
    if header is None:
        return None
    return (read_table(spark, f"{path}/documents"), header) if header.first()["schema_version"] == INDEX_SCHEMA else None


def ensure_index(docs: DataFrame, root: str, source: str, commit: str, dirty: bool = False, deep: bool = False) -> tuple[DataFrame, DataFrame]:
    """The index of a commit: the stored one, or a new one, which is stored. A dirty source is always read anew, as its commit does not name what it holds."""
    spark, path = docs.sparkSession, index_path(root, source, commit, deep)
    if not dirty and (found := load_index(spark, path)) is not None:
        return found
    replace_table(indexed(docs), f"{path}/documents")
    replace_table(index_header(read_table(spark, f"{path}/documents"), source, commit, deep).coalesce(1), f"{path}/header")
    return load_index(spark, path)


def index_status(spark: SparkSession, root: str, source: str, commit: str, deep: bool = False) -> dict:
    found = load_index(spark, index_path(root, source, commit, deep))
    row = found[1].first().asDict() if found else {"document_count": 0, "text_bytes": 0, "scale_class": "small", "commit": None}
    return {"exists": found is not None, "current_commit": commit} | {k: row[k] for k in ("document_count", "text_bytes", "scale_class", "commit")}


def load_vectors(spark: SparkSession, path: str, commit: str, width: int) -> DataFrame | None:
    """path, vector of a stored vector table (path, vector, commit, model, dim); None if its commit is another or any vector has another width."""
    table = read_table(spark, path)
    if table is None:
        return None
    bad = table.where((F.col("commit") != commit) | (F.size("vector") != width) | (F.col("dim") != width))
    return None if bad.head(1) else table.select("path", "vector")


def vector_index(docs: DataFrame, encode, model: str, width: int, commit: str, chars: int = 12_000) -> DataFrame:
    """path, vector, model, dim, commit: of each document's path and the start of its text; model and width are those that encoded."""
    text = F.concat("path", F.lit("\n"), F.substring("text", 1, chars))
    return docs.select("path", encode(text).alias("vector"), F.lit(model).alias("model"), F.lit(width).alias("dim"), F.lit(commit).alias("commit"))


# sources and snapshots


def chosen_sources(sources: DataFrame, source: str | None = None, root: str | None = None, default: str | None = None) -> DataFrame:
    """Of configured sources (id, root, ...), those of a root or an id; without either the default, so that corpora never mix unasked."""
    own = sources if root is None else sources.where(F.col("root") == root)
    preferred = source or (default if root is None else None)
    return own if preferred is None else own.where(F.col("id") == preferred)


def added_source(sources: DataFrame, new: DataFrame) -> DataFrame:
    """sources with a new one: rows with its id or its root take its values where it has any."""
    n = F.broadcast(new.limit(1).select(*(F.col(c).alias("_" + c) for c in new.columns)))  # one row
    same = (F.col("id") == F.col("_id")) | (F.col("root") == F.col("_root"))
    merged = sources.join(n, same, "left").select(*(F.coalesce("_" + c, c).alias(c) for c in sources.columns))
    missing = new.join(sources.select(F.col("id").alias("_id"), F.col("root").alias("_root")), (F.col("id") == F.col("_id")) | (F.col("root") == F.col("_root")), "left_anti")
    return merged.unionByName(missing)


def removed_source(sources: DataFrame, source: str) -> DataFrame:
    return sources.where(F.col("id") != source)


def source_views(sources: DataFrame, remote: DataFrame, local: DataFrame) -> DataFrame:
    """id, commit, commit_type, dirty, fetch_error, state: the remote snapshot (id, commit, error) of each source; where it failed, or for sources
    that are local only, the local checkout (id, commit, dirty), with the reason; of sources with a remote, its address without user and password."""
    r = remote.select("id", F.col("commit").alias("_remote"), F.col("error").alias("_error"))
    here = local.select("id", F.col("commit").alias("_local"), "dirty")
    joined = sources.join(r, "id", "left").join(here, "id", "left")
    fetched = ~F.coalesce("local_only", F.lit(False)) & F.col("_error").isNull() & F.col("_remote").isNotNull()
    error = F.when(~fetched & ~F.coalesce("local_only", F.lit(False)), F.coalesce("_error", F.lit("no remote snapshot")))
    dirty = F.when(fetched, False).otherwise(F.coalesce("dirty", F.lit(False)))
    commit = F.when(fetched, F.col("_remote")).otherwise(F.col("_local"))
    shown = [X.redacted_remote("remote").alias("remote")] if "remote" in sources.columns else []
    return joined.select("id", *shown, commit.alias("commit"), F.when(fetched, "remote_snapshot").otherwise("local_worktree").alias("commit_type"), dirty.alias("dirty"), error.alias("fetch_error"), C.freshness(dirty, error, commit).alias("state"))


def safe_listing(listing: DataFrame, unsafe: DataFrame) -> DataFrame:
    """Paths of a listing without those of another: an enumeration from which unsafe paths are taken by force."""
    return listing.join(unsafe.select("path"), "path", "left_anti")


def safe_document(docs: DataFrame) -> DataFrame:
    """Documents (path, text) that may be shown: inside the root, of no secret path, without secrets; lines as an array."""
    ok = C.inside_root(F.col("path")) & ~X.is_secret_path("path") & ~X.has_secret("text")
    return docs.where(ok & F.col("text").isNotNull()).withColumn("lines", lines_of("text"))


# scenarios, profile, conversations


def scenario_rows(new: DataFrame) -> DataFrame:
    """Records of scenarios (path, content, summary): the status that the text says, else candidate; accepted only if it says so."""
    status = C.first_mark("content", "candidate")
    return new.select(X.digest_key("local:L2:", 24, F.col("path")).alias("id"), F.lit("L2").alias("layer"), F.col("path").alias("session_id"), "content", status.alias("status"), (status != "accepted").alias("generated"), (status == "accepted").alias("accepted"))


def written_scenarios(records: DataFrame, new: DataFrame) -> DataFrame:
    """records with scenarios written over those of the same path; the last of a path's wins by content."""
    rows = scenario_rows(new).groupBy("id").agg(*(F.max_by(c, "content").alias(c) for c in ("layer", "session_id", "status", "generated", "accepted")), F.max("content").alias("content"))
    return records.join(rows.select("id"), "id", "left_anti").unionByName(rows.select(records.columns))


def deleted_scenarios(records: DataFrame, paths: DataFrame) -> DataFrame:
    gone = paths.select(F.lit("L2").alias("layer"), F.col("path").alias("session_id"))
    return records.join(gone, ["layer", "session_id"], "left_anti")


def scenario_snapshot(records: DataFrame) -> DataFrame:
    """path, digest of every scenario."""
    return records.where("layer = 'L2'").select(F.col("session_id").alias("path"), F.sha2(text_of("content").cast("binary"), 256).alias("digest"))


def changed_scenarios(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change between two snapshots: added, changed or removed."""
    b, a = before.withColumnRenamed("digest", "_b"), after.withColumnRenamed("digest", "_a")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return b.join(a, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def promoted_scenarios(records: DataFrame, paths: DataFrame) -> DataFrame:
    """records with the scenarios of these paths marked as accepted."""
    hit = paths.select(F.lit("L2").alias("layer"), F.col("path").alias("session_id"), F.lit(True).alias("_hit")).distinct()
    joined = records.join(hit, ["layer", "session_id"], "left")
    now = F.col("_hit").isNotNull() & (text_of("content") != "")
    out = {"content": F.when(now, C.with_marks("content", "accepted", "L2", F.col("session_id"))).otherwise(F.col("content")), "status": F.when(now, "accepted").otherwise(F.col("status")), "generated": F.when(now, False).otherwise(F.col("generated")), "accepted": F.when(now, True).otherwise(F.col("accepted"))}
    return joined.select(*(out[c].alias(c) if c in out else F.col(c) for c in records.columns))


def promoted_profile(profile: Column, scenario: Column, path: Column) -> Column:
    """The profile's text with an accepted scenario behind it; unchanged if it names the scenario as a source already."""
    block = C.with_marks(F.concat(F.lit("# Memory Profile\n\n"), scenario), "accepted", "L3", path)
    old = F.trim(text_of(profile))
    return F.when(F.contains(old, F.concat(F.lit("source_l2: "), path)), profile).when(old == "", block).otherwise(F.concat(old, F.lit("\n\n"), block))


def written_profile(records: DataFrame, content: Column) -> DataFrame:
    """records with the one profile row set to content."""
    spark = records.sparkSession
    row = spark.range(1).select(F.lit("local:L3:profile").alias("id"), F.lit("L3").alias("layer"), F.lit("core/profile").alias("session_id"), content.alias("content"), C.first_mark(content, "accepted").alias("status"), F.lit(False).alias("generated"), F.lit(True).alias("accepted"))
    return records.where("id <> 'local:L3:profile'").unionByName(row.select(records.columns))


def without_messages(records: DataFrame, ids: DataFrame) -> DataFrame:
    """records without the L0 and L1 rows of these ids; other layers stay."""
    return records.join(ids.select("id", F.explode(F.array(F.lit("L0"), F.lit("L1"))).alias("layer")), ["id", "layer"], "left_anti").select(records.columns)


# bundles and uploads


def exported_bundle(records: DataFrame, revisions: DataFrame, feedback: DataFrame) -> DataFrame:
    """part, key, json: a portable bundle as rows in their order, so that it never is one value; records by id, revisions by (memory_id, revision), feedback by (memory_id, feedback_id)."""
    def rows(df: DataFrame, part: int, *keys: str) -> DataFrame:
        return df.select(F.lit(part).alias("part"), F.concat_ws("\0", *(F.lpad(F.col(k).cast("string"), 12, "0") if k == "revision" else F.col(k).cast("string") for k in keys)).alias("key"), F.to_json(F.struct(*sorted(df.columns))).alias("json"))

    return rows(records, 0, "memory_id").unionByName(rows(revisions, 1, "memory_id", "revision")).unionByName(rows(feedback, 2, "memory_id", "feedback_id")).orderBy("part", "key", "json")


def deleted_names(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Names that an upload no longer has."""
    return previous.select("name").subtract(current.select("name"))


#: Names that a shard of an upload has, by and by.
FILES_OF_A_SHARD = 20_000


def upload_batches(files: DataFrame, shards: int | None = None) -> DataFrame:
    """name, shard, batch: files (name, size) dealt into uploads of at most 10 files and 4 MiB (a larger file goes alone), greedily by name.

    Names are dealt into shards first, so that batches fill in parallel; there are as many as it takes for FILES_OF_A_SHARD names each (or `shards`), and
    a shard's names and sizes pass one task in order."""
    import pandas as pd

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name")
        batch = count = total = 0
        out = []
        for size in pdf["size"].tolist():
            if count and (count >= BATCH_FILES or total + size > BATCH_BYTES):
                batch, count, total = batch + 1, 0, 0
            count, total = count + 1, total + size
            out.append(batch)
        return pd.DataFrame({"name": pdf["name"], "shard": pdf["shard"], "batch": out})

    shards = shards or -(-files.count() // FILES_OF_A_SHARD) or 1
    number = F.conv(F.substring(F.md5(F.col("name").cast("binary")), 1, 7), 16, 10).cast("bigint")
    dealt = files.select("name", "size", F.pmod(number, F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").applyInPandas(deal, "name string, shard int, batch int")


def promoted_candidate(candidates: DataFrame) -> DataFrame:
    """slug, path of candidates (id) as they are imported."""
    slug = X.slug(F.col("id"))
    return candidates.select("id", slug.alias("slug"), F.concat(F.lit("candidate/"), slug).alias("path"))
