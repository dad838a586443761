"""Entry points: the operations of the engine over tables, batch-first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions import citations as C
from mnemolake.functions import query as Q
from mnemolake.functions import vectors as V
from mnemolake.operators import memory as M
from mnemolake.operators import ranking as K
from mnemolake.operators import results as W
from mnemolake.operators import stores as O
from mnemolake.operators import team as T
from mnemolake.sources.files import exists


@dataclass
class Memory:
    """The tables that the operations read. documents: doc_id, path, text; records: as memory_candidates() takes them; team: as team_hits()
    takes them; feedback: memory_id, rating, agent; revisions: memory_id, revision, parent, payload_hash. Those that are None have no plane."""

    documents: DataFrame | None = None
    records: DataFrame | None = None
    team: DataFrame | None = None
    feedback: DataFrame | None = None
    revisions: DataFrame | None = None
    as_of: Column | None = None

    @property
    def now(self) -> Column:
        return F.current_timestamp() if self.as_of is None else self.as_of


def search(memory: Memory, queries: DataFrame, limit: int = 5) -> dict[str, DataFrame]:
    """Hits of each plane for queries (query_id, query), apart: repository, memory, team, and `answers`, which says what may answer."""
    out: dict[str, DataFrame] = {}
    lanes = []
    if memory.documents is not None:
        found = K.search(queries, memory.documents, W.fetch_size(limit))
        out["repository"] = found.where(F.col("rank") <= limit)
        lanes.append(found.where("doc_id is not null").select("query_id", F.lit("repository").alias("plane"), F.col("doc_id").cast("string").alias("id"), F.col("rank").cast("long").alias("place"), F.lit(None).cast("string").alias("role"), "excerpt", F.lit("verified").alias("lane"), F.col("claim_support").alias("support")))
    if memory.records is not None:
        asked = queries.withColumn("vector", V.builtin_vector("query")) if "vector" not in queries.columns else queries
        found = M.memory_search(asked, memory.records, F.unix_micros(memory.now) / 1e6, W.fetch_size(limit))
        out["memory"] = found.where(F.col("place") <= limit)
        rows = found.join(memory.records.select("id", "role", "content", "status", "accepted"), "id").join(queries.select("query_id", "query"), "query_id")
        support = Q.claim_support(Q.query_terms("query"), F.col("content"))["claim_support"]
        lane = F.when(C.promoted(F.col("accepted"), F.col("status")), "verified").otherwise("candidate")
        lanes.append(rows.select("query_id", F.lit("memory").alias("plane"), "id", F.col("place").cast("long").alias("place"), "role", F.col("content").alias("excerpt"), lane.alias("lane"), support.alias("support")))
    if memory.team is not None:
        out["team"] = T.team_hits(queries, memory.team, memory.feedback, memory.now, limit)
    if lanes:
        rows = lanes[0]
        for more in lanes[1:]:
            rows = rows.unionByName(more)
        judged = W.judged_items(rows.join(queries.select("query_id", "query"), "query_id"), limit)
        out["answers"] = W.response(queries, judged)
    return out


def get(memory: Memory, ids: DataFrame) -> DataFrame:
    """doc_id, path, excerpt, line_start, line_end, truncated of documents by id (doc_id, line_start, line_end; null: the first 200 lines), without secrets."""
    safe = O.safe_document(memory.documents).drop("lines")
    rows = safe.join(ids.select("doc_id", F.col("line_start").alias("_a"), F.col("line_end").alias("_b")), "doc_id")
    return rows.select("doc_id", "path", C.window_of(F.col("text"), F.col("_a"), F.col("_b")).alias("w")).select("doc_id", "path", "w.*")


def timeline(memory: Memory, session: str | None = None, limit: int = 50) -> DataFrame:
    return M.timeline(memory.records, session, max(1, min(limit, 500)))


def observe(memory: Memory, session: str, limit: int = 100) -> DataFrame:
    return M.observed(memory.records, session, limit)


def reflect(memory: Memory, queries: DataFrame, limit: int = 8) -> DataFrame:
    """A digest of what memory holds about each question, marked as a candidate."""
    asked = queries if "vector" in queries.columns else queries.withColumn("vector", V.builtin_vector("query"))
    found = M.memory_search(asked, memory.records, F.unix_micros(memory.now) / 1e6, max(1, min(limit, 20)))
    return M.reflected(found, memory.records)


def sync(memory: Memory, root: str, source: str, commit: str, dirty: bool = False) -> DataFrame:
    """The header of the documents' index at a commit, which is built where it is missing."""
    return O.ensure_index(memory.documents.select("path", "text"), root, source, commit, dirty)[1]


def doctor(memory: Memory) -> dict[str, DataFrame]:
    """Tables that say how each plane is: sizes, layers, lifecycle, team."""
    out: dict[str, DataFrame] = {}
    if memory.documents is not None:
        out["repository"] = W.corpus_size(memory.documents)
    if memory.records is not None:
        out["layers"] = memory.records.groupBy("layer").agg(F.count("*").alias("population"))
        out["lifecycle"] = M.lifecycle_counts(memory.records)
    if memory.team is not None:
        out["team"] = T.health(memory.team, memory.feedback, memory.revisions, memory.now)
    return out


def context(memory: Memory, queries: DataFrame, limit: int = 5) -> DataFrame:
    """query_id, section, id, place: repository evidence and team records by kind, in sections that are never ranked against each other."""
    repository = K.search(queries, memory.documents, limit).where("doc_id is not null").select("query_id", F.lit("repository_evidence").alias("section"), F.col("doc_id").cast("string").alias("id"), F.col("rank").alias("place"))
    hits = T.team_hits(queries, memory.team, memory.feedback, memory.now, limit).join(memory.team.select("memory_id", "memory_type"), "memory_id")
    section = F.when(F.col("status") == "candidate", "team_candidates").otherwise(F.col("memory_type"))
    return repository.unionByName(hits.select("query_id", section.alias("section"), F.col("memory_id").cast("string").alias("id"), F.col("rank").alias("place")))


def ingest_scoped(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, report) of requests' messages; see scoped_ingest() and ingest_report()."""
    return M.scoped_ingest(messages), M.ingest_report(messages)


def search_scoped(queries: DataFrame, records: DataFrame, top_k: int = 100) -> DataFrame:
    return M.scoped_search(queries, records, max(1, min(top_k, 100)))


def open_tables(spark: SparkSession, root: str) -> Memory:
    """The tables below a folder, each a Parquet folder by its name; those that are not there have no plane."""
    names = ("documents", "records", "team", "feedback", "revisions")
    return Memory(**{n: spark.read.parquet(f"{root}/{n}") for n in names if exists(spark, f"{root}/{n}")})
