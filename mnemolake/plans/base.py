"""Registration of queries, and the SQL of the views that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# SQL of the views in mnemolake.sources.readers.
DOCS = "(SELECT doc_id, lang || '/' || source || '/doc_' || doc_id || '.md' AS path, lang AS layer, source, text, octet_length(encode(text)) AS size FROM documents)"
RECORDS = "(SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS message_index, role, text AS content FROM conversations)"
TEAM = """(SELECT doc_id AS memory_id, (['evidence','decision','discovery','failure','solution','handoff','scenario'])[doc_id % 7 + 1] AS memory_type,
  CASE WHEN toxic = 1 THEN 'stale' WHEN quality = 1 THEN 'active' WHEN quality = 0 THEN 'superseded' ELSE 'candidate' END AS status,
  least(n_chars, 4000) / 4000.0::DOUBLE AS confidence, source AS repo, text AS content, doc_id % 50 AS source_memory_id FROM documents LEFT JOIN labels USING (doc_id))"""
FEEDBACK = """(SELECT event_id, event_id % 200 AS memory_id, CAST(user_id AS VARCHAR) AS agent, ts, CASE event_type WHEN 'purchase' THEN 'helpful' WHEN 'click' THEN 'not_helpful' WHEN 'error' THEN 'wrong' WHEN 'signup' THEN 'stale' END AS rating
  FROM events WHERE event_type IN ('purchase', 'click', 'error', 'signup'))"""
REVISIONS = """(SELECT memory_id, revision, CASE WHEN revision > 1 THEN revision - 1 END AS parent, substr(sha256(part || ':' || supplier), 1, 16) AS payload_hash FROM
  (SELECT l_orderkey AS memory_id, l_partkey AS part, l_suppkey AS supplier, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS revision FROM lineitem))"""
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}./:-]{{2,}}')"
SECRET = r"""(?i)-----BEGIN .*PRIVATE KEY-----|(?:api[_-]?key|access[_-]?token|password|secret)\s*[:=]\s*[''"]?[A-Za-z0-9_\-/.+=]{16,}|\bsk-[A-Za-z0-9_-]{16,}"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register
