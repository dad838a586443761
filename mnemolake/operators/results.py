"""Result surfaces: one schema for every store's hits, planes kept apart, what may answer, and how a turn is judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions import citations as C
from mnemolake.functions import query as Q
from mnemolake.functions import text as X
from mnemolake.functions.columns import text_of
from mnemolake.operators.ranking import term_counts
from mnemolake.operators.retrieval import small

#: How much a compact result keeps.
EXCERPT_CHARS, LIST_ROWS = 6000, 10
#: Names under which stores send the same field, in order of preference.
ALTERNATIVES = {
    "path": ("citation.path", "path", "file_path", "source_path", "metadata.path", "metadata.source_path"),
    "excerpt": ("snippet", "excerpt", "body", "content", "text", "summary", "metadata.excerpt", "metadata.text"),
    "commit": ("citation.commit", "commit", "_commit", "metadata.commit", "metadata.revision"),
    "title": ("title", "name", "heading"),
    "layer": ("memory_layer", "layer", "level", "metadata.memory_layer", "metadata.layer", "metadata.level", "citation.layer"),
    "line_start": ("locator.start_line", "locator.line_start", "citation.line_start", "line_start", "start_line"),
    "line_end": ("locator.end_line", "locator.line_end", "citation.line_end", "line_end", "end_line"),
}


def _pick(x: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(F.get_json_object(x, f"$.{n}"), F.lit("")) for n in names))


def normalised(items: DataFrame, source: str) -> DataFrame:
    """items (key, json) in one schema: key, id, kind, title, path, excerpt, commit, line_start, line_end, layer, tier, ref_kind, evidence_status, generated, accepted, status.

    A native memory keeps its own id; a document is known by source and path."""
    j = F.col("json")
    flag = lambda name: F.coalesce(F.get_json_object(j, f"$.citation.{name}"), F.get_json_object(j, f"$.{name}")) == "true"
    path, store = C.citation_path(_pick(j, ALTERNATIVES["path"])), F.get_json_object(j, "$.citation.source")
    native = store.isin(*C.NATIVE_SOURCES) | (F.get_json_object(j, "$._native_memory") == "true")
    backend = F.coalesce(F.get_json_object(j, "$.citation.memory_id"), F.get_json_object(j, "$.id"))
    status = C.evidence_status(F.coalesce(F.get_json_object(j, "$.evidence_status"), F.get_json_object(j, "$.citation.evidence_status")), F.coalesce(flag("generated"), F.lit(False)), F.coalesce(flag("accepted"), F.lit(False)))
    layer, start = _pick(j, ALTERNATIVES["layer"]), _pick(j, ALTERNATIVES["line_start"]).try_cast("int")
    native = F.coalesce(native, F.lit(False))
    return items.select(
        "key", F.when(native, F.coalesce(F.get_json_object(j, "$.id"), backend)).when(path.isNotNull(), F.concat(F.lit(source + ":"), path)).otherwise(backend).alias("id"),
        F.coalesce(F.get_json_object(j, "$.kind"), F.get_json_object(j, "$.type"), F.lit("adapter")).alias("kind"), F.coalesce(_pick(j, ALTERNATIVES["title"]), path, F.lit("untitled")).alias("title"), path.alias("path"),
        _pick(j, ALTERNATIVES["excerpt"]).alias("excerpt"), _pick(j, ALTERNATIVES["commit"]).alias("commit"), start.alias("line_start"), F.coalesce(_pick(j, ALTERNATIVES["line_end"]).try_cast("int"), start).alias("line_end"),
        layer.alias("layer"), Q.tier(layer).alias("tier"), Q.ref_kind(layer).alias("ref_kind"), status.alias("evidence_status"), F.coalesce(flag("generated"), F.lit(False)).alias("generated"), F.coalesce(flag("accepted"), F.lit(False)).alias("accepted"),
        C.lifecycle_status(native, status, F.coalesce(flag("generated"), F.lit(False)), F.coalesce(flag("accepted"), F.lit(False))).alias("status"),
    )


def flattened(payloads: DataFrame) -> DataFrame:
    """payload_id, lane, source, item (JSON) of responses (payload_id, json): long-term hits, each repository's wiki and code hits, direct results."""
    objects = lambda path: F.filter(F.from_json(F.get_json_object("json", path), "array<string>"), lambda x: x.startswith("{"))
    # the source is read once a response, before its items become rows: beside explode() it would be read from the whole text for each item
    items = lambda rows, lane, by, of: rows.select("payload_id", by.alias("source"), of.alias("_items")).select("payload_id", F.lit(lane).alias("lane"), "source", F.explode("_items").alias("item"))
    plain = lambda path, lane, by: items(payloads, lane, by, objects(path))
    long_term = plain("$.long_term.results", "long_term", F.coalesce(F.get_json_object("json", "$.long_term.query_source"), F.lit("long_term")))
    repositories = payloads.select("payload_id", F.explode(objects("$.repositories")).alias("r"))

    def section(name: str, lane: str) -> DataFrame:
        by = F.coalesce(F.get_json_object("r", f"$.{name}.query_source"), F.lit(lane))
        return items(repositories, lane, by, F.filter(F.from_json(F.get_json_object("r", f"$.{name}.results"), "array<string>"), lambda x: x.startswith("{")))

    return long_term.unionByName(section("memory", "wiki")).unionByName(section("code", "code")).unionByName(plain("$.results", "adapter", F.lit(None).cast("string")))


def route_scores(queries: DataFrame, hits: DataFrame, sources: DataFrame) -> DataFrame:
    """query_id, source, score: 4 for each term of a question in path, title or excerpt of a source's first three hits, 2 for each in its names.

    hits: query_id, source, rank, path, title, excerpt; sources: source, names, position."""
    terms = F.filter(Q.query_terms("query"), lambda t: (F.length(t) >= 3) | t.rlike(X.HAN))
    shown = hits.where("rank <= 3").groupBy("query_id", "source").agg(F.lower(F.concat_ws(" ", F.collect_list(F.concat_ws(" ", "path", "title", "excerpt")))).alias("said"))  # three rows each
    pairs = queries.select("query_id", terms.alias("terms")).join(F.broadcast(sources.select("source", "position", F.lower("names").alias("names"))))  # the configured sources
    joined = pairs.join(shown, ["query_id", "source"], "left")
    n = lambda c: F.size(F.filter("terms", lambda t: F.contains(F.coalesce(c, F.lit("")), t)))
    return joined.select("query_id", "source", "position", (4 * n(F.col("said")) + 2 * n(F.col("names"))).alias("score"))


def interleaved_sources(hits: DataFrame, routes: DataFrame, limit: int) -> DataFrame:
    """query_id, id, source, place: round robin over sources, the best routed first (ties: as configured), each id once, `limit` at most."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "position"))
    ordered = hits.join(routes.withColumn("_s", order).select("query_id", "source", "_s"), ["query_id", "source"])
    ranked = ordered.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank")))
    at = F.struct("_n", "_s")
    once = ranked.withColumn("_first", F.row_number().over(Window.partitionBy("query_id", F.coalesce("id", F.concat_ws(":", "source", "rank"))).orderBy(at))).where("_first = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(at))).where(F.col("place") <= limit).select("query_id", "id", "source", "place")


def fetch_size(limit: int) -> int:
    """Hits to ask a store for, so that `limit` are left when echoes are gone."""
    return max(4 * limit, limit + 12)


def planes(**hits: DataFrame) -> DataFrame:
    """query_id, plane, id, place of several planes' hits, kept apart: scores of one are never set against another's."""
    out = None
    for plane, df in hits.items():
        own = df.select("query_id", F.lit(plane).alias("plane"), F.col("id").cast("string").alias("id"), "place")
        out = own if out is None else out.unionByName(own)
    return out


def judged_items(items: DataFrame, limit: int) -> DataFrame:
    """items (query_id, plane, id, place, query, role, excerpt, lane, support) without echoes, the first `limit` of each plane and lane, with answerable.

    Echoes go before the limit. The wording of a question counts only against memories: a short document that holds it is a citation."""
    echo = F.when(F.col("plane") == "memory", X.is_echo(F.coalesce("role", F.lit("")), F.col("excerpt"), F.col("query"))).otherwise(X.is_question_turn("role", "excerpt"))
    left = items.where(~echo)
    ranked = left.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "plane", "lane").orderBy("place"))).where(F.col("place") <= limit)
    return ranked.withColumn("answerable", (F.col("lane") == "verified") & C.answerable(F.lit(False), F.col("support"), F.coalesce("role", F.lit(""))))


def response(queries: DataFrame, judged: DataFrame) -> DataFrame:
    """query_id, mode, abstain, answered_by, verified, candidates, answerable, claim_abstain: a row for each question.

    Only the repository plane decides whether to abstain; answered_by names all planes with an answer. A negative question is empty."""
    asked = queries.select("query_id", X.intent("query").alias("mode"))
    counts = judged.join(asked.where("mode <> 'negative'"), "query_id", "left_semi").groupBy("query_id").agg(
        F.count_if(F.col("lane") == "verified").alias("verified"), F.count_if(F.col("lane") == "candidate").alias("candidates"), F.count_if(F.col("answerable") & (F.col("plane") == "repository")).alias("answerable"),
        F.array_sort(F.collect_set(F.when(F.col("answerable"), F.col("plane")))).alias("answered_by"),
    )
    out = asked.join(counts, "query_id", "left").fillna(0, ["verified", "candidates", "answerable"])
    abstain = F.col("answerable") == 0
    return out.select("query_id", "mode", abstain.alias("abstain"), F.coalesce("answered_by", F.array().cast("array<string>")).alias("answered_by"), "verified", "candidates", "answerable", (abstain & (F.col("verified") > 0)).alias("claim_abstain"))


def diagnostics(items: DataFrame, judged: DataFrame) -> DataFrame:
    """plane, lane, items, echo_dropped over all questions, before any limit."""
    before = items.groupBy("plane", "lane").agg(F.count("*").alias("found"))
    echo = F.when(F.col("plane") == "memory", X.is_echo(F.coalesce("role", F.lit("")), F.col("excerpt"), F.col("query"))).otherwise(X.is_question_turn("role", "excerpt"))
    return items.groupBy("plane", "lane").agg(F.count_if(~echo).alias("items"), F.count_if(echo).alias("echo_dropped")).join(before, ["plane", "lane"]).select("plane", "lane", "items", "echo_dropped").join(judged.groupBy("plane", "lane").agg(F.count("*").alias("shown")), ["plane", "lane"], "left").fillna(0, ["shown"])


def compacted_items(items: DataFrame) -> DataFrame:
    """The first ten items of each list (query_id, list), texts cut to 6000 characters."""
    cut = {c: F.substring(c, 1, EXCERPT_CHARS) for c in ("excerpt", "content") if c in items.columns}
    kept = items.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "list").orderBy("place"))).where(F.col("_n") <= LIST_ROWS).drop("_n")
    return kept.withColumns(cut)


def semantic_rescue(lexical: DataFrame, vectors: DataFrame, most: int = 64, floor: float = 0.2) -> DataFrame:
    """query_id, doc_id, in_words, cos: documents that words or the best vectors find; vectors (query_id, doc_id, cos) widen what is looked at, never decide."""
    best = vectors.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("cos", 9)), "doc_id"))).where((F.col("_n") <= most) & (F.col("cos") >= floor)).select("query_id", "doc_id", "cos")
    return lexical.select("query_id", "doc_id", F.lit(True).alias("in_words")).join(best, ["query_id", "doc_id"], "full_outer").fillna(False, ["in_words"])


def all_found(accepted: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, complete: whether every accepted id is among those found."""
    missing = accepted.join(found, ["query_id", "id"], "left_anti").groupBy("query_id").agg(F.count("*").alias("n"))
    return accepted.select("query_id").distinct().join(missing, "query_id", "left").select("query_id", F.col("n").isNull().alias("complete"))


def matched_documents(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id, hits: documents (doc_id, path, text) that a question's terms of three characters or more are in, without a bound on how many."""
    terms = queries.select("query_id", F.explode(F.filter(Q.query_terms("query"), lambda t: F.length(t) >= 3)).alias("term"))
    return term_counts(terms.select("term").distinct(), docs).join(small(terms), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"))


def unreachable(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, term: terms whose borders are guesses and that no document has."""
    terms = queries.select("query_id", F.explode(Q.carved_terms("query")).alias("term"))
    held = term_counts(terms.select("term").distinct(), docs).select("term").distinct()
    return terms.join(held, "term", "left_anti").select("query_id", "term")


def last_answer(messages: DataFrame) -> DataFrame:
    """session_id, last_user (index of the last user message), answer (text of the last assistant message)."""
    of = lambda role: F.col("role") == role
    return messages.groupBy("session_id").agg(F.max(F.when(of("user"), F.col("message_index"))).alias("last_user"), F.max_by(F.when(of("assistant"), F.col("content")), F.when(of("assistant"), F.col("message_index"))).alias("answer"))


def neighbours_of(terms: Column) -> Column:
    """Adjacent pairs of an array, joined by a space."""
    n = F.greatest(F.size(terms) - 1, F.lit(0))
    return F.zip_with(F.slice(terms, F.lit(1), n), F.slice(terms, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def distinct_reports(reports: DataFrame) -> DataFrame:
    """report, n: distinct reports (JSON) without what changes from call to call (the server's uptime)."""
    steady = F.regexp_replace(text_of("json"), r'("server"\s*:\s*\{[^{}]*?)(,\s*"uptime"\s*:\s*[^,{}]+|"uptime"\s*:\s*[^,{}]+,?\s*)', "$1")
    return reports.groupBy(steady.alias("report")).agg(F.count("*").alias("n"))


def corpus_size(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("document_count"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("text_bytes"))


def stem_counts(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """term, docs: how many file stems hold each term."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    pages = docs.select("doc_id", F.lit("").alias("path"), stem.alias("text"))
    return terms.select("term").distinct().join(term_counts(terms.select("term").distinct(), pages).groupBy("term").agg(F.count("*").alias("docs")), "term", "left").fillna(0, ["docs"])


def audit_counts(responses: DataFrame) -> DataFrame:
    """call_id, verified_count, candidate_count, citation_valid_count, freshness_states, abstain of search responses (call_id, json)."""
    items = lambda name: F.from_json(F.get_json_object("json", f"$.{name}"), "array<string>")
    states = F.map_values(F.from_json(F.get_json_object("json", "$.freshness"), "map<string,struct<state:string>>"))
    n = lambda a: F.coalesce(F.size(F.filter(a, lambda x: x.isNotNull())), F.lit(0)).cast("bigint")
    return responses.select(
        "call_id", F.greatest(n(items("verified")), F.lit(0)).alias("verified_count"), F.greatest(n(items("candidates")), F.lit(0)).alias("candidate_count"),
        F.greatest(n(F.filter(items("verified"), lambda x: F.get_json_object(x, "$.citation.valid") == "true")), F.lit(0)).alias("citation_valid_count"),
        F.array_sort(F.array_distinct(F.filter(F.transform(states, lambda s: s["state"]), lambda s: F.coalesce(s, F.lit("")) != ""))).alias("freshness_states"), (F.get_json_object("json", "$.abstain") == "true").alias("abstain"),
    )
