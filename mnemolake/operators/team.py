"""Team records: counts, search, feedback, revisions, merge of bundles, compaction, export plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions.citations import yaml_scalar
from mnemolake.functions.columns import stripped
from mnemolake.functions.query import plane_terms
from mnemolake.functions.text import TEAM_STOP_WORDS, digest_key, has_secret, safe_name
from mnemolake.operators.ranking import matched_terms, term_counts
from mnemolake.operators.retrieval import small
from mnemolake.sources.scratch import materialised

# Fixed values of the lifecycle.
SECTIONS = {"decision": "Decisions", "discovery": "Discoveries", "failure": "Failures", "solution": "Solutions", "handoff": "Handoffs", "evidence": "Evidence"}
TYPES = ("evidence", "decision", "discovery", "failure", "solution", "handoff", "scenario")
STATUS_RANK = {"active": 0, "superseded": 1, "stale": 2, "candidate": 3}


def expired(valid_until: Column, now: Column) -> Column:
    """Unreadable or null times never expire; a time without a zone is UTC."""
    return F.coalesce(now >= F.try_to_timestamp(valid_until), F.lit(False))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("memory_id").agg(F.count_if(F.col("rating") == "helpful").alias("helpful"), F.count_if(F.col("rating").isin("wrong", "stale", "not_helpful")).alias("negative"))


def ranked_records(records: DataFrame, feedback: DataFrame, matched: Column, exact: bool = False) -> DataFrame:
    """records with score: 2 matched + confidence + .15 min(helpful, 10) - .2 min(negative, 10) + .4 if active; rounded, unless exact."""
    joined = records.join(small(feedback_counts(feedback)), "memory_id", "left")
    helpful, negative = (F.least(F.coalesce(F.col(c), F.lit(0)), F.lit(10)) for c in ("helpful", "negative"))
    score = 2 * matched + F.col("confidence") + 0.15 * helpful - 0.2 * negative + F.when(F.col("status") == "active", 0.4).otherwise(0.0)
    return joined.withColumn("score", score if exact else F.round(score, 6))


def feedback_transitions(records: DataFrame, feedback: DataFrame) -> DataFrame:
    """memory_id, status, confidence after feedback: .1 off for each stale or wrong, at least 0; wrong makes stale;
    stale by two distinct named agents makes an active record stale."""
    fold = feedback.groupBy("memory_id").agg(
        F.count_if(F.col("rating").isin("stale", "wrong")).alias("bad"), F.count_if(F.col("rating") == "wrong").alias("wrong"),
        F.count_distinct(F.when((F.col("rating") == "stale") & (F.trim("agent") != ""), F.trim("agent"))).alias("agents"),
    )
    joined = records.join(fold, "memory_id", "left").fillna(0, ["bad", "wrong", "agents"])
    status = F.when((F.col("wrong") > 0) | ((F.col("agents") >= 2) & (F.col("status") == "active")), "stale").otherwise(F.col("status"))
    return joined.select("memory_id", status.alias("status"), F.round(F.greatest(F.lit(0.0), F.col("confidence") - 0.1 * F.col("bad")), 6).alias("confidence"))


def activated(records: DataFrame, ids: DataFrame) -> DataFrame:
    """records with the candidates among ids (memory_id, and reviewer if there is one) active, and with them the candidates that are projections of the same memory:
    those whose source_memory_id is an activated one, or that are an activated one's source. What is activated takes the reviewer as its reviewed_by (of several
    for a record, its own first, then the greatest)."""
    own = ids.select("memory_id", (F.col("reviewer") if "reviewer" in ids.columns else F.lit(None)).cast("string").alias("_reviewer")).groupBy("memory_id").agg(F.max("_reviewer").alias("_reviewer"))
    chosen = records.join(own, "memory_id").where("status = 'candidate'").select("memory_id", "source_memory_id", "_reviewer")
    marks = lambda rows, n: rows.select(*rows.columns, F.lit(n).alias("_n"))
    hit = marks(chosen.select("memory_id", "_reviewer"), 0).union(marks(chosen.select("source_memory_id", "_reviewer"), 1)).where("memory_id is not null")
    first = lambda rows, by: rows.groupBy(by).agg(F.min(F.struct("_n", F.struct(F.col("_reviewer").isNull()), "_reviewer")).alias("_m"))
    hit = first(hit.groupBy("memory_id", "_n").agg(F.max("_reviewer").alias("_reviewer")), "memory_id").withColumnRenamed("_m", "_own")
    source = chosen.groupBy(F.col("memory_id").alias("source_memory_id")).agg(F.struct(F.max("_reviewer").alias("_reviewer")).alias("_source"))
    joined = records.join(hit, "memory_id", "left").join(source, "source_memory_id", "left")
    active = (F.col("status") == "candidate") & (F.col("_own").isNotNull() | F.col("_source").isNotNull())
    out = {"status": F.when(active, "active").otherwise(F.col("status"))}
    if "reviewed_by" in records.columns:
        out["reviewed_by"] = F.when(active, F.coalesce("_own._reviewer", "_source._reviewer", "reviewed_by")).otherwise(F.col("reviewed_by"))
    return joined.select(*(out[c].alias(c) if c in out else F.col(c) for c in records.columns))


def current_revisions(revisions: DataFrame) -> DataFrame:
    """memory_id and the greatest revision of each memory."""
    return revisions.groupBy("memory_id").agg(F.max("revision").alias("current"))


def ancestors(revisions: DataFrame, most_rounds: int = 64) -> DataFrame:
    """memory_id, revision, ancestor: every revision reached over parents, the revision left out.

    Paths double each round; a parent that leads back to a known pair adds nothing, so cycles end."""
    pairs = materialised(revisions.where("parent is not null and parent <> revision").select("memory_id", "revision", F.col("parent").alias("ancestor")), "ancestors")
    count = -1
    for _ in range(most_rounds):
        now = pairs.count()
        if now == count:
            break
        count = now
        further = pairs.alias("a").join(pairs.alias("b"), (F.col("a.memory_id") == F.col("b.memory_id")) & (F.col("a.ancestor") == F.col("b.revision"))).select("a.memory_id", "a.revision", "b.ancestor")
        pairs = materialised(pairs.union(further).where("ancestor <> revision").distinct(), "ancestors")
    return pairs


def chain_from(starts: DataFrame, revisions: DataFrame, most_rounds: int = 64) -> DataFrame:
    """memory_id, revision: each start (memory_id, revision; one for a memory) and all that it descends from, also where the log has lost them.

    List ranking: a round doubles the length of every jump, and what is marked jumps once with it, so rows are read and written for each of
    about log2(depth) rounds, never for pairs. A jump off the end of its chain goes; cycles end when nothing new is marked. A revision has one
    parent (of repeated rows, the greatest)."""
    jumps = materialised(revisions.where("parent is not null and parent <> revision").groupBy("memory_id", "revision").agg(F.max("parent").alias("to")), "jumps")
    marks = materialised(starts.select("memory_id", "revision").distinct(), "marks")
    count = marks.count()
    for _ in range(most_rounds):
        ahead = marks.join(jumps, ["memory_id", "revision"]).select("memory_id", F.col("to").alias("revision"))
        marks = materialised(marks.unionByName(ahead).distinct(), "marks")
        if (now := marks.count()) == count:
            break
        count = now
        further = jumps.select("memory_id", F.col("revision").alias("to"), F.col("to").alias("_to"))
        jumps = materialised(jumps.join(further, ["memory_id", "to"]).select("memory_id", "revision", F.col("_to").alias("to")), "jumps")
    return marks


def current_chain(revisions: DataFrame) -> DataFrame:
    """memory_id, revision: the greatest revision of each memory and all that it descends from, also where the log has lost them."""
    return chain_from(current_revisions(revisions).select("memory_id", F.col("current").alias("revision")), revisions)


def chain_lengths(revisions: DataFrame) -> DataFrame:
    """memory_id, chain: revisions on the way from the current one to its root, itself included, whatever branches the log has."""
    return current_chain(revisions).groupBy("memory_id").agg(F.count("*").alias("chain"))


def compacted(revisions: DataFrame, protected: DataFrame, keep: int) -> DataFrame:
    """revisions that stay: those in protected (memory_id, revision; as a rule current_chain()), and the newest `keep` others of each memory."""
    marked = revisions.join(protected.select("memory_id", "revision", F.lit(True).alias("_p")), ["memory_id", "revision"], "left")
    rank = F.row_number().over(Window.partitionBy("memory_id", F.col("_p").isNull()).orderBy(F.desc("revision")))
    return marked.withColumn("_n", rank).where(F.col("_p").isNotNull() | (F.col("_n") <= keep)).drop("_p", "_n")


#: Revisions of a memory up to which they are one row; memories with more go by joins.
ROW_REVISIONS = 64


def _long_memories(rows: DataFrame) -> DataFrame | None:
    """memory_id of the memories with more than ROW_REVISIONS rows, or None if there are none."""
    found = materialised(rows.groupBy("memory_id").agg(F.count("*").alias("_n")).where(F.col("_n") > ROW_REVISIONS).select("memory_id"), "long-memories")
    return found if found.head(1) else None


def merge_plan(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """memory_id, revision, action of an incoming revision log, taken in order of revision.

    skip: known with equal content; conflict: known with other content, or its parent is neither known here nor a revision of the
    bundle that comes before and goes in itself; insert: the rest."""
    return planned_revisions(local, incoming).select("memory_id", "revision", "action")


def planned_revisions(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """merge_plan() with the incoming parent and payload_hash. Both logs meet once, by memory: a memory's revisions are folded in their order. Memories
    with more than ROW_REVISIONS, and revisions without a key, go by joins."""
    names = ["memory_id", "revision", "parent", "payload_hash"]
    local, incoming = local.where("memory_id is not null and revision is not null").select(names), incoming.select(names)
    both = local.withColumn("_new", F.lit(False)).unionByName(incoming.where("memory_id is not null and revision is not null").withColumn("_new", F.lit(True)))
    more = incoming.where("memory_id is null or revision is null").withColumn("action", F.lit("conflict"))  # such meet nothing
    many = _long_memories(both)
    if many is not None:
        long = lambda rows: rows.join(small(many), "memory_id", "left_semi")
        more = more.unionByName(_plan_by_joins(long(local), long(incoming)))
        both = both.join(small(many), "memory_id", "left_anti")
    logs = both.groupBy("memory_id").agg(F.collect_list(F.struct("revision", "_new", "parent", "payload_hash")).alias("l"))
    logs = logs.select("memory_id", F.filter("l", lambda x: ~x["_new"]).alias("home"), F.filter("l", lambda x: x["_new"]).alias("new")).where("size(new) > 0")
    contents = F.filter("home", lambda h: h["payload_hash"].isNotNull())
    logs = logs.withColumns({"contents": F.transform(contents, lambda h: h["payload_hash"]), "known": F.transform(contents, lambda h: h["revision"]), "home": F.transform("home", lambda h: h["revision"])})
    fresh = F.array_sort(F.transform(F.filter("new", lambda x: ~F.array_contains(F.col("known"), x["revision"])), lambda x: F.struct(x["revision"].alias("revision"), x["parent"].alias("parent"))))
    held = lambda a, x: F.coalesce(F.array_contains(a, x), F.lit(False))
    goes = lambda s, x: x["parent"].isNull() | held(F.col("home"), x["parent"]) | (F.coalesce(x["parent"] < x["revision"], F.lit(False)) & held(s, x["parent"]))
    taken = F.aggregate(fresh, F.expr(f"cast(array() as array<{local.schema['revision'].dataType.simpleString()}>)"), lambda s, x: F.when(goes(s, x), F.concat(s, F.array(x["revision"]))).otherwise(s))
    rows = logs.withColumn("taken", taken).select("memory_id", "known", "contents", "taken", F.explode("new").alias("x"))
    own = F.get("contents", (F.array_position(F.col("known"), F.col("x.revision")) - 1).cast("int"))
    action = F.when(own == F.col("x.payload_hash"), "skip").when(own.isNotNull(), "conflict").when(held(F.col("taken"), F.col("x.revision")), "insert").otherwise("conflict")
    return rows.select("memory_id", "x.revision", "x.parent", "x.payload_hash", action.alias("action")).unionByName(more)


def _plan_by_joins(local: DataFrame, incoming: DataFrame, most_rounds: int = 64) -> DataFrame:
    """planned_revisions() of memories of any length: what a revision waits for is found by pointer jumping, in rounds that grow with the logarithm of a chain's length."""
    known = local.select("memory_id", "revision", F.col("payload_hash").alias("_local"))
    joined = incoming.join(known, ["memory_id", "revision"], "left")
    fresh = joined.where("_local is null").select("memory_id", "revision", "parent")
    at_home = local.select("memory_id", F.col("revision").alias("parent"), F.lit(True).alias("_home"))
    earlier = fresh.select("memory_id", F.col("revision").alias("parent"), F.lit(True).alias("_new"))
    linked = fresh.join(at_home, ["memory_id", "parent"], "left").join(earlier, ["memory_id", "parent"], "left")
    waits = F.col("_home").isNull() & F.col("_new").isNotNull() & (F.col("parent") < F.col("revision"))
    state = materialised(linked.select("memory_id", "revision", F.when(F.col("parent").isNull() | F.col("_home").isNotNull(), True).when(~waits, False).alias("ok"), F.when(F.col("parent").isNotNull() & waits, F.col("parent")).alias("at")), "merge")
    for _ in range(most_rounds):
        if not state.where("ok is null").head(1):
            break
        ahead = state.select("memory_id", F.col("revision").alias("at"), F.col("ok").alias("_ok"), F.col("at").alias("_at"))
        state = materialised(state.join(ahead, ["memory_id", "at"], "left").select("memory_id", "revision", F.coalesce("ok", "_ok").alias("ok"), F.when(F.coalesce("ok", "_ok").isNull(), F.col("_at")).alias("at")), "merge")
    action = F.when(F.col("_local") == F.col("payload_hash"), "skip").when(F.col("_local").isNotNull(), "conflict").when(F.col("ok"), "insert").otherwise("conflict")
    ok = state.where("ok").select("memory_id", "revision", "ok").distinct()
    return joined.join(ok, ["memory_id", "revision"], "left").select("memory_id", "revision", "parent", "payload_hash", action.alias("action"))


def merged_log(local: DataFrame, incoming: DataFrame, plan: DataFrame) -> DataFrame:
    """The revision log after a plan: memory_id, revision, parent, payload_hash. A plan of planned_revisions() has all of that and needs no look at incoming."""
    names = ["memory_id", "revision", "parent", "payload_hash"]
    new = plan.where("action = 'insert'")
    new = new if set(names) <= set(plan.columns) else incoming.join(new, ["memory_id", "revision"], "left_semi")
    return local.select(names).unionByName(new.select(names))


def _record_action() -> Column:
    return (
        F.when(F.col("parent").isNotNull() & F.col("_parent").isNull(), "conflict").when(F.col("_r").isNull(), "insert").when(F.col("revision") < F.col("_r"), "stale_ignored")
        .when(F.col("revision") == F.col("_r"), F.when(F.col("_h") == F.col("content_hash"), "skip").otherwise("conflict")).when(F.col("_based"), "update").otherwise("conflict")
    )


def record_plan(local: DataFrame, incoming: DataFrame, log: DataFrame) -> DataFrame:
    """memory_id, action of a bundle's records (memory_id, revision, parent, content_hash) against those at home; log: the merged revisions.

    conflict: the parent is not in the log; insert: not here; skip: the same revision and content; stale_ignored: a lower revision;
    conflict: the same revision with other content, or the revision at home is not among the incoming one's ancestors; update: the rest.
    A memory's log is one row, along which its parents are followed; memories with more than ROW_REVISIONS go by joins."""
    log = materialised(log.where("memory_id is not null and revision is not null").select("memory_id", "revision", "parent"), "merged-log")
    many, more = _long_memories(log), None
    if many is not None:
        long = lambda rows: rows.join(small(many), "memory_id", "left_semi")
        more = _records_by_joins(local, long(incoming), long(log))
        log, incoming = (rows.join(small(many), "memory_id", "left_anti") for rows in (log, incoming))
    logs = log.groupBy("memory_id").agg(F.collect_list(F.struct("revision", "parent")).alias("l"))
    here = local.select("memory_id", F.col("revision").alias("_r"), F.col("content_hash").alias("_h"))
    rows = incoming.join(here, "memory_id", "left").join(logs, "memory_id", "left")
    empty = F.array().cast(logs.schema["l"].dataType)
    log_of = F.coalesce("l", empty)
    up = lambda at: F.array_max(F.transform(F.filter(log_of, lambda x: (x["revision"] == at) & (x["parent"] != at)), lambda x: x["parent"]))
    way = F.aggregate(log_of, F.struct(F.col("revision").cast("bigint").alias("at"), F.lit(False).alias("met")), lambda s, _: F.struct(up(s["at"]).cast("bigint").alias("at"), (s["met"] | F.coalesce(up(s["at"]) == F.col("_r"), F.lit(False))).alias("met")))
    based = F.when(F.col("revision") > F.col("_r"), way["met"])
    held = F.when(F.exists(log_of, lambda x: F.coalesce(x["revision"] == F.col("parent"), F.lit(False))), True)
    found = rows.withColumns({"_based": based, "_parent": held}).select("memory_id", _record_action().alias("action"))
    return found if more is None else found.unionByName(more)


def _records_by_joins(local: DataFrame, incoming: DataFrame, log: DataFrame) -> DataFrame:
    here = local.select("memory_id", F.col("revision").alias("_r"), F.col("content_hash").alias("_h"))
    parents = log.select("memory_id", F.col("revision").alias("parent"), F.lit(True).alias("_parent"))
    based = chain_from(incoming, log).select("memory_id", F.col("revision").alias("_r"), F.lit(True).alias("_based"))
    joined = incoming.join(here, "memory_id", "left").join(parents, ["memory_id", "parent"], "left").join(based, ["memory_id", "_r"], "left")
    return joined.select("memory_id", _record_action().alias("action"))


def replayed(records: DataFrame, known: DataFrame, incoming: DataFrame, bundled: DataFrame) -> DataFrame:
    """memory_id, status, confidence after a bundle's feedback (memory_id, feedback_id, rating, agent) that is not known yet.

    A record that came with the bundle (bundled: memory_id, confidence) takes the lesser confidence, since the bundle's has the feedback in it;
    another loses .1 for each stale or wrong. wrong makes stale; stale by two distinct named agents in all makes an active record stale."""
    new = incoming.join(known.select("memory_id", "feedback_id"), ["memory_id", "feedback_id"], "left_anti").dropDuplicates(["memory_id", "feedback_id"])
    every = known.select("memory_id", "rating", "agent").unionByName(new.select("memory_id", "rating", "agent"))
    agents = every.groupBy("memory_id").agg(F.count_distinct(F.when((F.col("rating") == "stale") & (F.trim("agent") != ""), F.trim("agent"))).alias("agents"))
    fold = new.groupBy("memory_id").agg(F.count_if(F.col("rating") == "stale").alias("stale"), F.count_if(F.col("rating") == "wrong").alias("wrong"))
    joined = records.join(fold, "memory_id", "left").join(agents, "memory_id", "left").join(bundled.select("memory_id", F.col("confidence").alias("_top")), "memory_id", "left").fillna(0, ["stale", "wrong", "agents"])
    bad = F.col("stale") + F.col("wrong")
    status = F.when((F.col("wrong") > 0) & (F.col("status") != "superseded"), "stale").when((F.col("stale") > 0) & (F.col("agents") >= 2) & (F.col("status") == "active"), "stale").otherwise(F.col("status"))
    confidence = F.when(bad == 0, F.col("confidence")).when(F.col("_top").isNotNull(), F.least("confidence", "_top")).otherwise(F.greatest(F.lit(0.0), F.col("confidence") - 0.1 * bad))
    return joined.select("memory_id", status.alias("status"), F.round(confidence, 6).alias("confidence"))


def published(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """Outcome of a batch of payloads (key, memory_id, memory_type, title, content, confidence, status, idempotency_key, supersedes):
    key, memory_id, action (reject, duplicate, insert), confidence, superseded (the record that this one replaces).

    A payload needs a known type, content without secrets and a status of candidate or active. It is a duplicate if its id or its
    idempotency key is taken, here or by a payload before it (by key). records: memory_id, idempotency_key, status."""
    status = F.coalesce(F.nullif(F.lower(F.trim("status")), F.lit("")), F.lit("candidate"))
    title, content = F.coalesce("title", F.lit("")), stripped("content")
    good = F.lower(F.trim("memory_type")).isin(*TYPES) & (content != "") & ~has_secret(F.concat(title, F.lit("\n"), content)) & status.isin("candidate", "active")
    fallback = digest_key("", 24, F.lower(F.trim("memory_type")), title, content, between="\0")
    own = F.coalesce("memory_id", F.concat(F.lit("team:"), F.lower(F.trim("memory_type")), F.lit(":"), F.when(F.col("idempotency_key").isNotNull(), digest_key("", 24, F.col("idempotency_key"))).otherwise(fallback)))
    checked = payloads.select("key", F.when(own.startswith("team:"), own).otherwise(F.concat(F.lit("team:"), own)).alias("memory_id"), "idempotency_key", "supersedes", F.coalesce(good, F.lit(False)).alias("_good"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5)))).alias("confidence"))
    ids = records.select("memory_id", F.lit(True).alias("_id")).distinct()
    keys = records.where("idempotency_key is not null").select("idempotency_key", F.lit(True).alias("_key")).distinct()
    first = lambda c: F.row_number().over(Window.partitionBy(c, "_good").orderBy("key")) > 1
    seen = checked.join(ids, "memory_id", "left").join(keys, "idempotency_key", "left").withColumn("_again", first("memory_id") | (F.col("idempotency_key").isNotNull() & first("idempotency_key")))
    action = F.when(~F.col("_good"), "reject").when(F.col("_id").isNotNull() | F.col("_key").isNotNull() | F.col("_again"), "duplicate").otherwise("insert")
    targets = records.where("status <> 'superseded'").select(F.col("memory_id").alias("supersedes"), F.lit(True).alias("_there"))
    return seen.withColumn("action", action).join(targets, "supersedes", "left").select("key", "memory_id", "action", "confidence", F.when((F.col("action") == "insert") & F.col("_there"), F.col("supersedes")).alias("superseded"))


def _points(columns, row, q, matched, words, covered):
    """What ranked_records() makes of a task's rows, rounded alike."""
    import numpy as np

    return np.round(2 * matched + columns.column("base").to_numpy(zero_copy_only=False)[row], 6)


def team_hits(queries: DataFrame, records: DataFrame, feedback: DataFrame, now: Column, most: int = 10, candidates: bool = True, **scope: str) -> DataFrame:
    """query_id, memory_id, status, matched, score, rank: active and candidate records for each question, `most` of either, by score and id.

    records: memory_id, status, confidence, body (all that is searched), valid_until and the scope's columns. Expired records are left out.
    scope: column=text that it must hold, without regard to case. A question without terms takes every record."""
    live = records.where(F.col("status").isin("active", *(["candidate"] if candidates else [])) & ~expired(F.col("valid_until"), now))
    for column, value in scope.items():
        live = live.where(F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(value.lower())))
    asked = queries.select("query_id", plane_terms("query", TEAM_STOP_WORDS).alias("terms"))
    terms = asked.select("query_id", F.explode("terms").alias("term"))
    based = ranked_records(live.select("memory_id", "status", "confidence", F.col("body").alias("text")), feedback, F.lit(0), exact=True).select("memory_id", "status", "confidence", "text", F.col("score").alias("base"))
    counts = matched_terms(terms, based, _points, "double", most, ("memory_id",), ("status",))  # a task's first ones
    if counts is None:
        docs = live.select(F.col("memory_id").alias("doc_id"), F.lit("").alias("path"), F.col("body").alias("text"))
        counts = term_counts(terms.select("term").distinct(), docs).join(small(terms), "term").groupBy("doc_id", "query_id").agg(F.count("*").alias("matched")).withColumnRenamed("doc_id", "memory_id")
        counts = counts.join(live.select("memory_id", "status", "confidence"), "memory_id")
    found = ranked_records(counts.select("query_id", "memory_id", "status", "confidence", "matched"), feedback, F.col("matched")).select("query_id", "memory_id", "status", "matched", "score")
    # a question without terms matches nothing, so all such have the same first records: ranked once, then joined
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "memory_id"))
    same = ranked_records(live, feedback, F.lit(0)).withColumn("_n", rank("status")).where(F.col("_n") <= most).select("memory_id", "status", F.lit(0).cast("bigint").alias("matched"), "score")
    every = asked.where("size(terms) = 0").select("query_id").join(F.broadcast(same))  # twice `most` rows
    return found.unionByName(every.select(found.columns)).withColumn("rank", rank("query_id", "status")).where(F.col("rank") <= most).select("query_id", "memory_id", "status", "matched", "score", "rank")


def context_sections(records: DataFrame) -> DataFrame:
    """memory_type, n, first_id of active records: the sections of a context package, scenarios among them."""
    return records.where("status = 'active'").groupBy("memory_type").agg(F.count("*").alias("n"), F.min("memory_id").alias("first_id"))


def by_coverage(hits: DataFrame) -> DataFrame:
    """Hits (query_id, rank, coverage) by coverage, equal ones as they were: new rank."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("coverage"), "rank")))


def export_plan(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """memory_id, action: create, move (other path), conflict (other content), skip, preserve (no longer desired)."""
    e = existing.select("memory_id", F.col("path").alias("_path"), F.col("content_hash").alias("_hash"), F.lit(True).alias("_e"))
    d = desired.select("memory_id", "path", "content_hash", F.lit(True).alias("_d"))
    action = F.when(F.col("_e").isNull(), "create").when(F.col("_d").isNull(), "preserve").when(F.col("_hash") != F.col("content_hash"), "conflict").when(F.col("_path") != F.col("path"), "move").otherwise("skip")
    return e.join(d, "memory_id", "full_outer").select("memory_id", action.alias("action"))


def central_id(key: Column, layer: Column) -> Column:
    """The id that a record has in the shared repository: the one in its own id if it came from there, else made from it."""
    own = F.regexp_extract(F.substring_index(key.cast("string"), "team:central:", -1), "^(team_l[123]_[a-f0-9]{24})$", 1)
    return F.when(own != "", own).otherwise(F.concat(F.lit("team_"), F.lower(layer), F.lit("_"), F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 24)))


def record_path(layer: Column, status: Column, key: Column, agent: Column | None = None) -> Column:
    """Where a record's file lies: L1 by status, its candidates in their agents' inboxes; L2 and L3 as accepted or candidate."""
    name, who = F.concat(central_id(key, layer), F.lit(".md")), safe_name(F.lit("") if agent is None else agent)
    first = F.when(status == "candidate", F.concat_ws("/", F.lit("inbox"), who, name)).otherwise(F.concat_ws("/", F.lit("l1"), F.when(status.isin("active", "stale", "superseded"), status).otherwise("candidate"), name))
    return F.when(layer == "L1", first).otherwise(F.concat_ws("/", F.lower(layer), F.when(status.isin("accepted", "active"), "accepted").otherwise("candidate"), name))


def markdown_text(records: DataFrame) -> DataFrame:
    """memory_id, path, text: each record as its canonical Markdown file.

    records: memory_id, memory_type, layer, status, title, summary, content, scope (JSON), confidence, valid_until, reviewed_by, activated_at, author_agent, created_at."""
    q = lambda c: yaml_scalar(F.col(c), "string")
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value)
    key, layer = F.col("memory_id"), F.col("layer")
    summary, content = stripped("summary"), stripped("content")
    lines = F.array_compact(F.array(
        F.lit("---"), line("id", central_id(key, layer)), F.lit("schema_version: 1"), line("layer", layer), line("kind", F.coalesce("memory_type", F.lit("discovery"))), line("status", F.col("status")), F.lit("content_type: team_memory"),
        line("scope", F.coalesce("scope", F.lit("null"))), F.lit("provenance:"), line("  agent_id", q("author_agent")), line("  observed_at", q("created_at")), line("  source_memory_id", yaml_scalar(key.cast("string"), "string")), F.lit("  source_type: local_team_memory"),
        line("confidence", F.col("confidence").cast("string")), line("valid_until", q("valid_until")), F.when(F.col("reviewed_by").isNotNull(), line("reviewed_by", q("reviewed_by"))), F.when(F.col("activated_at").isNotNull(), line("accepted_at", q("activated_at"))),
        F.lit("evidence:"), F.lit("  - citation_status: pending_git_link"), F.lit("---"), F.lit(""), F.concat(F.lit("# "), F.coalesce("title", F.lit("Team memory"))), F.lit(""),
        F.when((summary != "") & (summary != content), F.concat(F.lit("## Summary\n\n"), summary, F.lit("\n"))), F.lit("## Content"), F.lit(""), content, F.lit(""),
    ))
    return records.select("memory_id", record_path(layer, F.col("status"), key, F.col("author_agent")).alias("path"), F.array_join(lines, "\n").alias("text"))


def catalog(records: DataFrame) -> DataFrame:
    """path, line of a catalog of files (path, id, layer, status, kind, agent), in order."""
    return records.select("path", F.concat(F.lit("| `"), "id", F.lit("` | "), F.concat_ws(" | ", "layer", "status", "kind", F.coalesce("agent", F.lit(""))), F.lit(" |")).alias("line")).orderBy("path")


def most_advanced(records: DataFrame, key: str) -> DataFrame:
    """status, n: distinct keys by the most advanced status that they have."""
    ranks = F.create_map(*(F.lit(v) for kv in STATUS_RANK.items() for v in kv))
    best = records.groupBy(key).agg(F.min(F.try_element_at(ranks, F.col("status"))).alias("r"))
    names = F.array(*map(F.lit, STATUS_RANK))
    return best.groupBy("r").agg(F.count("*").alias("n")).select(F.element_at(names, F.col("r") + 1).alias("status"), "n")


def review(records: DataFrame, floor: float = 0.5) -> DataFrame:
    """memory_id, decision of candidates: accept, hold (low confidence) or reject (secrets, under 20 characters)."""
    checks = ~has_secret("content") & (F.length(stripped("content")) >= 20)
    return records.where("status = 'candidate'").select("memory_id", F.when(~checks, "reject").when(F.col("confidence") >= floor, "accept").otherwise("hold").alias("decision"))


def supervised(records: DataFrame, decisions: DataFrame, floor: float = 0.5) -> DataFrame:
    """memory_id, failed (names of failed checks), decision (the reviewer's, hold if there is none or it is no known one), action of candidates: a receipt each.

    records: memory_id, status, content, provenance, confidence; decisions: memory_id, decision. Failed checks or a reviewer's reject mean reject; accept needs
    the reviewer and enough confidence; anything else holds."""
    checks = {"secret_free": ~has_secret("content"), "long_enough": F.length(stripped("content")) >= 20, "provenance": stripped("provenance") != ""}
    failed = F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in checks.items())))
    said = F.when(F.col("_said").isin("accept", "hold", "reject"), F.col("_said")).otherwise("hold")
    rows = records.where("status = 'candidate'").join(decisions.select("memory_id", F.col("decision").alias("_said")), "memory_id", "left").withColumns({"failed": failed, "decision": said})
    action = F.when((F.size("failed") > 0) | (F.col("decision") == "reject"), "reject").when((F.col("decision") == "accept") & (F.col("confidence") >= floor), "accept").otherwise("hold")
    return rows.select("memory_id", "failed", "decision", action.alias("action"))


def hydration_payloads(files: DataFrame) -> DataFrame:
    """Payloads for published() of canonical files (see read_markdown_records()) that could be read: each keeps its shared id."""
    good = files.where("failure is null")
    return good.select(
        F.col("path").alias("key"), F.concat(F.lit("team:central:"), F.col("id")).alias("memory_id"), F.col("kind").alias("memory_type"), "title", "content", "confidence", "status",
        F.concat(F.lit("central:"), F.col("id")).alias("idempotency_key"), F.lit(None).cast("string").alias("supersedes"),
    )


def sync_report(plan: DataFrame, outcome: DataFrame) -> DataFrame:
    """step, action, n of a round with the shared repository: what export_plan() writes and what published() takes in."""
    count = lambda df, step: df.groupBy("action").agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), "action", "n")
    return count(plan, "export").unionByName(count(outcome, "import"))


def health(records: DataFrame, feedback: DataFrame, revisions: DataFrame, now: Column) -> DataFrame:
    """One row: total, active, candidate, superseded, stale, expired (active ones), feedback, revisions, longest_chain."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    own = records.agg(F.count("*").alias("total"), *map(of, STATUS_RANK), F.count_if((F.col("status") == "active") & expired(F.col("valid_until"), now)).alias("expired"))
    rows = feedback.agg(F.count("*").alias("feedback")).join(revisions.agg(F.count("*").alias("revisions")))
    return own.join(rows).join(chain_lengths(revisions).agg(F.max("chain").alias("longest_chain")))
