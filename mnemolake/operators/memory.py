"""Layered conversation memory: ingest, projections, recency, rewards, deduplication, timelines."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions import citations as C
from mnemolake.functions import matching as P
from mnemolake.functions import query as Q
from mnemolake.functions import text as X
from mnemolake.functions import vectors as V
from mnemolake.functions.columns import collapsed, folded, stripped, text_of
from mnemolake.operators import nearest as N
from mnemolake.operators.ranking import matched_terms, numbered, term_counts
from mnemolake.operators.retrieval import mmr, small, top_k
from mnemolake.sources.scratch import materialised

# Fixed values of ranking and decay.
HALF_LIFE_DAYS, LATEST_WEIGHT, USUAL_WEIGHT = 14.0, 0.32, 0.08
GAMMA, ALPHA, PRIORITY_DAYS = 0.9, 0.3, 30.0
IDLE_SECONDS = 7200
LAYER_BONUS = {"L3": 0.45, "L2": 0.35, "L1": 0.2, "L0": 0.0}


def ingest(messages: DataFrame) -> DataFrame:
    """L0 and L1 twins of every message without secrets: id, layer, session_id, message_index, role, content, turn_id."""
    clean = messages.where(~X.has_secret("content"))
    twins = clean.withColumn("layer", F.explode(F.array(F.lit("L0"), F.lit("L1"))))
    key = X.stable_id(F.col("layer"), F.col("session_id"), F.col("message_index"), F.col("role"), F.col("content"))
    return twins.select(key.alias("id"), "layer", "session_id", "message_index", "role", "content", F.floor(F.col("message_index") / 2).cast("bigint").alias("turn_id"))


def scenario_projection(messages: DataFrame, last: int = 8, width: int = 500) -> DataFrame:
    """session_id, body, content: the last messages without secrets, a line each, and the candidate record's text with its marks."""
    clean = messages.where(~X.has_secret("content"))
    newest = clean.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("message_index")))).where(F.col("_n") <= last)
    line = F.concat(F.lit("- "), F.col("role"), F.lit(": "), F.substring(collapsed("content"), 1, width))
    bodies = newest.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("message_index", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    head = F.concat(F.lit("status: candidate\nlayer: L2\ngenerated: true\nsession_id: "), F.col("session_id"), F.lit("\n\n# Scenario candidate\n\n"))
    return bodies.select("session_id", "body", F.concat(head, F.col("body"), F.lit("\n")).alias("content"))


def policy_buckets(records: DataFrame, least_episodes: int = 2) -> DataFrame:
    """signature, episodes, records of buckets with enough distinct episodes (two at least); counts are pre-aggregated."""
    keyed = records.select(X.signature("content").alias("signature"), "session_id")
    per = keyed.groupBy("signature", "session_id").agg(F.count("*").alias("n"))
    return per.groupBy("signature").agg(F.count_if(F.col("session_id") != "").alias("episodes"), F.sum("n").alias("records")).where(F.col("episodes") >= max(2, least_episodes))


# What a policy candidate says besides its evidence.
PROCEDURE = ("Inspect the cited evidence", "Apply only within the observed scope", "Verify the result")
VERIFICATION = "Confirm the outcome against the linked evidence before reuse."
BOUNDARY = "Do not generalize beyond the linked episodes or treat candidate status as fact."


def policy_rows(records: DataFrame, least_episodes: int = 2, excerpts: int = 5, width: int = 600) -> DataFrame:
    """id, path, signature, episodes, records, content of a policy candidate for every bucket.

    records: id, session_id, message_index, content. Only the first `excerpts` records of a bucket are gathered; all ids are in the
    links that supporting_links() makes, not in the row, so that a bucket of any size is a small row."""
    keyed = records.withColumn("signature", X.signature("content"))
    ready = policy_buckets(records, least_episodes)
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("signature").orderBy("session_id", "message_index", "id"))).where(F.col("_n") <= excerpts)
    lines = first.groupBy("signature").agg(F.sort_array(F.collect_list(F.struct("_n", F.concat(F.lit("- "), F.substring("content", 1, width)).alias("line")))).alias("e"))
    text = F.concat_ws(
        "\n", F.lit("status: candidate"), F.lit("layer: L2"), F.lit("kind: policy"), F.lit("generated: true"), F.lit(""), F.concat(F.lit("trigger: "), F.col("signature")), F.lit("procedure:"), *(F.lit(f"- {x}") for x in PROCEDURE),
        F.lit(f"verification: {VERIFICATION}"), F.lit(f"boundary: {BOUNDARY}"), F.concat(F.lit("support_episode_count: "), F.col("episodes").cast("string")), F.lit("evidence:"), F.array_join(F.transform("e", lambda x: x["line"]), "\n"), F.lit(""),
    )
    path = X.digest_key("policy/", 24, F.col("signature"))
    return ready.join(lines, "signature").select(F.concat(F.lit("local:L2:"), path).alias("id"), path.alias("path"), "signature", "episodes", "records", text.alias("content"))


def supporting_links(records: DataFrame, policies: DataFrame) -> DataFrame:
    """source_id, target_id, relation: every record of a bucket supports its policy candidate."""
    keyed = records.select("id", X.signature("content").alias("signature"))
    return keyed.join(policies.select("signature", F.col("id").alias("target_id")), "signature").select(F.col("id").alias("source_id"), "target_id", F.lit("supports").alias("relation"))


def metadata_links(records: DataFrame) -> DataFrame:
    """source_id, target_id, relation of the ids that records' metadata (JSON) names: source_record_ids support the record, related_ids are
    related to it. Blank ids, loops and repetitions are left out."""
    ids = lambda k: F.from_json(F.get_json_object("metadata", f"$.{k}"), "array<string>")
    of = lambda k, relation: records.select("id", F.explode(F.transform(ids(k), lambda x: F.trim(x))).alias("other"), F.lit(relation).alias("relation"))
    sources = of("source_record_ids", "supports").select(F.col("other").alias("source_id"), F.col("id").alias("target_id"), "relation")
    related = of("related_ids", "related").select(F.col("id").alias("source_id"), F.col("other").alias("target_id"), "relation")
    return sources.unionByName(related).where("source_id <> '' and target_id <> '' and source_id <> target_id").distinct()


def recency(age_days: Column, latest: Column) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / HALF_LIFE_DAYS) * F.when(latest, LATEST_WEIGHT).otherwise(USUAL_WEIGHT)


def bounded_recency(t: Column, low: Column, high: Column, weight: float = 0.35) -> Column:
    return F.when(high > low, (t - low) / (high - low) * weight).otherwise(0.0)


def memory_relevance(similarity: Column, matched: Column, layer: Column, promoted: Column, fresh: Column, priority: Column) -> Column:
    """similarity + min(.65, .16 matched) + layer bonus (capped at .2 unless promoted) + recency + .12 priority within +-.2"""
    return similarity + F.least(F.lit(0.65), 0.16 * matched) + layer_bonus(layer, promoted) + fresh + urgency(priority)


def layer_bonus(layer: Column, promoted: Column) -> Column:
    bonus = F.lit(0.0)
    for name, value in LAYER_BONUS.items():
        bonus = F.when(layer == name, value).otherwise(bonus)
    return F.when(promoted, bonus).otherwise(F.least(bonus, F.lit(0.2)))


def urgency(priority: Column) -> Column:
    return F.greatest(F.lit(-0.2), F.least(F.lit(0.2), 0.12 * F.coalesce(priority, F.lit(0.0))))


def backpropagated(steps: DataFrame, reward: Column, age_days: Column, alpha: Column | None = None, gamma: float = GAMMA, half_life: float = PRIORITY_DAYS) -> DataFrame:
    """steps (episode, seq) with value and priority: the last step has the clamped reward, each one before it the next one's value
    times (alpha + (1 - alpha) gamma) with its own alpha. An episode's factors are multiplied as a sum of logarithms."""
    later = Window.partitionBy("episode").orderBy(F.desc("seq"))
    own = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(alpha, F.lit(ALPHA)) if alpha is not None else F.lit(ALPHA)))
    factor = own + (1 - own) * max(0.0, min(1.0, gamma))
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), reward))
    numbered = steps.withColumns({"_n": F.row_number().over(later), "_f": factor, "_r": F.first(clamped).over(later)})
    share = lambda c: F.sum(F.when(F.col("_n") > 1, c).otherwise(0)).over(later.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    none, logs = share(F.when(F.col("_f") == 0, 1).otherwise(0)), share(F.when(F.col("_f") > 0, F.log("_f")).otherwise(0.0))
    valued = numbered.withColumns({"_z": none, "_l": logs}).withColumn("value", F.when(F.col("_z") > 0, 0.0).otherwise(F.col("_r") * F.exp("_l")))
    return valued.withColumn("priority", F.greatest(F.col("value"), F.lit(0.0)) * F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / max(1.0, half_life))).drop("_n", "_f", "_r", "_z", "_l")


def feedback_values(records: DataFrame, feedback: DataFrame, now: Column) -> DataFrame:
    """id, value, priority of L1 records (id, episode_id, message_index, at, alpha) after a log of feedback (feedback_id, memory_id, rating, created_at).

    Feedback counts once by its id, in order of time. Each moves its record's value by the rating's delta, held within [-1, 1], and the
    value then goes back over the whole episode. So all values of an episode are one number times each record's share of it, and an event is
    x -> clamp(share * x + delta): such steps are folded day by day into one step of the same form, and the days into one, so that no row holds
    more than a day of one episode's feedback. Records of episodes without feedback have no row."""
    later = Window.partitionBy("episode_id").orderBy(F.desc("message_index"), F.desc("id"))
    own = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("alpha", F.lit(ALPHA))))
    numbered = records.withColumns({"_n": F.row_number().over(later), "_f": own + (1 - own) * GAMMA})
    shares = numbered.withColumn("_share", F.exp(F.sum(F.when(F.col("_n") > 1, F.log("_f")).otherwise(0.0)).over(later.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    once = feedback.groupBy("feedback_id").agg(*(F.min_by(c, "created_at").alias(c) for c in ("memory_id", "rating")), F.min("created_at").alias("created_at"))
    events = once.join(shares.select(F.col("id").alias("memory_id"), "episode_id", "_share"), "memory_id").select(
        "episode_id", F.to_date("created_at").alias("day"), F.struct("created_at", "feedback_id", F.col("_share").alias("a"), X.feedback_delta("rating").alias("b"), F.lit(-1.0).alias("low"), F.lit(1.0).alias("high")).alias("e")
    )
    whole = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"))
    held = lambda x, e: F.greatest(e["low"], F.least(e["high"], e["a"] * x + e["b"]))
    then = lambda s, e: F.struct((e["a"] * s["a"]).alias("a"), (e["a"] * s["b"] + e["b"]).alias("b"), held(s["low"], e).alias("low"), held(s["high"], e).alias("high"))
    folded = lambda items: F.aggregate(items, whole, then)
    days = events.groupBy("episode_id", "day").agg(F.sort_array(F.collect_list("e")).alias("l")).select("episode_id", F.struct("day", folded(F.col("l")).alias("s")).alias("d"))
    all_days = days.groupBy("episode_id").agg(F.sort_array(F.collect_list("d")).alias("l")).select("episode_id", folded(F.transform("l", lambda d: d["s"])).alias("s"))
    ends = all_days.select("episode_id", held(F.lit(0.0), F.col("s")).alias("_x"))
    valued = shares.join(ends, "episode_id").withColumn("value", F.col("_x") * F.col("_share"))
    age = F.greatest((now - F.coalesce("at", now)) / 86400.0, F.lit(0.0))
    return valued.select("id", "value", (F.greatest(F.col("value"), F.lit(0.0)) * F.pow(F.lit(0.5), age / PRIORITY_DAYS)).alias("priority"))


def turn_relations(events: DataFrame, who: str = "user_id", at: str = "ts", key: str = "event_id", text: str | None = None) -> DataFrame:
    """Relation of each event to the one before it: new-task for the first, revision for a correcting phrase, new-task for a phrase that says
    so or after more than two idle hours, else follow-up. Without a text column phrases are not looked at."""
    w = Window.partitionBy(who).orderBy(at, key)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = (micros(F.col(at)) - micros(F.lag(at).over(w))) / 1e6
    said = F.lit("") if text is None else stripped(text)
    first = F.lag(F.lit(1)).over(w).isNull() if text is None else F.coalesce(F.lag(text).over(w), F.lit("")) == ""
    marked = events.select(key, who, gap.alias("gap_seconds"), first.alias("_first"), said.rlike(X.REVISION_TAG).alias("_fix"), said.rlike(X.NEW_TASK_TAG).alias("_new"))
    relation = F.when(F.col("_first"), "new-task").when(F.col("_fix"), "revision").when(F.col("_new") | (F.col("gap_seconds") > IDLE_SECONDS), "new-task").otherwise("follow-up")
    return marked.withColumn("relation", relation).drop("_first", "_fix", "_new")


def best_copies(rows: DataFrame, content: str, *order: Column) -> DataFrame:
    """The first row by order for each digest of stripped content. A digest's rows are reduced before the shuffle."""
    digest = F.sha2(stripped(content).cast("binary"), 256)
    return rows.withColumn("_h", digest).withColumn("_n", F.row_number().over(Window.partitionBy("_h").orderBy(*order))).where("_n = 1").drop("_h", "_n")


def folded_copies(rows: DataFrame, content: str, *order: Column) -> DataFrame:
    """The first row by order for each folded, stripped content."""
    return rows.withColumn("_h", F.sha2(stripped(folded(content)).cast("binary"), 256)).withColumn("_n", F.row_number().over(Window.partitionBy("_h").orderBy(*order))).where("_n = 1").drop("_h", "_n")


def upserted(old: DataFrame, new: DataFrame, key: str, kept: tuple[str, ...]) -> DataFrame:
    """new over old by key; `kept` columns stay as they were in old."""
    o, n = old.alias("o"), new.alias("n")
    columns = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) if c in (key, *kept) else F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*columns)


def linked_records(links: DataFrame, records: DataFrame, newest: int = 8) -> DataFrame:
    """node, other, relation, layer: the newest links of each record, either way, with the record at the other end."""
    both = links.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), "relation", "created_at").union(links.select("target_id", "source_id", "relation", "created_at"))
    ranked = both.withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("created_at"), "other", "relation"))).where(F.col("_n") <= newest).drop("_n")
    return ranked.join(records.select(F.col("id").alias("other"), "layer"), "other", "left").select("node", "other", "relation", "layer")


def timeline(records: DataFrame, session: str | None = None, most: int = 500) -> DataFrame:
    """L0 and L1 records of one session by index, layer and time, `most` of them; of all sessions, `most` of each, which no single task sorts."""
    own = records.where(F.col("layer").isin("L0", "L1"))
    times = ["created_at"] if "created_at" in records.columns else []
    if session is not None:
        return own.where(F.col("session_id") == session).orderBy("message_index", "layer", *times).limit(most)
    return top_k(own, most, F.asc("message_index"), F.asc("layer"), *map(F.asc, times), by="session_id").withColumnRenamed("rank", "place")


def session_summary(messages: DataFrame) -> DataFrame:
    """session_id, messages, chars, first_index, last_index of a session's messages."""
    return messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.sum(F.length("content")).alias("chars"), F.min("message_index").alias("first_index"), F.max("message_index").alias("last_index"))


def lifecycle_counts(records: DataFrame) -> DataFrame:
    """layer, candidates (with pending ones), accepted."""
    return records.groupBy("layer").agg(F.count_if(F.col("status").isin("candidate", "pending")).alias("candidates"), F.count_if(F.col("status") == "accepted").alias("accepted"))


def vector_counts(records: DataFrame, model: str, width: int) -> DataFrame:
    """layer, indexed: records whose vector is of this model and width."""
    return records.groupBy("layer").agg(F.count_if((F.col("embedding_model") == model) & (F.col("embedding_dim") == width)).alias("indexed"))


def backfilled(records: DataFrame, model: str, width: int, encode) -> DataFrame:
    """records, those without a vector of this model and width encoded anew by encode(content column)."""
    stale = F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model)) | ~F.col("embedding_dim").eqNullSafe(F.lit(width))
    fresh, old = records.where(~stale), records.where(stale)
    made = old.withColumns({"embedding": encode(F.col("content")), "embedding_model": F.lit(model), "embedding_dim": F.lit(width)})
    return fresh.unionByName(made.select(fresh.columns))


def newest(records: DataFrame, limit: int, by: str = "updated_at") -> DataFrame:
    """The newest max(1000, 200 limit) records: what a store reads for one question."""
    return records.orderBy(F.desc(by), "id").limit(max(1000, 200 * limit))


def scoped(records: DataFrame, user: Column) -> DataFrame:
    """L0 and L1 records in a user's namespace."""
    return records.where(F.col("session_id").startswith(X.user_namespace(user)) & F.col("layer").isin("L0", "L1"))


def scoped_ingest(messages: DataFrame) -> DataFrame:
    """L0 and L1 records of requests' messages (request_id, user_id, session_id, message_index, role, content, timestamp), in their users' namespaces.

    Blank roles and contents make no record, nor do secrets. The id follows from request, place, role and content, so a request sent twice
    makes the same records."""
    clean = messages.withColumns({"role": stripped("role"), "content": stripped("content")}).where("role <> '' and content <> ''").where(~X.has_secret("content"))
    twins = clean.withColumn("layer", F.explode(F.array(F.lit("L0"), F.lit("L1"))))
    key = X.digest_key("", 32, F.col("request_id"), F.col("message_index"), F.col("role"), F.col("content"))
    session = F.concat(X.user_namespace(F.col("user_id")), X.digest_key("", 32, F.col("session_id")))
    return twins.select(F.concat(F.lit("aml:"), F.col("layer"), F.lit(":"), key).alias("id"), "layer", session.alias("session_id"), "message_index", "role", "content", "timestamp").dropDuplicates(["id"])


def ingest_report(messages: DataFrame) -> DataFrame:
    """request_id, stored_messages, skipped_sensitive, ok: a request without any storable message is refused."""
    secret = X.has_secret("content")
    good = (stripped("role") != "") & (stripped("content") != "")
    return messages.groupBy("request_id").agg(F.count_if(good & ~secret).alias("stored_messages"), F.count_if(good & secret).alias("skipped_sensitive")).withColumn("ok", F.col("stored_messages") > 0)


#: Fixed values of the memory planes: least likeness without a term, weight of a term and its cap.
LEAST_COSINE, TERM_WEIGHT, TERM_CAP = 0.12, 0.16, 0.65


def _matched(queries: DataFrame, records: DataFrame, stop: tuple[str, ...]) -> DataFrame:
    """query_id, id, matched: distinct terms of a question that a record's content holds."""
    terms = queries.select("query_id", F.explode(Q.plane_terms("query", stop)).alias("term"))
    found = matched_terms(terms, records.select("id", F.col("content").alias("text")))
    if found is not None:
        return found.select("id", "query_id", "matched")
    docs = records.select(F.col("id").alias("doc_id"), F.lit("").alias("path"), F.col("content").alias("text"))
    return term_counts(terms.select("term").distinct(), docs).join(small(terms), "term").groupBy(F.col("doc_id").alias("id"), "query_id").agg(F.count("*").alias("matched"))


#: Copies of a content that one task compares; of more, tasks compare parts, and the best ones of the parts meet.
MOST_COPIES = 1024


def memory_candidates(queries: DataFrame, records: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """query_id, id, relevance, matched, cos, promoted, and with limit vector: records for each question, the best copy of each stripped content.

    queries: query_id (distinct), query, vector; records: id, layer, role, content, status, accepted, at (epoch seconds), priority, vector. A question
    that a user asked is no answer; a record needs a matched term or a cosine of .12. All records are looked at, or with limit
    (hits that a question is to have) only the newest ones, see newest().

    Records are dealt by their content, so copies meet in a task, which scores them for all questions and hands on the best: no pair is shuffled or stored before."""
    own = (records if limit is None else newest(records, limit, "at")).where(~X.is_question_turn("role", "content"))
    told = materialised(own.withColumn("_h", F.coalesce(F.sha2(stripped("content").cast("binary"), 256), F.lit(""))), "told")
    terms = queries.select("query_id", F.filter(F.coalesce(Q.plane_terms("query", X.MEMORY_STOP_WORDS), F.array().cast("array<string>")), lambda t: t != "").alias("terms"), F.coalesce(X.is_latest("query"), F.lit(False)).alias("latest"))
    few, asked = P.few_terms(terms.select(F.explode("terms").alias("term"))), numbered(terms, "query_id", "terms", "latest")
    found = _joined_candidates(queries, told, now) if few is None or asked is None else _dealt_candidates(queries, told, now, few, {r["query_id"]: (r["terms"], r["latest"]) for r in asked})
    return found if limit is None else found.join(told.select("id", "vector").dropDuplicates(["id"]), "id").select(*found.columns, "vector")


def _joined_candidates(queries: DataFrame, told: DataFrame, now: Column) -> DataFrame:
    """memory_candidates() for more questions or terms than a task may hold."""
    pairs = N.cosines(queries, told).join(_matched(queries, told, X.MEMORY_STOP_WORDS), ["query_id", "id"], "left").fillna(0, ["matched"]).where((F.col("matched") > 0) | (F.col("cos") >= LEAST_COSINE))
    latest = queries.select("query_id", X.is_latest("query").alias("_latest"))
    rows = pairs.join(told, "id").join(small(latest), "query_id").withColumn("promoted", C.promoted(F.col("accepted"), F.col("status")))
    age = (now - F.col("at")) / 86400.0
    scored = rows.withColumn("relevance", memory_relevance(F.col("cos"), F.col("matched"), F.col("layer"), F.col("promoted"), recency(age, F.col("_latest")), F.col("priority")))
    return _best_of(scored).select("query_id", "id", "relevance", "matched", "cos", "promoted")


def _best_of(scored: DataFrame) -> DataFrame:
    return scored.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_h").orderBy(F.desc("relevance"), "id"))).where("_n = 1")


def _dealt_candidates(queries: DataFrame, told: DataFrame, now: Column, terms: list[str], asked: dict) -> DataFrame:
    promoted = C.promoted(F.col("accepted"), F.col("status"))
    fresh = F.pow(F.lit(0.5), F.greatest((now - F.col("at")) / 86400.0, F.lit(0.0)) / HALF_LIFE_DAYS)
    rows = told.select("_h", "id", F.lower(text_of("content")).alias("text"), "vector", promoted.alias("promoted"), layer_bonus(F.col("layer"), promoted).alias("bonus"), fresh.alias("fresh"), urgency(F.col("priority")).alias("urgency"))
    many = materialised(told.groupBy("_h").agg(F.count("*").alias("_copies")).where(F.col("_copies") > MOST_COPIES), "many-copies")
    if not many.head(1):
        return _scored_groups(queries, rows, terms, asked).drop("_h")
    rows = rows.join(small(many), "_h", "left")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("_copies") / MOST_COPIES))
    split = rows.where("_copies is not null").withColumn("_h", F.concat_ws(":", "_h", part.cast("string")))
    parts = _scored_groups(queries, split.drop("_copies"), terms, asked).withColumn("_h", F.substring_index("_h", ":", 1))
    return _scored_groups(queries, rows.where("_copies is null").drop("_copies"), terms, asked).unionByName(_best_of(parts).drop("_n")).drop("_h")


def _scored_groups(queries: DataFrame, rows: DataFrame, terms: list[str], asked: dict) -> DataFrame:
    """query_id, id, relevance, matched, cos, promoted, _h: the best of each _h of rows for each question, by relevance and id."""
    spark, out = rows.sparkSession, None
    dealt = rows.repartition("_h").sortWithinPartitions("_h", "id")
    kind = rows.schema["id"].dataType.simpleString()
    for ids, vectors in N.blocks_of(queries):
        known = [asked[i] for i in ids]
        shared = spark.sparkContext.broadcast((terms, P.Questions(terms, [(own, []) for own, _ in known]), N.matrices_of(ids, vectors), [LATEST_WEIGHT if latest else USUAL_WEIGHT for _, latest in known]))
        found = dealt.mapInArrow(_group_scores(shared), f"q int, id {kind}, relevance double, matched bigint, cos double, promoted boolean, _h string")
        names = spark.createDataFrame(list(enumerate(ids)), f"q int, query_id {queries.schema['query_id'].dataType.simpleString()}")
        found = found.join(F.broadcast(names), "q").select("query_id", "id", "relevance", "matched", "cos", "promoted", "_h")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {kind}, relevance double, matched bigint, cos double, promoted boolean, _h string")


def _group_scores(shared):
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        terms, questions, matrices, weights = shared.value
        finder, n, weights = P.Finder(terms) if terms else None, questions.n, np.array(weights)
        names = ["q", "id", "relevance", "matched", "cos", "promoted", "_h"]
        held = None  # the best ones of the last group, which may go on in the next batch

        def best(batch):
            """The best ones of each group of a batch, with _key, what they are compared by, and _g, the number of the group."""
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            matched = np.zeros((len(batch), n), np.int64)
            if finder is not None:
                matched = questions.sums(len(batch), *finder.counted(batch.column("text").to_pylist()))[0].reshape(len(batch), n)
            cos = np.concatenate([x for _, x in N.products_of(batch, batch.schema.get_field_index("vector"), n, matrices)])
            aged = np.asarray(batch.column("fresh").is_null())
            fresh = np.nan_to_num(column("fresh").astype(float))
            relevance = cos + np.minimum(0.65, 0.16 * matched) + column("bonus")[:, None] + fresh[:, None] * weights + column("urgency")[:, None]
            key = np.where(np.isnan(relevance), np.inf, relevance)
            key[aged] = np.finfo(float).min  # of unknown age: after all others
            key[(matched == 0) & (cos < LEAST_COSINE)] = -np.inf
            code = batch.column("_h").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            most = np.maximum.reduceat(key, starts, axis=0)
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(code)]))
            first = np.minimum.reduceat(np.where(key == most[group], np.arange(len(code))[:, None], len(code)), starts, axis=0)  # rows are in order of id
            g, q = np.nonzero(most > -np.inf)
            r = first[g, q]
            values = [pa.array(q, pa.int32()), batch.column("id").take(pa.array(r)), pa.array(relevance[r, q], mask=aged[r]), pa.array(matched[r, q], pa.int64()), pa.array(cos[r, q]), batch.column("promoted").take(pa.array(r)), batch.column("_h").take(pa.array(r))]
            return pa.table([*values, pa.array(most[g, q]), pa.array(g)], names=[*names, "_key", "_g"]), len(starts), batch.column("_h")[0].as_py(), batch.column("_h")[len(batch) - 1].as_py()

        def handed_on(table):
            return table.select(names).combine_chunks().to_batches(max_chunksize=P.HELD_ROWS)

        last = None
        for whole in batches:
            step = max(1, P.CELLS // max(1, n))
            for start in range(0, len(whole), step):
                found, groups, first_h, last_h = best(whole.slice(start, step))
                g = found.column("_g").to_numpy()
                if held is not None and first_h == last:  # the group goes on: of each question the better one, of equal ones the earlier
                    both = pa.concat_tables([held, found.filter(pa.array(g == 0))])
                    q = both.column("q").to_numpy()
                    order = np.lexsort((np.arange(len(q)), -both.column("_key").to_numpy(), q))
                    held = both.take(pa.array(order[np.r_[True, np.diff(q[order]) != 0] if len(q) else np.zeros(0, bool)]))
                    found, g = found.filter(pa.array(g > 0)), g[g > 0]
                    if groups == 1:
                        continue
                if held is not None:
                    yield from handed_on(held)
                held, last = found.filter(pa.array(g == groups - 1)), last_h
                yield from handed_on(found.filter(pa.array(g < groups - 1)))
        if held is not None:
            yield from handed_on(held)

    return run


def two_pools(picked: DataFrame, spare: DataFrame, k: int) -> DataFrame:
    """picked (query_id, id, pick) of promoted records, then as many of spare's as places are left: new column place."""
    both = picked.withColumn("_p", F.lit(0)).unionByName(spare.withColumn("_p", F.lit(1)))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_p", "pick"))).where(F.col("place") <= k).drop("_p", "pick")


def memory_search(queries: DataFrame, records: DataFrame, now: Column, k: int = 5) -> DataFrame:
    """query_id, id, place: memories that are relevant and differ, promoted ones first, candidates where places are left."""
    found = memory_candidates(queries, records, now, k)
    window = max(20, 8 * k)
    return two_pools(mmr(found.where("promoted"), k, pool=window), mmr(found.where("not promoted"), k, pool=window), k)


def scoped_search(queries: DataFrame, records: DataFrame, most: int = 100) -> DataFrame:
    """query_id, id, score, rank: of the asking user's records only, the first of each folded content.

    queries: query_id, user_id, query, vector; records as scoped_ingest() makes them, with at (epoch seconds) and vector. Questions for the
    latest add up to .35 for a record's place between the oldest and the newest of its scope."""
    asked = queries.withColumn("scope", X.user_namespace(F.col("user_id")))
    own = records.where(F.col("layer").isin("L0", "L1"))
    # a session's namespace is its text up to the second colon, so questions meet their scope by an equi-join
    named = own.withColumn("scope", F.concat(F.substring_index("session_id", ":", 2), F.lit(":")))
    spans = named.groupBy("scope").agg(F.min("at").alias("_low"), F.max("at").alias("_high"))
    # neither vectors nor contents go on with the pairs: each is read where a record meets the questions of its scope
    narrow = named.select("id", "scope", "at", "vector", F.sha2(stripped(folded("content")).cast("binary"), 256).alias("_h"))
    pairs = narrow.join(asked.select("query_id", "scope", F.col("vector").alias("_q"), X.is_latest("query").alias("_latest")), "scope").withColumn("cos", V.cosine(F.col("_q"), F.col("vector"))).drop("_q", "vector").join(small(spans), "scope")
    scored = pairs.join(_matched(asked, own, X.MEMORY_STOP_WORDS), ["query_id", "id"], "left").fillna(0, ["matched"]).where((F.col("matched") > 0) | (F.col("cos") >= LEAST_COSINE))
    fresh = F.when(F.col("_latest"), bounded_recency(F.col("at"), F.col("_low"), F.col("_high"))).otherwise(0.0)
    score = F.col("cos") + F.least(F.lit(TERM_CAP), TERM_WEIGHT * F.col("matched")) + fresh
    ranked = scored.select("query_id", "id", F.round(score, 9).alias("score"), "_h")
    once = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_h").orderBy(F.desc("score"), "id"))).where("_n = 1")
    return top_k(once, most, F.desc("score"), F.asc("id")).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def plain_score(matched: Column, layer: Column) -> Column:
    """Of the small store without vectors: matched terms, and .1 for an L1 record."""
    return matched + F.when(layer == "L1", 0.1).otherwise(0.0)


def plain_search(queries: DataFrame, records: DataFrame, k: int = 5) -> DataFrame:
    """query_id, id, score, rank: of the small store without vectors (records: id, layer, content), by plain_score() and id."""
    terms = queries.select("query_id", F.explode(Q.plane_terms("query", X.MEMORY_STOP_WORDS)).alias("term"))
    found = matched_terms(terms, records.select("id", "layer", F.col("content").alias("text")), _plain_points, "double", k, ("id",))  # a task's first k
    if found is None:
        found = _matched(queries, records, X.MEMORY_STOP_WORDS).join(records.select("id", "layer"), "id")
    return top_k(found.select("query_id", "id", F.round(plain_score(F.col("matched"), F.col("layer")), 6).alias("score")), k, F.desc("score"), F.asc("id"))


def _plain_points(columns, row, q, matched, words, covered):
    """plain_score() of a task's rows."""
    import numpy as np

    own = np.array([layer == "L1" for layer in columns.column("layer").to_pylist()], bool)
    return matched + np.where(own[row], 0.1, 0.0)


def profile_rank(queries: DataFrame, profiles: DataFrame, k: int = 5) -> DataFrame:
    """query_id, id, score, rank of scenario and profile texts (id, content) by how often they hold a question's words."""
    words = queries.select("query_id", F.explode(F.regexp_extract_all(F.lower("query"), F.lit(r"(?U)([\w一-龥.-]{2,})"), F.lit(1))).alias("term"))
    docs = profiles.select(F.col("id").alias("doc_id"), F.lit("").alias("path"), F.col("content").alias("text"))
    counts = term_counts(words.select("term").distinct(), docs).join(small(words), "term").groupBy("query_id", F.col("doc_id").alias("id")).agg(F.sum("n").alias("score"))
    return top_k(counts.where("score > 0"), k, F.desc("score"), F.asc("id"))


def observed(records: DataFrame, session: str, most: int = 100) -> DataFrame:
    """What a session has in layer L1, in order."""
    return records.where((F.col("layer") == "L1") & (F.col("session_id") == session)).orderBy("message_index").limit(most)


def reflected(hits: DataFrame, records: DataFrame) -> DataFrame:
    """query_id, status, evidence_count, observations: a digest of hits (query_id, id, place), marked as a candidate that nobody accepted."""
    rows = hits.join(records.select("id", "layer", F.substring("content", 1, 512).alias("observation"), "status"), "id")
    digest = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "id", "layer", "observation", "status"))).alias("observations"))  # k rows a question
    return digest.select("query_id", F.lit("candidate").alias("status"), F.lit(True).alias("generated"), F.lit(False).alias("accepted"), F.size("observations").alias("evidence_count"), "observations")


def after_cursor(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Messages after a session's high-water mark (session_id, after_ts); messages without a time stay."""
    joined = messages.join(cursors, "session_id", "left")
    return joined.where("after_ts is null or ts is null or ts > after_ts").drop("after_ts")
