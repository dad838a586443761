"""Evaluation of ranked results against relevance judgements, and audits of the judgements and of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.operators.retrieval import small
from mnemolake.sources.scratch import materialised

# Least figures of the gate, and qualities that do not count as strict.
LEAST_P1, LEAST_RECALL = 0.8, 0.8
LOOSE = ("ambiguous", "temporal-ambiguous")


def per_query(queries: DataFrame, results: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """query_id, intent, abstained, first_hit (rank; null), hits, relevant for each query.

    queries: query_id, intent; results: query_id, doc_id, rank; gold: query_id, doc_id."""
    top = results.where(F.col("rank") <= k)
    hit = top.join(gold.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_hit"), F.count("*").alias("hits"))
    relevant = gold.groupBy("query_id").agg(F.count_distinct("doc_id").alias("relevant"))
    found = top.groupBy("query_id").agg(F.count("*").alias("n"))
    joined = queries.join(relevant, "query_id", "left").join(hit, "query_id", "left").join(found, "query_id", "left")
    return joined.select("query_id", "intent", F.col("n").isNull().alias("abstained"), "first_hit", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("relevant", F.lit(0)).alias("relevant"))


def metrics(rows: DataFrame, by_intent: bool = False) -> DataFrame:
    """P@1, MRR, recall (macro, micro) over queries with gold and abstention over those without; with a grand total (null intent) if by intent."""
    has = F.col("relevant") > 0
    one = lambda c: F.round(F.avg(F.when(has, c)), 6)
    made = [
        F.count("*").alias("queries"),
        one(F.when(F.col("first_hit") == 1, 1.0).otherwise(0.0)).alias("p_at_1"),
        one(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))).alias("mrr"),
        one(F.col("hits") / F.col("relevant")).alias("recall_macro"),
        F.round(F.sum(F.when(has, F.col("hits"))) / F.sum(F.when(has, F.col("relevant"))), 6).alias("recall_micro"),
        F.round(F.avg(F.when(~has, F.col("abstained").cast("int"))), 6).alias("abstention"),
    ]
    return rows.rollup("intent").agg(*made) if by_intent else rows.agg(*made)


def audit(queries: DataFrame, gold: DataFrame) -> DataFrame:
    """problem, n: judgements of unknown queries, positive queries without judgements, negative ones with, repeated judgements."""
    unknown = gold.join(queries, "query_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("unknown_query").alias("problem"), "n")
    missing = queries.where("not expected_abstain").join(gold, "query_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("missing_gold").alias("problem"), "n")
    negative = queries.where("expected_abstain").join(gold, "query_id", "left_semi").agg(F.count("*").alias("n")).select(F.lit("negative_with_gold").alias("problem"), "n")
    repeated = gold.groupBy("query_id", "doc_id").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n")).select(F.lit("repeated").alias("problem"), "n")
    return unknown.union(missing).union(negative).union(repeated)


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, p50 (exact median), p95 (the value at place int((n - 1) * .95) of the sorted ones).

    Equal values of a key are counted first and dealt as one row into ranges of (by, value); only the ranges that hold a wanted rank are summed up,
    so no task has a key's values, nor the copies of one."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    ranged = materialised(values.repartitionByRange(parts, by, value).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(by, "_p").agg(F.sum("_c").alias("_c"))  # a row for each key and range
    at = Window.partitionBy(by)
    placed = counts.withColumns({"_end": F.sum("_c").over(at.orderBy("_p")), "n": F.sum("_c").over(at)})
    n = F.col("n")
    wanted = F.array_distinct(F.array(F.floor((n + 1) / 2), F.ceil((n + 1) / 2), F.floor((n - 1) * 0.95) + 1))
    ranks = placed.select(by, "_p", "n", (F.col("_end") - F.col("_c")).alias("_before"), "_c", F.explode(wanted).alias("_rank")).where("_rank > _before and _rank <= _before + _c")
    local = ranks.select(by, "_p", (F.col("_rank") - F.col("_before")).alias("_n"), "_rank", "n")
    held = ranged.join(small(local.select(by, "_p").distinct()), [by, "_p"], "left_semi").withColumn("_end", F.sum("_c").over(Window.partitionBy(by, "_p").orderBy(value)))
    ranked = held.join(small(local), [by, "_p"]).where("_n > _end - _c and _n <= _end")
    middle = F.avg(F.when((F.col("_rank") == F.floor((n + 1) / 2)) | (F.col("_rank") == F.ceil((n + 1) / 2)), F.col(value)))
    return ranked.groupBy(by, "n").agg(F.round(middle, 6).alias("p50"), F.round(F.max(F.when(F.col("_rank") == F.floor((n - 1) * 0.95) + 1, F.col(value))), 6).alias("p95"))


def graded(queries: DataFrame, results: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """query_id, quality, expected_abstain, rank, primary_rank, hits, relevant, verified, candidates, parseable: what the gate's figures are made of.

    queries: query_id, quality, expected_abstain; results: query_id, doc_id, rank, lane, citation_valid; gold: query_id, doc_id, relevance (2: primary)."""
    top = results.where((F.col("lane") == "verified") & (F.col("rank") <= k))
    own = gold.groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance")).where("relevance > 0")
    met = top.join(own, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"), F.min(F.when(F.col("relevance") >= 2, F.col("rank"))).alias("primary_rank"), F.count("*").alias("hits"))
    lanes = results.groupBy("query_id").agg(F.count_if((F.col("lane") == "verified") & (F.col("rank") <= k)).alias("verified"), F.count_if(F.col("lane") == "candidate").alias("candidates"), F.count_if((F.col("lane") == "verified") & (F.col("rank") <= k) & F.col("citation_valid")).alias("parseable"))
    relevant = own.groupBy("query_id").agg(F.count("*").alias("relevant"))
    out = queries.join(met, "query_id", "left").join(lanes, "query_id", "left").join(relevant, "query_id", "left")
    return out.select("query_id", "quality", "expected_abstain", "rank", "primary_rank", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("hits", "relevant", "verified", "candidates", "parseable")))


def gate_figures(rows: DataFrame) -> DataFrame:
    """One row: p_at_1, primary_p_at_1, strict_p_at_1, focused_p_at_1, recall, negative_abstain, citation_parseability, contamination, exposure of graded() rows."""
    positive = ~F.col("expected_abstain")
    first = lambda c, of=positive: F.avg(F.when(of, F.coalesce((F.col(c) == 1).cast("double"), F.lit(0.0))))
    share = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(0.0)
    figures = {
        "p_at_1": first("rank"), "primary_p_at_1": first("primary_rank"), "strict_p_at_1": first("rank", positive & ~F.col("quality").isin(*LOOSE)), "focused_p_at_1": first("rank", positive & (F.col("quality") == "focused")),
        "recall": F.avg(F.when(positive, F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0))), "negative_abstain": F.avg(F.when(~positive, (F.col("verified") == 0).cast("double"))),
        "citation_parseability": share(F.col("parseable"), F.col("verified")), "contamination": share(F.col("candidates"), F.col("verified") + F.col("candidates")), "exposure": F.avg((F.col("candidates") > 0).cast("double")),
    }
    return rows.agg(*(F.round(c, 6).alias(n) for n, c in figures.items()))


def gate(figures: DataFrame, audit_ok: Column | bool = True) -> DataFrame:
    """check, ok of a gate: strict P@1 and recall of .8 or more, every citation readable, every negative question abstained, a clean audit."""
    checks = {
        "qrels_audit": F.lit(audit_ok) if isinstance(audit_ok, bool) else audit_ok, "strict_p_at_1": F.coalesce(F.col("strict_p_at_1"), F.lit(0.0)) >= LEAST_P1, "recall": F.coalesce(F.col("recall"), F.lit(0.0)) >= LEAST_RECALL,
        "citation_parseability": F.col("citation_parseability") == 1.0, "negative_abstain": F.coalesce(F.col("negative_abstain"), F.lit(1.0)) == 1.0,
    }
    return figures.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), c.alias("ok")) for n, c in checks.items()))).alias("c")).select("c.check", "c.ok")


def paired_calls(events: DataFrame) -> DataFrame:
    """request_id, response_id, latency_seconds: each user's request (view) with the next event if it answers (click or error)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ahead = events.select("event_id", "event_type", "ts", F.lead("event_id").over(w).alias("response_id"), F.lead("event_type").over(w).alias("_t"), F.lead("ts").over(w).alias("_at"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return ahead.where("event_type = 'view' and _t in ('click', 'error')").select(F.col("event_id").alias("request_id"), "response_id", F.round((micros("_at") - micros("ts")) / 1e6, 6).alias("latency_seconds"))
