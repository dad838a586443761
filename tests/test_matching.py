"""Asked terms in words, by tasks: sums are right over batches, keys of any type, and with more terms than a task may hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.functions import matching as P
from mnemolake.operators import index as I
from mnemolake.operators import ranking as K

TEXTS = ["aaaa aa b.aab, Übergröße ÜBER", "", None, "x" * 500 + "aa", "b aab aab b"]
TERMS = ["aa", "aab", "b", "über", "größe", "nowhere", "x" * 40]


def brute(texts, terms):
    low = {i: (t or "").lower() for i, t in enumerate(texts)}
    return sorted((i, t, s.count(t), t in f"aa/{i}.md") for i, s in low.items() for t in terms if t in s or t in f"aa/{i}.md")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, f"aa/{i}.md", t) for i, t in enumerate(texts)], "doc_id long, path string, text string").repartition(3)


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "term", "n", "in_path").collect())


def test_term_counts_with_few_and_with_many_terms(spark, monkeypatch):
    asked = spark.createDataFrame([(t,) for t in [*TERMS, "aa", ""]], "term string")
    docs = docs_of(spark, TEXTS)
    assert rows(K.term_counts(asked, docs)) == brute(TEXTS, TERMS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # documents lie over many batches
    try:
        assert rows(K.term_counts(asked, docs)) == brute(TEXTS, TERMS)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(P, "MOST_TERMS", 2)
    assert rows(K.term_counts(asked, docs)) == brute(TEXTS, TERMS)


def test_index_counts_with_few_and_with_many_terms(spark, monkeypatch):
    texts = [f"{TEXTS[k % 5] or ''} word{k} aab" for k in range(70)]
    index = K.temporary_index(docs_of(spark, texts))
    asked = spark.createDataFrame([(t,) for t in TERMS], "term string")
    found = []
    for most in (P.MOST_TERMS, 2):
        monkeypatch.setattr(P, "MOST_TERMS", most)
        own = I.terms_of(asked, index)
        assert (own.few is None) == (most == 2)
        counts = I.block_counts(own, None, index).join(index.pages.select("doc_id", "block", "slot"), ["block", "slot"])
        assert rows(counts) == brute(texts, TERMS)
        found.append(sorted(tuple(r) for r in I.term_blocks(own, index).select("term", "block", "mask", "path_mask", "head_mask", "top").collect()))
        df = {r["term"]: r["df"] for r in I.frequencies(I.term_blocks(own, index)).collect()}
        assert df == {t: n for t in TERMS if (n := sum(1 for _, x, *_ in brute(texts, [t])))}
    assert found[0] == found[1]


def test_search_of_all_pairs_shuffles_none(spark):
    """Without k, pairs stay in the tasks of their blocks: the plan deals rows out by block or by question only, never by block and slot."""
    docs = docs_of(spark, [f"alpha beta{k}" for k in range(40)])
    asked = spark.createDataFrame([(1, "alpha beta1"), (2, "gamma alpha")], "query_id long, query string")
    found = K.scored(asked, docs)
    assert found.groupBy("query_id").agg(F.count("*").alias("n")).count() == 2 and found.count() == 80
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and not any("slot" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_memory_candidates_look_at_all_records(spark):
    """Without a limit the oldest of more than 1000 records is found; with one only the newest are looked at."""
    from mnemolake.operators import memory as M

    told = spark.range(1200).select(
        F.col("id").cast("string").alias("id"), F.lit("L1").alias("layer"), F.lit("assistant").alias("role"), F.concat(F.when(F.col("id") == 0, "zebra").otherwise("horse"), F.col("id").cast("string")).alias("content"),
        F.lit("verified").alias("status"), F.lit(True).alias("accepted"), F.col("id").cast("double").alias("at"), F.lit(0.0).alias("priority"), F.array(F.lit(0.0), F.lit(1.0)).alias("vector"),
    )
    asked = spark.createDataFrame([(1, "zebra", [1.0, 0.0])], "query_id long, query string, vector array<double>")
    assert [r["id"] for r in M.memory_candidates(asked, told, F.lit(2000.0)).collect()] == ["0"]
    assert M.memory_candidates(asked, told, F.lit(2000.0), 5).count() == 0


def test_memory_candidates_shuffle_records_not_pairs(spark, monkeypatch):
    """Copies meet in the task that scores them, whatever the batches and parts they come in: the best ones are those of the joined pairs, and no pair is shuffled."""
    from mnemolake.operators import memory as M

    records = spark.range(400).selectExpr(
        "concat('r', id) as id", "if(id % 2 = 0, 'L0', 'L1') as layer", "if(id % 9 = 0, 'user', 'assistant') as role", "case when id % 3 = 0 then ' the same reward ' when id % 11 = 0 then null else concat('note ', id % 40, ' alpha') end as content",
        "if(id % 4 = 1, 'candidate', 'verified') as status", "id % 4 <> 1 as accepted", "if(id % 13 = 0, null, 1.7e9D + id % 5) as at", "id % 7 - 3.0D as priority", "array(cos(id * 1.0D), sin(id * 1.0D)) as vector",
    )
    asked = spark.createDataFrame([(1, "latest reward", [1.0, 0.0]), (2, "alpha note 7", [0.0, 1.0]), (3, None, [0.6, 0.8]), (4, "the", None)], "query_id bigint, query string, vector array<double>")
    now, rows = F.lit(1.705e9), lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)
    found = M.memory_candidates(asked, records, now)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Window" not in above and "LeftOuter" not in above
    with monkeypatch.context() as m:
        m.setattr(M.P, "few_terms", lambda terms: None)  # more than a task may hold
        want = rows(M.memory_candidates(asked, records, now))
    assert len(want) > 60 and rows(found) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert rows(M.memory_candidates(asked, records, now)) == want
        monkeypatch.setattr(M, "MOST_COPIES", 7)
        assert rows(M.memory_candidates(asked, records, now)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
