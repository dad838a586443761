"""Scores by a scan: those of the index, with nothing shuffled but each task's first k."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from mnemolake.functions import matching as P
from mnemolake.operators import ranking as K
from mnemolake.operators import retrieval as R

WORDS = ["alpha", "beta", "betas", "gamma", "training", "trainings", "zeta9", "multi-word", "for", "late"]


def library(spark, n=120):
    rng = random.Random(5)
    rows = [(i, f"papers/{rng.choice(WORDS)}/{i}.md", None if i == 7 else " ".join(rng.choices(WORDS, k=rng.randint(0, 12)))) for i in range(n)]
    return spark.createDataFrame([*rows, *((n + i, f"papers/x/{n + i}.md", "alpha beta gamma") for i in range(40))], "doc_id long, path string, text string").repartition(5)


def questions(spark):
    asked = ["alpha beta", "training rewards", "how does multi-word zeta9", None, "nothing-here", "latest betas trainings gamma"]
    return spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "doc_id", "matched", "covered", "n_terms", "least", "score").collect())


def test_finder_counts_terms_without_overlaps(monkeypatch):
    rng = random.Random(1)
    for alphabet in ("ab", "abé漢/.-"):
        terms = sorted({"".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(60)})
        texts = ["".join(rng.choices(alphabet + " \n,😀", k=rng.randint(0, 150))) for _ in range(40)] + ["", "aaaaaaa"]
        for most in (1 << 21, 50):
            monkeypatch.setattr(P, "MOST_CHARS", most)
            got = sorted(zip(*(x.tolist() for x in P.Finder(terms).counted(texts))))
            assert got == sorted((r, i, s.count(t)) for r, s in enumerate(texts) for i, t in enumerate(terms) if t in s)


def test_scan_scores_as_the_index_does(spark, monkeypatch):
    docs, asked = library(spark), questions(spark)
    want = rows(K.scored(asked, docs))
    assert want and rows(K.scanned(asked, docs)) == want
    best = lambda df, k: rows(R.top_k(df, k, F.desc("score"), F.asc("doc_id")))
    monkeypatch.setattr(P, "HELD_ROWS", 8)  # tasks sort what they hold many times
    monkeypatch.setattr(P, "CELLS", 40)
    assert best(K.scanned(asked, docs, 3), 3) == best(K.scored(asked, docs), 3)
    assert K.scanned(asked, docs, 3).groupBy("query_id", F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 3
    monkeypatch.setattr(P, "MOST_TERMS", 2)
    assert rows(K.scanned(asked, docs)) == want


def test_scan_shuffles_no_pair(spark):
    plan = K.scanned(questions(spark), library(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_memories_and_team_records_by_terms_shuffle_no_pair(spark):
    """Each task hands on its first ones; equal scores go by id, active records and candidates apart."""
    from mnemolake.operators import memory as M
    from mnemolake.operators import team as T

    asked = spark.createDataFrame([(1, "alpha beta"), (2, "gamma gamma"), (3, "")], "query_id long, query string")
    texts = ["alpha", "ALPHA beta", "gamma", None, "none", "betas gamma"] * 30
    memories = spark.createDataFrame([(f"m{i:03}", f"L{i % 2}", t) for i, t in enumerate(texts)], "id string, layer string, content string").repartition(4)
    found = M.plain_search(asked, memories, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(id" not in plan
    terms = {1: ("alpha", "beta"), 2: ("gamma",)}
    want = []
    for q, ts in terms.items():
        rows = [(-(n + 0.1 * (i % 2)), f"m{i:03}") for i, t in enumerate(texts) if (n := sum(x in (t or "").lower() for x in ts))]
        want += [(q, m, round(-s, 6), k + 1) for k, (s, m) in enumerate(sorted(rows)[:3])]
    assert sorted(tuple(r) for r in found.select("query_id", "id", "score", "rank").collect()) == sorted(want)
    records = spark.createDataFrame([(i, "active" if i % 3 else "candidate", 0.5, t, None) for i, t in enumerate(texts)], "memory_id long, status string, confidence double, body string, valid_until string").repartition(4)
    feedback = spark.createDataFrame([(7, "helpful"), (9, "wrong")], "memory_id long, rating string")
    hits = T.team_hits(asked.where("query_id < 3"), records, feedback, F.lit("2024-01-01").cast("timestamp"), 4)
    assert "hashpartitioning(doc_id" not in hits._jdf.queryExecution().executedPlan().toString()
    want = []
    for q, ts in terms.items():
        for status in ("active", "candidate"):
            rows = []
            for i, t in enumerate(texts):
                n = sum(x in (t or "").lower() for x in ts)
                if n and ("active" if i % 3 else "candidate") == status:
                    rows.append((-round(2 * n + 0.5 + (0.15 if i == 7 else 0) - (0.2 if i == 9 else 0) + (0.4 if i % 3 else 0), 6), i))
            want += [(q, m, round(-s, 6), k + 1) for k, (s, m) in enumerate(sorted(rows)[:4])]
    assert sorted(tuple(r) for r in hits.select("query_id", "memory_id", "score", "rank").collect()) == sorted(want)


def test_sources_of_payloads_are_read_once_a_response(spark):
    """Above the explode() of a response's items no JSON text is read again."""
    import json

    from mnemolake.operators import results as W

    items = [{"id": str(i)} for i in range(5)]
    text = json.dumps({"long_term": {"query_source": "l0", "results": items}, "repositories": [{"memory": {"query_source": "pages", "results": items}, "code": {"results": items}}], "results": items})
    found = W.flattened(spark.createDataFrame([(1, text), (2, "{}")], "payload_id long, json string"))
    got = found.groupBy("payload_id", "lane", "source").count()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "long_term", "l0", 5), (1, "wiki", "pages", 5), (1, "code", "code", 5), (1, "adapter", None, 5)], key=repr)
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = [lines[i - 1] for i, line in enumerate(lines) if "Generate explode(_items" in line]
    assert len(above) == 4 and not any("get_json_object" in line for line in above)


def test_scoped_pairs_carry_no_vectors_and_contents(spark):
    from mnemolake.operators import memory as M

    asked = spark.createDataFrame([(1, "u1", "alpha", [1.0, 0.0])], "query_id long, user_id string, query string, vector array<double>")
    sent = spark.createDataFrame([("r", "u1", "s", i, "user", f"alpha {i % 2}", "0") for i in range(4)], "request_id string, user_id string, session_id string, message_index int, role string, content string, timestamp string")
    records = M.scoped_ingest(sent).select("*", F.lit(0.0).alias("at"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    found = M.scoped_search(asked, records)
    assert found.count() == 2  # the first of each content
    nodes, joined = [found._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Join" and node.joinType().toString() == "LeftOuter":
            joined.append(node.left().output().mkString(","))
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert joined and not any("vector" in names or "content" in names for names in joined)


def test_hits_of_sources_need_no_index(spark, sf_dir, duck, monkeypatch):
    """Tasks hand on the first five of a question and a source: no index is made or read, and no pair of a question and a document is shuffled."""
    from mnemolake.operators import index as I
    from mnemolake.plans import surfaces
    from tests.conftest import rows_of

    def no_index(*args, **more):
        raise AssertionError("an index")

    for name in ("write_index", "read_index"):
        monkeypatch.setattr(I, name, no_index)
    for name in ("source_routing", "source_round_robin"):
        found, want = getattr(surfaces, name)(spark, sf_dir), duck.execute(surfaces.L.query.__globals__["ORACLES"][name])
        assert rows_of(found.columns, found.collect()) == rows_of([c[0] for c in want.description], want.fetchall())
