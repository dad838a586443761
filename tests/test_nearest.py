"""Vector search by matrix blocks against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.operators import nearest as N


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 6))
    rows = [base[i % 60] if i % 3 else base[0] for i in range(400)]  # one vector is that of a third of all rows
    rows = [(f"r{i:03}", (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rows)]
    return [*rows, ("none", None), ("empty", []), ("wide", [1.0, 0.0]), ("x" * 40, rows[5][1])]


def brute(questions, rows, k, floor=None, but_itself=False):
    out = set()
    for q, v in questions:
        found = []
        for i, w in rows:
            cos = float(np.clip(np.dot(v, w), -1, 1)) if v and w and len(v) == len(w) else 0.0
            if not (but_itself and i == q) and (floor is None or cos >= floor):
                found.append((-round(cos, 9), i))
        out |= {(q, i, rank) for rank, (_, i) in enumerate(sorted(found)[:k], 1)}
    return out


def test_nearest(spark, vectors, monkeypatch):
    questions = [vectors[0], vectors[7], vectors[50], ("none", None), ("wide", [0.6, 0.8]), ("other", vectors[3][1])]
    rows = spark.createDataFrame(vectors, "id string, vector array<double>").repartition(5)
    asked = spark.createDataFrame(questions, "query_id string, vector array<double>")
    for k, floor, own in ((3, None, False), (20, 0.2, True), (1, 0.99, True)):
        got = N.nearest(asked, rows, k, floor, own)
        assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == brute(questions, vectors, k, floor, own)
    counts = {r["query_id"]: r["near"] for r in N.count_near(asked, rows, 0.12, True).collect()}
    want = {q: len({i for x, i, _ in brute([(q, v)], vectors, 10**6, 0.12, True)}) for q, v in questions}
    assert counts == {q: n for q, n in want.items() if n}
    assert N.cosines(asked, rows).count() == len(questions) * len(vectors)
    monkeypatch.setattr(N, "BLOCK_ROWS", 2)
    assert {(r["query_id"], r["id"], r["rank"]) for r in N.nearest(asked, rows, 4).collect()} == brute(questions, vectors, 4)


def test_a_task_hands_on_k_rows_a_question(spark, vectors):
    rows = spark.createDataFrame(vectors, "id string, vector array<double>").repartition(3)
    asked = rows.limit(5).select(F.col("id").alias("query_id"), "vector")
    plan = N.nearest(asked, rows, 4)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    found = N._mapped(asked, rows, lambda batches, ids, matrices: iter(()), "query_id string, id string, cos double")
    assert found.count() == 0 and N.nearest(asked.limit(0), rows, 4).count() == 0 and N.nearest(asked, rows.limit(0), 4).count() == 0


def test_ids_may_be_numbers(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "id bigint, vector array<float>")
    got = N.nearest(rows.where("id = 4").selectExpr("id as query_id", "vector"), rows, 2, but_itself=True).collect()
    assert [(r["query_id"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(4, 0), (4, 1)]  # all products of 1 or more count as 1
