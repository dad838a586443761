from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.llm import components, ngram_join, url_filter
from mnemolake.llm import queries as llm_queries
from tests.conftest import rows_of
from tests.llm import brute


def copies(rng, n, words=60, edits=6):
    base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"e{rng.randint(0, 10**6)}"
        yield " ".join(own)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    texts = [t for n in (1, 2, 3, 30, 8) for t in copies(rng, n)] + [t for t in copies(rng, 6, words=4, edits=1)] + ["", None, "one", "One", "two words", " \n", "two words"]
    texts += [" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 80))) for _ in range(30)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("words", "num", "den", "limits"), [
    (3, 90, 100, {}), (5, 8, 10, {}), (3, 90, 100, {"prefix_group": 3, "tree_group": 3}), (5, 8, 10, {"prefix_group": 2, "tree_group": 2}), (2, 5, 10, {"prefix_group": 4, "tree_group": 2}), (3, 90, 100, {"tree_shingles": 150}), (5, 8, 10, {"prefix_group": 5, "tree_shingles": 60}),
])
def test_similar_documents_against_brute_force(spark, rows, words, num, den, limits):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(df, words, num, den, **limits).collect()}
    assert got == {d: x for (d, _), x in zip(rows, brute.components(rows, words, num, den), strict=True)}


def test_clashing_keys_are_told_apart(spark, rows, monkeypatch):
    """With one-byte keys, different sets share a key before they get their own."""
    real = ngram_join.written

    def narrowed(df, tag, *a):
        if tag == "shingled" and "digest" in df.columns:
            df = df.withColumn("key", F.when(F.col("key").between(-(1 << 62), 1 << 62), F.col("key") % 4).otherwise(F.col("key")))
        return real(df, tag, *a)

    calls = iter([narrowed])
    monkeypatch.setattr(ngram_join, "written", lambda df, tag, *a: (next(calls, real) if tag == "shingled" else real)(df, tag, *a))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_documents(df, 3, 90, 100).collect()}
    assert got == {d: x[1] for (d, _), x in zip(rows, brute.components(rows, 3, 90, 100), strict=True)}


def test_keep_one_keeps_one_of_each_group(spark, rows):
    extra = [(d, t, "x") for d, t in rows] + [(rows[0][0], rows[0][1], "x"), (None, "null id one two three four five six", "y"), (None, "null id one two three four five six", "y")]
    df = spark.createDataFrame(extra, "doc_id bigint, text string, n_shingles string")
    kept = ngram_join.keep_one(df).collect()
    want = brute.components(rows, 5, 8, 10)
    least = {x[1] for x in want}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(least)
    assert sum(r["doc_id"] is None for r in kept) == 1 and kept[0].asDict().keys() == {"doc_id", "text", "n_shingles"}
    assert ngram_join.keep_one(df.limit(0)).count() == 0


def test_prefix_tree_against_brute_force():
    rng = np.random.default_rng(2)
    bound = ngram_join.Bound(8, 10)
    for _ in range(30):
        base = np.unique(rng.integers(0, 1 << 60, 40).astype(np.uint64))
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(20, len(base)), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(25)]
        tree = ngram_join.PrefixTree(bound)
        for i, s in enumerate(sets):
            tree.parent.append(i)
            tree.lookup(i, s)
            tree.insert(i, s)
        parent = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 10 * common >= 8 * (len(sets[i]) + len(sets[j]) - common):
                    a, b = parent[i], parent[j]
                    parent = [min(a, b) if p in (a, b) else p for p in parent]
        assert [tree.find(i) for i in range(len(sets))] == parent


@pytest.mark.parametrize("one", [0, 250_000])
def test_components(spark, monkeypatch, one):
    monkeypatch.setattr(components, "ONE_PARTITION", one)
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (102, 101), (-5, 102), (7, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["key"]: r["root"] for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: -5 for i in (100, 101, 102, -5)}}
    assert components.components(df.limit(0)).count() == 0


def test_url_filter(spark):
    entries = [
        ("bad", "domain", "example.com", "block", "add", "2024-01-02"), ("bad", "domain", "example.com", "block", "remove", "2024-01-04"), ("bad", "domain", "example.com", "block", "add", "2024-01-06"),
        ("good", "domain", "ok.example.com", "allow", "add", "2024-01-01"), ("pages", "url", "b.org/x", "block", "add", "2024-01-01"), (None, "domain", "c.org", "block", "add", "2024-01-01"), ("bad", "domain", "d.org", "block", "add", None),
    ]
    lists = spark.createDataFrame(entries, "list string, kind string, key string, verdict string, action string, at string").withColumn("at", F.to_timestamp("at"))
    urls = [
        (1, "http://a.Example.com:80/p", "2024-01-01", "", False), (2, "http://a.example.com/p", "2024-01-02", "bad", True), (3, "http://example.com", "2024-01-04", "", False), (4, "https://u@example.com/", "2024-02-01", "bad", True),
        (5, "http://x.ok.example.com/", "2024-01-03", "bad,good", False), (6, "http://b.org/x/?q=1#f", "2024-01-01", "pages", True), (7, "http://b.org/y", "2024-01-01", "", False), (8, None, "2024-01-03", "", False),
        (9, "not a url", "2024-01-03", "", False), (10, "http://example.com/", None, "", False), (11, "http://notexample.com/", "2024-01-03", "", False), (2, "http://a.example.com/p", "2024-01-02", "bad", True), (12, "http://c.org/", "2024-01-03", "", False), (13, "http://d.org", "2024-01-03", "", False),
    ]
    captures = spark.createDataFrame([u[:3] for u in urls], "id int, url string, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    got = sorted((r["id"], ",".join(r["lists"]), r["blocked"]) for r in url_filter.filter_urls(captures, lists).collect())
    assert got == sorted((u[0], u[3], u[4]) for u in urls)
    assert url_filter.filter_urls(captures.limit(0), lists).count() == 0
    assert not any(r["blocked"] for r in url_filter.filter_urls(captures, lists.limit(0)).collect())


def test_url_filter_keeps_clashing_columns(spark):
    lists = spark.createDataFrame([("bad", "domain", "a.org", "block", "add", 1), ("bad", "domain", "a.org", "block", "add", 1)], "list string, kind string, key string, verdict string, action string, at int")
    captures = spark.createDataFrame([("http://a.org/x", 2, "h", "l", True, "p", "k", 9)] * 2 + [(None, None, "h", None, None, None, None, None)], "url string, fetched_at int, host string, lists string, blocked boolean, _page string, key string, time int")
    out = url_filter.filter_urls(captures, lists)
    assert out.columns == [*captures.columns, "_host", "_lists", "_blocked"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([("http://a.org/x", 2, "h", "l", True, "p", "k", 9, "a.org", ["bad"], True)] * 2 + [(None, None, "h", None, None, None, None, None, "", [], False)], key=repr)
    assert url_filter.filter_urls(captures.limit(0), lists.limit(0)).count() == 0


def test_as_of_lookup(spark):
    for n in (1, 2, 3, 4, 7, 8, 9, 100):
        steps = [(3 * i, i % 2 == 0) for i in range(n)]
        df = spark.createDataFrame([(steps, t) for t in range(-1, 3 * n + 2)], "s array<struct<at:int,gone:boolean>>, t int")
        got = df.select(url_filter.in_force(F.col("s"), F.col("t")).alias("x"), "t").collect()
        assert all((r["x"] and r["x"]["at"]) == (None if r["t"] < 0 else min(r["t"] // 3, n - 1) * 3) for r in got)


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = llm_queries.queries()[name](spark, sf_dir)
    got = df.collect()
    con = duck.execute(llm_queries.oracle_sql()[name])
    columns = [c[0] for c in con.description]
    assert sorted(df.columns) == sorted(columns) and rows_of(df.columns, got) == rows_of(columns, con.fetchall())


def test_join_query_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in llm_queries.op9_ngram_join(spark, sf_dir).collect()}
    assert got == {d: x for (d, _), x in zip(rows, brute.components(rows, 3, 90, 100), strict=True)}


def test_language_query_on_held_out_labels(spark, sf_dir):
    labels = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in llm_queries.op10_language_id(spark, sf_dir).collect() if r["held_out"]]
    assert sum(labels[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)
