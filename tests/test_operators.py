from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from mnemolake.functions import host as H
from mnemolake.operators import evaluation as E
from mnemolake.operators import memory as M
from mnemolake.operators import ranking as K
from mnemolake.operators import retrieval as R
from mnemolake.operators import team as T
from mnemolake.plans import registry
from mnemolake.sources import readers as S
from mnemolake.streaming import capture as C


def test_scan_reads_only_what_it_may(spark, tmp_path):
    for name, text in {"README.md": "# Record", "docs/a.md": "x", "docs/key.pem": "x", ".git/a.md": "x", "tests/b.md": "x", "c.exe": "x", "d.txt": "password = abcdefghijklmnopqrst", "template.md": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {r["path"] for r in S.scan_files(spark, str(tmp_path)).collect()} == {"README.md", "docs/a.md"}
    assert {r["path"] for r in S.scan_files(spark, str(tmp_path), deep=True).collect()} == {"README.md", "docs/a.md", "tests/b.md", "template.md"}


def test_session_shapes(spark, tmp_path):
    m = [{"role": "user", "content": "hi"}, {"role": "", "content": "no"}, {"role": "assistant", "content": "yes"}]
    payloads = (
        json.dumps({"session_id": "a", "messages": m}, indent=1), json.dumps({"sessions": [{"sessionKey": "b", "messages": m}, {"sessionKey": "c", "conversations": m}]}), json.dumps([{"sessionKey": "d", "messages": [m[:1], m[1:]]}]),
        "\n".join(json.dumps({"sessionKey": k, "messages": m}) for k in "ef"), "\n".join(map(json.dumps, m)),
    )
    for i, payload in enumerate(payloads):
        (tmp_path / f"{i}.json").write_text(payload)
    got = S.session_messages(S.read_sessions(spark, str(tmp_path))).collect()
    names = [*"abcdef", "local-session"]
    assert sorted((r["session_id"], r["message_index"], r["content"]) for r in got) == [(s, i, c) for s in names for i, c in ((0, "hi"), (1, "yes"))]


def test_records_name_the_broken_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert [json.loads(r["json"])["x"] for r in S.read_records(spark, str(tmp_path / "a.jsonl")).orderBy("place").collect()] == [1, 2]
    (tmp_path / "b.json").write_text('[{"x": 1}, {"x": 2}]')
    assert S.read_records(spark, str(tmp_path / "b.json")).count() == 2
    (tmp_path / "c.jsonl").write_text('{"x": 1}\n[2]\n')
    with pytest.raises(Exception, match="line 2"):
        S.read_records(spark, str(tmp_path / "c.jsonl")).collect()


def test_bundles_of_another_kind_are_refused(spark, tmp_path):
    body = {"kind": "some-team-bundle", "schema_version": 3, "records": [{"id": "team:1"}], "revisions": [], "feedback": []}
    (tmp_path / "good.json").write_text(json.dumps(body))
    (tmp_path / "bad.json").write_text(json.dumps(body | {"schema_version": 9}))
    read = lambda name, kind="some-team-bundle": S.read_bundle(spark, str(tmp_path / name), kind, "id:string", "revision:int", "rating:string")
    assert [r["id"] for r in read("good.json")["records"].collect()] == ["team:1"]
    for name, kind in (("bad.json", "some-team-bundle"), ("good.json", "team-bundle"), ("good.json", "not-a-some-team-bundle")):
        with pytest.raises(ValueError, match="bundle"):
            read(name, kind)


def test_markdown_records(spark, tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    body = "---\n# Title\n\n## Summary\nshort\n\n## Content\nbody\n\n## Evidence\n- x\n"
    put("l1/active/a.md", "---\nid: team_l1_x\nlayer: L1\nstatus: active\nconfidence: 0.75\nreviewed_by: null\nother: 1\n" + body)
    put("l1/stale/b.md", "---\nid: team_l1_y\nstatus: stale\nconfidence: high\n" + body)
    put("inbox/agent/c.md", "---\nid: team_l1_z\n---\njust text")
    put("l1/other/d.md", "---\nid: team_l1_w\n" + body)
    put("l1/active/e.md", "no front matter")
    got = {r["id"]: r for r in S.read_markdown_records(spark, str(tmp_path)).collect()}
    assert got.keys() == {"team_l1_x", "team_l1_y", "team_l1_z"}
    assert [got["team_l1_x"][c] for c in ("status", "title", "summary", "content", "confidence", "reviewed_by", "failure")] == ["active", "Title", "short", "body", 0.75, "", None]
    assert (got["team_l1_y"]["status"], got["team_l1_y"]["canonical_status"]) == ("candidate", "stale") and "confidence" in got["team_l1_y"]["failure"]
    assert got["team_l1_z"]["content"] == "just text" and S.named_failures(S.read_markdown_records(spark, str(tmp_path))).count() == 1
    assert S.read_markdown_records(spark, str(tmp_path), candidates=False).count() == 2


def pages(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, path string, text string")


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id bigint, query string")


def test_search_abstains_on_negative_and_empty(spark):
    docs = pages(spark, [(1, "a/1.md", "alpha beta gamma"), (2, "a/2.md", "beta"), (3, "a/3.md", None)])
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["claim_support"], r["abstain"]) for r in K.search(questions(spark, "alpha beta", "no such alpha", "", "omega-x alpha"), docs).collect()}
    assert got[1, 1] == (1, "direct", False)
    assert got[2, None] == (None, None, True) and got[3, None] == (None, None, True)
    assert got[4, 1] == (1, "partial", True)


def test_search_over_an_empty_table(spark):
    assert [r["abstain"] for r in K.search(questions(spark, "alpha"), pages(spark, [])).collect()] == [True]


def test_terms_count_as_substrings_and_in_other_forms(spark):
    docs = pages(spark, [(1, "x/1.md", "retraining trains"), (2, "x/2.md", "a reward")])
    got = {(r["query_id"], r["doc_id"]): (r["matched"], r["covered"]) for r in K.scored(questions(spark, "training", "rewards"), docs).collect()}
    assert got == {(1, 1): (3, 1), (2, 2): (1, 1)}  # training, train, trai; reward


def test_ranking_prefers_stems_layers_and_headings(spark):
    docs = pages(spark, [(1, "papers/other.md", "gamma gamma"), (2, "papers/gamma.md", "# gamma\ntext"), (3, "notes/x.md", "gamma"), (4, "papers/index.md", "gamma gamma gamma gamma")])
    ranked = lambda q: [r["doc_id"] for r in K.repository_hits(questions(spark, q), docs).orderBy("rank").collect()]
    assert ranked("gamma") == [2, 1, 3, 4]
    assert ranked("papers about gamma")[0] == 2 and 3 not in ranked("papers gamma one")
    dated = pages(spark, [(1, "weekly/2026-01-02.md", "gamma"), (2, "weekly/2026-03-01.md", "gamma"), (3, "papers/a.md", "gamma gamma")])
    assert [r["doc_id"] for r in K.repository_hits(questions(spark, "latest weekly gamma"), dated).orderBy("rank").collect()][:2] == [2, 1]


def test_graph_and_vectors_widen_but_do_not_decide(spark):
    docs = pages(spark, [(1, "models/zeta9.md", "see other"), (2, "notes/far.md", "nothing"), (3, "notes/near.md", "zeta9 here")])
    asked = questions(spark, "related zeta9")
    links = spark.createDataFrame([("models/zeta9.md", "notes/far.md")], "path string, target string")
    known = asked.select("query_id", F.array(F.lit("zeta9")).alias("named"))
    graph = K.graph_candidates(known, docs, links)
    assert {r["doc_id"] for r in graph.collect()} == {2}
    with_graph = {r["doc_id"]: r["rank"] for r in K.repository_hits(asked, docs, graph=graph).collect()}
    assert 2 in with_graph and with_graph[2] > with_graph[1]
    semantic = spark.createDataFrame([(1, 2, 0.9)], "query_id bigint, doc_id bigint, cos double")
    lanes = [r["doc_id"] for r in K.repository_hits(questions(spark, "zeta9 word"), docs, semantic=semantic).orderBy("rank").collect()]
    assert 2 in lanes


def test_anchored_hit_comes_first(spark):
    rows = [(1, "notes/a.md", 1, True, ["zeta9"], 1.0), (1, "models/zeta9.md", 2, True, ["zeta9"], 0.5), (2, "a.md", 1, False, ["x1"], 1.0), (2, "x1.md", 2, False, ["x1"], 1.0)]
    hits = spark.createDataFrame(rows, "query_id int, path string, rank int, relates boolean, named array<string>, coverage double")
    got = {(r["query_id"], r["rank"]): r["path"] for r in K.anchored_first(hits).collect()}
    assert got == {(1, 1): "models/zeta9.md", (1, 2): "notes/a.md", (2, 1): "a.md", (2, 2): "x1.md"}


def test_backpropagation(spark):
    steps = spark.createDataFrame([("e", i) for i in range(3)], "episode string, seq int")
    got = {r["seq"]: r["value"] for r in M.backpropagated(steps, F.lit(2.0), F.lit(0.0)).collect()}
    assert got[2] == 1.0 and got[1] == pytest.approx(0.93) and got[0] == pytest.approx(0.93**2)


def test_turn_relation_is_strict(spark):
    events = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 02:00:00"), (3, 1, "2024-01-01 04:00:01")], "event_id int, user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r["event_id"]: r["relation"] for r in M.turn_relations(events).collect()} == {1: "new-task", 2: "follow-up", 3: "new-task"}


def test_backpropagation_with_own_alpha_and_zero(spark):
    steps = spark.createDataFrame([("e", 0, 0.3), ("e", 1, 1.0), ("e", 2, 0.5), ("e", 3, 0.1)], "episode string, seq int, a double")
    got = {r["seq"]: r["value"] for r in M.backpropagated(steps, F.lit(1.0), F.lit(0.0), F.col("a"), gamma=0.0).collect()}
    assert got == {3: 1.0, 2: pytest.approx(0.5), 1: pytest.approx(0.5), 0: pytest.approx(0.15)}
    got = {r["seq"]: r["value"] for r in M.backpropagated(steps, F.lit(1.0), F.lit(0.0), F.lit(0.0), gamma=0.0).collect()}
    assert got == {3: 1.0, 2: 0.0, 1: 0.0, 0: 0.0}


def test_turns_that_correct(spark):
    rows = [(1, 1, "2024-01-01 00:00:00", "hello"), (2, 1, "2024-01-01 00:01:00", "that is wrong"), (3, 1, "2024-01-01 00:02:00", "new topic: x"), (4, 1, "2024-01-01 00:03:00", "go on")]
    events = spark.createDataFrame(rows, "event_id int, user_id int, ts string, said string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r["relation"] for r in M.turn_relations(events, text="said").orderBy("event_id").collect()] == ["new-task", "revision", "new-task", "follow-up"]


def test_policy_rows_and_their_links(spark):
    rows = [(f"r{i}", f"s{i % 3}", i, "Build failed again" if i < 7 else "other words") for i in range(8)]
    records = spark.createDataFrame(rows, "id string, session_id string, message_index int, content string")
    made = M.policy_rows(records).collect()
    assert [(r["episodes"], r["records"]) for r in made] == [(3, 7)] and "trigger: failure|again|build|failed" in made[0]["content"] and made[0]["content"].count("- Build failed again") == 5
    assert M.supporting_links(records, M.policy_rows(records)).count() == 7


def test_policy_pool_needs_two_episodes(spark):
    rows = spark.createDataFrame([("a", "same words"), ("a", "same words"), ("b", "same words"), ("c", "other")], "session_id string, content string")
    assert [(r["episodes"], r["records"]) for r in M.policy_buckets(rows).collect()] == [(2, 3)]


def test_ingest_leaves_secrets_out_and_makes_twins(spark):
    rows = spark.createDataFrame([("s", 0, "user", "hello"), ("s", 1, "user", "password: abcdefghijklmnopqrst")], "session_id string, message_index bigint, role string, content string")
    got = M.ingest(rows).collect()
    assert sorted(r["layer"] for r in got) == ["L0", "L1"] and len({r["id"] for r in got}) == 2


def test_ancestors_end_on_cycles(spark):
    revisions = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2), (2, 1, 2), (2, 2, 1), (3, 1, 1)], "memory_id bigint, revision bigint, parent bigint")
    got = {(r["memory_id"], r["revision"], r["ancestor"]) for r in T.ancestors(revisions).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (1, 3, 1), (2, 1, 2), (2, 2, 1)}


def test_compaction_protects_and_keeps(spark):
    revisions = spark.createDataFrame([(1, r, r - 1) for r in range(1, 6)], "memory_id bigint, revision bigint, parent bigint")
    protected = spark.createDataFrame([(1, 5), (1, 1)], "memory_id bigint, revision bigint")
    assert sorted(r["revision"] for r in T.compacted(revisions, protected, 1).collect()) == [1, 4, 5]
    assert sorted(r["revision"] for r in T.compacted(revisions, protected, 0).collect()) == [1, 5]


def test_chains_follow_branches(spark):
    revisions = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 1), (2, 1, 2), (2, 2, 1), (3, 5, 4)], "memory_id bigint, revision bigint, parent bigint")
    assert {r["memory_id"]: r["chain"] for r in T.chain_lengths(revisions).collect()} == {1: 2, 2: 2, 3: 2}
    kept = T.compacted(revisions, T.current_chain(revisions), 0)
    assert sorted((r["memory_id"], r["revision"]) for r in kept.collect()) == [(1, 1), (1, 3), (2, 1), (2, 2), (3, 5)]


def test_a_long_chain_is_ranked_in_rounds(spark, monkeypatch):
    """5,000 revisions in a row: no more rows are written than revisions in each of about log2 of the depth rounds."""
    written, real = [], T.materialised
    monkeypatch.setattr(T, "materialised", lambda df, tag: (out := real(df, tag), written.append((tag, out.count())))[0])
    chain = spark.range(1, 5001).selectExpr("7L as memory_id", "id as revision", "case when id > 1 then id - 1 end as parent")
    branch = spark.range(5001, 5100).selectExpr("7L", "id", "50L")
    short = spark.range(0, 40).selectExpr("id + 100", "1L", "cast(null as bigint)")
    got = {r["memory_id"]: r["chain"] for r in T.chain_lengths(chain.where("revision <> 5000").union(short)).collect()}
    assert got == {7: 4999} | {i + 100: 1 for i in range(40)}
    jumps = [n for tag, n in written if tag == "jumps"]
    assert len(jumps) <= 15 and sum(jumps) <= 14 * 5000
    assert {r["memory_id"]: r["chain"] for r in T.chain_lengths(chain.union(branch)).collect()} == {7: 51}


def test_merge_waits_for_parents(spark):
    log = lambda rows: spark.createDataFrame(rows, "memory_id bigint, revision bigint, parent bigint, payload_hash string")
    here = log([(1, 1, None, "a"), (2, 1, None, "a")])
    incoming = log([(1, 1, None, "a"), (1, 2, 1, "b"), (1, 3, 2, "c"), (1, 9, 8, "x"), (1, 10, 9, "y"), (2, 1, None, "z"), (2, 2, 3, "q"), (2, 3, 2, "q"), (3, 1, None, "n"), (3, 2, 1, "n")])
    plan = T.merge_plan(here, incoming)
    assert {(r["memory_id"], r["revision"]): r["action"] for r in plan.collect()} == {(1, 1): "skip", (1, 2): "insert", (1, 3): "insert", (1, 9): "conflict", (1, 10): "conflict", (2, 1): "conflict", (2, 2): "conflict", (2, 3): "conflict", (3, 1): "insert", (3, 2): "insert"}
    merged = T.merged_log(here, incoming, plan)
    record = lambda rows: spark.createDataFrame(rows, "memory_id bigint, revision bigint, parent bigint, content_hash string")
    local = record([(1, 1, None, "a"), (2, 4, None, "a"), (4, 2, None, "k"), (5, 2, None, "k"), (6, 1, None, "k")])
    new = record([(1, 3, 2, "c"), (2, 1, None, "z"), (3, 2, 1, "n"), (4, 2, None, "k"), (5, 2, None, "l"), (6, 2, None, "m"), (7, 2, 1, "m")])
    assert {r["memory_id"]: r["action"] for r in T.record_plan(local, new, merged).collect()} == {1: "update", 2: "stale_ignored", 3: "insert", 4: "skip", 5: "conflict", 6: "conflict", 7: "conflict"}


def test_feedback_of_a_bundle_counts_once(spark):
    records = spark.createDataFrame([(1, "active", 0.5), (2, "active", 0.5), (3, "superseded", 0.5)], "memory_id bigint, status string, confidence double")
    feedback = lambda rows: spark.createDataFrame(rows, "memory_id bigint, feedback_id string, rating string, agent string")
    known, incoming = feedback([(1, "a", "stale", "x")]), feedback([(1, "a", "stale", "x"), (1, "b", "stale", "y"), (2, "c", "stale", "x"), (3, "d", "wrong", "x")])
    bundled = spark.createDataFrame([(2, 0.4)], "memory_id bigint, confidence double")
    got = {r["memory_id"]: (r["status"], r["confidence"]) for r in T.replayed(records, known, incoming, bundled).collect()}
    assert got == {1: ("stale", 0.4), 2: ("active", 0.4), 3: ("superseded", 0.4)}


def test_projections_of_one_memory_are_activated_together(spark):
    records = spark.createDataFrame([("a", "candidate", None), ("b", "candidate", "a"), ("c", "candidate", "d"), ("d", "candidate", None), ("e", "stale", "a"), ("f", "candidate", "x")], "memory_id string, status string, source_memory_id string")
    got = lambda *ids: {r["memory_id"] for r in T.activated(records, spark.createDataFrame([(i,) for i in ids], "memory_id string")).where("status = 'active'").collect()}
    assert got("a") == {"a", "b"} and got("c") == {"c", "d"} and got("e") == set()


def test_team_recall_by_scope_and_without_terms(spark):
    rows = [(1, "active", 0.5, "alpha beta", None, "Repo-A"), (2, "candidate", 0.9, "alpha", None, "repo-a"), (3, "active", 0.9, "beta", None, "other"), (4, "stale", 0.9, "alpha", None, "repo-a"), (5, "active", 0.1, "alpha", "2020-01-01", "repo-a")]
    records = spark.createDataFrame(rows, "memory_id bigint, status string, confidence double, body string, valid_until string, repo string")
    feedback = spark.createDataFrame([(1, "helpful", "x")], "memory_id bigint, rating string, agent string")
    got = T.team_hits(questions(spark, "alpha beta", "the"), records, feedback, F.current_timestamp(), repo="REPO").collect()
    assert {(r["query_id"], r["memory_id"]): (r["score"], r["rank"]) for r in got} == {(1, 1): (5.05, 1), (1, 2): (2.9, 1), (2, 1): (1.05, 1), (2, 2): (0.9, 1)}


def test_markdown_goes_out_and_comes_back(spark, tmp_path):
    rows = [("m1", "decision", "L1", "active", "T: 1", "s", "c\nd", '{"repo": "r"}', 0.5, None, "me", "2024", "bo b", "2024")]
    records = spark.createDataFrame(rows, "memory_id string, memory_type string, layer string, status string, title string, summary string, content string, scope string, confidence double, valid_until string, reviewed_by string, activated_at string, author_agent string, created_at string")
    row = T.markdown_text(records).first()
    assert row["path"].startswith("l1/active/team_l1_") and T.markdown_text(records.withColumn("status", F.lit("candidate"))).first()["path"].startswith("inbox/bo-b/team_l1_")
    (tmp_path / row["path"]).parent.mkdir(parents=True)
    (tmp_path / row["path"]).write_text(row["text"])
    back = S.read_markdown_records(spark, str(tmp_path)).first()
    assert [back[c] for c in ("status", "kind", "title", "summary", "content", "confidence", "reviewed_by")] == ["active", "decision", "T: 1", "s", "c\nd", 0.5, "me"]
    again = spark.createDataFrame([("team:central:" + back["id"], "L1")], "k string, l string").select(T.central_id(F.col("k"), F.col("l")).alias("i")).first()["i"]
    assert again == back["id"]


def test_feedback_transitions(spark):
    records = spark.createDataFrame([(1, "active", 0.5), (2, "active", 0.05), (3, "candidate", 0.5), (4, "active", 0.5)], "memory_id bigint, status string, confidence double")
    feedback = spark.createDataFrame([(1, "stale", "a"), (1, "stale", " a "), (2, "wrong", ""), (3, "stale", "a"), (3, "stale", "b"), (4, "stale", "a"), (4, "stale", "b")], "memory_id bigint, rating string, agent string")
    got = {r["memory_id"]: (r["status"], r["confidence"]) for r in T.feedback_transitions(records, feedback).collect()}
    assert got == {1: ("active", 0.3), 2: ("stale", 0.0), 3: ("candidate", 0.3), 4: ("stale", 0.3)}


def test_expiry(spark):
    rows = spark.createDataFrame([("2020-01-01T00:00:00Z",), ("nonsense",), (None,), ("2999-01-01",)], "v string")
    assert [r[0] for r in rows.select(T.expired(F.col("v"), F.current_timestamp())).collect()] == [True, False, False, False]


def test_metrics(spark):
    queries = spark.createDataFrame([(1, "exact"), (2, "exact"), (3, "negative")], "query_id bigint, intent string")
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1), (2, 13, 2)], "query_id bigint, doc_id bigint, rank int")
    gold = spark.createDataFrame([(1, 10), (1, 99), (2, 13)], "query_id bigint, doc_id bigint")
    m = E.metrics(E.per_query(queries, results, gold)).first()
    assert (m["p_at_1"], m["mrr"], m["recall_macro"], m["abstention"]) == (0.5, 0.75, 0.75, 1.0) and m["recall_micro"] == pytest.approx(0.666667)


def test_mmr_against_brute_force(spark):
    import random

    rng = random.Random(3)
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    rows = [(q, i, round(rng.random(), 3), unit([rng.gauss(0, 1) for _ in range(4)])) for q in range(4) for i in range(30)]
    got = {}
    for r in R.mmr(spark.createDataFrame(rows, "query_id bigint, id bigint, relevance double, vector array<double>"), 6, pool=25).collect():
        got[r["query_id"], r["pick"]] = r["id"]
    for q in range(4):
        left = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))[:25]
        chosen = []
        for pick in range(1, 7):
            near = lambda r: max((max(-1, min(1, sum(a * b for a, b in zip(r[3], c[3], strict=True)))) for c in chosen), default=0.0)  # noqa: B023, E731
            best = min(left, key=lambda r: (-(0.82 * r[2] - 0.18 * near(r)), r[1]))
            left.remove(best)
            chosen.append(best)
            assert got[q, pick] == best[1]


def test_promoted_memories_come_first(spark):
    vector = [1.0, 0.0]
    rows = [("c1", "L2", "assistant", "alpha proposal", "candidate", False, 0.0, None), ("p1", "L1", "assistant", "alpha fact", "verified", True, 0.0, 0.5), ("p2", "L1", "assistant", " alpha fact", "verified", True, 0.0, None), ("q", "L1", "user", "alpha?", "verified", True, 0.0, None), ("z", "L0", "user", "zeta", "verified", True, 0.0, None)]
    records = spark.createDataFrame([(*r, [0.0, 1.0]) for r in rows], "id string, layer string, role string, content string, status string, accepted boolean, at double, priority double, vector array<double>")
    asked = questions(spark, "alpha").withColumn("vector", F.array(*map(F.lit, vector)))
    got = M.memory_search(asked, records, F.lit(0.0), 3).orderBy("place").collect()
    assert [r["id"] for r in got] == ["p1", "c1"]
    digest = M.reflected(M.memory_search(asked, records, F.lit(0.0), 3), records).first()
    assert digest["status"] == "candidate" and digest["evidence_count"] == 2


def test_scopes_do_not_mix(spark):
    rows = [("r1", "u1", "s", 0, "user", "alpha here", "1704067200000"), ("r2", "u2", "s", 0, "user", "alpha there", "1704067200000"), ("r1", "u1", "s", 0, "user", "alpha here", "1704067200000"), ("r3", "u1", "s", 0, "user", "password: abcdefghijklmnopqrst", "")]
    messages = spark.createDataFrame(rows, "request_id string, user_id string, session_id string, message_index int, role string, content string, timestamp string")
    records = M.scoped_ingest(messages).withColumns({"at": F.lit(0.0), "vector": F.array().cast("array<double>")})
    assert records.count() == 4 and {r["request_id"]: r["ok"] for r in M.ingest_report(messages).collect()} == {"r1": True, "r2": True, "r3": False}
    asked = questions(spark, "alpha").withColumns({"user_id": F.lit("u1"), "vector": F.array().cast("array<double>")})
    assert [r["id"] for r in M.scoped_search(asked, records).collect()] == [records.where("content = 'alpha here' and layer = 'L0'").first()["id"]]


def test_reviewers_go_with_activation(spark):
    rows = [("a", "s1", "candidate", None), ("s1", None, "candidate", None), ("b", "a", "candidate", "old"), ("c", None, "active", "first"), ("d", "c", "candidate", None)]
    records = spark.createDataFrame(rows, "memory_id string, source_memory_id string, status string, reviewed_by string")
    ids = spark.createDataFrame([("a", "Ann"), ("c", "Bob")], "memory_id string, reviewer string")
    got = {r["memory_id"]: (r["status"], r["reviewed_by"]) for r in T.activated(records, ids).collect()}
    assert got == {"a": ("active", "Ann"), "s1": ("active", "Ann"), "b": ("active", "Ann"), "c": ("active", "first"), "d": ("candidate", None)}
    assert {r["memory_id"]: r["reviewed_by"] for r in T.activated(records, ids.select("memory_id")).collect()}["b"] == "old"


def test_percentiles_count_equal_values(spark):
    rows = spark.range(2000).selectExpr("id % 2 as k", "case when id % 4 < 2 then 0.0 else cast(id as double) end as v")
    import numpy as np

    got = {r["k"]: (r["n"], r["p50"], r["p95"]) for r in E.latency(rows, "k", "v").collect()}
    for k in (0, 1):
        v = sorted(0.0 if i % 4 < 2 else float(i) for i in range(2000) if i % 2 == k)
        assert got[k] == (1000, float(np.median(v)), v[int(999 * 0.95)])


def test_prompts_are_read_without_recalled_memory(spark):
    block = "<ctx>\n- [L1] upgrade deploy (memory_id=1)\n</ctx>\n"
    cut = "<ctx>\nThe following is conversation memory, not repository citation.\n- [L2] restart it (memory_id=2)\n"
    texts = [block + "hello there", cut + "latest report", "hello </ctx> deploy", block + "fix it", None, block, "<ctx>a</ctx>b\n<ctx>\nc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    got = rows.select(H.own_words("t", "ctx").alias("w"), H.prompt_policy("t", "ctx").alias("p"), H.prompt_policy("t").alias("raw")).collect()
    assert [r["w"] for r in got] == ["hello there", "latest report", "hello </ctx> deploy", "fix it", "", "", "b\nc"]
    assert [r["p"] for r in got] == ["ordinary", "repository-fact", "maintenance", "maintenance", "ordinary", "ordinary", "ordinary"] and got[0]["raw"] == "maintenance"


def test_recovery_and_tool_input(spark):
    commands = {"mem doctor": True, "mem x": False, "gate mcp probe": True, "launchctl list": True, "ps": True, "mem doctor; ls": False, "mem restart && rm x": False, "mem stop rm x": False, "": False, "lsof > x": False}
    rows = spark.createDataFrame([(c,) for c in commands], "c string").select("c", H.safe_recovery("c", ("mem",), ("gate",)).alias("ok")).collect()
    assert {r["c"]: r["ok"] for r in rows} == commands
    calls = [("git", {"args": "show x"}, "git show x"), ("Git", {"command": "log", "args": "a"}, "git log"), ("bash", {"cmd": "ls", "path": "p"}, "ls"), ("read", {"command": "", "path": " a.md "}, "a.md"), ("read", {}, "")]
    df = spark.createDataFrame([(t, p) for t, p, _ in calls], "t string, p map<string,string>")
    assert [r[0] for r in df.select(H.tool_input("t", F.col("p"))).collect()] == [want for _, _, want in calls]


def test_exact_percentiles_of_ties(spark):
    rows = [("a", float(v)) for v in [5, 5, 5, 1, 2, 9, 9, 9, 9, 3]] + [("b", 7.0), ("c", None)]
    got = {r["k"]: (r["n"], r["p50"], r["p95"]) for r in E.latency(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got == {"a": (10, 5.0, 9.0), "b": (1, 7.0, 7.0)}


def test_gate(spark):
    good = spark.createDataFrame([(0.9, 0.85, 1.0, None)], "strict_p_at_1 double, recall double, citation_parseability double, negative_abstain double")
    assert {r["check"]: r["ok"] for r in E.gate(good).collect()} == dict.fromkeys(("qrels_audit", "strict_p_at_1", "recall", "citation_parseability", "negative_abstain"), True)
    assert not all(r["ok"] for r in E.gate(good.withColumn("citation_parseability", F.lit(0.9))).collect())


def test_mmr_prefers_what_differs(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.0]), (1, 3, 0.9, [0.0, 1.0])], "query_id bigint, id bigint, relevance double, vector array<double>")
    assert [r["id"] for r in R.mmr(rows, 2).orderBy("pick").collect()] == [1, 3]


def test_stream_pairs_calls(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00")], "call_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "q"))
    spark.createDataFrame([("a", "2024-01-01 00:00:02"), ("b", "2024-01-01 09:00:00")], "call_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "r"))
    read = lambda d: spark.readStream.schema("call_id string, ts timestamp").parquet(str(tmp_path / d))
    got = C.drained(C.paired_stream(read("q"), read("r"))).collect()
    assert [(r["call_id"], r["latency_micros"]) for r in got] == [("a", 2_000_000)]


def test_stream_windows_close_behind_the_watermark(spark, tmp_path):
    spark.createDataFrame([(1, "x", "2024-01-01 01:00:00"), (2, "x", "2024-01-01 02:00:00"), (3, "x", "2024-01-09 00:00:00")], "event_id int, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id int, event_type string, ts timestamp").parquet(str(tmp_path / "e"))
    assert [r["n"] for r in C.drained(C.windowed_counts(stream)).collect()] == [2]


def test_link_resolution_and_neighbours(spark):
    known = spark.createDataFrame([("a/x.md",), ("a/y.md",)], "path string")
    links = spark.createDataFrame([("a/x.md", "y.md"), ("a/x.md", "a/y.md"), ("a/x.md", "z.md")], "path string, target string")
    assert sorted((r["target"], r["resolved"] or "") for r in R.resolved_links(links, known).collect()) == [("a/y.md", "a/y.md"), ("y.md", "a/y.md"), ("z.md", "")]


def test_gold_finds_passages_that_the_text_goes_on_after(spark, tmp_path):
    items = [(1, "aa bb cc dd ee wlongest15"), (2, "one two three"), (3, "word"), (4, "p q r s t u v"), (5, "no such passage in any text"), (6, None), (7, "f g h i"), (8, "  x  y ")]
    texts = ["start aa bb cc dd ee wlongest15, and on", "aa bb cc dd ee wlongest15\nNext", "(one two three)", "swordfish", "xp q r s t u vx", "ef g h ij", "a  x  y b", None, ""]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["query_id"], r["doc_id"]) for r in registry.gold(spark, str(tmp_path)).collect())
    assert got == sorted((i, d) for i, p in items for d, t in enumerate(texts) if p is not None and t is not None and p in t)


def test_search_reads_blocks_that_can_reach_the_first_and_scores_few_documents(spark, sf_dir, tmp_path, monkeypatch):
    """With and without skipped blocks the hits are those of all pairs; under a tenth of all pairs is scored."""
    from mnemolake.plans import library as L

    docs = L.library(spark, sf_dir)
    asked = L.asked(spark, sf_dir)
    index = K.stored_index(docs, str(tmp_path / "index"))
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "doc_id", "rank", "score", "matched", "covered").collect())
    monkeypatch.setattr(K, "_kth", lambda found, score, k: found.select("query_id", F.lit(None).cast("double").alias("_limit")).limit(0))
    want = rows(K.repository_hits(asked, docs, 2, index=index))
    monkeypatch.undo()
    monkeypatch.setattr(K, "FEW_BLOCKS", 0)
    assert rows(K.repository_hits(asked, docs, 2, index=index)) == want
    assert K.scored_pairs(asked, index, 1).count() < 0.1 * asked.count() * docs.count()
    assert K.stored_index(docs.limit(0), str(tmp_path / "index")).pages.count() == docs.count()  # what is stored is read


def test_bundle_plans_of_short_and_long_memories_agree(spark, monkeypatch):
    """A memory's log as one row and joins over logs say the same; short memories take one shuffle by memory, without rounds."""
    rows = lambda made, what: spark.createDataFrame(made, f"memory_id bigint, revision bigint, parent bigint, {what} string")
    here = [(m, r, r - 1 or None, f"{m}{r}") for m in range(1, 40) for r in range(1, 2 + m % 4)]
    incoming = [(m, r, None if r == 1 or (m + r) % 11 == 0 else r - 2 if r % 3 == 0 else r - 1 + 3 * ((m + r) % 13 == 0), f"{m}{r}" if m % 5 else "other") for m in range(1, 45) for r in range(1, 2 + m * 5 % 8) if (m + r) % 7]
    here, incoming = [*here, (None, 1, None, "x"), (50, None, None, "x"), (51, 1, None, None)], [*incoming, (None, 1, None, "x"), (50, None, None, "x"), (51, 1, None, "y"), (51, 2, 2, "y")]
    tops = [rows([max((x for x in log if x[0] == m and x[1]), key=lambda x: x[1]) for m in {x[0] for x in log if x[0] and x[1]}], "content_hash") for log in (here, incoming)]
    here, incoming = rows(here, "payload_hash"), rows(incoming, "payload_hash")
    rounds = []
    monkeypatch.setattr(T, "materialised", lambda df, tag, real=T.materialised: rounds.append(tag) or real(df, tag))
    found = []
    for most in (T.ROW_REVISIONS, 6, 0):
        monkeypatch.setattr(T, "ROW_REVISIONS", most)
        plan = T.planned_revisions(here, incoming)
        records = T.record_plan(*tops, T.merged_log(here, incoming, plan))
        assert T.merged_log(here, incoming, plan.select("memory_id", "revision", "action")).count() == T.merged_log(here, incoming, plan).count()
        found.append([sorted(map(repr, x.collect())) for x in (plan.select("memory_id", "revision", "action"), records)])
        if most == 64:
            assert not {"merge", "jumps", "marks"} & set(rounds)
    assert {"merge", "jumps", "marks"} <= set(rounds)
    assert found[0] == found[1] == found[2] and len(found[0][0]) == incoming.count()
    assert {r.split("action='")[1][:-2] for r in found[0][1]} == {"conflict", "insert", "skip", "stale_ignored", "update"}
