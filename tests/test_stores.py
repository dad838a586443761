from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import mnemolake.__main__ as cli
from mnemolake import api
from mnemolake.functions import vectors as V
from mnemolake.operators import results as W
from mnemolake.operators import retrieval as R
from mnemolake.operators import stores as O
from mnemolake.operators import team as T
from mnemolake.sources import providers as P
from mnemolake.sources import readers as S
from mnemolake.streaming import capture, state


def test_tables_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    O.replace_table(spark.range(3), path)
    O.replace_table(O.read_table(spark, path).where("id > 0"), path)  # reads what it replaces
    assert sorted(r["id"] for r in O.read_table(spark, path).collect()) == [1, 2]
    O.append_rows(spark.range(1), path + "-log")
    O.append_rows(spark.range(2), path + "-log")
    assert spark.read.parquet(path + "-log").count() == 3


def test_an_index_is_built_once_and_dirty_ones_always(spark, tmp_path):
    docs = lambda *texts: spark.createDataFrame([(f"a/{i}.md", t) for i, t in enumerate(texts)], "path string, text string")
    root = str(tmp_path)
    index, header = O.ensure_index(docs("see [x](1.md)", "## 2026-01-02\nback to a/0.md"), root, "s", "c1")
    got = {r["path"]: (r["dates"], r["links"]) for r in index.collect()}
    assert got == {"a/0.md": ([], ["a/1.md"]), "a/1.md": (["2026-01-02"], ["a/0.md"])}
    assert header.first()["document_count"] == 2 and O.ensure_index(docs("new"), root, "s", "c1")[1].first()["document_count"] == 2
    assert O.ensure_index(docs("new"), root, "s", "c1", dirty=True)[1].first()["document_count"] == 1
    assert O.index_status(spark, root, "s", "c1")["exists"] and not O.index_status(spark, root, "s", "c2")["exists"]


def test_vectors_of_another_commit_or_width_do_not_load(spark, tmp_path):
    path = str(tmp_path / "v")
    docs = spark.createDataFrame([("a.md", "x")], "path string, text string")
    O.replace_table(O.vector_index(docs, lambda c: F.array(F.lit(1.0), F.lit(0.0)), "m", 2, "c1"), path)
    assert O.load_vectors(spark, path, "c1", 2).count() == 1
    assert O.load_vectors(spark, path, "c2", 2) is None and O.load_vectors(spark, path, "c1", 3) is None and O.load_vectors(spark, path + "x", "c1", 2) is None


def test_sources(spark):
    sources = spark.createDataFrame([("a", "/a", "A"), ("b", "/b", "B")], "id string, root string, repository string")
    assert [r["id"] for r in O.chosen_sources(sources, default="b").collect()] == ["b"] and O.chosen_sources(sources).count() == 2 and [r["id"] for r in O.chosen_sources(sources, root="/a", default="b").collect()] == ["a"]
    moved = O.added_source(sources, spark.createDataFrame([("c", "/b", None)], sources.schema))
    assert sorted(tuple(r) for r in moved.collect()) == [("a", "/a", "A"), ("c", "/b", "B")]
    assert O.added_source(sources, spark.createDataFrame([("c", "/c", "C")], sources.schema)).count() == 3 and O.removed_source(sources, "a").count() == 1


def test_documents_that_may_be_shown(spark):
    docs = spark.createDataFrame([("a.md", "one\ntwo\n"), ("../b.md", "x"), (".env", "x"), ("c.md", "password = abcdefghijklmnopqrst"), ("d.md", None)], "path string, text string")
    assert [(r["path"], r["lines"]) for r in O.safe_document(docs).collect()] == [("a.md", ["one", "two"])]
    listing = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [r["path"] for r in O.safe_listing(listing, listing.where("path = 'b'")).collect()] == ["a"]


def test_profile_is_one_row(spark):
    records = spark.createDataFrame([("x", "L1", "s", "c", "verified", False, True)], "id string, layer string, session_id string, content string, status string, generated boolean, accepted boolean")
    once = O.written_profile(records, F.lit("me"))
    assert sorted(r["id"] for r in O.written_profile(once, F.lit("status: stale")).collect()) == ["local:L3:profile", "x"]


def test_candidates_get_slugs(spark):
    assert O.promoted_candidate(spark.createDataFrame([("My Idea: v2!",)], "id string")).first()["slug"] == "my-idea-v2"


def test_planes_stay_apart(spark):
    hits = spark.createDataFrame([(1, 7, 1)], "query_id int, id int, place int")
    assert {(r["plane"], r["id"]) for r in W.planes(repository=hits, memory=hits).collect()} == {("repository", "7"), ("memory", "7")}
    found = spark.createDataFrame([(1, 7), (2, 1)], "query_id int, id int")
    accepted = spark.createDataFrame([(1, 7), (2, 1), (2, 2)], "query_id int, id int")
    assert {r["query_id"]: r["complete"] for r in W.all_found(accepted, found).collect()} == {1: True, 2: False}


def test_compact_lists(spark):
    rows = spark.createDataFrame([(1, "verified", i, "x" * 7000) for i in range(12)], "query_id int, list string, place int, excerpt string")
    out = W.compacted_items(rows).collect()
    assert len(out) == 10 and {len(r["excerpt"]) for r in out} == {6000}


def test_reports_that_only_differ_in_uptime_are_one(spark):
    rows = spark.createDataFrame([(json.dumps({"server": {"uptime": u, "v": 1}, "n": n}),) for u, n in ((1, 0), (2, 0), (3, 1))], "json string")
    assert sorted(r["n"] for r in W.distinct_reports(rows).collect()) == [1, 2]


def test_backfill_encodes_only_what_is_stale(spark):
    from mnemolake.operators import memory as M

    rows = spark.createDataFrame([("a", "L1", "t", "m", 2, [9.0, 9.0]), ("b", "L1", "t", "old", 2, [9.0, 9.0]), ("c", "L1", "t", None, None, None)], "id string, layer string, content string, embedding_model string, embedding_dim int, embedding array<double>")
    out = M.backfilled(rows, "m", 2, lambda c: F.array(F.lit(1.0), F.lit(0.0)))
    assert {r["id"]: r["embedding"][0] for r in out.collect()} == {"a": 9.0, "b": 1.0, "c": 1.0}
    assert M.vector_counts(rows, "m", 2).first()["indexed"] == 1 and M.vector_counts(out, "m", 2).first()["indexed"] == 3
    assert M.newest(spark.range(5000).withColumn("updated_at", F.col("id")).withColumn("id", F.col("id").cast("string")), 1).count() == 1000


# streams


def test_session_state_counts_turns(spark, tmp_path):
    rows = [("s", "2024-01-01 00:00:00", "user", "hello"), ("s", "2024-01-01 00:00:01", "assistant", "hi"), ("s", "2024-01-01 00:00:02", "user", "<context> hello"), ("s", "2024-01-01 00:00:03", "user", "next"), ("t", "2024-01-01 00:00:00", "user", "x")]
    spark.createDataFrame(rows, "session_id string, ts string, role string, content string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema("session_id string, ts timestamp, role string, content string").parquet(str(tmp_path / "m"))
    got = capture.drained(state.session_state(stream)).where("not ended").collect()
    assert {(r["session_id"], r["turn"]): (r["messages"], r["prompt"]) for r in got} == {("s", 1): (3, "hello"), ("s", 2): (1, "next"), ("t", 1): (1, "x")}


def test_failed_captures_wait_and_are_tried_again(spark, tmp_path):
    pending, out, broken = str(tmp_path / "pending"), str(tmp_path / "out"), [True]

    def write(batch):
        if broken[0]:
            raise RuntimeError("store is down")
        batch.write.mode("append").parquet(out)

    spark.range(4).write.parquet(str(tmp_path / "in"))
    query = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")).writeStream.foreachBatch(state.capturing(write, pending)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["error"], r["attempts"]) for r in O.read_table(spark, pending).collect()} == {("store is down", 1)}
    assert state.retry_pending(spark, pending, write) == 0 and O.read_table(spark, pending).first()["attempts"] == 2
    broken[0] = False
    assert state.retry_pending(spark, pending, write) == 1 and spark.read.parquet(out).count() == 4 and O.read_table(spark, pending).count() == 0


def test_results_age(spark):
    rows = spark.createDataFrame([(0.0, True, 0), (0.0, False, 1), (0.0, False, 3), (0.0, False, 99), (2000.0, True, 0)], "at double, ok boolean, failures int")
    valid = lambda now: [r[0] for r in rows.select(state.still_valid(F.col("at"), F.col("ok"), F.col("failures"), F.lit(now))).collect()]
    assert valid(59.0) == [True, True, True, True, False] and valid(239.0) == [True, False, True, True, False] and valid(3599.0)[3] and not valid(3600.0)[3]
    assert state.wait_for(lambda: True) and not state.wait_for(lambda: False, 0.05, 0.01)


def test_frames(spark):
    body = json.dumps({"id": 1, "method": "tools/call"}).encode()
    framed = b"Content-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
    data = framed + b'\n{"id": "x", "result": {}}\n' + framed[:20]
    found, rest = state.frames(data)
    assert [m["id"] for m in found] == [1, "x"] and rest == framed[:20]
    chunks = spark.createDataFrame([("c", i, bytearray(data[i * 7 : i * 7 + 7])) for i in range(len(data) // 7 + 1)], "connection string, seq int, data binary")
    assert [(r["place"], r["id"], r["method"]) for r in state.decoded_calls(chunks).orderBy("place").collect()] == [(0, "1", "tools/call"), (1, "x", None)]


# providers


def test_adapter_source(spark, tmp_path):
    script = tmp_path / "adapter.py"
    script.write_text("import json, os, sys\nq = json.load(sys.stdin)\nprint(json.dumps({'results': [{'id': q['query'] + os.environ['MEMORY_SOURCE'], 'path': 'a.md'}] * 2}))\n")
    spark.dataSource.register(P.AdapterSource)
    options = {"command": json.dumps([sys.executable, str(script)]), "source": "-s", "requests": json.dumps([{"query": "a"}, {"query": "b"}])}
    got = spark.read.format("adapter").options(**options).load().collect()
    assert sorted((r["request"], r["place"], r["id"]) for r in got) == [(0, 0, "a-s"), (0, 1, "a-s"), (1, 0, "b-s"), (1, 1, "b-s")]


def test_http_source(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"entries": [{"id": asked["query"] + self.headers["Authorization"][-1], "path": "p"}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(P.HttpSource)
    options = {"url": f"http://127.0.0.1:{server.server_port}/search", "list": "entries", "token": "t7", "requests": json.dumps([{"query": "a"}, {"query": "b"}])}
    assert sorted((r["request"], r["id"]) for r in spark.read.format("http-json").options(**options).load().collect()) == [(0, "a7"), (1, "b7")]
    server.shutdown()


def test_reviewers_that_fail_hold(spark, tmp_path):
    script = tmp_path / "review.py"
    script.write_text("import json, sys\nr = json.load(sys.stdin)\nprint({'1': json.dumps({'decision': 'accept', 'reason': 'ok'}), '2': 'what'}.get(str(r['memory_id']), json.dumps({'decision': 'maybe'})))\n")
    records = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "memory_id bigint, content string")
    assert {r["memory_id"]: r["decision"] for r in P.reviewed(records, [sys.executable, str(script)]).collect()} == {1: "accept", 2: "hold", 3: "hold"}
    assert {r["decision"] for r in P.reviewed(records, ["/nonexistent"]).collect()} == {"hold"}


def test_vector_providers_are_all_or_nothing(spark):
    answer = lambda part: [{"index": i, "embedding": [len(t), 1.0]} for i, t in reversed(list(enumerate(part)))]
    assert P.provider_vectors(["x" * n for n in range(1, 24)] + ["y" * 9000], answer)[-1] == [6000.0, 1.0]
    assert P.provider_vectors(["a", "b"], lambda part: answer(part)[:1]) is None and P.provider_vectors(["a", "b"], lambda part: [{"index": 0, "embedding": [1.0]}, {"index": 1, "embedding": [1.0, 2.0]}]) is None
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id bigint, text string")
    got = P.vectors_of(docs, "doc_id", "text", lambda: lambda part: [], lambda texts: [[0.0]] * len(texts)).collect()
    assert {(r["doc_id"], r["provider"]) for r in got} == {(1, "builtin"), (2, "builtin")}


def test_provider_registry():
    known = P.Providers()
    known.register("local", search=lambda q: [q], doctor=lambda: "ok")
    assert known.capabilities("local") == ("doctor", "search") and known.call("local", "search", "x") == ["x"]
    with pytest.raises(ValueError, match="unknown"):
        known.register("bad", publish=print)
    with pytest.raises(KeyError):
        known.call("local", "sync")


def test_held_documents_follow_the_revision(spark, tmp_path):
    (tmp_path / "a.md").write_text("one")
    first = S.held_documents(spark, str(tmp_path), "r1")
    assert first.first()["text"] == "one" and S.held_documents(spark, str(tmp_path), "r1") is first
    (tmp_path / "a.md").write_text("two")
    assert first.first()["text"] == "one" and S.held_documents(spark, str(tmp_path), "r2").first()["text"] == "two"


def test_vectors_pack(spark):
    rows = spark.createDataFrame([([1.0, 0.5],), (None,)], "v array<double>").select(V.packed("v").alias("b"))
    assert [r["u"] for r in rows.select(V.unpacked(2)("b").alias("u")).collect()] == [[1.0, 0.5], []]
    assert [r["u"] for r in rows.select(V.unpacked(3)("b").alias("u")).collect()] == [[], []]


def test_semantic_candidates(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id bigint, path string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("d", [1.0, 0.0])], "path string, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, -1.0])], "query_id bigint, vector array<double>")
    assert [(r["query_id"], r["doc_id"]) for r in R.semantic_candidates(asked, docs, vectors).orderBy("cos", ascending=False).collect()] == [(1, 1), (1, 2)]


def test_a_round_with_the_shared_repository(spark):
    files = spark.createDataFrame([("l1/active/a.md", "team_l1_a", "decision", "t", "content", 0.5, "active", None), ("l1/active/b.md", "team_l1_b", "decision", "t", "content", 0.5, "active", "broken"), ("l1/active/c.md", "team_l1_c", "gossip", "t", "content", 0.5, "active", None)], "path string, id string, kind string, title string, content string, confidence double, status string, failure string")
    records = spark.createDataFrame([("team:x", None, "active")], "memory_id string, idempotency_key string, status string")
    outcome = T.published(records, T.hydration_payloads(files))
    assert {r["memory_id"]: r["action"] for r in outcome.collect()} == {"team:central:team_l1_a": "insert", "team:central:team_l1_c": "reject"}
    plan = spark.createDataFrame([("m", "create"), ("n", "skip")], "memory_id string, action string")
    assert {(r["step"], r["action"]): r["n"] for r in T.sync_report(plan, outcome).collect()} == {("export", "create"): 1, ("export", "skip"): 1, ("import", "insert"): 1, ("import", "reject"): 1}


def test_tracked_files_only(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    git("init", "-q")
    for name, text in {"a.md": "x", "b.md": "y", "c.key": "z", "tests/d.md": "w"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    git("add", "a.md", "c.key", "tests/d.md")
    assert [r["path"] for r in S.scan_tracked(spark, str(tmp_path)).collect()] == ["a.md"]


# entry points


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, "docs/a.md", "alpha beta"), (2, "docs/b.md", "gamma")], "doc_id bigint, path string, text string").write.parquet(f"{root}/documents")
    vector = [0.0] * 384
    spark.createDataFrame([("m1", "L1", "s", 0, "assistant", "alpha is done", "verified", True, 0.0, None, vector), ("m0", "L0", "s", 0, "user", "alpha?", "verified", True, 0.0, None, vector)], "id string, layer string, session_id string, message_index int, role string, content string, status string, accepted boolean, at double, priority double, vector array<double>").write.parquet(f"{root}/records")
    spark.createDataFrame([(1, "decision", "active", 0.5, "alpha chosen", None)], "memory_id bigint, memory_type string, status string, confidence double, body string, valid_until string").write.parquet(f"{root}/team")
    spark.createDataFrame([(1, "helpful", "x")], "memory_id bigint, rating string, agent string").write.parquet(f"{root}/feedback")
    spark.createDataFrame([(1, 1, None, "h")], "memory_id bigint, revision bigint, parent bigint, payload_hash string").write.parquet(f"{root}/revisions")
    return root


@pytest.mark.parametrize(("words", "want"), [
    (["search", "--query", "alpha"], {"repository", "memory", "team", "answers"}), (["doctor"], {"repository", "layers", "lifecycle", "team"}), (["timeline", "--session", "s"], {"events"}), (["observe", "--session", "s"], {"events"}),
    (["reflect", "--query", "alpha"], {"reflections"}), (["get", "--id", "1"], {"documents"}), (["context", "--query", "alpha"], {"context"}),
])
def test_operations(spark, tables, words, want):
    out = cli.run(spark, cli.parser().parse_args([*words, "--root", tables]))
    assert set(out) == want and all(df.count() > 0 for df in out.values())
    if words[0] == "search":
        answer = out["answers"].first()
        assert not answer["abstain"] and answer["answered_by"] == ["memory", "repository"]
    if words[0] == "context":
        assert {r["section"] for r in out["context"].collect()} == {"repository_evidence", "decision"}


def test_sync_builds_the_index(spark, tables, tmp_path):
    args = cli.parser().parse_args(["sync", "--root", tables, "--index", str(tmp_path), "--commit", "c"])
    assert cli.run(spark, args)["index"].first()["document_count"] == 2
    assert api.open_tables(spark, str(tmp_path)).documents is None
