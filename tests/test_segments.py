"""Tables behind a manifest, trees of digests, and an index that follows its documents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mnemolake.operators import ranking as K
from mnemolake.operators import retrieval as R
from mnemolake.operators import segments as G
from mnemolake.plans import library as L
from mnemolake.sources import manifest as M


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_a_merge_rewrites_only_its_buckets(spark, tmp_path):
    root = str(tmp_path / "t")
    first = spark.range(2000).selectExpr("id", "'old' as v")
    M.merge(first, root, ["id"], buckets=32)
    assert M.read(spark, root).count() == 2000 and len(M.current(spark, root)["buckets"]) == 32
    before = M.current(spark, root)["buckets"]
    changes = spark.createDataFrame([(5, "new"), (5000, "new")], "id bigint, v string")
    state = M.merge(changes, root, ["id"], gone=spark.createDataFrame([(7,), (9999,)], "id bigint"))
    assert len(state["written"]) <= 4 and {b for b, f in state["buckets"].items() if before.get(b) != f} <= set(map(str, state["written"]))
    want = sorted([(i, "new" if i == 5 else "old") for i in range(2000) if i != 7] + [(5000, "new")])
    assert rows_of(M.read(spark, root)) == want
    assert M.read(spark, root, state["written"]).count() < 400
    M.merge(changes.limit(0), root, ["id"], gone=M.read(spark, root).select("id"))
    assert M.read(spark, root).count() == 0


@pytest.mark.parametrize("step", ["data", "manifest", "rename", "clean"])
def test_a_crash_at_any_step_leaves_the_old_or_the_new_table(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path / "t")
    M.replace(spark.range(3), root)
    M.replace(spark.range(4), root)

    def fail(*args):
        raise OSError("crash")

    target = {"data": "filesystem", "manifest": "renamed", "rename": "renamed", "clean": "_clean"}[step]
    if step == "data":  # the data is written, nothing of the manifest is
        monkeypatch.setattr(M, "publish", fail)
    elif step == "manifest":  # the side file is written, the rename does not happen
        monkeypatch.setattr(M, target, fail)
    elif step == "rename":  # the rename happens, and nothing after it
        real = M.renamed
        monkeypatch.setattr(M, "renamed", lambda *a: (real(*a), fail())[0])
    else:
        monkeypatch.setattr(M, "_clean", fail)
    with pytest.raises(OSError):
        M.replace(spark.range(9), root)
    assert M.read(spark, root).count() == (9 if step in ("rename", "clean") else 4)
    monkeypatch.undo()
    M.replace(spark.range(2), root)
    assert M.read(spark, root).count() == 2
    M.append(spark.range(5), root)
    assert M.read(spark, root).count() == 7 and len(M.versions(spark, root)) <= M.KEPT_VERSIONS + 1


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    root = str(tmp_path / "t")
    M.replace(spark.range(1), root)
    with pytest.raises(RuntimeError, match="another writer"):
        M.publish(spark, root, {"folders": []}, 0)
    assert M.read(spark, root).count() == 1 and M.read(spark, str(tmp_path / "none")) is None


@pytest.fixture(scope="module")
def two_states(spark, sf_dir):
    docs = L.library(spark, sf_dir).select("doc_id", "path", "text")
    changed = docs.where("doc_id % 50 <> 8").withColumn("text", F.when(F.col("doc_id") % 50 == 7, F.concat(F.lit("# zebra rewards\n"), "text")).otherwise(F.col("text")))
    added = docs.where("doc_id % 60 = 3").selectExpr("doc_id + 1000000 as doc_id", "concat('new/', path) as path", "concat('quokka ', text) as text")
    return docs, changed.unionByName(added)


def test_trees_find_what_changed(spark, two_states, tmp_path):
    a, b = (str(tmp_path / x) for x in "ab")
    revisions = [G.write_tree(G.listing_of(d), p) for d, p in zip(two_states, (a, b), strict=True)]
    assert revisions == [R.content_revision(d).first()["revision"] for d in two_states] and revisions[0] != revisions[1]
    old, new = ({r["path"]: r["text"] for r in d.collect()} for d in two_states)
    want = {p: "removed" if p not in new else "added" if p not in old else "changed" for p in old | new if old.get(p) != new.get(p)}
    found, read = G.changed_paths(spark, a, b)
    assert {r["path"]: r["change"] for r in found.collect()} == want
    assert read[8] < 2 * len(want) + 20 < len(old) / 2  # leaves below equal nodes stay unread
    same, read = G.changed_paths(spark, a, a)
    assert same.count() == 0 and read[8] == 0 and read[2] == 0


def test_a_refreshed_index_is_that_of_a_full_build(spark, two_states, tmp_path):
    docs, after = two_states
    root, full = str(tmp_path / "followed"), str(tmp_path / "full")
    assert G.refresh(docs, root)["indexed"] == docs.count()
    state = G.refresh(after, root)
    changed = after.join(docs, ["path", "text"], "left_anti").count()
    assert state["indexed"] == changed < docs.count() / 10 and state["revision"] == R.content_revision(after).first()["revision"]
    assert G.refresh(after, root)["version"] == state["version"]  # nothing changed, nothing is written
    asked = spark.createDataFrame([(1, "zebra rewards"), (2, "quokka"), (3, "und der die"), (4, "latest weekly quokka"), (5, "papers about zebra")], "query_id bigint, query string")
    hits = lambda index: rows_of(K.repository_hits(asked, after, index=index).select("query_id", "doc_id", "rank", "score", "matched"))
    want = hits(K.stored_index(after, full))
    assert len(want) > 9 and hits(G.read_segments(spark, root)) == want
    merged = G.merge_segments(spark, root)
    assert len(merged["segments"]) == 1 and merged["dead"] is None and hits(G.read_segments(spark, root)) == want


def test_an_index_is_written_in_one_pass_without_a_shuffle(spark):
    """Texts stay in their tasks, and postings have each word of each document as often as it is there."""
    from collections import Counter

    from mnemolake.operators import index as I

    texts = {k: "" if k % 9 == 0 else f"# head{k % 4}\nalpha beta{k % 5} alpha word{k}" for k in range(200)}
    docs = spark.range(0, 200, 1, 4).selectExpr("id as doc_id", "concat('layer', id % 3, '/doc_', id, '.md') as path", "if(id % 9 = 0, '', concat('# head', id % 4, '\\nalpha beta', id % 5, ' alpha word', id)) as text")
    rows = I.block_rows(K.described(docs))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    index = I.Index(rows)
    placed = {(r["block"], r["slot"]): r["doc_id"] for r in index.pages.select("block", "slot", "doc_id").collect()}
    assert sorted(placed.values()) == sorted(texts) and max(slot for _, slot in placed) < I.BLOCK
    assert all(len({d % 3 for (b, _), d in placed.items() if b == block}) == 1 for block, _ in placed)
    found = {d: Counter() for d in texts}
    for r in index.postings.collect():
        assert r["top"] == max(r["counts"]) and sum(1 << s for s in r["slots"]) == r["mask"]
        for slot, n in zip(r["slots"], r["counts"], strict=True):
            found[placed[r["block"], slot]][r["word"]] += n
            in_path = r["word"] == f"layer{placed[r['block'], slot] % 3}/doc_{placed[r['block'], slot]}.md"
            assert bool(r["path_mask"] >> slot & 1) == in_path and bool(r["head_mask"] >> slot & 1) == r["word"].startswith("head")
    assert {d: +c for d, c in found.items()} == {d: Counter(t.replace("# ", "").split()) for d, t in texts.items()}


def test_no_row_of_an_index_grows_with_its_block(spark):
    """A reader holds some thousand rows at once: documents of many words make more rows, not greater ones."""
    from mnemolake.operators import index as I

    docs = spark.range(0, 40, 1, 1).selectExpr("id as doc_id", "concat('layer/doc_', id, '.md') as path", "concat_ws(' ', transform(sequence(1, 3000), i -> concat('word', id % 7, 'x', i))) as text")
    rows = I.block_rows(K.described(docs))
    most = rows.agg(F.max(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    assert most < 1000 and I.Index(rows).postings.count() >= 7 * 3000 and I.Index(rows).blocks.count() >= 3


def test_searches_read_a_stored_index_by_small_rows(spark, tmp_path):
    """What repository_search and search read of a stored index: no row holds other rows, and the widest is that of a word in a block."""
    from mnemolake.operators import index as I

    docs = spark.range(0, 32, 1, 1).selectExpr("id as doc_id", "concat('papers/doc_', id, '.md') as path", "concat_ws(' ', transform(sequence(1, 1500), i -> concat('w', id % 5, 'x', i))) as text")
    index = K.stored_index(docs, str(tmp_path / "index"))
    assert not any(f.dataType.simpleString().startswith("array<struct") for f in index.rows.schema.fields)
    asked = spark.createDataFrame([(1, "w3x1500 w3x7"), (2, "papers about w1x9")], "query_id bigint, query string")
    found = K.search(asked, docs, index=index).where("doc_id is not null").groupBy("query_id").agg(F.collect_set(F.col("doc_id") % 5).alias("r"), F.count("*").alias("n"))
    assert rows_of(found.selectExpr("query_id", "r[0]", "size(r)", "n")) == [(1, 3, 1, 5), (2, 1, 1, 5)]
    assert index.rows.agg(F.max(F.octet_length(F.to_json(F.struct("*"))))).first()[0] < 1000 and I.living(index) is index.rows
