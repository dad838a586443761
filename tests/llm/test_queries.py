"""The queries that SQL cannot express, over whole supplied tables, against brute force."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnemolake.llm import fingerprints, language_id
from mnemolake.llm import queries as Q
from tests.llm import brute


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()}


def token_ids(name, rows, end):
    made = Tokenizer.from_file(public_tokenizers.path(name))
    made.encode_special_tokens = True
    return {d: [*made.encode(t, add_special_tokens=False).ids, end] for d, t in rows.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2(spark, sf_dir, rows):
    got = {r["doc_id"]: r for r in Q.op2_fingerprints(spark, sf_dir).collect()}
    assert got.keys() == rows.keys()
    k, words = fingerprints.SKETCH_SIZE, fingerprints.SHINGLE_WORDS
    order = sorted(rows)
    sketches = {d: brute.sketch(t, k, words) for d, t in rows.items()}
    for i, d in enumerate(order):
        text, after = rows[d], order[(i + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + rows[after][:half]
        changed = brute.sketch(edited, k, words)
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), brute.sha(edited))
        assert fingerprints.decoded(r["fingerprint"]).tolist() == sketches[d] and fingerprints.decoded(r["edited_fingerprint"]).tolist() == changed
        assert r["near_edited"] == pytest.approx(brute.estimate(sketches[d], changed, k)) and r["near_next"] == pytest.approx(brute.estimate(sketches[d], sketches[after], k))
        assert abs(r["near_edited"] - brute.jaccard(text, edited)) < 0.15


def test_op6(spark, sf_dir, rows):
    ids = token_ids("byte_bpe_50k.json", rows, 1)
    pieces, sequences = {}, {}
    for r in Q.op6_packing(spark, sf_dir).collect():
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) and r["length"] > 0
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for parts, whole in ((pieces[d], len(ids[d])) for d in ids):
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == whole
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * sum(map(len, ids.values()))


def test_op7(spark, sf_dir, rows):
    start, want = 0, set()
    for d, ids in token_ids("word_bpe_49k.json", rows, 2).items():
        want.add((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert {tuple(r) for r in Q.op7_token_output(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want


def test_op8(spark, sf_dir, rows):
    got = {r["doc_id"]: r for r in Q.op8_sharding(spark, sf_dir).collect()}
    assert got.keys() == rows.keys()
    shards = {}
    for d, text in rows.items():
        r = got[d]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "bytes", None)
        shards.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    assert set(shards) <= set(range(16)) and all(sorted(k for k, _ in x) == list(range(len(x))) for x in shards.values())
    loads = [sum(n for _, n in shards.get(k, [])) for k in range(16)]
    assert max(loads) - min(loads) <= max(len(t.encode()) + 1 for t in rows.values())


def test_op10(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = docs.where("crc32(cast(doc_id as string)) % 5 <> 0")
    plain = brute.KneserNey(language_id.labelled_sample(learn), language_id.ORDER)
    for r in Q.op10_language_id(spark, sf_dir).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        best = plain.best(rows[r["doc_id"]].encode())
        if best is None:
            assert (r["lang_pred"], r["score"], r["bits_per_char"]) == ("und", 0.0, None)
        else:
            assert r["lang_pred"] == best[0] and abs(r["bits_per_char"] - best[1]) < 1e-9
