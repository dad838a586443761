from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mnemolake.llm import chat_format, decontamination, fingerprints, language_id, packing, secret_scan, sharding, shingles, token_output, tokens
from mnemolake.llm.common import running
from tests.llm import brute

ODD = [
    "", None, " ", "\n\n", "a", "Ünïcode über alles straße", "a  b\t c\n d", "x" * 5000, "the the the the the the", "日本語 テキスト です", "😀 emoji 😀", "<s>[INST]</s>", "trailing \\", "\\l\\b\\\\ [/INST]", "nul\x00byte", "\x1ca \x85b c",
    "it's 'quoted' don't", "12345 3.14 $5,000", "\n\n\nabc\r\ndef \n ghi", "İstanbul ẞ ΣΑΣ", "á combining",
]


def documents(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id bigint, text string" + extra)


# chat formatting


def test_chat_round_trip(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(ODD)] + [(2, 0, None, None), (2, 1, "assistant", "</s>[INST] ok [/INST]"), (None, None, "user", "x"), (3, 5, "assistant", "one"), (3, 5, "assistant", "two")]
    log = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").select("*", F.col("turn").alias("seq"), F.lit("message").alias("event"))
    parts = chat_format.read_back(chat_format.rendered(chat_format.folded(log), part=3)).orderBy("conv_id", "part").collect()
    for conv in (1, 2, 3, None):
        want = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        own = [p for p in parts if p["conv_id"] == conv]
        assert [(m["role"], m["text"]) for p in own for m in p["turns"]] == want
        assert [t for p in own for t in p["loss_texts"]] == [t for r, t in want if r == "assistant"]


def test_chat_folds_events(spark):
    rows = [
        (1, 0, 1, "message", "user", "hi"), (1, 1, 2, "message", "assistant", "a"), (1, 1, 3, "delta", "assistant", "b"), (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "c"), (1, 1, 6, "delta", None, "d"),
        (1, 0, 7, "edit", None, "hello"), (2, 0, 1, "delta", "assistant", "x"), (2, 0, 2, "delta", "assistant", "y"), (2, 1, 3, None, "user", "z"),
    ]
    log = spark.createDataFrame(rows, "conv_id bigint, turn bigint, seq bigint, event string, role string, text string")
    got = {(r["conv_id"], r["turn"]): [(m["role"], m["text"]) for m in r["messages"]] for r in chat_format.folded(log).collect()}
    assert got == {(1, 0): [("user", "hello")], (1, 1): [("assistant", "cd")], (2, 0): [("assistant", "xy")], (2, 1): [("user", "z")]}
    assert chat_format.format_conversations(log.limit(0)).count() == 0


def test_chat_streams_and_extra_columns(spark):
    rows = [(1, 0, 0, "message", "assistant", "<")] + [(1, 0, i, "delta", None, "é</s>") for i in range(1, 20_001)] + [(1, 0, 30_000, "message", "assistant", "z")]
    rows += [(None, None, None, None, None, None)] * 2 + [(5, 0, 1, "regenerate", "assistant", "gone"), (5, 0, 2, "edit", None, "kept"), (5, 0, 2, "edit", None, "kept"), (5, 0, 3, "delta", None, "!")]
    log = spark.createDataFrame(rows, "conv_id bigint, turn bigint, seq bigint, event string, role string, text string").withColumns({"messages": F.lit(1), "log": F.lit("x"), "part": F.lit(2), "turns": F.lit(3)})
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(log)).collect()}
    assert [m["text"] for m in got[1]["turns"]] == ["<" + "é</s>" * 20_000, "z"] and got[1]["loss_texts"] == ["<" + "é</s>" * 20_000, "z"]
    assert [m["text"] for m in got[None]["turns"]] == ["", ""] and [m["text"] for m in got[5]["turns"]] == ["kept!"]


# column helpers


def test_running_totals(spark):
    rng = random.Random(16)
    arrays = [[rng.randint(-9, 9) for _ in range(n)] for n in (0, 1, 2, 63, 64, 65, 66, 100, 1000, 4099)]
    df = spark.createDataFrame([(a,) for a in arrays], "v array<int>")
    got = df.select(running(F.col("v"), lambda a, b: a + b).alias("s"), running(F.col("v"), lambda a, b: F.greatest(a, b)).alias("m")).collect()
    for a, r in zip(arrays, got, strict=True):
        assert r["s"] == list(accumulate(a)) and r["m"] == list(accumulate(a, max))


# fingerprints


def test_sketches_merge_and_estimate():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(5000)]
    a = [rng.choice(vocabulary) for _ in range(3000)]
    b = a[:2000] + [rng.choice(vocabulary) for _ in range(1000)]
    ta, tb = " ".join(a), " ".join(b)
    sa, sb = (fingerprints.sketch(t.encode()) for t in (ta, tb))
    assert abs(fingerprints.resemblance(sa, sb) - brute.jaccard(ta, tb)) < 0.12
    assert abs(fingerprints.distinct(sa) / 2996 - 1) < 0.2 and abs(fingerprints.containment(sa, sb) - 2 / 3) < 0.15
    halves = fingerprints.merged(fingerprints.sketch(" ".join(a[:1504]).encode()), fingerprints.sketch(" ".join(a[1500:]).encode()))
    assert (halves == sa).all()
    assert (fingerprints.decoded(fingerprints.encoded(sa)) == sa).all()


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    words = "alpha béta  Gamma\tdelta\n" * 50
    whole = shingles.word_hashes(words.encode())
    assert len(whole) == 200 and (whole[:4] == whole[4:8]).all() and (shingles.word_hashes(b"gamma") == whole[2]).all()
    monkeypatch.setattr(shingles, "PIECE", 64)
    assert (shingles.word_hashes(words.encode()) == whole).all()
    assert len(shingles.shingle_hashes(whole[:2], 5)) == 1 and not len(shingles.shingle_hashes(whole[:0], 5))


def test_edited_fingerprints(spark):
    rng = random.Random(2)
    rows = [(7 * i, " ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randint(0, 400)))) for i in range(40)] + [(1000, None), (1001, "é" * 9), (1001, "é" * 9)]
    rng.shuffle(rows)
    got = {}
    for r in fingerprints.edited_fingerprints(documents(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    for k, (d, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = next(x for x in got[d] if x["edited_sha256"] == brute.sha(edited))
        assert r["n_chars"] == len(text)
        assert abs(r["near_edited"] - brute.jaccard(text, edited)) < 0.15 and abs(r["near_next"] - brute.jaccard(text, after)) < 0.15
    assert sum(map(len, got.values())) == len(rows)


def test_edited_fingerprints_of_ids_beyond_doubles(spark):
    rng = random.Random(12)
    rows = [(2**62 + 2 * i + 1, " ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randint(1, 30)))) for i in range(0, 40_000, 97)] + [(-(2**62) - i, f"low {i}") for i in range(1, 300, 7)] + [(2**63 - 1, "the last")]
    rng.shuffle(rows)
    assert fingerprints.with_successors(documents(spark, rows).selectExpr("doc_id", "cast(text as binary) as text"))[1] > 1
    order = sorted(rows)
    want = [(d, brute.sha(t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2])) for k, (d, t) in enumerate(order)]
    assert sorted((r["doc_id"], r["edited_sha256"]) for r in fingerprints.edited_fingerprints(documents(spark, rows)).collect()) == want


@pytest.mark.parametrize("rows", [[], [(1, "only one document here now")], [(None, "a b c d e f"), (None, None), (3, "x")]])
def test_edited_fingerprints_of_few_rows(spark, rows):
    got = fingerprints.edited_fingerprints(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    if len(rows) == 1:
        assert got[0]["near_next"] == 1.0


# secrets


def test_trigram_queries():
    q = secret_scan.trigram_query(secret_scan.BASE[0].pattern)
    assert frozenset({"tok", "oke", "ken"}) in q and all(len(x) >= 1 for x in q) and len(q) == 6
    assert secret_scan.trigram_query(secret_scan.BASE[1].pattern) == [frozenset({"aki", "kia"})]
    assert secret_scan.trigram_query(secret_scan.BASE[2].pattern) is None
    assert secret_scan.trigram_query("abc+d|xyz") == [frozenset({"abc"}), frozenset({"xyz"})]


def test_secrets_against_brute_force(spark):
    rng = random.Random(3)
    bits = ["password", "PASSWD", "Token", "api_key", "apikey", "secret", ":", "=", " ", '"', "'", "abcdef", "a1b2c3", "AKIA", "ABCDEFGHIJKLMNOPQRST", "0123456789abcdef", "é", "\n", "-", "."]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    rows = [(i, t, "x", [1]) for i, t in enumerate(texts)] + [(0, texts[30], "y", [1]), (None, texts[31], None, None)]
    df = documents(spark, rows, ", spans string, record_key array<int>")
    out = secret_scan.scan_secrets(df)
    assert out.columns == ["doc_id", "text", "spans", "record_key", "_spans"]
    base = secret_scan.listed(F.filter("_spans", lambda s: s["ord"] < 3))
    got = sorted((r["text"] or "", r["b"]) for r in out.select("text", base.alias("b")).collect())
    assert got == sorted((t or "", ",".join(brute.secrets(t))) for _, t, *_ in rows)
    assert secret_scan.scan_secrets(df.limit(0)).count() == 0


def redacted(text):
    """By brute force, base kinds only."""
    out, at = [], 0
    spans = [tuple(map(int, x.split(":")[1:])) for x in brute.secrets(text)]
    for a, b in spans:
        if a >= at:
            out += [text[at:a], "[REDACTED]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


@pytest.mark.parametrize("text", [
    "-----BEGIN " + "A " * 500_000 + "PRIVATE KEY-----", "é token=abcdef12 " * 100_000, "eyJ" * 300_000, "a" * 1_000_000, "password " * 100_000 + "=abcdefgh", "token" + " " * 1_000_000 + "x",
    ("x" * 1017 + " token=" + "0123456789abcdef" * 3 + "\U0001F600") * 400,
])
def test_long_texts_and_many_secrets(spark, text):
    df = documents(spark, [(1, text, len(text))], ", n_chars bigint")
    base = secret_scan.scan_secrets(df, secret_scan.BASE).select(secret_scan.listed(F.col("spans"))).first()[0]
    assert base == ",".join(brute.secrets(text))
    own = secret_scan.redact_secrets(df, secret_scan.BASE).first()
    assert (own["text"], own["n_chars"]) == (redacted(text), len(redacted(text)))
    secret_scan.scan_secrets(df).write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("before, header", [("", 7), ("", 900), ("", 1200), ("", 100_000), ("session-eyJ_", 100_000), ("é ", 5000)])
def test_web_tokens_have_no_longest_header(spark, before, header):
    """The span begins with the run of token characters that holds the header."""
    token = "eyJ" + "aB3_-" * (header // 5 + 2) + ".eyJ" + "x" * 10 + "." + "y" * 12
    text = f"{before}{token} eyJ{'a' * 20}.eyJshort.no eyJab.eyJ{'c' * 12}.eyJ{'d' * 12}.{'e' * 10}."
    df = documents(spark, [(1, text)])
    found = [(s["start"], s["end"]) for s in secret_scan.scan_secrets(df).first()["spans"] if s["kind"] == "web_token"]
    start, second = (2 if before == "é " else 0), text.index("eyJccc")
    assert found == [(start, len(before) + len(token)), (second, len(text) - 1)]
    assert secret_scan.redact_secrets(df).first()["text"].startswith(f"{text[:start]}[REDACTED] eyJ")


def test_web_tokens_take_linear_time(spark):
    for text in ("eyJ" * 300_000, "a" * 1_000_000, ("eyJ" + "a" * 20 + ".") * 50_000, "eyJ" + "a" * 1_000_000 + ".eyJ" + "b" * 1_000_000):
        secret_scan.scan_secrets(documents(spark, [(1, text)])).write.format("noop").mode("overwrite").save()


def test_redaction_against_brute_force(spark):
    rng = random.Random(15)
    bits = ["password=", "token: ", "secret = '", "abcdef", "0123456789abcdef01234567", "AKIA", "ABCDEFGHIJKLMNOPQRST", " ", "é", "\U0001F600", "x" * 700]
    texts = [*ODD, *("".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(150))]
    rows = [(i, t, None if t is None else len(t), "s") for i, t in enumerate(texts)] + [(3, texts[-1], len(texts[-1]), "s")] * 2
    got = sorted(tuple(r) for r in secret_scan.redact_secrets(documents(spark, rows, ", n_chars int, spans string"), secret_scan.BASE).where("text is not null").collect())
    assert got == sorted((d, redacted(t), len(redacted(t)), "s") for d, t, _, _ in rows if t is not None)


def test_redaction_leaves_clean_texts(spark):
    rows = [(1, "clean text", 10), (2, "é token=abcdef123 x", 19), (3, None, None)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secret_scan.redact_secrets(documents(spark, rows, ", n_chars bigint")).collect()}
    assert got == {1: ("clean text", 10), 2: ("é [REDACTED] x", 14), 3: (None, None)}


# decontamination


def test_contamination_against_brute_force(spark):
    rng = random.Random(4)
    words = ["alpha", "Beta", "g4", "é", "naïve", "x"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 9, 10, 15])))) for i in range(12)] + [(90, None), (3, "x, x; x")]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    docs = documents(spark, [(i, t, 5) for i, t in enumerate(texts)], ", n_words int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (decontamination.BLOCK_BYTES, 40):
        got = {r["doc_id"]: (r["_n_words"], len(r["hit_words"]), r["items"]) for r in decontamination.scan_documents(docs, bench, block_bytes=block).collect()}
        assert got == {i: brute.contamination(t, [x for x in items if x[1]]) for i, t in enumerate(texts)}
    assert {len(r["hit_words"]) for r in decontamination.scan_documents(docs, bench.limit(0)).collect()} == {0}


def test_items_without_id_hit_and_words_count_without_benchmark(spark):
    docs = documents(spark, [(1, "One two three four"), (2, "five"), (3, None)])
    bench = spark.createDataFrame([(None, "two three"), (7, "three four"), (8, None)], "item_id bigint, text string")
    found = lambda b: {r["doc_id"]: (r["n_words"], r["hit_words"], r["items"]) for r in decontamination.scan_documents(docs, b).collect()}
    assert found(bench) == {1: (4, [1, 2, 3], ["7"]), 2: (1, [], []), 3: (0, [], [])}
    assert found(bench.where("item_id is null")) == {1: (4, [1, 2], []), 2: (1, [], []), 3: (0, [], [])}
    for none in (bench.limit(0), bench.where("text is null")):
        assert found(none) == {1: (4, [], []), 2: (1, [], []), 3: (0, [], [])}


def test_decontaminate_cuts_spans_and_drops(spark):
    passage = "one two three four five six seven eight nine ten"
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"{long} -- {passage.upper()}! end", 0), (2, f"x {passage}", 0), (3, "clean", 5), (4, None, None)]
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in decontamination.decontaminate(documents(spark, rows, ", n_chars bigint"), bench).collect()}
    assert got == {1: (f"{long} -- ! end", len(f"{long} -- ! end")), 3: ("clean", 5), 4: (None, None)}


def test_decontaminate_in_blocks_equals_one_block(spark):
    w = [f"w{i}" for i in range(100)]
    passages = [w[0:12], w[6:18], w[40:52], w[70:82]]
    bench = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item_id bigint, text string")
    rows = [
        (1, " ".join(w[:39]), 0), (2, " ".join([*w[40:52], *["x"] * 12, *w[70:82]]), 0), (3, " ".join([*w[20:30], *w[40:46], *w[0:12], *w[46:52], *w[52:70]]), 0), (4, None, None), (5, "clean", 5),
    ]
    docs = documents(spark, rows, ", n_chars bigint")
    clean = lambda: {tuple(r) for r in decontamination.decontaminate(docs, bench).collect()}
    want = clean()
    assert {r[0] for r in want} == {1, 3, 4, 5} and (1, " " + " ".join(w[18:39]), len(" ".join(w[18:39])) + 1) in want
    assert len(list(decontamination._blocks(bench, 20))) > 1
    assert {tuple(r) for r in decontamination.decontaminate(docs, bench, block_bytes=20).collect()} == want


def test_equal_benchmark_rows_fill_no_block(spark):
    """10^5 equal rows are one; rows that differ are dealt by their bytes."""
    same = spark.range(100_000).selectExpr("7 as item_id", "'one two three four five six seven eight nine ten' as text")
    other = spark.range(400).selectExpr("id + 100 as item_id", "concat('w', id, repeat(' x y z', 20)) as text")
    bench = same.union(other).union(spark.range(50).selectExpr("cast(null as bigint)", "'a b c'"))
    blocks = [*decontamination._blocks(bench, 4000)]
    assert len(blocks) > 8 and sum(map(len, blocks)) == 402 and len({x for b in blocks for x in b}) == 402
    assert all(sum(len(t) for _, t in b) <= 4000 for b in blocks)
    docs = documents(spark, [(1, "so one two three four five six seven eight nine ten it is"), (2, "w7 x y z x y z x y z x y z"), (3, "a b c")])
    got = {r["doc_id"]: (len(r["hit_words"]), r["items"]) for r in decontamination.scan_documents(docs, same.union(other.where("item_id < 110")), block_bytes=1500).collect()}
    assert got[1] == (10, ["7"]) and got[2][0] == 13 and "107" in got[2][1] and got[3] == (0, [])


def test_decontaminate_against_brute_force(spark):
    rng = random.Random(13)
    words = ["alpha", "Beta", "g4", "é", "naïve", "x", "yy", "zed"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, line(rng.choice([1, 4, 10, 14, 30]))) for i in range(10)] + [(None, line(12)), (50, None), (51, "")]
    texts = [*ODD, *(line(rng.randint(0, 80)) for _ in range(60)), *(f"{line(20)}, {items[i][1].upper()}! {line(25)}" for i in range(10)), *(items[i][1] for i in range(10))]
    texts = [t if t is None else t.replace("\x85", " ") for t in texts]
    rows = [(i, t, None if t is None else len(t), i) for i, t in enumerate(texts)] + [(0, texts[-1], len(texts[-1]), 7)] * 2
    docs, bench = documents(spark, rows, ", n_chars bigint, hit_words int"), spark.createDataFrame(items, "item_id bigint, text string")
    pieces = lambda t: [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]

    def clean(d, t, n, x):
        hit = brute.hit_words(t, [i for i in items if i[1]])
        at = pieces(t)
        if not hit:
            return (d, t, n, x)
        if len(hit) >= 0.5 * len(at):
            return None
        out, k = [], 0
        for a in range(len(at)):
            if a in hit:
                if a - 1 not in hit:
                    out.append(t[k : at[a][0]])
                k = at[a][1]
        out = "".join([*out, t[k:]])
        return (d, out, len(out), x)

    want = sorted((r for r in (clean(*r) for r in rows) if r), key=repr)
    assert len(want) < len(rows) and any(w not in rows for w in want)
    for block in (decontamination.BLOCK_BYTES, 60):
        assert sorted((tuple(r) for r in decontamination.decontaminate(docs, bench, block_bytes=block).collect()), key=repr) == want
    assert decontamination.decontaminate(docs.limit(0), bench).count() == 0


def test_a_block_is_small():
    rng = random.Random(14)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(200_000)]
    items = [(str(i), " ".join(words[i : i + 200])) for i in range(0, len(words), 200)]
    grams = decontamination.NgramSet(items, 10)
    assert grams.nbytes < 6 * sum(len(t) for _, t in items)


# tokens, output, packing


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", "drop"), ("byte_bpe_50k.json", "lead")])
def test_encoder_is_exact(name, spaces):
    made = tokens.Encoder(public_tokenizers.path(name), spaces)
    rng = random.Random(5)
    alphabet = "abé XYZ  '.,\n\t1239-—́ß\x1c\x85 İſs_%"
    texts = [t for t in ODD if t] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(3000)] + ["plain words and, some.\nmore words, here 12."] * 2
    for text in texts:
        assert np.frombuffer(made.encode(text), "<u4").tolist() == made.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for k in range(300):
        bits = rng.integers(0, 65 if k % 2 else 17, int(rng.integers(0, 300)))
        ids = np.array([int(rng.integers(0, 1 << int(b), dtype=np.uint64, endpoint=b < 64)) if b < 64 else (1 << 64) - 1 - int(rng.integers(0, 9)) for b in bits], np.uint64)
        words = token_output.simple8b_encode(ids)
        assert (token_output.simple8b_decode(words, len(ids)) == ids).all()
    assert len(token_output.simple8b_encode(np.zeros(600, np.uint64))) == 10


def test_token_output_round_trip(spark):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(None, "null id"), (6, "same id"), (6, "same id")]
    path = public_tokenizers.path("word_bpe_49k.json")
    blocks = token_output.write_token_blocks(documents(spark, rows[::-1]), path, "drop", 2, partitions=3, block_ids=50)
    assert blocks.count() > 3
    got = token_output.read_token_blocks(blocks).orderBy("start").collect()
    made, start = tokens.Encoder(path, "drop"), 0
    for r, (d, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = made.encode(t) + b"\2\0\0\0"
        assert (r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) == (d, start, len(ids) // 4, zlib.crc32(ids))
        start += r["n_tokens"]
    assert token_output.read_token_blocks(token_output.write_token_blocks(documents(spark, []), path, "drop", 2)).count() == 0


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 4, 40, 16), packing.Limits(16, 1, 16, 4)])
def test_packer_places_every_id_once(limits):
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 99, int(n)).astype("<u4") for n in rng.integers(1, 200, 120)]
    masks = [None if k % 2 else rng.random(len(d)) < 0.5 for k, d in enumerate(docs)]
    packer, sequences = packing.Packer(limits), []
    for k, d in enumerate(docs):
        sequences += packer.add(packing.Piece(k, 0, d.tobytes(), masks[k]))
    sequences += packer.finish()
    seen = {}
    for s in sequences:
        assert sum(map(len, s)) <= limits.tokens and len(s) <= limits.segments and sum(p.losses for p in s) <= limits.loss_tokens
        for p in s:
            seen.setdefault(p.doc, []).append((p.start, p.ids))
    for k, d in enumerate(docs):
        assert b"".join(ids for _, ids in sorted(seen[k])) == d.tobytes()
    if limits.segments > 100:
        lengths = [sum(map(len, s)) for s in sequences]
        assert all(n == limits.tokens or n & (n - 1) == 0 for n in lengths) and sum(n != limits.tokens for n in lengths) <= 11


def test_pack_documents(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "word " * 5000)]
    got = packing.pack_documents(documents(spark, rows).repartition(2), public_tokenizers.path("byte_bpe_50k.json"), "lead", 1).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    made = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), "lead")
    assert sum(r["length"] for r in got) == sum(len(made.encode(t)) // 4 + 1 for _, t in rows)
    assert packing.pack_documents(documents(spark, []), public_tokenizers.path("byte_bpe_50k.json"), "lead", 1).count() == 0


def test_loss_masks_bind_through_the_frame(spark):
    """Conversations by operator 1: prompts bear no loss, so that sequences fill up with tokens, with segments, or with loss tokens."""
    rng = random.Random(17)
    say = lambda n: " ".join(rng.choice(["alpha", "béta", "gamma", "1234"]) for _ in range(n))
    log = [(c, t, t, "message", ("user", "assistant")[t % 2], say(rng.choice([0, 1, 60]) if c % 3 else (300, 4)[t % 2])) for c in range(60) for t in range(4)] + [(99, 0, 0, "message", "user", "no answer")]
    parts = chat_format.format_conversations(spark.createDataFrame(log, "conv_id bigint, turn bigint, seq bigint, event string, role string, text string"))
    docs = parts.select(F.col("conv_id").alias("doc_id"), F.col("formatted").alias("text"), F.col("loss_spans"), F.lit(1).alias("start")).coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    limits = packing.Limits(1024, 6, 300, 64)
    got = packing.pack_documents(docs, path, "lead", 1, limits, "loss_spans").collect()
    made = tokens.Encoder(path, "lead")
    want = {}
    for r in docs.collect():
        found = made.tokenizer.encode(r["text"], add_special_tokens=False)
        bears = [any(s["start"] <= a < s["start"] + s["length"] for s in r["loss_spans"]) for a, _ in found.offsets] + [any(s["start"] + s["length"] == len(r["text"]) for s in r["loss_spans"])]
        want[r["doc_id"]] = [*found.ids, 1], bears
    seen, sums = {}, {}
    for r in got:
        ids, bears = want[r["doc_id"]]
        part = slice(r["start"], r["start"] + r["length"])
        assert np.frombuffer(r["input_ids"], "<u4").tolist() == ids[part] and r["loss_tokens"] == sum(bears[part]) and r["doc_tokens"] == len(ids)
        seen.setdefault(r["doc_id"], []).extend(range(part.start, part.stop))
        sums.setdefault(r["sequence_id"], []).append((r["length"], 1, r["loss_tokens"]))
    assert all(sorted(seen[d]) == list(range(len(ids))) for d, (ids, _) in want.items())
    totals = [tuple(map(sum, zip(*x, strict=True))) for x in sums.values()]
    top = (limits.tokens, limits.segments, limits.loss_tokens)
    assert all(a <= b for t in totals for a, b in zip(t, top, strict=True))
    assert all(any(t[k] == top[k] for t in totals) for k in range(3))


# sharding


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(7)
    rows = [(i, "x" * rng.randint(0, 500)) for i in range(3000)] + [(None, None), (None, "a"), (5, "b"), (5, "b")]
    got = sharding.shard_documents(documents(spark, rows), 16).collect()
    assert len(got) == len(rows)
    load = {}
    for r in got:
        load.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    sizes = [sum(s for _, s in x) for x in load.values()]
    assert max(sizes) - min(sizes) < 0.01 * sum(sizes) / 16
    assert all(sorted(k for k, _ in x) == list(range(len(x))) for x in load.values())
    assert sharding.shard_documents(documents(spark, [])).count() == 0


def test_rebalancing_moves_little():
    sizes = [(s, 100 + s % 7, 1) for s in range(800)]
    old = sharding.balanced_map(sizes, 8)
    new = sharding.rebalanced_map(sizes, old, 9)
    load = [sum(b for s, b, _ in sizes if new[s] == k) for k in range(9)]
    assert max(load) <= 1.02 * sum(load) / 9
    moved = [s for s in old if new[s] != old[s]]
    assert all(new[s] == 8 for s in moved) and len(moved) < 1.2 * 800 / 9
    back = sharding.rebalanced_map(sizes, new, 8)
    assert set(back.values()) <= set(range(8)) and all(back[s] == new[s] for s in new if new[s] < 8)


# language


def test_language_id(spark):
    rng = random.Random(8)
    stems = {"xx": ["tion", "the", "ing", "wh"], "yy": ["eau", "oui", "ère", "que"], "zz": ["sch", "ung", "heit", "über"]}
    text = lambda lang, n: " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    train = [(i, text(lang, 80), lang) for i, lang in enumerate(list(stems) * 20)] + [(900, None, "xx"), (901, "no label", None), (902, "", "yy")]
    model = language_id.fitted(language_id.labelled_sample(documents(spark, train, ", lang string")))
    tests = [(i, text(lang, 30), lang) for i, lang in enumerate(list(stems) * 10)] + [(100, None, "und"), (101, "", "und"), (102, "123 ... !!", "und"), (103, "—", "und")]
    out = language_id.identify(documents(spark, tests, ", score string"), model)
    assert out.columns == ["doc_id", "text", "score", "lang_pred", "_score", "bits_per_char", "rejected"]
    for r in out.collect():
        assert r["lang_pred"] == r["score"] and 0 <= r["_score"] <= 1 and r["rejected"] == (r["score"] == "und")
    gibberish = documents(spark, [(1, "zqxj vkwpf qqzzx jjxkv " * 20)])
    assert language_id.identify(gibberish, model).first()["rejected"]
    assert {r["lang_pred"] for r in language_id.identify(documents(spark, tests[:2], ", x string"), None).collect()} == {"und"}


def test_labelled_sample_keeps_every_label_and_no_copies(spark):
    rng = random.Random(9)
    word = lambda k: "".join(chr(0x4E00 + 8 * k + rng.randrange(8)) for _ in range(5))
    text = lambda k, n: " ".join(word(k) for _ in range(n))
    train = [(i, text(i % 80, 40), f"l{i % 80:02}") for i in range(640)] + [(700 + i, text(90, 200), "long") for i in range(8)]
    train += [(800 + i, "copy of a text", "few") for i in range(300)] + [(1200 + i, f"text {chr(97 + i)}", "few") for i in range(5)]
    sample = language_id.labelled_sample(documents(spark, train, ", lang string"), 6, 1000)
    assert Counter(x for x, _ in sample) == {**{f"l{k:02}": 6 for k in range(80)}, "long": 6, "few": 6}
    assert len(set(sample)) == len(sample) and max(len(t) for _, t in sample) <= 1000
    starts = {t for _, t, name in train if name == "long"}
    assert all(any(whole.startswith(t.decode() + " ") for whole in starts) for name, t in sample if name == "long")
    model = language_id.fitted(sample)
    tests = [(k, text(k, 20), f"l{k:02}") for k in range(80)] + [(90, text(90, 20), "long")]
    got = language_id.identify(documents(spark, tests, ", lang string"), model).collect()
    assert all(r["lang_pred"] == r["lang"] and not r["rejected"] for r in got)


def test_sparse_models_equal_dense_ones(monkeypatch):
    rng = random.Random(10)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(60)).encode()
    samples = [(letters, text(letters)) for letters in ("abcd", "bcde", "xyé", "eab") * 8]
    dense, words = language_id.fitted(samples), ["abc", "x", "zzz", "éy", "deab"]
    monkeypatch.setattr(language_id, "DENSE_LANGUAGES", 1)
    sparse = language_id.fitted(samples)
    assert isinstance(sparse.shares[2], language_id.Sparse)
    assert (sparse.bits(words) == dense.bits(words)).all() and (sparse.limit, sparse.sharpness) == (dense.limit, dense.sharpness)


def test_kneser_ney_against_brute_force():
    rng = random.Random(11)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(40)).encode()
    samples = [(letters, text(letters)) for letters in ("abcd", "bcde", "xyé", "eab") * 6]
    model, plain = language_id.fitted(samples), brute.KneserNey(samples, language_id.ORDER)
    words = ["a", "abc", "dcba", "éxé", "qqq", "bab", "eabbae", "xyzzy"]
    got = model.bits(words)
    assert model.languages == plain.names and 1 / model.uniform == plain.symbols
    assert np.abs(got[:, :-1] - [[plain.bits(x, w) for x in plain.names] for w in words]).max() < 1e-9
    assert got[:, -1].tolist() == [len(w) + 1 for w in words]
    symbols = sorted({c for _, t in samples for c in t.decode() if c != " "}) + ["\x02", "?"]  # the last stands for all that is unknown
    for name in plain.names:
        for before in ("\x01\x01\x01", "\x01\x01a", "abc", "xyx", "qqq"):
            assert abs(sum(plain.probability(name, before + c) for c in symbols) - 1) < 1e-9


def test_sample_keeps_to_its_bytes():
    for labels in (1, 4, 5, 64, 1000, 10_000, 10**6):
        docs, size = language_id.sample_bounds(labels, language_id.SAMPLE_DOCS, language_id.SAMPLE_BYTES)
        assert docs >= language_id.LEAST_DOCS and size >= language_id.LEAST_BYTES
        assert labels * docs * size <= language_id.SAMPLE_TOTAL or (docs, size) == (language_id.LEAST_DOCS, language_id.LEAST_BYTES)
    assert language_id.sample_bounds(4, 600, 20_000)[1] == 20_000


def test_packing_by_size_takes_the_pieces_of_the_dot_product():
    """Where every id bears loss, the sorted list gives the sequences that the largest dot product gives."""
    import random

    from mnemolake.llm import packing as K

    def packed(limits, sizes, fill):
        packer = K.Packer(limits)
        packer._fill = getattr(packer, fill) if fill else packer._fill
        sequences = [s for i, n in enumerate(sizes) for s in packer.add(K.Piece(i, 0, bytes(4 * n)))] + list(packer.finish())
        return [[(x.doc, x.start, len(x)) for x in s] for s in sequences]

    draw = random.Random(5)
    for limits in (K.Limits(), K.Limits(64, 4, 64, 30), K.Limits(64, 8, 40, 50), K.Limits(64, 3, 100, 7)):
        sizes = [max(1, int(draw.expovariate(4 / limits.tokens))) for _ in range(800)]
        assert packed(limits, sizes, "_fill_by_size") == packed(limits, sizes, "_fill_by_sizes") == packed(limits, sizes, None)
