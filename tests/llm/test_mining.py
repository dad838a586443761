"""Collocations, source divergence and mixing against brute force on small tables with odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from mnemolake.llm import collocations, divergence, mixing
from mnemolake.llm.bits import has, width_for

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, lang string, source string, text string"


def brute_phrases(rows, least, top, share=80):
    counts, total = defaultdict(Counter), Counter()
    for _, lang, _, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            key = "und" if lang is None else lang
            total[key] += len(words)
            for n in range(1, 5):
                counts[key].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = set()
    for lang, f in counts.items():
        frequent = {g: a for g, a in f.items() if a >= least and len(g) > 1}
        longest = Counter()
        for g, a in frequent.items():
            for n in range(2, len(g)):
                for i in range(len(g) - n + 1):
                    longest[g[i : i + n]] = max(longest[g[i : i + n]], a)
        found = []
        for g, a in frequent.items():
            score, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            if 100 * longest[g] < share * a:
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


def prose(rng, n, words):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    words = ["a", "B", "the", "ÉTÉ", "été", "ß", "x" * 300, "\x00", "don't", " ", "1", "中文"]
    rows = [(i, rng.choice(["en", "en", "en", "fr", None, ""]), rng.choice(["s1", "s2", "s3", None, "", "é"]), prose(rng, rng.randrange(60), words)) for i in range(150)]
    rows += [(None, None, None, None), (7, "en", "s1", ""), (7, "en", "s1", "  \n "), (8, "de", "only", None), *[(500, "en", "s9", "the b the b ÉTÉ")] * 40]
    return rows


def test_phrases(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, SCHEMA).selectExpr("*", "1 as id", "2 as n", "3 as rank")
    got = {tuple(r) for r in collocations.mine_phrases(df, least=3, top=25).collect()}
    assert got == brute_phrases(odd_rows, 3, 25) and len(got) > 60


def test_phrases_of_nothing(spark, odd_rows):
    assert collocations.mine_phrases(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.mine_phrases(spark.createDataFrame([(1, "en", "s", None), (2, None, None, " ")], SCHEMA)).count() == 0


def test_phrases_of_a_long_text(spark):
    """Over several parts, with no piece break for megabytes: n-grams over the cuts count once."""
    text = "one two three four five six seven " * 300_000 + ". seven one"
    rows = [(1, "en", "s", text)]
    got = {tuple(r) for r in collocations.mine_phrases(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_phrases(rows, 30, 2000)


def test_words_that_share_an_id(spark, monkeypatch):
    """Colliding hashes are noticed, and ids made anew. Every second seed works here; the tasks read the hash from the driver's closure."""
    real = collocations.placed_ids

    def colliding(text, lang, seed):
        ids, first, behind = real(text, lang, seed)
        return (ids if seed else ids & np.uint64(1)), first, behind

    names = {"placed_ids": colliding, "Counter": Counter, "count": collocations.count}
    import types

    own = types.FunctionType(collocations.dictionary.__code__, {**vars(collocations), **names, "__name__": "__main__"}, "dictionary")
    rows = [(i, "en", "s", f"w{i % 9} w{i % 7}") for i in range(400)]
    table, seed = own(spark.createDataFrame(rows, SCHEMA).select("lang", "text"), 30)
    assert seed == 1 and {r["word"]: r["n"] for r in table.where("not total").collect()} == Counter(w for r in rows for w in r[3].split())


def test_run_lengths_with_equal_hashes():
    h, k, n = np.array([1, 1, 1, 5, 5]), np.array([9, 8, 9, 2, 2]), np.array([1, 2, 3, 4, 5])
    assert [x.tolist() for x in collocations._run_lengths([h, k, n])] == [[1, 1, 5], [8, 9, 2], [2, 4, 9]]


def test_parts_keep_every_gram_once():
    text = " ".join(f"w{i % 50}" for i in range(2000))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
    whole, _, _ = next(collocations._encoded([batch], 0))
    real, seen = collocations.pieces, []
    collocations.pieces = lambda data: real(data, 64)
    try:
        for ids, piece, old in collocations._encoded([batch], 0):
            assert (piece == 0).all()
            seen += [tuple(ids[i : i + 3]) for i in range(max(0, old - 2), len(ids) - 2)]
    finally:
        collocations.pieces = real
    assert seen == [tuple(whole[i : i + 3]) for i in range(len(whole) - 2)]


def brute_audit(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, lang, source, text in rows:
        key = (lang or "", source or "")
        groups.add(key)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[key].update(words)
        docs[key[0]].update(set(words))

    def shares(lang, kept, own):
        n, v = sum(own[t] for t in kept), len(kept)
        return {t: 1 + 1000000000 * (own[t] + 2) // (n + 2 * v) for t in kept}

    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]
        p = {s: shares(lang, kept, counts[lang, s]) for s in sources}
        q = shares(lang, kept, sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)}
    return out


def test_divergence(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, SCHEMA).selectExpr("*", "1 as n", "2 as number", "3 as p", "4 as value")
    got = [tuple(r) for r in divergence.audit_sources(df, least=5, top=4).collect()]
    assert set(got) == brute_audit(odd_rows, 5, 4) and len(got) == len(set(got))
    assert divergence.audit_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_divergence_of_many_sources(spark):
    """More sources than meet in one row."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    rows = [(i, "en" if i % 5 else "fr", f"s{rng.randrange(70)}", prose(rng, rng.randrange(12), words)) for i in range(900)]
    got = {tuple(r) for r in divergence.audit_sources(spark.createDataFrame(rows, SCHEMA), least=10).collect()}
    assert got == brute_audit(rows, 10, 10)


def test_sketch_never_underestimates(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["en", "fr"]), "s", " ".join("".join(rng.choices("abcdef", k=3)) for _ in range(20))) for i in range(200)]
    docs = defaultdict(Counter)
    for _, lang, _, text in rows:
        docs[lang].update(set(text.split()))
    for width in (16, 1 << 16):
        bits = divergence.possible_terms(spark.createDataFrame(rows, SCHEMA), 12, width)
        for lang, own in docs.items():
            passing = has(bits, divergence.cells_of(divergence.hashes(lang, [t.encode() for t in own]), width)).all(axis=0)
            assert all(ok for ok, n in zip(passing, own.values(), strict=True) if n >= 12)
    assert sum(passing) < len(own) / 2  # wide enough a sketch drops what is rare
    assert (width_for(0, 8, 16, 64), width_for(5, 8, 16, 64), width_for(50, 8, 16, 64)) == (16, 64, 64)


def test_terms_of_a_long_text():
    data = ("Ab1cd " * 100_000).encode().translate(divergence.TERMS)
    assert Counter(w for part in divergence.pieces(data, 1000) for w in part.split()) == {b"ab": 100_000, b"cd": 100_000}
    assert [*divergence.pieces(b"x" * 50, 10)] == [b"x" * 50] and [*divergence.pieces(b"", 10)] == [b""]


def brute_targets(sizes, weights, share, most):
    """By the rule: deal by weight, cap, deal the excess anew."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full = Fraction(*share) * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        level = (budget - sum(most * sizes[s] for s in full)) / sum(w[s] for s in free) if free else 0
        over = {s for s in free if w[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else w[s] * level for s in order}
        full |= over


def test_mixing(spark, odd_rows):
    rng = random.Random(1)
    rows = odd_rows + [(1000 + i, "en", f"t{i % 30}", "w " * rng.randrange(1, 400 if i % 30 < 4 else 9)) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as u", "2 as size", "3 as number", "4 as COPY", "5 as _mix_target")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += size(r[3])
    targets = brute_targets(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.MOST)
    got = mixing.mix_counts(df.select(*SCHEMA.replace(" bigint", "").replace(" string", "").split(", "))).collect()
    again = mixing.mix_counts(df.drop("size", "u", "COPY", "_mix_target")).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, again))
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"]) for r in got if r["doc_id"] != 500) == sorted((d is None, d, size(t)) for d, _, _, t in rows if d != 500)
    by_source = {s: sizes[s] for s in sizes}
    assert all(any(r["source_size"] == n and r["target"] == pytest.approx(float(targets[s])) for s, n in by_source.items()) for r in got)
    assert sum({s: float(t) for s, t in targets.items()}.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for r in got:
        rate = Fraction(r["target"]).limit_denominator(10**9) / r["source_size"] if r["source_size"] else Fraction(0)
        assert r["copies"] in (int(rate), int(rate) + 1) and r["copies"] <= 2
    emitted = mixing.mix_documents(df)
    assert emitted.columns == [*df.columns, "_copy"]
    taken = Counter((r["doc_id"], r["text"]) for r in emitted.select("doc_id", "text").collect())
    want = Counter()
    for r, row in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"])), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, size(r[3]))), strict=True):
        want[row[0]] += r["copies"]
    assert Counter({d: n for d, n in want.items() if n}) == Counter({d: sum(n for (x, _), n in taken.items() if x == d) for d in {x for x, _ in taken}})
    assert mixing.mix_counts(spark.createDataFrame([], SCHEMA)).count() == 0 and mixing.mix_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mixing_nears_its_targets(spark):
    rows = [(i, "en", f"s{i % 3}", "w " * (5 + i % 20)) for i in range(6000)]
    got = mixing.mix_counts(spark.createDataFrame(rows, SCHEMA)).selectExpr("target", "size * copies as taken").groupBy("target").sum("taken").collect()
    assert len(got) == 3 and all(abs(t / target - 1) < 0.03 for target, t in got)


def test_mixing_over_many_sources(spark, monkeypatch):
    """Beyond what is broadcast the plan is met by salted keys; a third of all rows has one source. The numbers are as before."""
    rows = [(i, "en", "hot" if i % 3 == 0 else f"s{i % 97}", "w " * (i % 9)) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, mixing.mix_counts(df).collect()))
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 3)
    assert sorted(map(tuple, mixing.mix_counts(df).collect())) == want


def test_words_of_odd_texts(spark):
    texts = [None, "", " ", "\n\t\r\x0b\x0c ", "a", " a  b ", "a b c", "\x00 \x1f", "x" * 10, "w " * 1_000_000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(__import__("pyspark.sql.functions").sql.functions.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


# fingerprints of unions


def test_merged_fingerprints_are_those_of_whole_sets(spark, sf_dir, monkeypatch):
    """All documents by source: merged sketches of parts equal the sketch of all shingles, whatever parts there are."""
    from mnemolake.llm import fingerprints
    from mnemolake.llm.shingles import shingle_hashes, word_hashes

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(-1, None, "blank"), (-2, "", "blank"), (-3, "one two three four five six", None), (-4, None, None)], "doc_id bigint, text string, source string")
    rows = docs.union(odd)
    prints = fingerprints.fingerprint_documents(rows).join(rows.select("doc_id", "source"), "doc_id").withColumn("g", __import__("pyspark.sql.functions").sql.functions.lit(1))
    got = {r["source"]: (r["fingerprint"], r["n_shingles"]) for r in fingerprints.merge_fingerprints(prints.repartition(7), "source").collect()}
    sets = defaultdict(list)
    for r in rows.collect():
        sets[r["source"]].append(shingle_hashes(word_hashes((r["text"] or "").encode()), fingerprints.SHINGLE_WORDS) >> np.uint64(64 - fingerprints.HASH_BITS))
    assert got.keys() == sets.keys()
    for source, parts in sets.items():
        whole = np.unique(np.concatenate(parts))
        assert fingerprints.decoded(got[source][0]).tolist() == whole[: fingerprints.SKETCH_SIZE].tolist()
        assert got[source][1] == pytest.approx(len(whole), rel=0.25)
    assert got["blank"] == ("", 0.0) and got[None][1] == 2.0
    twice = fingerprints.merge_fingerprints(fingerprints.merge_fingerprints(prints, "source").selectExpr("1L as one", "fingerprint"), "one").first()
    assert fingerprints.decoded(twice["fingerprint"]).tolist() == np.unique(np.concatenate([x for p in sets.values() for x in p]))[: fingerprints.SKETCH_SIZE].tolist()
    assert fingerprints.merge_fingerprints(prints.limit(0), "source").count() == 0


def test_containment_of_fingerprints(spark):
    from mnemolake.llm import fingerprints

    words = [f"w{i}" for i in range(3000)]
    texts = {"whole": " ".join(words), "half": " ".join(words[:1500]), "small": " ".join(words[10:60]), "none": None, "other": " ".join(f"v{i}" for i in range(500))}
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint_documents(spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id bigint, text string")).collect()}
    f = dict(zip(texts, (prints[i] for i in range(len(texts))), strict=True))
    pairs = [("half", "whole"), ("small", "whole"), ("other", "whole"), ("none", "whole"), ("none", "none"), ("whole", "whole")]
    df = spark.createDataFrame([(x, y, f[x] or None, f[y], 1) for x, y in pairs], "x string, y string, a string, b string, A_IN_B int")
    out = fingerprints.compare_fingerprints(df)
    assert out.columns == ["x", "y", "a", "b", "A_IN_B", "resemblance", "_a_in_b", "b_in_a", "a_shingles", "b_shingles"]
    got = {(r["x"], r["y"]): r for r in out.collect()}
    assert got["half", "whole"]["_a_in_b"] == pytest.approx(1, abs=0.2) and got["half", "whole"]["b_in_a"] == pytest.approx(0.5, abs=0.12) and got["half", "whole"]["resemblance"] == pytest.approx(0.5, abs=0.12)
    assert got["other", "whole"]["_a_in_b"] == 0 and got["none", "whole"]["_a_in_b"] == 1 and got["none", "none"]["resemblance"] == 1 and got["whole", "whole"]["b_in_a"] == 1
    assert got["half", "whole"]["a_shingles"] == pytest.approx(1496, rel=0.2)
