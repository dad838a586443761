from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.functions import citations as C
from mnemolake.functions import host as H
from mnemolake.functions import query as Q
from mnemolake.functions import text as X
from mnemolake.functions import vectors as V
from mnemolake.operators import stores as O


@pytest.fixture(scope="module")
def value(spark):
    def of(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return of


@pytest.mark.parametrize(("text", "want"), [
    ("fictional ZZZQWE repository that was never indexed", "negative"), ("最新进展", "temporal"), ("compare both", "cross-source"), ("see ./notes/a.md", "exact"), ("how are rewards shaped", "semantic"), (None, "semantic"), ("", "semantic"),
])
def test_intent(value, text, want):
    assert value(X.intent(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("token", "want"), [
    ("2026年8月18日", "2026-08-18"), ("8月18日", "08-18"), ("8月20号", "08-20"), ("8月18", "08-18"), ("2026年8月", "2026-08"), ("8月", None), ("13月1日", None), ("8月32日", None), ("August", None), (None, None),
])
def test_han_dates(value, token, want):
    assert value(X.han_iso_date(F.lit(token).cast("string"))) == want


@pytest.mark.parametrize(("term", "want"), [("rewards", {"rewards", "reward"}), ("training", {"training", "train", "trai"}), ("running", {"running", "runn", "run"}), ("policies", {"policies", "policy", "policie"}), ("class", {"class"}), ("tested", {"tested", "test"}), ("a", set())])
def test_term_forms(value, term, want):
    assert set(value(X.term_forms(F.lit(term)))) == want


def test_compound_parts_leave_numbers_out(value):
    assert value(X.compound_parts(F.lit("long-context/08-18"))) == ["long", "context"]


def test_redaction(value):
    text = "key: api_key=abcdefghijklmnopqrst and Bearer abcdefghijklmnopqrst <user-persona>x</user-persona> [[reply_to 3]] done"
    got = value(X.redact(F.lit(text)))
    assert "abcdefghijklmnop" not in got and "persona" not in got and "reply_to" not in got and got.endswith("done")


def test_term_count_does_not_overlap(value):
    assert value(X.term_count(F.lit("aaaa"), F.lit("aa"))) == 2
    assert value(X.term_count(F.lit("aaaa"), F.lit(""))) == 0


@pytest.mark.parametrize(("role", "text", "want"), [("user", "is it? ", True), ("User", "是吗？", True), ("assistant", "is it?", False), ("user", "it is", False), (None, None, False)])
def test_question_turns(value, role, text, want):
    assert value(X.is_question_turn(F.lit(role).cast("string"), F.lit(text).cast("string"))) is want


def test_echo(value):
    echo = lambda e, q: value(X.is_echo(F.lit("assistant"), F.lit(e), F.lit(q)))
    assert echo("What is it?!", "what is it")
    assert not echo("what is it: a long answer with content", "what is it")
    assert not echo("", "what")


def test_signature(value):
    assert value(X.signature(F.lit("Build failed again"))) == "failure|again|build|failed"
    assert value(X.signature(F.lit(""))) == "empty"


def test_date_score_puts_a_week_where_a_month_stands(value):
    assert value(X.date_score(F.lit("2026-08-18"))) == 2026 * 1_000_000 + 8 * 10_000 + 1800
    assert value(X.date_score(F.lit("2026-W33"))) == 2026 * 1_000_000 + 33 * 10_000


def test_epochs_in_milliseconds(value):
    assert value(X.epoch_seconds(F.lit(1704067200000))) == 1704067200.0
    assert value(X.epoch_seconds(F.lit(1704067200))) == 1704067200


def test_secret_paths(value):
    assert value(X.is_secret_path(F.lit("a/.env"))) and value(X.is_secret_path(F.lit("a/.git/x"))) and value(X.is_secret_path(F.lit("x/server.pem")))
    assert not value(X.is_secret_path(F.lit("docs/readme.md")))


def test_cosine(value):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert value(V.cosine(arr(1.0, 0.0), arr(0.6, 0.8))) == pytest.approx(0.6)
    assert value(V.cosine(arr(1.0), arr(0.6, 0.8))) == 0.0


def test_builtin_vector_is_unit_and_stable(spark):
    v = spark.createDataFrame([("hello world",), ("",), (None,), ("记忆检索",)], "t string").select(V.builtin_vector("t").alias("v")).collect()
    assert sum(x * x for x in v[0]["v"]) == pytest.approx(1.0)
    assert not any(v[1]["v"]) and not any(v[2]["v"])
    assert sum(x * x for x in v[3]["v"]) == pytest.approx(1.0)


def test_builtin_features_and_places():
    assert V.features("Ab a") == {"w:ab": 1.0}
    assert V.features("abcd abcd") == {"w:abcd": 2.0, "c:abc": 1.5, "c:bcd": 1.5}
    assert V.features("记忆 x") == {"w:记忆": 1.0, "g2:记忆": 1.2, "g2:忆x": 1.2, "g3:记忆x": 1.0}
    digest = hashlib.blake2b(b"w:ab", digest_size=16).digest()
    first, second = int.from_bytes(digest[:8], "little") % 384, int.from_bytes(digest[8:], "little") % 384
    sign = 1.0 if digest[0] & 1 else -1.0
    raw = np.zeros(384)
    raw[first] += sign
    raw[second] += 0.35 * (-sign if digest[1] & 1 else sign)
    assert np.allclose(V.encode(["AB"])[0], raw / np.linalg.norm(raw), atol=1e-12)


@pytest.mark.parametrize(("query", "want", "carved"), [
    ("李宁最近在做什么", ["李宁"], {"李宁"}), ("武垚乐 8月18日", ["武垚乐", "武垚", "垚乐", "08-18"], {"武垚", "垚乐"}), ("8月", ["8月"], set()), ("v2版本 Rewards", ["v2版本", "版本", "rewards"], set()), ("什么 的 做", [], set()), ("接进来", ["接进来", "接进", "进来"], {"接进来", "接进", "进来"}), (None, [], set()),
])
def test_query_terms(value, query, want, carved):
    q = F.lit(query).cast("string")
    assert value(Q.query_terms(q)) == want and set(value(Q.carved_terms(q))) == carved


def test_segmenter_keeps_words(spark):
    cut = {"火山云的模型": ["火山", "云", "的", "模型"]}
    run = Q.segmented_run(lambda text: cut[text])
    got = spark.createDataFrame([("火山云的模型",)], "r string").select(run("r").alias("p")).first()["p"]
    assert [(x["term"], x["carved"]) for x in got] == [("火山云", True), ("火山", False), ("模型", False)]


def test_terms_that_a_word_index_finds(value):
    assert value(Q.indexed_alike(F.lit("octo-loop"))) and not value(Q.indexed_alike(F.lit("v2版本")))


@pytest.mark.parametrize(("terms", "excerpt", "path", "gone", "real", "carved", "want"), [
    (["alpha", "note", "xy"], "has ALPHA", "", [], [], [], ("direct", 1.0)), (["alpha", "beta", "gamma"], "beta", "", [], [], [], ("partial", 0.3333)), (["alpha"], "none", "", [], [], [], ("unknown", 0.0)), ([], "x", "", [], [], [], ("direct", 1.0)),
    (["李宁"], "x", "standup/李宁.md", [], [], [], ("direct", 1.0)), (["自动记忆钩子"], "记忆钩子", "", [], [], [], ("direct", 1.0)), (["虚构项目"], "项目", "", [], [], [], ("unknown", 0.0)), (["08-18"], "8月18日 done", "", [], [], [], ("direct", 1.0)),
    (["alpha", "是怎么配置"], "alpha", "", ["是怎么配置"], [], ["是怎么配置"], ("direct", 1.0)), (["是怎么配置"], "x", "", ["是怎么配置"], [], ["是怎么配置"], ("unknown", 0.0)), (["模型上线", "模型", "上线"], "模型", "", [], ["模型", "上线"], ["模型上线"], ("partial", 0.5)),
])
def test_claim_support(value, terms, excerpt, path, gone, real, carved, want):
    arr = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    s = value(Q.claim_support(arr(terms), F.lit(excerpt), F.lit(path), None, arr(gone), arr(real), arr(carved)))
    assert (s["claim_support"], s["coverage"]) == want


def test_evidence_windows(value):
    at = lambda text, *terms: (lambda w: (w["line_start"], w["line_end"]))(value(Q.evidence_window(F.lit(text), F.array(*map(F.lit, terms)))))
    assert at("", "x") == (1, 1) and at("a\nb", "x") == (1, 2)
    assert at("x\n" + "y\n" * 30, "x") == (1, 4)
    far = "x one\n" + "y\n" * 40 + "x x\n" + "y\n" * 20
    assert at(far, "x") == (38, 49)
    assert at(far.replace("x x", "## x"), "x") == (42, 53)


@pytest.mark.parametrize(("query", "want"), [
    ("latest finding", {"reports"}), ("papers about x", {"papers"}), ("how is it", {"survey"}), ("what 李宁 did today", {"survey"}), ("谁 昨天 日报", {"standup"}), ("learning", {"papers", "survey"}), ("recent", {"reports"}), ("plain", set()),
])
def test_layer_routing(value, query, want):
    layers = F.array(*map(F.lit, ("papers", "reports", "survey", "standup", "weekly")))
    assert set(value(Q.preferred_layers(F.lit(query), layers))) == want


def test_citations(value):
    text = F.lit("first line here\nsecond line of text\nthird")
    place = lambda e: (lambda w: (w["line_start"], w["line_end"]))(value(C.located(text, F.lit(e))))
    assert place("second line of text\nthird") == (2, 3) and place("zz\nsecond line of\nqq") == (2, 3) and place("absent") == (1, 3)
    check = lambda path, a, b, e, commit="c": (lambda v: (v["valid"], v["stale"], v["reason"]))(value(C.validation(text, F.lit(path), F.lit(a), F.lit(b), F.lit(e), F.lit(commit), F.lit("c"))))
    assert check("a.md", 2, 2, " second  line of text") == (True, False, None) and check("a.md", 3, 3, "third") == (True, False, None)
    assert check("a.md", 2, 2, "second line of text", "d") == (False, True, "commit mismatch")
    assert check("../a.md", 1, 1, "x")[2].endswith("source root") and check("a.md", 3, 9, "x")[2].endswith("invalid") and check("a.md", 1, 1, " ")[2].endswith("missing") and check("a.md", 1, 1, "third")[2].endswith("cited lines")
    assert value(C.native_validation(F.lit("local-memory"), F.lit("L1"), F.lit("i"), F.lit("e"))) is None and value(C.native_validation(F.lit("web"), F.lit("L1"), F.lit("i"), F.lit("e"))) is not None
    assert value(C.citation_path(F.lit("raw\\sources\\a\\b.md"))) == "a/b.md"


def test_marks(value):
    assert value(C.with_marks(F.lit("status: candidate\nbody"), "accepted", "L2", F.lit("p"))) == "source_l2: p\nlayer: L2\nevidence_status: accepted\nstatus: accepted\nbody\n"
    profile = value(O.promoted_profile(F.lit(""), F.lit("x"), F.lit("p")))
    assert value(O.promoted_profile(F.lit(profile), F.lit("x"), F.lit("p"))) == profile and value(O.promoted_profile(F.lit(profile), F.lit("y"), F.lit("q"))).count("# Memory Profile") == 2


def test_json_and_yaml(value):
    assert value(C.json_text(F.lit('{"a": {"b": 3}}'), "a.b")) == "3" and value(C.json_text(F.lit("{"), "a")) is None
    assert value(C.json_or(F.lit(" "), "struct<a:int>", F.struct(F.lit(7).alias("a"))))["a"] == 7
    assert value(C.yaml_scalar(F.lit('a "b"'), "string")) == '"a \\"b\\""' and value(C.yaml_scalar(F.lit(""), "string")) == "null" and value(C.yaml_scalar(F.lit(True), "boolean")) == "true"


def test_message_content(value):
    assert value(X.content_text(F.lit('["a", {"type": "text", "text": "b"}, {"type": "image", "text": "no"}, {"type": "input_text", "content": "c"}]'))) == "a\nb\nc"
    assert value(X.content_text(F.lit('{"content": "z"}'))) == "z" and value(X.content_text(F.lit("plain"))) == "plain" and value(X.content_text(F.lit(None).cast("string"))) == ""


def test_links_and_paths(value):
    text = F.lit("see [a](b%20c.md#x), [w](https://x.y/z.md) [m](mailto:a@b.c) and docs/x.md, `y/z.yaml` [q](d.md?raw)")
    assert value(X.link_targets(text)) == ["b c.md", "d.md", "docs/x.md", "y/z.yaml"]
    assert value(X.posix_path(F.lit("./a//b/./c.md"))) == "a/b/c.md"


def test_freshness(value):
    f = lambda d, e, c: value(C.freshness(F.lit(d), F.lit(e).cast("string"), F.lit(c).cast("string")))
    assert [f(True, "x", "c"), f(False, "x", "c"), f(False, None, "c"), f(None, None, None)] == ["dirty", "fallback", "fresh", "unknown"]


def test_receipts(value):
    assert value(H.has_receipt(F.lit("see abc123 at x"), F.array(F.lit("abc123")))) and not value(H.has_receipt(F.lit("no"), F.array(F.lit("abc123"))))
    assert value(H.expected_tool(F.lit("repository_search"), "search")) and not value(H.expected_tool(F.lit("search"), "search"))


def test_stripped_in_time_about_in_proportion(spark):
    from mnemolake.functions.columns import collapsed, stripped

    blanks = " \t" * 500_000
    texts = ["", " ", "a", " a ", " a b \n", "a\x85", f"a{blanks}b", f"{blanks}a{blanks}b{blanks}", blanks, "a \n b\n", "\x1ca\x1f", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(stripped("t").alias("s"), collapsed("t").alias("c"), "i").orderBy("i").collect()
    assert [r["s"] for r in got] == [(t or "").strip() for t in texts]
    assert [r["c"] for r in got] == [" ".join((t or "").split()) for t in texts]


def test_folding_is_that_of_full_case_folding(spark):
    from mnemolake.functions.columns import folded
    from mnemolake.operators.memory import folded_copies

    texts = ["Straße STRASSE", "ΣΑΣ σας ς Σ", "İstanbul I ı", "ﬁﬂ ŉ ǰ ΐ", "Plain ASCII", "ÀÉÎ Ñ Ж Я", "ẞ", "", "Ⅷ ⓐ Ａ", "ᾳ ῼ ᾈ", "😀ſK"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r["f"] for r in rows.select("i", folded("t").alias("f")).orderBy("i").collect()] == [t.casefold() for t in texts]
    pairs = spark.createDataFrame([(1, "straße "), (2, "STRASSE"), (3, "ΟΔΟΣ"), (4, "οδος"), (5, "οδοσ"), (6, "other")], "i int, t string")
    assert [r["i"] for r in folded_copies(pairs, "t", F.asc("i")).orderBy("i").collect()] == [1, 3, 6]


def test_remotes_lose_user_and_password(spark):
    from mnemolake.functions.text import redacted_remote

    cases = {"https://u:p@Host.org:80/a@b?q=1#f": "https://host.org:80/a@b?q=1#f", "git@host.org:a/b": "host.org:a/b", "/local/path": "/local/path", "ssh://host/x": "ssh://host/x", "": "", "https://a@b@c/d": "https://c/d", "a@b@c": "b@c"}
    rows = spark.createDataFrame([(u,) for u in [*cases, None]], "u string").select("u", redacted_remote("u").alias("r")).collect()
    assert {r["u"]: r["r"] for r in rows} == cases | {None: None}
