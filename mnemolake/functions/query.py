"""Query understanding and claim support: terms, Han carving, layer routing, evidence windows, what an excerpt proves."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake.functions import text as X
from mnemolake.functions.columns import any_in, let, lines_of, mapped, ordered_distinct, text_of, words_in

# Word lists and patterns that results depend on.
STOP_TERMS = (
    "的", "了", "是", "在", "做", "干", "有", "被", "把", "给", "让", "对", "从", "到", "会", "能", "要", "过",
    "和", "与", "或", "也", "就", "都", "吗", "呢", "啥", "嘛", "呀", "吧",
    "我", "你", "他", "她", "它", "我们", "你们", "他们", "她们",
    "什么", "干什么", "怎么", "怎样", "咋", "哪些", "哪个", "如何", "谁", "为什么", "多少",
    "干嘛", "干啥", "咋样", "怎么样", "得怎么样", "啥时候",
    "最近", "最新", "上次", "之前", "以前", "目前", "当前", "本周", "本月", "今天", "昨天", "正在",
    "明天", "前天", "后天",
    "历史", "进展", "情况", "近况", "时候",
)
MODAL_PREFIXES = "要再先还都也就别才又快去来"
DIRECTIONAL_SUFFIXES = ("进来", "进去", "出来", "出去", "上来", "上去", "下来", "下去", "起来", "过来", "过去", "回来", "回去")
HAN_DATE_ANYWHERE = r"(?:(\d{4})年)?(\d{1,2})月(?:(\d{1,2})(?:日|号)?)?"
LAYER_ALIASES = {
    "paper": ("paper", "papers", "publication", "publications", "research"),
    "model": ("model", "models", "system", "systems"),
    "person": ("person", "people", "author", "authors", "researcher", "researchers", "team"),
    "benchmark": ("benchmark", "benchmarks", "evaluation", "evaluations", "eval", "test", "tests"),
    "note": ("note", "notes", "memo", "memos", "record", "records"),
    "report": ("report", "reports", "summary", "summaries", "finding", "findings", "conclusion", "conclusions", "status"),
    "survey": ("survey", "surveys", "overview", "overviews", "guide", "guides", "section", "sections"),
}
REPORT_LAYERS = ("report", "history", "archive", "summary")
EXPLANATORY_LAYERS = ("survey", "overview", "guide", "documentation", "docs")
PERSONAL_LAYERS = ("standup", "standups", "daily", "diary", "diaries", "journal", "journals")
TEMPORAL_GROUPS = (("report", "reports", "history", "archive", "archives"), ("weekly", "monthly", "daily"), ("notes", "note", "log", "logs"))
ASKS_TIME = r"(?i)latest|recent|最近|最新|上次|之前|以前|历史|本周|本月|昨天|today|yesterday"
ASKS_FINDINGS = r"(?i)结论|finding|findings|evidence|summary|评估证据"
ASKS_WHY = r"(?i)how|what|why|which"
ASKS_TOPIC = r"(?i)learning|study|studies|method|methods|feedback|training|research|学习|研究|方法|反馈"
ASKS_PERSON = r"(?i)我|你|某人|谁|在做|在干|做什么|干什么|干啥|干嘛|what.*doing|doing|standup|日报"
ASKS_REPORT = r"(?i)report|weekly|monthly|周报|报告|结论|summary|finding"

_HAN_RUN = f"{X.HAN}+"
_PAIR = "array<struct<term:string,carved:boolean>>"


def all_han(t: Column) -> Column:
    return t.rlike(f"^{_HAN_RUN}$")


def indexed_alike(t: Column) -> Column:
    """Whether a word index that takes a Han run for one word finds the term: it has no Han character."""
    return ~t.rlike(X.HAN)


def _pair(term: Column, carved: Column) -> Column:
    return F.struct(term.alias("term"), carved.alias("carved"))


def carved_run(run: Column) -> Column:
    """Pieces of a Han run between its stop terms (the longest are cut out first), each with its grams of two to four; only a piece that is the whole run is not carved."""
    cut = reduce(lambda x, stop: F.replace(x, F.lit(stop), F.lit(" ")), sorted(STOP_TERMS, key=len, reverse=True), run)

    def grams(p: Column, n: int) -> Column:
        return F.when(F.length(p) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: _pair(F.substring(p, i, F.lit(n)), F.lit(True)))).otherwise(F.array().cast(_PAIR))

    pieces = F.filter(F.split(cut, " "), lambda p: p != "")
    return F.flatten(F.transform(pieces, lambda p: F.concat(F.array(_pair(p, p != run)), grams(p, 2), grams(p, 3), grams(p, 4))))


def segmented_run(segment: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """carved_run() with a word segmenter: an Arrow UDF. Words between stop terms, and what neighbours make together."""

    @F.pandas_udf(_PAIR)
    def terms(runs: pd.Series) -> pd.Series:
        def one(run: str) -> list[dict]:
            groups: list[list[str]] = [[]]
            for word in filter(str.strip, segment(run)):
                if word in STOP_TERMS:
                    groups.append([])
                else:
                    groups[-1].append(word)
            out = []
            for own in filter(None, groups):
                made = ["".join(own)] if len(own) > 2 else []
                made += [a + b for a, b in zip(own, own[1:], strict=False)]
                out += [(x, x != run) for x in made] + [(x, False) for x in own if len(x) >= 2]
            return [{"term": t, "carved": c} for t, c in out]

        return runs.map(one)

    return terms


def _folded(pairs: Column) -> Column:
    """Distinct terms in order; one that came uncarved once is not carved."""
    kept = F.filter(pairs, lambda x: (x["term"] != "") & ~x["term"].isin(*STOP_TERMS))
    return ordered_distinct(kept, "term", lambda own: _pair(F.get(own, 0)["term"], F.forall(own, lambda x: x["carved"])))


def _of_token(token: Column, run_terms: Callable[[Column], Column]) -> Column:
    iso = X.han_iso_date(token)
    mixed = ~all_han(token) & ~any_in(token, words_in(STOP_TERMS))
    runs = F.filter(F.regexp_extract_all(token, F.lit(_HAN_RUN), F.lit(0)), lambda r: F.length(r) >= 2)
    parts = F.concat(F.when(mixed, F.array(_pair(token, F.lit(False)))).otherwise(F.array().cast(_PAIR)), F.flatten(F.transform(runs, run_terms)))
    return F.when(indexed_alike(token), F.array(_pair(token, F.lit(False)))).when(iso.isNotNull(), F.array(_pair(iso, F.lit(False)))).otherwise(parts)


def expand(query: Column | str) -> Column:
    """Array of (term, carved): words; a Han date as ISO; a mixed word without stop terms whole; Han runs of two or more carved.

    A term is carved if this tokenizer made it; one that the asker delimited even once is not. No stop terms."""
    return _folded(F.flatten(F.transform(X.words(query), lambda t: _of_token(t, carved_run))))


def query_terms(query: Column | str) -> Column:
    return F.transform(expand(query), lambda x: x["term"])


def plane_terms(query: Column | str, stop: tuple[str, ...]) -> Column:
    """Terms for a store that matches text directly, without the words that describe the store."""
    return F.array_except(query_terms(query), words_in(stop))


def guessed(pairs: Column) -> Column:
    """Of expand()'s pairs, the terms whose borders are guesses: the carved ones, and Han words that a modal begins or a directional complement ends."""
    glued = lambda t: all_han(t) & (((F.length(t) == 2) & F.contains(F.lit(MODAL_PREFIXES), F.substring(t, 1, 1))) | (F.length(t).between(3, 4) & F.substring(t, -2, 2).isin(*DIRECTIONAL_SUFFIXES)))
    return F.transform(F.filter(pairs, lambda x: x["carved"] | glued(x["term"])), lambda x: x["term"])


def carved_terms(query: Column | str) -> Column:
    return let(expand(query), guessed)


def date_aliases(text: Column | str) -> Column:
    """ISO forms of all Han dates in a text, in order."""
    part = lambda k: F.regexp_extract_all(text_of(text), F.lit(HAN_DATE_ANYWHERE), F.lit(k))
    return F.array_compact(F.transform(part(0), X.han_iso_date))


def supported(term: Column, evidence: Column) -> Column:
    """Whether evidence holds the term, or, of a Han term, a run of at least three characters and half of it."""
    n = F.length(term)
    least = F.greatest(F.lit(3), F.floor((n + 1) / 2).cast("int"))
    runs = F.when(n > least, F.transform(F.sequence(F.lit(1), F.greatest(n - least + 1, F.lit(1))), lambda i: F.substring(term, i, least))).otherwise(F.array().cast("array<string>"))
    return F.contains(evidence, term) | (all_han(term) & any_in(evidence, runs))


def required_terms(terms: Column, unreachable: Column, real: Column, carved: Column) -> Column:
    """The terms that evidence must hold.

    Terms of three characters (Han: two) that are not generic; where there are real words, no carved joins; of Han terms
    the longest forms; none that the corpus never has and the tokenizer made, but the real words that such a join took in.
    No step may leave nothing to require."""
    long_enough = lambda t: (F.length(t) >= 3) | ((F.length(t) >= 2) & all_han(t))
    raw = F.array_distinct(F.filter(terms, lambda t: long_enough(t) & ~t.isin(*X.GENERIC_SUPPORT)))
    has = F.array_contains
    absorbed = lambda t, others: F.exists(others, lambda o: (F.length(o) > F.length(t)) & F.contains(o, t))

    def without_joins(r: Column) -> Column:
        kept = F.filter(r, lambda t: ~has(carved, t) | has(real, t))
        return F.when((F.size(real) > 0) & (F.size(carved) > 0) & (F.size(kept) > 0), kept).otherwise(r)

    def reachable(r: Column) -> Column:
        longest = F.filter(r, lambda t: ~(all_han(t) & absorbed(t, r)))

        def choose(s: Column) -> Column:
            dropped, left = F.filter(s, lambda t: has(unreachable, t)), F.filter(s, lambda t: ~has(unreachable, t))
            back = F.filter(r, lambda t: has(left, t) | (has(real, t) & ~has(unreachable, t) & absorbed(t, dropped)))
            out = F.when(F.size(dropped) > 0, back).otherwise(left)
            return F.when(F.size(out) > 0, out).otherwise(s)

        return let(longest, choose)

    return let(let(raw, without_joins), reachable)


def claim_support(terms: Column, excerpt: Column, path: Column | None = None, line_start: Column | None = None, unreachable: Column | None = None, real: Column | None = None, carved: Column | None = None) -> Column:
    """Struct of matched, unmatched, coverage, claim_support (direct, partial, unknown) and spans (line, terms) of an excerpt.

    The path is evidence, too, as are ISO forms of the Han dates that the evidence holds; spans are lines of the excerpt."""
    none = F.array().cast("array<string>")
    given = [none if x is None else F.coalesce(x, none) for x in (unreachable, real, carved)]
    low = F.lower(F.concat_ws(" ", path, text_of(excerpt))) if path is not None else F.lower(text_of(excerpt))
    evidence = let(low, lambda e: F.concat_ws(" ", F.concat(F.array(e), date_aliases(e))))
    first = F.lit(1) if line_start is None else line_start

    def judged(required: Column) -> Column:
        def found(e: Column) -> Column:
            matched = F.filter(required, lambda t: supported(t, e))

            def out(m: Column) -> Column:
                n, k = F.size(required), F.size(m)
                lines = F.transform(lines_of(excerpt), lambda line, i: F.struct((first + i).cast("int").alias("line"), F.filter(m, lambda t: supported(t, F.lower(line))).alias("terms")))
                return F.struct(
                    m.alias("matched"), F.array_except(required, m).alias("unmatched"), F.when(n > 0, F.bround(k / n, 4)).otherwise(1.0).alias("coverage"),
                    F.when(n == k, "direct").when(k > 0, "partial").otherwise("unknown").alias("claim_support"), F.filter(lines, lambda x: F.size(x["terms"]) > 0).alias("spans"),
                )

            return let(matched, out)

        return let(evidence, found)

    return let(required_terms(terms, *given), judged)


def evidence_window(text: Column | str, terms: Column, most: int = 12) -> Column:
    """Struct of excerpt, line_start and line_end (1-based) around the strongest evidence.

    A line scores the occurrences of the terms, and one more if it is a heading with any. All matching lines are one window if
    they lie within 2 * most lines; else a heading that scores best opens the window, and another line has a third of it before."""

    def window(lines: Column) -> Column:
        n = F.size(lines)
        hits = F.transform(lines, lambda line: F.aggregate(terms, F.lit(0), lambda s, t: s + X.term_count(F.lower(line), t)))
        scores = F.zip_with(hits, lines, lambda k, line: k + F.when((k > 0) & F.ltrim(line).startswith("#"), 1).otherwise(0))

        def place(s: Column) -> Column:
            at = F.filter(F.transform(s, lambda k, i: F.when(k > 0, i).otherwise(-1)), lambda i: i >= 0)
            best = -F.array_max(F.transform(s, lambda k, i: F.struct(k.alias("k"), (-i).alias("i"))))["i"]
            low, high = F.array_min(at), F.array_max(at)
            near = high - low + 1 <= 2 * most
            heading = F.ltrim(F.get(lines, best)).startswith("#")
            start = F.when(F.size(at) == 0, 0).when(near, F.greatest(F.lit(0), low - most // 4)).when(heading, best).otherwise(F.greatest(F.lit(0), best - most // 3))
            return let(F.struct(start.cast("int").alias("a"), F.when((F.size(at) > 0) & near, high + most // 4 + 1).otherwise(start + most).cast("int").alias("b")), lambda w: F.struct(
                F.array_join(F.slice(lines, w["a"] + 1, F.least(n, w["b"]) - w["a"]), "\n").alias("excerpt"), (w["a"] + 1).alias("line_start"), F.least(n, w["b"]).alias("line_end")))

        return F.when(n > 0, let(scores, place)).otherwise(F.struct(F.lit("").alias("excerpt"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end")))

    return let(lines_of(text), window)


def singular(layer: Column) -> Column:
    return F.regexp_replace(layer, "s+$", "")


def layer_matches(layer: Column, terms: Column) -> Column:
    """Whether a directory name (or one of its kind's names) is among the terms."""
    name = F.replace(F.lower(layer), F.lit("_"), F.lit("-"))
    kinds = F.lit(None).cast("array<string>")
    for names in reversed(LAYER_ALIASES.values()):
        kinds = F.when(name.isin(*names) | singular(name).isin(*names), words_in(names)).otherwise(kinds)
    return F.arrays_overlap(terms, F.coalesce(kinds, F.array(name, singular(name))))


def preferred_layers(query: Column, layers: Column) -> Column:
    """Of the corpus's layers, those that the question's own words, or its kind (findings, explanation, topic, person, time), point to."""
    q = F.lower(text_of(query))
    forms = let(query_terms(query), lambda t: F.array_distinct(F.concat(t, F.flatten(F.transform(t, X.term_forms)))))
    pick = lambda names, of=layers: F.filter(of, lambda x: singular(F.lower(x)).isin(*names))
    exact = lambda names: F.filter(layers, lambda x: F.lower(x).isin(*names))
    some = lambda a: F.size(a) > 0
    named = let(forms, lambda f: F.filter(layers, lambda x: layer_matches(x, f)))
    reports, explains, papers, surveys = pick(REPORT_LAYERS), pick(EXPLANATORY_LAYERS), pick(LAYER_ALIASES["paper"]), pick(LAYER_ALIASES["survey"])
    time = q.rlike(ASKS_TIME)
    topic = F.when(q.rlike(ASKS_TOPIC) & some(papers), F.array_union(papers, surveys)).otherwise(F.array().cast("array<string>"))
    groups = topic
    for names in reversed(TEMPORAL_GROUPS):
        groups = F.when(some(exact(names)), exact(names)).otherwise(groups)
    personal = q.rlike(ASKS_PERSON) & ~q.rlike(ASKS_REPORT) & some(exact(PERSONAL_LAYERS))
    return (
        F.when(time & q.rlike(ASKS_FINDINGS) & some(reports), reports).when(some(named), named).when(q.rlike(ASKS_WHY) & some(explains), explains)
        .when(time & personal, exact(PERSONAL_LAYERS)).when(time, groups).otherwise(topic)
    )


#: Names of the layers' tiers.
TIER = {"L0": 0, "L1": 1, "L2": 2, "L3": 3}
KIND = {"L0": "conversation", "L1": "atomic", "L2": "scenario", "L3": "profile"}
REF_KIND = {"L0": "conversation", "L1": "trace", "L2": "policy", "L3": "world_model"}


def tier(layer: Column) -> Column:
    return mapped(layer, TIER)


def kind(layer: Column) -> Column:
    return mapped(layer, KIND, "memory")


def ref_kind(layer: Column) -> Column:
    return mapped(layer, REF_KIND, "memory")
