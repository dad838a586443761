"""The repository ranking: every signal of the score, for a frame of questions against an index of all documents.

A term matches as a substring, and its characters are those of words, so it lies inside one word of the text: terms are looked up in the
words of the postings where these are, and postings of words turn into those of terms. What a block of documents can give to
a question at most is summed from bits and maxima; only blocks that can reach the k-th score of the best ones are counted and scored by document.
Of these pairs, only those that can reach the first k (by a bound on what phrases can add) are held against their texts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions import matching as P
from mnemolake.functions import query as Q
from mnemolake.functions import text as X
from mnemolake.functions.columns import any_in, count_in, lines_of, text_of, words_in
from mnemolake.operators import index as I
from mnemolake.operators.retrieval import idf, small, top_k
from mnemolake.sources.files import deleted, exists, renamed
from mnemolake.sources.scratch import materialised, scratch_path

# Word lists, patterns and weights of the score.
DROPPED_TERMS = ("what", "latest", "recent", "最近", "最新", "什么", "source", "evidence", "citation", "definition", "and", "or", "the", "a", "an", "relationship")
TEMPORAL_NOUNS = ("note", "report", "weekly", "paper", "model", "card", "update", "result")
FILENAME_NOUNS = ("long", "context", "benchmark", "retrieval", "research", "result", "model", "paper", "survey", "section")
NOT_COVERED = (
    "how", "what", "why", "which", "do", "does", "did", "for", "about", "from", "the", "and", "or", "a", "an", "latest", "recent", "source", "evidence", "citation",
    "related", "relationship", "compare", "comparison",
)
NOT_COUNTED = (
    "how", "what", "why", "which", "do", "does", "did", "for", "about", "from", "the", "and", "or", "latest", "recent", "recently", "最近", "最新", "本周", "本月", "什么",
    "source", "evidence", "citation", "definition", "relationship", "related", "compare", "comparison", "result", "update",
)
NOT_NAMES = ("latest", "recent", "recently", "today", "yesterday", "what", "how", "why", "which")
LATEST = r"(?i)latest|recent|最近|最新|上次|之前|以前|历史|本周|本月"
CATALOG = (
    r"(?i)\b(index|overview|catalog|taxonomy|list|directory|framework|pipeline|instruction following|relationship|what makes|paper citation|survey section|compare|comparison)\b|"
    r"\bpaper\s+(?:about|on|regarding)\b|索引|目录|分类|框架|哪些|关系|对比|比较"
)
RELATES = r"(?i)related|relationship|compare|comparison|关联|相关|对比|比较"
ASKS_OPENLY = r"(?i)for|about|related|relationship|compare|对比|关联|相关|研究者|结论"
PERIODS = ("weekly", "monthly", "daily", "history", "archive")
WELL_KNOWN = ("papers/", "models/", "people/", "benchmarks/", "survey/", "reports/", "notes/")
ENTITY_KINDS = ("paper", "model", "person", "benchmark")
WIDE_HAN = "[一-鿿]"


def described(docs: DataFrame) -> DataFrame:
    """docs (doc_id, path, text) with what the score reads of a document besides its words."""
    low, name = F.lower("path"), F.element_at(F.split("path", "/"), -1)
    kinds = tuple(n for kind in ENTITY_KINDS for n in Q.LAYER_ALIASES[kind])
    dates = X.document_dates(F.col("path"), F.col("text"))
    numbers = F.transform("dates", lambda d: F.regexp_extract_all(d, F.lit(r"\d+"), F.lit(0)))
    newest = F.array_max(F.transform(numbers, lambda n: F.struct(*(F.coalesce(F.get(n, i).cast("int"), F.lit(0)).alias(k) for i, k in enumerate("ymd")))))
    headings = F.filter(F.slice(lines_of("text"), 1, 40), lambda line: F.ltrim(line).startswith("#"))
    primary = low.rlike(r"/index\.(yaml|yml|md)$")
    return docs.select(
        "doc_id", "path", "text", low.alias("low_path"), F.split("path", "/")[0].alias("layer"), F.lower(name).alias("name"), F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")).alias("stem"),
        F.lower(F.array_join(F.transform(headings, lambda line: F.regexp_replace(line, "^[# ]+", "")), " ")).alias("headings"), primary.alias("primary_index"),
        (primary | low.endswith("/aliases.yaml")).alias("index_like"), low.endswith("-codex.md").alias("codex"), F.exists(F.split(low, "/"), lambda p: p.isin(*PERIODS)).alias("period"),
        F.exists(words_in(WELL_KNOWN), lambda w: F.col("path").startswith(w)).alias("well_known"), F.split(low, "/")[0].alias("low_layer"), Q.singular(F.split(low, "/")[0]).isin(*kinds).alias("entity"), dates.alias("dates"),
    ).withColumn("day", F.coalesce(newest["y"] * 1_000_000 + newest["m"] * 10_000 + newest["d"] * 100, F.lit(0)))


def understood(queries: DataFrame, layers: Column) -> DataFrame:
    """queries (query_id, query) with the terms and flags that the score reads of a question; layers: array of the corpus's."""
    q = F.col("query")
    base = queries.select("query_id", "query", Q.expand("query").alias("pairs"), Q.preferred_layers(q, layers).alias("preferred"))
    raw = F.transform("pairs", lambda x: x["term"])
    more = F.concat(raw, F.flatten(F.transform(raw, X.compound_parts)), F.flatten(F.transform(raw, X.term_forms)))
    base = base.select("*", raw.alias("raw"), Q.guessed(F.col("pairs")).alias("guesses"), F.array_except(more, words_in(DROPPED_TERMS)).alias("terms")).drop("pairs")
    terms, guesses = F.col("terms"), F.col("guesses")
    dates = F.filter(terms, lambda t: t.rlike(X.DATE_TOKEN))
    content = F.array_except("raw", words_in(NOT_COVERED))
    sources = F.filter(content, lambda t: ~(F.array_contains(guesses, t) & F.exists(content, lambda o: (o != t) & F.contains(t, o))))
    covered = F.filter(sources, lambda t: (F.length(t) >= 2) & ~(Q.all_han(t) & F.exists(sources, lambda o: (F.length(o) > F.length(t)) & F.contains(o, t))))
    signals = F.filter(F.array_except(terms, words_in((*FILENAME_NOUNS, "multi"))), lambda t: F.length(t) >= 4)
    phrases = F.filter(
        F.zip_with(F.slice("raw", F.lit(1), F.greatest(F.size("raw") - 1, F.lit(0))), F.slice("raw", F.lit(2), F.greatest(F.size("raw") - 1, F.lit(0))), lambda a, b: F.when((F.length(a) >= 3) & (F.length(b) >= 3), F.concat(a, F.lit(" "), b))),
        lambda p: p.isNotNull(),
    )
    named = F.filter("raw", lambda t: ((F.length(t) >= 4) | ((F.length(t) >= 2) & Q.all_han(t))) & ~t.isin(*TEMPORAL_NOUNS, *NOT_NAMES) & ~t.rlike(X.DATE_TOKEN))
    asks, han = q.rlike(Q.ASKS_WHY), q.rlike(WIDE_HAN)
    latest = q.rlike(LATEST) | (F.size(dates) > 0)
    some_layer = F.size("preferred") > 0
    openly = asks | q.rlike(ASKS_OPENLY)
    relaxed = latest | F.exists("raw", lambda t: F.contains(t, F.lit("-"))) | openly | (F.size("preferred") > 1) | (han & some_layer)
    least = F.when(some_layer | openly | han, 1).when(relaxed, F.greatest(F.lit(1), F.floor((F.size(F.array_except(terms, words_in(NOT_COUNTED))) + 2) / 3))).otherwise(F.size(terms))
    specific = F.when(han, F.lit(0)).otherwise(F.size(F.array_except(terms, words_in(TEMPORAL_NOUNS))))
    return base.select(
        "*", dates.alias("date_terms"), content.alias("content"), covered.alias("covered"), signals.alias("signals"), phrases.alias("phrases"), named.alias("maybe_named"),
        F.array_except(terms, words_in(FILENAME_NOUNS)).alias("file_terms"), F.transform(F.filter(F.array_except(terms, words_in(FILENAME_NOUNS)), lambda t: F.length(t) >= 4), Q.singular).alias("heading_terms"),
        latest.alias("latest"), q.rlike(CATALOG).alias("catalog"), q.rlike(RELATES).alias("relates"), asks.alias("asks"), openly.alias("openly"), F.exists("raw", lambda t: F.contains(t, F.lit("-"))).alias("compound"),
        least.cast("int").alias("least"), (specific == 0).alias("no_specific"),
    ).where("size(terms) > 0 or latest")


def term_counts(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, term, n (occurrences in the text), in_path: of every asked term that a document's text or path holds.

    Few terms are looked up in the words where they are, and sums by document are shuffled; more than a task may hold meet all words by their grams."""
    kinds = F.array(F.struct(I.tokens(F.col("text")).alias("words"), F.lit(False).alias("path")), F.struct(F.array_distinct(I.tokens(F.col("path"))).alias("words"), F.lit(True).alias("path")))
    words = docs.select("doc_id", F.explode(kinds).alias("k")).select("doc_id", F.explode("k.words").alias("word"), "k.path")
    few = P.few_terms(asked)
    if few is not None:
        met = P.counted_by_key(words.withColumnRenamed("doc_id", "key"), few).withColumnRenamed("key", "doc_id")
        return met.repartition("doc_id").groupBy("doc_id", "term").agg(F.sum("n").cast("int").alias("n"), F.max("in_path").alias("in_path"))
    grams = words.select("word").distinct().select(F.explode(I.gram_list(F.col("word"))).alias("gram"), "word")
    own = materialised(I.term_words(asked.select("term").distinct(), grams), "term-words")
    counted = words.join(small(own), "word").groupBy("doc_id", "term").agg(F.sum(F.when(~F.col("path"), F.col("times")).otherwise(0)).cast("int").alias("n"), F.max("path").alias("in_path"))
    return counted.repartition("doc_id")


def _asked(known: DataFrame) -> DataFrame:
    """query_id, term, own: all that a question counts (its terms, and the forms of what must be covered), and, not its own, what headings may hold."""
    forms = lambda c: F.flatten(F.transform(c, X.term_forms))
    counted = F.concat("terms", forms("covered"), "raw")
    more = F.array_except(F.concat(forms("content"), "heading_terms"), F.concat(counted, F.array(F.lit(""))))
    mark = lambda terms, own: F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("term"), F.lit(own).alias("own")))
    return known.select("query_id", F.explode(F.concat(mark(counted, True), mark(more, False))).alias("t")).select("query_id", "t.*")


def corpus_frequency(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """term, df of asked terms, also of those that no document has."""
    return asked.select("term").distinct().join(counts.groupBy("term").agg(F.count("*").alias("df")), "term", "left").fillna(0, ["df"])


def _weights(asked: DataFrame, blocks: DataFrame, total: DataFrame) -> DataFrame:
    """term, idf of all asked terms, also of those that no document has."""
    df = asked.select("term").distinct().join(I.frequencies(blocks), "term", "left").fillna(0, ["df"])
    return df.join(F.broadcast(total)).select("term", idf(F.col("total"), F.col("df")).alias("idf"))  # total is a row


def _bits(flags: Column, masks: int) -> list[Column]:
    """An array of booleans as the columns mask0, mask1, ... of 63 bits each."""
    word = lambda k: F.aggregate(F.transform(F.slice(flags, 63 * k + 1, 63), lambda f, i: F.when(f, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    return [word(k).alias(f"mask{k}") for k in range(masks)]


def _weighed(known: DataFrame, asked: DataFrame, weights: DataFrame, masks: int) -> DataFrame:
    """What each term of a question is worth: query_id, term, own, idf, is_term, hyphen, signal, the bits of what it covers, and its points at most in a path or in headings."""
    has, t = F.array_contains, F.col("term")
    rows = known.select("query_id", "terms", "raw", "signals", "covered", "compound", "content", "file_terms", "heading_terms", "maybe_named").join(asked, "query_id").join(small(weights), "term")
    points = lambda c, n: F.when(c, n).otherwise(0)
    heads = F.filter("content", lambda c: has(X.term_forms(c), t))
    rows = rows.select(
        "query_id", "term", "own", "idf", has(F.col("terms"), t).alias("is_term"), (has(F.col("raw"), t) & F.contains(t, F.lit("-"))).alias("hyphen"), (has(F.col("signals"), t) & F.col("compound")).alias("signal"),
        *_bits(F.transform("covered", lambda c: has(X.term_forms(c), t)), masks), heads.alias("heads"), (420 * F.size(F.filter("heading_terms", lambda h: h == t))).alias("head_points"),
        (points(has(F.col("terms"), t), 28) + points(has(F.col("file_terms"), t), 260) + points(has(F.col("raw"), t) & has(F.col("maybe_named"), t), 3000)).alias("path_points"),
    )
    idfs = rows.where("is_term").select("query_id", F.col("term").alias("c"), F.col("idf").alias("c_idf"))
    held = rows.select("query_id", "term", F.explode("heads").alias("c")).join(idfs, ["query_id", "c"], "left")
    more = held.groupBy("query_id", "term").agg(F.sum(F.floor(F.lit(800.0) * F.coalesce("c_idf", F.lit(1.0)))).alias("_more"))
    return rows.join(more, ["query_id", "term"], "left").withColumn("head_points", F.col("head_points") + F.coalesce("_more", F.lit(0))).drop("_more", "heads")


def _sums(counts: DataFrame, per_term: DataFrame, *by: str) -> DataFrame:
    """Sums by query_id and `by` of rows (term, n, in_path, in_head, by): words, matched, cov, path_terms, any_path, hyphens, signal_sum, and
    bound: what paths and headings can add at most."""
    few, own = F.least(F.col("n"), F.lit(4)), F.col("own")
    if_ = lambda c, x: F.sum(F.when(c, x).otherwise(0))
    bound = if_(F.col("in_path"), F.col("path_points")) + if_(F.col("in_head"), F.col("head_points")) + F.when(F.max(own & F.col("in_path")), 1200).otherwise(0)
    return counts.join(small(per_term), "term").groupBy("query_id", *by).agg(
        F.sum(F.when(F.col("is_term"), few * (F.lit(6.0) + F.lit(18.0) * F.col("idf"))).otherwise(0.0)).alias("words"), F.count_if("is_term").alias("matched"),
        reduce(Column.__add__, (F.bit_count(F.bit_or(m)) for m in per_term.columns if m.startswith("mask"))).alias("cov"), F.count_if(F.col("is_term") & F.col("in_path")).alias("path_terms"), F.max(own & F.col("in_path")).alias("any_path"), if_(F.col("hyphen") & (F.col("n") > 0), 500).alias("hyphens"), if_(F.col("signal"), few * 20).alias("signal_sum"),
        bound.alias("bound"),
    )


@dataclass
class Asked:
    """What a search knows of its questions before any document is scored: known, per_term, the terms as the index is asked (own), and sums by block at most."""

    known: DataFrame
    per_term: DataFrame
    own: I.Terms
    blocks: DataFrame
    terms: DataFrame


def _prepared(queries: DataFrame, index: I.Index, layers: DataFrame | None) -> Asked:
    rows = queries.where("query is not null")
    known = understood(rows, F.array().cast("array<string>")) if layers is None else understood(rows.join(F.broadcast(layers)), F.col("layers"))  # layers: a row
    known = materialised(known, "questions")
    asked = materialised(_asked(known), "asked")
    own = I.terms_of(asked, index)
    terms = materialised(I.term_blocks(own, index), "term-blocks")
    masks = -(-(known.agg(F.max(F.size("covered"))).first()[0] or 1) // 63)  # a number, whatever the questions
    per_term = materialised(_weighed(known, asked, _weights(asked, terms, index.total), max(1, masks)), "term-weights")
    most = terms.select("term", "block", F.col("top").alias("n"), (F.col("path_mask") != 0).alias("in_path"), (F.col("head_mask") != 0).alias("in_head"))
    return Asked(known, per_term, own, _sums(most, per_term, "block"), terms)


def _counted(asked: Asked, wanted: DataFrame | None, index: I.Index) -> DataFrame:
    """Sums by (block, slot) of the documents with a term in wanted blocks (query_id, block), or in all. All that is by block stays in its task."""
    if wanted is None:
        return _sums(I.block_counts(asked.own, None, index), asked.per_term, "block", "slot")
    blocks = materialised(wanted.groupBy("block").agg(F.collect_set("query_id").alias("_wanted")), "wanted-of-block")  # questions of a block
    counts = I.block_counts(asked.own, blocks.select("block"), index)
    sums = _sums(counts, asked.per_term, "block", "slot")
    return sums.join(small(blocks), "block").where(F.array_contains("_wanted", F.col("query_id"))).drop("_wanted")


def placed_rows(found: DataFrame, places: DataFrame, *columns: str) -> DataFrame:
    """found (block, slot, ...) with columns of places (block, slot, ...): they meet by block, so rows of a block stay in their task."""
    held = places.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct(*columns)))).alias("_held"))  # a block's documents
    rows = found.join(held, "block").withColumn("_held", F.try_element_at("_held", F.col("slot"))).where("_held is not null")
    return rows.select(*found.columns, *(F.col(f"_held.{c}").alias(c) for c in columns))


def scored_places(queries: DataFrame, docs: DataFrame, index: I.Index | None = None, k: int | None = None) -> DataFrame:
    """scored() by block and slot of the index instead of doc_id. Without k all pairs are there, none of which is shuffled."""
    index = index or temporary_index(docs)
    asked = _prepared(queries, index, None)
    facts = asked.known.select("query_id", F.size("covered").alias("n_terms"), "least")
    total = lambda rows: (rows["words"] + _coverage(rows["cov"], rows["n_terms"])).cast("bigint")

    def rows_of(wanted: DataFrame | None) -> DataFrame:
        limited = wanted is not None and "_limit" in wanted.columns
        limits = materialised(wanted.select("query_id", "_limit").distinct(), "limits-of-rest") if limited else None
        sums = _counted(asked, wanted, index).where("matched > 0 or cov > 0").join(small(facts), "query_id")
        rows = sums.select("query_id", "block", "slot", "matched", F.col("cov").alias("covered"), "n_terms", "least", total(sums).alias("score"))
        return rows.join(small(limits), "query_id").where("_limit is null or score >= _limit").drop("_limit") if limited else rows

    if not k:
        return rows_of(None)
    bounds = asked.blocks.where("matched > 0 or cov > 0").join(small(facts), "query_id")
    bounds = bounds.select("query_id", "block", (total(bounds) + 1).alias("most"))
    return _by_blocks(bounds, rows_of, lambda rows: _kth(rows, "score", k))


def scored(queries: DataFrame, docs: DataFrame, index: I.Index | None = None, k: int | None = None) -> DataFrame:
    """query_id, doc_id, matched, covered, n_terms, least, score by words only: term counts (4 at most) with their idf, and coverage.

    docs: doc_id, path, text, which are indexed unless an index of them is given; a term counts where the text or the path holds it. Only documents with a match
    are there. With k, of each question at least its first k by (score, doc_id): blocks that cannot reach the k-th score of the best ones are not counted."""
    index = index or temporary_index(docs)
    found = placed_rows(scored_places(queries, docs, index, k), index.pages, "doc_id")
    return found.select("query_id", "doc_id", "matched", "covered", "n_terms", "least", "score")


#: Questions that tasks may hold at once.
MOST_QUESTIONS = 20_000


def numbered(queries: DataFrame, *columns: str) -> list | None:
    """The rows of queries, whose places number them, or None if they are too many for a task."""
    rows = queries.select(*columns).limit(MOST_QUESTIONS + 1).collect()
    return rows if len(rows) <= MOST_QUESTIONS else None


def scanned(queries: DataFrame, docs: DataFrame, k: int | None = None, by: tuple[str, ...] = (), index: I.Index | None = None) -> DataFrame:
    """scored() without an index, with docs' columns besides path and text: tasks look up the terms in their own documents, once, and hand on which ones a document holds. From the
    frequencies follows what terms are worth, and tasks sum up a document for each question. With k a task hands on its first k by (score, doc_id) of each question
    (and each value of columns `by`), so what is shuffled grows with tasks, not with pairs. More terms or questions than a task may hold go by the index."""
    spark = docs.sparkSession
    known = materialised(understood(queries.where("query is not null"), F.array().cast("array<string>")), "questions")
    forms = F.transform("covered", lambda c: F.array_distinct(X.term_forms(c)))
    known = known.select("query_id", "terms", forms.alias("forms"), F.size("covered").alias("n_terms"), "least")
    terms = P.few_terms(known.select(F.explode(F.concat("terms", F.flatten("forms"))).alias("term")))
    asked = numbered(known, *known.columns)
    more = [c for c in docs.columns if c not in ("doc_id", "path", "text")]
    if terms is None or asked is None:
        index = index or temporary_index(docs.select("doc_id", "path", "text"))
        found = placed_rows(scored_places(queries, docs, index, None if by else k), index.pages, "doc_id")
        return (found.join(docs.select("doc_id", *more), "doc_id") if more else found).select("query_id", "doc_id", *more, "matched", "covered", "n_terms", "least", "score")
    rows = docs.where("doc_id is not null").select("doc_id", *more, *(F.lower(text_of(c)).alias(c) for c in ("text", "path")))
    lists = materialised(P.held_terms(rows, terms), "held-terms")
    total = lists.count()
    df = {r["term"]: r["df"] for r in lists.select(F.explode("held").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row a term
    idfs = spark.createDataFrame([(t, df.get(i, 0)) for i, t in enumerate(terms)], "term string, df bigint").select("term", idf(F.lit(total), F.col("df")).alias("idf"))
    weights = {r["term"]: 6.0 + 18.0 * r["idf"] for r in idfs.collect()}
    counts = [r["n_terms"] for r in asked]

    def score(columns, row, q, matched, words, covered):
        import numpy as np

        n = np.array(counts)[q]
        more_than_one = np.maximum(covered - 1, 0).astype(float)
        coverage = 220 * covered + 280 * more_than_one**2 + np.floor(1800 * (covered / np.maximum(n, 1))) + np.where((n >= 2) & (covered == n), 4200, 0)
        return (words + coverage).astype(np.int64)

    questions = P.Questions(terms, [(r["terms"], r["forms"]) for r in asked], weights)
    hits = P.question_hits(lists, questions, score, "bigint", k, ("doc_id",), by)
    facts = spark.createDataFrame([(i, r["query_id"], r["n_terms"], r["least"]) for i, r in enumerate(asked)], f"q int, query_id {known.schema['query_id'].dataType.simpleString()}, n_terms int, least int")
    return hits.join(F.broadcast(facts), "q").select("query_id", "doc_id", *more, "matched", "covered", "n_terms", "least", "score")


def matched_terms(terms: DataFrame, rows: DataFrame, score=None, kind: str = "double", k: int | None = None, order: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame | None:
    """query_id, matched (distinct terms of a question that a row's text holds), score and the other columns of rows (text, ...), for terms (query_id, term); None if tasks cannot hold
    these. Tasks count their own rows and nothing is shuffled. score, kind, k, order, by: see matching.question_hits(); without a score it is 0."""
    spark = rows.sparkSession
    asked = numbered(terms.where("term <> ''").groupBy("query_id").agg(F.collect_set("term").alias("terms")), "query_id", "terms")  # terms of a question
    few = P.few_terms(terms)
    if asked is None or few is None:
        return None
    lists = P.held_terms(rows.withColumns({"text": F.lower(text_of("text")), "path": F.lit("")}), few)
    hits = P.question_hits(lists, P.Questions(few, [(r["terms"], []) for r in asked]), score or _no_points, kind, k, order, by)
    names = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(asked)], f"q int, query_id {terms.schema['query_id'].dataType.simpleString()}")
    return hits.join(F.broadcast(names), "q").drop("q", "covered")


def _no_points(columns, row, q, matched, words, covered):
    return matched * 0.0


#: Blocks of a question that are counted first, and documents (times k) that are scored first, to learn what the others must reach.
FIRST_BLOCKS, FIRST_DOCUMENTS = 4, 4
#: Pairs of a question and a block up to which all are counted at once.
FEW_BLOCKS = 100_000


def _kth(rows: DataFrame, score: str, k: int) -> DataFrame:
    """query_id, _limit: the k-th score of each question that has so many rows: k documents reach it."""
    by = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score)))
    return rows.select("query_id", score).withColumn("_n", by).where(F.col("_n") == k).select("query_id", F.col(score).alias("_limit"))


def _by_blocks(bounds: DataFrame, rows_of, limit_of) -> DataFrame:
    """Rows of the blocks that can reach each question's limit. bounds: query_id, block, most and more; rows_of: wanted blocks to rows;
    limit_of: rows of the most promising blocks to query_id, _limit. Blocks below the limit go unread."""
    bounds = materialised(bounds, "block-bounds")
    if bounds.count() <= FEW_BLOCKS:
        return rows_of(bounds)
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "block"))
    ranked = materialised(bounds.withColumn("_n", at).where(F.col("_n") <= FIRST_BLOCKS).drop("_n"), "first-blocks")
    first = materialised(rows_of(ranked), "first-rows")
    limits = materialised(limit_of(first), "limits")
    rest = bounds.join(small(ranked.select("query_id", "block")), ["query_id", "block"], "left_anti").join(small(limits), "query_id", "left").where("_limit is null or most >= _limit")
    rest = materialised(rest, "wanted-blocks")
    return first.unionByName(rows_of(rest))


def temporary_index(docs: DataFrame) -> I.Index:
    """An index of docs in the shared scratch folder."""
    path = scratch_path(docs.sparkSession, "index")
    I.write_index(described(docs), path)
    return I.read_index(docs.sparkSession, path)


def _coverage(cov: Column, n: Column) -> Column:
    return 220 * cov + 280 * F.pow(F.greatest(cov - 1, F.lit(0)), F.lit(2)) + F.floor(1800 * (cov / F.greatest(F.lit(1), n))) + F.when((n >= 2) & (cov == n), 4200).otherwise(0)


def stored_index(docs: DataFrame, path: str) -> I.Index:
    """The index at path, made of docs (doc_id, path, text) if it is not there yet. It is written beside and then renamed, so it is there in whole or not at all."""
    spark = docs.sparkSession
    if not exists(spark, path):
        side = f"{path}.{uuid.uuid4().hex}"
        I.write_index(described(docs), side)
        if not renamed(spark, side, path):  # another run was faster
            deleted(spark, side)
    return I.read_index(spark, path)


def repository_hits(queries: DataFrame, docs: DataFrame, k: int = 5, deep: bool = False, graph: DataFrame | None = None, semantic: DataFrame | None = None, index: I.Index | None = None) -> DataFrame:
    """query_id, doc_id, path, score (whole), rank, matched, covered: the first k documents of each question.

    docs: doc_id, path (distinct), text; index: their stored index, without which one is made. graph: query_id, doc_id of documents that a named one
    links to or is linked from. semantic: query_id, doc_id, cos of the best vectors; they widen what is looked at and score only without a term match.
    Ties go to the lesser path. Questions without terms that do not ask for the latest find nothing, nor do null texts.
    """
    index = index or temporary_index(docs)
    return _first(materialised(scored_pairs(queries, index, k, deep, graph, semantic), "pairs"), docs, k)


def scored_pairs(queries: DataFrame, index: I.Index, k: int, deep: bool = False, graph: DataFrame | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """What repository_hits() scores: at least all pairs that can be among the first k."""
    pages = index.pages
    asked = _prepared(queries, index, pages.agg(F.collect_set("layer").alias("layers")))
    stems = _stem_counts(asked.known, pages)
    common = F.coalesce("common_stems", F.array().cast("array<string>"))
    known = asked.known.join(stems, "query_id", "left").withColumn("named", F.filter("maybe_named", lambda t: F.contains(t, F.lit("-")) | t.rlike(r"\d") | ~F.array_contains(common, t))).drop("maybe_named", "common_stems")
    heads = asked.per_term.where("is_term").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("idfs"))  # a question's terms
    points = F.transform("content", lambda t: F.struct(X.term_forms(t).alias("forms"), F.floor(F.lit(800.0) * F.coalesce(F.try_element_at("idfs", t), F.lit(1.0))).alias("points")))
    known = known.join(heads, "query_id", "left").withColumns({"content_points": points, "heading_terms": F.filter("heading_terms", lambda t: t != "")})
    known = materialised(known.drop("idfs", "query", "guesses", "content", "signals", "layers"), "named-questions")
    by_layer = known.where("latest or no_specific").select("query_id", F.explode("preferred").alias("layer"))
    lanes = index.blocks.select("block", "layer").join(small(by_layer), "layer").select("query_id", "block", F.lit(True).alias("lane"))
    bounds = asked.blocks.join(lanes, ["query_id", "block"], "full_outer").join(index.blocks, "block").join(small(known), "query_id").fillna(0, ["words", "matched", "cov", "hyphens", "signal_sum", "bound"]).fillna(False, ["lane"])
    full = (F.size("covered") >= 2) & (F.col("cov") == F.size("covered"))
    bounds = bounds.where((_free(deep) | full) & ((F.col("matched") >= F.col("least")) | F.col("lane")))
    bounds = bounds.select("query_id", "block", "lane", F.size("covered").alias("n_cov"), "least", _free(deep).alias("free"), _bonus().alias("bonus"), (_sum_points(F.size("covered")) + _bonus()).alias("most"))
    facts = ["lane", "n_cov", "least", "free", "bonus"]
    can = (F.col("free") | ((F.col("n_cov") >= 2) & (F.col("cov") == F.col("n_cov")))) & ((F.col("matched") >= F.col("least")) | F.col("lane"))
    none = {c: 0 for c in ("words", "matched", "cov", "hyphens", "signal_sum", "path_terms", "bound")} | {"any_path": False}

    def sums_of(wanted: DataFrame) -> DataFrame:
        """Sums of the documents of wanted blocks that can be among the first k, with `most`; where a question asks for a whole layer, of all its documents."""
        wanted = materialised(wanted, "wanted-blocks")
        limit = F.col("_limit") if "_limit" in wanted.columns else F.lit(None)
        every = pages.select("block", "slot").join(small(wanted.where("lane").select("query_id", "block")), "block").select("query_id", "block", "slot")
        sums = _counted(asked, wanted, index).join(every, ["query_id", "block", "slot"], "full_outer").fillna(none)
        rows = sums.join(small(wanted.select("query_id", "block", *facts, limit.cast("double").alias("_limit"))), ["query_id", "block"])
        rows = rows.where(can).withColumn("most", _sum_points(F.col("n_cov")) + F.col("bonus"))
        return rows.where("_limit is null or most >= _limit").drop("_limit", *facts)

    def score(sums: DataFrame) -> DataFrame:
        rows = sums.drop("most").join(pages, ["block", "slot"]).join(small(known), "query_id")
        rows = rows.join(graph.select("query_id", "doc_id", F.lit(True).alias("in_graph")), ["query_id", "doc_id"], "left") if graph is not None else rows.withColumn("in_graph", F.lit(False))
        rows = rows.join(semantic.select("query_id", "doc_id", "cos"), ["query_id", "doc_id"], "left") if semantic is not None else rows.withColumn("cos", F.lit(None).cast("double"))
        return _scored(rows.fillna(False, ["in_graph"]), deep)

    def limits(sums: DataFrame) -> DataFrame:
        return _kth(score(top_k(sums, FIRST_DOCUMENTS * k, F.desc("most"), F.asc("block"), F.asc("slot")).drop("rank")), "base", k)

    sums = materialised(_by_blocks(bounds, sums_of, limits), "sums")
    found = score(sums.join(small(materialised(limits(sums), "limits")), "query_id", "left").where("_limit is null or most >= _limit").drop("_limit"))
    named = [x.select("query_id", "doc_id") for x in (graph, semantic) if x is not None]
    if named:  # documents of these lanes are scored whatever their block can reach
        extra = materialised(reduce(DataFrame.unionByName, named).distinct().join(pages.select("doc_id", "block", "slot"), "doc_id").select("query_id", "block", "slot"), "lane-documents")
        own = _counted(asked, materialised(extra.select("query_id", "block").distinct(), "wanted-blocks"), index)
        found = found.unionByName(score(extra.join(own, ["query_id", "block", "slot"], "left").fillna(none))).dropDuplicates(["query_id", "doc_id"])
    return found


def _free(deep: bool) -> Column:
    """Whether the filters of _scored() may let a document of a block pass that does not have all that is to be covered."""
    return F.lit(deep) | (F.size("preferred") == 0) | F.col("latest") | F.array_contains("preferred", F.lower("layer")) | (F.col("relates") & (F.size("named") > 0))


def _sum_points(n_cov: Column) -> Column:
    """What terms can give to a document, or to one of a block, at most."""
    c = F.col
    return F.ceil(c("words")) + _coverage(c("cov"), n_cov) + c("hyphens") + c("signal_sum") + c("bound") + 1


def _bonus() -> Column:
    """What else any document of a block may get at most, phrases included."""
    c = F.col
    on = lambda cond, points: F.when(cond, points).otherwise(0)
    preferred = F.array_contains("preferred", F.lower("layer"))
    return (
        180 * F.size("phrases") + on(preferred, 72) + on(F.array_contains("preferred", c("layer")), 72) + on(preferred & c("latest"), 1400) + on(c("catalog") & c("primary_index"), 240) + on(c("relates") & c("primary_index") & preferred, 700)
        + on(c("latest") & c("primary_index") & preferred, 700) + on(c("latest") & c("period"), 800) + on(c("well_known"), 4) + on(c("latest") & preferred, F.greatest(c("day"), F.lit(0)))
    )


def _stem_counts(known: DataFrame, pages: DataFrame) -> DataFrame:
    """query_id, common_stems: terms that may be names but are in the file stems of more than three documents."""
    names = known.select("query_id", F.explode("maybe_named").alias("term"))
    stems = pages.select("doc_id", F.explode(F.array_distinct(I.tokens(F.col("stem")))).alias("word"))
    own = I.term_words(names.select("term").distinct(), stems.select("word").distinct().select(F.explode(I.gram_list(F.col("word"))).alias("gram"), "word"))
    many = stems.join(small(own), "word").groupBy("term").agg(F.count_distinct("doc_id").alias("docs")).where("docs > 3").select("term")
    return names.join(many, "term").groupBy("query_id").agg(F.collect_set("term").alias("common_stems"))


def _scored(rows: DataFrame, deep: bool) -> DataFrame:
    """Rows that the filters let through, with base: the score but for phrases."""
    n_cov, has = F.size("covered"), F.array_contains
    path, entity = F.col("low_path"), F.col("entity")
    full = (n_cov >= 2) & (F.col("cov") == n_cov)
    some = F.size("preferred") > 0
    preferred = has(F.col("preferred"), F.col("low_layer"))
    related = F.col("relates") & (F.size("named") > 0) & (entity | F.col("in_graph"))
    kept = F.lit(deep) | ~some | F.col("latest") | preferred | full | related
    dated = F.forall("date_terms", lambda t: F.contains(path, t) | F.exists("dates", lambda d: F.contains(d, t)))
    temporal = F.col("latest") & some & preferred
    candidate = (F.col("matched") >= F.col("least")) | temporal | (some & F.col("no_specific") & preferred) | F.col("cos").isNotNull() | F.col("in_graph")
    c = F.col
    named = F.size("named") > 0
    index, primary = c("index_like"), c("primary_index")
    on = lambda cond, points: F.when(cond, points).otherwise(0)
    bonus = (
        on(some & preferred, 72) + on(some & preferred & c("latest"), 1400) + on(c("catalog") & primary & ~c("compound"), 240) - on(c("catalog") & primary & c("compound"), 560) - on(index & ~primary, 600)
        + on(~c("catalog") & index, F.when(c("relates") & primary & preferred, 700).when(named, -2600).otherwise(-160)) - on(c("codex"), 220) - on(c("openly") & ~named & ~c("catalog") & index, 220)
        - on(c("asks") & ~some & ~c("catalog") & index, 2200) + on(c("latest") & primary & ~named & (F.size("date_terms") == 0) & preferred, 700) + on(c("latest") & ~named & (F.size("date_terms") == 0) & c("period"), 800)
    )
    anchored = (preferred & ~(index & named)) | (c("catalog") & index) | (c("openly") & ~named & ~index)
    heading = 420 * count_in(c("headings"), c("heading_terms")) + F.aggregate(F.filter("content_points", lambda x: any_in(c("headings"), x["forms"])), F.lit(0).cast("bigint"), lambda s, x: s + x["points"])
    long_name = F.filter("file_terms", lambda t: F.contains(c("name"), t) & ((F.length(t) >= 4) | ((F.length(t) >= 2) & Q.all_han(t))))
    anchors = F.filter("raw", lambda t: has(c("named"), t) & F.contains(path, t))
    base = (
        c("words") + _coverage(c("cov"), n_cov)
        + on(~index, c("signal_sum")) + on(c("in_graph"), 900) + on((c("matched") == 0) & c("cos").isNotNull(), F.floor(1800 * F.greatest(c("cos"), F.lit(0.0))))
        + on(c("any_path") & (preferred | (c("relates") & entity)), 3000 * F.size(anchors)) + c("hyphens") + 28 * c("path_terms") + on(c("any_path"), 260 * F.size(long_name)) + on(c("any_path") & has(c("file_terms"), c("stem")), 1200)
        + on(anchored & (c("headings") != ""), heading) + on(has(c("preferred"), c("layer")), 72) + bonus + on(c("well_known"), 4) + on(temporal, c("day"))
    )
    kept_rows = rows.where(kept & dated & candidate)
    return kept_rows.select("query_id", "doc_id", "path", "layer", "matched", F.col("cov").alias("covered"), "phrases", "relates", "latest", "date_terms", "named", "preferred", base.alias("base"))


def _first(scored: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The first k by the whole score. Phrases add 180 each: pairs that cannot reach the k-th base with all of theirs are left out before texts are read."""
    at = Window.partitionBy("query_id").orderBy(F.desc("base"), "path")
    limits = scored.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("base")).alias("reach"))
    near = materialised(scored.join(small(limits), "query_id").where("reach is null or cast(base + 180 * size(phrases) as bigint) >= cast(reach as bigint)"), "near-pairs")
    texts = docs.select("doc_id", F.lower("text").alias("low"))
    whole = texts.join(small(near), "doc_id").withColumn("score", (F.col("base") + 180 * count_in(F.coalesce("low", F.lit("")), F.col("phrases"))).cast("bigint"))
    return top_k(whole.drop("low", "base", "phrases"), k, F.desc("score"), F.asc("path"))


#: Terms that make no evidence window.
NOT_CITED = ("what", "latest", "recent", "source", "evidence", "citation", "model", "paper", "benchmark", "report", "note", "section")


def cited(hits: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """hits (query_id, doc_id, ...) with line_start, line_end, excerpt and support (see claim_support()); only texts of hits are read."""
    none = F.array().cast("array<string>")
    asked = materialised(understood(queries.where("query is not null"), none), "questions")
    window_terms = F.array_except(F.array_union("raw", "terms"), words_in(NOT_CITED))
    terms = asked.select("query_id", "terms", F.array_intersect("guesses", "terms").alias("carved"), F.when(F.size(window_terms) > 0, window_terms).otherwise(F.col("terms")).alias("window_terms"))
    texts = docs.select("doc_id", F.col("path").alias("_path"), F.col("text").alias("_text"))
    gone = unreachable_of(terms, docs) if terms.where("size(carved) > 0").head(1) else terms.select("query_id", F.array().cast("array<string>").alias("unreachable"))
    hits = materialised(hits, "hits")
    rows = small(hits).join(texts, "doc_id").join(small(terms), "query_id").join(gone, "query_id", "left").withColumn("_w", Q.evidence_window("_text", F.col("window_terms")))
    support = Q.claim_support(F.col("terms"), F.col("_w.excerpt"), F.col("_path"), F.col("_w.line_start"), F.col("unreachable"), F.array_except("terms", F.col("carved")), F.col("carved"))
    return rows.select(*hits.columns, F.col("_w.line_start").alias("line_start"), F.col("_w.line_end").alias("line_end"), F.col("_w.excerpt").alias("excerpt"), support.alias("support"))


def unreachable_of(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, unreachable: of the questions' carved terms, those that no document has."""
    guesses = terms.select("query_id", F.explode("carved").alias("term"))
    held = term_counts(guesses.select("term").distinct(), docs).select("term").distinct()
    return guesses.join(held, "term", "left_anti").groupBy("query_id").agg(F.collect_set("term").alias("unreachable"))  # terms of one question


def search(queries: DataFrame, docs: DataFrame, k: int = 5, index: I.Index | None = None, **lanes: DataFrame | None) -> DataFrame:
    """Ranked, cited answers: query_id, doc_id, path, rank, score, line_start, line_end, excerpt, coverage, claim_support, abstain.

    A negative question looks at nothing; a question abstains unless some excerpt carries all of it. Questions without hits have a row of nulls."""
    asked = queries.where(X.intent("query") != "negative")
    found = cited(repository_hits(asked, docs, k, index=index, **lanes).select("query_id", "doc_id", "path", "rank", "score"), asked, docs)
    rows = found.withColumns({"coverage": F.col("support.coverage"), "claim_support": F.col("support.claim_support")}).drop("support")
    direct = rows.groupBy("query_id").agg((F.count_if(F.col("claim_support") == "direct") == 0).alias("abstain"))
    return queries.select("query_id").join(rows, "query_id", "left").join(direct, "query_id", "left").withColumn("abstain", F.coalesce("abstain", F.lit(True)))


def anchored_first(hits: DataFrame) -> DataFrame:
    """Ranked hits (query_id, path, rank, relates, named, coverage) with the best path-anchored one of a relationship question at the front: new rank.

    Best: most names in the path, then coverage, then the greater path."""
    n = count_in(F.lower("path"), F.col("named"))
    order = Window.partitionBy("query_id").orderBy(F.desc("_n"), F.desc("coverage"), F.desc("path"))
    marked = hits.withColumn("_n", n).withColumn("_front", F.col("relates") & (F.col("_n") > 0) & (F.row_number().over(order) == 1))
    return marked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_front"), "rank"))).drop("_n", "_front")


def graph_candidates(known: DataFrame, docs: DataFrame, links: DataFrame) -> DataFrame:
    """query_id, doc_id: one hop, either way, over explicit links (path, target) from documents that hold a name of a relationship question.

    known: query_id, named; docs: doc_id, path, text."""
    names = known.select("query_id", F.explode("named").alias("term"))
    anchors = term_counts(names.select("term").distinct(), docs).join(small(names), "term").select("query_id", "doc_id").distinct()
    paths = docs.select("doc_id", "path")
    at = anchors.join(paths, "doc_id").select("query_id", "path")
    ahead = at.join(links, "path").select("query_id", F.col("target").alias("path"))
    behind = links.join(at.select("query_id", F.col("path").alias("target")), "target").select("query_id", "path")
    return ahead.union(behind).join(paths, "path").select("query_id", "doc_id").distinct()
