"""Indexing, ranking and evidence over documents, for a frame of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions import text as X
from mnemolake.operators.nearest import nearest

#: Rows and bytes of a side that may be broadcast; beyond either Spark shuffles both sides. A side whose files and plan Spark puts below SURELY_SMALL bytes needs no look.
MOST_BROADCAST_ROWS, MOST_BROADCAST_BYTES, SURELY_SMALL = 200_000, 64 << 20, 4 << 20


def small(df: DataFrame, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its size is bounded: by Spark's statistics of the files below it, or by one bounded job that finds
    `most` rows and MOST_BROADCAST_BYTES bytes (as JSON text) at most."""
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= SURELY_SMALL:
        return F.broadcast(df)
    size = df.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if size["n"] <= most and size["b"] <= MOST_BROADCAST_BYTES else df


def runs_of_three(items: Column, between: str) -> Column:
    """Each three neighbours of an array, joined; the array is made once, not for each run."""
    rest = lambda k: F.slice(items, k, F.greatest(F.size(items) - k + 1, F.lit(0)))
    join = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(between), b))
    return F.array_compact(F.zip_with(F.zip_with(items, rest(2), join), rest(3), join))


def against_all(queries: DataFrame, rows: DataFrame, key: str, condition: Column, block_rows: int = 4096) -> DataFrame:
    """A stated query set against all rows, in blocks of about `block_rows` queries, each small enough to be broadcast."""
    n = -(-queries.count() // block_rows) or 1
    blocks = [queries if n == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]
    out = None
    for block in blocks:
        met = rows.join(F.broadcast(block), condition)
        out = met if out is None else out.unionByName(met)
    return out


def trigram_postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """gram, key: the distinct character trigrams of folded texts."""
    grams = F.array_distinct(runs_of_three(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), ""), lambda c: c != ""), ""))
    return docs.select(key, F.explode(grams).alias("gram"))


def term_postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, tf of every text's words."""
    return docs.select(key, F.explode(X.words(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(postings: DataFrame, key: str = "doc_id") -> DataFrame:
    return postings.groupBy("term").agg(F.count_distinct(key).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(1.0), F.log((n + 1) / (df + 1)))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: each question's distinct words."""
    return queries.select("query_id", F.explode(F.array_distinct(X.words("query"))).alias("term"))


def top_k(hits: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first k of each `by`, with rank; Spark limits groups before it shuffles them."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def citation_line(text: Column, needle: Column) -> Column:
    """1-based line on which needle begins in text; null if it is not there."""
    at = F.locate(needle, text) if isinstance(needle, str) else F.call_function("locate", needle, text)
    before = F.substring(text, F.lit(1), at - 1)
    return F.when(at > 0, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1)


def split_verified(results: DataFrame) -> DataFrame:
    """First occurrence of each (query_id, id) by pos, with lane: verified or candidate."""
    first = results.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("pos"))).where("_n = 1").drop("_n")
    bad = F.col("status").isin("stale", "candidate", "pending", "inferred", "generated")
    return first.withColumn("lane", F.when(F.col("valid") & ~bad, "verified").otherwise("candidate"))


def diversified(hits: DataFrame, by: str, layer: str, pos: str) -> DataFrame:
    """The best hit of each layer first, then the rest, in order; new column place."""
    ranked = hits.withColumn("_n", F.row_number().over(Window.partitionBy(by, layer).orderBy(pos)))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.col("_n") > 1, pos))).drop("_n")


def interleaved(hits: DataFrame, by: str, bucket: str, pos: str) -> DataFrame:
    """Round robin over buckets; new column place."""
    ranked = hits.withColumn("_n", F.row_number().over(Window.partitionBy(by, bucket).orderBy(pos)))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("_n", bucket, pos))).drop("_n")


def neighbours(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """One hop both ways: node, neighbour, distinct, without loops."""
    out = edges.select(F.col(src).alias("node"), F.col(dst).alias("neighbour"))
    back = edges.select(F.col(dst).alias("node"), F.col(src).alias("neighbour"))
    return out.union(back).where("node <> neighbour").distinct()


def resolved_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """path, target, resolved: the raw target if it is a known path, else the one beside the linking document, else null."""
    beside = F.concat(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), F.col("target"))
    k1, k2 = known.select(F.col("path").alias("_a")), known.select(F.col("path").alias("_b"))
    joined = links.join(k1, F.col("target") == F.col("_a"), "left").join(k2, beside == F.col("_b"), "left")
    return joined.select("path", "target", F.coalesce("_a", "_b").alias("resolved"))


def content_revision(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """revision of a corpus: a digest over the sorted (path, content digest) pairs, folded in levels of 256, so that no row holds the
    corpus: four levels are enough for 10^11 documents with some thousand pairs a row."""
    path = F.sha2(F.col(key).cast("string").cast("binary"), 256)
    nodes = docs.select(F.substring(path, 1, 8).alias("b"), F.col(key).cast("string").alias("k"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("h"))
    for level in (6, 4, 2, 0):
        lists = nodes.groupBy(F.substring("b", 1, level).alias("b")).agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("l"))
        joined = F.array_join(F.transform("l", lambda x: F.concat(x["k"], F.lit("\0"), x["h"], F.lit("\0"))), "")
        nodes = lists.select("b", F.col("b").alias("k"), F.sha2(joined.cast("binary"), 256).alias("h"))
    return nodes.select(F.concat(F.lit("content-"), F.substring("h", 1, 24)).alias("revision"))


def href_paths(html: Column | str) -> Column:
    """Distinct local targets of href attributes, without fragment and query."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")), F.lit(r'href="(/[^"#?]*)"'), F.lit(1)))


def link_counts(links: DataFrame, key: str) -> DataFrame:
    """target, pages, first_page of links (key, target)."""
    return links.groupBy("target").agg(F.count("*").alias("pages"), F.min(key).alias("first_page"))


def document_vectors(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """doc_id, path, vector of documents (doc_id, path) that have one (path, vector)."""
    return docs.select("doc_id", "path").join(vectors.select("path", "vector"), "path").select("doc_id", "path", "vector")


def semantic_candidates(queries: DataFrame, docs: DataFrame, vectors: DataFrame, most: int = 64, floor: float = 0.2) -> DataFrame:
    """query_id, doc_id, cos of the documents whose vectors are nearest to each question's (query_id, vector): 64 at most, with a cosine of .2."""
    found = nearest(queries, document_vectors(docs, vectors).select(F.col("doc_id").alias("id"), "vector"), most, floor)
    return found.select("query_id", F.col("id").alias("doc_id"), "cos")


def mmr(candidates: DataFrame, k: int, weight: float = 0.82, pool: int | None = None) -> DataFrame:
    """query_id, id, pick: maximal marginal relevance over the best `pool` (default max(20, 8k)) of each query.

    weight * relevance - (1 - weight) * greatest cosine to those chosen; ties go to the smaller id. The pool bounds a group."""
    import numpy as np
    import pandas as pd

    best = top_k(candidates, pool or max(20, 8 * k), F.desc("relevance"), F.asc("id"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["relevance", "id"], ascending=[False, True])
        vectors = np.stack(pdf["vector"].map(lambda v: np.asarray(v, float)).tolist())
        relevance, ids = pdf["relevance"].to_numpy(float), pdf["id"].to_numpy()
        near, left, picked = np.zeros(len(ids)), list(range(len(ids))), []
        while left and len(picked) < k:
            gain = weight * relevance[left] - (1 - weight) * near[left]
            at = min(range(len(left)), key=lambda i: (-gain[i], ids[left[i]]))
            one = left.pop(at)
            picked.append(one)
            near = np.maximum(near, np.clip(vectors @ vectors[one], -1, 1)) if len(picked) > 1 else np.clip(vectors @ vectors[one], -1, 1)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "id": ids[picked], "pick": range(1, len(picked) + 1)})

    kinds = {c: best.schema[c].dataType.simpleString() for c in ("query_id", "id")}
    return best.groupBy("query_id").applyInPandas(choose, f"query_id {kinds['query_id']}, id {kinds['id']}, pick int")
