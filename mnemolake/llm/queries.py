"""Queries of the training-data operators, by the names that the driver runs."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm import chat_format, collocations, decontamination, divergence, fingerprints, language_id, mixing, ngram_join, packing, secret_scan, sharding, token_output, url_filter
from mnemolake.llm.common import table
from mnemolake.llm.oracles import ORACLES

CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    events = rows.unionByName(planted).select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("event"), "role", "text")
    parts = chat_format.read_back(chat_format.format_conversations(events))
    digests = parts.select(
        "conv_id", "part", F.size("turns").alias("n"), F.length("formatted").alias("chars"),
        F.array_join(F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "").alias("said"), F.array_join("loss_texts", "").alias("loss"),
    )
    whole = digests.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("part", "said", "loss"))).alias("p"))
    said, loss = F.array_join(F.col("p.said"), ""), F.array_join(F.col("p.loss"), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts, domains and pages at hand, dealt by digests: stands in for list files, which the tables lack."""
    host = url_filter.host_of(F.col("url"))
    domains = pages.select(F.explode(url_filter.domain_keys(host)).alias("key")).where("key <> ''").distinct().select(F.lit("domain").alias("kind"), "key")
    urls = pages.select(url_filter.page_of(F.col("url")).alias("key")).where("key <> ''").distinct().select(F.lit("url").alias("kind"), "key")
    sums = domains.union(urls).withColumn("h", F.conv(F.substring(F.md5(F.concat_ws(":", "kind", "key").cast("binary")), 1, 7), 16, 10).cast("bigint"))
    listed = sums.where("h % 3 <> 0").withColumns({"list": F.concat(F.lit("list"), (F.col("h") % 5).cast("string")), "verdict": F.when(F.col("h") % 5 == 4, "allow").otherwise("block")})
    day = lambda n: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast({n} as int))")
    added = listed.select("list", "kind", "key", "verdict", F.lit("add").alias("action"), day("(h div 7) % 200").alias("at"))
    removed = listed.where("h % 2 = 0").select("list", "kind", "key", "verdict", F.lit("remove").alias("action"), day("(h div 7) % 200 + 60").alias("at"))
    again = listed.where("h % 4 = 0").select("list", "kind", "key", "verdict", F.lit("add").alias("action"), day("(h div 7) % 200 + 120").alias("at"))
    return added.union(removed).union(again)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of `pages` as a capture fetched on day page_id mod 366 of 2024."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(page_id % 366 as int))"))
    found = url_filter.filter_urls(captures, list_entries(pages))
    return found.select("page_id", "host", F.array_join("lists", ",").alias("lists"), "blocked")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan_secrets(docs)
    base = F.filter("spans", lambda s: s["ord"] < len(secret_scan.BASE))
    of = lambda k: F.filter("spans", lambda s: s["ord"] == k)
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{r.kind}") for k, r in enumerate(secret_scan.BASE)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(base).cast("binary"), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.scan_documents(docs, table(spark, sf_dir, "benchmark"))
    hits = F.size("hit_words").cast("bigint")
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), "lead", 1)
    return packed.select("doc_id", "start", "length", F.crc32("input_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    blocks = token_output.write_token_blocks(docs, public_tokenizers.path("word_bpe_49k.json"), "drop", 2)
    return token_output.read_token_blocks(blocks).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_id.fitted(language_id.labelled_sample(docs.where(~held_out)))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_char", "rejected")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
