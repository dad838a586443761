"""Training-data pipeline over `documents`: language, near duplicates, benchmark passages, secrets, packing.

A stage takes (spark, docs, sf_dir) and returns a frame with the columns of docs, the last one packed sequences. What a stage decides takes
effect: documents that language identification rejects go, one document of each near-duplicate group stays,
benchmark passages are cut out (a document that is mostly passages goes), secrets are redacted.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm import decontamination, language_id, ngram_join, packing, secret_scan
from mnemolake.llm.common import discard, free_name, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a cross-entropy within the calibrated limit. Null and empty texts and texts without letters go;
    equal rows have equal results; without any labelled text, and of an empty table, nothing stays."""
    model = language_id.fitted(language_id.labelled_sample(docs))
    rejected = free_name(docs.columns, "rejected")
    found = language_id.identify(docs, model)
    return found.where(~F.col(rejected)).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles with a likeness of 0.8 or more, the first by (doc_id, text), null ids
    last; of equal rows one stays. Texts without words, null and empty ones, are in no group and all stay; an empty table stays empty."""
    return ngram_join.keep_one(docs, words=5, num=8, den=10)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 10-word passages of `benchmark`; null and empty texts stay, and with an empty benchmark all do."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by [REDACTED]; null and empty texts stay as they are, equal rows stay equal, no row goes."""
    return secret_scan.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), "lead", 1)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can express neither the language models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(before)  # the stage's own table; the input is not one
    return STAGES[-1][1](spark, docs, sf_dir)
