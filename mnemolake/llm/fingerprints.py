"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch keeps the k smallest of a set's hashes. The sketch of a union is made from the sketches of
its parts, so sketches of partial data merge. From sketches come estimates of resemblance (Jaccard),
containment and the number of distinct shingles; a set of fewer than k shingles is kept whole, and
then they are exact.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import free_name, resident, small_batches
from mnemolake.llm.shingles import shingle_hashes, word_hashes

SKETCH_SIZE = 256
SHINGLE_WORDS = 5
#: Hashes are cut to so many bits: at 10^11 distinct shingles the k-th smallest still has 19 of them.
HASH_BITS = 48


def sketch(text: bytes | None, k: int = SKETCH_SIZE, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The k smallest hashes of a text's distinct shingles, ascending; none for a text without words."""
    hashes = shingle_hashes(word_hashes(text), words) >> np.uint64(64 - HASH_BITS)
    return np.unique(hashes[: k + 8])[:k]


def merged(a: np.ndarray, b: np.ndarray, k: int = SKETCH_SIZE) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = SKETCH_SIZE) -> float:
    """Jaccard likeness of the sets behind two sketches; 1.0 for two empty sets."""
    union = merged(a, b, k)
    if not len(union):
        return 1.0
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(common, union[-1], "right") / len(union))


def distinct(a: np.ndarray, k: int = SKETCH_SIZE) -> float:
    """Number of distinct shingles behind a sketch."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2**HASH_BITS)


def containment(a: np.ndarray, b: np.ndarray, k: int = SKETCH_SIZE) -> float:
    """Share of a's shingles that b has; 1.0 for an empty a."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merged(a, b, k), k) / distinct(a, k))


def encoded(a: np.ndarray) -> str:
    """Base64 of the hashes, 6 bytes each, most significant first."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode("ascii")


def decoded(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def fingerprint_documents(docs: DataFrame, k: int = SKETCH_SIZE, words: int = SHINGLE_WORDS) -> DataFrame:
    """docs' doc_id with fingerprint (string) and n_shingles (estimate). Null and empty texts have an empty fingerprint."""

    def made(batches):
        for batch in batches:
            found = [sketch(t.as_py(), k, words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoded(x) for x in found], pa.string()), pa.array([distinct(x, k) for x in found], pa.float64())], names=["doc_id", "fingerprint", "n_shingles"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(made, "doc_id bigint, fingerprint string, n_shingles double")


def _real_borders(ids: DataFrame, rough: list[int], lowest: int) -> list[int]:
    """The least doc_id at or above each rough border, without the lowest of all: one pass, a row for each border and task."""
    edges = np.array(rough, np.int64)

    def least(batches):
        found, seen = np.full(len(edges) + 1, 2**63 - 1, np.int64), np.zeros(len(edges) + 1, bool)
        for batch in batches:
            values = np.asarray(batch.column(0).drop_null(), np.int64)
            part = np.searchsorted(edges, values, "right")
            np.minimum.at(found, part, values)
            seen[part] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen)), pa.array(found[seen])], names=["part", "doc_id"])

    rows = ids.mapInArrow(least, "part bigint, doc_id bigint").groupBy("part").agg(F.min("doc_id").alias("doc_id")).collect()
    return sorted({r["doc_id"] for r in rows} - {lowest})


def with_successors(docs: DataFrame, partitions: int | None = None) -> tuple[DataFrame, int]:
    """docs (doc_id, text as binary) dealt into ranges of doc_id in one shuffle, each range with the first
    document of the next one behind it (after the last range: the first of all).

    Range borders are values of doc_id, from a quantile sketch of that column alone (whose doubles are only
    rough borders, each snapped to the least id from there on); the document at a border goes to the range before it as well. Columns: part, follows (0 own, 1 of the next range), doc_id, text;
    partitions hold whole ranges and are sorted by these columns.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    lowest, nulls = ids.agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    probabilities = [i / n for i in range(1, n)]
    rough = sorted({min(int(x), 2**63 - 1) for x in ids.approxQuantile("doc_id", probabilities, 1 / (8 * n))}) if lowest is not None and n > 1 else []
    borders = _real_borders(ids, rough, lowest) if rough else []
    first, last, edges = None if nulls else lowest, len(borders), np.array(borders, np.int64)

    def deal(batches):
        for batch in batches:
            key, gone = batch.column(0), np.asarray(batch.column(0).is_null())
            values = np.asarray(key.fill_null(0))
            part = np.where(gone, 0, np.searchsorted(edges, values, "right")).astype(np.int32)
            again = np.flatnonzero(~gone & np.isin(values, edges))
            wraps = np.flatnonzero(gone if first is None else ~gone & (values == first))
            rows = np.concatenate([np.arange(len(values)), again, wraps])
            to = np.concatenate([part, part[again] - 1, np.full(len(wraps), last)]).astype(np.int32)
            follows = np.repeat([0, 1, 2], [len(values), len(again), len(wraps)]).astype(np.int8)
            for at in range(0, len(rows), 2048):
                own = pa.array(rows[at : at + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(to[at : at + 2048]), pa.array(follows[at : at + 2048]), key.take(own), batch.column(1).take(own)], names=["part", "follows", "doc_id", "text"])

    dealt = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(deal, "part int, follows byte, doc_id bigint, text binary")
    return dealt.repartitionById(last + 1, F.col("part")).sortWithinPartitions("part", "follows", "doc_id", "text"), last + 1


def edited_fingerprints(docs: DataFrame, k: int = SKETCH_SIZE, words: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, whose last floor(n_chars / 2) code points are
    those at the start of the next document (ascending doc_id, null ids first, ties by text; after the last, the first).

    Null texts are empty; repeated rows follow each other; an empty table gives no rows; other columns are ignored.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compare(batches):
        resident()
        held, rows = None, []  # held: the document whose successor is to come

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows.clear()
            return made

        for batch in batches:
            for part, follows, key, data in zip(*batch.columns, strict=True):
                raw = data.as_py() or b""
                text, own = raw.decode("utf-8"), sketch(raw, k, words)
                if held is not None and held[0] == part.as_py():
                    half = len(held[2]) // 2
                    edited = (held[2][: len(held[2]) - half] + text[:half]).encode("utf-8")
                    changed = sketch(edited, k, words)
                    rows.append((held[1], len(held[2]), hashlib.sha256(edited).hexdigest(), encoded(held[3]), encoded(changed), resemblance(held[3], changed, k), resemblance(held[3], own, k)))
                held = (part.as_py(), key.as_py(), text, own) if not follows.as_py() else None
                if len(rows) >= 1024:
                    yield out()
        if rows:
            yield out()

    small_batches(docs.sparkSession)
    ranges, _ = with_successors(docs)
    return ranges.mapInArrow(compare, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


#: Groups whose sketches a task merges before it hands them on.
HELD_GROUPS = 4096


def merge_fingerprints(sketches: DataFrame, by: str, k: int = SKETCH_SIZE) -> DataFrame:
    """`by`, fingerprint, n_shingles: the sketch of the union of each group's sets, from fingerprints of their parts (columns `by` and fingerprint).

    Tasks merge what they hold of a group; of what is left, distinct hashes are ranked by group, and Spark limits groups to k before the shuffle, so a
    group of any size, be it a third of all rows, hands on k hashes a task. Null and empty fingerprints add nothing: a group of such only has an
    empty one. A null `by` is a group; an empty table gives no rows; other columns are ignored."""
    kind = sketches.schema[by].dataType.simpleString()
    small_batches(sketches.sparkSession)

    def rows(held: dict):
        groups, sizes, hashes = [], [], []
        for group, a in held.items():
            groups.append(group)
            sizes.append(len(a) or 1)
            hashes.append(pa.array(a.astype(np.int64)) if len(a) else pa.nulls(1, pa.int64()))
        names = pa.array(groups, out_type.field("g").type).take(pa.array(np.repeat(np.arange(len(groups)), sizes)))
        return pa.RecordBatch.from_arrays([names, pa.concat_arrays(hashes)], names=["g", "hash"])

    def parts(batches):
        resident()
        held: dict = {}
        for batch in batches:
            for group, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = decoded(text or "")
                before = held.get(group)
                held[group] = own[:k] if before is None else merged(before, own, k)
                if len(held) >= HELD_GROUPS:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    out_type = pa.schema([("g", _arrow_type(sketches, by)), ("hash", pa.int64())])
    found = sketches.select(F.col(f"`{by}`").alias("g"), F.col("fingerprint").cast("string")).mapInArrow(parts, f"g {kind}, hash bigint").distinct()
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(F.asc_nulls_last("hash")))).where(F.col("n") <= k)
    lists = first.groupBy("g").agg(F.sort_array(F.collect_list("hash")).alias("hashes"))  # k at most

    def made(batches):
        resident()
        for batch in batches:
            own = [np.array(x, np.uint64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoded(a) for a in own], pa.string()), pa.array([distinct(a, k) for a in own], pa.float64())], names=["g", "fingerprint", "n_shingles"])

    return lists.mapInArrow(made, f"g {kind}, fingerprint string, n_shingles double").withColumnRenamed("g", by)


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def compare_fingerprints(pairs: DataFrame, a: str = "a", b: str = "b", k: int = SKETCH_SIZE) -> DataFrame:
    """pairs (two columns of fingerprints, and others) with resemblance, a_in_b, b_in_a (containment), a_shingles and b_shingles behind its own columns;
    clashing names get an underscore in front. Null fingerprints count as empty: two empty sets are alike and hold each other."""
    small_batches(pairs.sparkSession)
    added = [free_name(pairs.columns, x) for x in ("resemblance", "a_in_b", "b_in_a", "a_shingles", "b_shingles")]
    schema = pairs.select("*", *(F.lit(0.0).alias(x) for x in added)).schema
    names, at = [*pairs.columns, *added], [pairs.columns.index(x) for x in (a, b)]

    def compared(batches):
        resident()
        for batch in batches:
            both = [(decoded(x or ""), decoded(y or "")) for x, y in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            found = [(resemblance(x, y, k), containment(x, y, k), containment(y, x, k), distinct(x, k), distinct(y, k)) for x, y in both]
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in range(len(added))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    return pairs.mapInArrow(compared, schema)
