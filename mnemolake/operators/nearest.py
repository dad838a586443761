"""Exact vector search by matrix blocks: Arrow batches of rows times blocks of questions, with a bounded number of hits a question and task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Questions of a block, which a broadcast holds as a matrix, and the floats that a block and a product of it may have.
BLOCK_ROWS, BLOCK_FLOATS = 4096, 1 << 22
#: Digits after the point to which likeness is compared.
DIGITS = 9


def blocks_of(queries: DataFrame):
    """(ids, vectors) of the questions (query_id, vector), block by block; one is on the driver at a time."""
    n, widest = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = max(1, -(-n // BLOCK_ROWS), -(-n * max(1, widest or 1) * 2 // BLOCK_FLOATS))
    for k in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        if rows := own.select("query_id", "vector").collect():  # about BLOCK_ROWS rows and BLOCK_FLOATS floats
            yield [r["query_id"] for r in rows], [np.asarray(r["vector"] or [], np.float64) for r in rows]


def matrices_of(ids: list, vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width: places of the questions, and their vectors as columns."""
    widths: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        widths.setdefault(len(v), []).append(i)
    return {w: (np.array(at), np.stack([vectors[i] for i in at], axis=1)) for w, at in widths.items() if w}


def products_of(batch: pa.RecordBatch, column: int, n: int, matrices: dict):
    """(first row, cosines) of parts of a batch: rows times questions, 0 where widths differ or vectors are null or empty, held within [-1, 1]."""
    lists = batch.column(column)
    lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    lengths[np.asarray(lists.is_null())] = 0
    starts, flat = lists.offsets.to_numpy()[:-1].astype(np.int64), lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    step = max(1, BLOCK_FLOATS // max(1, n))
    for at in range(0, len(lengths), step):
        out = np.zeros((min(step, len(lengths) - at), n))
        for width, (places, matrix) in matrices.items():
            rows = np.flatnonzero(lengths[at : at + step] == width)
            if len(rows):
                own = flat[(starts[at + rows, None] + np.arange(width)).ravel()].reshape(len(rows), width)
                out[np.ix_(rows, places)] = np.clip(own @ matrix, -1.0, 1.0)
        yield at, out


def _mapped(queries: DataFrame, rows: DataFrame, body: Callable, schema: str) -> DataFrame:
    """A union over blocks of questions of body(batches, ids, matrices), run in the tasks that hold the rows (id, vector)."""
    spark = rows.sparkSession
    narrow = rows.select("id", "vector")
    out = None
    for ids, vectors in blocks_of(queries):
        shared = spark.sparkContext.broadcast((ids, matrices_of(ids, vectors)))

        def task(batches, shared=shared):
            yield from body(batches, *shared.value)

        found = narrow.mapInArrow(task, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _kinds(queries: DataFrame, rows: DataFrame) -> tuple[str, str]:
    return queries.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()


def nearest(queries: DataFrame, rows: DataFrame, k: int, floor: float | None = None, but_itself: bool = False) -> DataFrame:
    """query_id, id, cos, rank: of each question (query_id, vector) the k rows (id, vector) of the greatest cosine, all rows looked at.

    Vectors are of unit length; where widths differ, or one is null or empty, the cosine is 0. Cosines are compared to DIGITS digits, ties go to
    the lesser id. A task hands on k rows a question at most. but_itself: rows with the question's id don't count; floor: least cosine."""
    q_kind, id_kind = _kinds(queries, rows)

    def body(batches, ids, matrices):
        kept = None  # question, rounded cosine, cosine, id
        least = np.full(len(ids), -2.0)
        own_ids = np.array([str(x) for x in ids])

        def reduced(parts):
            q, near, cos, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((at, -near, q))
            q, near, cos, at = q[order], near[order], cos[order], at[order]
            first = np.searchsorted(q, q)
            keep = np.arange(len(q)) - first < k
            q, near, cos, at = q[keep], near[keep], cos[keep], at[keep]
            full, counts = np.unique(q, return_counts=True)
            ends = np.cumsum(counts) - 1
            least[full[counts == k]] = near[ends[counts == k]]
            return q, near, cos, at

        for batch in batches:
            names = np.array(batch.column(0).to_pylist())
            for at, cos in products_of(batch, 1, len(ids), matrices):
                near = np.round(cos, DIGITS)
                hit = near >= least
                if floor is not None:
                    hit &= cos >= floor
                if but_itself:
                    hit &= names[at : at + len(cos)].astype(str)[:, None] != own_ids
                r, q = np.nonzero(hit)
                if len(r):
                    found = (q, near[r, q], cos[r, q], names[at + r])
                    kept = reduced([found] if kept is None else [kept, found])
        if kept is not None:
            q, _, cos, at = kept
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q]), pa.array(at.tolist()), pa.array(cos)], names=["query_id", "id", "cos"])

    found = _mapped(queries, rows, body, f"query_id {q_kind}, id {id_kind}, cos double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("cos", DIGITS)), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def count_near(queries: DataFrame, rows: DataFrame, floor: float, but_itself: bool = False) -> DataFrame:
    """query_id, near: rows with a cosine of `floor` or more to each question that has any; a task hands on a number a question."""

    def body(batches, ids, matrices):
        total = np.zeros(len(ids), np.int64)
        own_ids = np.array([str(x) for x in ids])
        for batch in batches:
            names = np.array(batch.column(0).to_pylist()).astype(str)
            for at, cos in products_of(batch, 1, len(ids), matrices):
                hit = cos >= floor
                if but_itself:
                    hit &= names[at : at + len(cos), None] != own_ids
                total += hit.sum(axis=0)
        if len(some := np.flatnonzero(total)):
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in some]), pa.array(total[some])], names=["query_id", "near"])

    return _mapped(queries, rows, body, f"query_id {_kinds(queries, rows)[0]}, near bigint").groupBy("query_id").agg(F.sum("near").alias("near"))


def cosines(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, id, cos of every question and every row: for rows of a bounded number, such as the newest ones."""
    q_kind, id_kind = _kinds(queries, rows)

    def body(batches, ids, matrices):
        questions = pa.array(ids)
        for batch in batches:
            for at, cos in products_of(batch, 1, len(ids), matrices):
                n = len(cos)
                yield pa.RecordBatch.from_arrays(
                    [questions.take(pa.array(np.tile(np.arange(len(ids)), n))), batch.column(0).take(pa.array(np.repeat(np.arange(at, at + n), len(ids)))), pa.array(cos.ravel())], names=["query_id", "id", "cos"]
                )

    return _mapped(queries, rows, body, f"query_id {q_kind}, id {id_kind}, cos double")
