from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as pipeline
from mnemolake.llm import decontamination, secret_scan
from mnemolake.llm.common import written


def test_stages_on_supplied_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    assert decontamination.scan_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("size(hit_words) > 0").count() == 0
    assert secret_scan.scan_secrets(docs).where("size(spans) > 0").count() == 0
    packed = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == before


SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("rejected", pa.string()), ("spans", pa.int32())])


@pytest.mark.parametrize("rows", [
    [],
    [(1, None, None, None, None, None, None), (1, None, None, None, None, None, None), (None, "", "en", "s", 0, "x", 1)],
    [(i, "the quick brown fox jumps over the lazy dog and runs", "en", "s", 52, "x", 1) for i in range(4)] + [(9, "the quick brown fox " * 6_000, "en", "s", 120_000, "x", 1), (9, "the quick brown fox " * 6_000, "en", "s", 120_000, "x", 1), (10, "12 34", None, None, 5, None, None)],
])
def test_odd_tables(spark, tmp_path, rows):
    pq.write_table(pa.Table.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in rows], SCHEMA), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": pa.array([None], pa.string())}), tmp_path / "benchmark.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    if len(rows) > 5:
        assert {r["doc_id"] for r in got} == {0, 9}
    else:
        assert got == []
