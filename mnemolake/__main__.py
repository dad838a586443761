"""Command line: python -m mnemolake OPERATION --root FOLDER [--query TEXT] ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from mnemolake import api

OPERATIONS = ("doctor", "sync", "search", "get", "timeline", "observe", "reflect", "context")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="mnemolake")
    out.add_argument("operation", choices=OPERATIONS)
    out.add_argument("--root", required=True, help="folder with the tables")
    out.add_argument("--query", action="append", default=[])
    out.add_argument("--session")
    out.add_argument("--id", type=int, action="append", default=[])
    out.add_argument("--limit", type=int, default=5)
    out.add_argument("--index", help="folder of indexes, for sync")
    out.add_argument("--source", default="source")
    out.add_argument("--commit", default="unknown")
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    memory = api.open_tables(spark, args.root)
    queries = spark.createDataFrame(list(enumerate(args.query)), "query_id bigint, query string")
    if args.operation == "doctor":
        return api.doctor(memory)
    if args.operation == "sync":
        return {"index": api.sync(memory, args.index, args.source, args.commit)}
    if args.operation == "search":
        return api.search(memory, queries, args.limit)
    if args.operation == "get":
        return {"documents": api.get(memory, spark.createDataFrame([(i, None, None) for i in args.id], "doc_id bigint, line_start int, line_end int"))}
    if args.operation == "timeline":
        return {"events": api.timeline(memory, args.session, args.limit)}
    if args.operation == "observe":
        return {"events": api.observe(memory, args.session, args.limit)}
    if args.operation == "reflect":
        return {"reflections": api.reflect(memory, queries, args.limit)}
    return {"context": api.context(memory, queries, args.limit)}


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("mnemolake").getOrCreate()
    for name, rows in run(spark, args).items():
        for row in rows.toJSON().toLocalIterator():
            print(json.dumps({name: json.loads(row)}, ensure_ascii=False))


if __name__ == "__main__":
    main()
