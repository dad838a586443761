"""Seams for what runs outside Spark: adapter commands, reviewers, vector providers, and the protocols that backends follow."""

from __future__ import annotations

import json
import subprocess
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Limits of a call.
REVIEW_SECONDS, ADAPTER_SECONDS = 120, 60
BATCH_TEXTS, TEXT_CHARS = 10, 6000
DECISIONS = ("accept", "hold", "reject")
OPERATIONS = ("doctor", "sync", "search", "get", "timeline", "observe", "reflect")


class AdapterSource(DataSource):
    """spark.read.format("adapter"): results of an external command, one task for each line of `requests`.

    options: command (JSON array of arguments), source and commit (its environment), requests (JSON array of objects, given to it one
    each as JSON on standard input). It answers {"results": [{...}]}; a row for each: request, place, id, path, json."""

    @classmethod
    def name(cls) -> str:
        return "adapter"

    def schema(self) -> str:
        return "request int, place int, id string, path string, json string"

    def reader(self, schema) -> DataSourceReader:
        return _AdapterReader(dict(self.options))


class _AdapterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(len(json.loads(self.options["requests"])))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        request = json.loads(self.options["requests"])[partition.value]
        env = {"MEMORY_SOURCE": self.options.get("source", ""), "MEMORY_COMMIT": self.options.get("commit", "")}
        done = subprocess.run(json.loads(self.options["command"]), input=json.dumps(request), capture_output=True, text=True, timeout=float(self.options.get("seconds", ADAPTER_SECONDS)), env=env, check=False)
        if done.returncode:
            raise RuntimeError(f"adapter failed with {done.returncode}: {done.stderr[-400:]}")
        for place, item in enumerate(json.loads(done.stdout).get("results", [])):
            yield partition.value, place, str(item.get("id")), item.get("path"), json.dumps(item, sort_keys=True)


class HttpSource(DataSource):
    """spark.read.format("http-json"): results of a JSON service, one task for each of `requests`, posted as JSON.

    options: url, requests (JSON array of objects), list (name of the result's list, `results`), seconds, token (sent as a bearer token).
    A row for each result: request, place, id, path, json."""

    @classmethod
    def name(cls) -> str:
        return "http-json"

    def schema(self) -> str:
        return "request int, place int, id string, path string, json string"

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(dict(self.options))


class _HttpReader(_AdapterReader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        body = json.loads(self.options["requests"])[partition.value]
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.options['token']}"} if "token" in self.options else {})
        request = urllib.request.Request(self.options["url"], json.dumps(body).encode(), headers, method="POST")
        with urllib.request.urlopen(request, timeout=float(self.options.get("seconds", ADAPTER_SECONDS))) as answer:
            found = json.load(answer)
        for place, item in enumerate(found.get(self.options.get("list", "results")) or []):
            yield partition.value, place, str(item.get("id")), item.get("path"), json.dumps(item, sort_keys=True)


def reviewed(records: DataFrame, command: list[str], seconds: float = REVIEW_SECONDS) -> DataFrame:
    """memory_id, decision, reason of a reviewer command, asked once a record with JSON on standard input. No valid answer in time means hold."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                try:
                    done = subprocess.run(command, input=json.dumps(row, default=str), capture_output=True, text=True, timeout=seconds, check=True)
                    said = json.loads(done.stdout)
                    decision, reason = said.get("decision"), str(said.get("reason") or "")
                    if decision not in DECISIONS:
                        decision, reason = "hold", "reviewer gave no known decision"
                except (OSError, ValueError, subprocess.SubprocessError, AttributeError) as error:
                    decision, reason = "hold", type(error).__name__
                rows.append((row["memory_id"], decision, reason))
            yield pd.DataFrame(rows, columns=["memory_id", "decision", "reason"])

    kind = records.schema["memory_id"].dataType.simpleString()
    return records.mapInPandas(ask, f"memory_id {kind}, decision string, reason string")


def provider_vectors(texts: list[str], call: Callable[[list[str]], list[dict]]) -> list[list[float]] | None:
    """Vectors of texts from a provider that takes ten at a time, 6000 characters each, and answers {index, embedding} in any order.

    All or none: a missing index or vectors of several widths mean that the provider can't be used."""
    out: list[list[float]] = []
    for at in range(0, len(texts), BATCH_TEXTS):
        part = [t[:TEXT_CHARS] for t in texts[at : at + BATCH_TEXTS]]
        try:
            found = {int(x["index"]): list(map(float, x["embedding"])) for x in call(part)}
        except (KeyError, TypeError, ValueError, OSError):
            return None
        if sorted(found) != list(range(len(part))):
            return None
        out += [found[i] for i in range(len(part))]
    return out if len({len(v) for v in out}) <= 1 and all(out) else None


def vectors_of(docs: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], list[dict]]], fallback: Callable[[list[str]], list]) -> DataFrame:
    """key, vector, provider of docs: the provider is loaded once a task; a batch that it does not answer whole is encoded by fallback, and says so."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = load()
        for pdf in batches:
            texts = pdf[text].fillna("").tolist()
            found = provider_vectors(texts, call)
            name = "provider" if found is not None else "builtin"
            vectors = found if found is not None else [list(map(float, v)) for v in fallback(texts)]
            yield pd.DataFrame({key: pdf[key], "vector": vectors, "provider": name})

    return docs.select(key, text).mapInPandas(encode, f"{key} {docs.schema[key].dataType.simpleString()}, vector array<double>, provider string")


@runtime_checkable
class TeamBackend(Protocol):
    """What a store of team records offers, over frames."""

    def publish(self, payloads: DataFrame) -> DataFrame: ...
    def activate(self, ids: DataFrame) -> DataFrame: ...
    def search(self, queries: DataFrame, limit: int) -> DataFrame: ...
    def feedback(self, feedback: DataFrame) -> DataFrame: ...
    def export_bundle(self) -> DataFrame: ...
    def import_bundle(self, records: DataFrame, revisions: DataFrame, feedback: DataFrame) -> DataFrame: ...
    def compact(self, keep: int) -> DataFrame: ...
    def health(self) -> DataFrame: ...


class Providers:
    """Named providers of the seven operations; unknown names and operations are errors."""

    def __init__(self):
        self._all: dict[str, dict[str, Callable]] = {}

    def register(self, name: str, **operations: Callable) -> None:
        if unknown := set(operations) - set(OPERATIONS):
            raise ValueError(f"unknown operations: {', '.join(sorted(unknown))}")
        self._all[name] = operations

    def call(self, name: str, operation: str, *args, **kwargs):
        if operation not in self._all.get(name, {}):
            raise KeyError(f"{name} has no operation {operation}")
        return self._all[name][operation](*args, **kwargs)

    def capabilities(self, name: str) -> tuple[str, ...]:
        return tuple(x for x in OPERATIONS if x in self._all.get(name, {}))
