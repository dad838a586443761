"""Benchmark decontamination: a hash set of the benchmark's n-grams, scanned against every token window.

The benchmark is dealt into blocks of a bounded number of bytes. Of a block, the driver makes sorted arrays of the hashes of
all windows, with the bytes that each stands for, and broadcasts them. A document's windows are hashed as arrays, looked up by
binary search, and every hit is verified against the bytes. One block is enough for any usual benchmark. A larger one is
scanned block by block, one job after another, so that a task holds one block only; hits of all blocks are gathered by the
text's digest, on the original words, before anything is decided. The result does not depend on the number of blocks.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import ALNUM, free_name, resident, small_batches, written
from mnemolake.llm.shingles import placed_words, run_hashes, word_hashes

#: Bytes of benchmark texts that one broadcast block holds at most (an item is never split); its arrays take about four times as much.
BLOCK_BYTES = 8 << 20
#: Parts of a block by which it is filled: a table of CELLS rows for each block is on the driver.
CELLS = 16
#: Verified hashes that a task keeps.
VERIFIED = 50_000
#: Rows of hits (texts with any) that may be broadcast to the documents; of more, both sides are shuffled.
MOST_BROADCAST = 100_000


def words_of(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, with A-Z lower-cased."""
    return (text or "").encode("utf-8").translate(ALNUM).split()


class NgramSet:
    """n-grams of items. Items with fewer than n words, but with some, are one n-gram of their own length.
    An item without an id has n-grams, too, but is not among the items found.

    text: all items' words, one space between. sizes: for each size of n-grams, the sorted window hashes and, of each, its
    place in text, its length in bytes, and its item."""

    def __init__(self, items, n: int):
        self.names, texts, found, at = [], [], {}, 0
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            size = min(n, len(words))
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            starts = at + np.cumsum(lengths + 1) - lengths - 1
            texts.append(b" ".join(words))
            hashes, m = run_hashes(word_hashes(texts[-1], ALNUM), size), len(words) - size + 1
            length = starts[size - 1 :] + lengths[size - 1 :] - starts[:m]
            found.setdefault(size, []).append((hashes, starts[:m].astype(np.uint32), length.astype(np.uint32), np.full(m, len(self.names), np.int32)))
            self.names.append(item)
            at += len(texts[-1]) + 1
        self.text = b" ".join(texts)
        self.sizes = {}
        for size in sorted(found):
            columns = [np.concatenate(x) for x in zip(*found.pop(size), strict=True)]
            order = np.argsort(columns[0], kind="stable")
            self.sizes[size] = tuple(x[order] for x in columns)
        self.verified: dict[tuple[int, int], dict[bytes, set[str]]] = {}

    def __getstate__(self):
        return self.__dict__ | {"verified": {}}

    @property
    def nbytes(self) -> int:
        return len(self.text) + sum(x.nbytes for columns in self.sizes.values() for x in columns)

    def _grams(self, size: int, at: int) -> dict[bytes, set[str]]:
        """Items of each n-gram with the hash at this place of the sorted array."""
        hashes, starts, lengths, items = self.sizes[size]
        if (known := self.verified.get((size, at))) is None:
            known, end = {}, int(np.searchsorted(hashes, hashes[at], "right"))
            for a, n, item in zip(starts[at:end].tolist(), lengths[at:end].tolist(), items[at:end].tolist(), strict=True):
                known.setdefault(self.text[a : a + n], set()).update([] if self.names[item] is None else [self.names[item]])
            if len(self.verified) >= VERIFIED:
                self.verified.clear()
            self.verified[size, at] = known
        return known

    def scan(self, text: bytes | None) -> tuple[np.ndarray, set[str]]:
        """A flag for each word of the text that lies in an occurrence of an n-gram, and the items with occurrences."""
        found: set[str] = set()
        if not text:
            return np.zeros(0, bool), found
        words, first, behind = placed_words(text, ALNUM)
        hit, plain = np.zeros(len(words), bool), None
        for size, (hashes, *_) in self.sizes.items():
            windows = run_hashes(words, size)
            at = np.minimum(np.searchsorted(hashes, windows), len(hashes) - 1)
            for i in np.flatnonzero(hashes[at] == windows).tolist():
                plain = text.translate(ALNUM) if plain is None else plain
                own = b" ".join(plain[first[i] : behind[i + size - 1]].split())
                if (items := self._grams(size, int(at[i])).get(own)) is not None:
                    hit[i : i + size] = True
                    found |= items
        return hit, found


def _blocks(benchmark: DataFrame, limit: int):
    """Lists of different (item, text) of about `limit` bytes at most, one row at least; one is on the driver at a time.

    Rows are dealt into cells by hash, CELLS to a limit's bytes, and cells are filled into blocks by their bytes, so equal rows don't count."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= limit:
        yield [(r["item"], r["text"]) for r in items.collect()]  # of the size checked above
        return
    items = written(items.withColumn("cell", F.pmod(F.xxhash64("item", "text"), F.lit(-(-total // limit) * CELLS))), "benchmark")
    first, held = None, 0
    for cell, size in [*((r["cell"], r["b"]) for r in items.groupBy("cell").agg(F.sum(F.octet_length("text")).alias("b")).orderBy("cell").collect()), (None, limit)]:
        if first is not None and (held + size > limit or cell is None):
            until = F.lit(True) if cell is None else F.col("cell") < cell
            yield [(r["item"], r["text"]) for r in items.where((F.col("cell") >= first) & until).collect()]
            first, held = None, 0
        first = cell if first is None else first
        held += size


def _sets(docs: DataFrame, benchmark: DataFrame, n: int, limit: int):
    """The blocks' n-grams, each broadcast as it is asked for."""
    for rows in _blocks(benchmark, limit):
        yield docs.sparkSession.sparkContext.broadcast(NgramSet(rows, n))


def scan_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the columns n_words (long), hit_words (array of word numbers in any occurrence) and
    items (array of item_ids, as strings, sorted) behind its own; clashing names get an underscore in front.

    Null and empty texts have no words; items with null text have no n-grams, those with a null id hit words but are
    not in items; equal items count each, and repeated rows of docs are rows of their own. An empty table gives no rows, an
    empty benchmark hits nothing. n-grams are compared by content, never by hash alone. Texts of any length are scanned whole.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    added = [free_name(names, x) for x in ("n_words", "hit_words", "items")]
    kinds = ("bigint", "array<int>", "array<string>")
    sets = _sets(docs, benchmark, n, block_bytes)
    first, second = next(sets), next(sets, None)
    if second is not None:
        return _gathered(docs, [first, second], sets, added)
    schema = docs.select("*", *(F.lit(None).cast(t).alias(x) for x, t in zip(added, kinds, strict=True))).schema
    text_at = names.index("text")

    def scan(batches):
        resident()
        grams = first.value
        for batch in batches:
            found = [grams.scan(t.as_py().encode("utf-8") if t.is_valid else None) for t in batch.column(text_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *_found_columns(found)], names=[*names, *added])

    return docs.mapInArrow(scan, schema)


def _found_columns(found) -> list[pa.Array]:
    return [
        pa.array([len(hit) for hit, _ in found], pa.int64()),
        pa.array([np.flatnonzero(hit).astype(np.int32) for hit, _ in found], pa.list_(pa.int32())),
        pa.array([sorted(items) for _, items in found], pa.list_(pa.string())),
    ]


def _gathered(docs: DataFrame, sets: list, more, added: list[str]) -> DataFrame:
    """scan_documents() with several blocks: each scans all texts in a job of its own and writes the texts' digests with hits;
    hits are a function of the text, so equal texts share theirs."""
    texts = docs.select(F.col("text").cast("binary").alias("text")).where("text is not null")
    tables = []
    while sets:
        shared = sets.pop(0)

        def scan(batches, shared=shared):
            resident()
            grams = shared.value
            for batch in batches:
                texts = [t.as_py() for t in batch.column(1)]
                found = [grams.scan(t) for t in texts]
                keep = [i for i, (hit, _) in enumerate(found) if hit.any()]
                columns = _found_columns([found[i] for i in keep])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), *columns[1:]], names=["digest", "hits", "items"])

        hits = texts.select(F.sha2("text", 256).alias("digest"), "text").mapInArrow(scan, "digest string, hits array<int>, items array<string>")
        tables.append(written(hits.dropDuplicates(["digest"]), "block-hits"))
        shared.destroy()
        if not sets and (following := next(more, None)) is not None:
            sets.append(following)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    merged = written(reduce(DataFrame.unionByName, tables).groupBy("digest").agg(union("hits").alias("hits"), union("items").alias("items")), "hits")  # a row for each block at most
    few = merged.count() <= MOST_BROADCAST
    own = free_name([*docs.columns, *added], "digest")
    block_hits, block_items = (free_name([*docs.columns, *added, own], x) for x in ("block_hits", "block_items"))
    merged = merged.select(F.col("digest").alias(own), F.col("hits").alias(block_hits), F.col("items").alias(block_items))
    joined = docs.withColumn(own, F.sha2(F.col("text").cast("binary"), 256)).join(F.broadcast(merged) if few else merged, own, "left")
    words = F.size(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"), F.lit(0)))
    return joined.select(
        *(F.col(f"`{c}`") for c in docs.columns), words.cast("bigint").alias(added[0]),
        F.coalesce(block_hits, F.array().cast("array<int>")).alias(added[1]), F.coalesce(block_items, F.array().cast("array<string>")).alias(added[2]),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, drop_share: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the benchmark's passages: hit words are cut out of the text (with what lies between
    them), and a document goes if `drop_share` or more of its words are hit. n_chars, where docs has it, follows the text.

    Hits of all benchmark blocks are gathered on the original text before anything is decided or cut. Documents without hits,
    null and empty texts stay as they are; repeated rows are treated alike; an empty table gives no rows, an empty benchmark
    changes nothing; the columns are those of docs, whatever their names. Texts of any length are scanned whole."""
    small_batches(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    text_at = names.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names else None
    chars_type = pa.int32() if chars_at is not None and schema[chars_at].dataType.typeName() == "integer" else pa.int64()
    sets = _sets(docs, benchmark, n, block_bytes)
    first, second = next(sets), next(sets, None)
    source = docs
    if second is not None:
        added = [free_name(names, x) for x in ("n_words", "hit_words", "items")]
        source = _gathered(docs, [first, second], sets, added).select(*(F.col(f"`{c}`") for c in names), added[1])
    one = first if second is None else None

    def clean(batches):
        resident()
        for batch in batches:
            keep, texts, changed = [], [], False
            earlier = batch.column(len(names)) if one is None else repeat(None, len(batch))
            for text, found in zip(batch.column(text_at), earlier, strict=True):
                old = text.as_py()
                if one is not None:
                    hit, _ = one.value.scan(old.encode("utf-8") if old else None)
                else:
                    numbers = found.as_py()
                    hit = np.zeros(len(words_of(old)) if numbers else 0, bool)
                    hit[numbers] = True
                stays = not hit.any() or hit.mean() < drop_share
                keep.append(stays)
                if stays and hit.any():
                    changed = True
                    old = without_words(old, hit)
                texts.append(old)
            columns = list(batch.columns[: len(names)])
            if changed:
                lengths = columns[chars_at].to_pylist() if chars_at is not None else []
                old_texts = columns[text_at].to_pylist()
                columns[text_at] = pa.array(texts, pa.string())
                if chars_at is not None:
                    columns[chars_at] = pa.array([c if a == b else len(b) for c, a, b in zip(lengths, old_texts, texts, strict=True)], chars_type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return source.mapInArrow(clean, schema)


def without_words(text: str, hit: np.ndarray) -> str:
    """text without the words of which hit is true and what lies between two such neighbours."""
    data = text.encode("utf-8")
    plain = np.frombuffer(data.translate(ALNUM), np.uint8)
    inside = np.concatenate([[False], ~np.isin(plain, [32, 9, 10, 11, 12, 13]), [False]])
    edges = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    flags = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(flags == 1).tolist(), np.flatnonzero(flags == -1).tolist(), strict=True):
        out.append(data[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, data[at:]]).decode("utf-8")
