"""Token-ID output: Simple-8b blocks of token ids, in document order.

File format. The output is a Parquet table with a row for each block, in range partitions by document:
part, block (its number in the part), part_start (ids before it in the part), n_ids, n_docs, payload.
A payload is, little-endian: the magic S8B1; unsigned 32-bit n_docs; unsigned 64-bit n_ids and n_words;
n_docs document ids (signed 64-bit); n_docs flags, 1 where the document id is null; n_docs + 1 offsets
of the documents' ids in the block (unsigned 64-bit); n_words coded 64-bit words. A coded word has its
selector in the top 4 bits and equally wide fields below, the first id in the lowest bits. Selector 15
is the escape: the next word holds one id of over 60 bits as it is. The last word of a block may have
unused fields. Blocks hold whole documents, so each decodes alone and with array operations only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import small_batches, written
from mnemolake.llm.tokens import encoder

# Fixed values of the Simple-8b format: fields in a word and bits of each, by selector.
FIELDS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
#: Bits of small ids.
_BITS = np.array([max(1, i.bit_length()) for i in range(1 << 16)], np.int8)
MAGIC = b"S8B1"

#: Pretokens that a worker keeps: texts without case and white space repeat more, and this operator holds little else.
CACHE_ENTRIES = 400_000
#: A block is closed once it has so many ids; a longer document is a block of its own.
BLOCK_IDS = 65_536


def simple8b_encode(ids: np.ndarray) -> np.ndarray:
    """Coded words of unsigned ids (any width up to 64 bits)."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    bits = _BITS[ids] if int(ids.max()) < len(_BITS) else np.searchsorted(1 << np.arange(1, 61, dtype=np.uint64), ids, "right").astype(np.int8) + 1
    choice = np.full(n, ESCAPE, np.int8)
    low, high = int(bits.min()), int(bits.max())
    for selector in range(len(FIELDS) - 1, -1, -1):  # the fullest word that fits wins
        fields, width = FIELDS[selector], WIDTHS[selector]
        if width < low:
            break
        if width >= high:
            choice[:] = selector
            continue
        # runs of ids that fit the width; the unused fields of the last word count as fitting
        wide = np.flatnonzero(bits > width)
        gaps = np.diff(wide, prepend=-1, append=n + 60)
        long = np.flatnonzero(gaps > fields)
        if not len(long):
            continue
        first = wide[long - 1] + 1 if long[0] else np.concatenate([[0], wide[long[1:] - 1] + 1])
        last = first + gaps[long] - 1 - fields
        if len(long) < 64:
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                choice[a : b + 1] = selector
            continue
        change = np.zeros(n + 1, np.int8)
        change[first[first < n]] = 1
        change[np.minimum(last[first < n] + 1, n)] -= 1
        choice[np.cumsum(change[:n], dtype=np.int8).view(bool)] = selector
    counts = np.array([*FIELDS, 1, 1], np.int64)[choice].tolist()
    starts, i = [], 0
    add = starts.append
    while i < n:
        add(i)
        i += counts[i]
    starts = np.array(starts, np.int64)
    chosen = choice[starts]
    place = np.arange(len(starts)) + np.cumsum(chosen == ESCAPE) - (chosen == ESCAPE)
    words = np.zeros(len(starts) + int((chosen == ESCAPE).sum()), np.uint64)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for selector in np.unique(chosen).tolist():
        own = chosen == selector
        if selector == ESCAPE:
            words[place[own]] = np.uint64(ESCAPE << 60)
            words[place[own] + 1] = ids[starts[own]]
            continue
        word = np.full(int(own.sum()), selector << 60, np.uint64)
        for k in range(FIELDS[selector]):
            word |= padded[starts[own] + k] << np.uint64(k * WIDTHS[selector])
        words[place[own]] = word
    return words


def simple8b_decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of coded words."""
    words = np.asarray(words, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int8)
    escapes = np.flatnonzero(selectors == ESCAPE)
    if len(escapes):  # a raw word may look like an escape: of a run of such, every other one is
        real, last = [], -2
        for e in escapes.tolist():
            if e != last + 1:
                real.append(e)
                last = e
        raw = np.zeros(len(words), bool)
        raw[np.array(real) + 1] = True
        values = words[np.array(real) + 1]
        selectors = np.where(np.isin(np.arange(len(words)), real), ESCAPE, selectors)[~raw]
        words = words[~raw]
    counts = np.array([*FIELDS, 1, 1], np.int64)[selectors]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) if len(counts) else 0, np.uint64)
    for selector in np.unique(selectors).tolist():
        own = selectors == selector
        if selector == ESCAPE:
            out[starts[own]] = values
            continue
        mask = np.uint64((1 << WIDTHS[selector]) - 1)
        for k in range(FIELDS[selector]):
            out[starts[own] + k] = (words[own] >> np.uint64(k * WIDTHS[selector])) & mask
    return out[:n]


def pack_block(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """ids: of each document, as little-endian unsigned 32-bit integers."""
    offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("<u8")
    words = simple8b_encode(np.frombuffer(b"".join(ids), "<u4"))
    head = np.array([len(doc_ids)], "<u4").tobytes() + np.array([offsets[-1], len(words)], "<u8").tobytes()
    keys = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + bytes(x is None for x in doc_ids)
    return MAGIC + head + keys + offsets.tobytes() + words.astype("<u8").tobytes()


def unpack_block(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, offsets and all ids (little-endian unsigned 32-bit)."""
    if payload[:4] != MAGIC:
        raise ValueError("not a Simple-8b block")
    n_docs = int(np.frombuffer(payload, "<u4", 1, 4)[0])
    n_ids, n_words = map(int, np.frombuffer(payload, "<u8", 2, 8))
    at = 24
    keys = np.frombuffer(payload, "<i8", n_docs, at).tolist()
    nulls = payload[at + 8 * n_docs : at + 9 * n_docs]
    at += 9 * n_docs
    offsets = np.frombuffer(payload, "<u8", n_docs + 1, at).astype(np.int64)
    words = np.frombuffer(payload, "<u8", n_words, at + 8 * (n_docs + 1))
    return [None if gone else k for k, gone in zip(keys, nulls, strict=True)], offsets, simple8b_decode(words, n_ids).astype("<u4")


def write_token_blocks(
    docs: DataFrame, tokenizer: str, spaces: str, end_id: int, partitions: int | None = None, block_ids: int = BLOCK_IDS
) -> DataFrame:
    """Encode every text of docs (doc_id, text) and write its blocks to the shared folder in ascending
    doc_id order; return the table of blocks, read from the files.

    Null and empty texts have the end id alone. Null document ids come first; rows with equal ids are
    ordered by text, and repeated rows are kept. Other columns are ignored. An empty table has no blocks.
    Texts of any length are encoded whole; a document longer than `block_ids` is a block of its own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], "<u4").tobytes()

    def blocks(batches):
        made = encoder(tokenizer, spaces, CACHE_ENTRIES)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def close():
            nonlocal block, before, held
            row = {"part": [part], "block": [block], "part_start": [before], "n_ids": [held], "n_docs": [len(keys)], "payload": [pack_block(keys, ids)]}
            block, before, held = block + 1, before + held, 0
            keys.clear()
            ids.clear()
            return pa.RecordBatch.from_pydict(row, BLOCK_ARROW)

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(key.as_py())
                ids.append(made.encode(text.as_py()) + end)
                held += len(ids[-1]) // 4
                if held >= block_ids:
                    yield close()
        if keys:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(blocks, BLOCK_SCHEMA), "token-blocks")


BLOCK_SCHEMA = "part int, block int, part_start bigint, n_ids bigint, n_docs bigint, payload binary"
BLOCK_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("payload", pa.binary())])


def read_token_blocks(blocks: DataFrame) -> DataFrame:
    """A row for each document of a table of blocks: doc_id, start (ids of all documents before it),
    n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # a row for each range partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    joined = blocks.join(bases, blocks["part"] == bases["_part"]).select((F.col("base") + F.col("part_start")).alias("start"), "payload")

    def documents(batches):
        for batch in batches:
            for start, payload in zip(batch.column(0), batch.column(1), strict=True):
                keys, offsets, ids = unpack_block(payload.as_py())
                data, sizes = ids.tobytes(), np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        pa.array(start.as_py() + offsets[:-1], pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([data[4 * a : 4 * b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return joined.mapInArrow(documents, "doc_id bigint, start bigint, n_tokens bigint, ids binary")

