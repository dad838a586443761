"""Packing: vector bin packing of token pieces by the dot-product heuristic.

Every item has three sizes: tokens, segments (1) and loss-bearing tokens, and a sequence has a limit
on each. Which tokens bear loss follows from spans of the text (as operator 1 gives them for assistant turns); without spans all do. A task fills one sequence at a time: of the items that fit, it takes the one whose size
vector (as shares of the limits) has the largest dot product with the room that is left. Where no
whole item fills the last gap, an item is cut there. What is left at the end of a task is cut into
sequences whose lengths are powers of two, which need no padding.

A task packs its own input partition, so nothing is shuffled and a lost task is simply run again.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import small_batches
from mnemolake.llm.tokens import encoder


#: Ids that a task takes in before it hands out what it has packed.
FLUSH_BYTES = 2 << 20


@dataclass(frozen=True)
class Limits:
    """Of a sequence. pool: items among which the heuristic chooses at once."""

    tokens: int = 2048
    segments: int = 512
    loss_tokens: int = 2048
    pool: int = 2048


@dataclass(slots=True)
class Piece:
    """A run of one document's ids: bytes of unsigned 32-bit ids, and for each id whether it bears loss."""

    doc: int
    start: int
    ids: bytes
    loss: np.ndarray | None = None  # None: every id bears loss

    def __len__(self) -> int:
        return len(self.ids) // 4

    @property
    def losses(self) -> int:
        return len(self) if self.loss is None else int(self.loss.sum())

    def cut(self, n: int) -> tuple[Piece, Piece]:
        a, b = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return Piece(self.doc, self.start, self.ids[: 4 * n], a), Piece(self.doc, self.start + n, self.ids[4 * n :], b)

    def fit(self, tokens: int, losses: int) -> int:
        """Ids from the start that keep to both."""
        n = min(tokens, len(self))
        if self.loss is None:
            return min(n, losses)
        return min(n, int(np.searchsorted(np.cumsum(self.loss), losses, "right")))


class Packer:
    """Takes pieces, gives full sequences (lists of pieces); finish() gives the rest."""

    def __init__(self, limits: Limits):
        self.limits, self.items = limits, []
        self.whole = min(limits.tokens, limits.loss_tokens)

    def add(self, piece: Piece):
        while len(piece) > self.limits.tokens or piece.losses > self.limits.loss_tokens:
            head, piece = piece.cut(max(1, piece.fit(self.limits.tokens, self.limits.loss_tokens)))
            if len(head) == self.limits.tokens:
                yield [head]
            else:
                self.items.append(head)
        self.items.append(piece)
        if len(self.items) >= self.limits.pool:
            yield from self._fill(last=False)

    def finish(self):
        yield from self._fill(last=True)

    def _fill(self, last: bool):
        return self._fill_by_size(last) if all(x.loss is None for x in self.items) else self._fill_by_sizes(last)

    def _fill_by_size(self, last: bool):
        """_fill_by_sizes() where every id bears loss: the largest dot product is that of the longest item that fits, found in a sorted list."""
        items, top = self.items, self.limits
        order = sorted((len(x), -i) for i, x in enumerate(items))
        left = sum(n for n, _ in order)
        while left >= (1 if last else top.tokens * 4):
            room, segments, loss, chosen = top.tokens, top.segments, top.loss_tokens, []
            while room > 0 and segments > 0:
                at = bisect_right(order, (min(room, loss), 0)) - 1
                if at < 0 or segments == 1 and order[at][0] != room:  # the last segment: only what fills the gap is of use
                    break
                n, k = order.pop(at)
                chosen.append(items[-k])
                room, segments, loss, left = room - n, segments - 1, loss - n, left - n
            n = min(room, loss)
            if n > 0 and segments > 0 and order:  # cut the longest item into the gap
                size, k = order.pop()
                head = items[-k]
                if n < size:
                    head, items[-k] = items[-k].cut(n)
                    insort(order, (size - n, k))
                n = min(n, size)
                chosen.append(head)
                room, left = room - n, left - n
            yield from [chosen] if room == 0 else self._powers(chosen)
        self.items = [items[i] for i in sorted(-k for _, k in order)]

    def _fill_by_sizes(self, last: bool):
        items, top = self.items, self.limits
        caps = np.array([top.tokens, top.segments, top.loss_tokens], np.float64)
        sizes = np.array([[len(x), 1, x.losses] for x in items], np.float64).reshape(-1, 3)
        free = np.ones(len(items), bool)
        left = sizes[:, 0].sum()
        while left >= (1 if last else top.tokens * 4):
            room, chosen = caps.copy(), []
            while room[0] > 0 and room[1] > 0:
                fits = free & (sizes <= room).all(axis=1)
                if room[1] == 1:  # the last segment: only what fills the gap is of use
                    fits &= sizes[:, 0] == room[0]
                if not fits.any():
                    break
                k = int(np.argmax(np.where(fits, (sizes / caps) @ (room / caps), -1)))
                chosen.append(items[k])
                room -= sizes[k]
                left -= sizes[k, 0]
                free[k] = False
            if room[0] > 0 and room[1] > 0 and free.any():  # cut the longest item into the gap
                k = int(np.argmax(np.where(free, sizes[:, 0], -1)))
                n = items[k].fit(int(room[0]), int(room[2]))
                if 0 < n < len(items[k]):
                    head, items[k] = items[k].cut(n)
                    chosen.append(head)
                    sizes[k] = len(items[k]), 1, items[k].losses
                    left -= n
                    room[0] -= n
                elif n == len(items[k]):
                    chosen.append(items[k])
                    free[k] = False
                    left -= n
                    room[0] -= n
            yield from [chosen] if room[0] == 0 else self._powers(chosen)
        self.items = [x for x, f in zip(items, free, strict=True) if f]

    @staticmethod
    def _powers(pieces: list[Piece]):
        """Sequences whose lengths are the powers of two that make up the total."""
        total, rest = sum(map(len, pieces)), pieces[::-1]
        while total:
            room = 1 << (total.bit_length() - 1)
            total, out = total - room, []
            while room:
                piece = rest.pop()
                if len(piece) > room:
                    piece, tail = piece.cut(room)
                    rest.append(tail)
                out.append(piece)
                room -= len(piece)
            yield out


PACKED_SCHEMA = "doc_id bigint, start bigint, length bigint, input_ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint"


def loss_mask(starts: np.ndarray, spans: list[tuple[int, int]], end: bool) -> np.ndarray:
    """Whether each token (first code point in `starts`, ascending) begins in a span (start, length); last, `end` for the end id."""
    edges = np.array([(a, a + n) for a, n in sorted(spans) if n > 0], np.int64).reshape(-1, 2)
    tops = np.maximum.accumulate(edges[:, 1]) if len(edges) else edges[:, 1]
    at = np.searchsorted(edges[:, 0], starts, "right")
    inside = (at > 0) & (starts < np.concatenate([[0], tops])[at])
    return np.append(inside, end)


def pack_documents(docs: DataFrame, tokenizer: str, spaces: str, end_id: int, limits: Limits = Limits(), loss_spans: str | None = None) -> DataFrame:
    """Pack every text of docs (doc_id, text), with end_id after each, into sequences.

    loss_spans: a column of docs, array of (start, length) in code points of the text: only tokens that begin in a span bear loss,
    and the end id does if the text does to its end. Null spans are none. Without the column every id bears loss.

    A row for each piece: doc_id, start, length, input_ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset, loss_tokens. sequence_id is the task's number times 2^33 plus a
    count. Null and empty texts have the end id alone. Rows with equal or null doc_id are documents
    of their own. Other columns are ignored. An empty table gives no rows. Texts of any length are encoded whole.
    """
    end = np.array([end_id], "<u4").tobytes()
    small_batches(docs.sparkSession)

    def pack(batches):
        made, packer = encoder(tokenizer, spaces), Packer(limits)
        number = TaskContext.get().partitionId() << 33
        known: dict[int, tuple[int | None, int]] = {}  # of documents with pieces that wait: doc_id, tokens
        rows: list[tuple] = []
        count = size = 0

        def place(sequences):
            nonlocal number
            for sequence in sequences:
                offset = 0
                for piece in sequence:
                    doc_id, total = known[piece.doc]
                    rows.append((doc_id, piece.start, len(piece), piece.ids, total, number, offset, piece.losses))
                    offset += len(piece)
                number += 1

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PACKED_TYPES, strict=True)], names=PACKED_NAMES)
            rows.clear()
            waits = {x.doc for x in packer.items}
            for k in [k for k in known if k not in waits]:
                del known[k]
            return out

        for batch in batches:
            for key, text, spans in zip(batch.column(0), batch.column(1), batch.column(2) if loss_spans else repeat(None), strict=loss_spans is not None):
                raw = text.as_py()
                if spans is None:
                    ids, mask = made.encode(raw) + end, None
                else:
                    own = [(x["start"], x["length"]) for x in spans.as_py() or ()]
                    ids, starts = made.encode_with_starts(raw)
                    chars = len(raw.decode("utf-8")) if raw else 0
                    mask = loss_mask(starts, own, any(a < chars <= a + n for a, n in own))
                    ids += end
                known[count] = key.as_py(), len(ids) // 4
                place(packer.add(Piece(count, 0, ids, mask)))
                count += 1
                size += len(ids)
                if size >= FLUSH_BYTES and rows:
                    yield flush()
                    size = 0
        for sequence in packer.finish():
            place([sequence])
            if len(rows) >= 1024:
                yield flush()
        if rows:
            yield flush()

    spans = [F.col(f"`{loss_spans}`").cast("array<struct<start:bigint,length:bigint>>").alias("spans")] if loss_spans else []
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"), *spans).mapInArrow(pack, PACKED_SCHEMA)


PACKED_NAMES = ["doc_id", "start", "length", "input_ids", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
PACKED_TYPES = [pa.binary() if n == "input_ids" else pa.int64() for n in PACKED_NAMES]
