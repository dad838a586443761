"""Asked terms in the words of a task's rows, without a table of all words: an Arrow batch of words becomes counts by key and term."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Terms that a task may hold (beyond, terms and words meet by a join), and words whose terms a task keeps.
MOST_TERMS, KEPT_WORDS = 20_000, 100_000


def few_terms(asked: DataFrame) -> list[str] | None:
    """The distinct terms of asked (term), or None if they are too many for a task."""
    rows = asked.where("term <> ''").select("term").distinct().limit(MOST_TERMS + 1).collect()
    return sorted(r["term"] for r in rows) if len(rows) <= MOST_TERMS else None


class Matcher:
    """The terms that words hold."""

    def __init__(self, terms: list[str]):
        self.terms, self.kept, self.starts = terms, {}, {1: {}, 2: {}, 3: {}}
        for i, t in enumerate(terms):
            first = t[:3]
            self.starts[len(first)].setdefault(first, []).append((i, t))

    def of(self, word: str) -> bytes:
        """Numbers of the terms in a word, each with how often it is there without overlaps, as 32-bit integers. Terms meet the word by their first three characters."""
        found = self.kept.get(word)
        if found is None:
            held = {}
            for n, starts in self.starts.items():
                for at in range(len(word) - n + 1) if starts else ():
                    for i, t in starts.get(word[at : at + n], ()):
                        if i not in held and word.startswith(t, at):
                            held[i] = word.count(t)
            found = array("i", [x for pair in held.items() for x in pair]).tobytes()
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            self.kept[word] = found
        return found

    def pairs(self, words):
        """Arrays of row, term and times of all terms in an Arrow array of words."""
        import numpy as np

        coded = words.dictionary_encode()
        found = [self.of(w) for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 8
        flat = np.frombuffer(b"".join(found), np.int32).reshape(-1, 2).astype(np.int64)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[codes]
        rows = np.repeat(np.arange(len(codes)), lengths)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat((np.cumsum(sizes) - sizes)[codes], lengths)
        return rows, flat[place, 0], flat[place, 1]


def _groups(key):
    """Order of rows by key, and where each key begins in it."""
    import numpy as np

    order = np.argsort(key, kind="stable")
    return order, np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else order


def _mapped(rows: DataFrame, schema: str, terms: list[str], of_batch) -> DataFrame:
    """rows with a column word (no nulls) by Arrow batches; of_batch(batch, matcher, pairs) gives columns, the term by its number."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches) -> Iterator:
        import pyarrow as pa

        matcher = Matcher(shared.value)
        names = pa.array(matcher.terms, pa.string())
        for batch in batches:
            columns = of_batch(batch, matcher.pairs(batch.column("word")))
            yield pa.RecordBatch.from_pydict(columns | {"term": names.take(pa.array(columns["term"]))})

    return rows.mapInArrow(run, schema)


def counted_by_key(rows: DataFrame, terms: list[str]) -> DataFrame:
    """key, term, n, in_path of rows (key, word, path): n counts words that are not of the path. Sums of a batch: neighbouring rows of a key are one row."""

    def of_batch(batch, pairs):
        import numpy as np

        row, term, times = pairs
        keys = batch.column("key").dictionary_encode()
        path = batch.column("path").to_numpy(zero_copy_only=False).astype(bool)[row]
        order, starts = _groups(keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * (term.max(initial=0) + 1) + term)
        at = order[starts]
        total = np.add.reduceat(np.where(path, 0, times)[order], starts) if len(at) else times
        held = np.logical_or.reduceat(path[order], starts) if len(at) else path
        return {"key": batch.column("key").take(row[at]), "term": term[at], "n": total, "in_path": held}

    return _mapped(rows, f"key {rows.schema['key'].dataType.simpleString()}, term string, n bigint, in_path boolean", terms, of_batch)


def block_masks(postings: DataFrame, terms: list[str]) -> DataFrame:
    """term, block, mask, path_mask, head_mask, top of postings (word, block, masks, top), as sums of a batch."""
    masks = ("mask", "path_mask", "head_mask")

    def of_batch(batch, pairs):
        import numpy as np

        row, term, times = pairs
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        blocks = batch.column("block").dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order, starts = _groups(blocks[row] * (term.max(initial=0) + 1) + term)
        at, ordered = order[starts], row[order]
        out = {"term": term[at], "block": column("block")[row[at]]}
        for m in masks:
            out[m] = np.bitwise_or.reduceat(column(m)[ordered], starts) if len(at) else np.zeros(0, np.int64)
        out["top"] = np.add.reduceat(column("top")[ordered] * times[order], starts) if len(at) else np.zeros(0, np.int64)
        return out

    return _mapped(postings.select("word", "block", *masks, "top"), "term string, block bigint, mask bigint, path_mask bigint, head_mask bigint, top bigint", terms, of_batch)


def slot_counts(postings: DataFrame, terms: list[str]) -> DataFrame:
    """term, block, slot, n, in_path, in_head of postings with slots and counts, as sums of a batch."""

    def of_batch(batch, pairs):
        import numpy as np

        row, term, times = pairs
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        blocks = batch.column("block").dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        slots, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("slots", "counts"))
        held = batch.column("slots").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = held[row]
        pair = np.repeat(np.arange(len(row)), lengths)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat((np.cumsum(held) - held)[row], lengths)
        slot, own = slots[place].astype(np.int64), row[pair]
        bit = lambda c, rows, s: (column(c)[rows] >> s) & 1 != 0
        live = bit("mask", own, slot)  # counts of documents that are gone stay in the postings
        pair, place, slot, own = pair[live], place[live], slot[live], own[live]
        order, starts = _groups((blocks[own] * (term.max(initial=0) + 1) + term[pair]) * 64 + slot)
        at = order[starts]
        any_of = lambda c: np.logical_or.reduceat(bit(c, own, slot)[order], starts) if len(at) else np.zeros(0, bool)
        n = np.add.reduceat((counts[place].astype(np.int64) * times[pair])[order], starts) if len(at) else np.zeros(0, np.int64)
        return {"term": term[pair[at]], "block": column("block")[own[at]], "slot": slot[at].astype(np.int32), "n": n, "in_path": any_of("path_mask"), "in_head": any_of("head_mask")}

    return _mapped(postings.select("word", "block", "mask", "path_mask", "head_mask", "slots", "counts"), "term string, block bigint, slot int, n bigint, in_path boolean, in_head boolean", terms, of_batch)


#: Cells of documents times questions that a task sums at once, rows of the first k that it holds before it sorts them, and characters that it looks through at once.
CELLS, HELD_ROWS, MOST_CHARS = 1 << 20, 1 << 16, 1 << 21
#: Characters by which terms meet a text before the rest of them is compared.
FIRST = 5


class Finder:
    """Terms in whole texts, by array operations: windows of up to FIRST characters meet the first characters of the terms, and the rest is compared where they do."""

    def __init__(self, terms: list[str]):
        import numpy as np

        self.terms = terms
        chars = sorted(set("".join(terms)))
        self.codes = np.zeros(0x110000, np.uint32)  # characters of no term are 0
        self.codes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.base = np.uint64(len(chars) + 1)
        self.lengths = np.array([len(t) for t in terms], np.int64)
        self.chars = np.zeros((len(terms), int(self.lengths.max(initial=0))), np.uint32)
        starts: dict[int, dict[int, list[int]]] = {}
        for i, t in enumerate(terms):
            own = self.codes[[ord(c) for c in t]]
            self.chars[i, : len(own)] = own
            key = 0
            for c in own[:FIRST]:
                key = (key * int(self.base) + int(c)) % 2**64
            starts.setdefault(min(len(own), FIRST), {}).setdefault(key, []).append(i)
        self.starts = {n: (np.array(sorted(of), np.uint64), Links([(k, i) for k, key in enumerate(sorted(of)) for i in of[key]], len(of))) for n, of in starts.items()}
        self.near = {n: self._marked(keys) for n, (keys, _) in self.starts.items()}
        self.overlap = np.array([any(t.startswith(t[k:]) for k in range(1, len(t))) for t in terms], bool)

    @staticmethod
    def _slot(keys):
        import numpy as np

        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)  # 20 bits

    def _marked(self, keys):
        import numpy as np

        marked = np.zeros(1 << 20, bool)
        marked[self._slot(keys)] = True
        return marked

    def counted(self, texts: list[str]):
        """Arrays of row, term and times (without overlaps) of the terms that texts hold, by row and term."""
        import numpy as np

        none = np.zeros(0, np.int64)
        parts, row, size = [], 0, 0
        for at, text in enumerate(texts):
            size += len(text) + 1
            if size >= MOST_CHARS or at == len(texts) - 1:
                parts.append((row, self._counted(texts[row : at + 1])))
                row, size = at + 1, 0
        return tuple(np.concatenate(x) if x else none for x in ([first + r for first, (r, _, _) in parts], [t for _, (_, t, _) in parts], [n for _, (_, _, n) in parts]))

    def _counted(self, texts: list[str]):
        import numpy as np

        code = self.codes[np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        code = np.r_[code, np.zeros(self.chars.shape[1] + 1, np.uint32)]
        ends = np.cumsum([len(t) + 1 for t in texts])
        keys, places, found = np.zeros(len(code), np.uint64), [], []
        for n in range(1, FIRST + 1):
            keys = keys[: len(code) - n + 1] * self.base + code[n - 1 :]
            if n not in self.starts:
                continue
            known, terms = self.starts[n]
            at = np.flatnonzero(self.near[n][self._slot(keys)])
            k = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
            same = known[k] == keys[at]
            place, link = terms.follow(k[same])
            at, term = at[same][place], terms.to[link]
            for j in range(self.chars.shape[1]) if n == FIRST or self.base > 7000 else ():  # such keys are exact where they are whole terms
                good = (self.lengths[term] <= j) | (code[at + j] == self.chars[term, j])
                at, term = at[good], term[good]
            places.append(at)
            found.append(term)
        at, term = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, found))
        cell, many = np.searchsorted(ends, at, "right") * len(self.terms) + term, len(texts) * len(self.terms)
        if many <= 1 << 23:
            n = np.bincount(cell, minlength=many)
            held = np.flatnonzero(n)
            n = n[held]
        else:
            held, n = np.unique(cell, return_counts=True)
        own = self.overlap[term]
        if own.any():  # such terms may overlap themselves: where they do, they are counted one by one
            order = np.lexsort((at[own], term[own]))
            a, t = at[own][order], term[own][order]
            close = (np.diff(a) < self.lengths[t[1:]]) & (t[1:] == t[:-1])
            for c in np.unique(cell[own][order][1:][close]).tolist():
                n[np.searchsorted(held, c)] = texts[c // len(self.terms)].count(self.terms[c % len(self.terms)])
        row, term = np.divmod(held, max(1, len(self.terms)))
        return row, term, n


def held_terms(rows: DataFrame, terms: list[str]) -> DataFrame:
    """rows (text, path, both lowered and not null, and others) with, in their place, held, times, in_path: the numbers of the terms that a row's text or path holds,
    how often its text does, and whether its path does. No row meets another. Terms have no white space."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)
    kept = [c for c in rows.columns if c not in ("text", "path")]

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        finder, n = Finder(shared.value), max(1, len(shared.value))
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch = whole.slice(start, 1024)
                (row, term, times), (path_row, path_term, _) = (finder.counted(batch.column(c).to_pylist()) for c in ("text", "path"))
                in_text, in_path = row * n + term, path_row * n + path_term
                cells = np.union1d(in_text, in_path)
                count = np.zeros(len(cells), np.int32)
                count[np.searchsorted(cells, in_text)] = times
                ends = pa.array(np.r_[0, np.cumsum(np.bincount(cells // n, minlength=len(batch)))], pa.int32())
                made = {"held": pa.array((cells % n).astype(np.int32)), "times": pa.array(count), "in_path": pa.array(np.isin(cells, in_path))}
                yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {c: pa.ListArray.from_arrays(ends, x) for c, x in made.items()})

    return rows.select(*kept, "text", "path").mapInArrow(run, _ddl(rows, kept, "held array<int>, times array<int>, in_path array<boolean>"))


def _ddl(rows: DataFrame, kept: list[str], more: str) -> str:
    return ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), more])


class Links:
    """From numbers below n to numbers, each with a weight, as flat arrays."""

    def __init__(self, pairs, n: int):
        import numpy as np

        pairs = sorted(pairs)
        self.to = np.array([p[1] for p in pairs], np.int64)
        self.weight = np.array([p[2] if len(p) > 2 else 1.0 for p in pairs], float)
        self.starts = np.r_[0, np.cumsum(np.bincount(np.array([p[0] for p in pairs], np.int64), minlength=n))]

    def follow(self, numbers):
        """For all links of an array of numbers: the place of the number in it, and the link."""
        import numpy as np

        first, lengths = self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers]
        place = np.repeat(np.arange(len(numbers)), lengths)
        return place, np.arange(len(place)) - np.repeat(np.cumsum(lengths) - lengths - first, lengths)


class Questions:
    """What tasks know of the questions: which terms they count and with what weight, and which terms cover what is to be covered.

    terms: their list; of each question its terms and the forms of each of its covered items; weights: by term."""

    def __init__(self, terms: list[str], asked: list[tuple[list[str], list[list[str]]]], weights: dict[str, float] | None = None):
        number = {t: i for i, t in enumerate(terms)}
        items: dict[tuple[str, ...], int] = {}
        of_item = [(items.setdefault(tuple(sorted(set(forms))), len(items)), q) for q, (_, covered) in enumerate(asked) for forms in covered]
        self.n, self.items = len(asked), len(items)
        self.counted = Links([(number[t], q, (weights or {}).get(t, 0.0)) for q, (own, _) in enumerate(asked) for t in set(own) if t in number], len(terms))
        self.covers = Links([(number[f], i) for forms, i in items.items() for f in forms if f in number], len(terms))
        self.of_item = Links(of_item, len(items))

    def sums(self, rows: int, row, term, times):
        """matched, words (weighted counts of 4 at most) and covered by row and question, as flat arrays, of the terms that rows hold."""
        import numpy as np

        place, link = self.counted.follow(term)
        cell = row[place] * self.n + self.counted.to[link]
        matched = np.bincount(cell, minlength=rows * self.n)
        words = np.bincount(cell, np.minimum(times[place], 4) * self.counted.weight[link], rows * self.n)
        place, link = self.covers.follow(term)
        item_row, item = np.divmod(np.unique(row[place] * max(1, self.items) + self.covers.to[link]), max(1, self.items))
        place, link = self.of_item.follow(item)
        return matched, words, np.bincount(item_row[place] * self.n + self.of_item.to[link], minlength=rows * self.n)


def question_hits(lists: DataFrame, questions: Questions, score, kind: str, k: int | None = None, order: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of held_terms() for each question (its number: q) of which they hold or cover something: their other columns, q, matched, covered, and score (of Spark's type `kind`).

    score(columns, rows, q, matched, words, covered) gives an array; columns: the batch, rows and q: places in it and numbers of questions. With k a task hands on only the first k
    of each question (and each value of the columns `by`), by score and the columns `order`; without, all of them. Nothing is shuffled."""
    kept = [c for c in lists.columns if c not in ("held", "times", "in_path")]
    shared = lists.sparkSession.sparkContext.broadcast(questions)

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        asked = shared.value
        limit, pending, waiting = np.full(asked.n, -np.inf), [], 0
        numbers = {"bigint": pa.int64(), "double": pa.float64()}[kind]

        def first(tables):
            rows = pa.concat_tables(tables).sort_by([("q", "ascending"), *((c, "ascending") for c in by), ("score", "descending"), *((c, "ascending") for c in order)])
            group = np.zeros(len(rows), bool)
            group[:1] = True
            for c in ("q", *by):
                code = rows.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                group[1:] |= code[1:] != code[:-1]
            at = np.flatnonzero(group)
            rank = np.arange(len(rows)) - np.repeat(at, np.diff(np.r_[at, len(rows)]))
            rows = rows.filter(pa.array(rank < k))
            if not by:  # the k-th of a question is what further rows must reach
                q, s = rows.column("q").to_numpy(), rows.column("score").to_numpy()
                full = np.bincount(q, minlength=asked.n) >= k
                ends = np.flatnonzero(np.r_[np.diff(q) != 0, True]) if len(q) else q
                limit[q[ends]] = np.where(full[q[ends]], s[ends], -np.inf)
            return rows

        for whole in batches:
            size = max(1, CELLS // max(1, asked.n))
            for start in range(0, len(whole), size):
                batch = whole.slice(start, size)
                held, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("held", "times"))
                lengths = batch.column("held").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                matched, words, covered = asked.sums(len(batch), np.repeat(np.arange(len(batch)), lengths), held, times)
                cells = np.flatnonzero((matched > 0) | (covered > 0))
                row, q = np.divmod(cells, max(1, asked.n))
                points = score(batch, row, q, matched[cells], words[cells], covered[cells])
                if k is not None:
                    good = np.flatnonzero(points >= limit[q])
                    cells, row, q, points = cells[good], row[good], q[good], points[good]
                taken = batch.select(kept).take(pa.array(row))
                made = [pa.array(q, pa.int32()), pa.array(matched[cells], pa.int64()), pa.array(covered[cells], pa.int32()), pa.array(points, numbers)]
                out = pa.RecordBatch.from_arrays([*taken.columns, *made], names=[*kept, "q", "matched", "covered", "score"])
                if k is None:
                    for at in range(0, len(out), HELD_ROWS):
                        yield out.slice(at, HELD_ROWS)
                    continue
                pending.append(pa.Table.from_batches([out]))
                waiting += len(out)
                if waiting > HELD_ROWS:
                    pending = [first(pending)]
                    waiting = 0
        if pending:
            yield from first(pending).combine_chunks().to_batches(max_chunksize=HELD_ROWS)

    return lists.mapInArrow(run, _ddl(lists, kept, f"q int, matched bigint, covered int, score {kind}"))
