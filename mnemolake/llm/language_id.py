"""Language identification by interpolated Kneser-Ney character models.

A language's model gives each character of a word its probability after the ORDER - 1 characters before
it (a word starts with start marks and closes with an end mark). All languages' n-grams are merged
into one sorted array of 64-bit hashes for each order, with a row of discounted probabilities, and one
for contexts, with a row of back-off weights, so that a lookup is a binary search. The language
with the lowest cross-entropy per character wins. Rejection is calibrated on labelled texts that the
models have not seen.

The models are fitted on the driver on a bounded sample of labelled rows (SAMPLE_DOCS distinct texts of every label, of
SAMPLE_BYTES bytes at most; longer texts fill up where there are too few, by their start; with very many labels, fewer and
shorter ones, so that all of the sample has about SAMPLE_TOTAL bytes at most); every text is then scored whole, word by word,
with a cache of words.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import free_name, resident, small_batches
from mnemolake.llm.shingles import mixed

ORDER = 4
#: Bound of the labelled sample: texts of each language, and bytes of a text that are in it.
SAMPLE_DOCS = 600
SAMPLE_BYTES = 20_000
#: Bytes of all of the sample; beyond it, labels get fewer texts, LEAST_DOCS at least, and then shorter ones. No label is left out.
SAMPLE_TOTAL, LEAST_DOCS, LEAST_BYTES = 64 << 20, 40, 500
#: Tables of more languages than this are kept sparse, so that a model grows with its sample, not with languages times n-grams.
DENSE_LANGUAGES = 64
#: Of a worker's cache of word scores: words, and numbers in all; and of the words that are scored at once.
CACHE_WORDS = 150_000
CACHE_CELLS = CACHE_WORDS * (DENSE_LANGUAGES + 1)
PART_WORDS = 5_000
UNKNOWN = "und"
#: Rows of labels that may be broadcast.
MOST_BROADCAST = 100_000

_START, _END = 1, 2
#: ASCII other than letters parts words; case is folded on whole words later.
_SPLIT = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_SPLIT).split()


def letters_of(word: bytes) -> str:
    return "".join(c for c in word.decode("utf-8", "replace").lower() if c.isalpha())


def _laid_out(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with marks around each, and the places that are predicted."""
    pad = chr(_START) * (order - 1)
    flat = np.frombuffer("".join(pad + w + chr(_END) for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + order for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    inside = np.ones(len(flat), bool)
    for k in range(order - 1):
        inside[starts + k] = False
    return flat, np.flatnonzero(inside)


def _gram_hashes(flat: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of the n code points that end at each place."""
    out = np.full(len(at), n, np.uint64)
    for k in range(n - 1, -1, -1):
        out = mixed(out ^ flat[at - k])
    return out


def _context_hashes(flat: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of the n - 1 code points before each place."""
    out = np.full(len(at), n, np.uint64)
    for k in range(n - 1, 0, -1):
        out = mixed(out ^ flat[at - k])
    return out


def _rows(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each key in a sorted array, and whether it is there."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class Sparse:
    """Rows of a table that mostly holds one value: row i has values[starts[i]:starts[i + 1]] in the columns of the same places."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def at(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position among rows, column and value of each entry of these rows."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        which = np.repeat(np.arange(len(rows)), sizes)
        own = np.arange(len(which)) + np.repeat(self.starts[rows] - np.cumsum(sizes) + sizes, sizes)
        return which, self.columns[own], self.values[own]


def _table(keys: np.ndarray, own: list[tuple[np.ndarray, np.ndarray]], other: float) -> np.ndarray | Sparse:
    """Values by key, and by language in columns; `other` where a language lacks the key."""
    if len(own) <= DENSE_LANGUAGES:
        out = np.full((len(keys), len(own)), other)
        for j, (k, values) in enumerate(own):
            out[np.searchsorted(keys, k), j] = values
        return out
    row = np.concatenate([np.searchsorted(keys, k) for k, _ in own])
    order = np.argsort(row, kind="stable")
    columns = np.repeat(np.arange(len(own), dtype=np.int32), [len(k) for k, _ in own])
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(keys)))])
    return Sparse(starts, columns[order], np.concatenate([v for _, v in own])[order])


@dataclass
class Model:
    """grams[n], shares[n]: sorted n-gram hashes and, by language, their discounted probabilities; contexts[n],
    weights[n]: of the contexts of n-grams, the back-off weights. limit: the calibrated cross-entropy (bits a
    character) above which a text is rejected. sharpness: of the score."""

    languages: list[str]
    order: int
    grams: list[np.ndarray]
    shares: list[np.ndarray | Sparse]
    contexts: list[np.ndarray]
    weights: list[np.ndarray | Sparse]
    uniform: float
    limit: float = float("inf")
    sharpness: float = 1.0

    def bits(self, words: list[str]) -> np.ndarray:
        """Bits of each word by language, in columns, and last its length with the end mark."""
        flat, at = _laid_out(words, self.order)
        p = np.full((len(at), len(self.languages)), self.uniform)
        for n in range(1, self.order + 1):
            row, there = _rows(_context_hashes(flat, at, n), self.contexts[n])
            if isinstance(table := self.weights[n], Sparse):
                which, column, value = table.at(row[there])
                p[np.flatnonzero(there)[which], column] *= value
            else:
                p *= np.where(there[:, None], table[row], 1.0)
            row, there = _rows(_gram_hashes(flat, at, n), self.grams[n])
            if isinstance(table := self.shares[n], Sparse):
                which, column, value = table.at(row[there])
                p[np.flatnonzero(there)[which], column] += value
            else:
                p += np.where(there[:, None], table[row], 0.0)
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        sums = np.add.reduceat(-np.log2(p), np.cumsum(sizes) - sizes)
        return np.concatenate([sums, sizes[:, None]], axis=1)


def fitted(samples: list[tuple[str, bytes]], order: int = ORDER) -> Model | None:
    """A model of (language, text) pairs; a quarter of them only calibrates. None if there is nothing to learn from."""
    names = sorted({x for x, _ in samples})
    if not names:
        return None
    held = [i % 4 == 3 for i in range(len(samples))]
    counts: dict[str, Counter] = {x: Counter() for x in names}
    for (name, text), out in zip(samples, held, strict=True):
        if not out:
            counts[name].update(w for w in map(letters_of, words_of(text)) if w)
    for (name, text), out in zip(samples, held, strict=True):  # a language of which all texts were held out
        if out and not counts[name]:
            counts[name].update(w for w in map(letters_of, words_of(text)) if w)
    names = [x for x in names if counts[x]]
    if not names:
        return None
    symbols = len({c for x in names for w in counts[x] for c in w}) + 2
    per = [_counted(counts[x], order) for x in names]
    grams, shares, contexts, weights = [np.zeros(0)], [np.zeros(0)], [np.zeros(0)], [np.zeros(0)]
    for n in range(1, order + 1):
        g, c = (np.unique(np.concatenate([x[n][k] for x in per])) for k in (0, 2))
        grams.append(g)
        shares.append(_table(g, [(x[n][0], x[n][1]) for x in per], 0.0))
        contexts.append(c)
        weights.append(_table(c, [(x[n][2], x[n][3]) for x in per], 1.0))
    model = Model(names, order, grams, shares, contexts, weights, 1.0 / symbols)
    _calibrate(model, [s for s, out in zip(samples, held, strict=True) if out])
    return model


def _counted(words: Counter, order: int) -> dict[int, tuple]:
    """For each n: n-gram hashes and their discounted probabilities, context hashes and their back-off weights."""
    flat, at = _laid_out(list(words), order)
    times = np.repeat(np.fromiter(words.values(), np.float64), [len(w) + 1 for w in words])
    out = {}
    for n in range(order, 0, -1):
        own, ctx = _gram_hashes(flat, at, n), _context_hashes(flat, at, n)
        if n == order:
            grams, first, inverse = np.unique(own, return_index=True, return_inverse=True)
            count = np.bincount(inverse, times)
        else:  # continuation counts: of distinct (n+1)-grams that end in the n-gram
            _, one = np.unique(_gram_hashes(flat, at, n + 1), return_index=True)
            grams, where, inverse = np.unique(own[one], return_index=True, return_inverse=True)
            count, first = np.bincount(inverse).astype(np.float64), one[where]
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
        contexts, inverse = np.unique(ctx[first], return_inverse=True)
        total, kinds = np.bincount(inverse, count), np.bincount(inverse)
        out[n] = grams, np.maximum(count - discount, 0) / total[inverse], contexts, np.minimum(1.0, np.bincount(inverse, np.minimum(count, discount)) / total)
        assert len(kinds) == len(contexts)
    return out


class Scorer:
    """Sums of a text's word scores, with a cache of words."""

    def __init__(self, model: Model):
        self.model = model
        columns = len(model.languages) + 1
        self.most = min(CACHE_WORDS, CACHE_CELLS // columns)
        self.part = min(PART_WORDS, max(1, PART_WORDS * (DENSE_LANGUAGES + 1) // columns))
        self._empty()

    def _empty(self):
        self.known: dict[bytes, int] = {}
        self.scores = np.zeros((4096, len(self.model.languages) + 1))

    def totals(self, text: bytes | None) -> np.ndarray:
        """Bits by language and characters of a whole text."""
        words = words_of(text)
        rows = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(words) and rows.min() < 0:
            new = list(dict.fromkeys(words[i] for i in np.flatnonzero(rows < 0).tolist()))
            if len(self.known) + len(new) > self.most:
                self._empty()
                new = list(dict.fromkeys(words))
            at = len(self.known)
            while len(self.scores) < at + len(new):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            letters = [letters_of(w) for w in new]
            full = [i for i, w in enumerate(letters) if w]
            self.scores[at : at + len(new)] = 0
            for a in range(0, len(full), self.part):
                part = full[a : a + self.part]
                self.scores[at + np.array(part)] = self.model.bits([letters[i] for i in part])
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
            rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return self.scores[rows].sum(axis=0)

    def predict(self, text: bytes | None) -> tuple[str, float, float | None, bool]:
        """Language, score, bits a character, rejected."""
        *bits, size = self.totals(text)
        if not size:
            return UNKNOWN, 0.0, None, True
        mean = np.array(bits) / size
        best = int(np.argmin(mean))
        odds = np.exp2(-(mean - mean[best]) * self.model.sharpness)
        return self.model.languages[best], float(1 / odds.sum()), float(mean[best]), bool(mean[best] > self.model.limit)


def _calibrate(model: Model, held: list[tuple[str, bytes]]) -> None:
    """The rejection limit lies well above what labelled texts have (three times the distance from their median to
    the 99.5 % quantile beyond it, and more where few texts calibrate); the score's sharpness makes labels most likely."""
    scorer = Scorer(model)
    found = [(name, t[:-1] / t[-1]) for name, text in held if name in model.languages and (t := scorer.totals(text))[-1]]
    if not found:
        return
    best = np.array([x.min() for _, x in found])
    high, middle = np.quantile(best, 0.995), np.median(best)
    model.limit = float(high + 3 * (high - middle) + 0.5 + 8 / np.sqrt(len(best)))

    def likely(sharpness: float) -> float:
        return sum(float(np.log2(np.exp2(-(x - x.min()) * sharpness).sum())) + (x[model.languages.index(name)] - x.min()) * sharpness for name, x in found)

    model.sharpness = min((0.5, 1.0, 2.0, 4.0, 8.0, 16.0), key=likely)


def sample_bounds(labels: int, docs: int, size: int) -> tuple[int, int]:
    """Texts of a label and bytes of a text, so that all labels together keep to SAMPLE_TOTAL as long as LEAST_BYTES allow."""
    docs = max(min(docs, LEAST_DOCS), min(docs, SAMPLE_TOTAL // (max(1, labels) * size)))
    return docs, max(min(size, LEAST_BYTES), min(size, SAMPLE_TOTAL // (max(1, labels) * docs)))


def labelled_sample(docs: DataFrame, docs_per_language: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, bytes]]:
    """(lang, text) of the distinct texts with the least hashes in each language; null labels, null and empty texts are left out.

    Where a language has too few texts of `most_bytes` bytes at most, longer ones fill up its sample, each by the whole
    words among its first `most_bytes` bytes. Languages share out evenly by a first cut on the hash, so that few rows meet in the ranking.
    Both bounds shrink where there are very many labels, see sample_bounds().
    """
    labelled = docs.where("lang is not null and text <> ''")
    labels = labelled.select("lang").distinct().count()
    docs_per_language, most_bytes = sample_bounds(labels, docs_per_language, most_bytes)
    long, raw = F.octet_length("text") > most_bytes, F.col("text").cast("binary")
    labelled = labelled.select("lang", long.alias("_long"), F.when(long, F.substring(raw, 1, most_bytes)).otherwise(raw).alias("_body"))
    spread = F.pmod(F.xxhash64("_body"), F.lit(1 << 30))
    kinds = lambda of: F.approx_count_distinct(F.when(of, F.xxhash64("_body")))
    sizes = labelled.groupBy("lang").agg(kinds(~F.col("_long")).alias("_short_kinds"), kinds(F.col("_long")).alias("_long_kinds"))
    sizes = F.broadcast(sizes) if labels <= MOST_BROADCAST else sizes  # a row for each label
    below = lambda n: F.lit(float((1 << 30) * docs_per_language * 4)) / F.greatest(F.col(n), F.lit(1))
    cut = F.when(~F.col("_long"), below("_short_kinds")).when(F.col("_short_kinds") < 2 * docs_per_language, below("_long_kinds"))
    texts = labelled.join(sizes, "lang").where(spread < cut).select("lang", "_long", "_body").distinct()
    ranked = texts.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_long", spread, "_body"))).where(F.col("_n") <= docs_per_language)
    rows = ranked.orderBy(spread, "lang", "_body").select("lang", "_long", "_body").collect()
    return [(r["lang"], _whole_words(bytes(r["_body"])) if r["_long"] else bytes(r["_body"])) for r in rows]


def _whole_words(start: bytes) -> bytes:
    """The start of a text without the word that its end may cut, unless it is the only one."""
    return start.rsplit(None, 1)[0] if len(start.split(None, 1)) > 1 else start


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score (0 to 1), bits_per_char and rejected behind its own columns (clashing names get
    underscores in front). A null text or one without letters has lang_pred `und`, score 0, and is rejected; a text
    whose cross-entropy is above the calibrated limit is rejected too. Without a model all are `und`. Of languages with the
    same cross-entropy the first by name wins. Repeated rows are rows of their own with equal results; an empty table gives
    no rows. Texts of any length are scored whole."""
    names = docs.columns
    added = [free_name(names, x) for x in ("lang_pred", "score", "bits_per_char", "rejected")]
    kinds = dict(zip(added, ("string", "double", "double", "boolean"), strict=True))
    if model is None:
        return docs.select("*", F.lit(UNKNOWN).alias(added[0]), F.lit(0.0).alias(added[1]), F.lit(None).cast("double").alias(added[2]), F.lit(True).alias(added[3]))
    text_at = names.index("text")
    small_batches(docs.sparkSession)
    shared, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # of a bounded sample
    schema = docs.select("*", *(F.lit(None).cast(t).alias(n) for n, t in kinds.items())).schema

    def predict(batches):
        scorer = resident(("language", token), lambda: Scorer(shared.value))
        for batch in batches:
            texts = batch.column(text_at)
            found = [scorer.predict(t.as_py().encode("utf-8") if t.is_valid else None) for t in texts]
            columns = zip(*found, strict=True) if found else [()] * 4
            types = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*names, *added])

    return docs.mapInArrow(predict, schema)
