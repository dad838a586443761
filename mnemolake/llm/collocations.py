"""Phrase collocation mining: counts of word n-grams within pieces of text, and the phrases whose parts mostly occur together.

Words are dictionary-encoded: a word's id is a 64-bit hash of language and word, and the dictionary holds the frequent ones. All words
are counted by id, with the least and the greatest word of each, so no two words share an id that matters unnoticed (then all ids are
made anew with another seed). An n-gram is a fixed-width binary key of ids; pieces break at words that are not in the dictionary, and
from three words on at pairs that are not frequent: no n-gram is more frequent than its parts. Tasks sort and run-length count what
they hold; keys are dealt by ranges of their hash, radix sorted within, and run-length counted again.

Dictionary and pairs reach the tasks as bits by hash, of a bounded number. A bit may stand for more than one, which only lets through
what the final counts drop.
"""

from __future__ import annotations

from collections import Counter
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.bits import collected_bits, has, width_for
from mnemolake.llm.common import LOWER, discard, resident, small_batches, written
from mnemolake.llm.shingles import mixed, placed_words

#: Counts and n-grams that a task holds before it hands them on, and bytes of a text that it splits at once.
HELD_WORDS, HELD_GRAMS, PIECE = 1 << 19, 1 << 20, 1 << 22
#: Bits for each member of a set, as powers of two, and the most of all: 32 MB.
BITS_EACH, FEWEST_BITS, MOST_BITS = 32, 1 << 20, 1 << 28
#: Words of a phrase, and its least count.
LONGEST, LEAST = 4, 30
#: Shares in which a language's phrases are ranked first.
SHARES = 64
#: A phrase goes if a longer one that holds it has at least SHARE hundredths of its count.
SHARE = 80

_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

#: Piece breaks become line feeds and tabs spaces, so words lie between white space; A-Z is lower-cased.
PLAIN = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in LOWER)


def _seed(lang: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8"), seed)


def ids_of(hashes: np.ndarray, lang: str, seed: int) -> np.ndarray:
    return mixed(hashes ^ _U(_seed(lang, seed)))


def placed_ids(text: bytes, lang: str, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id, first byte and byte behind the last of each word of a PLAIN text. Seed 0 hashes whole arrays; other seeds hash words one by one,
    so that words which collide in one way do not in the other."""
    hashes, first, behind = placed_words(text, PLAIN)
    if seed:
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b], seed) for a, b in zip(first.tolist(), behind.tolist(), strict=True)), _U, len(first))
    return ids_of(hashes, lang, seed), first, behind


def _texts(batch: pa.RecordBatch):
    """(lang, PLAIN text) of each row."""
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield lang, (text.as_py() or "").encode("utf-8").translate(PLAIN)


def pieces(data: bytes, size: int = PIECE):
    """data, cut between words into parts of about `size` bytes."""
    at = 0
    while len(data) - at > size:
        ends = [x for x in (data.find(b" ", at + size), data.find(b"\n", at + size)) if x >= 0]
        if not ends:
            break
        yield data[at : min(ends)]
        at = min(ends)
    yield data[at:]


def dictionary(docs: DataFrame, least: int) -> tuple[DataFrame, int]:
    """A written table of total, id, lang, word, n, and the seed of its ids: frequent words, and a row with total for each language's number of all words."""
    schema = "total boolean, id bigint, lang string, word string, n bigint"

    def made(seed: int) -> DataFrame:
        def batch(total: bool, lang: str, ids: np.ndarray, words: list, n: list):
            return pa.RecordBatch.from_arrays([pa.array([total] * len(n), pa.bool_()), pa.array(ids.view(np.int64)), pa.array([lang] * len(n), pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["total", "id", "lang", "word", "n"])

        def rows(held: dict[str, Counter]):
            for lang, counts in held.items():
                words = [*counts]
                ids, *_ = placed_ids(b" ".join(words), lang, seed)
                yield batch(False, lang, ids, [w.decode("utf-8") for w in words], [*counts.values()])
                yield batch(True, lang, np.array([_seed(lang, seed)], _U), [None], [sum(counts.values())])

        def counted(batches):
            resident()
            held: dict[str, Counter] = {}
            seen = 0
            for b in batches:
                for lang, text in _texts(b):
                    own = held.setdefault(lang, Counter())
                    for piece in pieces(text):
                        own.update(words := piece.split())
                        seen += len(words)
                    if seen >= HELD_WORDS:
                        seen = 0
                        if sum(map(len, held.values())) >= HELD_WORDS:
                            yield from rows(held)
                            held = {}
            yield from rows(held)

        ends = [f(c).alias(f"{k}_{c}") for c in ("lang", "word") for k, f in (("low", F.min), ("high", F.max))]
        counts = docs.mapInArrow(counted, schema).groupBy("total", "id").agg(F.sum("n").alias("n"), *ends).where(F.col("total") | (F.col("n") >= least))
        clash = (F.col("low_lang") != F.col("high_lang")) | ~F.col("low_word").eqNullSafe(F.col("high_word"))
        return written(counts.select("total", "id", F.col("low_lang").alias("lang"), F.col("low_word").alias("word"), "n", clash.alias("clash")), "phrase-words")

    for seed in count():
        table = made(seed)
        if table.where("clash").isEmpty():
            return table.drop("clash"), seed
        discard(table)


def _encoded(batches, seed: int):
    """(ids, numbers of pieces, how many of the words came already) of the texts of each language in each batch, part by part; a part begins
    with the last words of the one before, so no n-gram is cut."""
    for b in batches:
        texts: dict[str, list[bytes]] = {}
        for lang, text in _texts(b):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            ids, piece, base = np.zeros(0, _U), np.zeros(0, np.int64), 0
            for part in pieces(b"\n".join(own)):
                more, first, _ = placed_ids(part, lang, seed)
                breaks = np.flatnonzero(np.frombuffer(part, np.uint8) == 10)
                kept = max(0, len(ids) - LONGEST + 1)
                ids, piece, old = np.concatenate([ids[kept:], more]), np.concatenate([piece[kept:], base + np.searchsorted(breaks, first)]), len(ids) - kept
                base += len(breaks)
                yield ids, piece, old


def _bit(h: np.ndarray, width: int) -> np.ndarray:
    return h & _U(width - 1)


def gram_hash(ids: list[np.ndarray]) -> np.ndarray:
    """A hash that gives the last id from the others."""
    out = ids[-1].copy()
    for k, x in enumerate(ids[:-1]):
        out += x * _ODD[k]
    return out


def _run_lengths(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Columns h, k1, ..., n sorted by h: rows of equal keys become one, their n added up."""
    *keys, n = columns
    if not len(n):
        return columns
    new = np.ones(len(n), bool)
    new[1:] = keys[0][1:] != keys[0][:-1]
    other = np.zeros(len(n), bool)
    for k in keys[1:]:
        other[1:] |= k[1:] != k[:-1]
    if (other & ~new).any():  # different keys of one hash
        order = np.lexsort(keys[::-1])
        keys, n = [k[order] for k in keys], n[order]
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return [*(k[at] for k in keys), np.add.reduceat(n, at)]


_KEYS = ("h", "k1", "k2", "k3")


def count_grams(docs: DataFrame, sizes: tuple[int, ...], seed: int, words, pairs, least: int) -> DataFrame:
    """A written table of h, ids, n: the n-grams of these sizes that occur `least` times or more, with words among `words` and, from three words on,
    pairs among `pairs`. words, pairs: broadcasts of (bits, width); pairs may be None. Without its last id a key is k1, k2 and k3, as many as there are;
    the others are 0, which ids of fewer words might be, too, so sizes are counted apart."""
    names = [*_KEYS[: max(sizes)], "n"]

    def held_rows(held: list[list[np.ndarray]], size: int):
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        order = np.argsort(columns[0])
        h, *rest, n = _run_lengths([*(c[order] for c in columns), np.ones(len(order), np.int64)])
        rest += [np.zeros(len(h), _U)] * (len(names) - 2 - len(rest))
        for at in range(0, len(h), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h[cut]), size, np.int32)), *(pa.array(c[cut].view(np.int64)) for c in (h, *rest, n))], names=["size", *names])

    def gathered(batches):
        resident()
        held: dict[int, list] = {s: [] for s in sizes}
        some = dict.fromkeys(sizes, 0)
        bits, width = words.value
        pair_bits, pair_width = pairs.value if pairs is not None else (None, 0)
        for ids, piece, old in _encoded(batches, seed):
            if len(ids) < 2:
                continue
            known = has(bits, _bit(ids, width))
            link = known[:-1] & known[1:] & (piece[:-1] == piece[1:])
            if pairs is not None:
                at = np.flatnonzero(link)
                link[at] = has(pair_bits, _bit(gram_hash([ids[at], ids[at + 1]]), pair_width))
            for size in sizes:
                m = len(ids) - size + 1
                if m <= 0:
                    continue
                whole = link[:m].copy()
                for k in range(1, size - 1):
                    whole &= link[k : k + m]
                whole[: max(0, old - size + 1)] = False
                at = np.flatnonzero(whole)
                own = [ids[at + k] for k in range(size)]
                held[size].append([gram_hash(own), *own[:-1]])
                some[size] += len(at)
                if some[size] >= HELD_GRAMS:
                    yield from held_rows(held[size], size)
                    held[size], some[size] = [], 0
        for size in sizes:
            if some[size]:
                yield from held_rows(held[size], size)

    def run_lengths(batches):
        resident()
        kept = None

        def found(columns):
            size, h, *rest, n = columns
            frequent = np.flatnonzero(n >= least)
            size, h, n, rest = size[frequent], h[frequent], n[frequent], [k[frequent].view(_U) for k in rest]
            last = h.view(_U).copy()
            rows = []
            for s in sizes:
                own = np.flatnonzero(size == s)
                tail = last[own]
                for k in range(s - 1):
                    tail = tail - rest[k][own] * _ODD[k]
                rows.append((own, np.stack([*(rest[k][own] for k in range(s - 1)), tail], axis=1)))
            for own, ids in rows:
                if len(own):
                    flat = pa.array(ids.reshape(-1).view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(h[own]), pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * ids.shape[1]), flat), pa.array(n[own])], names=["h", "ids", "n"])

        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if kept is not None:
                columns = [np.concatenate(x) for x in zip(kept, columns, strict=True)]
            if not len(columns[-1]):
                continue
            # the hash leads, the size is one more part of the key
            h, size, *rest = _run_lengths([columns[1], columns[0], *columns[2:]])
            columns = [size, h, *rest]
            done = int(np.searchsorted(h, h[-1]))
            kept = [c[done:] for c in columns]
            yield from found([c[:done] for c in columns])
        if kept is not None:
            yield from found(kept)

    dealt = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.mapInArrow(gathered, "size int, " + ", ".join(f"{c} bigint" for c in names))
    ranges = keys.repartitionById(dealt, F.expr(f"cast(((shiftrightunsigned(h, 40) + {1 << 23}) % {1 << 24}) * {dealt} div {1 << 24} as int)"))  # hashes are even: equal ranges
    return written(ranges.sortWithinPartitions("h").mapInArrow(run_lengths, "h bigint, ids array<bigint>, n bigint"), "phrase-grams")


def _bits(spark, numbers: DataFrame, column: str):
    """A broadcast of the bits of a column of hashes, and their number."""
    width = width_for(numbers.count(), BITS_EACH, FEWEST_BITS, MOST_BITS)
    cells = numbers.select(F.col(column).bitwiseAND(F.lit(width - 1)).alias("cell"))
    return spark.sparkContext.broadcast((collected_bits(cells, width), width))


def _slices(ids: str, sizes: str) -> Column:
    """All contiguous parts of an array with sizes from the given SQL array."""
    return F.expr(f"flatten(transform({sizes}, s -> transform(sequence(1, size({ids}) - s + 1), i -> slice({ids}, i, s))))")


def scored(grams: DataFrame, singles: DataFrame, share: int) -> DataFrame:
    """ids, a, l, r, score of the n-grams that no longer one stands for. grams: ids, n of two words and more; singles: of one."""
    counts = grams.unionByName(singles)
    cuts = grams.select("ids", F.col("n").alias("a"), F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k"))
    cuts = cuts.withColumns({"left_ids": F.expr("slice(ids, 1, k)"), "right_ids": F.expr("slice(ids, k + 1, size(ids) - k)")})
    part = lambda ids, n: counts.select(F.col("ids").alias(ids), F.col("n").alias(n))
    met = cuts.join(part("left_ids", "l"), "left_ids").join(part("right_ids", "r"), "right_ids")
    score = F.expr("cast(cast(2000000 as decimal(10,0)) * cast(cast(a as decimal(20,0)) as decimal(38,0)) div (cast(cast(l as decimal(20,0)) as decimal(38,0)) + r) as bigint)")
    lowest = met.groupBy("ids").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"), F.max("a").alias("a"))
    longer = grams.where("size(ids) > 2").select(F.explode(_slices("ids", "sequence(2, size(ids) - 1)")).alias("ids"), "n").groupBy("ids").agg(F.max("n").alias("longer"))
    left = lowest.join(longer, "ids", "left").where(F.col("longer").isNull() | (F.expr(f"cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {share}")))
    return left.select("ids", "a", "m.l", "m.r", "m.score")


def mine_phrases(docs: DataFrame, least: int = LEAST, top: int = 2000, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to LONGEST words.

    a, l and r are the counts of the phrase and of its two parts at the cut that scores lowest (equal scores: the first cut), n all
    words of the language, score floor(2000000 a / (l + r)). Phrases with fewer than `least` occurrences don't count, and those go that lie in a
    longer one with `share` hundredths of their count or more. Order: score, then a, both falling, then the phrase's bytes.

    A null language is 'und', a null text empty; empty texts have no words. Equal rows count each, and counts include overlaps. A text of any
    length is read part by part. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    table, seed = dictionary(docs, least)
    words = table.where("not total")
    word_bits = _bits(spark, words, "id")
    twos = count_grams(docs, (2,), seed, word_bits, None, least)
    more = count_grams(docs, tuple(range(3, LONGEST + 1)), seed, word_bits, _bits(spark, twos, "h"), least)
    grams = twos.unionByName(more).select("ids", "n")
    found = written(scored(grams, words.select(F.array("id").alias("ids"), "n"), share), "phrase-scores")
    said = found.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    said = said.groupBy("ids").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each share of a language, so that its last task gets SHARES * top rows at most
    shares = found.join(said, "ids").withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    firsts = shares.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_n") <= top)
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    totals = table.where("total").select("lang", F.col("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
