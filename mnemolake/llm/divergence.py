"""Source divergence audit: how far the words of each source are from those of the other sources of its language.

Document frequencies are first sketched: every task adds its documents' distinct terms to the cells of a count-min sketch, and
cells are summed over all tasks. A cell is never below the frequency of any of its terms, so a term with a cell below the
limit is impossible and goes before anything of it is shuffled. Survivors are counted exactly, by language, source and term.

Pairs of sources are compared over the terms that both have: a term's counts are one row for each block of LANES sources, blocks
meet by term, and tasks keep sums for pairs of lanes only. What terms that one or neither has add is known from sums by source.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.bits import collected_bits, has, width_for
from mnemolake.llm.common import LOWER, resident, small_batches, written

#: Rows of the sketch; a term's cells are slices of one 64-bit hash.
ROWS = 2
#: Cells of a row for each document, as powers of two within these bounds. Only one bit of a cell is broadcast: 2^28 cells are 32 MB.
CELLS_A_DOCUMENT, FEWEST_CELLS, MOST_CELLS = 8, 1 << 16, 1 << 28
#: Counts that a task holds before it hands them on, and bytes of a text that it splits at once.
HELD, PIECE = 1 << 20, 1 << 22
#: Sources that meet in one row, and pairs of blocks of them whose sums a task holds.
LANES, HELD_BLOCKS = 32, 2048
#: Rows of groups that may be broadcast.
MOST_BROADCAST = 50_000
SCALE = 1_000_000_000

#: Letters and non-ASCII bytes; all else is a gap.
TERMS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in LOWER)


def pieces(data: bytes, size: int = PIECE):
    """data, cut at spaces into parts of about `size` bytes."""
    at = 0
    while len(data) - at > size:
        end = data.find(b" ", at + size)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def hashes(lang: str, terms: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode("utf-8"))
    return np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in terms), np.uint64, len(terms))


def cells_of(found: np.ndarray, width: int) -> np.ndarray:
    """ROWS numbers of cells for each hash; width is a power of two of at most 2^32."""
    return np.stack([((found >> np.uint64(32 * r)) & np.uint64(width - 1)).astype(np.int64) + r * width for r in range(ROWS)])


def _terms(batch: pa.RecordBatch, keys: int):
    """The first `keys` columns of each row, and its text's terms piece by piece."""
    for *key, text in zip(*(c.to_pylist() for c in batch.columns[:keys]), batch.column(keys), strict=True):
        yield tuple(key), (piece.split() for piece in pieces((text.as_py() or "").encode("utf-8").translate(TERMS)))


def _frequencies(batches):
    """Documents with each term, by language, in parts of about HELD entries."""
    held: dict[str, Counter] = {}
    seen = 0
    for batch in batches:
        for (lang,), parts in _terms(batch, 1):
            own: set[bytes] = set()
            for words in parts:
                own.update(words)
            held.setdefault(lang, Counter()).update(own)
            seen += len(own)
            if seen >= HELD and sum(map(len, held.values())) >= HELD:
                yield held
                held = {}
            if seen >= HELD:
                seen = 0
    yield held


def possible_terms(docs: DataFrame, least: int, width: int) -> np.ndarray:
    """The merged sketch as bits, ROWS * width of them: a bit is set where the cell has `least` or more."""

    def sketched(batches):
        resident()
        for held in _frequencies(batches):
            cells = [np.repeat(np.array([*c.values()], np.int64)[None], ROWS, 0).ravel() for c in held.values()]
            at = [cells_of(hashes(lang, [*c]), width).ravel() for lang, c in held.items()]
            if not at:
                continue
            cell, inverse = np.unique(np.concatenate(at), return_inverse=True)
            sums = np.bincount(inverse, np.concatenate(cells).astype(np.float64), len(cell)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums)], names=["cell", "n"])

    merged = docs.select("lang", "text").mapInArrow(sketched, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return collected_bits(merged, ROWS * width)


def exact_counts(docs: DataFrame, bits, width: int) -> DataFrame:
    """lang, source, term, n, documents of the terms that the sketch lets pass: occurrences by source (documents 0), and, where source is null, the documents of the
    language that have the term (n 0). bits: a broadcast of possible_terms()."""
    names = ["lang", "source", "term", "n", "documents"]

    def rows(lang: str, source: str | None, counts: Counter):
        terms = [*counts]
        keep = np.flatnonzero(has(bits.value, cells_of(hashes(lang, terms), width)).all(axis=0)) if terms else np.zeros(0, np.int64)
        own = pa.array(terms, pa.binary()).take(pa.array(keep)).cast(pa.string())
        found = pa.array(np.fromiter(counts.values(), np.int64, len(counts))[keep])
        none = pa.array(np.zeros(len(keep), np.int64))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keep), pa.string()), pa.array([source] * len(keep), pa.string()), own, *((found, none) if source is not None else (none, found))], names=names)

    def counted(batches):
        resident()
        held: dict[tuple, Counter] = {}
        seen = 0
        for batch in batches:
            for (lang, source), parts in _terms(batch, 2):
                counts, documents = held.setdefault((lang, source), Counter()), held.setdefault((lang, None), Counter())
                own: set[bytes] = set()
                for words in parts:
                    counts.update(words)
                    own.update(words)
                documents.update(own)
                seen += len(own)
                if seen >= HELD:
                    seen = 0
                    if sum(map(len, held.values())) >= HELD:
                        for key, c in held.items():
                            yield rows(*key, c)
                        held = {}
        for key, c in held.items():
            yield rows(*key, c)

    found = docs.select("lang", "source", "text").mapInArrow(counted, "lang string, source string, term string, n bigint, documents bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def _p(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exact; null without any terms."""
    wide = lambda x: f"cast(cast({x} as decimal(20,0)) as decimal(38,0))"
    return F.expr(f"case when {terms} > 0 then 1 + (cast({SCALE} as decimal(10,0)) * ({wide(n)} + 2)) div ({wide(total)} + 2 * {wide(terms)}) end")


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def _shared(blocks: DataFrame) -> DataFrame:
    """lang, a, b, value of the ordered pairs of sources with common terms: the sum over these of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0),
    p0 and q0 being what a term without occurrences has there. blocks: lang, term, block, cells (number, p, p0)."""
    other = blocks.select("lang", "term", F.col("block").alias("block_b"), F.col("cells").alias("cells_b"))
    met = blocks.join(other, ["lang", "term"]).where("block <= block_b").select("lang", "block", "block_b", "cells", "cells_b")

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    def rows(sums: dict):
        for (lang, i, j), m in sums.items():
            a, b = np.nonzero(m)
            value, at, to = m[a, b], a + i * LANES, b + j * LANES
            off = at != to
            at, to, value = at[off], to[off], value[off]
            if i != j:  # the other way round
                at, to, value = np.concatenate([at, to]), np.concatenate([to, at]), np.concatenate([value, value])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(to), pa.array(value)], names=["lang", "a", "b", "value"])

    def summed(batches):
        resident()
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            keys = zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)
            sides = []
            for column in batch.columns[3:]:
                offsets, flat = column.offsets.to_numpy(), column.values
                sides.append((offsets, *(flat.field(k).to_numpy() for k in range(3))))
            for r, key in enumerate(keys):
                (na, p, p0), (nb, q, q0) = ([x[o[r] : o[r + 1]] for x in fields] for o, *fields in sides)
                m = sums.get(key)
                if m is None:
                    if len(sums) >= HELD_BLOCKS:
                        yield from rows(sums)
                        sums.clear()
                    m = sums[key] = np.zeros((LANES, LANES), np.int64)
                p, p0 = p[:, None], p0[:, None]
                m[np.ix_(na % LANES, nb % LANES)] += f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
        yield from rows(sums)

    return met.mapInArrow(summed, "lang string, a bigint, b bigint, value bigint")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def audit_sources(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value, rank, for each (lang, source) of docs.

    A language keeps the terms of `least` of its documents or more. p is a term's smoothed share of a source's words, in parts of
    SCALE, q that in another source (pairs: the sum of f = floor((p - q)^2 / (p + q)) over all kept terms) or in the whole language
    (terms: the `top` of those that the source uses more). Ties go by the item's bytes.

    Null text, language and source are ''. Texts without terms, and empty ones, still make their group occur; a source alone in its
    language has no pairs, a language without kept terms has pairs of value 0. Repeated rows count each; long texts are split piece by
    piece. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    width = width_for(docs.count(), CELLS_A_DOCUMENT, FEWEST_CELLS, MOST_CELLS)
    counts = written(exact_counts(docs, spark.sparkContext.broadcast(possible_terms(docs, least, width)), width), "audit-counts")
    terms = counts.where("source is null").where(F.col("documents") >= least).select("lang", "term")
    found = counts.where("source is not null").select("lang", "source", "term", "n").join(terms, ["lang", "term"])
    kept = written(found.withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang", "term"))), "audit-kept")  # a row for each source at most

    langs = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint") - 1
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_total")), number.alias("number"))
    groups = written(groups.withColumn("p0", _p("0", "total", "v")), "audit-groups")
    n = groups.count()
    seen = kept.join(_small(groups, n), ["lang", "source"]).withColumns({"p": _p("n", "total", "v"), "q": _p("lang_n", "lang_total", "v")})
    seen = written(seen.select("lang", "source", "number", "term", "p", "p0", "q"), "audit-shares")
    return _top_terms(seen, top).unionByName(_pairs(groups, n, seen))


def _top_terms(seen: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = seen.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _pairs(groups: DataFrame, n: int, seen: DataFrame) -> DataFrame:
    """The sum over all kept terms is that of terms that neither has, plus what a's terms add to it, plus what b's do, plus what both have."""
    others = groups.select("lang", F.col("number").alias("b"), F.col("p0").alias("q0"), "v")
    mine = groups.select("lang", F.col("number").alias("a"), "p0")
    neither = mine.join(_small(others, n), "lang").where("a <> b").select("lang", "a", "b", F.expr(f"coalesce(v * {_f('p0', 'q0')}, 0)").alias("value"))
    alike = seen.groupBy("lang", F.col("number").alias("a"), "p", "p0").agg(F.count("*").alias("m"))  # terms of equal share add alike
    one = alike.join(_small(others, n), "lang").where("a <> b").select("lang", "a", "b", F.expr(f"m * ({_f('p', 'q0')} - {_f('p0', 'q0')})").alias("value"))
    one = one.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    turned = one.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    blocks = seen.groupBy("lang", "term", F.expr(f"number div {LANES}").alias("block")).agg(F.collect_list(F.struct("number", "p", "p0")).alias("cells"))  # LANES at most
    sums = neither.unionByName(one).unionByName(turned).unionByName(_shared(blocks)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = lambda at, to: groups.select("lang", F.col("number").alias(at), F.col("source").alias(to))
    named = sums.join(_small(name("a", "source"), n), ["lang", "a"]).join(_small(name("b", "item"), n), ["lang", "b"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
