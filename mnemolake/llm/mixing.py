"""Mixing sources to target weights, with DataFrame operations only.

Words are summed by source. Every source gets a target: a share of all words by its weight, but at most `most` times what it
has; what is over goes to the others by weight until no target is above its limit. The rate of a source is its target by its
words. A document is taken floor(rate) times, and once more if a hash of it falls below the rate's fraction.

Sources are as many as there are, so nothing of them is gathered on the driver: they are numbered by a range sort, and the
common level of the targets is found by a few sums over their table. All that decides a copy is an integer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import discard, free_name, written

#: Weights by a source's number in code point order, repeating; null comes last.
WEIGHTS = (3, 1, 2)
#: The mix has SHARE[0] / SHARE[1] of all words.
SHARE = (3, 2)
#: A target is at most so many times its source's words.
MOST = 2
#: Hash bits that decide the copy by chance.
CHANCE_BITS = 40
#: Sources that may be broadcast; the rows of a source are dealt over SALTS keys beyond that.
MOST_BROADCAST = 50_000
SALTS = 64

_GAP = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; of null none. Every run with the gaps around it shrinks to one sign, so a long text makes no array of words."""
    runs = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{_GAP}]*+[^{_GAP}]++[{_GAP}]*+", "x")
    return F.octet_length(F.btrim(runs, F.lit(" \t\n\x0b\x0c\r"))).cast("bigint")


def chance(doc_id: Column, text: Column, seed: int) -> Column:
    """A number from 0 to 2^CHANCE_BITS - 1, by seed, id and text; equal rows have equal ones."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, CHANCE_BITS // 4), 16, 10).cast("bigint")


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """source, source_size with the source's number by code point, null last: a range sort, and what lies before each range."""
    ranged = written(sizes.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))  # a row for each range
    before = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").isNull(), "source")) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_range").select("source", "source_size", (F.col("_before") + F.col("_own")).alias("number"))


def source_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """For a table of (source, source_size): also target, whole (sure copies of a document) and below (the number below which its chance gives one more).

    The targets are min(limit, weight * level). The level starts as if there were no limits and is found anew for the sources within
    theirs until no more leave; it only rises, and a source that has left stays out."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights)).cast("int") + 1).cast("bigint")
    table = written(numbered_sources(sizes).withColumn("weight", w), "mix-sources")
    exact = lambda c: F.col(c).cast("decimal(20,0)").cast("decimal(38,0)")
    total, all_weights = table.agg(F.sum("source_size"), F.sum("weight")).first()
    level, by, left = share[0] * (total or 0), share[1] * (all_weights or 1), None
    while True:
        full = exact("weight") * F.lit(level).cast("decimal(38,0)") >= exact("source_size") * F.lit(most * by).cast("decimal(38,0)")
        out, rest = table.agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if (out, rest) == left or not rest:
            break
        left = (out, rest)
        level, by = share[0] * total - share[1] * most * (out or 0), share[1] * rest
    parts = exact("weight") * F.lit(level).cast("decimal(38,0)")
    own = exact("source_size") * F.lit(by).cast("decimal(38,0)")
    rate = table.withColumns({"_full": full, "_parts": parts, "_own": own}).withColumn("whole", F.when(F.col("_full"), F.when(F.col("source_size") > 0, most).otherwise(0)).otherwise(F.expr("_parts div _own")).cast("int"))
    return rate.select(
        "source", "source_size", F.when(F.col("_full"), (most * F.col("source_size")).cast("double")).otherwise(F.col("_parts").cast("double") / F.lit(float(by))).alias("target"), "whole",
        F.when(F.col("_full"), 0).otherwise(F.expr(f"((_parts - whole * _own) * cast({1 << CHANCE_BITS} as decimal(38,0))) div _own")).cast("bigint").alias("below"),
    )


def _planned(rows: DataFrame, plan: DataFrame, source: str, u: str) -> tuple[DataFrame, dict[str, str]]:
    """rows with the columns of their source's plan and their copies, and the names that these have there."""
    plan = written(plan, "mix-plan")
    names = {c: free_name(rows.columns, f"mix_{c}") for c in (*plan.columns, "salt", "copies")}
    renamed = plan.select(*(F.col(c).alias(names[c]) for c in plan.columns))
    same = F.col(f"`{source}`").eqNullSafe(F.col(names["source"]))
    if plan.count() <= MOST_BROADCAST:
        joined = rows.join(F.broadcast(renamed), same)
    else:
        salted = renamed.withColumn(names["salt"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(salted, same & (F.col(names["salt"]) == F.col(f"`{u}`") % SALTS))
    return joined.withColumn(names["copies"], (F.col(names["whole"]) + (F.col(f"`{u}`") < F.col(names["below"])).cast("int")).cast("int")), names


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), chance(F.col("doc_id"), text, seed).alias("u"))


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, seed: int = 13) -> DataFrame:
    """A row for each document: doc_id, size (words), source_size (words of its source), target (its source's), copies.

    A null source is one of its own, the last. Null, empty and blank texts have size 0 and copies by their chance, which take no
    words. Repeated rows are rows of their own and share their chance, as do equal rows without an id. A source without words has
    the target 0 and no copies; an empty table gives no rows. Texts of any length are counted whole. Other columns are ignored.
    """
    records = written(_measured(docs, seed), "mix-records")
    plan = source_plan(records.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    done, names = _planned(records, plan, "source", "u")
    return done.select("doc_id", "size", *(F.col(names[c]).alias(c) for c in ("source_size", "target", "copies")))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, seed: int = 13) -> DataFrame:
    """The mixture itself: docs' own columns, each document as often as mix_counts() says, with its number from 1 in the column copy
    (behind its own; a clashing name gets an underscore in front). Odd rows are as there."""
    records = written(_measured(docs, seed).groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    plan = source_plan(records, weights, share, most)
    text, u, copy = F.col("text").cast("string"), free_name(docs.columns, "u"), free_name(docs.columns, "copy")
    done, names = _planned(docs.withColumn(u, chance(F.col("doc_id"), text, seed)), plan, "source", u)
    copies = F.col(names["copies"])
    out = done.where(copies > 0).select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), copies)).alias(copy))
    discard(records)
    return out
