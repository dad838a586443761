"""Connected components and spanning forests of groups, distributed."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import discard, written


def settled(df: DataFrame, tag: str) -> DataFrame:
    """written(), after which Spark may drop the shuffle files that df needed."""
    out = written(df, tag)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


#: So few edges (16 bytes each) are one partition, as adaptive execution would make them; the algorithm is the same.
ONE_PARTITION = 250_000


def components(edges: DataFrame) -> DataFrame:
    """key, root of every vertex of edges (a, b: bigint); root is the least vertex of its component.

    Alternating large-star and small-star steps: each is a grouped minimum and a join back, so a vertex with
    very many edges is pre-aggregated, and the number of rounds grows with the logarithm of a component's width.
    """

    tables: list[DataFrame] = []

    def measured(df: DataFrame) -> tuple[DataFrame, tuple]:
        out = written(df, "cc")
        tables.append(out)
        seen = tuple(out.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        return fit(out, seen[0]), seen

    def fit(df: DataFrame, n: int) -> DataFrame:
        return df.coalesce(1) if n <= ONE_PARTITION else df

    now, seen = measured(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        n = seen[0]
        both = fit(now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), n)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = fit(large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b"))), n).distinct()
        last = seen
        now, seen = measured(small)
        discard(tables.pop(0))  # of the round before: nothing that is still to run reads it
        if last == seen:
            break
    return now.select(F.col("a").alias("key"), F.col("b").alias("root")).union(fit(now.select(F.col("b").alias("key"), F.col("b").alias("root")), n).distinct())


def group_forest(members: DataFrame, kernel, limit: int, payload: DataFrame | None = None, heavy: int | None = None) -> tuple[DataFrame, bool]:
    """Edges (a, b) of a spanning forest of each group's link graph, exact for groups of any size.

    members: grp, key (bigint) and, if `heavy` is given, weight, written, so that it can be read again; payload: further columns by key.
    kernel(rows with columns sub, key, comp and the payload's, grouped by sub) returns edges; keys of one comp need no edge between them.
    Second: whether edges reach beyond single calls, so that components() must put them together.

    Groups of over `limit` members or `heavy` weight are dealt into chunks. Each chunk is solved alone; then, round by round, one
    member for each component found so far stands for it, and components merge through them. What is left is
    exact: the members outside their group's largest component (none, if a group of copies became one component) are
    held against every chunk of the group, in blocks, and pairs in one component are skipped.
    """
    spare = lambda m: m if payload is None else m.join(payload, "key")
    no_comp = F.lit(None).cast("bigint").alias("comp")
    members = members if heavy else members.withColumn("weight", F.lit(0))
    load = F.sum(F.col("weight").cast("bigint")).alias("w")
    parts = F.ceil(F.greatest(F.col("n") / limit, F.col("w") / (heavy or 1))).cast("int")
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"), load).where(parts > 1)
    big = written(sizes.select("grp", parts.alias("chunks")), "big-groups")
    if not big.head(1):
        return kernel(spare(members.select(F.struct("grp", F.lit(0).alias("chunk"), F.lit(0).alias("block")).alias("sub"), "key", no_comp))), False

    def sub(chunk: Column, block: Column) -> Column:
        return F.struct("grp", chunk.cast("int").alias("chunk"), block.cast("int").alias("block")).alias("sub")

    dealt = members.join(big, "grp", "left").select("grp", "key", "weight", F.coalesce("chunks", F.lit(1)).alias("chunks"))
    chunk_of = F.pmod(F.xxhash64("key"), F.col("chunks"))
    edges = settled(kernel(spare(dealt.select(sub(chunk_of, F.lit(0)), "key", no_comp))), "forest")
    split = written(dealt.where("chunks > 1"), "split-groups")

    def labelled() -> DataFrame:
        roots = components(edges)
        return written(split.join(roots, "key", "left").select("grp", "key", "weight", "chunks", F.coalesce("root", "key").alias("comp")), "labelled")

    known = labelled()
    count, seed = None, 0
    while True:
        leaders = known.groupBy("grp", "comp").agg(F.min("key").alias("key"), F.min_by("weight", "key").alias("weight"))
        per = leaders.groupBy("grp").agg(F.count("*").alias("n"), load).where("n > 1")
        total = per.agg(F.sum("n")).first()[0] or 0
        if not total or count is not None and total > 0.9 * count:
            break
        count, seed = total, seed + 1
        found = kernel(spare(leaders.join(per, "grp").select(sub(F.pmod(F.xxhash64("key", F.lit(seed)), F.greatest(parts, F.lit(1))), F.lit(0)), "key", F.col("comp"))))
        edges = settled(edges.union(found), "forest")
        known = labelled()
    counts = known.groupBy("grp", "comp").agg(F.count("*").alias("n"))
    largest = counts.groupBy("grp").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    rest = known.join(largest, "grp").where("comp <> main")
    blocks = written(rest.groupBy("grp").agg(F.count("*").alias("n"), load).select("grp", F.greatest(parts, F.lit(1)).alias("blocks")), "rest-blocks")
    if blocks.head(1):
        left = known.join(blocks, "grp")
        chunked = left.select("grp", "key", "comp", F.pmod(F.xxhash64("key"), F.col("chunks")).alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        asking = rest.join(blocks, "grp").select("grp", "key", "comp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).alias("block"))
        both = chunked.select("grp", "key", "comp", F.col("chunk").cast("int"), F.col("block").cast("int")).union(asking.select("grp", "key", "comp", F.col("chunk").cast("int"), F.col("block").cast("int"))).distinct()
        found = kernel(spare(both.select(sub(F.col("chunk"), F.col("block")), "key", "comp")))
        edges = settled(edges.union(found), "forest")
    return edges, True
