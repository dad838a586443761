"""An index that follows its documents: a stored tree of digests finds what changed, changed documents alone are indexed anew.

The tree folds (path, digest) pairs by the first characters of the path's hash, so its root is the revision of the whole. Two trees are
compared from the root down, and only below nodes that differ. What changed becomes a new segment; bits mark its old places as dead. The list of
segments is a version of a manifest, so a search sees one state. merge_segments() makes one segment of all, without reading a text."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.operators import index as I
from mnemolake.operators.ranking import described
from mnemolake.operators.retrieval import small
from mnemolake.sources import manifest
from mnemolake.sources.scratch import materialised

#: Characters of the hash by level, from the root; leaves have LEAF.
LEVELS, LEAF = (0, 2, 4, 6), 8


def listing_of(docs: DataFrame) -> DataFrame:
    """path, digest of documents (path, text): for sources that do not list digests themselves."""
    return docs.select("path", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("digest"))


def write_tree(listing: DataFrame, path: str) -> str:
    """Store the tree of (path, digest) under path, a folder for each level, leaves dealt by their first two characters. Gives the revision."""
    spark = listing.sparkSession
    name = F.sha2(F.col("path").cast("string").cast("binary"), 256)
    leaves = listing.select(F.substring(name, 1, LEAF).alias("b"), F.col("path").cast("string").alias("k"), F.col("digest").alias("h")).withColumn("p", F.substring("b", 1, 2))
    leaves.repartition("p").sortWithinPartitions("b").write.partitionBy("p").parquet(f"{path}/leaves")
    nodes = spark.read.schema("b string, k string, h string, p string").parquet(f"{path}/leaves").select("b", "k", "h")
    for level in reversed(LEVELS):
        lists = nodes.groupBy(F.substring("b", 1, level).alias("b")).agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("l"))
        joined = F.array_join(F.transform("l", lambda x: F.concat(x["k"], F.lit("\0"), x["h"], F.lit("\0"))), "")
        lists.select("b", F.col("b").alias("k"), F.sha2(joined.cast("binary"), 256).alias("h")).write.parquet(f"{path}/level{level}")
        nodes = spark.read.parquet(f"{path}/level{level}")
    row = nodes.first()
    return f"content-{row['h'][:24]}" if row else "content-"


def changed_paths(spark: SparkSession, old: str, new: str) -> tuple[DataFrame, dict[int, int]]:
    """path, change (added, changed, removed) between two stored trees, and how many nodes were read at each level: only children of nodes that differ."""
    def level(path: str, n: int, parents: DataFrame | None) -> DataFrame:
        if n == LEAF:
            wanted = [r["p"] for r in parents.select(F.substring("b", 1, 2).alias("p")).distinct().collect()]  # 256 at most
            rows = spark.read.schema("b string, k string, h string, p string").parquet(f"{path}/leaves").where(F.col("p").isin(wanted))
        else:
            rows = spark.read.parquet(f"{path}/level{n}")
        if parents is not None:
            rows = rows.join(small(parents), F.substring(rows["b"], 1, max(0, n - 2)) == parents["b"], "left_semi")
        return rows.select("k", F.col("b").alias("_b"), "h")

    parents, read = None, {}
    for n in (*LEVELS, LEAF):
        a, b = (level(p, n, parents) for p in (old, new))
        both = a.select("k", F.col("_b").alias("_b1"), F.col("h").alias("_old")).join(b.select("k", F.col("_b").alias("_b2"), F.col("h").alias("_new")), "k", "full_outer")
        met = materialised(both, f"tree-{n}")
        read[n] = met.count()
        differ = met.where(~F.col("_old").eqNullSafe(F.col("_new")))
        if n == LEAF:
            change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
            return differ.select(F.col("k").alias("path"), change.alias("change")), read
        parents = materialised(differ.select(F.coalesce("_b1", "_b2").alias("b")).distinct(), "tree-differs")
    raise AssertionError


def refresh(docs: DataFrame, root: str, listing: DataFrame | None = None) -> dict:
    """Bring the index under root to the state of docs (doc_id, path, text; paths distinct); listing: (path, digest) as the source gives them,
    without which texts are digested. Gives the manifest: revision, segments, and indexed, the number of documents that were read for it."""
    spark = docs.sparkSession
    state = manifest.current(spark, root) or {"version": 0, "segments": [], "dead": None, "tree": None}
    tree, segment = f"trees/{uuid.uuid4().hex}", f"segments/{uuid.uuid4().hex}"
    revision = write_tree(listing_of(docs) if listing is None else listing, f"{root}/{tree}")
    if state["tree"] is None:
        changed, delta = None, docs
    elif revision == state["revision"]:
        return state
    else:
        changed = materialised(changed_paths(spark, f"{root}/{state['tree']}", f"{root}/{tree}")[0], "changed-paths")
        delta = docs.join(small(changed.where("change <> 'removed'").select("path")), "path", "left_semi")
    segments, indexed = list(state["segments"]), 0
    if changed is None or changed.where("change <> 'removed'").head(1):
        I.write_index(described(delta.select("doc_id", "path", "text")), f"{root}/{segment}", salt=segment)
        indexed = I.read_index(spark, f"{root}/{segment}").total.first()["total"]
        segments = [*segments, segment] if indexed or changed is None else segments
    dead = state["dead"]
    if changed is not None:
        places = read_segments(spark, root, state).pages.join(small(changed.select("path")), "path").select("block", F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot")).alias("dead"))
        if dead is not None:
            places = places.unionByName(spark.read.parquet(f"{root}/{dead}"))
        dead = f"dead/{uuid.uuid4().hex}"
        places.groupBy("block").agg(F.bit_or("dead").alias("dead")).write.parquet(f"{root}/{dead}")
    return _published(spark, root, {"segments": segments, "dead": dead, "tree": tree, "revision": revision, "indexed": indexed}, state["version"])


def _published(spark: SparkSession, root: str, content: dict, after: int) -> dict:
    return manifest.publish(spark, root, content | {"folders": [*content["segments"], *(x for x in (content["dead"], content["tree"]) if x)]}, after)


def read_segments(spark: SparkSession, root: str, state: dict | None = None) -> I.Index:
    """The index under root, of its newest version or a given one."""
    state = state or manifest.current(spark, root)
    rows = reduce(DataFrame.unionByName, (I.read_index(spark, f"{root}/{s}").rows for s in state["segments"]))
    return I.Index(rows, None if state["dead"] is None else spark.read.parquet(f"{root}/{state['dead']}"))


def merge_segments(spark: SparkSession, root: str) -> dict:
    """One segment in place of all, from what they hold: postings without dead documents, words that are left."""
    state = manifest.current(spark, root)
    whole, segment = read_segments(spark, root, state), f"segments/{uuid.uuid4().hex}"
    I.living(whole).write.parquet(f"{root}/{segment}/rows")
    return _published(spark, root, state | {"segments": [segment], "dead": None, "indexed": 0}, state["version"])
