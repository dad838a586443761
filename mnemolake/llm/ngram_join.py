"""N-gram Jaccard join by prefix trees.

A text is the set of its distinct word shingles, as 64-bit hashes. All sets share one order: frequent
shingles last, otherwise by hash. Two sets with a Jaccard likeness of t or more have a common shingle among
the first n - ceil(t n) + 1 of either (the prefix), so sets meet in groups by prefix shingle. In a group, a pair goes on if
its sizes and the parity sketches of the sets (a bit for each hash cell, flipped by every member; sets
that differ in d shingles have sketches that differ in d bits at most) do not rule it out. Groups with the same
members are one, and only the connected components of these
pairs are kept, never the pairs. Inside a component, the whole sets are stored, in the shared order, in a prefix tree; a set is looked up by walking
the tree with the overlap that its paths share, and subtrees are left out where the sizes and the remaining lengths cannot
reach the bound, or where all sets are in one component with it already.

Equal sets are one vertex from the start. Result: connected components of the exact links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import resident, small_batches, written
from mnemolake.llm.components import components, group_forest, settled
from mnemolake.llm.shingles import mixed, shingle_hashes, word_hashes

#: A shingle is frequent if it is in so many distinct sets of those that a task sees one after another ...
LOCAL_SETS, LOCAL_COUNT = 4096, 4
#: ... and in so many of all. Of more than FREQUENT_MOST, the most frequent count; this only shapes the order.
FREQUENT_COUNT, FREQUENT_MOST = 32, 1 << 18
#: Members of a group that one call compares at once, and shingles of the sets that one call puts into a tree; larger groups are dealt out, see group_forest().
PREFIX_GROUP, TREE_GROUP, TREE_SHINGLES = 4096, 512, 1 << 21
#: A parity sketch has a power of two of bits, so many at least, and three times the difference that linked sets of the size may have.
LEAST_BITS = 256
#: Rows of one shingle that are held to compare a group's members with other groups'.
HELD_ROWS = 1 << 20
#: Cells of the filter in front of the second reading of texts.
CELLS = 1 << 18
#: Rows (of about 50 bytes) of near sets, or of documents that go, that may be broadcast to the texts; of more, both sides are shuffled.
MOST_BROADCAST = 500_000


class Bound:
    """Jaccard likeness of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def overlap(self, n: int, m: int) -> int:
        """Least intersection of linked sets of n and m members."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def bits(self, n: int) -> int:
        most = 2 * n * (self.den - self.num) // (self.den + self.num)
        return max(LEAST_BITS, 1 << (3 * most).bit_length())

    def links(self, common: int, n: int, m: int) -> bool:
        return self.den * common >= self.num * (n + m - common)


def frequent_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of the shingles that many texts have; counted over all texts, FREQUENT_MOST at most."""

    def count(batches):
        resident()
        seen: set[bytes] = set()
        held: list[np.ndarray] = []

        def out():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= LOCAL_COUNT
            held.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], names=["token", "n"])

        size = 0
        for batch in batches:
            for text in batch.column(0):
                tokens = shingle_hashes(word_hashes(text.as_py()), words)
                digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                if len(tokens) and digest not in seen:
                    seen.add(digest)
                    held.append(tokens)
                    size += len(tokens)
                    if len(held) >= LOCAL_SETS or size > 4_000_000:
                        yield out()
                        size = 0
        if held:
            yield out()

    found = docs.select(F.col("text").cast("binary")).mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = found.where(F.col("n") >= FREQUENT_COUNT).orderBy(F.desc("n"), "token").limit(FREQUENT_MOST)
    return np.sort(np.array([r["token"] for r in top.select("token").collect()], np.int64).view(np.uint64))


def ordered(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """tokens, sorted by hash, in the shared order: as numbers that ascend in it, frequent shingles in the upper half."""
    ranks = tokens >> np.uint64(1)
    if not len(frequent) or not len(tokens):
        return ranks
    last = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
    return np.concatenate([ranks[~last], ranks[last] | np.uint64(1 << 63)])


def parity(tokens: np.ndarray, bits: int) -> bytes:
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def shingled(docs: DataFrame, words: int, bound: Bound, shared) -> DataFrame:
    """shared: the frequent shingles, broadcast. A written row for each document: doc_id, text_hash, n_shingles, key (hash of the set; null if empty), digest, and, for the
    first of equal sets that a task sees, parity and prefix (array of shingles)."""
    spark = docs.sparkSession
    small_batches(spark)
    names = ["doc_id", "text_hash", "n_shingles", "key", "digest", "parity", "prefix"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]

    def made(batches):
        resident()
        frequent = shared.value
        seen: set[bytes] = set()
        for batch in batches:
            rows, size = [], 0
            for doc_id, text_hash, text in zip(*batch.columns, strict=True):
                tokens = shingle_hashes(word_hashes(text.as_py()), words)
                if not len(tokens):
                    rows.append((doc_id.as_py(), text_hash.as_py(), 0, None, None, None, None))
                    continue
                digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                first = digest not in seen
                if first:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(digest)
                prefix = ordered(tokens, frequent)[: bound.prefix(len(tokens))].view(np.int64) if first else None
                size += 0 if prefix is None else len(prefix)
                rows.append((doc_id.as_py(), text_hash.as_py(), len(tokens), int.from_bytes(digest[:8], "little", signed=True), digest, parity(tokens, bound.bits(len(tokens))) if first else None, prefix))
                if size > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("binary")).alias("text_hash"), F.col("text").cast("binary").alias("text"))
    sets = written(source.mapInArrow(made, "doc_id bigint, text_hash bigint, n_shingles bigint, key bigint, digest binary, parity binary, prefix array<bigint>"), "shingled")
    clashes = written(sets.where("key is not null").groupBy("key").agg((F.min("digest") != F.max("digest")).alias("clash")).where("clash").select("key"), "clashes")
    if clashes.head(1):  # different sets with equal keys: those get keys from a hash of all their bits
        marked = sets.join(clashes.withColumn("clash", F.lit(True)), "key", "left")
        sets = written(marked.withColumn("key", F.when(F.col("clash"), F.xxhash64("digest")).otherwise(F.col("key"))).select(*names), "shingled")
    return sets


def shared_postings(sets: DataFrame) -> DataFrame:
    """grp, key: the sets that meet at some prefix shingle. A group's name is a hash of its members, so that the many shingles that
    the same sets share make one group (a clash of names joins two groups, which only adds comparisons)."""
    spark = sets.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def groups(batches):
        told: set[int] = set()
        tokens, keys = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last shingle's rows so far
        spilled = None  # a shingle with more rows than are held: they go out under its own name

        def out(names, members):
            return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(members)], names=["grp", "key"])

        def whole(tokens, keys):
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
            tokens, keys = tokens[new], keys[new]
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            sizes = np.diff(np.append(starts, len(tokens)))
            names = mixed(np.add.reduceat(mixed(keys.view(np.uint64)), starts) ^ sizes.astype(np.uint64))
            _, first = np.unique(names, return_index=True)
            fresh = np.zeros(len(names), bool)
            fresh[first] = True
            fresh &= sizes > 1
            at = np.flatnonzero(fresh)
            fresh[at] = [x not in told for x in names[at].tolist()]
            if len(told) > 500_000:
                told.clear()
            told.update(names[fresh].tolist())
            keep = np.repeat(fresh, sizes)
            return out(np.repeat(names, sizes)[keep], keys[keep])

        for batch in batches:
            more = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if spilled is not None:
                own = more[0] == spilled
                if own.any():
                    yield out(mixed(more[0][own].view(np.uint64)), more[1][own])
                more = more[0][~own], more[1][~own]
                if not len(more[0]):
                    continue
                spilled = None
            tokens, keys = np.concatenate([tokens, more[0]]), np.concatenate([keys, more[1]])
            last = int((tokens != tokens[-1]).sum())
            if last:
                yield whole(tokens[:last], keys[:last])
                tokens, keys = tokens[last:], keys[last:]
            if len(tokens) > HELD_ROWS:
                spilled = tokens[0]
                yield out(mixed(tokens.view(np.uint64)), keys)
                tokens, keys = tokens[:0], keys[:0]
        if len(tokens):
            yield whole(tokens, keys)

    postings = sets.where("prefix is not null").select(F.explode("prefix").alias("token"), "key")
    return settled(postings.repartition(n, "token").sortWithinPartitions("token", "key").mapInArrow(groups, "grp bigint, key bigint").distinct(), "postings")


def _by_sub(rows: DataFrame, order: list[str]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "sub").sortWithinPartitions("sub", *order)


def _groups(batches):
    """Lists of rows (as tuples without sub) with equal sub, from sorted batches."""
    last, rows = None, []
    for batch in batches:
        subs = batch.column(0)
        columns = [c.to_pylist() for c in batch.columns[1:]]
        marks = list(zip(*(np.asarray(subs.field(i)).tolist() for i in range(3)), strict=True))
        for mark, row in zip(marks, zip(*columns, strict=True), strict=True):
            if mark != last:
                if len(rows) > 1:
                    yield rows
                last, rows = mark, []
            rows.append(row)
    if len(rows) > 1:
        yield rows


def _edge_batches(groups, solve):
    edges: list[tuple[int, int]] = []
    for rows in groups:
        edges += solve(rows)
        if len(edges) > 50_000:
            yield _edges(edges)
            edges = []
    yield _edges(edges)


def _edges(edges):
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def sketch_kernel(bound: Bound):
    """Forest of the pairs of a group that sizes and parity sketches do not rule out. Payload: n, parity."""

    def solve(rows):
        rows = list({r[0]: r for r in rows}.values())
        keys = [r[0] for r in rows]
        n = np.array([r[2] for r in rows], np.int64)
        sketches = [np.frombuffer(r[3], np.uint8) for r in rows]
        width = np.array([len(x) for x in sketches])
        tables, place = {}, np.zeros(len(rows), np.int64)
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            place[own] = np.arange(len(own))
            tables[w] = np.stack([sketches[i] for i in own.tolist()]).view(np.uint64)
        first: dict[int, int] = {}
        label = np.array([first.setdefault(r[1], i) if r[1] is not None else i for i, r in enumerate(rows)], np.int64)
        edges, low = [], 0
        for i in range(1, len(rows)):
            while bound.den * n[low] < bound.num * n[i]:
                low += 1
            at = low + np.flatnonzero(label[low:i] != label[i])
            if not len(at):
                continue
            own = tables[width[i]][place[i]]
            while len(at) and len(own):
                w = len(own) * 8
                here = at[width[at] == w]
                at = at[width[at] < w]
                if len(here):
                    apart = np.bitwise_count(tables[w][place[here]] ^ own).sum(axis=1, dtype=np.int64)
                    for j in here[apart * (bound.den + bound.num) <= (n[here] + n[i]) * (bound.den - bound.num)].tolist():
                        if label[j] != label[i]:
                            edges.append((keys[i], keys[j]))
                            label[label == label[i]] = label[j]
                own = own[: len(own) // 2] ^ own[len(own) // 2 :]  # the same sketch with half the cells
        return edges

    def kernel(rows: DataFrame) -> DataFrame:
        given = _by_sub(rows.select("sub", "key", "comp", "n", "parity"), ["n", "key"])
        return given.mapInArrow(lambda batches: _edge_batches(_groups(batches), solve), "a bigint, b bigint")

    return kernel


class PrefixTree:
    """Sets of sorted hashes, with compressed edges, that keeps the components of its linked sets."""

    __slots__ = ("bound", "edge", "kids", "least", "most", "mark", "ends", "parent")

    def __init__(self, bound: Bound):
        self.bound = bound
        # of each node: edge, children by first hash, least and greatest size below, a set of the one component below (None: several), sets that end here
        self.edge, self.kids, self.least, self.most, self.mark, self.ends = [np.zeros(0, np.uint64)], [{}], [1 << 62], [0], [-1], [[]]
        self.parent: list[int] = []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y

    def _node(self, edge, kids, least, most, mark, ends) -> int:
        for held, x in ((self.edge, edge), (self.kids, kids), (self.least, least), (self.most, most), (self.mark, mark), (self.ends, ends)):
            held.append(x)
        return len(self.edge) - 1

    def lookup(self, x: int, tokens: np.ndarray) -> list[int]:
        """Sets that link x to components other than its own; x joins them."""
        n, bound, out = len(tokens), self.bound, []
        small, large = -(-bound.num * n // bound.den), bound.den * n // bound.num
        stack = [(child, 0, 0, 0) for child in self.kids[0].values()]
        while stack:
            node, common, depth, at = stack.pop()
            if self.most[node] < small or self.least[node] > large:
                continue
            mark = self.mark[node]
            if mark is not None and self.find(mark) == self.find(x):
                continue
            edge = self.edge[node]
            place = np.searchsorted(tokens[at:], edge) + at
            common += int((tokens[np.minimum(place, n - 1)] == edge).sum())
            depth += len(edge)
            at = int(np.searchsorted(tokens[at:], edge[-1], "right")) + at
            if common + min(n - at, self.most[node] - depth) < bound.overlap(n, max(self.least[node], small)):
                continue
            for y in self.ends[node]:
                if bound.links(common, n, depth) and self.union(x, y):
                    out.append(y)
            stack += [(child, common, depth, at) for child in self.kids[node].values()]
        return out

    def insert(self, x: int, tokens: np.ndarray) -> None:
        node, at, n = 0, 0, len(tokens)
        while True:
            if node:
                self.least[node], self.most[node] = min(self.least[node], n), max(self.most[node], n)
                if self.mark[node] is not None and self.find(self.mark[node]) != self.find(x):
                    self.mark[node] = None
            if at == n:
                self.ends[node].append(x)
                return
            child = self.kids[node].get(int(tokens[at]))
            if child is None:
                self.kids[node][int(tokens[at])] = self._node(tokens[at:], {}, n, n, x, [x])
                return
            edge = self.edge[child]
            m = min(len(edge), n - at)
            differ = np.flatnonzero(edge[:m] != tokens[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(edge):  # the child's edge is split
                lower = self._node(edge[same:], self.kids[child], self.least[child], self.most[child], self.mark[child], self.ends[child])
                self.edge[child], self.kids[child], self.ends[child] = edge[:same], {int(edge[same]): lower}, []
            node, at = child, at + same


def tree_kernel(bound: Bound, words: int, shared):
    """Forest of the exact links of a group. Payload: text. shared: the frequent shingles, broadcast."""

    def solve(rows):
        tree, keys, edges, comps = PrefixTree(bound), [], [], {}
        for key, comp, text in {r[0]: r for r in rows}.values():
            x = len(keys)
            tokens = ordered(shingle_hashes(word_hashes(text), words), shared.value)
            keys.append(key)
            tree.parent.append(x)
            if comp is not None:
                tree.union(x, comps.setdefault(comp, x))
            edges += [(key, keys[y]) for y in tree.lookup(x, tokens)]
            tree.insert(x, tokens)
        return edges

    def kernel(rows: DataFrame) -> DataFrame:
        given = _by_sub(rows.select("sub", "key", "comp", "text"), ["key"])
        return given.mapInArrow(lambda batches: _edge_batches(_groups(batches), solve), "a bigint, b bigint")

    return kernel


def _place():
    """What rows are put in order by: null ids come last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")


def linked_sets(docs: DataFrame, sets: DataFrame, words: int, bound: Bound, shared, prefix_group: int = PREFIX_GROUP, tree_group: int = TREE_GROUP, tree_shingles: int = TREE_SHINGLES) -> DataFrame:
    """key, root of the sets that have links to other sets."""
    sketches = sets.where("prefix is not null").groupBy("key").agg(F.min("n_shingles").alias("n"), F.min("parity").alias("parity"))
    edges, _ = group_forest(shared_postings(sets), sketch_kernel(bound), prefix_group, sketches)
    near = components(settled(edges, "near-forest"))
    firsts = sets.where("key is not null").groupBy("key").agg(F.min(_place()).alias("first"), F.min("n_shingles").alias("weight"))
    chosen = written(near.join(firsts, "key").select("key", "weight", F.col("root").alias("grp"), F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash")), "near-sets")
    # texts of the chosen only: a filter on hash cells (CELLS rows at most) spares the shuffle most of the others
    cell = lambda c: F.pmod(c, F.lit(CELLS))
    cells = chosen.select(cell(F.col("text_hash")).alias("cell")).distinct()
    source = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64(F.col("text").cast("binary")).alias("_hash"), F.col("text").cast("binary").alias("text"))
    some = source.join(F.broadcast(cells), cell(F.col("_hash")) == F.col("cell"), "left_semi")
    few = chosen.count() <= MOST_BROADCAST
    texts = (F.broadcast(chosen) if few else chosen).join(some, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))).select("key", "text")
    exact, _ = group_forest(chosen.select("grp", "key", "weight"), tree_kernel(bound, words, shared), tree_group, texts, tree_shingles)
    return components(settled(exact, "links"))


def similar_documents(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, **limits) -> DataFrame:
    """A row for each document: doc_id, text_hash, n_shingles, component_id, component_hash.

    Documents whose shingle sets have a Jaccard likeness of num / den or more are linked; component_id is the least doc_id
    reachable by links. A text without words, or null, has no shingles and is linked with nothing: its own doc_id. With
    fewer than `words` words, the whole sequence is one shingle. Repeated rows and ids are documents of their own; null ids
    are greater than none (a component of null ids has a null id). component_hash is the text hash of the component's first row by (doc_id, text_hash).
    Other columns are ignored. An empty table gives no rows.
    """
    bound = Bound(num, den)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words))  # FREQUENT_MOST hashes at most
    sets = shingled(docs, words, bound, shared)
    roots = linked_sets(docs, sets, words, bound, shared, **limits)
    per_key = sets.where("key is not null").groupBy("key").agg(F.min(_place()).alias("first"))
    rooted = per_key.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = written(rooted.select("key", "root").join(least, "root").select("key", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("component_hash")), "named")
    rows = sets.select("doc_id", "text_hash", "n_shingles", "key")
    joined = rows.join(named, "key", "left")
    empty = F.col("key").isNull()
    return joined.select("doc_id", "text_hash", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(empty, F.col("text_hash")).otherwise(F.col("component_hash")).alias("component_hash"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, **limits) -> DataFrame:
    """docs with one document of each component: its first by (doc_id, text). Of repeated equal rows one stays;
    texts without words, null and empty ones, all stay. An empty table gives no rows. The columns are those of docs, whatever
    their names; other columns than doc_id and text decide nothing. Texts of any length are compared whole."""
    found = similar_documents(docs.select("doc_id", "text"), words, num, den, **limits)
    gone = found.where("n_shingles > 0 and not (doc_id <=> component_id and text_hash = component_hash)").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    repeated = found.where("n_shingles > 0 and doc_id <=> component_id and text_hash = component_hash").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    own = F.xxhash64(F.col("text").cast("binary"))
    gone = written(gone, "gone")
    gone = F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone
    left = docs.join(gone, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (own == F.col("_hash")), "left_anti")
    again = written(repeated, "repeated")
    if not again.head(1):
        return left
    twice = again.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (own == F.col("_hash"))
    ones = left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, same, "left_anti").unionByName(ones)
