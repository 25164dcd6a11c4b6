"""Similarity join on word n-grams: MinHash LSH forest and exact verification.

Texts with the same set of shingles form a class; only the class's first document goes on. Each of ``trees`` trees is a
trie of signatures of ``full_depth`` levels. Documents with the same prefix in a tree are in one node and are candidates.
The prefix is shortened to the depth at which a pair at the threshold itself is a candidate with the target's probability,
whatever the data. Only where a caller asks for it, it stays longer: as long as all links together reach the target.
Candidates' components are compared exactly; large ones node by node, by blocks, without emitting pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected

#: Documents of a component or node that one task compares with each other, or half of it with another half.
BLOCK = 2000
#: Bits of a level's minimum in a signature; six levels fill one of its two numbers.
LEVEL = 10


def recall_at(depth: int, trees: int, similarity: float | np.ndarray) -> float | np.ndarray:
    """The probability that two documents of a similarity share a node of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(threshold: float, trees: int, full: int, target: float) -> int:
    """The longest prefix at which a pair at ``threshold`` itself reaches the target."""
    for depth in range(full, 0, -1):
        if recall_at(depth, trees, threshold) >= target:
            return depth
    raise ValueError(f"{trees} trees can't reach a recall of {target} at {threshold}")


def shortened(links: dict[float, float], trees: int, full: int, floor: int, target: float) -> int:
    """The prefix, shortened from ``full`` until links of the measured similarities (with weights) reach the target."""
    if not links:
        return floor
    similarity, weight = np.array(list(links)), np.array(list(links.values()))
    depth = full
    while depth > floor and weight @ recall_at(depth, trees, similarity) < target * weight.sum():
        depth -= 1
    return depth


def shingles(raw: bytes | None, cache: common.HashCache, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``words`` consecutive words, ASCII letters lower-cased; a shorter text is one shingle."""
    h = common.hashes((raw or b"").lower().split(), cache)
    return np.unique(common.windows(h, min(words, len(h)), 5)) if len(h) else h


class Signer:
    """MinHash signatures: of each tree the levels' minima, ``LEVEL`` bits of each, packed into two numbers."""

    def __init__(self, trees: int, depth: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.factor = rng.integers(0, 1 << 31, (trees * depth, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.mask = rng.integers(0, 1 << 32, (trees * depth, 1), dtype=np.uint32)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        """Both numbers of each tree."""
        low, s = np.full((len(self.factor), 1), ~np.uint32(0)), s.astype(np.uint32)
        for i in range(0, len(s), 2048):
            low = np.minimum(low, ((s[None, i : i + 2048] ^ self.mask) * self.factor).min(1, keepdims=True))
        level = (low * np.uint32(0x9E3779B1) >> np.uint32(32 - LEVEL)).astype(np.int64).reshape(self.trees, self.depth)
        out = np.zeros((2, self.trees), np.int64)
        for k in range(self.depth):
            out[k // 6] |= level[:, k] << (LEVEL * (5 - k % 6))
        return out


def signatures(docs: DataFrame, trees: int, depth: int, words: int) -> DataFrame:
    """doc_id, shape (digest of the set of shingles, null without words), signature (two numbers a tree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sign = common.HashCache(), Signer(trees, depth)
        for batch in batches:
            shape, signed = [], []
            for raw in common.as_bytes(batch.column(1)):
                s = shingles(raw, cache, words)
                shape.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signed.append(sign(s).ravel() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shape, pa.binary()), pa.array(signed, pa.list_(pa.int64()))], ["doc_id", "shape", "signature"])

    return docs.mapInArrow(run, "doc_id bigint, shape binary, signature array<bigint>")


def node_keys(trees: int, depth: int) -> Column:
    """The node of each tree that has the first ``depth`` levels of a signature."""

    def key(t: Column) -> Column:
        first, second = F.get("signature", t), F.get("signature", t + trees)
        cut = lambda x, levels: F.shiftright(x, LEVEL * (6 - min(max(levels, 0), 6)))
        return F.xxhash64(t, cut(first, depth), cut(second, depth - 6))

    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), key)


def overlaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of sets in one task: for all pairs how much they share and how much they have together."""
    m, size = len(sets), np.array([len(s) for s in sets], np.int64)
    value, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    shared = times[at] > 1  # others are in no intersection
    column = (np.cumsum(times > 1) - 1)[at[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common_n = np.zeros((m, m), np.float32)
    step, n = 2048, int(column[-1]) + 1 if len(column) else 0
    for a in range(0, n, step):
        lo, hi = np.searchsorted(column, (a, a + step))
        x = np.zeros((m, min(step, n - a)), np.float32)
        x[owner[lo:hi], column[lo:hi] - a] = 1
        common_n += x @ x.T
    return common_n, size[:, None] + size[None, :] - common_n


def linked(sets: list[np.ndarray], left: int, threshold: float, nodes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of sets in one task: how many others each is linked to, and the first of those it is tied to.

    With ``left`` only pairs of the first ``left`` sets with the others count, otherwise all pairs. With ``nodes``, the
    sets' nodes of earlier trees, pairs that share one of those don't count, as they are compared there.
    """
    m = len(sets)
    count = np.ones((m, m), bool)
    np.fill_diagonal(count, False)
    if left:
        count[:left, :left] = count[left:, left:] = False
    if nodes is not None:
        for column in nodes.T:
            count &= column[:, None] != column[None, :]
    if not count.any():
        return np.zeros(m, np.int64), np.arange(m)
    shared, either = overlaps(sets)
    near = (shared >= threshold * either - 1e-6) & count
    root = np.arange(m)
    while True:
        best = np.minimum(root, np.where(near, root[None, :], m).min(1))
        best = best[best]
        if (best == root).all():
            break
        root = best
    return near.sum(1), root


def _blocks(n: Column) -> Column:
    """In how many parts a group of ``n`` documents is compared."""
    return F.when(n <= BLOCK, 1).otherwise(F.ceil(n / (BLOCK // 2))).cast("int")


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of groups of ``parts`` parts, dealt to pairs (i, j): each part with itself and with each other part. The second of two is the right one."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other"), "right": F.col("part") > F.col("other")}).drop("part", "other", "parts")


def verified(docs: DataFrame, members: DataFrame, threshold: float, words: int) -> DataFrame:
    """Links inside groups: doc_id, links, root (several rows of a document that is in several groups or blocks).

    ``members`` has doc_id, nodes (all nodes of the document, or null), and groups, an array of (id, tree, parts).
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = common.HashCache()
        for batch in batches:
            got = [shingles(raw, cache, words).tobytes() for raw in common.as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary()), *batch.columns[2:]], ["doc_id", "shingles", "nodes", "groups"])

    def pairs(group: pa.Table) -> pa.Table:
        group = group.sort_by([("right", "ascending"), ("doc_id", "ascending")])
        ids, right, tree = group.column("doc_id").to_numpy(), group.column("right").to_numpy(zero_copy_only=False), group.column("tree")[0].as_py()
        nodes = np.array(group.column("nodes").to_pylist(), np.int64)[:, :tree] if tree > 0 else None
        left = int((~right).sum()) if group.column("i")[0] != group.column("j")[0] else 0
        got, root = linked([np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()], left, threshold, nodes)
        has = got > 0
        return pa.table({"doc_id": ids[has], "links": got[has].astype(np.int64), "root": ids[root][has]})

    rows = docs.join(members, "doc_id").select("doc_id", "text", "nodes", "groups")
    rows = rows.mapInArrow(sets, "doc_id bigint, shingles binary, nodes array<bigint>, groups array<struct<id:bigint,tree:int,parts:int>>")
    rows = rows.select("doc_id", "shingles", "nodes", F.explode("groups").alias("g")).select("doc_id", "shingles", "nodes", "g.*")
    return in_blocks(rows).groupBy("id", "tree", "i", "j").applyInArrow(pairs, "doc_id bigint, links bigint, root bigint")


def measured(docs: DataFrame, at: DataFrame, nodes: DataFrame, floor: int, threshold: float, words: int) -> dict[float, float]:
    """Similarities of all links in all nodes, and their weights. Large nodes are compared by blocks.

    A link is met in the more nodes the more similar it is, and counts the less.
    """

    def histogram(group: pa.Table) -> pa.Table:
        cache = common.HashCache()
        right = group.column("right").to_numpy(zero_copy_only=False)
        shared, either = overlaps([shingles(raw, cache, words) for raw in common.as_bytes(group.column("text"))])
        one = group.column("i")[0] == group.column("j")[0]
        found = (shared / either)[np.triu_indices(len(shared), 1) if one else np.ix_(~right, right)]
        value, n = np.unique(np.floor(found[found >= threshold - 1e-9] * 1000) / 1000, return_counts=True)
        return pa.table({"similarity": value.astype(float), "n": n.astype(np.int64)})

    rows = common.stored(at.join(nodes.select("node", _blocks(F.col("n")).alias("parts")), "node"), "measured")
    texts = in_blocks(common.of_ids(docs, rows).join(rows, "doc_id"))
    found = texts.groupBy("node", "i", "j").applyInArrow(histogram, "similarity double, n bigint").groupBy("similarity").agg(F.sum("n").alias("n")).collect()  # 200 at most
    return {r["similarity"]: r["n"] / r["similarity"] ** floor for r in found}


def similarity_join(
    docs: DataFrame, *, threshold: float = 0.8, words: int = 5, trees: int = 24, full_depth: int = 12, target: float = 0.9999, least_links: int | None = None
) -> DataFrame:
    """Near-duplicate links and groups.

    In: doc_id (unique), text. Out, a row for each input row: doc_id, class_id (smallest doc_id with the same set of
    shingles), class_size, n_links (other classes with a Jaccard similarity of ``threshold`` or more), group_id
    (smallest doc_id of the classes joined by links, however far), kept (doc_id is its group's first). Words are runs of
    other than ASCII white space with A-Z lower-cased; a text of fewer than ``words`` words is one shingle. A null or
    empty text, or one without a doc_id, is a class and group by itself. Each link, also one at the threshold, is missed
    with a probability of at most 1 - ``target``. With ``least_links`` that holds for the mean of all links instead, where
    there are at least so many: links far above the threshold then allow longer prefixes, at the cost of those near it.
    Links that are reported are compared shingle by shingle (64-bit hashes of them). Other columns are ignored. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    common.ship_code(spark)
    common.quiet_arrow(spark)
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    signed = common.stored(signatures(docs, trees, full_depth, words), "signatures")
    classes = signed.filter("shape is not null and doc_id is not null").groupBy("shape")
    classes = common.stored(classes.agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")).filter("class_size > 1"), "classes")
    placed = signed.join(classes, "shape", "left").withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))).withColumn("class_size", F.coalesce("class_size", F.lit(1)).cast("bigint"))
    placed = common.stored(placed.select("doc_id", "class_id", "class_size", F.when(F.col("doc_id") == F.col("class_id"), F.col("signature")).alias("signature")), "placed")
    first = placed.filter("signature is not null")

    def trie(depth: int) -> tuple[DataFrame, DataFrame]:
        """Documents by node, and the nodes that several documents share."""
        at = first.select("doc_id", F.explode(node_keys(trees, depth)).alias("node"))
        return at, common.stored(at.groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).filter("n > 1"), "nodes")

    depth = depth_for(threshold, trees, full_depth, target)
    at, nodes = trie(depth)
    if least_links is not None:
        links = measured(docs, at, nodes, depth, threshold, words)
        if sum(links.values()) >= least_links and (longer := shortened(links, trees, full_depth, depth, target)) > depth:
            depth = longer
            at, nodes = trie(depth)
    edges = at.join(nodes, "node").filter("doc_id != low").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    parts = common.stored(connected(edges), "components")
    sizes = common.stored(parts.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    of = parts.join(sizes, "component").withColumnRenamed("node", "doc_id")
    # Small components are compared as a whole. Large ones node by node, so that a chain costs as much as its nodes.
    group = lambda key, tree, n: F.struct(key.alias("id"), tree.cast("int").alias("tree"), _blocks(n).alias("parts"))
    members = of.filter(F.col("n") <= BLOCK).select("doc_id", F.lit(None).cast("array<bigint>").alias("nodes"), F.array(group(F.col("component"), F.lit(-1), F.lit(1))).alias("groups"))
    chained = not sizes.filter(F.col("n") > BLOCK).isEmpty()
    if chained:
        inside = first.join(of.filter(F.col("n") > BLOCK).select("doc_id"), "doc_id").select("doc_id", node_keys(trees, depth).alias("nodes"))
        each = inside.select("doc_id", "nodes", F.posexplode("nodes").alias("tree", "node")).join(nodes.select("node", "n"), "node")
        members = members.union(each.groupBy("doc_id").agg(F.first("nodes").alias("nodes"), F.collect_list(group(F.col("node"), F.col("tree"), F.col("n"))).alias("groups")))
    members = common.stored(members, "members")
    found = common.stored(verified(common.of_ids(docs, members), members, threshold, words), "links")
    links = found.groupBy("doc_id").agg(F.sum("links").alias("n_links"), F.min("root").alias("group"))
    if chained:
        whole = connected(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
        links = links.drop("group").join(whole.select(F.col("node").alias("doc_id"), F.col("component").alias("group")), "doc_id")
    links = common.stored(links, "linked").withColumnRenamed("doc_id", "class_id")
    out = placed.join(links, "class_id", "left")
    out = out.select("doc_id", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("group", "class_id").alias("group_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("group_id")))
