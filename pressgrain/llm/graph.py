"""Connected components of an edge table, and the splitting of large groups into blocks that are compared pairwise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressgrain.session import cut_lineage


class UnionFind:
    """Disjoint sets over 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = int(self.parent[x])
        return x

    def union(self, x: int, y: int) -> bool:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        roots = self.parent.copy()
        while not np.array_equal(roots, again := roots[roots]):
            roots = again
        return roots


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) -> for each batch, an edge from every node to the smallest node it is joined with in the batch."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        sets = UnionFind(len(nodes))
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
            sets.union(x, y)
        roots = sets.roots()
        moved = roots != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[roots[moved]])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); the component is its smallest node.

    Batches of edges are first reduced to forests by union-find inside the tasks. Then, in rounds, each node and its
    neighbours are tied to the smallest of them (the large-star and small-star steps of Kiveris et al.), until nothing
    changes: the rounds grow with the logarithm of the longest path, and each is written to the shared folder. A node
    that many others are tied to is only ever aggregated to its smallest neighbour, which is partly done before the
    shuffle, and joined, where the skew handling of joins splits it.
    """
    stars = cut_lineage(edges.select("a", "b").filter("a <> b").mapInArrow(_forest, "a long, b long"))
    while True:
        # large star: every larger neighbour of a node is tied to the smallest node of its neighbourhood
        both = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every node and its smaller neighbours are tied to the smallest of these
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(smallest.select("a", F.col("m").alias("b"))).distinct()
        after = cut_lineage(small.mapInArrow(_forest, "a long, b long").distinct())
        # done when no node is tied to two others and no root is tied itself
        open_ends = after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        if not open_ends and after.count() == after.select("a").distinct().count():
            break
        stars = after
    return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def block_pairs(members: DataFrame, group: str, member: str, size: int, asking: str | None = None, weight: str | None = None) -> DataFrame:
    """Members of each group dealt to tasks so that any two of them meet exactly once.

    A group of n members is cut into k = ceil(n / size) blocks by a hash of the member; task (i, j) with i <= j gets
    blocks i and j. Rows come back with _i, _j and _block (their own block), k times each, so a task's input is bounded
    by the block size however large the group is. With ``asking``, a boolean column, only pairs with an asking member need to
    meet: blocks of asking members and of others are numbered apart, and pairs of two non-asking blocks are left out.
    ``weight`` is a column to count instead of members.
    """
    asks = F.col(asking) if asking else F.lit(True)
    rows = members.withColumn("_asks", asks)
    heavy = F.col(weight) if weight else F.lit(1)
    sizes = rows.groupBy(group).agg(
        F.ceil(F.sum(F.when(F.col("_asks"), heavy).otherwise(0)) / size).cast("int").alias("_ka"), F.ceil(F.sum(F.when(F.col("_asks"), 0).otherwise(heavy)) / size).cast("int").alias("_ko"))
    dealt = rows.join(sizes, group)
    hashed = F.xxhash64(member)
    own = F.when(F.col("_asks"), F.pmod(hashed, F.greatest("_ka", F.lit(1)))).otherwise(F.col("_ka") + F.pmod(hashed, F.greatest("_ko", F.lit(1)))).cast("int")
    placed = dealt.withColumn("_block", own).filter("_ka > 0")
    # an asking block meets all blocks, another one only the asking blocks
    partners = F.when(F.col("_asks"), F.sequence(F.lit(0), F.col("_ka") + F.col("_ko") - 1)).otherwise(F.sequence(F.lit(0), F.col("_ka") - 1))
    met = placed.withColumn("_other", F.explode(partners))
    return met.select("*", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j")).drop("_other", "_ka", "_ko", "_asks")
