"""Near-duplicate documents by SuperMinHash, banding, verification and union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgrain.llm.common import slices, table
from pressgrain.llm.graph import UnionFind, block_pairs, components
from pressgrain.llm.shingles import band_keys, shingle_set, super_min_hash
from pressgrain.session import cut_lineage


def _node(shingles: np.ndarray) -> int:
    """Identity of a shingle set: documents with equal sets are one node."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def signatures(docs: DataFrame, width: int, size: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, node (null for the empty set) and signature of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x, width) for x in batch.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            signed = iter(super_min_hash(full, size).astype("<u4")) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([next(signed).tobytes() if len(s) else None for s in sets], pa.binary())], ["doc_id", "n_shingles", "node", "signature"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_shingles long, node long, signature binary")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """node and its sorted shingle hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x, width) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles array<long>")


def _compare_blocks(size: int, percent: int, slack: float):
    """Links among the members of a pair of blocks, as a forest.

    Signatures estimate the similarity of all pairs at once; those within ``slack`` of the bound, or above it, are
    compared by their sets, the most similar first, unless they are tied already.
    """
    def run(found: pa.Table) -> pa.Table:
        node = found.column("node").to_numpy()
        block, asks = found.column("_block").to_numpy(), found.column("asking").to_numpy(zero_copy_only=False)
        signed = np.stack([np.frombuffer(x, "<u4") for x in found.column("signature").to_pylist()])
        shingles = found.column("shingles").combine_chunks()
        flat, cuts = shingles.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(shingles.value_lengths().to_numpy())])
        sets = UnionFind(len(node))
        count = np.diff(cuts)
        one_block = (block == block[0]).all()
        pairs = []
        for a in range(len(node)):
            rest = np.arange(a + 1, len(node))
            rest = rest[(asks[rest] | asks[a]) & (one_block | (block[rest] != block[a]))]
            least, most = np.minimum(count[a], count[rest]), np.maximum(count[a], count[rest])
            rest = rest[100 * least >= percent * most]
            if len(rest):
                equal = (signed[rest] == signed[a]).sum(axis=1)
                near = equal >= (percent / 100 - slack) * size
                pairs += [(-int(e), a, int(b)) for e, b in zip(equal[near], rest[near])]
        links = []
        for _, a, b in sorted(pairs):
            if sets.find(a) != sets.find(b):
                x, y = flat[cuts[a] : cuts[a + 1]], flat[cuts[b] : cuts[b + 1]]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    sets.union(a, b)
                    links.append((node[a], node[b]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 24, rows: int = 5, slack: float = 0.16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Group of every document: doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    Two documents are linked if the Jaccard similarity of their sets of ``width``-word shingles is ``percent`` % or more;
    links are confirmed on the full sets.

    1. Documents with equal sets are one node from here on, so exact copies never meet each other.
    2. Nodes with an equal band of their signature share a bucket; a bucket ties its members to its smallest one. The
       components of these ties are families, within which all candidates lie. With 24 bands of 5 rows a pair at 85 %
       shares no band once in a million, one at 80 % once in 14,000.
    3. Each family has a centre, the node with the most bucket mates. Every member is compared with it, in salted
       parts, so a large family of near copies is mostly tied by as many comparisons as it has members.
    4. What isn't linked to the centre is compared with all members of its family, in pairs of blocks of bounded size.
    5. The links' components give the groups.

    A document without words has no shingles, is linked with nothing and kept. A row without id isn't compared, has no
    component and is kept. Rows that repeat an id are compared each. Other columns are ignored.
    """
    size = bands * rows
    signed = cut_lineage(signatures(docs, width, size, doc_id, text))
    nodes = signed.filter(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).groupBy("node").agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("x"))
    nodes = cut_lineage(nodes.select("node", F.col("x.doc_id").alias("first"), F.col("x.n_shingles").alias("n"), F.col("x.signature").alias("signature")))

    def to_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            keys = band_keys(np.stack([np.frombuffer(x, "<u4") for x in batch.column(1).to_pylist()]), rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1])), pa.array(keys.reshape(-1))], ["node", "band"])

    banded = nodes.select("node", "signature").mapInArrow(to_bands, "node long, band long")
    buckets = banded.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("mates")).filter("mates > 1")
    ties = cut_lineage(banded.join(buckets, "band").select("node", "least", "mates"))
    families = components(ties.select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    central = ties.groupBy("node").agg(F.sum("mates").alias("mates"))
    members = cut_lineage(families.join(central, "node").join(nodes, "node").select("node", F.col("component").alias("family"), "mates", "first", "n", "signature"))
    centres = members.groupBy("family").agg(F.max_by("node", F.struct("mates", "node")).alias("centre"), F.count(F.lit(1)).alias("size"))

    # sets of the members only, from the texts of their first documents
    wanted = members.select(F.col("first").alias("_id"), F.col("node").alias("_node"))
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text")).join(wanted.select("_id").distinct(), "_id", "left_semi").select("text").filter("text is not null")
    sets = _sets(texts, width).join(wanted.select(F.col("_node").alias("node")), "node", "left_semi").dropDuplicates(["node"])
    full = cut_lineage(members.join(sets, "node").join(centres.select("family", "centre", "size"), "family"))

    parts = F.ceil(F.col("size") / 64).cast("int")
    around = full.filter("node <> centre").select("node", "family", "shingles", F.pmod(F.xxhash64("node"), parts).alias("part"))
    middle = full.filter("node = centre").select("family", "centre", F.col("shingles").alias("core"), F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long"))).alias("part"))
    shared = F.size(F.array_intersect("shingles", "core"))
    met = around.join(middle, ["family", "part"]).withColumn("shared", shared)
    linked = cut_lineage(met.filter(F.col("shared") * 100 >= percent * (F.size("shingles") + F.size("core") - F.col("shared"))).select(F.col("node").alias("a"), F.col("centre").alias("b")))

    tied = linked.select(F.col("a").alias("node"), F.lit(True).alias("tied"))
    left = full.join(tied, "node", "left").withColumn("asking", F.col("tied").isNull() & (F.col("node") != F.col("centre"))).withColumn("heavy", 1 + F.col("n") / 2000)
    dealt = block_pairs(left.select("family", "node", "signature", "shingles", "asking", "heavy"), "family", "node", 64, "asking", "heavy")
    rest = dealt.groupBy("family", "_i", "_j").applyInArrow(_compare_blocks(size, percent, slack), "a long, b long")
    groups = components(linked.union(rest))
    by_node = signed.filter("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least")).filter("node is not null")
    named = by_node.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    first = named.groupBy("group").agg(F.min("least").alias("component_id"))
    lookup = named.join(first, "group").select("node", "component_id")
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", F.xxhash64("doc_id"))).alias("_at"), "node").join(lookup.withColumnRenamed("node", "_at"), "_at", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    done = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return done.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
