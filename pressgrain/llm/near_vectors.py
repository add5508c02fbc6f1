"""Near-duplicate embeddings by p-stable hashing of normalised vectors and exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressgrain.llm.common import mix64, slices, table
from pressgrain.llm.graph import UnionFind, block_pairs, components
from pressgrain.session import cut_lineage


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length scaled to length 1, in double precision."""
    found = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = found.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(found), -1)
    # by the largest component first, so that no square over- or underflows
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _hashes(batches: Iterator[pa.RecordBatch], tables: int, projections: int, width: float, seed: int) -> Iterator[pa.RecordBatch]:
    drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in slices(batches):
        nodes, lengths = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
        for size in np.unique(lengths):
            if size not in drawn:
                rng = np.random.default_rng([seed, int(size)])
                drawn[size] = rng.standard_normal((int(size), tables * projections)), rng.uniform(0, width, tables * projections)
            axes, shifts = drawn[size]
            which = np.flatnonzero(lengths == size)
            cells = np.floor((_matrix(batch.column(1).take(pa.array(which))) @ axes + shifts) / width).astype(np.int64).reshape(len(which), tables, projections)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(mix64(np.arange(tables) * 65536 + int(size)), (len(which), tables))
                for i in range(projections):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, i].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[which], tables)), pa.array(key.reshape(-1).astype(np.int64))], ["node", "bucket"])


def _link_blocks(least: float):
    """Links between two blocks of one bucket, as a forest."""
    def run(found: pa.Table) -> pa.Table:
        node, block = found.column("node").to_numpy(), found.column("_block").to_numpy()
        rows = _matrix(found.column("vector"))
        near = rows @ rows.T >= least
        if len(np.unique(block)) > 1:
            near &= block[:, None] != block[None, :]
        sets, links = UnionFind(len(node)), []
        for a, b in zip(*np.nonzero(np.triu(near, 1))):
            if sets.union(int(a), int(b)):
                links.append((node[a], node[b]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _count_blocks(least: float):
    """How many vectors each member is linked with in the other block, or in its own if there is one."""
    def run(found: pa.Table) -> pa.Table:
        block, copies = found.column("_block").to_numpy(), found.column("copies").to_numpy()
        rows = _matrix(found.column("vector"))
        near = rows @ rows.T >= least
        if len(np.unique(block)) > 1:
            near &= block[:, None] != block[None, :]
        elif found.column("_i")[0].as_py() != found.column("_j")[0].as_py():
            near[:] = False  # the other block is empty
        np.fill_diagonal(near, False)
        return pa.table({"node": found.column("node"), "met": pa.array(near @ copies, pa.int64())})

    return run


def _usable(vector: str) -> Column:
    """Whether a vector has components, all of them finite, and one that isn't zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, least: float = 0.9, tables: int = 120, projections: int = 24, width: float = 2.5, seed: int = 9, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Links and group of every vector: vec_id, n_links, component_id (smallest id reachable by links), kept.

    1. Equal vectors are one node with a number of copies, so that copies never meet each other.
    2. In each of ``tables`` tables the normalised vector is projected on ``projections`` random normal axes, shifted and
       cut into cells of ``width``; nodes in the same cell of all axes share a bucket. A pair at cosine 0.9 meets in one
       table at least with probability 0.95, one at 0.95 with 0.9999; unrelated vectors meet in about one of a million.
    3. The members of a bucket are checked against its smallest member, which ties groups of near copies with
       as many checks as members. Where a bucket still has members of several components, those outside its commonest
       one are checked against all members, in pairs of blocks of bounded size.
    4. Within each component every pair is checked, again in pairs of blocks, and the links are counted, copies
       included. So links that no table found are counted as well if the component is complete.

    Every reported link has an exact cosine of ``least`` or more in double precision. Vectors that are null, empty, zero
    or hold null or non-finite components are linked with nothing, as are those of different lengths. A row without id
    isn't compared and has no component. Repeated rows are vectors of their own. Other columns are ignored.
    """
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    # adding 0 turns -0.0 into 0.0, which is the same vector
    keyed = cut_lineage(own.withColumn("node", F.when(_usable("vector") & F.col("vec_id").isNotNull(), F.xxhash64(F.transform("vector", lambda x: x + F.lit(0).cast("float"))))))
    nodes = cut_lineage(
        keyed.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("vector").alias("vector")))

    hashed = nodes.select("node", "vector").mapInArrow(lambda batches: _hashes(batches, tables, projections, width, seed), "node long, bucket long")
    counts = hashed.groupBy("bucket").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("mates")).filter("mates > 1")
    held = cut_lineage(hashed.join(counts, "bucket"))
    pairs = held.filter("node <> least").select("node", F.col("least").alias("other")).distinct()
    sides = pairs.join(nodes.select("node", F.col("vector").alias("v")), "node").join(nodes.select(F.col("node").alias("other"), F.col("vector").alias("w")), "other")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            other, node, v, w = batch.columns
            sizes = v.value_lengths().to_numpy()
            good = np.zeros(len(node), bool)
            for size in np.unique(sizes):
                which = np.flatnonzero((sizes == size) & (w.value_lengths().to_numpy() == size))
                if len(which):
                    at = pa.array(which)
                    good[which] = (_matrix(v.take(at)) * _matrix(w.take(at))).sum(axis=1) >= least
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([node.filter(keep), other.filter(keep)], ["a", "b"])

    tied = cut_lineage(sides.select("other", "node", "v", "w").mapInArrow(check, "a long, b long"))
    so_far = components(tied)
    # buckets of three or more whose members are not all in one component
    members = held.filter("mates > 2").select("bucket", "node").join(so_far, "node", "left").withColumn("component", F.coalesce("component", "node"))
    common = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("common"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    open_buckets = members.join(common, "bucket").withColumn("asking", F.col("component") != F.col("common")).select("bucket", "node", "asking")
    dealt = block_pairs(open_buckets, "bucket", "node", 64, "asking").join(nodes.select("node", "vector"), "node")
    more = dealt.groupBy("bucket", "_i", "_j").applyInArrow(_link_blocks(least), "a long, b long")

    groups = cut_lineage(components(tied.union(more)))
    inside = block_pairs(groups.join(nodes, "node"), "component", "node", 128)
    met = inside.groupBy("component", "_i", "_j").applyInArrow(_count_blocks(least), "node long, met long").groupBy("node").agg(F.sum("met").alias("met"))
    first = groups.join(nodes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    per_node = (
        nodes.select("node", "first", "copies").join(groups, "node", "left").join(first, "component", "left").join(met, "node", "left")
        .select("node", (F.col("copies") - 1 + F.coalesce("met", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id")))
    out = keyed.select("vec_id", F.coalesce("node", F.xxhash64("vec_id", F.lit("alone"))).alias("_at"), F.col("node").isNull().alias("_alone")).join(per_node.withColumnRenamed("node", "_at"), "_at", "left")
    return out.select(
        "vec_id", F.when(F.col("_alone"), 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(F.col("_alone"), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
