"""Trie of conversation prefixes: nodes are digests, and each shard adds up its paths in flat arrays addressed by a minimal perfect hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pressgrain.llm.common import mix64, table
from pressgrain.session import cut_lineage

ROOT = bytes(16)
EMPTY = hashlib.sha256(b"").hexdigest()
U = np.uint64


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys (n x 2 words): each key has its own slot below n.

    On every level the keys without a slot are hashed into a table of twice their number; those alone in their cell take
    the next slots in the order of the cells, the others go on to the next level. The key is kept at its slot, so that
    a look-up tells whether the slot it finds is the key's.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray]] = []
        self.keys = np.empty_like(keys)
        left, given = keys, 0
        while len(left):
            size = 2 * len(left)
            cell = self._cell(left, len(self.levels), size)
            alone = np.bincount(cell, minlength=size) == 1
            slots = np.where(alone, given + np.cumsum(alone) - 1, -1)
            self.levels.append((size, slots))
            mine = slots[cell]
            self.keys[mine[mine >= 0]] = left[mine >= 0]
            given += int(alone.sum())
            left = left[mine < 0]

    @staticmethod
    def _cell(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix64(keys[:, 0] ^ mix64(keys[:, 1] + U(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) % U(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that the table does not hold."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (size, slots) in enumerate(self.levels):
            found = slots[self._cell(keys[open_], level, size)]
            out[open_[found >= 0]] = found[found >= 0]
            open_ = open_[found < 0]
            if not len(open_):
                break
        met = out >= 0
        out[np.flatnonzero(met)[(self.keys[out[met]] != keys[met]).any(axis=1)]] = -1
        return out


def _words(column: pa.ChunkedArray) -> np.ndarray:
    """16-byte digests as pairs of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


def _add_up(group: pa.Table) -> pa.Table:
    """Paths (depth, node, parent, own, leaf, saved) of one shard -> what they add to each node on them: children, leaves, saved bytes.

    Only rows marked ``own`` bring something; every node is own in one shard. A node's sums go to its parent's slot, the deepest nodes first.
    """
    rows = _words(group.column("node"))
    _, first = np.unique(rows.view([("a", "u8"), ("b", "u8")]).reshape(-1), return_index=True)
    nodes = PerfectHash(rows[first])
    at = nodes.slots(rows)
    depth = np.zeros(len(first), np.int64)
    depth[at] = group.column("depth").to_numpy()
    parent = np.full(len(first), -1, np.int64)
    below = depth[at] > 0
    parent[at[below]] = nodes.slots(_words(group.column("parent").filter(pa.array(below))))
    sums = np.zeros((3, len(first)), np.int64)
    own = np.flatnonzero(group.column("own").to_numpy(zero_copy_only=False))
    np.add.at(sums[1], at[own], group.column("leaf").to_numpy(zero_copy_only=False)[own].astype(np.int64))
    np.add.at(sums[2], at[own], group.column("saved").to_numpy(zero_copy_only=False)[own])
    up = own[below[own]]
    np.add.at(sums[0], parent[at[up]], 1)
    order = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    for d in range(int(depth.max()), 0, -1):
        level = order[bounds[d] : bounds[d + 1]]
        for part in (1, 2):
            np.add.at(sums[part], parent[level], sums[part][level])
    return pa.table({"node": pa.array([k.tobytes() for k in nodes.keys], pa.binary()), "children": sums[0], "leaves": sums[1], "saved": sums[2]})


def rebuilt_turns(conversations: DataFrame, family: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, sizes) of the rebuilt conversations: turns are (c, d, turn digest, size of the text, total), sizes are (c, total).

    Conversation c takes the first h turns of c - c % ``family``, then its own turns after its first h; h is the crc32 of
    c in decimal modulo ``modulus``. Texts are digested before anything moves.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.octet_length(text).cast("long").alias("size"), role.alias("role"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("said"))
    # turns with equal numbers stand in the order of their roles, then of their texts' digests
    placed = turns.select("c", "said", "size", F.row_number().over(Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "said")).alias("i"))
    placed = cut_lineage(placed)
    taken = F.expr(f"crc32(cast(cast(c as string) as binary)) % {modulus}").cast("int")
    counts = placed.groupBy("c").agg(F.max("i").alias("n")).withColumns({"h": taken, "base": F.col("c") - F.col("c") % family})
    heads = placed.filter(F.col("i") < modulus).groupBy(F.col("c").alias("base")).agg(F.array_sort(F.collect_list(F.struct("i", "said", "size"))).alias("heads"))
    convs = counts.join(heads, "base", "left").withColumn("heads", F.slice(F.coalesce("heads", F.expr("cast(array() as array<struct<i:int,said:binary,size:bigint>>)")), F.lit(1), F.col("h")))
    convs = cut_lineage(convs.select("c", "h", "heads", F.size("heads").alias("t"), (F.size("heads") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("total")))
    front = convs.select("c", "total", F.explode("heads").alias("x")).select("c", F.col("x.i").cast("long").alias("d"), "x.said", "x.size", "total")
    back = placed.join(convs.drop("heads"), "c").filter("i > h").select("c", (F.col("t") + F.col("i") - F.col("h")).cast("long").alias("d"), "said", "size", "total")
    return front.union(back), convs.select("c", "total")


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in the order of conversation and depth -> (c, depth, node, parent, size, end); a node digests its parent and the turn."""
    current, before = None, ROOT
    for batch in batches:
        conv, depth, said, size, total = batch.columns
        nodes, parents = [], []
        for c, turn in zip(conv.to_pylist(), said.to_pylist()):
            if c != current:
                current, before = c, ROOT
            parents.append(before)
            before = hashlib.md5(before + turn).digest()
            nodes.append(before)
        ends = pa.array(depth.to_numpy() == total.to_numpy())
        yield pa.RecordBatch.from_arrays([conv, depth, pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), size, ends], ["c", "depth", "node", "parent", "size", "end"])


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, c) -> (node, first c, the ids joined by commas), one row for each node and Arrow batch."""
    for batch in batches:
        nodes, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        starts = [i for i in range(len(nodes)) if not i or nodes[i] != nodes[i - 1]]
        parts = [",".join(map(str, ids[a:b])) for a, b in zip(starts, [*starts[1:], len(nodes)])]
        yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in starts], pa.binary()), pa.array([ids[i] for i in starts], pa.int64()), pa.array(parts, pa.string())], ["node", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, first, ids) -> (node, sha256 of all its ids joined by commas), fed piece by piece."""
    kinds = ["node", "ends_sha256"]
    current, state = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if node != current:
                if state:
                    done.append((current, state.hexdigest()))
                current, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], kinds)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([state.hexdigest()], pa.string())], kinds)


def prefix_trie(conversations: DataFrame, family: int = 5, modulus: int = 9, shard_rows: int = 300_000) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, from the textless root on.

    A node belongs to its smallest member, whose path holds all nodes above it. So the paths of these owners are dealt to
    shards by conversation, whatever turns they share; each shard adds up what its own nodes bring to all nodes above them, and the shards'
    sums are added by node. No first turn, node or group of copies ever comes together in one place: members are counted before
    they move, and the list of conversations that end in a node is sorted in ranges, each range written as one piece.

    Rows without conv_id belong to no conversation and are left out; turns with equal numbers stand in the order of
    their roles, then of their digests; % is that of SQL; an empty table gives no rows; further columns are ignored.

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    turns, sizes = rebuilt_turns(conversations, family, modulus)
    chained = turns.repartition("c").sortWithinPartitions("c", "d").select("c", "d", "said", "size", "total").mapInArrow(
        _chain, "c long, depth long, node binary, parent binary, size long, end boolean")
    tops = sizes.select("c", F.lit(0).cast("long").alias("depth"), F.lit(bytearray(ROOT)).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("size"), (F.col("total") == 0).alias("end"))
    paths = cut_lineage(chained.union(tops))
    nodes = cut_lineage(paths.groupBy("node").agg(
        F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if("end").alias("n_ends"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("size").alias("size")))

    marks = nodes.select(F.col("conv_id").alias("c"), "depth", F.lit(True).alias("own"), (F.col("n_convs") == F.col("n_ends")).alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    owners = nodes.select(F.col("conv_id").alias("c")).distinct()
    marked = paths.join(owners, "c", "left_semi").select("c", "depth", "node", "parent").join(marks, ["c", "depth"], "left")
    filled = cut_lineage(marked.select("c", "depth", "node", "parent", F.coalesce("own", F.lit(False)).alias("own"), F.coalesce("leaf", F.lit(False)).alias("leaf"), F.coalesce("saved", F.lit(0).cast("long")).alias("saved")))
    shards = max(1, -(-filled.count() // shard_rows))
    sums = filled.withColumn("shard", F.pmod(F.xxhash64("c"), F.lit(shards))).groupBy("shard").applyInArrow(_add_up, "node binary, children long, leaves long, saved long")
    totals = sums.groupBy("node").agg(F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    ends = paths.filter("end").select("node", "c").repartitionByRange("node", "c").sortWithinPartitions("node", "c").mapInArrow(_joined_ids, "node binary, first long, ids string")
    digests = ends.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node binary, ends_sha256 string")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, "node").join(digests, "node", "left").join(above, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
