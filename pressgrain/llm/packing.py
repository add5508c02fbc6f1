"""Packing of tokenized documents into sequences of a fixed length, shortest pack first."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pressgrain.llm.common import table
from pressgrain.llm.tokens import closed, encoder, text_slices
from pressgrain.session import cut_lineage


def pack_histogram(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Places for every length, given how many pieces have it.

    Lengths go longest first, each into the packs with the most free room. Packs filled alike are one entry with a
    range of sequence numbers, so the work follows the number of different lengths (at most ``capacity``) and not the
    number of pieces. Where no pack has room, as many are opened as the remaining pieces of this length can fill.

    Returns rows (length, first rank, count, first sequence, offset), sorted: the pieces of this length with these
    ranks lie in these sequences, one each, at this offset.
    """
    packs: list[tuple[int, int, int]] = []  # (-free room, first sequence, count)
    opened, rows = 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if not packs or -packs[0][0] < length:
                fresh = -(-left // (capacity // length))
                heapq.heappush(packs, (-capacity, opened, fresh))
                opened += fresh
            room, first, count = heapq.heappop(packs)
            used = min(left, count)
            rows.append((length, rank, used, first, capacity + room))
            if -room > length:
                heapq.heappush(packs, (room + length, first, used))
            if count > used:
                heapq.heappush(packs, (room, first + used, count - used))
            left, rank = left - used, rank + used
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pieces_of(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text", kept_pieces: int = 800_000) -> DataFrame:
    """Pieces of at most ``capacity`` ids, with checksum and rank.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, task, rank. ``rank`` counts the pieces of the same length
    that the same task made before.
    """
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, task int, rank long"
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in text_slices(batches, 1):
            ids, counts = closed(*encoder(tokenizer, kind, kept_pieces).encode(batch.column(1)), end_id)
            pieces = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            total, start = counts[row], nth * capacity
            length = np.minimum(total - start, capacity)
            first = np.cumsum(length) - length
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
            # rank among the pieces of the same length: those before this slice, then those before in it
            order = np.argsort(length, kind="stable")
            sizes, at, many = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - np.repeat(at, many) + np.repeat(seen[sizes], many)
            seen[sizes] += many
            longs = [pa.array(np.asarray(c, dtype=np.int64)) for c in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), *longs, pa.array(np.full(len(row), task, np.int32)), pa.array(rank)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, kind: str = "lead", end_id: int = 1, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", kept_pieces: int = 800_000) -> DataFrame:
    """Sequence and offset of every piece of every document.

    A document is its ids and ``end_id``; it is cut every ``capacity`` ids. Pieces are counted by length, packed by
    ``pack_histogram`` on those counts, and joined back by their rank among the pieces of their length: a rank is a
    count within one task plus the counts of the earlier tasks, so no length is ever gathered in one place. Only the
    histogram (at most ``capacity`` rows) comes to the driver and only the places made from it go to the tasks.

    Null and empty texts are the end id alone; repeated rows are packed each; an empty table gives no rows; further
    columns are ignored. ``kept_pieces`` bounds what a Python worker remembers of the texts. Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    pieces = cut_lineage(pieces_of(docs, tokenizer, kind, end_id, capacity, doc_id, text, kept_pieces))
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = pack_histogram(histogram, capacity)
    shift = np.int64(40)
    starts = (places[:, 0] << shift) | places[:, 1]
    out = pieces.join(base, ["length", "task"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            row = np.searchsorted(starts, (length << shift) | rank, side="right") - 1
            found = places[row]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind_of_id = docs.schema[doc_id].dataType.simpleString()
    return out.mapInArrow(place, f"doc_id {kind_of_id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
