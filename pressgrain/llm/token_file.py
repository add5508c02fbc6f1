"""Files of token ids in range-coded blocks, and their readers."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pressgrain.llm.coder import decode_block, encode_block
from pressgrain.llm.common import open_store, shared_folder, table
from pressgrain.llm.tokens import closed, encoder, text_slices
from pressgrain.session import cut_lineage

#: A block is closed once it holds this many ids; it always holds whole documents.
BLOCK_IDS = 1 << 21
#: Pieces of texts that a worker remembers, with their ids; 1,200,000 of them take some 200 MB.
KEPT_PIECES = 1_600_000
_INDEX = "<II"  # documents, crc32 of the index


def _frame(entries: list[tuple[int | None, int]], ids: np.ndarray) -> bytes:
    """Index of the block's documents (id, whether it is null, number of ids), then the coded ids."""
    index = np.array([(0 if i is None else i, i is None, n) for i, n in entries], dtype=[("id", "<i8"), ("null", "u1"), ("n", "<u8")]).tobytes()
    return struct.pack(_INDEX, len(entries), zlib.crc32(index)) + index + encode_block(ids)


def _unframe(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    count, crc = struct.unpack_from(_INDEX, raw)
    kind = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")])
    index = raw[struct.calcsize(_INDEX) : struct.calcsize(_INDEX) + count * kind.itemsize]
    if zlib.crc32(index) != crc:
        raise ValueError("damaged index")
    return np.frombuffer(index, kind), decode_block(raw[struct.calcsize(_INDEX) + len(index) :])


def write_token_files(docs: DataFrame, tokenizer: str, kind: str, end_id: int, folder: str, block_ids: int = BLOCK_IDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode documents in ascending id order (nulls first), each closed by ``end_id``, into files below ``folder``.

    Rows are ranged by id and, so that a repeated id can be split, by a hash of the text. Each task streams its range
    into one file of independent blocks; memory is bounded by a block or the longest document. A file's name carries the
    task attempt, so a retried task leaves at worst a file that the returned table doesn't name.

    Returns the table of blocks: shard, block, path, position, size, first_id (ids of the shard before it), ids.
    """
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text")))
    ranged = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = context.partitionId()
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        path = f"{root}/shard-{shard:06d}-{context.taskAttemptId()}.pgt"
        rows: list[tuple] = []
        pending: list[np.ndarray] = []
        entries: list[tuple[int | None, int]] = []
        size = position = first = 0
        sink = None

        def close_block() -> None:
            nonlocal pending, entries, size, position, first, sink
            sink = sink or store.open_output_stream(path)
            raw = _frame(entries, np.concatenate(pending))
            sink.write(raw)
            rows.append((shard, len(rows), path, position, len(raw), first, size))
            position, first = position + len(raw), first + size
            pending, entries, size = [], [], 0

        for batch in text_slices(batches, 1, 1 << 23):
            ids, counts = closed(*encoder(tokenizer, kind, KEPT_PIECES).encode(batch.column(1)), end_id)
            at = 0
            for key, n in zip(batch.column(0).to_pylist(), counts.tolist()):
                pending.append(ids[at : at + n])
                entries.append((key, n))
                at, size = at + n, size + n
                if size >= block_ids:
                    close_block()
        if entries:
            close_block()
        if sink:
            sink.close()
        columns = list(zip(*rows)) or [()] * 7
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "block", "path", "position", "size", "first_id", "ids"])

    return cut_lineage(ranged.mapInArrow(write, "shard int, block int, path string, position long, size long, first_id long, ids long"))


def read_token_files(blocks: DataFrame, folder: str) -> DataFrame:
    """Documents read back from the files that ``blocks`` names, each block by itself.

    Returns doc_id, start (ids of all documents before it), n_tokens, ids_crc32.
    """
    shards = blocks.groupBy("shard").agg(F.sum("ids").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    base = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # the blocks are few rows of much work each: a stated number of partitions keeps AQE from merging them by their size
    spread = blocks.join(base, "shard").select("path", "position", "size", (F.col("base") + F.col("first_id")).alias("start"), "shard", "block").repartition(
        max(1, blocks.count()), "shard", "block")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for path, position, size, start in zip(*(batch.column(i).to_pylist() for i in range(4))):
                with store.open_input_file(path) as source:
                    index, ids = _unframe(source.read_at(size, position))
                counts = index["n"].astype(np.int64)
                ends = np.cumsum(counts)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(index["id"], mask=index["null"].astype(bool)), pa.array(start + ends - counts), pa.array(counts), pa.array(np.array(crc, np.int64))],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are the end id alone; repeated rows are written each; an empty table gives no rows."""
    import public_tokenizers

    folder = shared_folder(spark, "token-files")
    blocks = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "drop", 2, folder)
    return read_token_files(blocks, folder)
