"""Removal of repeated byte strings: segments around sampled grams, and merged Burrows-Wheeler transforms where they differ.

Two equal strings of ``length`` bytes hold the same least gram (the one of smallest hash), so they meet under that gram.
A gram that occurs once settles nothing and is dropped by a count. Around every other occurrence lies a segment that
holds all strings whose least gram it is. Equal segments are one string with its first place: the strings of all later
places are repeated. Where a gram has several different segments, these are collected, their transforms are built in
shards, and the transforms are merged by refining their interleaving symbol by symbol.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressgrain.llm.common import mix64, table
from pressgrain.llm.tokens import text_slices
from pressgrain.session import cut_lineage

#: Bytes of a gram.
GRAM = 32
#: Odd multiplier of the polynomial hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
U = np.uint64


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values one after the other, their bounds) of a binary column; null counts as empty."""
    column = column.fill_null(b"").cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


@lru_cache(maxsize=4)
def _table(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n - 1; tables grow by doubling and the last ones stay."""
    return _table(base, 1 << max(16, n.bit_length()))[:n]


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place on: differences of prefix sums, brought to a common power; never 0."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_powers(BASE, len(data)) * (data.astype(np.uint64) + U(1)), dtype=np.uint64)])
        own = (sums[gram:] - sums[:-gram]) * _powers(INVERSE, len(sums) - gram)
    return mix64(own) | U(1)


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of every run of ``width`` values: runs of doubled width, the last two of which overlap."""
    have = 1
    while 2 * have <= width:
        x, have = best(x[:-have], x[have:]), 2 * have
    return best(x[: len(x) - width + have], x[width - have :]) if have < width else x


def sampled_grams(data: np.ndarray, bounds: np.ndarray, length: int, gram: int, block: int = 1 << 18) -> tuple[np.ndarray, ...]:
    """(places, hashes, first starts, last starts) of the grams that are least in some string of ``length`` bytes within one text.

    A string's least gram is the one of smallest hash, of equals the first. Strings with the same one start side by side,
    from first to last start. The work goes in blocks of ``block`` bytes, so memory does not follow the longest text; a gram at the border of two
    blocks may come twice, with a part of its strings each.
    """
    starts, width = len(data) - length + 1, length - gram + 1
    # a start is void where its string would pass the end of its text
    fits = np.ones(len(data) + 1, bool)
    sizes = np.diff(bounds)
    for back in range(1, length):
        fits[bounds[1:][sizes >= back] - back] = False
    found: list[tuple[np.ndarray, ...]] = []
    low = U((1 << 20) - 1)
    for at in range(0, starts, block - length + 1):
        own = _gram_hashes(data[at : at + block], gram)
        # the low bits are the place, so that the smallest word tells where it stands
        least = (_sliding((own & ~low) | np.arange(len(own), dtype=np.uint64), width, np.minimum) & low).astype(np.int64)
        good = np.flatnonzero(fits[at : at + len(least)])
        where = least[good]
        if not len(good):
            continue
        head = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (good[1:] != good[:-1] + 1)]))
        tail = np.append(head[1:], len(good)) - 1
        found.append((at + where[head], own[where[head]], at + good[head], at + good[tail]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def _segments(batches: Iterator[pa.RecordBatch], length: int, gram: int, only_grams: bool) -> Iterator[pa.RecordBatch]:
    """(doc, tie, text) -> sampled grams; unless ``only_grams`` with the hash of their segment (all strings whose least gram it is) and ``at``,
    the place of the gram and how far before it the last and the first of these strings start."""
    for batch in text_slices(batches, 2, 1 << 22):
        data, bounds = flat_bytes(batch.column(2))
        where, values, first, last = sampled_grams(data, bounds, length, gram)
        if only_grams:
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], ["gram"])
            continue
        row = np.searchsorted(bounds, where, side="right") - 1
        held = memoryview(data).cast("B") if len(data) else memoryview(b"")
        lo, hi = where - last, where - first
        ends = last + length
        digest = np.array([xxhash.xxh3_64_intdigest(held[a:b], seed=x) for a, b, x in zip(first.tolist(), ends.tolist(), lo.tolist())], np.uint64)
        rows = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(values.view(np.int64)), pa.array(digest.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((where - bounds[row]) << 16 | lo << 8 | hi)],
            ["gram", "same", "doc", "tie", "at"])


class ShardTransform:
    """Burrows-Wheeler transform of a set of strings, each closed by an end mark of its own.

    ``symbols`` are bytes plus 1, and 0 before the first byte of a string; the first rows are the end marks in the order of the strings.
    """

    def __init__(self, symbols: np.ndarray, strings: int):
        self.symbols, self.strings = symbols, strings

    @classmethod
    def build(cls, strings: list[bytes]) -> ShardTransform:
        """Sort the suffixes by prefix doubling."""
        n = len(strings)
        sizes = np.fromiter(map(len, strings), np.int64, n) + 1
        ends = np.cumsum(sizes) - 1
        text = np.zeros(int(sizes.sum()), np.int64)
        inner = np.ones(len(text), bool)
        inner[ends] = False
        text[inner] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + n
        text[ends] = np.arange(n)  # end marks differ, so that no comparison passes them
        before = np.zeros(len(text), np.uint16)
        before[1:] = np.where(inner[:-1], text[:-1] - n + 1, 0)
        # the first ranks are of as many symbols as a word holds
        bits = (n + 255).bit_length()
        rank, step = text, 1
        while step < 63 // bits:
            rank = rank << bits | np.concatenate([text[step:], np.zeros(step, np.int64)])[: len(text)]
            step += 1
        while True:
            order = np.argsort(rank)
            held = rank[order]
            fresh = np.empty_like(rank)
            fresh[order] = np.cumsum(np.concatenate([[0], held[1:] != held[:-1]]))
            if fresh[order[-1]] == len(text) - 1:
                return cls(before[order], n)
            ahead = np.concatenate([fresh[step:], np.zeros(step, np.int64)])[: len(text)]
            rank, step = fresh * len(text) + ahead, 2 * step


def merged_blocks(shards: list[ShardTransform], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, block of each) of the merged transform, where rows of a block share their first ``length`` symbols.

    Rows are numbered shard by shard. The interleaving starts with the shards one after the other. A round deals it out,
    stably, by the symbol before each suffix, and every shard's rows step to the suffixes that are one symbol longer; so after
    h rounds the order is right for the first h symbols, and two neighbours share them unless their symbols differ or the
    neighbours they came from were parted in an earlier round. That first round in which two are parted is their common
    prefix plus one. End marks part from all others at once. No suffix is compared or sorted again.
    """
    bases = np.cumsum([0, *(len(s.symbols) for s in shards)])
    symbols = np.concatenate([s.symbols for s in shards])
    step = np.empty(len(symbols), np.int32)
    marks = np.concatenate([base + np.arange(s.strings) for base, s in zip(bases, shards)])
    for base, s in zip(bases, shards):
        by_symbol = np.argsort(s.symbols, kind="stable")
        step[base + by_symbol] = base + np.arange(len(by_symbol))
    order, block = np.arange(len(symbols)), np.zeros(len(symbols), np.int32)
    # the first row of each symbol is the same in every round
    heads = np.cumsum(np.bincount(symbols, minlength=258))[:-1]
    heads = heads[heads < len(symbols)]
    if symbols.max(initial=0) < 256:
        symbols = symbols.astype(np.uint8)  # sorts in one pass
    parted = np.ones(len(symbols), bool)
    for _ in range(length):
        dealt = np.argsort(symbols.take(order, mode="clip"), kind="stable")[len(marks) :]
        came = block.take(dealt, mode="clip")
        np.not_equal(came[1:], came[:-1], out=parted[len(marks) + 1 :])
        parted[heads] = True
        order[len(marks) :] = step.take(order.take(dealt, mode="clip"), mode="clip")
        order[: len(marks)] = marks
        block = np.cumsum(parted, dtype=np.int32)
        if block[-1] == len(block):
            break
    return order, block


def places(shards: list[ShardTransform]) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every row, found by walking all strings backwards from their end marks side by side."""
    bases = np.cumsum([0, *(len(s.symbols) for s in shards)])
    firsts = np.cumsum([0, *(s.strings for s in shards)])
    string, offset = np.empty(bases[-1], np.int64), np.empty(bases[-1], np.int64)
    for base, first, s in zip(bases, firsts, shards):
        by_symbol = np.argsort(s.symbols, kind="stable")
        step = np.empty(len(by_symbol), np.int64)
        step[by_symbol] = np.arange(len(by_symbol))
        own, back = np.empty(len(by_symbol), np.int64), np.empty(len(by_symbol), np.int64)
        rows, names, walked = np.arange(s.strings), np.arange(s.strings), 0
        total = np.zeros(s.strings, np.int64)
        while len(rows):
            own[rows], back[rows] = names, walked
            on = s.symbols[rows] != 0
            total[names[~on]] = walked
            rows, names, walked = step[rows[on]], names[on], walked + 1
        string[base : base + len(own)] = first + own
        offset[base : base + len(own)] = total[own] - back
    return string, offset


def _build(group: pa.Table) -> pa.Table:
    """Segments of one shard -> its transform, with what is known of each string, in one row."""
    strings = group.column("bytes").to_pylist()
    symbols = ShardTransform.build(strings).symbols
    columns = {c: [group.column(c).to_pylist()] for c in ("doc", "tie", "start")}
    return pa.table({"bucket": group.column("bucket")[:1], "symbols": [symbols.astype("<u2").tobytes()], **{c: pa.array(v, pa.list_(pa.int64())) for c, v in columns.items()}})


def _merge(length: int):
    def merge(group: pa.Table) -> pa.Table:
        """Transforms of one bucket -> spans (doc, tie, first, last) whose strings occur earlier under the same key."""
        lists = {c: np.concatenate([np.asarray(v, np.int64) for v in group.column(c).to_pylist()]) for c in ("doc", "tie", "start")}
        counts = [len(v) for v in group.column("doc").to_pylist()]
        shards = [ShardTransform(np.frombuffer(b, "<u2"), n) for b, n in zip(group.column("symbols").to_pylist(), counts)]
        order, block = merged_blocks(shards, length)
        string, offset = places(shards)
        many = np.bincount(block)[block] > 1
        rows, block = order[many], block[many]
        string, offset = string[rows], offset[rows]
        doc, start = lists["doc"][string], lists["start"][string] + offset
        # the first place of each interval of equal strings stays
        sort = np.lexsort((start, doc, block))
        block, doc, start, string = block[sort], doc[sort], start[sort], string[sort]
        head = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
        of = np.repeat(head, np.diff(np.append(head, len(block))))
        later = (doc != doc[of]) | (start != start[of])
        string, start = string[later], start[later]
        sort = np.lexsort((start, string))
        string, start = string[sort], start[sort]
        new = np.concatenate([[True], (string[1:] != string[:-1]) | (start[1:] > start[:-1] + length)]) if len(start) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        last = start[np.append(at[1:], len(start)) - 1] + length if len(at) else start
        return pa.table({"doc": lists["doc"][string[at]], "tie": lists["tie"][string[at]], "first": start[at], "last": last})

    return merge


_UNIT = ["part", "same", "doc", "tie", "place", "lo", "hi", "bytes"]
_UNITS = "part long, same long, doc long, tie long, place long, lo long, hi long, bytes binary"
_SPANS = "doc long, tie long, first long, last long"


def _parted(rows: Iterator[tuple], length: int, reach: int, spread: int) -> pa.RecordBatch:
    """Units of ``spread`` + 1 neighbouring starts each, under the hash of the bytes that all strings with such starts share.

    Rows are (doc, tie, place of the gram, lo, hi, bytes, start of the bytes): the strings start lo to hi bytes before the gram. Starts are
    counted from the gram, so equal strings of two segments fall to units of the same part.
    """
    out: list[tuple] = []
    for doc, tie, place, lo, hi, raw, base in rows:
        for a in range(0, reach + 1, spread + 1):
            b = min(a + spread, reach)
            x, y = max(a, lo), min(b, hi)
            if x <= y:
                shared = bytes(raw[place - a - base : place - b + length - base])
                piece = bytes(raw[place - y - base : place - x + length - base])
                out.append((xxhash.xxh3_64_intdigest(shared, seed=a) - (1 << 63), xxhash.xxh3_64_intdigest(piece, seed=x) - (1 << 63), doc, tie, place, x, y, piece))
    columns = list(zip(*out)) or [()] * 8
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.binary())], _UNIT)


def _cut(length: int, gram: int, spread: int):
    """(doc, tie, text, wanted) -> units of the wanted segments with their bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2, 1 << 22):
            doc, tie, text, wanted = batch.columns
            segments = (
                (d, t, w >> 16, w >> 8 & 255, w & 255, held, 0)
                for d, t, held, some in zip(doc.to_pylist(), tie.to_pylist(), (memoryview(x.as_buffer()) for x in text), wanted.to_pylist()) for w in some)
            yield _parted(segments, length, length - gram, spread)

    return cut


def _narrow(length: int, gram: int, spread: int):
    """Units -> narrower units."""

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie, place, lo, hi, raw = (c.to_pylist() for c in batch.columns[2:])
            yield _parted(((d, t, p, x, y, r, p - y) for d, t, p, x, y, r in zip(doc, tie, place, lo, hi, raw)), length, length - gram, spread)

    return narrow


def _by_transforms(units: DataFrame, length: int, bucket_bytes: int, shard_bytes: int) -> DataFrame:
    """Spans of units that occur earlier in another unit of their part, from the merged transforms of buckets of parts."""
    units = cut_lineage(units.select("part", "doc", "tie", (F.col("place") - F.col("hi")).alias("start"), "bytes"))
    size = units.agg(F.sum(F.length("bytes"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    shards = max(1, bucket_bytes // shard_bytes)
    # equal strings of two parts are found as well, and no less repeated
    dealt = units.select(
        F.pmod(F.xxhash64("part"), F.lit(buckets)).alias("bucket"), F.pmod(F.xxhash64("doc", "start"), F.lit(shards)).alias("shard"), "doc", "tie", "start", "bytes")
    built = dealt.groupBy("bucket", "shard").applyInArrow(_build, "bucket long, symbols binary, doc array<long>, tie array<long>, start array<long>")
    return built.groupBy("bucket").applyInArrow(_merge(length), _SPANS)


def repeated_spans(docs: DataFrame, length: int = 100, gram: int = GRAM, limit: int = 1000, bucket_bytes: int = 1 << 18, shard_bytes: int = 1 << 16, spreads: tuple[int, ...] = (34, 8, 0)) -> DataFrame:
    """Of each document (doc long, tie long, text binary) with repeated bytes an array of spans: doc, spans of (tie, first, last); they may overlap.

    Equal segments of a gram are one class; those behind its first place are repeated whole. Grams with several classes give units: their strings are
    parted by where they start before the gram, in runs of ``spreads`` + 1, and those of one run whose shared bytes agree are a part. Equal
    units are a class again, and what differs within a part goes through transforms, in buckets of ``bucket_bytes`` that stay in a
    processor's cache. Parts of more than ``limit`` classes are cut into narrower ones, in the end into single strings, which leave one class each. So
    no part is ever too large for a task.
    """
    grams = docs.mapInArrow(lambda b: _segments(b, length, gram, True), "gram long")
    again = cut_lineage(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"))
    segments = docs.mapInArrow(lambda b: _segments(b, length, gram, False), "gram long, same long, doc long, tie long, at long")
    live = cut_lineage(segments.join(again, "gram", "left_semi"))
    place, lo, hi = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(F.lit(255)), F.col("at").bitwiseAND(F.lit(255))
    classes = cut_lineage(live.groupBy("gram", "same").agg(F.min(F.struct("doc", (place - hi).alias("start"), "tie", "at")).alias("first")))

    def marks(rows: DataFrame, start: Column, end: Column, first: bool, level: int) -> DataFrame:
        # classes of two levels are different ones even if their bytes agree
        return rows.select("doc", "tie", F.xxhash64("same", F.lit(level)).alias("same"), start.cast("long").alias("first"), end.cast("long").alias("last"), F.lit(first).alias("mark"))

    heads = classes.select("same", "first.doc", "first.tie", "first.at")
    found = [marks(live, place - hi, place - lo + length, False, 0), marks(heads, place - hi, place - lo + length, True, 0)]
    several = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
    wanted = classes.join(several, "gram", "left_semi").groupBy(F.col("first.doc").alias("doc"), F.col("first.tie").alias("tie")).agg(F.collect_list("first.at").alias("wanted"))
    units = cut_lineage(docs.join(wanted, ["doc", "tie"]).select("doc", "tie", "text", "wanted").mapInArrow(_cut(length, gram, spreads[0]), _UNITS))
    start, end = F.col("place") - F.col("hi"), F.col("place") - F.col("lo") + length
    for level, spread in enumerate((*spreads[1:], None), 1):
        kinds = cut_lineage(units.groupBy("part", "same").agg(F.min(F.struct("doc", start.alias("start"), "tie", "place", "lo", "hi")).alias("u")).select("part", "same", "u.*"))
        found += [marks(units, start, end, False, level), marks(kinds, start, end, True, level)]
        sizes = kinds.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        chosen = kinds.join(sizes, "part").select("part", "same", "doc", "tie", "place", "n")
        held = cut_lineage(units.join(chosen, ["part", "same", "doc", "tie", "place"]).dropDuplicates(["part", "same", "doc", "tie", "place"]))
        later = _by_transforms(held.filter(F.col("n") <= limit), length, bucket_bytes, shard_bytes)
        found.append(marks(later.withColumn("same", F.lit(None).cast("long")), F.col("first"), F.col("last"), False, -1))
        large = held.filter(F.col("n") > limit).select(*_UNIT)
        if spread is None or not large.limit(1).count():
            break
        units = cut_lineage(large.mapInArrow(_narrow(length, gram, spread), _UNITS))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.groupBy("doc").agg(F.collect_list(F.struct("tie", "same", "first", "last", "mark")).alias("marks"))


def _runs(marks: pa.Array, ties: np.ndarray) -> list[list[list[int]]]:
    """Merged spans of each text: all marks but those of classes that have their first place here."""
    counts = pc.fill_null(marks.value_lengths(), 0).to_numpy(zero_copy_only=False)
    tie, same, first, last, head = (pc.struct_field(marks.flatten(), i) for i in range(5))
    row = np.repeat(np.arange(len(counts)), counts)
    known, same = same.is_valid().to_numpy(zero_copy_only=False), same.fill_null(0).to_numpy()
    tie, first, last, head = tie.to_numpy(), first.to_numpy(), last.to_numpy(), head.to_numpy(zero_copy_only=False)
    # a class and its place, first places before the others
    order = np.lexsort((~head, first, same, known, row))
    a = [c[order] for c in (row, known, same, first)]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in a])
    led = head[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else new
    stay = order[~led]
    stay = stay[tie[stay] == ties[row[stay]]]
    stay = stay[np.lexsort((first[stay], row[stay]))]
    row, first, last = row[stay], first[stay], last[stay]
    out: list[list[list[int]]] = [[] for _ in range(len(counts))]
    if len(row):
        far = int(last.max()) + 1
        reach = np.maximum.accumulate(row * far + last)
        begins = np.ones(len(row), bool)
        begins[1:] = row[1:] * far + first[1:] > reach[:-1]
        at = np.flatnonzero(begins)
        ends = reach[np.append(at[1:], len(row)) - 1] - row[at] * far
        for r, x, y in zip(row[at].tolist(), first[at].tolist(), ends.tolist()):
            out[r].append([x, y])
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tie, text, marks) -> what is left of each text, as runs are merged and cut out."""
    for batch in text_slices(batches, 2):
        sizes, removed, runs, digests, left = [], [], [], [], []
        for raw, merged in zip(batch.column(2), _runs(batch.column(3), batch.column(1).to_numpy())):
            held = memoryview(raw.as_buffer())
            at, kept = 0, []
            for a, b in merged:
                kept.append(held[at:a])
                at = b
            kept = b"".join([*kept, held[at:]])
            sizes.append(len(held))
            removed.append(len(held) - len(kept))
            runs.append(merged)
            digests.append(hashlib.sha256(kept).hexdigest())
            left.append(kept)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(digests, pa.string()), pa.array(left, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100, **settings) -> DataFrame:
    """Texts without the bytes that lie in a string of ``length`` bytes that also starts earlier.

    Places are ordered by document id (null first) and byte; rows that repeat an id are one document whose equal places are
    not earlier than each other. Texts are compared as UTF-8 bytes, null and empty ones have none, and shorter ones
    than ``length`` stay whole. Spans are judged on the input. An empty table gives no rows; further columns are ignored.

    Returns doc_id, n_bytes, n_removed, spans (array of [first, last) byte bounds), kept_sha256, kept (the bytes left).
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), raw.alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "text")
    # texts of one id are told apart by their hash, where an id repeats at all
    repeated = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    rows = rows.withColumn("tie", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    marks = repeated_spans(rows.select("doc", "tie", "text"), length, **settings)
    joined = rows.join(marks, "doc", "left").select("doc_id", "tie", "text", "marks")
    return joined.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept_sha256 string, kept binary")


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
