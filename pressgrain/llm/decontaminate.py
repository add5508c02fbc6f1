"""Benchmark passages in documents, found with a few edits: shared q-grams in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgrain.llm.common import slices, table

_MULTIPLIER = 0x9E3779B97F4A7C15


def normal(text: str | None) -> str:
    """Lower case, white space runs as one blank, trimmed."""
    return " ".join((text or "").lower().split())


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hash of each run of ``q`` code points, put together from runs of the powers of two in q."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, length, run, size = None, 0, codes.astype(np.uint64), 1
    with np.errstate(over="ignore"):
        while True:
            if q & size:
                shift = np.uint64(pow(_MULTIPLIER, size, 1 << 64))
                out = run[:n] if out is None else out * shift + run[length : length + n]
                length += size
            if 2 * size > q:
                return out
            run = run[: len(run) - size] * np.uint64(pow(_MULTIPLIER, size, 1 << 64)) + run[size:]
            size *= 2


def _slot(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(42)).astype(np.int64)


class BenchmarkIndex:
    """q-grams of a block of benchmark items.

    An item of m characters may be found with e = floor(rate * m) edits. Such an occurrence shares m + 1 - q(e + 1)
    q-grams with the item at least (the q-gram lemma), all on diagonals within e of each other. Items for which that
    bound isn't positive, since they are short, get the largest edit budget for which it is; items shorter than q are
    looked for as they are.
    """

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.q = q
        named = [(i, normal(t)) for i, t in items]
        self.short = [(i, t) for i, t in named if 0 < len(t) < q]
        kept = [(i, t) for i, t in named if len(t) >= q]
        self.ids = [i for i, _ in kept]
        self.codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for _, t in kept]
        lengths = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.maximum(np.minimum((rate * lengths).astype(np.int64), lengths // q - 1), 0)
        self.need = lengths + 1 - q * (self.budget + 1)
        hashes = [gram_hashes(c, q) for c in self.codes]
        every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.hashes, first = np.unique(every[order], return_index=True)
        self.cuts = np.concatenate([first, [len(every)]])
        self.item, self.place = item[order], place[order]
        # most q-grams of a text are in no item; a bit map tells that without a search
        self.bits = np.zeros(1 << 22, bool)
        self.bits[_slot(self.hashes)] = True

    def candidates(self, hashes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(text, item, places in the texts, places in the item) of shared q-grams, if a text shares enough of them.

        ``hashes`` are of texts laid end to end, which end at ``ends``.
        """
        at = np.flatnonzero(self.bits[_slot(hashes)])
        if not len(at) or not len(self.hashes):
            return
        slot = np.searchsorted(self.hashes, hashes[at])
        slot[slot == len(self.hashes)] = 0
        text = np.searchsorted(ends, at, side="right")
        same = (self.hashes[slot] == hashes[at]) & (at + self.q <= ends[np.minimum(text, len(ends) - 1)])
        at, slot, text = at[same], slot[same], text[same]
        counts = self.cuts[slot + 1] - self.cuts[slot]
        where, text = np.repeat(at, counts), np.repeat(text, counts)
        entry = np.repeat(self.cuts[slot] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        item, place = self.item[entry], self.place[entry]
        key = text * len(self.ids) + item
        order = np.argsort(key, kind="stable")
        found, first, n = np.unique(key[order], return_index=True, return_counts=True)
        for k in np.flatnonzero(n >= self.need[found % len(self.ids)]):
            which = order[first[k] : first[k] + n[k]]
            yield int(found[k] // len(self.ids)), int(found[k] % len(self.ids)), where[which], place[which]

    def bands(self, item: int, where: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int]]:
        """First and last diagonal of the bands in which a text shares enough q-grams with an item.

        A band is twice e + 1 diagonals wide and overlaps the next by half, so any e + 1 neighbours lie in one. Equal
        places of the item count once in a band, else a text of repeats would look like all of it.
        """
        half = int(self.budget[item]) + 1
        cell = (where - place) // half
        for shift in (0, 1):
            pairs = np.unique(((cell + shift) // 2) * (1 << 32) + place)
            band, n = np.unique(pairs >> 32, return_counts=True)
            for b in band[n >= self.need[item]].tolist():
                low = (2 * b - shift) * half
                yield low, low + 2 * half - 1


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> int:
    """Least number of edits that turn ``item`` into some part of ``text`` whose path stays on the diagonals [low - budget,
    high + budget]; ``budget`` + 1 if it takes more than ``budget``.

    Row by row over the band only; a row is a few array operations, as the cost of running along it is a prefix minimum.
    """
    first, last = low - budget, high + budget
    width = last - first + 1
    far = budget + 1
    steps = np.arange(width)
    # cell k of row r is the text place r + first + k; a match may start anywhere in the text
    row = np.where((first + steps >= 0) & (first + steps <= len(text)), 0, far).astype(np.int64)
    for r in range(1, len(item) + 1):
        places = r + first + steps
        inside = (places >= 1) & (places <= len(text))
        letters = text[np.clip(places - 1, 0, len(text) - 1)]
        replaced = row + (letters != item[r - 1])
        dropped = np.append(row[1:], far) + 1
        now = np.minimum(np.where(inside, replaced, far), dropped)
        now[(places < 0) | (places > len(text))] = far
        now = np.minimum(np.minimum.accumulate(now - steps) + steps, far)
        if now.min() > budget:
            return far
        row = now
    return int(min(row.min(), far))


def find_in(index: BenchmarkIndex, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
    """(item id, place, edits) of the items found in each text, every item once, where it takes the fewest edits."""
    clean = [normal(t) for t in texts]
    found: list[dict[int, tuple[int, int]]] = [{i: (t.find(s), 0) for i, s in index.short if s in t} for t in clean]
    codes = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in clean])
    for text, item, where, place in index.candidates(gram_hashes(codes, index.q), ends):
        start = int(ends[text]) - len(clean[text])
        own, budget = codes[start : ends[text]], int(index.budget[item])
        best: tuple[int, int] | None = None
        for low, high in index.bands(item, where - start, place):
            edits = banded_distance(index.codes[item], own, low, high, budget)
            if edits <= budget and (best is None or edits < best[1]):
                best = (max(low, 0), edits)
            if best and best[1] == 0:
                break
        if best:
            found[text][index.ids[item]] = best
    return [sorted((i, place, edits) for i, (place, edits) in f.items()) for f in found]


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Benchmark items in blocks of bounded size, fetched one after the other."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).filter("i is not null and t is not null")
    for row in rows.toLocalIterator():
        block.append((row["i"], row["t"]))
        size += len(row["t"])
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08, block_chars: int = 1 << 21, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, place (of the region in the normalised text), edits.

    Texts are compared in lower case with single blanks, an item of m characters with floor(rate * m) edits at most.
    Every whole text is searched for all items; the items are a stated query set that the tasks get in blocks of
    ``block_chars`` characters, so nothing that grows is held at once, and documents don't move. The text streams through
    one pass for each block.

    Null and empty texts hold nothing; items that are null, blank or without id are not looked for; an empty benchmark
    gives no rows; repeated rows give their findings each; further columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {kind}, item_id long, place long, edits long"

    def search(items: list[tuple[int, str]]) -> DataFrame:
        held = chosen.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = None
            for batch in slices(batches, 64):
                index = index or BenchmarkIndex(held.value, q, rate)
                found = find_in(index, batch.column(1).to_pylist())
                rows = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
                flat = [x for f in found for x in f]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array([x[k] for x in flat], pa.int64()) for k in range(3))], ["doc_id", "item_id", "place", "edits"])

        return chosen.mapInArrow(run, schema)

    out = None
    for items in _blocks(benchmark, item_id, item_text, block_chars):
        part = search(items)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08, block_chars: int = 1 << 21, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item, found as in ``contamination``.

    Rows are dropped where they are read, so nothing is shuffled; all other rows and their columns stay as they are.
    """
    named = docs.columns.index(text)

    def without(kept: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = None
            for batch in slices(batches, 64):
                index = index or BenchmarkIndex(held.value, q, rate)
                yield batch.filter(pa.array([not f for f in find_in(index, batch.column(named).to_pylist())], pa.bool_()))

        return kept.mapInArrow(run, docs.schema)

    out = docs
    for items in _blocks(benchmark, item_id, item_text, block_chars):
        out = without(out, items)
    return out


def op7_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
