"""Scores of whole texts under a probabilistic suffix tree learned from the corpus, beside a unigram base."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pressgrain.llm.common import held_out, shared_folder, slices, table
from pressgrain.llm.suffix_tree import END, GramCounter, SuffixAutomaton, grams, symbols
from pressgrain.session import cut_lineage

#: The end of a text as a token; no word holds a line feed.
END_WORD = xxhash.xxh3_64_intdigest(b"\n") - (1 << 63)


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes without ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


class _Hashes(dict):
    """64-bit hash of each word, kept for the words met first."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        if len(self) < 300_000:
            self[word] = value
        return value


_HASHES = _Hashes()


def _word_ids(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of some texts, ends included, and how many each text has."""
    sizes = np.array([len(w) + 1 for w in texts], np.int64)
    out = np.empty(int(sizes.sum()), np.int64)
    at = 0
    for words in texts:
        out[at : at + len(words)] = np.fromiter(map(_HASHES.__getitem__, words), np.int64, len(words))
        out[at + len(words)] = END_WORD
        at += len(words) + 1
    return out, sizes


def _in_chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """``docs`` (doc_id, held_out, text) written with a chunk number: runs of rows of one task, ``chunk_bytes`` each."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches, 64):
            size += batch.column(2).nbytes
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, chunk)), *batch.columns], ["chunk", *batch.schema.names])
            if size >= chunk_bytes:
                chunk, size = chunk + 1, 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    path = shared_folder(docs.sparkSession, "stages")
    docs.mapInArrow(number, f"chunk long, doc_id {kind}, held_out boolean, text string").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def fit_tree(training: DataFrame, depth: int, least_root: float) -> SuffixAutomaton:
    """Suffix tree of the ``text`` column of ``training``.

    Tasks count the runs of depth + 1 symbols; the counts of shorter contexts are sums of these. A context is a
    candidate if it occurs ``least_root`` times the root of the number of all symbols, so the contexts known grow with the corpus,
    and there are root / least_root of each length at most, which bounds what comes to the driver and is broadcast. It is retained if its next symbols diverge from those of the
    context without its oldest symbol: n * KL(context || shorter) must exceed k / 2 * ln(n) + 3 for n occurrences and k
    kinds of next symbols, as a description-length test asks. Everything is counted over all training texts.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = GramCounter()
        for batch in slices(batches):
            counter.add(grams(symbols([words_of(x) for x in batch.column(0).to_pylist()]), depth))
        counter.merge()
        for at in range(0, len(counter.codes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(counter.codes[at : at + (1 << 16)]), pa.array(counter.counts[at : at + (1 << 16)])], ["code", "n"])

    full = cut_lineage(training.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    total = full.agg(F.sum("n")).first()[0] or 0
    least = max(2.0, least_root * total**0.5)
    mask = lambda symbols_kept: (1 << (8 * symbols_kept)) - 1

    def of_length(length: int) -> DataFrame:
        """key (next symbol lowest), n, and nc, the occurrences of the context."""
        there = full.filter(F.shiftright("code", 8 * length).bitwiseAND(255) != 0) if length else full
        sums = there.groupBy(F.col("code").bitwiseAND(F.lit(mask(length + 1))).alias("key")).agg(F.sum("n").alias("n"))
        return sums.withColumn("context", F.shiftright("key", 8)).withColumn("nc", F.sum("n").over(Window.partitionBy("context")))

    # the symbols by themselves are the root; they are 256 rows at most
    rows = [of_length(0).select(F.lit(0).alias("length"), "key", "n")]
    for length in range(1, depth + 1):
        own = of_length(length).filter(F.col("nc") >= least)
        shorter = of_length(length - 1).select(F.col("key").alias("parent"), F.col("n").alias("pn"), F.col("nc").alias("pnc"))
        both = own.withColumn("parent", F.col("key").bitwiseAND(F.lit(mask(length)))).join(shorter, "parent")
        per_context = Window.partitionBy("context")
        gain = F.sum(F.col("n") * F.log((F.col("n") / F.col("nc")) / (F.col("pn") / F.col("pnc")))).over(per_context)
        kinds = F.count(F.lit(1)).over(per_context)
        rows.append(both.withColumn("gain", gain).withColumn("kinds", kinds).filter(F.col("gain") > F.col("kinds") / 2 * F.log("nc") + 3).select(F.lit(length).alias("length"), "key", "n"))
    found = [part.toPandas() for part in rows]
    codes = np.concatenate([f["key"].to_numpy(np.int64) for f in found])
    counts = np.concatenate([f["n"].to_numpy(np.int64) for f in found])
    return SuffixAutomaton(codes, counts, depth, {i: np.unique(f["key"].to_numpy(np.int64) >> 8) for i, f in enumerate(found) if i})


def score_texts(docs: DataFrame, held: Column, doc_id: str = "doc_id", text: str = "text", depth: int = 5, least_root: float = 0.03, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Score of every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words and one end. ``base_score`` is the smoothed unigram score with the counts of the texts that
    aren't ``held``. ``score`` is the log10 probability of the same tokens spelled out, a blank between two and an end
    behind the last, under the suffix tree of those texts: each symbol is predicted by the state of the longest
    retained suffix of what comes before it, within the text.

    Texts are numbered in chunks of bounded size. Each chunk sends its distinct words, as 64-bit hashes, to be counted
    and gets the counts back, so a frequent word moves once for each chunk and a task holds a chunk and its words. Of
    the tree, only the retained contexts (bounded by ``least_root``) are sent to the tasks.

    Null and empty texts are one end. Rows are scored each, also repeated ones or such without id; other columns are
    ignored; an empty table gives no rows. Without training texts all symbols are equally likely and the base is 0.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    staged = _in_chunks(docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text")), chunk_bytes)
    tree = docs.sparkSession.sparkContext.broadcast(fit_tree(staged.filter(~F.col("held_out")), depth, least_root))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(chunk: int, words: list[np.ndarray], train: list[np.ndarray]) -> pa.RecordBatch:
            ids, at = np.unique(np.concatenate(words), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(train), minlength=len(ids)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), chunk)), pa.array(ids), pa.array(n)], ["chunk", "word", "n"])

        now, words, train = None, [], []
        for batch in slices(batches):
            chunks = batch.column(0).to_numpy()
            texts = [words_of(x) for x in batch.column(2).to_pylist()]
            learned = ~batch.column(1).to_numpy(zero_copy_only=False)
            for chunk in np.unique(chunks):
                if now is not None and chunk != now:
                    yield put(now, words, train)
                    words, train = [], []
                now = chunk
                which = np.flatnonzero(chunks == chunk)
                ids, sizes = _word_ids([texts[i] for i in which])
                words.append(ids)
                train.append(np.repeat(learned[which].astype(np.int64), sizes))
        if now is not None:
            yield put(now, words, train)

    per_word = Window.partitionBy("word")
    counted = staged.select("chunk", "held_out", "text").mapInArrow(distinct, "chunk long, word long, n long")
    counted = counted.withColumn("c", F.sum("n").over(per_word)).withColumn("lead", F.row_number().over(per_word.orderBy("chunk")) == 1)
    vocabulary = cut_lineage(counted)
    totals = vocabulary.agg(F.sum("n"), F.sum((F.col("lead") & (F.col("c") > 0)).cast("long"))).first()
    tokens, kinds = totals[0] or 0, totals[1] or 0

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        ids, counts = known.column("word").to_numpy(), known.column("c").to_numpy()
        order = np.argsort(ids)
        ids, counts = ids[order], counts[order]
        base_of = np.log10((counts + 0.5) / (tokens + 0.5 * (kinds + 1)))
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in slices(iter(texts.select(["text"]).to_batches())):
            rows = [words_of(x) for x in batch.column(0).to_pylist()]
            found, sizes = _word_ids(rows)
            at = np.searchsorted(ids, found)
            starts = np.cumsum(sizes) - sizes
            stream = symbols(rows)
            ends = np.flatnonzero(stream == END)
            logs = tree.value.score(stream).astype(np.float64)
            parts.append((
                sizes, np.add.reduceat((counts[at] > 0).astype(np.int64), starts), np.add.reduceat(base_of[at], starts), np.add.reduceat(logs, np.concatenate([[0], ends[:-1] + 1]))))
        size, known_tokens, base, own = (np.concatenate(c) for c in zip(*parts)) if parts else (np.empty(0),) * 4
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": pa.array(size, pa.int64()), "n_known": pa.array(known_tokens, pa.int64()),
            "train_tokens": pa.array(np.full(len(size), tokens), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(own, pa.float64())})

    return staged.groupBy("chunk").cogroup(vocabulary.select("chunk", "word", "c").groupBy("chunk")).applyInArrow(
        score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), held_out("doc_id", 5, 1))

