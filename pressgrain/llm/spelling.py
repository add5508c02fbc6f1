"""Grouping of spelling variants: bit-sliced position indexes over blocks of the vocabulary, walked for zero and one error at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgrain.llm.common import table
from pressgrain.llm.graph import block_pairs
from pressgrain.session import cut_lineage

#: What a word is made of, after A-Z are lower-cased (fixed value).
RUN = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
U = np.uint64


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 7, least_n: int = 2, every: int = 31) -> DataFrame:
    """(word, n) of the words of all whole texts. Where ``every`` divides h, the crc32 of ``<doc_id>:<run>``, the run loses its code point h % length."""
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    runs = docs.select(ident.alias("id"), F.explode(F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    size = F.length("run")
    long = runs.filter(size >= least_chars).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", size.cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    words = long.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)


class PositionIndex:
    """For every position and letter the set of the words that have this letter there, as bits; and the sets by length."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        n, self.longest = codes.shape
        self.words = -(-n // 64)
        self.rows, self.sets = [], []
        for position in range(self.longest + 1):
            letters = codes[:, position] if position < self.longest else np.zeros(n, np.uint8)
            present = np.unique(letters[letters > 0])
            row = np.zeros(256, np.int16)
            row[present] = np.arange(1, len(present) + 1)
            self.rows.append(row)
            # set 0 is that of a letter no word has here
            self.sets.append(np.concatenate([np.zeros((1, self.words), np.uint64), pack_bits(present[:, None] == letters[None, :])]))
        self.reaches = [pack_bits((lengths > p)[None, :])[0] for p in range(self.longest + 1)]
        self.by_length = {int(x): pack_bits((lengths == x)[None, :])[0] for x in np.unique(lengths)}

    def at(self, position: int, letters: np.ndarray) -> np.ndarray:
        """Sets of the words with these letters at this position, one row for each letter."""
        if not 0 <= position <= self.longest:
            return np.zeros((len(letters), self.words), np.uint64)
        return self.sets[position][self.rows[position][letters]]

    def one_error(self, queries: np.ndarray, length: int) -> np.ndarray:
        """Words at exactly one insertion, deletion or replacement from each query; queries are rows of codes of this length.

        After i letters of a query, ``same`` holds the words that begin with them. ``changed``, ``longer`` and ``shorter`` hold
        those that agree but for one letter, which was replaced, is in the word only, or in the query only; so the
        next letter is looked up at the same position, one further or one before.
        """
        none = np.zeros((len(queries), self.words), np.uint64)
        same, changed, longer, shorter = ~none, none, none, none
        for i in range(length):
            letters = queries[:, i]
            here = self.at(i, letters)
            changed = (changed & here) | (same & self.reaches[i] if i <= self.longest else none)
            longer = (longer | same) & self.at(i + 1, letters)
            shorter = (shorter & self.at(i - 1, letters)) | same
            same = same & here
        size = lambda n: self.by_length.get(n, none[0])
        return (changed & ~same & size(length)) | ((longer | same) & size(length + 1)) | (shorter & size(length - 1))


def pack_bits(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    rows, n = flags.shape
    padded = np.zeros((rows, -(-n // 64) * 64), bool)
    padded[:, :n] = flags
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def set_bits(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bit) of every bit that is set."""
    row, word = np.nonzero(sets)
    bits = np.unpackbits(sets[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, bit = np.nonzero(bits)
    return row[which], word[which] * 64 + bit


def _codes(words: list[str], longest: int) -> np.ndarray:
    out = np.zeros((len(words), longest), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out[np.arange(longest)[None, :] < lengths[:, None]] = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return out


def _near(group: pa.Table) -> pa.Table:
    """Entries of two blocks (word, n, side, half, _block) -> for each word its near words among them: their number, and the one of largest n.

    All entries of a group have the same side and half. A pair of near words agrees in the first ``half`` letters or in the last, half
    being half of the shorter length; it counts on side 0 if the first agree, and on side 1 only if they do not.
    """
    group = group.sort_by("word")
    words, n, block = group.column("word").to_pylist(), group.column("n").to_numpy(), group.column("_block").to_numpy()
    side, half = group.column("side")[0].as_py(), group.column("half")[0].as_py()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = _codes(words, 2 * half + 2)
    ends = _codes([w[::-1] for w in words], 2 * half + 2)[:, :half] if side else None
    index = PositionIndex(codes, lengths)
    other = {b: pack_bits((block != b)[None, :])[0] for b in np.unique(block)} if group.column("_i")[0].as_py() != group.column("_j")[0].as_py() else None
    found: list[tuple[np.ndarray, np.ndarray]] = []
    some = max(1, 40_000 // index.words)
    for length in range(2 * half, 2 * half + 3):
        for b in np.unique(block) if other else (None,):
            asked = np.flatnonzero((lengths == length) & (block == b) if other else lengths == length)
            for at in range(0, len(asked), some):
                rows = asked[at : at + some]
                sets = index.one_error(codes[rows], length)
                if other:
                    sets = sets & other[b]
                row, bit = set_bits(sets)
                left = rows[row]
                good = (lengths[left] + lengths[bit]) < 4 * half + 4
                fronts = (codes[left, :half] == codes[bit, :half]).all(axis=1)
                good &= ~fronts & (ends[left] == ends[bit]).all(axis=1) if side else fronts
                found.append((left[good], bit[good]))
    left, right = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    # words stand in code-point order, so that the smallest comes first among those of equal n
    order = np.lexsort((right, -n[right], left))
    left, right = left[order], right[order]
    heads = np.flatnonzero(np.diff(left, prepend=-1))
    names = group.column("word").combine_chunks()
    return pa.table({
        "word": names.take(pa.array(left[heads])), "n_near": np.diff(np.append(heads, len(left))), "best_n": n[right[heads]], "best": names.take(pa.array(right[heads]))})


def near_words(words: DataFrame, block: int = 8192) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have a near word.

    Two words at one error agree in their first or in their last letters, as many as half of the shorter one has. So each word is an entry
    under its two halves, for partners as long as itself and one letter longer, and for those one letter shorter. Entries with equal halves are put
    together with others into groups of about a block, and larger groups are dealt out in pairs of blocks.
    """
    size = F.length("word")
    halves = F.array_distinct(F.array(F.floor(size / 2).cast("int"), F.floor((size - 1) / 2).cast("int")))
    entries = words.select("word", "n", F.explode(halves).alias("half"))
    entries = entries.select("word", "n", "half", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    part = F.when(F.col("side") == 0, F.substring("word", F.lit(1), F.col("half"))).otherwise(F.substring("word", F.length("word") - F.col("half") + 1, F.col("half")))
    many = entries.groupBy("half", "side").agg(F.ceil(F.count(F.lit(1)) * 2 / block).cast("int").alias("_many"))
    placed = entries.join(many, ["half", "side"]).withColumn("bucket", F.concat_ws("/", "side", "half", F.pmod(F.xxhash64(part), F.col("_many")))).drop("_many")
    met = block_pairs(cut_lineage(placed), "bucket", "word", block)
    found = met.groupBy("bucket", "_i", "_j").applyInArrow(_near, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("o"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.o")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to. Each round doubles the steps a word has gone."""
    steps = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut_lineage(steps.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        steps = moved.drop("_moved")
        if not moved.filter("_moved").limit(1).count():
            return steps


def spelling_variants(words: DataFrame, ratio: int = 10, block: int = 8192) -> DataFrame:
    """Words (word, n) with their form, the near word of largest n (ties: the smallest) if it is ``ratio`` times as frequent, and its root.

    Returns word, form, root, n, n_near, form_n; an empty table gives no rows.
    """
    words = cut_lineage(words.select("word", F.col("n").cast("long").alias("n")))
    joined = words.join(near_words(words, block), "word", "left")
    has = F.col("best_n") >= F.col("n") * ratio
    formed = cut_lineage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    led = roots(formed.filter("form is not null").select("word", "form"))
    return formed.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have no words; a null id counts as ''; repeated rows count each; further columns are ignored."""
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))
