"""Language identification by compression with one dictionary for each language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pressgrain.llm.common import held_out, slices, table


def letters(text: Column) -> Column:
    """Lower-cased words with one blank between them: everything but letters and marks separates. Marks alone are no words."""
    words = F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{M}]+", " "))
    return F.when(words.rlike("\\p{L}"), words).otherwise("")


def fit_dictionaries(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", sample_docs: int = 400, piece_chars: int = 160, dictionary_bytes: int = 1 << 16) -> dict[str, bytes]:
    """Raw-content dictionary of each language from a bounded sample of labelled rows.

    Of each language the ``sample_docs`` rows with the smallest hash of key and text give a piece of ``piece_chars``
    characters each, from a place that the hash names; up to ``dictionary_bytes`` of them are the dictionary. These bounds are all that is
    learned from, so only sample_docs x piece_chars x languages characters come to the driver. Rows are counted first, and of a language with
    many more rows only those below a threshold of the hash go to the ranking, so that no language gathers in one task. Copies of a text count once.
    """
    rows = (
        labelled.select(F.col(lang).alias("lang"), letters(F.col(text)).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("h"))
        .filter(F.col("lang").isNotNull() & (F.col("text") != "")))
    counts = labelled.filter(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return {}
    # eight times the wanted rows, so that texts without letters and copies leave enough
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 8 * sample_docs / r["n"])))])
    at = F.pmod(F.col("h"), F.greatest(F.length("text") - piece_chars + 1, F.lit(1))).cast("int") + 1
    some = rows.filter(F.pmod(F.col("h"), F.lit(1 << 40)) < share[F.col("lang")] * (1 << 40)).select("lang", "h", F.substring("text", at, F.lit(piece_chars)).alias("text"))
    first = Window.partitionBy("lang").orderBy("h", "text")
    sample = some.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= sample_docs).select("lang", "h", "text").collect()
    texts: dict[str, dict[str, None]] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["h"], r["text"])):
        texts.setdefault(r["lang"], {})[r["text"]] = None
    return {name: "\n".join(found).encode()[:dictionary_bytes] for name, found in texts.items()}


class Classifier:
    """Sizes of a text under each dictionary; the zstandard contexts are made once per worker.

    A text is compressed in pieces of ``piece_bytes``, each with nothing before it but the dictionary, and the sizes of
    the pieces are summed. As one stream a long text would soon be its own dictionary, under every language alike.
    """

    def __init__(self, dictionaries: dict[str, bytes], level: int, piece_bytes: int):
        self.names, self.piece_bytes = sorted(dictionaries), piece_bytes
        self.coders = []
        for name in self.names:
            held = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        raw = memoryview(text.encode())
        pieces = [raw[i : i + self.piece_bytes] for i in range(0, len(raw), self.piece_bytes)]
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in self.coders], np.float64)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", levels: tuple[int, ...] = (1, 6), min_margin: float = 0.004, piece_bytes: int = 4_096) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and accepted.

    The whole text, lower-cased and reduced to its letters, is compressed under every dictionary in pieces of
    ``piece_bytes``, at each of ``levels``, which find matches of other lengths; the smallest sum names the language, and the margin doesn't depend on the length. ``score`` is 1 - smallest / second smallest size, and a text is accepted if that
    is ``min_margin`` at least. Ties go to the first name. With a single language the score is 1.

    A null text, or one without letters, is `und` with score 0 and not accepted, as is every text if nothing was
    learned. Rows and their other columns stay as they are; columns named like the results are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "accepted")]
    made: list[Classifier] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made and dictionaries:
            made.extend(Classifier(dictionaries, level, piece_bytes) for level in levels)
        for batch in slices(batches):
            names, scores = [], []
            for x in batch.column(batch.num_columns - 1).to_pylist():
                if not x or not dictionaries:
                    names.append("und")
                    scores.append(0.0)
                    continue
                sizes = sum(c.sizes(x) for c in made)
                best = int(sizes.argmin())
                rest = np.delete(sizes, best)
                names.append(made[0].names[best])
                scores.append(float(1 - sizes[best] / rest.min()) if len(rest) else 1.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([n != "und" and s >= min_margin for n, s in zip(names, scores)], pa.bool_())],
                [*kept, "lang_pred", "score", "accepted"])

    cleaned = docs.select(*[F.col(f"`{c}`") for c in kept], letters(F.col(text)).alias("_letters"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept] + ["lang_pred string", "score double", "accepted boolean"])
    return cleaned.mapInArrow(run, schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out("doc_id", 4, 2)
    dictionaries = fit_dictionaries(docs.filter(~held & F.col("lang").isNotNull()))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), dictionaries).drop("text")
