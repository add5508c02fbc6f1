"""From raw documents to packed training sequences: language, repeated lines, near copies, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgrain.llm import decontaminate, lang_id, line_chunks, near_text, packing
from pressgrain.llm.common import held_out, table
from pressgrain.session import cut_lineage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; texts without letters and undecided ones go."""
    labelled = docs.filter(~held_out("doc_id", 4, 2) & F.col("lang").isNotNull())
    named = lang_id.identify(docs, lang_id.fit_dictionaries(labelled))
    return named.filter("accepted").select(docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated chunks of lines; a document that consists of them only goes."""
    cut = line_chunks.remove_repeated_chunks(docs)
    left = cut.filter((F.col("n_removed_chunks") == 0) | (F.trim(F.regexp_replace("text", "\\s+", " ")) != ""))
    sized = left.withColumn("n_chars", F.when(F.col("n_removed_chunks") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return sized.select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five words, 80 %), and all rows without id."""
    groups = near_text.near_duplicates(docs)
    kept = groups.filter("kept").select(F.col("doc_id").alias("_kept")).filter("_kept is not null").distinct()
    return docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi").unionByName(docs.filter("doc_id is null"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids."""
    import public_tokenizers

    # the Python workers serve all stages: half of the usual pieces are kept, so that the later ones find room
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), kept_pieces=400_000)


STAGES = [
    ("language_id", language),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("packing", sequences),
]

#: Compression sizes, signatures and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
