"""Removal of repeated runs of lines: content-defined chunks and passages of a number of words, hashed, counted and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressgrain.llm.common import stage, table
from pressgrain.session import cut_lineage


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row.

    A plain column would be pasted into every later expression that names it, and inside a lambda it would then be
    computed anew for each element. A generator is a border that expressions don't cross.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _with_ends(df: DataFrame, text: str, divisor: int) -> DataFrame:
    """``df`` with _lines, the hashes of the lines without blanks around them, and _ends, the last line of each chunk."""
    df = _once(df, "_lines", F.split(F.col(text), "\n", -1))
    df = _once(df, "_hashes", F.transform("_lines", lambda x: F.xxhash64(F.trim(x))))
    ends_at = lambda i: F.pmod(F.xxhash64(F.when(i > 1, F.get("_hashes", i - 2)).otherwise(F.lit(0).cast("long")), F.get("_hashes", i - 1)), F.lit(divisor)) == 0
    return _once(df, "_ends", F.filter(F.sequence(F.lit(1), F.size("_lines")), lambda i: ends_at(i) | (i == F.size("_lines"))))


def _part(first: Column, n: Column) -> Column:
    return F.array_join(F.slice("_lines", first, n), "\n")


def _before(k: Column) -> Column:
    """Last line before the chunk of index ``k``."""
    return F.when(k > 0, F.get("_ends", k - 1)).otherwise(0)


def with_chunks(df: DataFrame, text: str, divisor: int) -> DataFrame:
    """``df`` with _chunks, the content-defined chunks of its text: array of struct(part, n lines).

    A rolling hash over the hashes of a line and the line before it decides whether a chunk ends behind the line: its
    remainder by ``divisor`` must be 0. White space around a line plays no role in it. The decision depends on two lines
    only, so text put in or taken out elsewhere moves no boundary, and chunks have ``divisor`` lines on average. The
    parts joined by line feeds are the text.
    """
    chunks = F.transform("_ends", lambda end, k: F.struct(_part(_before(k) + 1, end - _before(k)).alias("part"), (end - _before(k)).alias("n")))
    return _once(_with_ends(df, text, divisor), "_chunks", chunks).drop("_lines", "_hashes", "_ends")


def _span(first: Column, n: Column) -> Column:
    """A run of lines as one number, since arrays of numbers are made distinct by hashing, arrays of structs pair by pair."""
    return F.shiftleft(first.cast("long"), 32) + n.cast("long")


def _first(span: Column) -> Column:
    return F.shiftright(span, 32).cast("int")


def _n(span: Column) -> Column:
    return span.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def with_spans(df: DataFrame, text: str, divisor: int, min_lines: int, min_words: int, passage_words: int) -> DataFrame:
    """``df`` with _spans, the runs of lines that are looked for elsewhere: array of struct(span, hash).

    These are the chunks of ``min_lines`` lines and ``min_words`` words at least, and of each line the shortest run of
    ``passage_words`` words that begins with it and the shortest that ends with it. Such a run depends on its own lines
    only. So whatever lies around a repeated passage of that many words, of one line or of many, each of its lines is
    in a run inside the passage, and that run repeats as well.
    """
    df = _with_ends(df, text, divisor)
    chunks = F.transform("_ends", lambda end, k: F.struct((_before(k) + 1).alias("first"), (end - _before(k)).alias("n")))
    enough = lambda c: (c["n"] >= min_lines) & (F.size(F.split(F.trim(_part(c["first"], c["n"])), "\\s+")) >= min_words)
    counted = F.transform(F.filter(chunks, enough), lambda c: _span(c["first"], c["n"]))
    # of each word the number of its line; the window of passage_words words from word p on spans the lines (p) to (p + passage_words - 1)
    df = _once(df, "_owner", F.flatten(F.transform("_lines", lambda x, i: F.array_repeat(i + 1, F.regexp_count(x, F.lit("\\S+"))))))
    owner = lambda p: F.get("_owner", p)
    last = lambda p: p + passage_words - 1
    at_border = lambda p: ~owner(p - 1).eqNullSafe(owner(p)) | ~owner(last(p)).eqNullSafe(owner(last(p) + 1))
    windows = F.transform(F.filter(F.sequence(F.lit(0), F.size("_owner") - passage_words), at_border), lambda p: _span(owner(p), owner(last(p)) - owner(p) + 1))
    runs = F.when(F.size("_owner") >= passage_words, windows).otherwise(F.array().cast("array<bigint>"))
    spans = F.transform(F.array_distinct(F.concat(counted, runs)), lambda s: F.struct(s.alias("span"), F.xxhash64(F.slice("_hashes", _first(s), _n(s))).alias("hash")))
    return _once(df, "_spans", spans).drop("_lines", "_hashes", "_ends", "_owner")


def remove_repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", divisor: int = 3, min_lines: int = 2, min_words: int = 10, passage_words: int = 50) -> DataFrame:
    """``docs`` with every repeated run of lines but its first occurrence taken out of the text, and n_removed_chunks.

    Runs of lines are those of ``with_spans``: content-defined chunks of ``min_lines`` lines and ``min_words`` words at
    least (very short lines repeat by chance), and all lines of any repeated passage of ``passage_words`` words at least.
    The first occurrence of a run is that in the smallest (id, text hash, line). A line goes if it is in a run that
    occurs before, unless it is also in that earlier occurrence; so every line is left once at least.
    ``n_removed_chunks`` counts the pieces taken out, each of neighbouring lines.

    Hashes and places of runs are counted first, without their text. Documents with a run whose hash repeats are marked,
    which moves the texts once, and only those runs are compared, by their SHA-256 digests, since runs overlap and their
    bytes would move many times. Both counts are partly done before the shuffle, so a run that a third of all documents
    hold moves once for each task. The joins with texts are merge joins at every size.

    Rows with equal id and text are one document and are treated alike. Null and empty texts stay as they are; so does
    an unrepeated text, to the byte. Other columns are kept, except that an n_removed_chunks of the input is replaced.
    """
    names = [c for c in docs.columns if c.lower() != "n_removed_chunks"]
    # inside, the columns go by their places, so that none can clash with what is added to them
    docs = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)])
    kept, doc_id, text = docs.columns, f"k{names.index(doc_id)}", f"k{names.index(text)}"
    key = [F.col(doc_id).alias("_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("_key")]
    keyed = docs.select(*[F.col(f"`{c}`") for c in kept], *key)
    spans = with_spans(docs.select(*key, F.col(text).alias("_text")), "_text", divisor, min_lines, min_words, passage_words)
    places = cut_lineage(spans.select("_id", "_key", F.inline("_spans")))
    # one number stands for a place here: it only has to tell places apart
    at = F.xxhash64("_id", "_key", "span")
    repeated = places.groupBy("hash").agg(F.min(at).alias("one"), F.max(at).alias("other")).filter("one <> other").select("hash")
    suspects = places.join(repeated, "hash", "left_semi").select("_id", "_key", "span").distinct()

    def with_spans_of(df: DataFrame, found: DataFrame, name: str) -> DataFrame:
        """``df`` with the array of the spans that ``found`` has of each document, null for none."""
        own = found.groupBy("_id", "_key").agg(F.collect_list("span").alias(name))
        same = F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._key") == F.col("b._key"))
        return df.alias("a").join(own.alias("b").hint("merge"), same, "left").select("a.*", name)

    marked = stage(with_spans_of(keyed, suspects, "_maybe"))
    touched = marked.filter(F.col("_maybe").isNotNull())
    lined = _once(touched.select("_id", "_key", "_maybe", F.col(f"`{text}`").alias("_text")), "_lines", F.split("_text", "\n", -1))
    digests = F.transform("_maybe", lambda s: F.struct(s.alias("span"), F.unhex(F.sha2(_part(_first(s), _n(s)).cast("binary"), 256)).alias("digest")))
    compared = cut_lineage(lined.select("_id", "_key", F.inline(digests)))
    owners = compared.groupBy("digest").agg(F.min(F.struct("_id", "_key", "span")).alias("own"), F.count("*").alias("n")).filter("n > 1")
    same_document = F.col("_id").eqNullSafe(F.col("own._id")) & (F.col("_key") == F.col("own._key"))
    here, until = _first(F.col("span")), _first(F.col("span")) + _n(F.col("span"))
    start = F.when(same_document, F.greatest(here, _first(F.col("own.span")) + _n(F.col("own.span")))).otherwise(here)
    gone = compared.join(owners, "digest").select("_id", "_key", start.alias("start"), until.alias("until")).filter("start < until").select("_id", "_key", _span(F.col("start"), F.col("until") - F.col("start")).alias("span")).distinct()
    cut = with_spans_of(touched, gone, "_gone")
    lost = F.array_distinct(F.flatten(F.transform("_gone", lambda s: F.sequence(_first(s), _first(s) + _n(s) - 1))))
    cut = _once(_once(cut, "_lost", lost), "_lines", F.split(F.col(f"`{text}`"), "\n", -1))
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size("_lines")), F.col("_lost")), lambda i: F.get("_lines", i - 1)), "\n")
    clean = F.when(F.col("_gone").isNull(), F.col(f"`{text}`")).otherwise(left)
    pieces = F.size(F.array_except(F.col("_lost"), F.transform("_lost", lambda i: i + 1)))
    size = F.when(F.col("_gone").isNull(), 0).otherwise(pieces).alias("n_removed_chunks")
    done = cut.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in kept], size)
    every = marked.filter(F.col("_maybe").isNull()).select(*kept, F.lit(0).alias("n_removed_chunks")).unionByName(done)
    return every.select(*[F.col(k).alias(c) for k, c in zip(kept, names)], "n_removed_chunks")


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines, and how many pieces went."""
    docs = table(spark, sf_dir, "documents")
    return remove_repeated_chunks(docs.select("doc_id", "text"))
