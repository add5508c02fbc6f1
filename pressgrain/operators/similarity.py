"""Exact set-similarity joins over an index of the rarest tokens.

The tokens of a run are put in one order, the rarest first. Two sets that share enough tokens also share one among the first
tokens of each in this order (their prefixes), so only prefixes are joined and the most frequent tokens, which carry nearly all
pairs, are met by no one. What the two sets really share is counted afterwards on the pairs that met.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def rarity_index(sets: DataFrame, tokens: str, run: str = "run", unit: str = "unit_id") -> DataFrame:
    """(run, unit, size, ranked): each set's tokens as struct(n, token), n the number of sets of the run that hold it, rarest first."""
    rows = sets.select(run, unit, F.explode(F.array_distinct(tokens)).alias("token"))
    carried = rows.groupBy(run, "token").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(carried, [run, "token"]).groupBy(run, unit).agg(
        F.count(F.lit(1)).cast("int").alias("size"), F.array_sort(F.collect_list(F.struct("n", "token"))).alias("ranked"))


def _prefixes(index: DataFrame, needed: Column, run: str, unit: str) -> DataFrame:
    """Tokens of the first size - needed + 1 places with their places; those that only one set holds meet nobody."""
    cut = index.select(run, unit, "size", F.posexplode(F.slice("ranked", F.lit(1), F.greatest(F.col("size") - needed + 1, F.lit(0)).cast("int"))).alias("place", "x"))
    return cut.filter("x.n > 1").select(run, unit, "size", "place", F.col("x.token").alias("token"))


def _met(prefixes: DataFrame, enough: Column, run: str, unit: str) -> DataFrame:
    a, b = (prefixes.select(run, "token", F.col(unit).alias(u), F.col("size").alias(f"size_{s}"), F.col("place").alias(f"place_{s}")) for u, s in (("src", "a"), ("dst", "b")))
    return a.join(b, [run, "token"]).filter((F.col("src") > F.col("dst")) & enough).select(run, "src", "dst").distinct()


def jaccard_candidates(sets: DataFrame, tokens: str, threshold: float, run: str = "run", unit: str = "unit_id") -> DataFrame:
    """(run, src, dst), src after dst, of all pairs that may have a Jaccard similarity of ``threshold``: none that has it is missing.

    Such a pair shares at least threshold x size tokens of either set, so prefixes of size - ceil(threshold x size) + 1 tokens meet. A meeting
    counts if the sizes allow the similarity and enough tokens are left behind the places where the two met first.
    """
    # a hair below the threshold, so that no rounding of sizes loses a pair
    least = threshold - 1e-9
    index = rarity_index(sets, tokens, run, unit)
    prefixes = _prefixes(index, F.ceil(F.col("size") * least), run, unit)
    sizes = (F.col("size_a") >= F.col("size_b") * least) & (F.col("size_b") >= F.col("size_a") * least)
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    return _met(prefixes, sizes & (left * (1 + least) >= (F.col("size_a") + F.col("size_b")) * least), run, unit)


def overlap_candidates(sets: DataFrame, tokens: str, overlap: int, run: str = "run", unit: str = "unit_id") -> DataFrame:
    """(run, src, dst) of all pairs that may share ``overlap`` tokens; with 1 these are the pairs that share one."""
    prefixes = _prefixes(rarity_index(sets, tokens, run, unit), F.lit(overlap), run, unit)
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    return _met(prefixes, left >= overlap, run, unit)


def shared_counts(pairs: DataFrame, sets: DataFrame, columns: Sequence[tuple[str, str]], run: str = "run", unit: str = "unit_id") -> DataFrame:
    """``pairs`` with the number of tokens both sets share in each of ``columns``, (token column, name of the count)."""
    left = sets.select(run, F.col(unit).alias("src"), *[F.col(c).alias(f"l_{c}") for c, _ in columns])
    right = sets.select(run, F.col(unit).alias("dst"), *[F.col(c).alias(f"r_{c}") for c, _ in columns])
    joined = pairs.join(left, [run, "src"]).join(right, [run, "dst"])
    return joined.select(run, "src", "dst", *[F.size(F.array_intersect(f"l_{c}", f"r_{c}")).cast("long").alias(n) for c, n in columns])
