"""Small relational patterns shared by the operators, written so that a hot key stays spread out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None = 1, rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows per key, or all of them with their rank if ``n`` is None.

    Spark turns the rank filter into a partial group limit before the shuffle, so at most ``n`` rows
    per key leave each map task however large the group is.
    """
    name = rank_col or "_rn"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = ranked if n is None else ranked.filter(F.col(name) <= n)
    return out if rank_col else out.drop(name)


def newest(df: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    """Ordered rows; with ``limit``, the first of them (each partition keeps ``limit`` rows before the merge)."""
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def lag_by_bucket(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: str, out: str) -> DataFrame:
    """``lag(value)`` inside ``keys`` without pulling one key into one task.

    The order is cut into ranges by ``bucket`` (which must not decrease along ``order``). Rows look
    back inside their own range; the first row of a range takes the last value of the nearest earlier
    range, found on one summary row per (key, range).
    """
    b = df.withColumn("_lag_b", bucket)
    inner = Window.partitionBy(*keys, "_lag_b").orderBy(*order)
    rows = b.withColumn("_lag_in", F.lag(value).over(inner)).withColumn("_lag_first", F.row_number().over(inner) == 1)
    last = b.groupBy(*keys, "_lag_b").agg(F.max_by(F.col(value), F.struct(*order)).alias("_lag_last"))
    carry = last.select(*keys, "_lag_b", F.lag("_lag_last").over(Window.partitionBy(*keys).orderBy("_lag_b")).alias("_lag_carry"))
    joined = rows.join(carry, [*keys, "_lag_b"], "left")
    return joined.withColumn(out, F.when(F.col("_lag_first"), F.col("_lag_carry")).otherwise(F.col("_lag_in"))).drop(
        "_lag_b", "_lag_in", "_lag_first", "_lag_carry")


def scalar(df: DataFrame, expr: Column) -> Column:
    """One-row aggregate as a scalar subquery: no join, and the value is folded into the plan once."""
    return df.select(expr).scalar()


def set_digest(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Order-free digest of the distinct ``value`` set of each group, plus its size.

    The set is cut into 4,096 slices by the hash of the value. A slice's digest is that of its sorted values, the set's
    digest that of the slice digests in slice order, so no task ever holds a whole hot group and every size has the same formula.
    """
    text = F.col(value).cast("string")
    distinct = df.select(*keys, text.alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    slices = distinct.withColumn("_slot", F.substring(F.sha2("_v", 256), 1, 3)).groupBy(*keys, "_slot").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("_v")), "\n"), 256).alias("_d"), F.count(F.lit(1)).alias("_c"))
    parts = slices.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_slot", "_d"))).alias("_p"), F.sum("_c").alias("set_size"))
    return parts.select(*keys, "set_size", F.sha2(F.array_join(F.transform("_p", lambda p: p["_d"]), "\n"), 256).alias("set_digest"))


def last_per_key(df: DataFrame, key: str, arrival: Sequence[str] = ()) -> DataFrame:
    """One row per key: the last by ``arrival``, ties by the other columns, reduced before the shuffle."""
    rest = [c for c in df.columns if c != key and c not in arrival]
    return df.groupBy(key).agg(F.max(F.struct(*arrival, *rest)).alias("_last")).select(key, "_last.*").select(*df.columns)
