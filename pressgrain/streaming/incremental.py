"""Batch twins of the incremental operators; the streaming forms are in ``streams``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressgrain.functions import columns as C


def late_rows(df: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows older than the lookback behind the newest event: reported, never lost."""
    newest = df.agg(F.max(ts)).scalar()
    return df.filter(F.col(ts) < newest - F.make_dt_interval(F.lit(days)))


def rate_window(actions: DataFrame, actor: str, ts: str, kind: str, limits: dict[str, int], minutes: int = 15) -> DataFrame:
    """Actions per actor, kind and fixed epoch-aligned window, with the over-limit flag."""
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return (
        actions.groupBy(F.col(actor).alias("actor"), F.col(kind).alias("kind"), F.window(ts, f"{minutes} minutes").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("actor", "kind", F.col("w.start").alias("window_start"), "n",
                (F.col("n") > F.coalesce(F.try_element_at(limit, F.col("kind")), F.lit(2**31))).alias("over_limit"))
    )


def slot_window(articles: DataFrame, ts: str = "published_at", hours: int = 6) -> DataFrame:
    """Articles per ``hours``-long slot of the local (UTC+9) day."""
    local = F.col(ts) + F.expr(f"INTERVAL {C.KST_HOURS} HOURS")
    return articles.withColumn("_l", local).groupBy(F.window("_l", f"{hours} hours").alias("w")).agg(
        F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("slot_start"), "n")


def expiry_sweep(contents: DataFrame, now: Column, hard_date: Column) -> DataFrame:
    """Retention: active rows past their expiry, or every active row once the hard date has come."""
    return contents.filter((F.col("status") == "active") & ((F.col("expires_at") <= now) | (now >= hard_date)))


def dead_letter_rows(jobs: DataFrame, now: Column, stale_days: int) -> DataFrame:
    """Unfinished jobs that ran out of attempts or waited too long, with the reason."""
    open_jobs = jobs.filter(F.col("status") != "done")
    reason = F.when(F.col("attempts") >= F.col("max_attempts"), "attempts_exhausted").when(
        F.col("due_at") < now - F.make_dt_interval(F.lit(stale_days)), "expired")
    return open_jobs.withColumn("reason", reason).filter(F.col("reason").isNotNull())
