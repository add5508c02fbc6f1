"""Ordered pages, top-k lists and work queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pressgrain.functions import columns as C
from pressgrain.operators.common import newest, top_per_key


def offset_page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int) -> DataFrame:
    """One page with ``has_more``, which compares the total with the end of the page."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("has_more", total > offset + limit)


def keyset_page(posts: DataFrame, limit: int, after_ts: Column | None = None, after_id: int | None = None) -> DataFrame:
    """Feed page after a (created_at, id) cursor, newest first; limit + 1 rows tell if more follow."""
    df = posts
    if after_ts is not None:
        df = df.filter((F.col("created_at") < after_ts) | ((F.col("created_at") == after_ts) & (F.col("post_id") < after_id)))
    return newest(df, [F.col("created_at").desc(), F.col("post_id").desc()], limit + 1)


def hot_feed(posts: DataFrame, reactions: DataFrame, limit: int) -> DataFrame:
    """Posts by reaction count, then recency."""
    counts = reactions.groupBy("post_id").agg(F.count(F.lit(1)).alias("reaction_count"))
    rows = posts.join(counts, "post_id", "left").withColumn("reaction_count", F.coalesce("reaction_count", F.lit(0)))
    return newest(rows, [F.col("reaction_count").desc(), F.col("created_at").desc(), F.col("post_id").desc()], limit)


def top_issues(issues: DataFrame, k: int, min_articles: int = 3, min_sources: int = 2) -> DataFrame:
    ok = issues.filter((F.col("article_count") >= min_articles) & (F.col("source_count") >= min_sources))
    return newest(ok, [F.col("agenda_score").desc(), F.col("source_count").desc(), F.col("article_count").desc(), F.col("issue_id")], k)


def observed_component_rank(clusters: DataFrame, configured: int, max_articles: int = 50) -> DataFrame:
    """Metadata-only score of clusters: no placement part, volume against a fixed maximum."""
    n, s = F.col("article_count"), F.col("source_count")
    diversity = F.least(F.lit(100.0), s / F.lit(float(configured)) * 100.0)
    volume = F.least(F.lit(100.0), F.log1p(n.cast("double")) / F.log1p(F.lit(float(max_articles))) * 100.0)
    repeat = F.when(n > 1, (n - s) / (n - 1) * 100.0).otherwise(F.lit(0.0))
    base = (diversity * 0.55 + volume * 0.25 + repeat * 0.05) / F.lit(0.55 + 0.25 + 0.05)
    return clusters.withColumns({
        "agenda_score": C.half_up(base * C.coverage_factor(s, F.lit(configured)), 1),
        "diversity": C.half_up(diversity, 1), "volume": C.half_up(volume, 1), "repetition": C.half_up(repeat, 1)})


def due_work(jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    """Due jobs with attempts left, best first within each queue."""
    due = jobs.filter(F.col("status").isin("queued", "retry_wait") & (F.col("due_at") <= now) & (F.col("attempts") < F.col("max_attempts")))
    return top_per_key(due, ["queue"], [F.col("priority").desc(), F.col("due_at"), F.col("created_at"), F.col("job_id")], limit, "position")


def expiring_content(contents: DataFrame, now: Column, hard_date: Column, limit: int) -> DataFrame:
    """Content to purge, oldest expiry first."""
    rows = contents.filter((F.col("status") == "active") & ((F.col("expires_at") <= now) | (now >= hard_date)))
    return newest(rows, [F.col("expires_at"), F.col("content_id")], limit)


def top_terms(terms: DataFrame, k: int = 40) -> DataFrame:
    """Most frequent terms per article."""
    return top_per_key(terms, ["article_id"], [F.col("n").desc(), F.col("term")], k, "position")


def top_body_tokens(counts: DataFrame, k: int = 160) -> DataFrame:
    """Tokens per body by count, then length."""
    return top_per_key(counts, ["article_id"], [F.col("n").desc(), F.length("token").desc(), F.col("token")], k, "position")
