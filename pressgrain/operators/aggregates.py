"""Aggregations over articles, runs, issues and operations tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressgrain.functions import columns as C
from pressgrain.operators.common import scalar
from pressgrain.operators.predicates import active_content


def date_spine(spark: SparkSession, first: str, last: str, max_days: int = 31) -> DataFrame:
    """One row per date; reversed or over-long ranges are refused."""
    days = (date.fromisoformat(last) - date.fromisoformat(first)).days + 1
    if days < 1 or days > max_days:
        raise ValueError(f"date range of {days} days is not within 1..{max_days}")
    days_df = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("d"))
    return days_df.select(F.date_format("d", "yyyy-MM-dd").alias("target_date"))


def evidence_union(*sides: DataFrame) -> DataFrame:
    """Distinct article ids over several evidence tables."""
    out = sides[0].select("article_id")
    for df in sides[1:]:
        out = out.union(df.select("article_id"))
    return out.distinct()


def collection_health(articles: DataFrame, sources: DataFrame, contents: DataFrame, signals: DataFrame, profiles: DataFrame, now: Column) -> DataFrame:
    """Headline counts, one row; each count is its own scalar subquery over its own table."""
    usable = active_content(contents, now)
    union = evidence_union(usable, signals, profiles)
    distinct = F.count_distinct("article_id")
    return articles.agg(F.count(F.lit(1)).alias("article_count")).select(
        scalar(sources.filter("active"), F.count(F.lit(1))).alias("configured_sources"),
        "article_count",
        scalar(usable, distinct).alias("authorized_content_count"),
        scalar(signals, distinct).alias("transient_evidence_count"),
        scalar(union, F.count(F.lit(1))).alias("body_evidence_count"),
    )


def collection_status(articles: DataFrame, contents: DataFrame, profiles: DataFrame, first: str, last: str) -> DataFrame:
    """Window totals: articles and sources, content by status, next expiry, profiles by status."""
    a = articles.filter(C.in_kst_days(F.col("published_at"), first, last))
    ids = a.select("article_id")
    c = contents.join(ids, "article_id", "left_semi")
    p = profiles.join(ids, "article_id", "left_semi")
    return a.agg(
        F.count(F.lit(1)).alias("article_count"), F.count_distinct("source_id").alias("source_count"),
        F.max("collected_at").alias("latest_collected_at"),
    ).select(
        "*",
        scalar(c, F.count_if(F.col("status") == "active")).alias("active_count"),
        scalar(c, F.count_if(F.col("status") == "purged")).alias("purged_count"),
        scalar(c, F.min(F.when(F.col("status") == "active", F.col("expires_at")))).alias("next_expiry_at"),
        scalar(p, F.count_if(F.col("status") == "succeeded")).alias("analyzed_count"),
        scalar(p, F.count_if(F.col("status") == "failed")).alias("failed_count"),
    )


def collection_status_by_source(articles: DataFrame, first: str, last: str) -> DataFrame:
    return articles.filter(C.in_kst_days(F.col("published_at"), first, last)).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("article_count"), F.max("collected_at").alias("latest_collected_at"))


def articles_per_kst_day(articles: DataFrame) -> DataFrame:
    return articles.groupBy(C.kst_date(F.col("published_at")).alias("target_date")).agg(F.count(F.lit(1)).alias("article_count"))


def state_counts(states: DataFrame, domain: Sequence[str], day: str | None = None) -> DataFrame:
    """Rows per state, zero for a state that never occurs."""
    rows = states if day is None else states.filter(C.in_kst_days(F.col("updated_at"), day))
    counts = rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    spine = states.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in domain])).alias("state"))
    return spine.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def scoped_issue_metrics(members: DataFrame, articles: DataFrame, sources: DataFrame, contents: DataFrame, profiles: DataFrame,
                         placements: DataFrame, now: Column, configured: int) -> DataFrame:
    """Per issue counts and derived scores over one source scope."""
    flags = {
        "_c": active_content(contents, now),
        "_p": profiles.filter(F.col("status") == "succeeded"),
        "_o": placements,
    }
    rows = members.join(sources.select("source_id"), "source_id", "left_semi").join(
        articles.select("article_id", "homepage_placement"), "article_id")
    for name, df in flags.items():
        rows = rows.join(df.select("article_id").distinct().withColumn(name, F.lit(True)), "article_id", "left")
    m = rows.groupBy("issue_id").agg(
        F.count(F.lit(1)).alias("article_count"),
        F.count_distinct("source_id").alias("source_count"),
        F.count_if(F.col("_c")).alias("content_available_count"),
        F.count_if(F.col("_p")).alias("structured_profile_count"),
        F.count_if(F.col("homepage_placement").isNotNull() | F.col("_o").isNotNull()).alias("placement_observed_count"),
    )
    return m.withColumns({
        "agenda_score": C.scoped_score(F.col("source_count"), F.col("article_count"), configured),
        "diversity_score": C.half_up(F.col("source_count") * F.lit(100.0) / F.lit(float(configured)), 1),
        "placement_score": C.half_up(F.col("placement_observed_count") * F.lit(100.0) / F.col("article_count"), 1),
        "volume_score": C.half_up(F.least("article_count", F.lit(10)) * F.lit(10.0), 1),
    })


def outlet_coverage(members: DataFrame, articles: DataFrame) -> DataFrame:
    """Per issue and outlet: articles and the strongest homepage zone."""
    zone = F.col("homepage_placement")
    weight = F.when(zone == "top", 4).when(zone == "main", 3).when(zone == "section", 2).when(zone == "list", 1).otherwise(0)
    return members.join(articles.select("article_id", "homepage_placement"), "article_id").groupBy("issue_id", "source_id").agg(
        F.count(F.lit(1)).alias("article_count"), F.max(weight).cast("bigint").alias("placement_weight"))


def category_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("run_id", "category").agg(F.count(F.lit(1)).alias("issues"))


def import_source_results(incoming: DataFrame, current: DataFrame, sources: DataFrame) -> DataFrame:
    """Per panel source: received, inserted, duplicates; a source with nothing received is skipped."""
    known = current.select("canonical_url").distinct().withColumn("_dup", F.lit(1))
    per = incoming.join(known, "canonical_url", "left").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.col("_dup").isNull()).alias("inserted"))
    return sources.select("source_id").join(per, "source_id", "left").select(
        "source_id", F.coalesce("received", F.lit(0)).alias("received"), F.coalesce("inserted", F.lit(0)).alias("inserted"),
        (F.coalesce("received", F.lit(0)) - F.coalesce("inserted", F.lit(0))).alias("duplicates"),
        F.when(F.coalesce("received", F.lit(0)) > 0, "success").otherwise("skipped").alias("status"))


def ops_status(jobs: DataFrame, outbox: DataFrame, letters: DataFrame) -> DataFrame:
    """Counts per job status, outbox status, and open dead letters, as (kind, status, n) rows."""
    n = F.count(F.lit(1)).alias("n")
    a = jobs.groupBy(F.lit("job").alias("kind"), "status").agg(n)
    b = outbox.groupBy(F.lit("outbox").alias("kind"), "status").agg(n)
    c = letters.filter(F.col("redriven_at").isNull()).agg(n).select(F.lit("dead_letter").alias("kind"), F.lit("open").alias("status"), "n")
    return a.unionByName(b).unionByName(c)


def coder_agreement(pairs: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Percent agreement per issue and dimension (long rows), from one boolean column per dimension."""
    long = pairs.select("issue_id", "article_id", F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).alias("agree")) for d in dimensions])).alias("x")).select("issue_id", "article_id", "x.*")
    return long.groupBy("issue_id", "dimension").agg(
        F.count(F.lit(1)).alias("articles"), F.count_if("agree").alias("agreed")).withColumn(
        "agreement", C.half_up(C.ratio(F.col("agreed"), F.col("articles")), 3))


def coder_agreement_summary(pairs: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Mean agreement over dimensions and number of articles on which every dimension agrees."""
    agreed = sum((F.col(d).cast("int") for d in dimensions), F.lit(0))
    return pairs.groupBy("issue_id").agg(
        F.count(F.lit(1)).alias("articles"),
        F.count_if(agreed == len(dimensions)).alias("full_agreement"),
        C.half_up(C.ratio(F.sum(agreed), F.count(F.lit(1)) * len(dimensions)), 3).alias("mean_agreement"))


def review_quality_metrics(reviews: DataFrame, minimum: int = 30, target: int = 50) -> DataFrame:
    """Reviewer-based precision, recall and merge rates; percentages to one decimal, null on empty."""
    articles = F.greatest(F.col("articles"), F.lit(0))
    wrong = F.least(articles, F.greatest(F.col("misplaced"), F.lit(0)))
    weight = F.when(F.col("verdict") == "correct", 2).when(F.col("verdict") == "partial", 1).otherwise(0)
    s = reviews.agg(
        F.count(F.lit(1)).alias("n"), F.sum(articles).alias("predicted"), F.sum(articles - wrong).alias("related"),
        F.sum(F.greatest(F.col("missing"), F.lit(0))).alias("missed"), F.sum(weight).alias("w2"))
    pct = lambda a, b: C.half_up(C.ratio(a * F.lit(100.0), b), 1)
    related, predicted, missed = F.col("related"), F.col("predicted"), F.col("missed")
    return s.select(
        F.col("n").alias("reviewed"),
        F.when(F.col("n") >= minimum, "ready").otherwise("collecting").alias("sample_status"),
        pct(F.least("n", F.lit(target)), F.lit(target)).alias("progress"),
        pct(related, predicted).alias("precision"),
        pct(related, related + missed).alias("recall"),
        pct(predicted - related, predicted).alias("overmerge"),
        pct(missed, related + missed).alias("undermerge"),
        pct(F.col("w2"), F.col("n") * 2).alias("cluster_agreement"),
    )


def token_cost_estimate(docs: DataFrame, max_chars: int, chars_per_token: int, usd_per_million: float,
                        run_tokens: int, day_tokens: int) -> DataFrame:
    """Capped characters to tokens to dollars per (day, run), with cap violations flagged."""
    capped = F.least(F.col("chars"), F.lit(max_chars))
    tokens = F.floor((capped + F.lit(chars_per_token - 1)) / F.lit(chars_per_token)).cast("bigint")
    per_run = docs.groupBy("day", "run_id").agg(F.count(F.lit(1)).alias("articles"), F.sum(tokens).alias("tokens"))
    per_day = per_run.groupBy("day").agg(F.sum("tokens").alias("day_tokens"))
    return per_run.join(per_day, "day").select(
        "day", "run_id", "articles", "tokens", "day_tokens",
        C.half_up(F.col("tokens") * F.lit(usd_per_million) / F.lit(1e6), 6).alias("usd"),
        F.when(F.col("tokens") > run_tokens, "run_cap").when(F.col("day_tokens") > day_tokens, "day_cap").alias("violation"))
