"""Join-shaped operators. Spark picks the physical join; sizes decide on broadcasting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressgrain.functions import columns as C
from pressgrain.operators.common import newest, top_per_key
from pressgrain.operators.predicates import active_content


def article_source_join(articles: DataFrame, sources: DataFrame) -> DataFrame:
    return articles.join(sources, "source_id")


def progress_left_join(articles: DataFrame, profiles: DataFrame, extractor: str, provider: str, schema: str) -> DataFrame:
    """Totals of analyzed and failed profiles of one version over all articles."""
    p = profiles.filter((F.col("extractor_version") == extractor) & (F.col("provider") == provider) & (F.col("schema_version") == schema))
    per_article = p.groupBy("article_id").agg(
        F.count_if(F.col("status") == "succeeded").alias("_ok"), F.count_if(F.col("status") == "failed").alias("_bad"))
    joined = articles.select("article_id").join(per_article, "article_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("_ok"), F.lit(0)).alias("analyzed"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("failed"),
    )


def unanalyzed_bodies(contents: DataFrame, profiles: DataFrame, extractor: str, now: Column, limit: int) -> DataFrame:
    """Usable content without a profile of the current version, oldest first."""
    done = profiles.filter(F.col("extractor_version") == extractor).select("article_id")
    todo = active_content(contents, now).join(done, "article_id", "left_anti")
    return newest(todo, [F.col("acquired_at"), F.col("content_id")], limit)


def collection_candidates(articles: DataFrame, contents: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """Articles without usable content whose last attempt, if any, is due for a retry."""
    have = active_content(contents, now).select("article_id")
    last = attempts.groupBy("article_id").agg(
        F.max("attempted_at").alias("last_attempt"), F.max("attempt_count").alias("attempt_count"))
    delay = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), C.retry_delay_ms(F.col("attempt_count"), 900_000, 86_400_000) / F.lit(1000))
    due = F.col("last_attempt").isNull() | ((F.col("attempt_count") < 5) & (F.col("last_attempt") + delay <= now))
    return articles.select("article_id", "source_id").join(have, "article_id", "left_anti").join(last, "article_id", "left").filter(due)


def exists_flags(articles: DataFrame, contents: DataFrame, profiles: DataFrame, placements: DataFrame, now: Column) -> DataFrame:
    """0/1 columns for four existence tests; keys are made distinct before each join."""
    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select("article_id").distinct().withColumn(name, F.lit(1))

    out = articles.select("article_id", "homepage_placement")
    sides = {
        "has_content": active_content(contents, now),
        "has_profile": profiles.filter(F.col("status") == "succeeded"),
        "has_placement": placements,
    }
    for name, df in sides.items():
        out = out.join(flag(df, name), "article_id", "left")
    return out.select("article_id", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in sides],
                      F.greatest(F.coalesce("has_placement", F.lit(0)), F.col("homepage_placement").isNotNull().cast("int")).cast("bigint").alias("placement_seen"))


def runs_in_scope(runs: DataFrame, issues: DataFrame, members: DataFrame, sources: DataFrame, source_type: str) -> DataFrame:
    """Runs with at least one issue carried by a source in scope."""
    scope = sources.filter((F.col("source_type") == source_type) & F.col("active"))
    hit = members.join(scope, "source_id", "left_semi").select("issue_id").distinct()
    run_ids = issues.join(hit, "issue_id", "left_semi").select("run_id").distinct()
    return runs.join(run_ids, "run_id", "left_semi")


def latest_content_per_article(contents: DataFrame, now: Column) -> DataFrame:
    """Newest usable content of each article; equal times are all kept."""
    w = Window.partitionBy("article_id").orderBy(F.col("acquired_at").desc())
    return active_content(contents, now).withColumn("_r", F.rank().over(w)).filter("_r = 1").drop("_r")


def latest_placement_asof(placements: DataFrame) -> DataFrame:
    """Latest observation per article; ties by zone weight, then page rank, then id."""
    return top_per_key(placements, ["article_id"], [
        F.col("observed_at").desc(), C.zone_weight(F.col("zone")).desc(), F.col("page_rank"), F.col("observation_id")])


def receipt_disjunctive_join(events: DataFrame, receipts: DataFrame) -> DataFrame:
    """Join on id OR (destination, key), as two equi joins; a pair met twice is emitted once."""
    e = events.alias("e")
    r = receipts.select(*[F.col(c).alias(f"r_{c}") for c in receipts.columns]).alias("r")
    by_id = e.join(r, F.col("e.event_id") == F.col("r_event_id"))
    by_key = e.join(r, (F.col("e.destination") == F.col("r_destination")) & (F.col("e.idempotency_key") == F.col("r_idempotency_key"))
                    & (F.col("e.event_id") != F.col("r_event_id")))
    return by_id.unionByName(by_key)


def orphan_receipts(events: DataFrame, receipts: DataFrame) -> DataFrame:
    """Delivered events lacking a receipt, and receipts that disagree with their event."""
    pairs = receipt_disjunctive_join(events, receipts)
    mismatch = pairs.filter(
        (F.col("event_id") != F.col("r_event_id")) | (F.col("destination") != F.col("r_destination"))
        | (F.col("idempotency_key") != F.col("r_idempotency_key")) | (F.col("payload_version") != F.col("r_payload_version"))
    ).select("event_id", F.col("r_receipt_id").alias("receipt_id"), F.lit("mismatch").alias("reason"))
    delivered = events.filter(F.col("status") == "delivered")
    missing = (
        delivered.join(receipts.select("event_id"), "event_id", "left_anti")
        .join(receipts.select("destination", "idempotency_key"), ["destination", "idempotency_key"], "left_anti")
        .select("event_id", F.lit(None).cast("bigint").alias("receipt_id"), F.lit("missing_receipt").alias("reason"))
    )
    return mismatch.unionByName(missing)


def pending_publication(profiles: DataFrame, articles: DataFrame, pending: Sequence[str], day: str | None = None) -> DataFrame:
    """Latest profile per article when it is still pending, oldest first keys attached."""
    latest = top_per_key(profiles, ["article_id"], [F.col("analyzed_at").desc(), F.col("profile_id").desc()])
    rows = latest.filter(F.col("status").isin(*pending)).join(
        articles.select("article_id", "source_id", "canonical_url", "published_at"), "article_id")
    return rows if day is None else rows.filter(C.in_kst_days(F.col("published_at"), day))


def authorization_match(articles: DataFrame, approvals: DataFrame, on_date: str, scope: str) -> DataFrame:
    """Articles whose id, source, URL, business date and body hash are all bound by a valid approval."""
    valid = approvals.filter((F.col("valid_until") >= on_date) & (F.col("text_scope") == scope))
    return articles.join(valid, ["article_id", "source_id", "canonical_url", "published_date", "body_sha256"], "left_semi")


def pair_counts_from_groups(groups: DataFrame, group: str = "group_id", item: str = "article_id") -> DataFrame:
    """Unordered pairs inside each group, counted as n*(n-1)/2: no pair is ever materialized."""
    n = F.count_distinct(item)
    return groups.groupBy(group).agg(n.alias("members")).withColumn(
        "pairs", F.expr("members * (members - 1) div 2"))


def prefix_related_tokens(left: DataFrame, right: DataFrame, min_chars: int = 2, min_extra: int = 2) -> DataFrame:
    """Tokens equal, or one a prefix of another at least ``min_extra`` longer: an equi join on prefixes."""
    def prefixes(df: DataFrame) -> DataFrame:
        cut = F.sequence(F.lit(min_chars), F.greatest(F.length("token") - min_extra, F.lit(min_chars)))
        return (df.filter(F.length("token") >= min_chars + min_extra)
                .select("token", F.explode(F.transform(cut, lambda i: F.left(F.col("token"), i))).alias("stem")))

    l, r = left.select("token").distinct(), right.select("token").distinct()
    equal = l.join(r, "token").select(F.col("token").alias("a"), F.col("token").alias("b"))
    longer_left = prefixes(l).join(r.select(F.col("token").alias("b")), F.col("stem") == F.col("b")).select(F.col("token").alias("a"), "b")
    longer_right = prefixes(r).join(l.select(F.col("token").alias("a")), F.col("stem") == F.col("a")).select("a", F.col("token").alias("b"))
    return equal.unionByName(longer_left).unionByName(longer_right)


def evidence_bind(cited: DataFrame, index: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Keep cited evidence that exists in the index (and whose article is allowed); drop repeats."""
    keys = ["article_id", "paragraph", "sentence", "sentence_sha256"]
    kept = cited.join(index.select(*keys), keys, "left_semi")
    if allowed is not None:
        kept = kept.join(allowed.select("article_id"), "article_id", "left_semi")
    return kept.dropDuplicates()


def actor_paraphrase_join(speakers: DataFrame, items: DataFrame) -> DataFrame:
    return speakers.join(items, ["article_id", "paragraph", "sentence"])


def calendar_left_join(spine: DataFrame, runs: DataFrame, daily_counts: DataFrame) -> DataFrame:
    """Every day of the spine with its latest run; days without a run are pending or empty."""
    latest = top_per_key(runs, ["target_date"], [F.col("started_at").desc(), F.col("run_id").desc()])
    joined = spine.join(latest.select("target_date", "run_id", "status"), "target_date", "left").join(daily_counts, "target_date", "left")
    n = F.coalesce("article_count", F.lit(0))
    return joined.select("target_date", n.alias("article_count"), "run_id",
                         F.coalesce("status", F.when(n > 0, "pending").otherwise("empty")).alias("status"))


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys present on one side only, labelled with the side they are missing from."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("missing_from", F.lit("right")).unionByName(
        b.join(a, key, "left_anti").withColumn("missing_from", F.lit("left")))


def issue_frame_details(frames: DataFrame, sources: DataFrame, articles: DataFrame, contents: DataFrame) -> DataFrame:
    """Frame rows with their three optional dimensions."""
    return (
        frames.join(sources.select("source_id", "source_name"), "source_id", "left")
        .join(articles.select("article_id", "title"), "article_id", "left")
        .join(contents.select("content_id", "body_sha256"), "content_id", "left")
    )


def open_dead_letters(letters: DataFrame, jobs: DataFrame, limit: int) -> DataFrame:
    rows = letters.filter(F.col("redriven_at").isNull()).join(jobs.select("job_id", "queue", "status"), "job_id")
    return newest(rows, [F.col("failed_at"), F.col("dead_letter_id")], limit)


def delivery_readiness(issues: DataFrame, runs: DataFrame, comparisons: DataFrame) -> DataFrame:
    """An issue is deliverable only if its run succeeded and its comparison is for the same run and complete."""
    j = issues.join(runs.select("run_id", F.col("status").alias("run_status")), "run_id").join(
        comparisons.select("issue_id", F.col("run_id").alias("comparison_run_id"), F.col("status").alias("comparison_status")), "issue_id", "left")
    ready = (F.col("run_status") == "success") & (F.col("comparison_run_id") == F.col("run_id")) & (F.col("comparison_status") == "complete")
    return j.select("issue_id", "run_id", "run_status", "comparison_status", F.coalesce(ready, F.lit(False)).alias("deliverable"))


def ranking_to_rows(ranking: DataFrame, contents: DataFrame, min_chars: int) -> DataFrame:
    """Ranked ids back to source rows; a missing or short body becomes an error row."""
    best = contents.groupBy("article_id").agg(F.max("body_chars").alias("body_chars"))
    return ranking.join(best, "article_id", "left").withColumn(
        "error", F.when(F.col("body_chars").isNull(), "missing_body").when(F.col("body_chars") < min_chars, "short_body"))
