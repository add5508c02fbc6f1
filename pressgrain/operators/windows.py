"""Window-shaped operators. Rank filters become partial group limits, so hot keys stay spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressgrain.functions import columns as C
from pressgrain.operators.common import lag_by_bucket, top_per_key

# fixed values: allowed job state transitions
TRANSITIONS = {
    "none": ("queued", "running"),
    "queued": ("running", "dead_letter"),
    "running": ("retry_wait", "succeeded", "review_needed", "dead_letter"),
    "retry_wait": ("queued", "running", "dead_letter"),
    "review_needed": ("queued", "running", "dead_letter"),
    "succeeded": (),
    "dead_letter": (),
}
# fixed values: categories listed after the others in a ranking
SECONDARY_CATEGORIES = ("스포츠", "생활·IT")


def latest_run_per_date(runs: DataFrame, issues: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Latest successful run per date, kept only if it has public issues."""
    best = top_per_key(runs.filter(F.col("status") == "success"), ["target_date"], [F.col("finished_at").desc(), F.col("run_id").desc()])
    public = issues.filter(F.col("category").isin(*categories)).groupBy("run_id").agg(F.count(F.lit(1)).alias("issue_count"))
    return best.join(public, "run_id")


def latest_attempt_per_date(runs: DataFrame) -> DataFrame:
    return top_per_key(runs, ["target_date"], [F.col("started_at").desc(), F.col("run_id").desc()])


def latest_analysis_per_article(profiles: DataFrame) -> DataFrame:
    return top_per_key(profiles, ["article_id"], [F.col("analyzed_at").desc(), F.col("profile_id").desc()])


def preferred_profile(profiles: DataFrame, provider_order: Sequence[str]) -> DataFrame:
    """First profile per article by provider priority, then recency."""
    priority = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in provider_order]), F.col("provider")), F.lit(0)), F.lit(99))
    return top_per_key(profiles, ["article_id"], [priority, F.col("analyzed_at").desc(), F.col("profile_id").desc()])


def current_state(states: DataFrame) -> DataFrame:
    """Latest state per item: an aggregate with map-side combine, no window."""
    return states.groupBy("item_id").agg(F.max_by("state", F.struct("updated_at", "seq")).alias("state"))


def illegal_transitions(states: DataFrame, allowed: dict[str, Sequence[str]] = TRANSITIONS) -> DataFrame:
    """Consecutive states of an item that the transition table does not allow."""
    steps = lag_by_bucket(states, ["item_id"], F.date_trunc("day", F.col("updated_at")), ["updated_at", "seq"], "state", "_prev")
    steps = steps.withColumn("from_state", F.coalesce("_prev", F.lit("none"))).drop("_prev")
    pairs = [f"{a}>{b}" for a, bs in allowed.items() for b in bs]
    return steps.filter(~F.concat_ws(">", "from_state", "state").isin(*pairs)).select(
        "item_id", "seq", "from_state", F.col("state").alias("to_state"))


def issue_rank(issues: DataFrame) -> DataFrame:
    """1 + number of issues of the run with a strictly higher score.

    Ranked on (run, score) counts rather than on rows: scores have one decimal, so this table is small.
    """
    per = issues.groupBy("run_id", "agenda_score").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy("run_id").orderBy(F.col("agenda_score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = per.select("run_id", "agenda_score", (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).alias("issue_rank"))
    return issues.join(ranks, ["run_id", "agenda_score"])


def agenda_rank(issues: DataFrame, per: Sequence[str] = ("run_id",), max_issues: int | None = None, secondary: Sequence[str] = SECONDARY_CATEGORIES) -> DataFrame:
    """Published order of a run: secondary categories last, then score, breadth, size, cohesion, title."""
    order = [F.col("category").isin(*secondary).cast("int"), F.col("agenda_score").desc(), F.col("source_count").desc(),
             F.col("article_count").desc(), F.col("cohesion_score").desc(), F.col("title"), F.col("issue_id")]
    return top_per_key(issues, list(per), order, max_issues, "agenda_rank")


def first_wins_dedupe(rows: DataFrame, key: str, arrival: Sequence[str]) -> DataFrame:
    """First writer per key in arrival order."""
    return top_per_key(rows, [key], [F.col(c) for c in arrival])


def source_budget(candidates: DataFrame, sources: DataFrame, total: int) -> DataFrame:
    """Rows picked under a run budget, spread over sources.

    First pass: every source gets total/n plus one of the remainder by its position. Second pass: what
    unproductive sources left over is handed to the others in source order. Only per-source counts are
    put in order, never the rows.
    """
    counts = candidates.groupBy("source_id").agg(F.count(F.lit(1)).alias("available"))
    n = sources.agg(F.count(F.lit(1))).scalar()
    panel = sources.select("source_id", "sample_order").join(counts, "source_id", "left").withColumn(
        "available", F.coalesce("available", F.lit(0)))
    panel = panel.withColumn("quota", F.floor(F.lit(total) / n) + (F.col("sample_order") <= F.pmod(F.lit(total), n)).cast("bigint"))
    panel = panel.withColumn("first", F.least("quota", "available"))
    before = Window.orderBy("sample_order").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    panel = panel.withColumns({
        "spare": F.lit(total) - F.sum("first").over(everything),
        "wanted_before": F.coalesce(F.sum(F.col("available") - F.col("first")).over(before), F.lit(0)),
    })
    extra = F.greatest(F.lit(0), F.least(F.col("available") - F.col("first"), F.col("spare") - F.col("wanted_before")))
    panel = panel.select("source_id", (F.col("first") + extra).alias("take"))
    ranked = top_per_key(candidates, ["source_id"], [F.col("published_at").desc(), F.col("article_id")], total, "_pos")
    return ranked.join(panel, "source_id").filter(F.col("_pos") <= F.col("take")).drop("_pos", "take")


def newest_n_per_source(rows: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` rows per source; ``truncated`` says whether the source had more."""
    counts = rows.groupBy("source_id").agg((F.count(F.lit(1)) > n).alias("truncated"))
    return top_per_key(rows, ["source_id"], [F.col("published_at").desc(), F.col("article_id")], n, "position").join(counts, "source_id")


def previous_success(runs: DataFrame) -> DataFrame:
    """For each successful run, the next older successful run of the same date (the rollback target)."""
    ok = runs.filter(F.col("status") == "success")
    return lag_by_bucket(ok, ["target_date"], F.date_trunc("hour", "finished_at"), ["finished_at", "run_id"], "run_id", "fallback_run_id")


def consecutive_line_dedupe(text: Column) -> Column:
    """Lines of a text without immediate repeats; each document is one row, so no window is needed."""
    # a lambda of one argument: F.trim itself takes two, and transform would give it the index as characters to trim
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    # compare each line with the one before it; dropping repeats of the previous kept line is the same test
    prev = F.concat(F.array(F.lit(None).cast("string")), F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))))
    pairs = F.arrays_zip(lines.alias("cur"), prev.alias("prev"))
    kept = F.filter(pairs, lambda p: ~p["cur"].eqNullSafe(p["prev"]))
    return F.array_join(F.transform(kept, lambda p: p["cur"]), "\n")


def lead_sentences(sentences: DataFrame, n: int = 2) -> DataFrame:
    """The first ``n`` sentences of each article."""
    return top_per_key(sentences, ["article_id"], [F.col("paragraph"), F.col("sentence")], n, "lead_position")


def representative_title(members: DataFrame, articles: DataFrame) -> DataFrame:
    """Per issue: the representative's title, else the most recent one. A plain aggregate."""
    rows = members.select("issue_id", "article_id", "is_representative").join(articles.select("article_id", "title", "published_at"), "article_id")
    return rows.groupBy("issue_id").agg(
        F.max_by("title", F.struct("is_representative", "published_at", "article_id")).alias("representative_title"))


def longest_body_per_url(contents: DataFrame, min_chars: int = 300) -> DataFrame:
    """Content id with the longest body per normalized URL; only ids and lengths are shuffled."""
    return contents.filter(F.col("body_chars") >= min_chars).groupBy("url").agg(
        F.max("body_chars").alias("body_chars"), F.max_by("content_id", F.struct(F.col("body_chars"), -F.col("content_id"))).alias("content_id"))
