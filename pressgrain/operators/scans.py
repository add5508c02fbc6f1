"""Scans, imports and merges over article tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressgrain.functions import columns as C
from pressgrain.operators.common import last_per_key, newest, top_per_key

# fixed values: header aliases of a provider export
HEADER_ALIASES = {
    "news_id": ("뉴스식별자", "news_id"),
    "published_at": ("일자", "날짜", "published_at"),
    "source": ("언론사", "source"),
    "title": ("제목", "title"),
    "section": ("통합분류1", "분야", "section"),
    "excerpt": ("본문", "body_excerpt", "excerpt"),
    "url": ("url", "원문url", "링크"),
    "excluded": ("분석제외여부", "analysis_excluded"),
}
# fixed values: cells that exclude a row from analysis
EXCLUSION_MARKERS = ("1", "true", "y", "yes", "예", "예외", "제외", "exclude")
REQUIRED_HEADERS = ("published_at", "source", "title", "url")


def scan_articles(articles: DataFrame, sources: DataFrame, day: str, limit: int | None = None) -> DataFrame:
    """Articles of one business day with their source, newest first. The range filter reaches the scan."""
    rows = articles.filter(C.in_kst_days(F.col("published_at"), day)).join(
        sources.select("source_id", "source_name"), "source_id")
    return newest(rows, [F.col("published_at").desc(), F.col("article_id").desc()], limit)


def resolve_headers(df: DataFrame) -> DataFrame:
    """Rename an export's columns to the canonical field names; fail on a missing required field."""
    found = {}
    for column in df.columns:
        key = column.strip().lower()
        for field, names in HEADER_ALIASES.items():
            if key in names and field not in found:
                found[field] = column
    missing = [f for f in REQUIRED_HEADERS if f not in found]
    if missing:
        raise ValueError(f"export lacks required columns: {missing}")
    return df.select(*[F.col(f"`{c}`").alias(f) for f, c in found.items()])


def published_at_from_id(news_id: Column, date_cell: Column) -> Column:
    """14-digit timestamp inside the id, else the date cell at midnight; both are local (UTC+9) times."""
    digits = F.regexp_extract(F.coalesce(news_id, F.lit("")), r"\.(\d{14})", 1)
    day = F.regexp_replace(F.regexp_extract(F.trim(date_cell), r"^(\d{4}[./-]?\d{2}[./-]?\d{2})$", 1), "[./-]", "")
    text = F.when(digits != "", digits).otherwise(F.concat(day, F.lit("000000")))
    local = F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    return local - F.expr(f"INTERVAL {C.KST_HOURS} HOURS")


def import_export_rows(export: DataFrame, day: str | None = None, text_scope: str = "provider_excerpt") -> DataFrame:
    """Canonical rows of a provider export: excluded rows and rows without a URL are dropped."""
    df = resolve_headers(export)
    for optional in ("news_id", "section", "excerpt", "excluded"):
        if optional not in df.columns:
            df = df.withColumn(optional, F.lit(None).cast("string"))
    kept = df.filter(~excluded_flag(F.col("excluded")) & (F.trim(F.coalesce("url", F.lit(""))) != ""))
    rows = kept.select(
        F.trim("source").alias("source"),
        F.trim("title").alias("title"),
        F.regexp_replace(F.trim("url"), "^http://", "https://").alias("url"),
        published_at_from_id(F.col("news_id"), F.col("published_at").cast("string")).alias("published_at"),
        F.trim(F.coalesce("section", F.lit(""))).alias("section"),
        F.trim(F.coalesce("excerpt", F.lit(""))).alias("excerpt"),
        F.lit(text_scope).alias("text_scope"),
    )
    return rows if day is None else rows.filter(C.in_kst_days(F.col("published_at"), day))


def excluded_flag(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin(*EXCLUSION_MARKERS), F.lit(False))


def import_stats(export: DataFrame) -> DataFrame:
    """Dry-run summary of an export in one pass."""
    df = resolve_headers(export)
    excluded = excluded_flag(F.col("excluded"))
    no_url = ~excluded & (F.trim(F.coalesce("url", F.lit(""))) == "")
    accepted = ~excluded & ~no_url
    published = published_at_from_id(F.col("news_id"), F.col("published_at").cast("string"))
    return df.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(excluded).alias("excluded_rows"),
        F.count_if(no_url).alias("missing_url_rows"),
        F.count_if(accepted).alias("accepted_rows"),
        F.count_if(accepted & (F.length(F.trim("excerpt")) >= 40)).alias("analyzable_excerpts"),
        F.count_distinct(F.when(accepted, C.kst_date(published))).alias("distinct_dates"),
    )


def merge_articles_import(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by URL: incoming provider fields win, an incoming null keeps the old placement fields.

    A URL that comes more than once counts by its last row (by ``collected_at``, ties by the other fields).

    ``change`` is insert, update or same; only the first two count as written.
    """
    keep_old = ("section", "homepage_placement", "homepage_rank")
    overwrite = ("source_id", "title", "published_at")
    o, n = current.alias("o"), last_per_key(incoming, "canonical_url", ["collected_at"]).alias("n")
    joined = o.join(n, F.col("o.canonical_url") == F.col("n.canonical_url"), "full_outer")
    has_new, has_old = F.col("n.canonical_url").isNotNull(), F.col("o.canonical_url").isNotNull()
    cols, same = [F.coalesce("n.canonical_url", "o.canonical_url").alias("canonical_url")], F.lit(True)
    for c in overwrite:
        cols.append(F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    for c in keep_old:
        cols.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        same = same & (F.col(f"n.{c}").isNull() | F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")))
    change = F.when(~has_old, "insert").when(~has_new | same, "same").otherwise("update")
    return joined.select(*cols, change.alias("change"))


def merge_articles_discovery(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by URL in one aggregate: longest title (old wins ties), newest section, oldest dates."""
    rows = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    have = lambda c: F.when(F.col(c).isNotNull(), F.struct("_new", c))
    # the value itself ends every ordering, so rows of one batch that tie give the same result on a replay
    return rows.groupBy("canonical_url").agg(
        F.max_by("title", F.struct(F.length("title"), -F.col("_new"), F.col("title"))).alias("title"),
        F.max(have("section"))["section"].alias("section"),
        F.min(have("published_at"))["published_at"].alias("published_at"),
        F.min("collected_at").alias("collected_at"),
    )


def merge_sources(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert of panel rows by id; an id that comes more than once counts by its greatest row."""
    o, n = current.alias("o"), last_per_key(incoming, "source_id").alias("n")
    fields = [c for c in current.columns if c != "source_id"]
    return o.join(n, F.col("o.source_id") == F.col("n.source_id"), "full_outer").select(
        F.coalesce("n.source_id", "o.source_id").alias("source_id"),
        *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in fields],
    )


def merge_versioned_profiles(profiles: DataFrame) -> DataFrame:
    """Latest row per (article, extractor, provider, schema) version key."""
    keys = ["article_id", "extractor_version", "provider", "schema_version"]
    return top_per_key(profiles, keys, [F.col("analyzed_at").desc(), F.col("profile_id").desc()])


def load_warehouse_plan(articles: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles with article metadata as load rows; profiles without an article become orphan rows."""
    joined = profiles.join(articles.select("article_id", "source_id", "canonical_url", "published_at"), "article_id", "left")
    payload = F.to_json(F.struct(F.col("extractor_version"), F.col("provider"), F.col("schema_version")))
    return joined.select(
        "profile_id", "article_id", "source_id", "canonical_url",
        F.when(F.col("source_id").isNull(), "orphan").otherwise("load").alias("row_kind"),
        payload.alias("payload"),
    )


def structured_rows_export(articles: DataFrame, profiles: DataFrame) -> DataFrame:
    """Body-free article document plus its profile, as JSON text."""
    doc = F.to_json(F.struct("article_id", "section", "source_id", "title"))
    return articles.join(profiles, "article_id").select(
        "article_id", "profile_id", doc.alias("article_json"), F.col("status").alias("profile_status"))


def merge_placements(current: DataFrame, incoming: DataFrame, articles: DataFrame) -> DataFrame:
    """One observation per (snapshot, url, x, y), latest write wins, with the article it resolves to."""
    rows = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    latest = top_per_key(rows, ["snapshot_id", "url", "x", "y"], [F.col("_new").desc(), F.col("observation_id").desc()]).drop("_new")
    return placement_url_link(latest, articles)


def placement_url_link(observations: DataFrame, articles: DataFrame) -> DataFrame:
    """Resolve observations to articles by URL; unmatched rows stay, with method and confidence."""
    ids = articles.select(F.col("canonical_url").alias("url"), F.col("article_id").alias("linked_article_id"))
    return observations.join(ids, "url", "left").withColumns({
        "match_method": F.when(F.col("linked_article_id").isNull(), "unmatched").otherwise("canonical_url"),
        "match_confidence": F.col("linked_article_id").isNotNull().cast("bigint"),
    })


def merge_contents(current: DataFrame, incoming: DataFrame, min_chars: int = 300, max_chars: int | None = None) -> DataFrame:
    """Upsert of content versions by (article, body hash): reactivate and refresh expiry on a repeat. Bodies of fewer than ``min_chars``, or more than ``max_chars`` if given, are not taken."""
    long_enough = F.col("body_chars") >= min_chars
    fresh = incoming.filter(long_enough if max_chars is None else long_enough & (F.col("body_chars") <= max_chars)).groupBy("article_id", "body_sha256").agg(
        F.max("expires_at").alias("n_expires"), F.min("acquired_at").alias("n_acquired"), F.max("body_chars").alias("n_chars"))
    old = current.groupBy("article_id", "body_sha256").agg(
        F.max("expires_at").alias("o_expires"), F.min("acquired_at").alias("o_acquired"),
        F.max("body_chars").alias("o_chars"), F.max_by("status", "content_id").alias("o_status"))
    joined = old.join(fresh, ["article_id", "body_sha256"], "full_outer")
    is_new = F.col("n_chars").isNotNull()
    return joined.select(
        "article_id", "body_sha256",
        F.coalesce("o_chars", "n_chars").alias("body_chars"),
        F.coalesce("o_acquired", "n_acquired").alias("acquired_at"),
        F.coalesce("n_expires", "o_expires").alias("expires_at"),
        F.when(is_new, "active").otherwise(F.col("o_status")).alias("status"),
        F.when(F.col("o_chars").isNull(), "insert").when(is_new, "refresh").otherwise("keep").alias("change"),
    )


def manifest_rows(issues: DataFrame, members: DataFrame, snapshot_id: str) -> DataFrame:
    """One row per ranked issue with distinct article and outlet counts and its payload key."""
    counts = members.groupBy("issue_id").agg(
        F.count_distinct("article_id").alias("articles"), F.count_distinct("source_id").alias("outlets"))
    return issues.join(counts, "issue_id").select(
        "issue_id", "articles", "outlets", "agenda_score", F.col("cluster_quality").alias("status"),
        F.format_string("snapshots/%s/issues/%d.json", F.lit(snapshot_id), F.col("issue_id")).alias("payload_key"),
    )
