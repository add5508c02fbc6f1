"""Filters, predicates and row-level validation."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pressgrain.functions import columns as C

# fixed values: paths and titles that are not news articles
EXCLUDED_PATHS = (
    r"/(?:opinion|column|editorial)(?:/|$)",
    r"/(?:photo|photos|video|videos|gallery|cartoon)(?:/|$)",
    r"/(?:sports|sport|entertainment|culture|life|lifestyle)(?:/|$)",
    r"/(?:comment|comments|advertising|advertorial)(?:/|$)",
)
EXCLUDED_TITLES = (
    "사설|칼럼|기고|오피니언|데스크칼럼|취재수첩|편집국에서|독자마당",
    "포토|사진뉴스|영상뉴스|다시보기|하이라이트",
    "광고|협찬|브랜드콘텐츠",
)
# fixed values: topic by path segment
TOPIC_PATHS = (
    ("politics", "/(?:politics|politic|assembly|president|government|청와대|국회|정치)(?:/|$)"),
    ("economy", "/(?:economy|economic|finance|industry|business|market|경제|금융|산업)(?:/|$)"),
    ("society", "/(?:society|social|national|local|education|health|법조|사회|전국)(?:/|$)"),
    ("international", "/(?:international|world|foreign|global|국제|세계)(?:/|$)"),
)
# fixed values: private, loopback, link-local and metadata hosts
BLOCKED_HOST = (
    r"^(?:localhost|metadata\.google\.internal|127\.[0-9.]+|10\.[0-9.]+|192\.168\.[0-9.]+|169\.254\.[0-9.]+"
    r"|0\.[0-9.]+|172\.(?:1[6-9]|2[0-9]|3[01])\.[0-9.]+|\[.*\])$"
)
BODY_LIKE = r"[.!?。]|다\.|했다|밝혔다|말했다|것으로|따르면"


def article_search(articles: DataFrame, sources: DataFrame, *, source: str | None = None, section_prefix: str | None = None,
                   title_contains: str | None = None, day: str | None = None) -> DataFrame:
    """Conjunctive optional filters. Text filters are literal (no wildcard meaning)."""
    df = articles
    if source is not None:
        df = df.filter(F.col("source_id") == source)
    if section_prefix is not None:
        df = df.filter(F.col("section").startswith(section_prefix))
    if title_contains is not None:
        df = df.filter(F.col("title").contains(title_contains))
    if day is not None:
        df = df.filter(C.in_kst_days(F.col("published_at"), day))
    return df.join(sources.select("source_id", "source_name"), "source_id")


def article_search_page(matches: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of a search plus the total; the total is a scalar subquery over the same filters."""
    total = matches.agg(F.count(F.lit(1))).scalar()
    page = matches.orderBy(F.coalesce("published_at", "collected_at").desc(), F.col("article_id").desc()).offset(offset).limit(limit)
    return page.withColumn("total", total)


def scope_filter(rows: DataFrame, sources: DataFrame, *, source_type: str | None = None, source_ids: Sequence[str] | None = None) -> DataFrame:
    """Rows of a named scope: everything, one type of active source, or an explicit source list."""
    scope = sources
    if source_type is None and source_ids is None:
        return rows
    if source_type is not None:
        scope = scope.filter((F.col("source_type") == source_type) & F.col("active"))
    if source_ids is not None:
        scope = scope.filter(F.col("source_id").isin(*source_ids))
    return rows.join(scope.select("source_id"), "source_id", "left_semi")


def domain_allowed(pages: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """``allowed`` is true when the host equals a listed domain or is below one.

    Host suffixes are exploded once per distinct host, so the match is an equi join.
    """
    hosts = pages.select(C.url_host(F.col(url)).alias("host")).distinct()
    ok = (
        hosts.select("host", F.explode(C.host_suffixes(F.col("host"))).alias("domain"))
        .join(domains.select("domain").distinct(), "domain", "left_semi")
        .select("host").distinct().withColumn("allowed", F.lit(True))
    )
    return pages.withColumn("host", C.url_host(F.col(url))).join(ok, "host", "left").withColumn(
        "allowed", F.coalesce("allowed", F.lit(False)))


def url_policy(url: Column) -> Column:
    """Reason a URL is refused, or null: https only, no credentials, no private or metadata host."""
    return (
        F.when(~F.lower(url).startswith("https://"), "not_https")
        .when(url.rlike("^[A-Za-z]+://[^/?#]*@"), "credentials")
        .when(C.url_host(url) == "", "no_host")
        .when(C.url_host(url).rlike(BLOCKED_HOST), "private_host")
    )


def article_like_filter(rows: DataFrame, path_patterns: Sequence[str], excluded_paths: Sequence[str] = EXCLUDED_PATHS,
                        excluded_titles: Sequence[str] = EXCLUDED_TITLES) -> DataFrame:
    """Keep rows whose path looks like an article and is not in an excluded section or title class."""
    path = F.regexp_extract(F.col("url"), r"^[A-Za-z]+://[^/?#]*([^#]*)", 1)
    like = path.rlike("(?i)" + "|".join(f"(?:{p})" for p in path_patterns))
    bad = path.rlike("(?i)" + "|".join(f"(?:{p})" for p in excluded_paths)) | F.col("title").rlike(
        "|".join(f"(?:{p})" for p in excluded_titles))
    return rows.filter(like & ~bad)


def collection_window(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Business date inside [first, last]; undated rows use their discovery time."""
    return rows.filter(C.in_kst_days(F.coalesce("published_at", "collected_at"), first, last))


def reconciliation_lookback(rows: DataFrame, days: int = 3) -> DataFrame:
    """Rows published within ``days`` business days of their discovery; undated rows stay."""
    shift = F.expr(f"INTERVAL {C.KST_HOURS} HOURS")
    day_start = F.date_trunc("day", F.col("collected_at") + shift).cast("timestamp_ntz") - shift
    earliest = day_start - F.make_dt_interval(F.lit(max(1, days) - 1))
    return rows.filter(F.col("published_at").isNull() | (F.col("published_at") >= earliest))


def rights_filter(rows: DataFrame, sources: DataFrame, analyzable_levels: Sequence[str]) -> DataFrame:
    """Route each row: analyzable when its source grants analysis, else deferred."""
    policy = sources.select("source_id", "rights_level")
    return rows.join(policy, "source_id", "left").withColumn(
        "route", F.when(F.col("rights_level").isin(*analyzable_levels), "analyzable").otherwise("deferred"))


def active_content(contents: DataFrame, now: Column) -> DataFrame:
    """Content that may be analyzed at ``now`` (always a parameter, never the wall clock)."""
    return contents.filter((F.col("status") == "active") & F.col("analysis_allowed")
                           & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def publishable_issue(members: DataFrame, issues: DataFrame, min_articles: int = 3, min_sources: int = 2,
                      coherent: Sequence[str] = ("high", "medium")) -> DataFrame:
    counts = members.groupBy("issue_id").agg(
        F.count(F.lit(1)).alias("articles"), F.count_distinct("source_id").alias("sources"))
    ok = counts.filter((F.col("articles") >= min_articles) & (F.col("sources") >= min_sources))
    return ok.join(issues.filter(F.col("coherence").isin(*coherent)), "issue_id")


def publishable_title(title: Column, max_chars: int = 120) -> Column:
    """Reason a title is not publishable, or null."""
    text = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    sentences = F.regexp_count(text, F.lit(r"[.!?。]\s+\S"))
    return (
        F.when(text == "", "empty")
        .when(F.length(text) > max_chars, "too_long")
        .when((F.length(text) > 80) & (sentences >= 1), "multi_sentence")
        .when((F.length(text) > 80) & text.rlike(BODY_LIKE), "body_like")
    )


def forbidden_columns(schema: T.DataType, names: Sequence[str], path: str = "$") -> list[str]:
    """Paths of forbidden keys at any depth of a table's own schema."""
    found: list[str] = []
    if isinstance(schema, T.StructType):
        for field in schema.fields:
            here = f"{path}.{field.name}"
            if field.name.lower() in names:
                found.append(here)
            found += forbidden_columns(field.dataType, names, here)
    elif isinstance(schema, T.ArrayType):
        found += forbidden_columns(schema.elementType, names, path + "[]")
    elif isinstance(schema, T.MapType):
        found += forbidden_columns(schema.valueType, names, path + "{}")
    return found


def forbidden_json_keys(docs: DataFrame, json_col: str, names: Sequence[str]) -> DataFrame:
    """Forbidden keys in open JSON text: one row per (document, key) with its number of occurrences."""
    keys = F.regexp_extract_all(F.col(json_col), F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    return (
        docs.withColumn("key", F.explode(keys))
        .filter(F.lower("key").isin(*names))
        .groupBy(*[c for c in docs.columns if c != json_col], "key")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def public_projection(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop forbidden fields at any depth; the projection is generated from the schema."""
    return df.select(*[_prune(F.col(f"`{f.name}`"), f.dataType, names).alias(f.name)
                       for f in df.schema.fields if f.name.lower() not in names])


def _prune(col: Column, dtype: T.DataType, names: Sequence[str]) -> Column:
    if not forbidden_columns(dtype, names):
        return col
    if isinstance(dtype, T.StructType):
        kept = [_prune(col[f.name], f.dataType, names).alias(f.name) for f in dtype.fields if f.name.lower() not in names]
        return F.when(col.isNotNull(), F.struct(*kept))
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _prune(x, dtype.elementType, names))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, v: _prune(v, dtype.valueType, names))
    return col


def validate_import_rows(rows: DataFrame, sources: DataFrame, domains: DataFrame) -> DataFrame:
    """Names of the failed row rules, empty for a good row."""
    known = sources.select("source_id", F.lit(True).alias("_known"))
    df = domain_allowed(rows, domains).join(known, "source_id", "left")
    title = F.length(F.trim(F.coalesce("title", F.lit(""))))
    rules = [
        F.when(F.col("_known").isNull(), "unknown_source"),
        F.when((title < 1) | (title > 500), "title_length"),
        F.when(~F.col("allowed"), "foreign_domain"),
        F.when(F.col("homepage_rank").isNotNull() & ~F.col("homepage_rank").between(1, 500), "rank_range"),
        F.when(F.col("homepage_placement").isNotNull() & C.placement_alias(F.col("homepage_placement")).isNull(), "placement"),
    ]
    return df.withColumn("errors", F.array_compact(F.array(*rules))).drop("_known", "allowed", "host")


def topic_from_path(endpoint_topic: Column, url: Column, topics=TOPIC_PATHS) -> Column:
    path = C.url_path(url)
    inferred = F.when(path.rlike("(?i)" + topics[0][1]), topics[0][0])
    for name, pattern in topics[1:]:
        inferred = inferred.when(path.rlike("(?i)" + pattern), name)
    return F.when(endpoint_topic != "mixed", endpoint_topic).otherwise(inferred)


def sources_subset(mentions: DataFrame, allowed: DataFrame) -> DataFrame:
    """Per document: number of mentioned sources outside the allowed set, and whether all are inside."""
    ok = allowed.select("source_id").distinct().withColumn("_ok", F.lit(True))
    return mentions.join(ok, "source_id", "left").groupBy("issue_id").agg(
        F.count_if(F.col("_ok").isNull()).alias("outside"), (F.count_if(F.col("_ok").isNull()) == 0).alias("inside_only"))
