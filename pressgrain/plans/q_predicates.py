"""Filters and row validation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from pressgrain.functions import columns as C
from pressgrain.operators import predicates as P
from pressgrain.plans.fixtures import NOW, VIEWS, ntz
from pressgrain.plans.registry import query

HOST = r"regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"
PATH = r"CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"

VIEWS["fx_urls"] = "SELECT page_id, CASE WHEN page_id % 17 = 0 THEN replace(url, '://', '://user@') WHEN page_id % 19 = 0 THEN 'https://192.168.0.' || (page_id % 250) || '/x' ELSE url END AS url FROM pages"


def urls(t):
    return t.raw("pages").select("page_id", F.expr(
        "case when page_id % 17 = 0 then replace(url, '://', '://user@') when page_id % 19 = 0 then concat('https://192.168.0.', page_id % 250, '/x') else url end").alias("url"))


@query("article_search", """
    SELECT article_id, source_id, title, (SELECT count(*) FROM fx_articles JOIN fx_panel USING (source_id) WHERE section LIKE 'e%' AND contains(title, 'th')) AS total
    FROM fx_articles JOIN fx_panel USING (source_id) WHERE section LIKE 'e%' AND contains(title, 'th')
    ORDER BY published_at DESC, article_id DESC LIMIT 100 OFFSET 20""")
def _(t):
    m = P.article_search(t.articles, t.panel, section_prefix="e", title_contains="th")
    return P.article_search_page(m, 100, 20).select("article_id", "source_id", "title", "total")


@query("scope_filter", "SELECT article_id, source_id FROM fx_articles WHERE source_id IN (SELECT source_id FROM fx_panel WHERE source_type = 'daily' AND active)")
def _(t):
    return P.scope_filter(t.articles, t.panel, source_type="daily").select("article_id", "source_id")


@query("domain_allowed", f"""
    SELECT page_id, {HOST} AS host, ({HOST} = 'example.com' OR {HOST} LIKE '%.example.com' OR {HOST} LIKE '%.tiontion.example.net') AS allowed FROM pages""")
def _(t):
    domains = t.spark.createDataFrame([("example.com",), ("tiontion.example.net",)], "domain string")
    return P.domain_allowed(t.raw("pages"), domains).select("page_id", "host", "allowed")


@query("url_policy", f"""
    SELECT page_id, CASE WHEN lower(url) NOT LIKE 'https://%' THEN 'not_https' WHEN regexp_matches(url, '^[A-Za-z]+://[^/?#]*@') THEN 'credentials'
           WHEN {HOST} LIKE '192.168.%' THEN 'private_host' END AS refused FROM fx_urls""")
def _(t):
    return urls(t).select("page_id", P.url_policy(F.col("url")).alias("refused"))


@query("article_like_filter", r"""
    SELECT page_id FROM pages WHERE regexp_matches(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1), '/(en|fr)/[0-9]+')
    AND NOT regexp_matches(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1), '/fr/[0-9]*5(/|$)')
    AND NOT contains(regexp_extract(html, '<title>([^<]*)</title>', 1), '%%%')""")
def _(t):
    rows = t.raw("pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return P.article_like_filter(rows, ["/(?:en|fr)/[0-9]+"], [*P.EXCLUDED_PATHS, "/fr/[0-9]*5(?:/|$)"], [*P.EXCLUDED_TITLES, "%%%"]).select("page_id")


@query("collection_window", """
    SELECT article_id FROM fx_articles WHERE coalesce(CASE WHEN article_id % 9 <> 0 THEN published_at END, collected_at) >= TIMESTAMP '2024-01-04 15:00:00'
    AND coalesce(CASE WHEN article_id % 9 <> 0 THEN published_at END, collected_at) < TIMESTAMP '2024-01-12 15:00:00'""")
def _(t):
    a = t.articles.withColumn("published_at", F.expr("case when article_id % 9 <> 0 then published_at end"))
    return P.collection_window(a, "2024-01-05", "2024-01-12").select("article_id")


@query("reconciliation_lookback", """
    SELECT article_id FROM fx_articles WHERE published_at >= date_trunc('day', collected_at + INTERVAL 9 HOURS) - INTERVAL 9 HOURS - INTERVAL 2 DAYS""")
def _(t):
    return P.reconciliation_lookback(t.articles, 3).select("article_id")


@query("late_rows", """
    SELECT article_id, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM fx_articles
    WHERE published_at < (SELECT max(published_at) FROM fx_articles) - INTERVAL 3 DAYS""")
def _(t):
    from pressgrain.streaming.incremental import late_rows

    return late_rows(t.articles, "published_at", 3).select("article_id", C.stamp(F.col("published_at")).alias("published_at"))


@query("rights_filter", """
    SELECT article_id, source_id, CASE WHEN rights_level IN ('full', 'licensed') THEN 'analyzable' ELSE 'deferred' END AS route FROM fx_articles LEFT JOIN fx_panel USING (source_id)""")
def _(t):
    return P.rights_filter(t.articles, t.panel, ("full", "licensed")).select("article_id", "source_id", "route")


@query("active_content", f"SELECT content_id, article_id FROM fx_contents WHERE status = 'active' AND analysis_allowed AND expires_at > TIMESTAMP '{NOW}'")
def _(t):
    return P.active_content(t.contents, ntz(NOW)).select("content_id", "article_id")


@query("publishable_issue", """
    SELECT issue_id, count(*) AS articles, count(DISTINCT source_id) AS sources, any_value(CASE issue_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END) AS coherence
    FROM fx_members WHERE issue_id % 3 < 2 GROUP BY issue_id HAVING count(*) >= 3 AND count(DISTINCT source_id) >= 2""")
def _(t):
    issues = t.members.select("issue_id").distinct().withColumn("coherence", F.expr("case issue_id % 3 when 0 then 'high' when 1 then 'medium' else 'low' end"))
    return P.publishable_issue(t.members, issues)


@query("publishable_title", r"""
    WITH n AS (SELECT article_id, trim(regexp_replace(title, '\s+', ' ', 'g')) AS x FROM fx_articles)
    SELECT article_id, CASE WHEN x = '' THEN 'empty' WHEN length(x) > 120 THEN 'too_long'
      WHEN length(x) > 80 AND len(regexp_extract_all(x, '[.!?。]\s+\S')) >= 1 THEN 'multi_sentence'
      WHEN length(x) > 80 AND regexp_matches(x, '[.!?。]') THEN 'body_like' END AS reason FROM n""")
def _(t):
    return t.articles.select("article_id", P.publishable_title(F.col("title")).alias("reason"))


@query("forbidden_columns", r"""
    WITH k AS (SELECT event_id, unnest(regexp_extract_all('{"text":"' || event_type || '","meta":' || props || '}', '"((?:[^"\\]|\\.)*)"\s*:', 1)) AS key FROM events)
    SELECT event_id, key, count(*) AS occurrences FROM k WHERE key IN ('text', 'k') GROUP BY ALL""")
def _(t):
    docs = t.raw("events").select("event_id", F.expr("""concat('{"text":"', event_type, '","meta":', props, '}')""").alias("doc"))
    return P.forbidden_json_keys(docs, "doc", ("text", "k"))


@query("public_projection", "SELECT article_id, source_id, '{\"title\":' || to_json(title) || ',\"section\":\"' || section || '\"}' AS doc FROM fx_articles")
def _(t):
    nested = t.articles.select("article_id", "source_id", "body_text", F.struct("title", "body_text", "section").alias("doc"))
    return P.public_projection(nested, ("body_text",)).withColumn("doc", F.to_json("doc"))


@query("validate_import_rows", """
    SELECT article_id, array_to_string(list_filter([CASE WHEN source_id IN ('src7') THEN 'unknown_source' END, CASE WHEN length(trim(title, ' ')) < 1 OR length(trim(title, ' ')) > 500 THEN 'title_length' END,
      CASE WHEN article_id % 13 = 0 THEN 'foreign_domain' END, CASE WHEN article_id % 600 = 0 OR article_id % 600 > 500 THEN 'rank_range' END,
      CASE WHEN article_id % 8 = 0 THEN 'placement' END], lambda x: x IS NOT NULL), ',') AS errors FROM fx_articles""")
def _(t):
    rows = t.articles.select("article_id", "source_id", "title", F.expr(
        "case when article_id % 13 = 0 then 'https://other.test/x' else canonical_url end").alias("url"),
        F.expr("article_id % 600").alias("homepage_rank"), F.expr("case when article_id % 8 = 0 then 'sidebar' when article_id % 8 = 1 then 'Top ' else null end").alias("homepage_placement"))
    domains = t.spark.createDataFrame([("example.com",)], "domain string")
    return P.validate_import_rows(rows, t.panel.filter("source_id <> 'src7'"), domains).select("article_id", F.array_join("errors", ",").alias("errors"))


@query("topic_from_path", f"""
    SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'economy' WHEN regexp_matches({PATH}, '(?i)/en(/|$)') THEN 'english' WHEN regexp_matches({PATH}, '(?i)/fr(/|$)') THEN 'french' END AS topic FROM pages""")
def _(t):
    endpoint = F.expr("case when page_id % 5 = 0 then 'economy' else 'mixed' end")
    return t.raw("pages").select("page_id", P.topic_from_path(endpoint, F.col("url"), (("english", "/en(?:/|$)"), ("french", "/fr(?:/|$)"))).alias("topic"))


@query("needs_moderation", r"""
    SELECT doc_id, regexp_matches(text, '[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}') OR regexp_matches(text, '\b[0-9]{2,3}[- .][0-9]{3,4}[- .][0-9]{4}\b') AS flagged FROM documents""")
def _(t):
    return t.raw("documents").select("doc_id", C.needs_moderation(F.col("text")).alias("flagged"))


@query("sources_subset", """
    SELECT issue_id, count(*) FILTER (source_id NOT IN (SELECT source_id FROM fx_panel WHERE active)) AS outside,
           count(*) FILTER (source_id NOT IN (SELECT source_id FROM fx_panel WHERE active)) = 0 AS inside_only FROM fx_members GROUP BY 1""")
def _(t):
    return P.sources_subset(t.members.select("issue_id", "source_id"), t.panel.filter("active"))
