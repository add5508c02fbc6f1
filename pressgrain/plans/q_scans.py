"""Scans, imports and merges over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrain.functions import columns as C
from pressgrain.operators import scans as S
from pressgrain.plans.fixtures import VIEWS, Tables
from pressgrain.plans.registry import query

VIEWS["fx_export"] = r"""
    SELECT CASE WHEN doc_id % 3 = 0 THEN '' ELSE '02100.' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 700 AS INTEGER)), '%Y%m%d%H%M%S') || '1' END AS news_id,
           '2024-01-' || CASE WHEN doc_id % 28 + 1 < 10 THEN '0' ELSE '' END || (doc_id % 28 + 1) AS "일자",
           source AS "언론사", ' ' || split_part(text, chr(10), 1) AS "제목", lang AS "통합분류1", text AS "본문",
           CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'http://news.example.com/a/' || doc_id END AS "URL",
           CASE WHEN doc_id % 7 = 0 THEN '예외' ELSE '' END AS "분석제외여부" FROM documents"""


def export(t: Tables):
    return t.raw("documents").select(
        F.expr("""case when doc_id % 3 = 0 then '' else concat('02100.', date_format(timestamp_ntz'2024-01-01 00:00:00'
                  + make_dt_interval(0, cast(doc_id % 700 as int)), 'yyyyMMddHHmmss'), '1') end""").alias("news_id"),
        F.expr("concat('2024-01-', lpad(cast(doc_id % 28 + 1 as string), 2, '0'))").alias("일자"),
        F.col("source").alias("언론사"),
        F.concat(F.lit(" "), F.substring_index("text", "\n", 1)).alias("제목"),
        F.col("lang").alias("통합분류1"),
        F.col("text").alias("본문"),
        F.expr("case when doc_id % 11 = 0 then '' else concat('http://news.example.com/a/', doc_id) end").alias("URL"),
        F.expr("case when doc_id % 7 = 0 then '예외' else '' end").alias("분석제외여부"),
    )


EXPORT_TS = """CASE WHEN regexp_extract(news_id, '\\.([0-9]{14})', 1) <> ''
      THEN strptime(regexp_extract(news_id, '\\.([0-9]{14})', 1), '%Y%m%d%H%M%S') ELSE strptime("일자", '%Y-%m-%d') END - INTERVAL 9 HOURS"""


@query("scan_articles", """
    SELECT article_id, source_id, source_name, title, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at
    FROM fx_articles JOIN fx_panel USING (source_id)
    WHERE published_at >= TIMESTAMP '2024-01-09 15:00:00' AND published_at < TIMESTAMP '2024-01-10 15:00:00'
    ORDER BY fx_articles.published_at DESC, article_id DESC LIMIT 5000""")
def _(t):
    return S.scan_articles(t.articles, t.panel, "2024-01-10", 5000).select(
        "article_id", "source_id", "source_name", "title", C.stamp(F.col("published_at")).alias("published_at"))


@query("import_export_rows", f"""
    SELECT "언론사" AS source, trim("제목", ' ') AS title, replace("URL", 'http://', 'https://') AS url,
           strftime({EXPORT_TS}, '%Y-%m-%d %H:%M:%S') AS published_at, "통합분류1" AS section,
           sha256(trim("본문", ' ')) AS excerpt_sha, 'provider_excerpt' AS text_scope
    FROM fx_export WHERE "분석제외여부" <> '예외' AND "URL" <> ''
      AND {EXPORT_TS} >= TIMESTAMP '2024-01-04 15:00:00' AND {EXPORT_TS} < TIMESTAMP '2024-01-05 15:00:00'""")
def _(t):
    return S.import_export_rows(export(t), day="2024-01-05").select(
        "source", "title", "url", C.stamp(F.col("published_at")).alias("published_at"), "section",
        F.sha2("excerpt", 256).alias("excerpt_sha"), "text_scope")


@query("import_stats", f"""
    SELECT count(*) AS input_rows, count(*) FILTER ("분석제외여부" = '예외') AS excluded_rows,
           count(*) FILTER ("분석제외여부" <> '예외' AND "URL" = '') AS missing_url_rows,
           count(*) FILTER ("분석제외여부" <> '예외' AND "URL" <> '') AS accepted_rows,
           count(*) FILTER ("분석제외여부" <> '예외' AND "URL" <> '' AND length(trim("본문", ' ')) >= 40) AS analyzable_excerpts,
           count(DISTINCT CASE WHEN "분석제외여부" <> '예외' AND "URL" <> '' THEN strftime({EXPORT_TS} + INTERVAL 9 HOURS, '%Y-%m-%d') END) AS distinct_dates
    FROM fx_export""")
def _(t):
    return S.import_stats(export(t))


MERGE_OLD = """SELECT canonical_url, source_id, title, published_at, section, homepage_placement, CAST(article_id % 40 AS BIGINT) AS homepage_rank, collected_at
               FROM fx_articles WHERE article_id % 4 <> 0"""
MERGE_NEW = """SELECT canonical_url, source_id, CASE WHEN article_id % 6 = 0 THEN title || ' (update)' ELSE title END AS title, published_at,
               CASE WHEN article_id % 5 = 0 THEN NULL ELSE section END AS section, CASE WHEN article_id % 10 = 3 THEN 'top' END AS homepage_placement,
               CAST(NULL AS BIGINT) AS homepage_rank, collected_at - INTERVAL 1 DAY AS collected_at FROM fx_articles WHERE article_id % 3 <> 1"""


def merge_sides(t):
    a = t.articles
    old = a.filter("article_id % 4 <> 0").select(
        "canonical_url", "source_id", "title", "published_at", "section", "homepage_placement",
        F.expr("article_id % 40").alias("homepage_rank"), "collected_at")
    new = a.filter("article_id % 3 <> 1").select(
        "canonical_url", "source_id", F.expr("case when article_id % 6 = 0 then concat(title, ' (update)') else title end").alias("title"),
        "published_at", F.expr("case when article_id % 5 = 0 then null else section end").alias("section"),
        F.expr("case when article_id % 10 = 3 then 'top' end").alias("homepage_placement"),
        F.lit(None).cast("bigint").alias("homepage_rank"),
        (F.col("collected_at") - F.expr("interval 1 day")).alias("collected_at"))
    return old, new


@query("merge_articles_import", f"""
    WITH o AS ({MERGE_OLD}), n AS ({MERGE_NEW})
    SELECT coalesce(n.canonical_url, o.canonical_url) AS canonical_url,
           CASE WHEN n.canonical_url IS NULL THEN o.title ELSE n.title END AS title,
           coalesce(n.section, o.section) AS section, coalesce(n.homepage_placement, o.homepage_placement) AS homepage_placement,
           coalesce(n.homepage_rank, o.homepage_rank) AS homepage_rank,
           CASE WHEN o.canonical_url IS NULL THEN 'insert' WHEN n.canonical_url IS NULL THEN 'same'
                WHEN o.title IS DISTINCT FROM n.title OR o.source_id IS DISTINCT FROM n.source_id OR o.published_at IS DISTINCT FROM n.published_at
                  OR (n.section IS NOT NULL AND o.section IS DISTINCT FROM n.section)
                  OR (n.homepage_placement IS NOT NULL AND o.homepage_placement IS DISTINCT FROM n.homepage_placement) THEN 'update' ELSE 'same' END AS change
    FROM o FULL JOIN n ON o.canonical_url = n.canonical_url""")
def _(t):
    return S.merge_articles_import(*merge_sides(t)).select(
        "canonical_url", "title", "section", "homepage_placement", "homepage_rank", "change")


@query("merge_articles_discovery", f"""
    WITH o AS ({MERGE_OLD}), n AS ({MERGE_NEW})
    SELECT coalesce(o.canonical_url, n.canonical_url) AS canonical_url,
           CASE WHEN o.title IS NULL OR length(n.title) > length(o.title) THEN n.title ELSE o.title END AS title,
           coalesce(n.section, o.section) AS section,
           strftime(coalesce(o.published_at, n.published_at), '%Y-%m-%d %H:%M:%S') AS published_at,
           strftime(least(coalesce(o.collected_at, n.collected_at), coalesce(n.collected_at, o.collected_at)), '%Y-%m-%d %H:%M:%S') AS collected_at
    FROM o FULL JOIN n ON o.canonical_url = n.canonical_url""")
def _(t):
    old, new = merge_sides(t)
    cols = ["canonical_url", "title", "section", "published_at", "collected_at"]
    out = S.merge_articles_discovery(old.select(*cols), new.select(*cols))
    return out.withColumns({"published_at": C.stamp(F.col("published_at")), "collected_at": C.stamp(F.col("collected_at"))})


@query("merge_sources", """
    WITH o AS (SELECT source_id, source_name, source_type FROM fx_panel WHERE active),
         n AS (SELECT source_id, CASE WHEN source_type = 'daily' THEN source_name || ' News' END AS source_name, source_type FROM fx_panel WHERE rights_level <> 'full')
    SELECT coalesce(n.source_id, o.source_id) AS source_id, coalesce(n.source_name, o.source_name) AS source_name,
           coalesce(n.source_type, o.source_type) AS source_type FROM o FULL JOIN n ON o.source_id = n.source_id""")
def _(t):
    p = t.panel
    new = p.filter("rights_level <> 'full'").select(
        "source_id", F.expr("case when source_type = 'daily' then concat(source_name, ' News') end").alias("source_name"), "source_type")
    return S.merge_sources(p.filter("active").select("source_id", "source_name", "source_type"), new)


@query("merge_versioned_profiles", """
    SELECT article_id, extractor_version, provider, profile_id, status FROM fx_profiles
    QUALIFY row_number() OVER (PARTITION BY article_id, extractor_version, provider, schema_version ORDER BY analyzed_at DESC, profile_id DESC) = 1""")
def _(t):
    return S.merge_versioned_profiles(t.profiles).select("article_id", "extractor_version", "provider", "profile_id", "status")


@query("load_warehouse_plan", """
    SELECT p.profile_id, p.article_id, a.source_id, a.canonical_url, CASE WHEN a.source_id IS NULL THEN 'orphan' ELSE 'load' END AS row_kind,
           '{"extractor_version":"' || extractor_version || '","provider":"' || provider || '","schema_version":"' || schema_version || '"}' AS payload
    FROM fx_profiles p LEFT JOIN (SELECT * FROM fx_articles WHERE section <> 'de') a USING (article_id)""")
def _(t):
    return S.load_warehouse_plan(t.articles.filter("section <> 'de'"), t.profiles)


@query("structured_rows_export", """
    SELECT article_id, profile_id, '{"article_id":' || article_id || ',"section":"' || section || '","source_id":"' || source_id || '","title":' || to_json(title) || '}' AS article_json,
           status AS profile_status FROM fx_articles JOIN fx_profiles USING (article_id)""")
def _(t):
    return S.structured_rows_export(t.articles, t.profiles)


PLACE_SQL = """SELECT observation_id, 'snap' || (observation_id % 200) AS snapshot_id, url, page_rank % 5 AS x, page_rank % 7 AS y, zone FROM fx_placements"""


@query("merge_placements", f"""
    WITH p AS ({PLACE_SQL}), m AS (SELECT *, CASE WHEN observation_id % 3 = 0 THEN 0 ELSE 1 END AS is_new FROM p),
         w AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY snapshot_id, url, x, y ORDER BY is_new DESC, observation_id DESC) = 1)
    SELECT observation_id, snapshot_id, url, zone, article_id AS linked_article_id,
           CASE WHEN article_id IS NULL THEN 'unmatched' ELSE 'canonical_url' END AS match_method,
           CAST(CASE WHEN article_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS match_confidence
    FROM w LEFT JOIN fx_articles a ON a.canonical_url = w.url AND a.section <> 'fr'""")
def _(t):
    p = t.placements.select("observation_id", F.expr("concat('snap', observation_id % 200)").alias("snapshot_id"), "url",
                            F.expr("page_rank % 5").alias("x"), F.expr("page_rank % 7").alias("y"), "zone")
    out = S.merge_placements(p.filter("observation_id % 3 = 0"), p.filter("observation_id % 3 <> 0"), t.articles.filter("section <> 'fr'"))
    return out.select("observation_id", "snapshot_id", "url", "zone", "linked_article_id", "match_method", "match_confidence")


@query("placement_url_link", """
    SELECT observation_id, article_id AS linked_article_id, CASE WHEN article_id IS NULL THEN 'unmatched' ELSE 'canonical_url' END AS match_method
    FROM (SELECT observation_id, url FROM fx_placements) p LEFT JOIN (SELECT article_id, canonical_url FROM fx_articles WHERE section = 'en') a ON a.canonical_url = p.url""")
def _(t):
    return S.placement_url_link(t.placements, t.articles.filter("section = 'en'")).select("observation_id", "linked_article_id", "match_method")


@query("merge_contents", """
    WITH n AS (SELECT article_id, body_sha256, max(expires_at) AS e, min(acquired_at) AS a, max(body_chars) AS c FROM fx_contents
               WHERE content_id % 2 = 0 AND body_chars >= 300 GROUP BY ALL),
         o AS (SELECT article_id, body_sha256, max(expires_at) AS e, min(acquired_at) AS a, max(body_chars) AS c, max_by(status, content_id) AS s FROM fx_contents
               WHERE content_id % 5 < 3 GROUP BY ALL)
    SELECT coalesce(o.article_id, n.article_id) AS article_id, coalesce(o.body_sha256, n.body_sha256) AS body_sha256,
           coalesce(o.c, n.c) AS body_chars, strftime(coalesce(n.e, o.e), '%Y-%m-%d %H:%M:%S') AS expires_at,
           CASE WHEN n.c IS NOT NULL THEN 'active' ELSE o.s END AS status,
           CASE WHEN o.c IS NULL THEN 'insert' WHEN n.c IS NOT NULL THEN 'refresh' ELSE 'keep' END AS change
    FROM o FULL JOIN n ON o.article_id = n.article_id AND o.body_sha256 = n.body_sha256""")
def _(t):
    c = t.contents
    return S.merge_contents(c.filter("content_id % 5 < 3"), c.filter("content_id % 2 = 0")).select(
        "article_id", "body_sha256", "body_chars", C.stamp(F.col("expires_at")).alias("expires_at"), "status", "change")


@query("manifest_rows", """
    SELECT i.issue_id, articles, outlets, agenda_score, cluster_quality AS status, 'snapshots/s1/issues/' || i.issue_id || '.json' AS payload_key
    FROM fx_issues i JOIN (SELECT issue_id, count(DISTINCT article_id) AS articles, count(DISTINCT source_id) AS outlets FROM fx_members GROUP BY 1) m USING (issue_id)""")
def _(t):
    return S.manifest_rows(t.issues, t.members, "s1")
