"""Body extraction and feeds over the given pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrain.functions import columns as C
from pressgrain.plans.fixtures import VIEWS
from pressgrain.plans.registry import query
from pressgrain.sources import pages as P

FURNITURE = "|".join(f"(?:{p})" for p in P.BOILERPLATE_LINES)
DECODE = "replace(replace(replace(replace({}, '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&amp;', '&')"

VIEWS["fx_candidates"] = rf"""
    WITH r AS (SELECT page_id, unnest(regexp_extract_all(nfc_normalize(html), '(?is)<article\b[^>]*>(.*?)</article>', 1)) AS raw FROM pages),
      d AS (SELECT page_id, {DECODE.format(r"regexp_replace(regexp_replace(raw, '(?i)</?(?:p|h1|br|li|div)\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')")} AS x FROM r),
      l AS (SELECT page_id, list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(regexp_replace(y, '[\t \x{{00A0}}]+', ' ', 'g'), ' ')), lambda y: y <> '' AND NOT regexp_matches(y, '{FURNITURE}')) AS ls FROM d),
      u AS (SELECT page_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l), k AS (SELECT *, lag(line) OVER (PARTITION BY page_id ORDER BY i) AS prev FROM u)
    SELECT page_id, 'article' AS strategy, string_agg(line, chr(10) ORDER BY i) AS body_text FROM k WHERE line IS DISTINCT FROM prev GROUP BY 1"""
VIEWS["fx_stats"] = r"""
    WITH b AS (SELECT *, length(regexp_replace(body_text, '\s', '', 'g')) AS c, list_filter(string_split(body_text, chr(10)), lambda x: x <> '') AS ls, list_filter(string_split(body_text, chr(10)), lambda x: length(trim(x, ' ')) >= 20) AS lg FROM fx_candidates)
    SELECT page_id, strategy, body_text, length(body_text) AS chars, coalesce(len(regexp_extract_all(body_text, '[\p{L}\p{N}]'))::DOUBLE / nullif(c, 0)::DOUBLE, 0.0) AS meaningful_ratio,
      CAST(len(regexp_extract_all(body_text, '[.!?。！？](?:["''”’)]|$|\s)')) + len(regexp_extract_all(body_text, '[가-힣](?:다|요|죠|음|함)[.!?](?:\s|$)')) AS BIGINT) AS sentence_signals,
      CAST(len(list_filter(ls, lambda x: length(x) >= 35)) AS BIGINT) AS paragraphs, CASE WHEN c = 0 THEN 1.0 ELSE 0.0 END AS anchor_ratio,
      len(list_filter(ls, lambda x: length(x) < 18))::DOUBLE / greatest(len(ls), 1) AS short_line_ratio, CAST(0 AS BIGINT) AS boilerplate_hits,
      CASE WHEN len(lg) < 2 THEN 0.0 ELSE (len(lg) - len(list_distinct(lg)))::DOUBLE / len(lg) END AS repeated_line_ratio FROM b"""
CL = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, {}))"
VIEWS["fx_quality"] = f"""
    SELECT *, CASE WHEN chars BETWEEN 280 AND 200000 THEN {CL.format(
        "0.2::DOUBLE + CASE WHEN chars < 450 THEN 0.08::DOUBLE WHEN chars < 800 THEN 0.16::DOUBLE WHEN chars < 1500 THEN 0.23::DOUBLE WHEN chars < 8000 THEN 0.28::DOUBLE ELSE 0.25::DOUBLE END"
        f" + {CL.format('sentence_signals / 10.0::DOUBLE')} * 0.12::DOUBLE + {CL.format('paragraphs / 5.0::DOUBLE')} * 0.1::DOUBLE + {CL.format('(meaningful_ratio - 0.45::DOUBLE) / 0.4::DOUBLE')} * 0.17::DOUBLE + 0.06::DOUBLE"
        f" - {CL.format('(anchor_ratio - 0.08::DOUBLE) / 0.42::DOUBLE')} * 0.28::DOUBLE - {CL.format('(short_line_ratio - 0.45::DOUBLE) / 0.45::DOUBLE')} * 0.1::DOUBLE - {CL.format('boilerplate_hits / 5.0::DOUBLE')} * 0.18::DOUBLE - repeated_line_ratio * 0.18::DOUBLE")}
      ELSE 0.0 END AS quality FROM fx_stats"""


def r(e, d):
    return f"floor({e} * {10**d}.0::DOUBLE + 0.5::DOUBLE) / {10**d}.0::DOUBLE"


def candidates(t):
    return P.clean_candidates(P.body_candidates(t.raw("pages")))


@query("body_candidates")
def _(t):
    return P.body_candidates(t.raw("pages")).select("page_id", "strategy", "source_offset", "anchor_chars", F.sha2("raw_text", 256).alias("raw_sha"))


@query("html_to_text", "SELECT page_id, strategy, sha256(body_text) AS body_sha, length(body_text) AS chars FROM fx_candidates")
def _(t):
    return candidates(t).filter("body_text <> ''").select("page_id", "strategy", F.sha2("body_text", 256).alias("body_sha"), F.length("body_text").cast("bigint").alias("chars"))


@query("text_statistics", f"""
    SELECT page_id, chars, {r('meaningful_ratio', 6)} AS meaningful_ratio, sentence_signals, paragraphs, {r('anchor_ratio', 6)} AS anchor_ratio, {r('short_line_ratio', 6)} AS short_line_ratio, boilerplate_hits, {r('repeated_line_ratio', 6)} AS repeated_line_ratio FROM fx_stats""")
def _(t):
    s = P.text_statistics(candidates(t).filter("body_text <> ''"))
    return s.select("page_id", "chars", "sentence_signals", "paragraphs", "boilerplate_hits", *[C.half_up(F.col(c), 6).alias(c) for c in ("meaningful_ratio", "anchor_ratio", "short_line_ratio", "repeated_line_ratio")])


@query("quality_score", f"SELECT page_id, strategy, {r('quality', 6)} AS quality FROM fx_quality")
def _(t):
    return P.quality_score(P.text_statistics(candidates(t).filter("body_text <> ''"))).select("page_id", "strategy", C.half_up(F.col("quality"), 6).alias("quality"))


@query("best_body", f"SELECT page_id, chars, {r('quality', 6)} AS quality FROM fx_quality WHERE quality >= 0.54 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY quality DESC, chars DESC) = 1")
def _(t):
    return P.best_body(P.quality_score(P.text_statistics(candidates(t)))).select("page_id", "chars", C.half_up(F.col("quality"), 6).alias("quality"))


@query("extract_page_body", f"SELECT page_id, strategy, sha256(body_text) AS body_sha, {r('quality', 3)} AS quality FROM fx_quality WHERE quality >= 0.54 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY quality DESC, chars DESC) = 1")
def _(t):
    return P.extract_page_body(t.raw("pages")).select("page_id", "strategy", F.sha2("body_text", 256).alias("body_sha"), "quality")


@query("access_restricted", "SELECT page_id, page_id % 7 = 0 AS structured, false AS visible FROM pages")
def _(t):
    gated = t.raw("pages").withColumn("html", F.expr("""case when page_id % 7 = 0 then concat('<meta itemprop="isAccessibleForFree" content="false">', html) else html end"""))
    return P.access_restricted(gated)


@query("page_topic", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CASE lang WHEN 'en' THEN 'international' WHEN 'fr' THEN 'economy' ELSE 'excluded' END END AS topic FROM (SELECT page_id, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang FROM pages)")
def _(t):
    lang = F.regexp_extract("html", 'lang="([a-z]+)"', 1)
    section = F.when(lang == "en", "World").when(lang == "fr", "Business").otherwise("Leisure")
    tagged = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<script type="application/ld+json">{"@type": "NewsArticle", "articleSection": "'), section, F.lit('"}</script>'), F.col("html"))).otherwise(F.col("html"))
    return t.raw("pages").select("page_id", P.page_topic(tagged).alias("topic"))


@query("title_lineage", f"SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Open graph' ELSE {DECODE.format('''trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' ')''')} END AS title, CASE WHEN page_id % 4 = 0 THEN 'og_title' ELSE 'html_title' END AS title_source FROM pages")
def _(t):
    p = t.raw("pages").withColumn("html", F.expr("""case when page_id % 4 = 0 then concat('<meta property="og:title" content="Open graph">', html) else html end"""))
    return P.title_lineage(p)


@query("feed_entries", rf"""
    WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>') AS bs FROM pages), b AS (SELECT page_id, unnest(bs) AS b, generate_subscripts(bs, 1) - 1 AS position FROM a)
    SELECT page_id, position, {DECODE.format(r"regexp_extract(b, '(?is)>(.*)</a>', 1)")} AS title, regexp_extract(b, 'href="([^"]*)"', 1) AS url, CAST(NULL AS VARCHAR) AS published FROM b""")
def _(t):
    return P.feed_entries(t.raw("pages"), "links")


ENTRY = ("concat('{open}<{title}>', case when article_id % 3 = 0 then concat('<![CDATA[', title, ']]>') else replace(replace(title, '&', '&amp;'), '<', '&lt;') end, '</{title}>', "
         "'<{link}> https://x.test/a?b=1&amp;c=', article_id, ' </{link}>', case when article_id % 4 = 0 then '' else concat('<{date}>2024-01-', lpad(cast(article_id % 28 + 1 as string), 2, '0'), '</{date}>') end, '{close}')")


def documents_of(t, entry, head, foot):
    """One XML document for twenty articles each."""
    rows = t.articles.select(F.expr("article_id div 20").alias("page_id"), "article_id", F.expr(entry).alias("entry")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("article_id", "entry"))).alias("x"))
    return rows.select("page_id", F.concat(F.lit(head), F.array_join("x.entry", "\n"), F.lit(foot)).alias("html"))


ENTRIES = """SELECT article_id // 20 AS page_id, row_number() OVER (PARTITION BY article_id // 20 ORDER BY article_id) - 1 AS position, CASE WHEN trim(title, E' \\t\\r\\n') <> '' THEN trim(title, E' \\t\\r\\n') END AS title, 'https://x.test/a?b=1&c=' || article_id AS url,
    CASE WHEN article_id % 4 <> 0 THEN '2024-01-' || lpad(CAST(article_id % 28 + 1 AS VARCHAR), 2, '0') END AS published FROM fx_articles"""


@query("feed_entries_feed", ENTRIES)
def _(t):
    entry = ENTRY.format(open="<item><media:title>no</media:title>", close="</item>", title="title", link="link", date="dc:date")
    return P.feed_entries(documents_of(t, entry, '<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>feed</title>', "</channel></rss>"), "feed")


@query("feed_entries_sitemap", ENTRIES)
def _(t):
    # the news namespace goes by another prefix than usual
    entry = ENTRY.format(open="<url><n:news>", close="</n:news></url>", title="n:title", link="loc", date="n:publication_date")
    return P.feed_entries(documents_of(t, entry, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:n="http://www.google.com/schemas/sitemap-news/0.9">', "</urlset>"), "sitemap")
