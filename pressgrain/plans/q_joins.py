"""Join operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrain.functions import columns as C
from pressgrain.operators import joins as J
from pressgrain.plans.fixtures import NOW, ntz
from pressgrain.plans.registry import query

now = lambda: ntz(NOW)


@query("article_source_join", "SELECT article_id, source_id, source_name, source_type FROM fx_articles JOIN fx_panel USING (source_id)")
def _(t):
    return J.article_source_join(t.articles, t.panel).select("article_id", "source_id", "source_name", "source_type")


@query("progress_left_join", """
    WITH p AS (SELECT article_id, count(*) FILTER (status = 'succeeded') AS ok, count(*) FILTER (status = 'failed') AS bad FROM fx_profiles
               WHERE extractor_version = 'v1' AND provider = 'rules' AND schema_version = '1' GROUP BY 1)
    SELECT count(*) AS total, CAST(sum(coalesce(ok, 0)) AS BIGINT) AS analyzed, CAST(sum(coalesce(bad, 0)) AS BIGINT) AS failed FROM fx_articles LEFT JOIN p USING (article_id)""")
def _(t):
    return J.progress_left_join(t.articles, t.profiles, "v1", "rules", "1")


@query("unanalyzed_bodies", """
    SELECT content_id, article_id FROM fx_active c WHERE NOT EXISTS (SELECT 1 FROM fx_profiles p WHERE p.article_id = c.article_id AND p.extractor_version = 'v1')
    ORDER BY acquired_at, content_id LIMIT 50""")
def _(t):
    return J.unanalyzed_bodies(t.contents, t.profiles, "v1", now(), 50).select("content_id", "article_id")


@query("collection_candidates", f"""
    WITH l AS (SELECT article_id, max(attempted_at) AS t, max(attempt_count) AS n FROM fx_attempts GROUP BY 1)
    SELECT a.article_id, a.source_id FROM fx_articles a LEFT JOIN l ON l.article_id = a.article_id
    WHERE a.article_id NOT IN (SELECT article_id FROM fx_active)
      AND (l.t IS NULL OR (l.n < 5 AND l.t + to_seconds(least(86400, 900 * pow(2, l.n - 1))) <= TIMESTAMP '{NOW}'))""")
def _(t):
    return J.collection_candidates(t.articles, t.contents, t.attempts, now()).select("article_id", "source_id")


@query("exists_flags", """
    SELECT article_id, CAST(article_id IN (SELECT article_id FROM fx_active) AS BIGINT) AS has_content,
           CAST(article_id IN (SELECT article_id FROM fx_profiles WHERE status = 'succeeded') AS BIGINT) AS has_profile,
           CAST(article_id IN (SELECT article_id FROM fx_placements) AS BIGINT) AS has_placement,
           CAST(homepage_placement IS NOT NULL OR article_id IN (SELECT article_id FROM fx_placements) AS BIGINT) AS placement_seen FROM fx_articles""")
def _(t):
    return J.exists_flags(t.articles, t.contents, t.profiles, t.placements, now())


@query("runs_in_scope", """
    SELECT run_id, target_date, status FROM fx_runs WHERE run_id IN (SELECT i.run_id FROM fx_issues i JOIN fx_members m ON m.issue_id = i.issue_id
      JOIN fx_panel p ON p.source_id = m.source_id WHERE p.source_type = 'broadcast' AND p.active)""")
def _(t):
    return J.runs_in_scope(t.runs, t.issues, t.members, t.panel, "broadcast").select("run_id", "target_date", "status")


@query("latest_content_per_article", """
    SELECT article_id, content_id, strftime(acquired_at, '%Y-%m-%d %H:%M:%S') AS acquired_at FROM fx_active c
    WHERE acquired_at = (SELECT max(acquired_at) FROM fx_active x WHERE x.article_id = c.article_id)""")
def _(t):
    return J.latest_content_per_article(t.contents, now()).select("article_id", "content_id", C.stamp(F.col("acquired_at")).alias("acquired_at"))


@query("latest_placement_asof", """
    SELECT article_id, observation_id, zone, page_rank FROM fx_placements QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY observed_at DESC,
      CASE zone WHEN 'top' THEN 4 WHEN 'main' THEN 3 WHEN 'section' THEN 2 ELSE 1 END DESC, page_rank, observation_id) = 1""")
def _(t):
    return J.latest_placement_asof(t.placements).select("article_id", "observation_id", "zone", "page_rank")


@query("receipt_disjunctive_join", """
    SELECT DISTINCT e.event_id, r.receipt_id FROM fx_outbox e JOIN fx_receipts r ON r.event_id = e.event_id
    UNION SELECT e.event_id, r.receipt_id FROM fx_outbox e JOIN fx_receipts r ON r.destination = e.destination AND r.idempotency_key = e.idempotency_key""")
def _(t):
    return J.receipt_disjunctive_join(t.outbox, t.receipts).select("event_id", F.col("r_receipt_id").alias("receipt_id"))


ORPHANS = """
    WITH j AS (SELECT e.event_id, e.destination AS d, e.idempotency_key AS k, e.payload_version AS v, r.* RENAME (event_id AS r_event_id) FROM fx_outbox e JOIN fx_receipts r ON r.event_id = e.event_id
               UNION SELECT e.event_id, e.destination, e.idempotency_key, e.payload_version, r.* FROM fx_outbox e JOIN fx_receipts r ON r.destination = e.destination AND r.idempotency_key = e.idempotency_key)
    SELECT event_id, receipt_id, 'mismatch' AS reason FROM j WHERE event_id <> r_event_id OR d <> destination OR k <> idempotency_key OR v <> payload_version
    UNION ALL SELECT event_id, CAST(NULL AS BIGINT), 'missing_receipt' FROM fx_outbox e WHERE status = 'delivered' AND event_id NOT IN (SELECT event_id FROM j)"""


@query("orphan_receipts", ORPHANS)
def _(t):
    return J.orphan_receipts(t.outbox, t.receipts)


@query("pending_publication", """
    WITH l AS (SELECT * FROM fx_profiles QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY analyzed_at DESC, profile_id DESC) = 1)
    SELECT article_id, profile_id, source_id FROM l JOIN fx_articles USING (article_id) WHERE status = 'failed'
      AND published_at >= TIMESTAMP '2024-01-09 15:00:00' AND published_at < TIMESTAMP '2024-01-10 15:00:00'""")
def _(t):
    return J.pending_publication(t.profiles, t.articles, ("failed",), "2024-01-10").select("article_id", "profile_id", "source_id")


@query("authorization_match", """
    WITH a AS (SELECT article_id, source_id, canonical_url, strftime(published_at + INTERVAL 9 HOURS, '%Y-%m-%d') AS published_date, sha256(body_text) AS body_sha256 FROM fx_articles)
    SELECT article_id, source_id, published_date FROM a WHERE article_id % 4 = 0 AND article_id % 12 <> 0 AND article_id % 8 <> 0""")
def _(t):
    a = t.articles.select("article_id", "source_id", "canonical_url", C.kst_date(F.col("published_at")).alias("published_date"), C.body_hash(F.col("body_text")).alias("body_sha256"))
    approvals = a.filter("article_id % 4 = 0").withColumns({
        "body_sha256": F.expr("case when article_id % 12 = 0 then sha2('other', 256) else body_sha256 end"),
        "valid_until": F.expr("case when article_id % 8 = 0 then '2023-12-31' else '2024-12-31' end"), "text_scope": F.lit("full")})
    return J.authorization_match(a, approvals, "2024-06-01", "full").select("article_id", "source_id", "published_date")


@query("pairs_from_groups", """
    SELECT body_sha256 AS group_id, count(DISTINCT content_id) AS members, count(DISTINCT content_id) * (count(DISTINCT content_id) - 1) // 2 AS pairs FROM fx_contents GROUP BY 1""")
def _(t):
    g = t.contents.select(F.col("body_sha256").alias("group_id"), F.col("content_id").alias("article_id"))
    return J.pair_counts_from_groups(g)


@query("prefix_related_tokens", """
    WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(lower(title), '[a-z]+')) AS token FROM fx_articles), r AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM benchmark),
      lp AS (SELECT token, unnest(list_transform(range(2, length(token) - 1), lambda i: token[1:i])) AS stem FROM l), rp AS (SELECT token, unnest(list_transform(range(2, length(token) - 1), lambda i: token[1:i])) AS stem FROM r)
    SELECT l.token AS a, r.token AS b FROM l JOIN r ON l.token = r.token UNION ALL SELECT lp.token, r.token FROM lp JOIN r ON r.token = lp.stem UNION ALL SELECT l.token, rp.token FROM rp JOIN l ON l.token = rp.stem""")
def _(t):
    words = lambda df, c: df.select(F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))).alias("token"))
    return J.prefix_related_tokens(words(t.articles, "title"), words(t.raw("benchmark"), "text"))


@query("calendar_left_join", """
    WITH d AS (SELECT strftime(CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 1 DAY)) AS DATE), '%Y-%m-%d') AS target_date),
         r AS (SELECT run_id, status, strftime(strptime(target_date, '%Y-%m-%d') + to_days(9131 - CAST(date_diff('day', DATE '1999-01-01', DATE '1999-01-01') AS INTEGER)), '%Y-%m-%d') AS target_date, started_at FROM fx_runs),
         l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY target_date ORDER BY started_at DESC, run_id DESC) = 1),
         c AS (SELECT strftime(published_at + INTERVAL 9 HOURS, '%Y-%m-%d') AS target_date, count(*) AS article_count FROM fx_articles GROUP BY 1)
    SELECT d.target_date, coalesce(article_count, 0) AS article_count, run_id, coalesce(status, CASE WHEN coalesce(article_count, 0) > 0 THEN 'pending' ELSE 'empty' END) AS status
    FROM d LEFT JOIN l USING (target_date) LEFT JOIN c USING (target_date)""")
def _(t):
    from pressgrain.operators.aggregates import articles_per_kst_day, date_spine

    spine = date_spine(t.spark, "2024-01-01", "2024-02-10", 60)
    runs = t.runs.withColumn("target_date", F.date_format(F.date_add(F.to_date("target_date"), 9131), "yyyy-MM-dd"))
    return J.calendar_left_join(spine, runs, articles_per_kst_day(t.articles))


@query("missing_keys", """
    WITH a AS (SELECT DISTINCT article_id FROM fx_articles WHERE article_id % 3 = 0 AND article_id % 2 = 0), b AS (SELECT DISTINCT article_id FROM fx_profiles)
    SELECT article_id, 'right' AS missing_from FROM a WHERE article_id NOT IN (SELECT article_id FROM b)
    UNION ALL SELECT article_id, 'left' FROM b WHERE article_id NOT IN (SELECT article_id FROM a)""")
def _(t):
    return J.missing_keys(t.articles.filter("article_id % 3 = 0 and article_id % 2 = 0"), t.profiles, "article_id")


@query("issue_frame_details", """
    SELECT m.issue_id, m.article_id, p.source_name, a.title, c.body_sha256 FROM fx_members m LEFT JOIN (SELECT * FROM fx_panel WHERE active) p ON p.source_id = m.source_id
    LEFT JOIN (SELECT * FROM fx_articles WHERE section = 'en') a ON a.article_id = m.article_id LEFT JOIN (SELECT * FROM fx_contents WHERE status = 'active') c ON c.content_id = m.article_id""")
def _(t):
    frames = t.members.withColumn("content_id", F.col("article_id"))
    return J.issue_frame_details(frames, t.panel.filter("active"), t.articles.filter("section = 'en'"), t.contents.filter("status = 'active'")).select(
        "issue_id", "article_id", "source_name", "title", "body_sha256")


@query("open_dead_letters", """
    SELECT dead_letter_id, job_id, queue, status FROM fx_dead_letters JOIN fx_jobs USING (job_id) WHERE redriven_at IS NULL ORDER BY failed_at, dead_letter_id LIMIT 100""")
def _(t):
    return J.open_dead_letters(t.dead_letters, t.jobs, 100).select("dead_letter_id", "job_id", "queue", "status")


@query("delivery_readiness", """
    WITH c AS (SELECT issue_id, CASE WHEN article_count % 5 = 0 THEN run_id + 1 ELSE run_id END AS run_id, CASE WHEN article_count % 4 = 0 THEN 'partial' ELSE 'complete' END AS status FROM fx_issues WHERE article_count % 3 <> 0)
    SELECT i.issue_id, i.run_id, r.status AS run_status, c.status AS comparison_status, coalesce(r.status = 'success' AND c.run_id = i.run_id AND c.status = 'complete', false) AS deliverable
    FROM fx_issues i JOIN fx_runs r ON r.run_id = i.run_id LEFT JOIN c ON c.issue_id = i.issue_id""")
def _(t):
    comp = t.issues.filter("article_count % 3 <> 0").selectExpr("issue_id", "case when article_count % 5 = 0 then run_id + 1 else run_id end as run_id",
                                                               "case when article_count % 4 = 0 then 'partial' else 'complete' end as status")
    return J.delivery_readiness(t.issues, t.runs, comp)


@query("ranking_to_rows", """
    WITH b AS (SELECT article_id, max(body_chars) AS body_chars FROM fx_contents WHERE article_id % 9 <> 0 GROUP BY 1)
    SELECT m.issue_id, m.article_id, body_chars, CASE WHEN body_chars IS NULL THEN 'missing_body' WHEN body_chars < 300 THEN 'short_body' END AS error FROM fx_members m LEFT JOIN b USING (article_id)""")
def _(t):
    return J.ranking_to_rows(t.members.select("issue_id", "article_id"), t.contents.filter("article_id % 9 <> 0"), 300)
