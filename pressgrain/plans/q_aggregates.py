"""Aggregations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrain.functions import columns as C
from pressgrain.operators import aggregates as A
from pressgrain.plans.fixtures import NOW, ntz
from pressgrain.plans.registry import query
from pressgrain.streaming import incremental as I

TS = "'%Y-%m-%d %H:%M:%S'"


def signals(t):
    return t.raw("labels").filter("toxic = 0").select(F.col("doc_id").alias("article_id"))


@query("date_spine", """
    WITH b AS (SELECT min(published_at) AS lo, max(published_at) AS hi FROM fx_articles)
    SELECT strftime(d, '%Y-%m-%d') AS target_date, count(article_id) AS articles
    FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS d) s
    LEFT JOIN fx_articles a ON strftime(a.published_at + INTERVAL 9 HOURS, '%Y-%m-%d') = strftime(s.d, '%Y-%m-%d') GROUP BY 1""")
def _(t):
    spine = A.date_spine(t.spark, "2024-01-01", "2024-01-31")
    return spine.join(A.articles_per_kst_day(t.articles), "target_date", "left").select(
        "target_date", F.coalesce("article_count", F.lit(0)).alias("articles"))


@query("evidence_union", """
    SELECT article_id FROM fx_contents WHERE status = 'active' UNION SELECT article_id FROM fx_signals UNION SELECT article_id FROM fx_profiles WHERE status = 'succeeded'""")
def _(t):
    return A.evidence_union(t.contents.filter("status = 'active'"), signals(t), t.profiles.filter("status = 'succeeded'"))


@query("collection_health", """
    SELECT (SELECT count(*) FROM fx_panel WHERE active) AS configured_sources, (SELECT count(*) FROM fx_articles) AS article_count,
      (SELECT count(DISTINCT article_id) FROM fx_active) AS authorized_content_count, (SELECT count(DISTINCT article_id) FROM fx_signals) AS transient_evidence_count,
      (SELECT count(*) FROM (SELECT article_id FROM fx_active UNION SELECT article_id FROM fx_signals UNION SELECT article_id FROM fx_profiles)) AS body_evidence_count""")
def _(t):
    return A.collection_health(t.articles, t.panel, t.contents, signals(t), t.profiles, ntz(NOW))


@query("collection_status", f"""
    WITH a AS (SELECT * FROM fx_articles WHERE published_at >= TIMESTAMP '2024-01-04 15:00:00' AND published_at < TIMESTAMP '2024-01-12 15:00:00'),
         c AS (SELECT * FROM fx_contents WHERE article_id IN (SELECT article_id FROM a)), p AS (SELECT * FROM fx_profiles WHERE article_id IN (SELECT article_id FROM a))
    SELECT count(*) AS article_count, count(DISTINCT source_id) AS source_count, strftime(max(collected_at), {TS}) AS latest_collected_at,
      (SELECT count(*) FROM c WHERE status = 'active') AS active_count, (SELECT count(*) FROM c WHERE status = 'purged') AS purged_count,
      (SELECT strftime(min(expires_at), {TS}) FROM c WHERE status = 'active') AS next_expiry_at,
      (SELECT count(*) FROM p WHERE status = 'succeeded') AS analyzed_count, (SELECT count(*) FROM p WHERE status = 'failed') AS failed_count FROM a""")
def _(t):
    out = A.collection_status(t.articles, t.contents, t.profiles, "2024-01-05", "2024-01-12")
    return out.withColumns({c: C.stamp(F.col(c)) for c in ("latest_collected_at", "next_expiry_at")})


@query("collection_status_by_source", f"""
    SELECT source_id, count(*) AS article_count, strftime(max(collected_at), {TS}) AS latest_collected_at FROM fx_articles
    WHERE published_at >= TIMESTAMP '2024-01-04 15:00:00' AND published_at < TIMESTAMP '2024-01-12 15:00:00' GROUP BY 1""")
def _(t):
    return A.collection_status_by_source(t.articles, "2024-01-05", "2024-01-12").withColumn("latest_collected_at", C.stamp(F.col("latest_collected_at")))


@query("articles_per_kst_day", "SELECT strftime(published_at + INTERVAL 9 HOURS, '%Y-%m-%d') AS target_date, count(*) AS article_count FROM fx_articles GROUP BY 1")
def _(t):
    return A.articles_per_kst_day(t.articles)


STATES = ("none", "queued", "running", "retry_wait", "succeeded", "review_needed", "dead_letter")


@query("state_counts", f"""
    SELECT d.state, count(s.state) AS n FROM (SELECT unnest({list(STATES)}) AS state) d LEFT JOIN
      (SELECT state FROM fx_states WHERE updated_at >= TIMESTAMP '2024-01-09 15:00:00' AND updated_at < TIMESTAMP '2024-01-10 15:00:00') s USING (state) GROUP BY 1""")
def _(t):
    return A.state_counts(t.states, STATES, "2024-01-10")


@query("scoped_issue_metrics", """
    WITH m AS (SELECT issue_id, count(*) AS article_count, count(DISTINCT m.source_id) AS source_count,
        count(*) FILTER (m.article_id IN (SELECT article_id FROM fx_active)) AS content_available_count,
        count(*) FILTER (m.article_id IN (SELECT article_id FROM fx_profiles WHERE status = 'succeeded')) AS structured_profile_count,
        count(*) FILTER (homepage_placement IS NOT NULL OR m.article_id IN (SELECT article_id FROM fx_placements)) AS placement_observed_count
      FROM fx_members m JOIN fx_articles a ON a.article_id = m.article_id WHERE m.source_id IN (SELECT source_id FROM fx_panel WHERE active) GROUP BY 1)
    SELECT *, floor((source_count * 60.0::DOUBLE / 10.0::DOUBLE + least(article_count, 10) * 4.0::DOUBLE) * least(1.0::DOUBLE, 0.45::DOUBLE + source_count * 0.8::DOUBLE / 10.0::DOUBLE) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS agenda_score,
      floor(source_count * 100.0::DOUBLE / 10.0::DOUBLE * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS diversity_score,
      floor(placement_observed_count * 100.0::DOUBLE / article_count * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS placement_score,
      floor(least(article_count, 10) * 10.0::DOUBLE * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS volume_score FROM m""")
def _(t):
    return A.scoped_issue_metrics(t.members, t.articles, t.panel.filter("active"), t.contents, t.profiles, t.placements, ntz(NOW), 10)


@query("outlet_coverage", """
    SELECT issue_id, m.source_id, count(*) AS article_count, CAST(max(CASE homepage_placement WHEN 'top' THEN 4 WHEN 'main' THEN 3 WHEN 'section' THEN 2 WHEN 'list' THEN 1 ELSE 0 END) AS BIGINT) AS placement_weight
    FROM fx_members m JOIN fx_articles a USING (article_id) GROUP BY issue_id, m.source_id""")
def _(t):
    return A.outlet_coverage(t.members, t.articles)


@query("category_counts", "SELECT run_id, category, count(*) AS issues FROM fx_issues GROUP BY 1, 2")
def _(t):
    return A.category_counts(t.issues)


@query("import_source_results", """
    WITH n AS (SELECT * FROM fx_articles WHERE article_id % 3 = 0 AND source_id <> 'src9'), c AS (SELECT canonical_url FROM fx_articles WHERE article_id % 2 = 0),
      p AS (SELECT source_id, count(*) AS received, count(*) FILTER (canonical_url NOT IN (SELECT canonical_url FROM c)) AS inserted FROM n GROUP BY 1)
    SELECT source_id, coalesce(received, 0) AS received, coalesce(inserted, 0) AS inserted, coalesce(received, 0) - coalesce(inserted, 0) AS duplicates,
      CASE WHEN coalesce(received, 0) > 0 THEN 'success' ELSE 'skipped' END AS status FROM (SELECT source_id FROM fx_panel) LEFT JOIN p USING (source_id)""")
def _(t):
    a = t.articles
    return A.import_source_results(a.filter("article_id % 3 = 0 and source_id <> 'src9'"), a.filter("article_id % 2 = 0"), t.panel)


@query("ops_status", """
    SELECT 'job' AS kind, status, count(*) AS n FROM fx_jobs GROUP BY 2 UNION ALL SELECT 'outbox', status, count(*) FROM fx_outbox GROUP BY 2
    UNION ALL SELECT 'dead_letter', 'open', count(*) FROM fx_dead_letters WHERE redriven_at IS NULL""")
def _(t):
    return A.ops_status(t.jobs, t.outbox, t.dead_letters)


AGREE = {"problem": "(doc_id + quality) % 3 <> 0", "cause": "(doc_id + toxic) % 4 <> 0", "remedy": "doc_id % 5 <> 0"}


@query("coder_agreement", f"""
    WITH l AS (SELECT doc_id // 7 AS issue_id, doc_id, d.dimension, CASE d.dimension {' '.join(f"WHEN '{k}' THEN {v}" for k, v in AGREE.items())} END AS agree
               FROM labels, (SELECT unnest({list(AGREE)}) AS dimension) d)
    SELECT issue_id, dimension, count(*) AS articles, count(*) FILTER (agree) AS agreed, floor(count(*) FILTER (agree)::DOUBLE / count(*)::DOUBLE * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS agreement FROM l GROUP BY 1, 2""")
def _(t):
    pairs = t.raw("labels").select(F.expr("doc_id div 7").alias("issue_id"), F.col("doc_id").alias("article_id"), *[F.expr(v).alias(k) for k, v in AGREE.items()])
    return A.coder_agreement(pairs, list(AGREE))


@query("coder_agreement_summary", f"""
    WITH l AS (SELECT doc_id // 7 AS issue_id, {' + '.join(f'CAST({v} AS INTEGER)' for v in AGREE.values())} AS s FROM labels)
    SELECT issue_id, count(*) AS articles, count(*) FILTER (s = 3) AS full_agreement, floor(sum(s)::DOUBLE / (count(*) * 3)::DOUBLE * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS mean_agreement FROM l GROUP BY 1""")
def _(t):
    pairs = t.raw("labels").select(F.expr("doc_id div 7").alias("issue_id"), F.col("doc_id").alias("article_id"), *[F.expr(v).alias(k) for k, v in AGREE.items()])
    return A.coder_agreement_summary(pairs, list(AGREE))


def pct(a, b):
    return f"floor(({a})::DOUBLE * 100.0::DOUBLE / nullif({b}, 0)::DOUBLE * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE"


@query("review_quality_metrics", f"""
    WITH s AS (SELECT count(*) AS n, sum(articles) AS predicted, sum(articles - least(articles, misplaced)) AS related, sum(missing) AS missed,
      sum(CASE verdict WHEN 'correct' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END) AS w FROM fx_reviews)
    SELECT n AS reviewed, CASE WHEN n >= 30 THEN 'ready' ELSE 'collecting' END AS sample_status, {pct('least(n, 50)', '50')} AS progress, {pct('related', 'predicted')} AS "precision",
      {pct('related', 'related + missed')} AS recall, {pct('predicted - related', 'predicted')} AS overmerge, {pct('missed', 'related + missed')} AS undermerge, {pct('w', 'n * 2')} AS cluster_agreement FROM s""")
def _(t):
    return A.review_quality_metrics(t.reviews)


@query("token_cost_estimate", """
    WITH d AS (SELECT doc_id % 30 AS day, doc_id % 120 AS run_id, (least(length(text), 4000) + 3) // 4 AS tokens FROM documents),
      r AS (SELECT day, run_id, count(*) AS articles, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL), y AS (SELECT day, CAST(sum(tokens) AS BIGINT) AS day_tokens FROM r GROUP BY 1)
    SELECT day, run_id, articles, tokens, day_tokens, floor(tokens * 0.3::DOUBLE / 1e6::DOUBLE * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS usd,
      CASE WHEN tokens > 4000 THEN 'run_cap' WHEN day_tokens > 15000 THEN 'day_cap' END AS violation FROM r JOIN y USING (day)""")
def _(t):
    d = t.raw("documents").select(F.expr("doc_id % 30").alias("day"), F.expr("doc_id % 120").alias("run_id"), F.length("text").alias("chars"))
    return A.token_cost_estimate(d, 4000, 4, 0.3, 4000, 15000)


@query("rate_window", f"""
    SELECT user_id AS actor, event_type AS kind, strftime(time_bucket(INTERVAL 15 MINUTES, ts, TIMESTAMP '1970-01-01 00:00:00'), {TS}) AS window_start, count(*) AS n,
      count(*) > CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2147483648 END AS over_limit FROM events GROUP BY 1, 2, 3, event_type""")
def _(t):
    out = I.rate_window(t.raw("events"), "user_id", "ts", "event_type", {"click": 0, "view": 1})
    return out.withColumn("window_start", C.stamp(F.col("window_start")))


@query("slot_window", f"SELECT strftime(time_bucket(INTERVAL 6 HOURS, published_at + INTERVAL 9 HOURS, TIMESTAMP '1970-01-01 00:00:00'), {TS}) AS slot_start, count(*) AS n FROM fx_articles GROUP BY 1")
def _(t):
    return I.slot_window(t.articles).withColumn("slot_start", C.stamp(F.col("slot_start")))


@query("expiry_sweep", f"SELECT content_id, article_id FROM fx_contents WHERE status = 'active' AND expires_at <= TIMESTAMP '{NOW}'")
def _(t):
    return I.expiry_sweep(t.contents, ntz(NOW), ntz("2024-06-01 00:00:00")).select("content_id", "article_id")


@query("dead_letter_table", """
    SELECT job_id, queue, CASE WHEN attempts >= max_attempts THEN 'attempts_exhausted' ELSE 'expired' END AS reason FROM fx_jobs
    WHERE status <> 'done' AND (attempts >= max_attempts OR due_at < TIMESTAMP '1999-01-01 00:00:00' - INTERVAL 30 DAYS)""")
def _(t):
    return I.dead_letter_rows(t.jobs, ntz("1999-01-01 00:00:00"), 30).select("job_id", "queue", "reason")


@query("reconcile_outbox", """
    WITH j AS (SELECT e.event_id, e.status, r.receipt_id, (r.event_id <> e.event_id OR r.destination <> e.destination OR r.idempotency_key <> e.idempotency_key OR r.payload_version <> e.payload_version) AS bad
               FROM fx_outbox e JOIN fx_receipts r ON r.event_id = e.event_id OR (r.destination = e.destination AND r.idempotency_key = e.idempotency_key)),
      b AS (SELECT DISTINCT event_id FROM j WHERE bad)
    SELECT e.event_id, CASE WHEN e.event_id IN (SELECT event_id FROM b) THEN 'conflict' WHEN e.status = 'delivered' AND e.event_id NOT IN (SELECT event_id FROM j) THEN 'create_receipt'
      WHEN e.status = 'pending' AND e.event_id IN (SELECT event_id FROM j) THEN 'mark_delivered' END AS repair FROM fx_outbox e
    WHERE repair IS NOT NULL""")
def _(t):
    from pressgrain.operators.repairs import reconcile_outbox

    return reconcile_outbox(t.outbox, t.receipts)
