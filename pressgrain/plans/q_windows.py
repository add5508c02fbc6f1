"""Window, paging and set operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrain.functions import columns as C
from pressgrain.operators import paging as K, sets as U, windows as W
from pressgrain.plans.fixtures import NOW, VIEWS, ntz
from pressgrain.plans.registry import query

VIEWS["fx_reviewed"] = """
    SELECT issue_id, m.article_id, m.source_id, canonical_url, strftime(published_at + INTERVAL 9 HOURS, '%Y-%m-%d') AS published_date, sha256(body_text) AS body_sha256
    FROM fx_members m JOIN fx_articles a ON a.article_id = m.article_id"""


def reviewed(t):
    a = t.articles.select("article_id", "canonical_url", C.kst_date(F.col("published_at")).alias("published_date"), C.body_hash(F.col("body_text")).alias("body_sha256"))
    return t.members.select("issue_id", "article_id", "source_id").join(a, "article_id")


@query("latest_run_per_date", """
    WITH b AS (SELECT * FROM fx_runs WHERE status = 'success' QUALIFY row_number() OVER (PARTITION BY target_date ORDER BY finished_at DESC, run_id DESC) = 1)
    SELECT run_id, target_date, issue_count FROM b JOIN (SELECT run_id, count(*) AS issue_count FROM fx_issues WHERE category IN ('economy', 'politics') GROUP BY 1) USING (run_id)""")
def _(t):
    return W.latest_run_per_date(t.runs, t.issues, ("economy", "politics")).select("run_id", "target_date", "issue_count")


@query("latest_attempt_per_date", "SELECT target_date, run_id, status FROM fx_runs QUALIFY row_number() OVER (PARTITION BY target_date ORDER BY started_at DESC, run_id DESC) = 1")
def _(t):
    return W.latest_attempt_per_date(t.runs).select("target_date", "run_id", "status")


@query("latest_analysis_per_article", "SELECT article_id, profile_id, status FROM fx_profiles QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY analyzed_at DESC, profile_id DESC) = 1")
def _(t):
    return W.latest_analysis_per_article(t.profiles).select("article_id", "profile_id", "status")


@query("preferred_profile", """
    SELECT article_id, profile_id, provider FROM fx_profiles QUALIFY row_number() OVER (PARTITION BY article_id
      ORDER BY CASE provider WHEN 'human' THEN 1 WHEN 'rules' THEN 2 ELSE 99 END, analyzed_at DESC, profile_id DESC) = 1""")
def _(t):
    return W.preferred_profile(t.profiles, ("human", "rules")).select("article_id", "profile_id", "provider")


@query("current_state", "SELECT item_id, state FROM fx_states QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY updated_at DESC, seq DESC) = 1")
def _(t):
    return W.current_state(t.states)


@query("illegal_transitions", """
    WITH s AS (SELECT item_id, seq, coalesce(lag(state) OVER (PARTITION BY item_id ORDER BY updated_at, seq), 'none') AS from_state, state AS to_state FROM fx_states)
    SELECT * FROM s WHERE from_state || '>' || to_state NOT IN ('none>queued', 'none>running', 'queued>running', 'queued>dead_letter', 'running>retry_wait', 'running>succeeded',
      'running>review_needed', 'running>dead_letter', 'retry_wait>queued', 'retry_wait>running', 'retry_wait>dead_letter', 'review_needed>queued', 'review_needed>running', 'review_needed>dead_letter')""")
def _(t):
    return W.illegal_transitions(t.states)


@query("issue_rank", "SELECT issue_id, run_id, agenda_score, rank() OVER (PARTITION BY run_id ORDER BY agenda_score DESC) AS issue_rank FROM fx_issues")
def _(t):
    return W.issue_rank(t.issues).select("issue_id", "run_id", "agenda_score", "issue_rank")


@query("agenda_rank", """
    SELECT issue_id, run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY CAST(category = 'sports' AS INTEGER), agenda_score DESC, source_count DESC, article_count DESC, cohesion_score DESC, title, issue_id) AS BIGINT) AS agenda_rank
    FROM fx_issues QUALIFY agenda_rank <= 80""")
def _(t):
    return W.agenda_rank(t.issues, secondary=("sports",)).select("issue_id", "run_id", F.col("agenda_rank").cast("bigint").alias("agenda_rank"))


@query("first_wins_dedupe", "SELECT article_id, attempt_id FROM fx_attempts QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY attempted_at, attempt_id) = 1")
def _(t):
    return W.first_wins_dedupe(t.attempts, "article_id", ["attempted_at", "attempt_id"]).select("article_id", "attempt_id")


@query("source_budget", """
    WITH p AS (SELECT source_id, row_number() OVER (ORDER BY source_id) AS pos FROM (SELECT DISTINCT source AS source_id FROM documents)),
      c AS (SELECT source_id, article_id, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, article_id) AS r FROM fx_articles),
      q AS (SELECT pos, p.source_id, coalesce(n, 0) AS n, least(200 // (SELECT count(*) FROM p) + CASE WHEN pos <= 200 % (SELECT count(*) FROM p) THEN 1 ELSE 0 END, coalesce(n, 0)) AS f
            FROM p LEFT JOIN (SELECT source_id, count(*) AS n FROM c GROUP BY 1) x ON x.source_id = p.source_id),
      k AS (SELECT source_id, f + greatest(0, least(n - f, 200 - (SELECT sum(f) FROM q) - coalesce(sum(n - f) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM q)
    SELECT c.source_id, article_id FROM c JOIN k USING (source_id) WHERE r <= take""")
def _(t):
    sources = ordered_panel(t)
    return W.source_budget(t.articles, sources, 200).select("source_id", "article_id")


def ordered_panel(t):
    from pyspark.sql import Window

    return t.raw("documents").select(F.col("source").alias("source_id")).distinct().withColumn(
        "sample_order", F.row_number().over(Window.orderBy("source_id")))


@query("newest_n_per_source", """
    SELECT source_id, article_id, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, article_id) AS position, count(*) OVER (PARTITION BY source_id) > 10 AS truncated
    FROM fx_articles QUALIFY position <= 10""")
def _(t):
    return W.newest_n_per_source(t.articles, 10).select("source_id", "article_id", F.col("position").cast("bigint").alias("position"), "truncated")


@query("previous_success", "SELECT run_id, target_date, lead(run_id) OVER (PARTITION BY target_date ORDER BY finished_at DESC, run_id DESC) AS fallback_run_id FROM fx_runs WHERE status = 'success'")
def _(t):
    return W.previous_success(t.runs).select("run_id", "target_date", "fallback_run_id")


@query("consecutive_line_dedupe", """
    WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS a FROM documents),
      k AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM l), f AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM k)
    SELECT d.doc_id, coalesce(sha256(string_agg(line, chr(10) ORDER BY i)), sha256('')) AS text_sha, count(line) AS n FROM documents d LEFT JOIN (SELECT * FROM f WHERE p IS DISTINCT FROM line) x ON x.doc_id = d.doc_id GROUP BY 1""")
def _(t):
    out = t.raw("documents").select("doc_id", W.consecutive_line_dedupe(F.col("text")).alias("x"))
    return out.select("doc_id", F.sha2("x", 256).alias("text_sha"), F.when(F.col("x") == "", F.lit(0)).otherwise(F.size(F.split("x", "\n"))).cast("bigint").alias("n"))


@query("representative_title", """
    SELECT issue_id, title AS representative_title FROM fx_members m JOIN fx_articles a ON a.article_id = m.article_id
    QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY is_representative DESC, published_at DESC, a.article_id DESC) = 1""")
def _(t):
    return W.representative_title(t.members, t.articles)


@query("longest_body_per_url", """
    SELECT url, body_chars, content_id FROM (SELECT 'https://news.example.com/a/' || article_id AS url, body_chars, content_id FROM fx_contents WHERE body_chars >= 300)
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY body_chars DESC, content_id) = 1""")
def _(t):
    return W.longest_body_per_url(t.contents.withColumn("url", F.concat(F.lit("https://news.example.com/a/"), "article_id")))


# -- paging ---------------------------------------------------------------------------------------

@query("offset_page", "SELECT article_id, title, (SELECT count(*) FROM fx_articles) > 150 AS has_more FROM fx_articles ORDER BY published_at DESC, article_id DESC LIMIT 50 OFFSET 100")
def _(t):
    order = [F.col("published_at").desc(), F.col("article_id").desc()]
    return K.offset_page(t.articles.select("article_id", "title", "published_at"), order, 50, 100).drop("published_at")


@query("keyset_page", """
    SELECT post_id, author_kind FROM fx_posts WHERE created_at < TIMESTAMP '2024-01-03 12:00:00' OR (created_at = TIMESTAMP '2024-01-03 12:00:00' AND post_id < 60)
    ORDER BY created_at DESC, post_id DESC LIMIT 21""")
def _(t):
    return K.keyset_page(t.posts, 20, ntz("2024-01-03 12:00:00"), 60).select("post_id", "author_kind")


@query("hot_feed", """
    SELECT p.post_id, coalesce(n, 0) AS reaction_count FROM fx_posts p LEFT JOIN (SELECT post_id, count(*) AS n FROM fx_reactions GROUP BY 1) r ON r.post_id = p.post_id
    ORDER BY coalesce(n, 0) DESC, created_at DESC, p.post_id DESC LIMIT 30""")
def _(t):
    return K.hot_feed(t.posts, t.reactions, 30).select("post_id", "reaction_count")


@query("top_issues", "SELECT issue_id, agenda_score FROM fx_issues WHERE article_count >= 3 AND source_count >= 2 ORDER BY agenda_score DESC, source_count DESC, article_count DESC, issue_id LIMIT 5")
def _(t):
    return K.top_issues(t.issues, 5).select("issue_id", "agenda_score")


D = "::DOUBLE"


def r1(e):
    return f"floor(({e}) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE"


@query("observed_component_rank", f"""
    WITH c AS (SELECT issue_id, count(*) AS n, count(DISTINCT source_id) AS s FROM fx_members GROUP BY 1),
      p AS (SELECT *, least(100.0::DOUBLE, s / 12.0::DOUBLE * 100.0::DOUBLE) AS d, least(100.0::DOUBLE, ln(1.0::DOUBLE + n) / ln(51.0::DOUBLE) * 100.0::DOUBLE) AS v,
                   CASE WHEN n > 1 THEN (n - s)::DOUBLE / (n - 1)::DOUBLE * 100.0::DOUBLE ELSE 0.0::DOUBLE END AS f FROM c)
    SELECT issue_id, n AS article_count, s AS source_count, {r1('d')} AS diversity, {r1('v')} AS volume, {r1('f')} AS repetition,
      {r1('(d * 0.55::DOUBLE + v * 0.25::DOUBLE + f * 0.05::DOUBLE) / (0.55::DOUBLE + 0.25::DOUBLE + 0.05::DOUBLE) * least(1.0::DOUBLE, 0.45::DOUBLE + s::DOUBLE / 12.0::DOUBLE * 0.8::DOUBLE)')} AS agenda_score FROM p""")
def _(t):
    c = t.members.groupBy("issue_id").agg(F.count(F.lit(1)).alias("article_count"), F.count_distinct("source_id").alias("source_count"))
    return K.observed_component_rank(c, 12)


@query("due_work", """
    SELECT job_id, queue, row_number() OVER (PARTITION BY queue ORDER BY priority DESC, due_at, created_at, job_id) AS position FROM fx_jobs
    WHERE status IN ('queued', 'retry_wait') AND due_at <= TIMESTAMP '1998-01-01 00:00:00' AND attempts < max_attempts QUALIFY position <= 25""")
def _(t):
    return K.due_work(t.jobs, ntz("1998-01-01 00:00:00"), 25).select("job_id", "queue", F.col("position").cast("bigint").alias("position"))


@query("expiring_content", f"SELECT content_id, article_id FROM fx_contents WHERE status = 'active' AND expires_at <= TIMESTAMP '{NOW}' ORDER BY expires_at, content_id LIMIT 40")
def _(t):
    return K.expiring_content(t.contents, ntz(NOW), ntz("2024-06-01 00:00:00"), 40).select("content_id", "article_id")


# -- sets -----------------------------------------------------------------------------------------

PAIRS = """
    WITH g AS (SELECT article_id, body_sha256 AS k FROM (SELECT content_id AS article_id, body_sha256 FROM fx_contents)), p AS (SELECT doc_id AS article_id, sha256(split_part(text, chr(10), 1)) AS k FROM documents),
      gp AS (SELECT a.article_id AS x, b.article_id AS y FROM g a JOIN g b ON a.k = b.k AND a.article_id < b.article_id), pp AS (SELECT a.article_id AS x, b.article_id AS y FROM p a JOIN p b ON a.k = b.k AND a.article_id < b.article_id)"""


def gold_and_predicted(t):
    d = t.raw("documents")
    gold = d.select(F.sha2("text", 256).alias("group_id"), F.col("doc_id").alias("article_id"))
    pred = d.select(F.sha2(F.substring_index("text", "\n", 1), 256).alias("group_id"), F.col("doc_id").alias("article_id"))
    return gold, pred


@query("pair_confusion", PAIRS + """
    SELECT (SELECT count(*) FROM gp JOIN pp USING (x, y)) AS shared_pairs, (SELECT count(*) FROM (FROM pp EXCEPT FROM gp)) AS false_pairs, (SELECT count(*) FROM (FROM gp EXCEPT FROM pp)) AS missed_pairs""")
def _(t):
    return U.pair_confusion(*gold_and_predicted(t))


@query("content_override_merge", """
    WITH a AS (SELECT article_id, title, section FROM fx_articles WHERE article_id % 2 = 0), b AS (SELECT article_id, CASE WHEN article_id % 3 = 0 THEN 'B' || article_id END AS title, section FROM fx_articles WHERE article_id % 3 <> 1),
      c AS (SELECT article_id, CAST(NULL AS VARCHAR) AS title, 'top' AS section FROM fx_articles WHERE article_id % 7 = 0)
    SELECT article_id, coalesce(c.title, b.title, a.title) AS title, coalesce(c.section, b.section, a.section) AS section FROM a FULL JOIN b USING (article_id) FULL JOIN c USING (article_id)""")
def _(t):
    x = t.articles.select("article_id", "title", "section")
    b = x.filter("article_id % 3 <> 1").withColumn("title", F.expr("case when article_id % 3 = 0 then concat('B', article_id) end"))
    c = x.filter("article_id % 7 = 0").withColumns({"title": F.lit(None).cast("string"), "section": F.lit("top")})
    return U.content_override_merge([x.filter("article_id % 2 = 0"), b, c], "article_id", ["title", "section"])


@query("partition_check", """
    WITH u AS (SELECT article_id FROM fx_articles WHERE article_id % 11 <> 0), p AS (SELECT article_id FROM fx_articles WHERE article_id % 5 <> 0 UNION ALL SELECT article_id FROM fx_articles WHERE article_id % 50 = 1),
      s AS (SELECT article_id FROM fx_articles WHERE article_id % 10 = 5 OR article_id % 33 = 1), b AS (SELECT article_id, 'c' AS k FROM p UNION ALL SELECT article_id, 's' FROM s)
    SELECT article_id, 'repeated' AS violation FROM p GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT article_id, 'clustered_and_set_aside' FROM p WHERE article_id IN (SELECT article_id FROM s)
    UNION ALL SELECT article_id, 'missing' FROM u WHERE article_id NOT IN (SELECT article_id FROM b) UNION ALL SELECT DISTINCT article_id, 'unknown' FROM b WHERE article_id NOT IN (SELECT article_id FROM u)""")
def _(t):
    x = t.articles.select("article_id")
    predicted = x.filter("article_id % 5 <> 0").unionByName(x.filter("article_id % 50 = 1"))
    special = x.filter("article_id % 10 = 5 or article_id % 33 = 1").withColumn("bucket", F.lit("ambiguous"))
    return U.partition_check(x.filter("article_id % 11 <> 0"), predicted, special)


@query("partition_reconcile", """
    WITH g AS (SELECT DISTINCT doc_id // 7 AS group_id, doc_id AS article_id FROM documents WHERE doc_id % 63 < 50), c AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN doc_id // 7 ELSE doc_id // 7 * CASE WHEN doc_id // 7 % 4 = 0 THEN 1 ELSE 2 END END AS cluster_id, doc_id AS article_id FROM documents WHERE doc_id % 50 <> 0),
      gs AS (SELECT group_id, count(*) AS group_size FROM g GROUP BY 1), cs AS (SELECT cluster_id, count(*) AS cluster_size FROM c GROUP BY 1), x AS (SELECT group_id, cluster_id, count(*) AS shared FROM g JOIN c USING (article_id) GROUP BY ALL)
    SELECT group_id, cluster_id, shared, group_size, cluster_size, CASE WHEN shared = group_size AND shared = cluster_size THEN 'exact' ELSE 'overlap' END AS match FROM x JOIN gs USING (group_id) JOIN cs USING (cluster_id)
    UNION ALL SELECT NULL, cluster_id, 0, 0, cluster_size, 'unmatched_cluster' FROM cs WHERE cluster_id NOT IN (SELECT cluster_id FROM x)
    UNION ALL SELECT group_id, NULL, 0, group_size, 0, 'unmatched_group' FROM gs WHERE group_id NOT IN (SELECT group_id FROM x)""")
def _(t):
    d = t.raw("documents")
    g = d.filter("doc_id % 63 < 50").selectExpr("doc_id div 7 as group_id", "doc_id as article_id")
    c = d.filter("doc_id % 50 <> 0").selectExpr("case when doc_id % 3 = 0 then doc_id div 7 else doc_id div 7 * case when doc_id div 7 % 4 = 0 then 1 else 2 end end as cluster_id", "doc_id as article_id")
    return U.partition_reconcile(g, c)


@query("url_set_signature", "SELECT issue_id, CAST(set_size AS BIGINT) AS set_size, set_digest FROM fx_url_sets WHERE set_size >= 2")
def _(t):
    return U.url_set_signature(reviewed(t))


@query("disjoint_manifests", "SELECT article_id, count(DISTINCT m) AS manifests FROM (SELECT user_id AS article_id, event_id % 9 AS m FROM events) GROUP BY 1 HAVING count(DISTINCT m) > 1")
def _(t):
    return U.disjoint_manifests(t.raw("events").selectExpr("user_id as article_id", "event_id % 9 as manifest_id"))


@query("approval_manifest", """
    WITH d AS (SELECT issue_id, CAST(set_size AS BIGINT) AS set_size, set_digest FROM fx_url_sets)
    SELECT issue_id, article_id, source_id, canonical_url, published_date, body_sha256, set_size, set_digest FROM fx_reviewed JOIN d USING (issue_id) WHERE set_size >= 2""")
def _(t):
    return U.approval_manifest(reviewed(t))
