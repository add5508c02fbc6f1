"""Gates, evaluation and retrieval over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrain.functions import columns as C
from pressgrain.operators import compare as M, quality as G, retrieval as A, sets as U, textops as T
from pressgrain.plans import q_framing as Q
from pressgrain.plans.fixtures import VIEWS, ntz
from pressgrain.plans.q_clusters import rnd
from pressgrain.plans.q_compare import items, mentions
from pressgrain.plans.q_text import STOP
from pressgrain.plans.q_windows import PAIRS, gold_and_predicted, reviewed
from pressgrain.plans.registry import query
from pressgrain.session import cut_lineage

VIEWS["fx_gate_issues"] = "SELECT issue_id, any_value(title) AS title, count(DISTINCT m.source_id) AS outlet_count, CASE WHEN issue_id % 6 = 0 THEN 0.0 ELSE 10.5 END AS agenda_score FROM fx_members m JOIN fx_articles a ON a.article_id = m.article_id WHERE is_representative GROUP BY issue_id"


def gate_issues(t):
    r = t.members.filter("is_representative").join(t.articles.select("article_id", "title"), "article_id")
    return r.groupBy("issue_id").agg(F.min("title").alias("title"), F.count_distinct("source_id").alias("outlet_count"), F.expr("case when issue_id % 6 = 0 then 0.0D else 10.5D end").alias("agenda_score"))


@query("gate_violations", r"""
    WITH i AS (SELECT * FROM fx_gate_issues), n AS (SELECT issue_id, trim(regexp_replace(title, '\s+', ' ', 'g'), ' ') AS x FROM i),
      a AS (SELECT issue_id, article_id, article_id % 30 = 0 AS bad FROM fx_members WHERE issue_id IN (SELECT issue_id FROM i)), p AS (SELECT * FROM a WHERE article_id % 8 <> 0)
    SELECT issue_id, 'title' AS rule FROM n WHERE x = '' OR length(x) > 120 OR (length(x) > 80 AND regexp_matches(x, '[.!?。]')) UNION ALL SELECT issue_id, 'score' FROM i WHERE agenda_score <= 0 UNION ALL SELECT issue_id, 'outlets' FROM i WHERE outlet_count < 2
    UNION ALL SELECT issue_id, 'articles' FROM a GROUP BY 1 HAVING count(*) < 3 UNION ALL SELECT issue_id, 'evidence' FROM a GROUP BY 1 HAVING bool_or(bad) UNION ALL SELECT DISTINCT issue_id, 'unverified_profile' FROM a WHERE article_id NOT IN (SELECT article_id FROM p)
    UNION ALL SELECT issue_id, 'missing_bundle' FROM i WHERE issue_id % 5 = 0 UNION ALL SELECT issue_id, 'extra_bundle' FROM fx_members WHERE issue_id NOT IN (SELECT issue_id FROM i) GROUP BY 1 UNION ALL SELECT NULL, 'issue_count' FROM (SELECT count(*) AS c FROM i) WHERE c <> 5""")
def _(t):
    i = gate_issues(t)
    arts = t.members.join(i.select("issue_id"), "issue_id", "left_semi").select("issue_id", "article_id", F.lit(1).alias("paragraph"), F.expr("case when article_id % 30 = 0 then 0 else 1 end").alias("sentence"), F.sha2(F.col("article_id").cast("string"), 256).alias("sentence_sha256"))
    profiles = arts.selectExpr("issue_id", "article_id", "'succeeded' as status", "article_id % 8 <> 0 as receipt_valid")
    bundles = t.members.select("issue_id").distinct().withColumn("status", F.expr("case when issue_id % 5 = 0 then 'failed' else 'succeeded' end"))
    return G.gate_violations(i, arts, profiles, bundles, 5)


@query("evidence_lineage", "SELECT claim_id, article_id % 40 <> 0 AND article_id % 41 <> 0 AS ok FROM fx_items")
def _(t):
    broken = Q.items(t).withColumns({"sentence_sha256": F.expr("case when article_id % 40 = 0 then 'short' else sentence_sha256 end"), "paragraph": F.expr("case when article_id % 41 = 0 then 0 else paragraph end")})
    return broken.select("claim_id", G.evidence_lineage(F.col("paragraph"), F.col("sentence"), F.col("sentence_sha256")).alias("ok"))


def receipts(t):
    return t.raw("orders").selectExpr("o_orderkey as receipt_id", "case when o_orderkey % 9 = 0 then ' ' else concat('r', o_orderkey) end as receipt_key", "concat('m', o_custkey % 3) as model", "'p1' as prompt",
                                      "case when o_orderstatus = 'P' then 'bad' else sha2(cast(o_orderkey as string), 256) end as response_sha256", "o_orderdate as issued_at")


@query("receipt_valid", "SELECT o_orderkey AS receipt_id, o_orderkey % 9 <> 0 AND o_custkey % 3 = 1 AND o_orderstatus <> 'P' AS valid FROM orders")
def _(t):
    return G.receipt_valid(receipts(t), "m1", "p1").select("receipt_id", "valid")


@query("verified_bundle", "SELECT issue_id, count(*) AS profiles, bool_and(status = 'succeeded' AND quality > 0) AS verified FROM (SELECT article_id // 25 AS issue_id, * FROM fx_profiles) GROUP BY 1")
def _(t):
    return G.verified_bundle(t.profiles.selectExpr("article_id div 25 as issue_id", "status", "quality as evidence_count"))


@query("live_publishable", "SELECT issue_id, articles, outlets FROM (SELECT issue_id, count(*) AS articles, count(DISTINCT source_id) AS outlets FROM fx_members GROUP BY 1) WHERE articles >= 3 AND outlets >= 2 AND issue_id % 4 <> 0")
def _(t):
    m = t.members.groupBy("issue_id").agg(F.count(F.lit(1)).alias("articles"), F.count_distinct("source_id").alias("outlets"))
    return G.live_publishable(m.withColumn("payload_key", F.expr("case when issue_id % 4 = 0 then concat('fallback-', issue_id) else concat('live-', issue_id) end"))).drop("payload_key")


def label_metrics(t):
    return t.raw("labels").groupBy("toxic").agg(F.avg("quality").alias("actual")).select(F.concat(F.lit("quality_"), "toxic").alias("name"), "actual")


RULE_ROWS = [("quality_0", "gte", 0.5), ("quality_1", "gte", 0.99), ("quality_2", "lte", 1.0)]


@query("release_gate", """
    WITH m AS (SELECT 'quality_' || toxic AS name, avg(quality) AS a FROM labels GROUP BY 1), r AS (SELECT unnest(['quality_0', 'quality_1', 'quality_2']) AS name, unnest([0.5, 0.99, 1.0]) AS v, unnest(['g', 'g', 'l']) AS o),
      c AS (SELECT coalesce(CASE o WHEN 'g' THEN a >= v ELSE a <= v END, false) AS ok FROM r LEFT JOIN m USING (name)), d AS (SELECT count(*) FILTER (n < 100) AS bad FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1))
    SELECT count(*) AS rules, count(*) FILTER (NOT ok) AS failed, (SELECT bad FROM d) AS datasets_not_ready, count(*) FILTER (NOT ok) = 0 AND (SELECT bad FROM d) = 0 AS released FROM c""")
def _(t):
    rules = t.spark.createDataFrame(RULE_ROWS, "name string, operator string, value double")
    sets = t.raw("documents").groupBy("lang").agg((F.count(F.lit(1)) >= 100).alias("ready"))
    return G.release_gate(rules, label_metrics(t), sets)


@query("holdout_audit", """
    WITH r AS (SELECT doc_id, doc_id % 2 = 0 AS done FROM labels)
    SELECT doc_id AS record_id, 'kind_not_real' AS rule FROM r WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'not_locked' FROM r WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id, 'raw_content' FROM r WHERE doc_id % 13 = 0
    UNION ALL SELECT doc_id, 'annotators' FROM r WHERE done AND doc_id % 3 = 0 UNION ALL SELECT doc_id, 'adjudication' FROM r WHERE done AND doc_id % 5 = 0 UNION ALL SELECT doc_id, 'agreement' FROM r WHERE done AND doc_id % 17 = 0""")
def _(t):
    rec = t.raw("labels").selectExpr("doc_id as record_id", "case when doc_id % 7 = 0 then 'synthetic' else 'real' end as kind", "'locked_holdout' as split", "doc_id % 11 <> 0 as locked", "doc_id % 13 = 0 as body_present",
                                     "case when doc_id % 2 = 0 then 'labeled' else 'open' end as status", "case when doc_id % 3 = 0 then array('a', 'a') else array('a', 'b') end as annotators", "doc_id % 5 <> 0 as adjudicated",
                                     "case when doc_id % 17 <> 0 then 0.9 end as agreement")
    return G.holdout_audit(rec)


@query("slo_check", "WITH m AS (SELECT event_type AS name, max(value) AS a FROM events GROUP BY 1) SELECT name, budget, a AS actual, a IS NULL OR a > budget AS breached FROM (SELECT unnest(['click', 'view', 'error', 'lost']) AS name, unnest([100.0::DOUBLE, 50.0::DOUBLE, 1000.0::DOUBLE, 1.0::DOUBLE]) AS budget) b LEFT JOIN m USING (name)")
def _(t):
    m = t.raw("events").groupBy(F.col("event_type").alias("name")).agg(F.max("value").alias("actual"))
    return G.slo_check(m, t.spark.createDataFrame([("click", 100.0), ("view", 50.0), ("error", 1000.0), ("lost", 1.0)], "name string, budget double"))


@query("issue_state", """
    WITH p AS (SELECT article_id // 25 AS issue_id, count(*) AS n, count(*) FILTER (status = 'succeeded') AS ok FROM fx_profiles GROUP BY 1), c AS (SELECT DISTINCT issue_id, CASE WHEN issue_id % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS s FROM fx_members)
    SELECT c.issue_id, coalesce(n, 0) AS profiles, coalesce(ok, 0) AS succeeded, CASE WHEN s = 'succeeded' AND n > 0 AND ok = n THEN 'succeeded' WHEN ok > 0 THEN 'partial' ELSE 'failed' END AS state FROM c LEFT JOIN p ON p.issue_id = c.issue_id""")
def _(t):
    c = t.members.select("issue_id").distinct().withColumn("cluster_status", F.expr("case when issue_id % 3 = 0 then 'failed' else 'succeeded' end"))
    return G.issue_state(c, t.profiles.selectExpr("article_id div 25 as issue_id", "status"))


@query("constraint_violations", """
    SELECT 'quantity_range' AS constraint_name, count(*) FILTER (NOT l_quantity BETWEEN 1 AND 49) AS violations FROM lineitem UNION ALL SELECT 'discount_cap', count(*) FILTER (NOT l_discount <= 0.09::DOUBLE) FROM lineitem
    UNION ALL SELECT 'unique_l_orderkey_l_linenumber', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'fk_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def _(t):
    orders = t.raw("orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return G.constraint_violations(t.raw("lineitem"), {"quantity_range": F.col("l_quantity").between(1, 49), "discount_cap": F.col("l_discount") <= 0.09},
                                   [("l_orderkey", "l_linenumber")], {"fk_order": ("l_orderkey", orders)})


def summaries(t):
    s = t.members.select("issue_id").distinct().selectExpr("issue_id", "case when issue_id % 7 = 0 then 'maybe' else 'same_event' end as decision", "case when issue_id % 5 = 0 then 'odd' else 'high' end as coherence",
                                                           "case when issue_id % 11 = 0 then '' else 'Title' end as title", "repeat('x', cast(issue_id % 300 as int)) as text")
    v = t.members.filter("article_id % 25 < issue_id % 6").selectExpr("issue_id", "case when article_id % 50 = 0 then article_id + 1000000 else article_id end as article_id")
    return s, v


SUMMARY_SQL = """
    WITH s AS (SELECT DISTINCT issue_id FROM fx_members), v AS (SELECT issue_id, CASE WHEN article_id % 50 = 0 THEN article_id + 1000000 ELSE article_id END AS article_id FROM fx_members WHERE article_id % 25 < issue_id % 6), n AS (SELECT issue_id, count(*) AS n FROM v GROUP BY 1),
      r AS (SELECT issue_id, 'decision' AS rule FROM s WHERE issue_id % 7 = 0 UNION ALL SELECT issue_id, 'coherence' FROM s WHERE issue_id % 5 = 0 UNION ALL SELECT issue_id, 'title_length' FROM s WHERE issue_id % 11 = 0 UNION ALL SELECT issue_id, 'text_length' FROM s WHERE issue_id % 300 > 280
        UNION ALL SELECT s.issue_id, 'variant_count' FROM s LEFT JOIN n ON n.issue_id = s.issue_id WHERE coalesce(n, 0) NOT BETWEEN 1 AND 4 UNION ALL SELECT DISTINCT issue_id, 'foreign_article' FROM v WHERE article_id NOT IN (SELECT article_id FROM fx_members m WHERE m.issue_id = v.issue_id))"""


@query("summary_payload_violations", SUMMARY_SQL + " SELECT * FROM r")
def _(t):
    s, v = summaries(t)
    return G.summary_payload_violations(s, v, t.members)


@query("summary_fallback", SUMMARY_SQL + " SELECT issue_id, CASE WHEN issue_id IN (SELECT issue_id FROM r) THEN 'review_needed' ELSE 'same_event' END AS decision FROM s")
def _(t):
    s, v = summaries(t)
    return G.summary_fallback(s, G.summary_payload_violations(s, v, t.members))


@query("lineage_consistent", """
    WITH p AS (SELECT article_id // 25 AS issue_id, count(DISTINCT provider) = 1 AND count(DISTINCT schema_version) = 1 AS same FROM fx_profiles GROUP BY 1) SELECT issue_id, same AS same_lineage, issue_id % 2 = 0 AS approved, same AND issue_id % 2 = 0 AS consistent FROM p""")
def _(t):
    sig = U.url_set_signature(reviewed(t), minimum=1)
    return G.lineage_consistent(t.profiles.withColumn("issue_id", F.expr("article_id div 25")), ("provider", "schema_version"), sig, sig.filter("issue_id % 2 = 0"))


@query("comparison_contract", """
    WITH p AS (SELECT issue_id, CASE WHEN issue_id % 9 = 0 AND dimension = 'moral_evaluation' THEN ' ' ELSE variant_key END AS k, CASE WHEN issue_id % 8 = 0 THEN 0 ELSE article_count END AS n, len(outlets) AS o FROM fx_patterns)
    SELECT issue_id, 'empty_variant' AS rule FROM p WHERE trim(k, ' ') = '' UNION ALL SELECT issue_id, 'article_count' FROM p WHERE n < 1 UNION ALL SELECT issue_id, 'outlets_exceed_articles' FROM p WHERE o > n
    UNION ALL SELECT issue_id, 'gap_range' FROM fx_lens WHERE role = 'other' AND presence_gap + 0.5::DOUBLE > 1 UNION ALL SELECT issue_id, 'unknown_claim' FROM fx_ii WHERE article_id % 77 = 0""")
def _(t):
    i = items(t)
    p = M.axis_patterns(i).withColumns({"variant_key": F.expr("case when issue_id % 9 = 0 and dimension = 'moral_evaluation' then ' ' else variant_key end"), "article_count": F.expr("case when issue_id % 8 = 0 then 0 else article_count end")})
    lens = M.source_role_lens(mentions(t), t.members).withColumn("presence_gap", F.expr("case when role = 'other' then presence_gap + 0.5D else presence_gap end"))
    return G.comparison_contract(p, lens, i.select("issue_id", "claim_id"), i.filter("article_id % 77 <> 0").select("claim_id").distinct())


@query("panel_contract", """
    WITH p AS (SELECT source_id, source_type FROM fx_panel UNION ALL SELECT source_id, source_type FROM fx_panel WHERE source_id = 'src4'), t AS (SELECT source_type, count(DISTINCT source_id) AS n FROM p GROUP BY 1)
    SELECT source_id, 'duplicate' AS rule FROM p GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT NULL, 'count_' || source_type FROM t WHERE n <> CASE source_type WHEN 'daily' THEN 10 ELSE 7 END UNION ALL SELECT DISTINCT source_id, 'no_endpoint' FROM p WHERE source_id = 'src3'
    UNION ALL SELECT source_id, 'limit' FROM fx_panel WHERE source_id IN ('src5', 'src15')""")
def _(t):
    p = t.panel.select("source_id", "source_type")
    ends = t.panel.filter("source_id <> 'src3'").selectExpr("source_id", "case when source_id in ('src5', 'src15') then 0 else 40 end as max_records")
    return G.panel_contract(p.unionByName(p.filter("source_id = 'src4'")), ends, 10, 7)


@query("pairwise_metrics", PAIRS + f""", c AS (SELECT (SELECT count(*) FROM gp JOIN pp USING (x, y))::DOUBLE AS tp, (SELECT count(*) FROM (FROM pp EXCEPT FROM gp))::DOUBLE AS fp, (SELECT count(*) FROM (FROM gp EXCEPT FROM pp))::DOUBLE AS fn)
    SELECT {rnd('tp / (tp + fp)', 6)} AS "precision", {rnd('tp / (tp + fn)', 6)} AS recall, {rnd('2 * tp / (2 * tp + fp + fn)', 6)} AS f1, {rnd('fp / (tp + fp)', 6)} AS over_merge, {rnd('fn / (tp + fn)', 6)} AS under_merge FROM c""")
def _(t):
    m = G.pairwise_metrics(U.pair_confusion(*gold_and_predicted(t)))
    return m.select(*[C.half_up(F.col(c), 6).alias(c) for c in m.columns])


@query("multilabel_macro_f1", f"""
    WITH g AS (SELECT doc_id AS case_id, unnest(list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)) AS label FROM labels),
      p AS (SELECT l.doc_id AS case_id, unnest(list_filter([CASE WHEN n_chars > 400 THEN 'good' END, CASE WHEN n_chars % 5 = 0 THEN 'toxic' END], lambda x: x IS NOT NULL)) AS label FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
      c AS (SELECT coalesce(g.label, p.label) AS label, count(*) FILTER (g.label IS NOT NULL AND p.label IS NOT NULL)::DOUBLE AS tp, count(*) FILTER (g.label IS NULL)::DOUBLE AS fp, count(*) FILTER (p.label IS NULL)::DOUBLE AS fn FROM g FULL JOIN p ON g.case_id = p.case_id AND g.label = p.label GROUP BY 1)
    SELECT count(*) AS labels, {rnd('avg(2 * tp / (2 * tp + fp + fn))', 6)} AS macro_f1, CAST(0 AS BIGINT) AS mismatched_cases FROM c""")
def _(t):
    labels = t.raw("labels")
    j = labels.join(t.raw("documents").select("doc_id", "n_chars"), "doc_id")
    gold = labels.select(F.col("doc_id").alias("case_id"), F.explode(F.expr("array_compact(array(case when quality = 1 then 'good' end, case when toxic = 1 then 'toxic' end))")).alias("label"))
    pred = j.select(F.col("doc_id").alias("case_id"), F.explode(F.expr("array_compact(array(case when n_chars > 400 then 'good' end, case when n_chars % 5 = 0 then 'toxic' end))")).alias("label"))
    cases = labels.select(F.col("doc_id").alias("case_id"))
    return G.multilabel_macro_f1(gold, pred, cases, j.select(F.col("doc_id").alias("case_id"))).withColumn("macro_f1", C.half_up(F.col("macro_f1"), 6))


@query("gold_partition_errors", "SELECT article_id, CASE WHEN count(DISTINCT g) > 1 THEN 'overlapping' ELSE 'duplicate' END AS error FROM (SELECT user_id AS article_id, CASE WHEN user_id % 3 = 0 THEN 1 ELSE event_id % 4 END AS g FROM events) GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return G.gold_partition_errors(t.raw("events").selectExpr("user_id as article_id", "case when user_id % 3 = 0 then 1 else event_id % 4 end as group_id"))


# -- retrieval ------------------------------------------------------------------------------------

VIEWS["fx_qtok"] = f"SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[0-9a-z가-힣]{{2,}}')) AS t FROM benchmark) WHERE t NOT IN {STOP}"
VIEWS["fx_ctok"] = f"SELECT DISTINCT cid, t FROM (SELECT article_id || ':' || paragraph || ':' || sentence AS cid, unnest(regexp_extract_all(lower(text), '[0-9a-z가-힣]{{2,}}')) AS t FROM fx_sentences) WHERE t NOT IN {STOP}"


@query("evidence_answer", """
    WITH o AS (SELECT item_id, cid, count(*) AS n FROM fx_qtok q JOIN fx_ctok c ON c.t = q.t GROUP BY ALL), b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, cid) = 1)
    SELECT item_id AS question_id, cid AS candidate_id, coalesce(n, 0) AS overlap, CASE WHEN cid IS NULL THEN 'withheld' ELSE 'answered' END AS status FROM benchmark LEFT JOIN b USING (item_id)""")
def _(t):
    q = t.raw("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    # every sentence is a candidate and its own evidence; they are segmented once
    s = cut_lineage(T.segment_sentences(t.articles).select(F.concat_ws(":", "article_id", "paragraph", "sentence").alias("candidate_id"), "text"))
    return A.evidence_answer(q, s, s, STOP)


@query("rule_answer", """
    WITH q AS (SELECT item_id, CASE WHEN regexp_matches(text, 'then|ther') THEN 'x' WHEN regexp_matches(text, 'inon') THEN 'y' END AS w FROM benchmark), qt AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[0-9a-z가-힣]{2,}')) AS t FROM benchmark),
      p AS (SELECT article_id, section, CASE WHEN section = 'en' THEN 'x' ELSE 'y' END AS dimension, article_id % 7 AS n FROM fx_articles), pt AS (SELECT DISTINCT article_id, unnest(regexp_extract_all(lower(title), '[0-9a-z가-힣]{2,}')) AS t FROM fx_articles),
      o AS (SELECT item_id, article_id, count(*) AS o FROM qt JOIN pt ON pt.t = qt.t GROUP BY ALL)
    SELECT o.item_id AS question_id, o.article_id AS candidate_id, o.o * 10 + p.n AS score, row_number() OVER (PARTITION BY o.item_id ORDER BY o.o * 10 + p.n DESC, o.article_id) AS position
    FROM o JOIN p ON p.article_id = o.article_id JOIN q ON q.item_id = o.item_id WHERE w IS NULL OR w = dimension QUALIFY position <= 3""")
def _(t):
    q = t.raw("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    p = t.articles.selectExpr("article_id as pattern_id", "title as text", "case when section = 'en' then 'x' else 'y' end as dimension", "article_id % 7 as article_count")
    return Q.BIG(A.rule_answer(q, p, (("x", "then|ther"), ("y", "inon"))), "position")


@query("speaker_roster", "SELECT issue_id, role, CAST(sum(direct_quote_count + indirect_attribution_count) AS BIGINT) AS quotes, count(DISTINCT name) AS speakers, count(DISTINCT source_id) AS outlets, row_number() OVER (PARTITION BY issue_id ORDER BY sum(direct_quote_count + indirect_attribution_count) DESC, role) AS position FROM fx_im GROUP BY issue_id, role QUALIFY position <= 5")
def _(t):
    return Q.BIG(A.speaker_roster(mentions(t)), "position")


@query("review_queue", """
    WITH f AS (SELECT doc_id AS review_id, count(*) AS n FROM labels, range(3) r(i) WHERE i < doc_id % 4 GROUP BY 1), m AS (SELECT doc_id AS review_id, count(*) AS n FROM labels, range(2) r(i) WHERE i < doc_id % 3 GROUP BY 1),
      i AS (SELECT issue_id, count(*) AS article_count, CAST(issue_id % 17 AS DOUBLE) AS agenda_score FROM fx_members GROUP BY 1)
    SELECT i.issue_id, r.review_id, r.verdict, coalesce(f.n, 0) AS misplaced_count, coalesce(m.n, 0) AS missing_count FROM i LEFT JOIN fx_reviews r ON r.issue_id = i.issue_id LEFT JOIN f ON f.review_id = r.review_id LEFT JOIN m ON m.review_id = r.review_id
    ORDER BY agenda_score DESC, article_count DESC, i.issue_id, r.review_id LIMIT 50""")
def _(t):
    issues = t.members.groupBy("issue_id").agg(F.count(F.lit(1)).alias("article_count"), F.expr("cast(issue_id % 17 as double)").alias("agenda_score"))
    flags = t.reviews.select("review_id", F.explode(F.expr("filter(array(0, 1, 2), i -> i < review_id % 4)")).alias("i"))
    missing = t.reviews.select("review_id", F.explode(F.expr("filter(array(0, 1), i -> i < review_id % 3)")).alias("i"))
    return A.review_queue(issues, t.reviews.select("issue_id", "review_id", "verdict"), flags, missing).select("issue_id", "review_id", "verdict", "misplaced_count", "missing_count")


@query("comment_feed", """
    SELECT p.post_id, author_kind, coalesce(r.n, 0) AS reaction_count, coalesce(r.me, false) AS reacted_by_me, coalesce(y.n, 0) AS reply_count FROM fx_posts p LEFT JOIN (SELECT post_id, count(*) AS n, bool_or(actor_id = 7) AS me FROM fx_reactions GROUP BY 1) r ON r.post_id = p.post_id
    LEFT JOIN (SELECT post_id, count(*) AS n FROM fx_replies GROUP BY 1) y ON y.post_id = p.post_id ORDER BY created_at DESC, p.post_id DESC LIMIT 40""")
def _(t):
    return A.comment_feed(t.posts, t.replies, t.reactions, F.lit(7), 40).select("post_id", "author_kind", "reaction_count", "reacted_by_me", "reply_count")


@query("nested_replies", "SELECT post_id, reply_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM fx_replies WHERE post_id IN (SELECT post_id FROM fx_posts ORDER BY created_at DESC, post_id DESC LIMIT 40)")
def _(t):
    page = A.comment_feed(t.posts, t.replies, t.reactions, F.lit(7), 40)
    return A.nested_replies(page, t.replies).select("post_id", "reply_id", C.stamp(F.col("created_at")).alias("created_at"))


@query("moderation_state", r"""
    WITH r AS (SELECT post_id, count(DISTINCT reporter_id) AS n FROM fx_reports GROUP BY 1)
    SELECT p.post_id, coalesce(n, 0) AS reporters, CASE WHEN coalesce(n, 0) >= 3 THEN 'hidden' WHEN regexp_matches(body, '[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}') OR regexp_matches(body, '\b[0-9]{2,3}[- .][0-9]{3,4}[- .][0-9]{4}\b') THEN 'pending' ELSE 'published' END AS state
    FROM fx_posts p LEFT JOIN r ON r.post_id = p.post_id""")
def _(t):
    return A.moderation_state(t.posts, t.reports)
