"""Clustering, scoring and ranking over the given documents, one run per business day."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrain.functions import columns as C, text as X
from pressgrain.operators import clusters as L, issues as I, paging, textops as T
from pressgrain.plans.fixtures import VIEWS
from pressgrain.plans.q_functions import W as SCORE
from pressgrain.plans.q_text import ACTION_WORDS, ACTOR, FRAMES, STOP
from pressgrain.plans.registry import query

GENERIC = ("ther", "thes", "then", "thing", "thed")
DISTINCTIVE = ("thanedble", "onandti", "erand", "thou", "thoned")
CONCEPTS = (("inone", ("^In", "one")), ("toed", ("^To", "ed")))
HARD = (("Thtion|Thon", "Ined|Inon"), ("^On", "^Of"))
SECTIONS = (("french", "^fr$"), ("german", "^de$"))
TITLES = (("politics", "th|er"), ("economy", "on|an"))
LEX = L.Lexicon(stopwords=STOP, body_stopwords=STOP + GENERIC, generic=GENERIC, distinctive=DISTINCTIVE, actor_pattern=ACTOR, actions=ACTION_WORDS,
                concepts=CONCEPTS, hard_negatives=HARD, section_categories=SECTIONS, title_categories=TITLES)


def listed(rules, test):
    return "list_filter([" + ", ".join(f"CASE WHEN {test(r)} THEN '{r[0]}' END" for r in rules) + "], lambda x: x IS NOT NULL)"


def sides(i):
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(title, '{p[i]}') THEN {n} END" for n, p in enumerate(HARD)) + "], lambda x: x IS NOT NULL)"


VIEWS["fx_category"] = """
    WITH c AS (SELECT article_id, section, len(regexp_extract_all(title, 'th|er')) AS a, len(regexp_extract_all(title, 'on|an')) AS b FROM fx_articles)
    SELECT article_id, CASE WHEN section = 'fr' THEN 'french' WHEN section = 'de' THEN 'german' WHEN a > 0 AND a >= b THEN 'politics' WHEN b > 0 THEN 'economy' END AS category FROM c"""
VIEWS["fx_base"] = f"""
    SELECT strftime(published_at + INTERVAL 9 HOURS, '%Y-%m-%d') AS run, a.article_id, category, title, regexp_replace(lower(title), '[^0-9a-z가-힣]+', '', 'g') AS title_key,
      list_distinct(regexp_extract_all(title, '{ACTOR}', 1)) AS actors, {listed(CONCEPTS, lambda r: ' AND '.join(f"regexp_matches(title, '{p}')" for p in r[1]))} AS concepts,
      {listed(ACTION_WORDS, lambda r: ' OR '.join(f"contains(title || ' ' || body_text, '{w}')" for w in r[1]))} AS actions, {sides(0)} AS hn1, {sides(1)} AS hn2
    FROM fx_articles a JOIN fx_category c ON c.article_id = a.article_id WHERE category IS NOT NULL"""
VIEWS["fx_body_kept"] = f"""
    WITH w AS (SELECT b.run, b.article_id, c.token FROM fx_base b JOIN fx_body_counts c ON c.article_id = b.article_id WHERE c.token NOT IN {GENERIC}),
      f AS (SELECT run, token, count(*) AS df FROM w GROUP BY ALL), s AS (SELECT run, count(*) AS n FROM fx_base GROUP BY 1)
    SELECT w.run, w.article_id, w.token, f.df <= greatest(3, ceil(s.n * 0.02)) AS anchor FROM w JOIN f ON f.run = w.run AND f.token = w.token JOIN s ON s.run = w.run WHERE f.df <= greatest(5, ceil(s.n * 0.08))"""
VIEWS["fx_units"] = """
    WITH h AS (SELECT run, title_key, min(article_id) AS unit_id, count(*) AS weight, list_sort(list_distinct(flatten(list(actions)))) AS actions FROM fx_base GROUP BY ALL)
    SELECT b.* EXCLUDE (actions), h.actions, h.unit_id, h.weight FROM h JOIN fx_base b ON b.run = h.run AND b.article_id = h.unit_id"""
VIEWS["fx_unit_tokens"] = f"""
    WITH x AS (SELECT u.run, u.unit_id, t.token, 1 AS it, 0 AS ib, 0 AS ik FROM fx_units u JOIN fx_title_tokens t ON t.article_id = u.unit_id
               UNION ALL SELECT u.run, u.unit_id, b.token, 0, 1, CAST(b.anchor AS INTEGER) FROM fx_units u JOIN fx_base m ON m.run = u.run AND m.title_key = u.title_key JOIN fx_body_kept b ON b.run = m.run AND b.article_id = m.article_id)
    SELECT run, unit_id, token, max(it) AS it, max(ib) AS ib, max(ik) AS ik, CAST(token NOT IN {GENERIC} AS INTEGER) AS id, 0 AS ic FROM x GROUP BY run, unit_id, token"""
VIEWS["fx_token_pairs"] = """
    WITH x AS (FROM fx_unit_tokens UNION ALL SELECT run, unit_id, '#' || unnest(concepts), 0, 0, 0, 0, 1 FROM fx_units)
    SELECT a.run, a.unit_id AS src, b.unit_id AS dst, CAST(sum(a.it * b.it) AS BIGINT) AS shared_title, CAST(sum(a.ib * b.ib) AS BIGINT) AS shared_body, CAST(sum(a.ik * b.ik) AS BIGINT) AS shared_anchors,
      CAST(sum(a.id * b.id) AS BIGINT) AS shared_discriminators, CAST(sum(a.ic * b.ic) AS BIGINT) AS shared_concepts, count(*) FILTER (a.ic = 0) AS shared_all
    FROM x a JOIN x b ON a.run = b.run AND a.token = b.token AND a.unit_id > b.unit_id GROUP BY 1, 2, 3"""
RELATED = "(x.token = y.token OR (length(x.token) >= 2 AND length(y.token) >= length(x.token) + {0} AND starts_with(y.token, x.token)) OR (length(y.token) >= 2 AND length(x.token) >= length(y.token) + {0} AND starts_with(x.token, y.token)))"
VIEWS["fx_pair_features"] = f"""
    WITH z AS (SELECT run, unit_id, CAST(sum(it) AS BIGINT) AS nt, CAST(sum(ib) AS BIGINT) AS nb, count(*) AS nc FROM fx_unit_tokens GROUP BY ALL),
      p AS (SELECT p.*, coalesce(shared_title::DOUBLE / nullif(a.nt + b.nt - shared_title, 0)::DOUBLE, 0.0) AS title_jaccard, coalesce(a.nb, 0) > 0 AND coalesce(b.nb, 0) > 0 AS bodies, coalesce(shared_all::DOUBLE / nullif(a.nc + b.nc - shared_all, 0)::DOUBLE, 0.0) AS cj
            FROM fx_token_pairs p LEFT JOIN z a ON a.run = p.run AND a.unit_id = p.src LEFT JOIN z b ON b.run = p.run AND b.unit_id = p.dst),
      q AS (SELECT * EXCLUDE (cj), CASE WHEN bodies THEN cj END AS content_jaccard, CASE WHEN bodies THEN floor((title_jaccard * 0.65::DOUBLE + cj * 0.35::DOUBLE) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE ELSE title_jaccard END AS similarity,
                   shared_title + CASE WHEN bodies THEN shared_all ELSE 0 END AS overlap FROM p),
      k AS (SELECT * FROM q WHERE shared_concepts > 0 OR title_jaccard >= 0.15::DOUBLE OR coalesce(content_jaccard, 0.0) >= 0.10::DOUBLE),
      d AS (SELECT run, unit_id, token FROM fx_unit_tokens WHERE id = 1),
      r AS (SELECT k.run, k.src, k.dst, count(DISTINCT x.token) AS shared_topic, count(DISTINCT x.token) FILTER (x.token = y.token) AS exact FROM k JOIN d x ON x.run = k.run AND x.unit_id = k.src JOIN d y ON y.run = k.run AND y.unit_id = k.dst AND {RELATED.format(2)} GROUP BY ALL),
      s AS (SELECT k.run, k.src, k.dst, count(DISTINCT x.token) AS shared_distinctive FROM k JOIN d x ON x.run = k.run AND x.unit_id = k.src AND x.token IN {DISTINCTIVE} JOIN d y ON y.run = k.run AND y.unit_id = k.dst AND y.token IN {DISTINCTIVE} AND {RELATED.format(0)} GROUP BY ALL),
      n AS (SELECT run, unit_id, count(*) FILTER (token IN {DISTINCTIVE}) AS nd FROM d GROUP BY ALL)
    SELECT k.* EXCLUDE (bodies), CASE WHEN coalesce(r.exact, 0) >= 2 THEN r.exact ELSE coalesce(r.shared_topic, 0) END AS shared_topic, coalesce(s.shared_distinctive, 0) AS shared_distinctive,
      CAST(len(list_intersect(a.actors, b.actors)) AS BIGINT) AS shared_actors, CAST(len(list_intersect(a.actions, b.actions)) AS BIGINT) AS shared_actions, CAST(len(a.actors) AS BIGINT) AS actors_left, CAST(len(b.actors) AS BIGINT) AS actors_right,
      CAST(len(a.actions) AS BIGINT) AS actions_left, CAST(len(b.actions) AS BIGINT) AS actions_right, coalesce(n1.nd, 0) AS distinctive_left, coalesce(n2.nd, 0) AS distinctive_right, a.category = b.category AS same_category,
      list_has_any(a.hn1, b.hn2) OR list_has_any(a.hn2, b.hn1) AS hard_negative
    FROM k JOIN fx_units a ON a.run = k.run AND a.unit_id = k.src JOIN fx_units b ON b.run = k.run AND b.unit_id = k.dst LEFT JOIN r ON r.run = k.run AND r.src = k.src AND r.dst = k.dst LEFT JOIN s ON s.run = k.run AND s.src = k.src AND s.dst = k.dst
      LEFT JOIN n n1 ON n1.run = k.run AND n1.unit_id = k.src LEFT JOIN n n2 ON n2.run = k.run AND n2.unit_id = k.dst"""
VIEWS["fx_decided"] = """
    WITH f AS (SELECT *, coalesce(content_jaccard, -1.0) AS cj, (shared_topic >= 1 AND greatest(shared_discriminators, shared_topic) >= 2 AND title_jaccard >= 0.15::DOUBLE AND shared_title >= 3 AND (shared_actors >= 1 OR shared_topic >= 2)) OR (shared_anchors >= 2 AND shared_title >= 1) AS staged FROM fx_pair_features),
      d AS (SELECT *, CASE WHEN hard_negative THEN -2 WHEN NOT same_category THEN -3 WHEN shared_concepts > 0 THEN 4 WHEN actors_left > 0 AND actors_right > 0 AND shared_actors = 0 THEN -5
        WHEN distinctive_left > 0 AND distinctive_right > 0 AND shared_distinctive = 0 THEN -6 WHEN actions_left > 0 AND actions_right > 0 AND shared_actions = 0 AND NOT staged THEN -7
        WHEN staged AND shared_title >= 3 AND title_jaccard >= 0.18::DOUBLE THEN 8 WHEN actors_left >= 2 AND actors_right >= 2 AND shared_discriminators < 1 THEN -9 WHEN shared_anchors >= 3 AND cj >= 0.18::DOUBLE AND shared_actions > 0 THEN 10
        WHEN shared_anchors >= 2 AND shared_title >= 1 AND cj >= 0.10::DOUBLE THEN 11 WHEN shared_anchors >= 1 AND shared_body >= 4 AND shared_title >= 2 AND title_jaccard >= 0.15::DOUBLE AND cj >= 0.14::DOUBLE THEN 12
        WHEN actors_left <> actors_right AND similarity < 0.35::DOUBLE THEN -13 WHEN overlap >= 2 AND shared_topic >= 1 AND similarity >= 0.25::DOUBLE THEN 14 ELSE -14 END AS r FROM f)
    SELECT run, src, dst, similarity, abs(r) AS rule, r > 0 AS compatible FROM d"""


VIEWS["fx_edges"] = """
    WITH p AS (SELECT run, unit_id FROM fx_unit_tokens GROUP BY ALL HAVING sum(id) = 0)
    SELECT d.run, d.src, d.dst, d.similarity, f.shared_discriminators > 0 OR (a.unit_id IS NOT NULL AND b.unit_id IS NOT NULL AND f.shared_title > 0) AS indexed
    FROM fx_decided d JOIN fx_pair_features f ON f.run = d.run AND f.src = d.src AND f.dst = d.dst LEFT JOIN p a ON a.run = d.run AND a.unit_id = d.src LEFT JOIN p b ON b.run = d.run AND b.unit_id = d.dst WHERE d.compatible"""
# units in id order, each given the clusters so far: it enters the best of those it is compatible with as a whole, or opens one
VIEWS["fx_grown"] = """
    WITH RECURSIVE e AS MATERIALIZED (SELECT run, src AS u, dst AS v, similarity AS sim, indexed FROM fx_edges UNION ALL SELECT run, dst, src, similarity, indexed FROM fx_edges),
      k AS (SELECT run, unit_id AS u, list(token) FILTER (id = 1) AS d, list(token) FILTER (it = 1) AS t FROM fx_unit_tokens GROUP BY ALL),
      n AS MATERIALIZED (SELECT x.run, x.unit_id AS u, x.weight AS w, greatest(length(x.title) - 70, 0) / 500.0::DOUBLE AS long, coalesce(k.d, k.t) AS tokens, row_number() OVER (PARTITION BY x.run ORDER BY x.unit_id) AS i
                         FROM fx_units x JOIN (SELECT DISTINCT run, u FROM e) o ON o.run = x.run AND o.u = x.unit_id LEFT JOIN k ON k.run = x.run AND k.u = x.unit_id),
      grow AS (
        SELECT run, 0::BIGINT AS i, []::STRUCT(u BIGINT, c BIGINT)[] AS placed FROM n GROUP BY run
        UNION ALL (
        WITH now AS (SELECT g.run, g.i, g.placed, n.u, n.tokens FROM grow g JOIN n ON n.run = g.run AND n.i = g.i + 1),
          m AS (SELECT run, p.u AS v, p.c AS c FROM (SELECT run, unnest(placed) AS p FROM grow)),
          fits AS (SELECT m.run, m.c FROM m JOIN now ON now.run = m.run LEFT JOIN e ON e.run = m.run AND e.u = now.u AND e.v = m.v GROUP BY ALL HAVING count(e.v) = count(*) AND bool_or(e.indexed)),
          total AS (SELECT m.run, m.c, sum(n.w) AS w, list_distinct(flatten(list(n.tokens))) AS tokens FROM m JOIN n ON n.run = m.run AND n.u = m.v GROUP BY ALL),
          near AS (SELECT a.run, a.c, a.v, sum(e.sim * nb.w) AS s FROM m a JOIN m b ON b.run = a.run AND b.c = a.c AND b.v <> a.v JOIN e ON e.run = a.run AND e.u = a.v AND e.v = b.v JOIN n nb ON nb.run = b.run AND nb.u = b.v GROUP BY ALL),
          score AS (SELECT m.run, m.c, m.v, greatest((coalesce(s, 0.0) + n.w - 1) / greatest(total.w - 1, 1)::DOUBLE - n.long, -1.0) AS x FROM fits JOIN m ON m.run = fits.run AND m.c = fits.c JOIN n ON n.run = m.run AND n.u = m.v JOIN total ON total.run = m.run AND total.c = m.c
                    LEFT JOIN near ON near.run = m.run AND near.c = m.c AND near.v = m.v),
          rep AS (SELECT run, c, v FROM score QUALIFY row_number() OVER (PARTITION BY run, c ORDER BY x DESC, v) = 1),
          best AS (SELECT rep.run, rep.c FROM rep JOIN now ON now.run = rep.run JOIN e ON e.run = rep.run AND e.u = now.u AND e.v = rep.v JOIN total ON total.run = rep.run AND total.c = rep.c
                   QUALIFY row_number() OVER (PARTITION BY rep.run ORDER BY e.sim DESC, len(list_intersect(now.tokens, total.tokens)) DESC, rep.c) = 1)
        SELECT now.run, now.i + 1, list_append(now.placed, {'u': now.u, 'c': coalesce(best.c, now.u)}) FROM now LEFT JOIN best ON best.run = now.run)),
      ended AS (SELECT run, p.u AS unit_id, p.c AS issue_id FROM (SELECT run, unnest(placed) AS p FROM grow QUALIFY row_number() OVER (PARTITION BY run ORDER BY i DESC) = 1))
    SELECT x.run, x.unit_id, coalesce(ended.issue_id, x.unit_id) AS issue_id, x.weight, greatest(length(x.title) - 70, 0) / 500.0::DOUBLE AS long FROM fx_units x LEFT JOIN ended ON ended.run = x.run AND ended.unit_id = x.unit_id"""
VIEWS["fx_clustered"] = "SELECT g.run, g.issue_id, b.article_id, g.unit_id FROM fx_grown g JOIN fx_units u ON u.run = g.run AND u.unit_id = g.unit_id JOIN fx_base b ON b.run = u.run AND b.title_key = u.title_key"
VIEWS["fx_representatives"] = """
    WITH e AS (SELECT run, src AS u, dst AS v, similarity AS sim FROM fx_edges UNION ALL SELECT run, dst, src, similarity FROM fx_edges), w AS (SELECT run, issue_id, sum(weight) AS w FROM fx_grown GROUP BY ALL),
      s AS (SELECT a.run, a.unit_id, sum(e.sim * b.weight) AS s FROM fx_grown a JOIN e ON e.run = a.run AND e.u = a.unit_id JOIN fx_grown b ON b.run = e.run AND b.unit_id = e.v AND b.issue_id = a.issue_id GROUP BY ALL)
    SELECT g.run, g.issue_id, g.unit_id FROM fx_grown g JOIN w ON w.run = g.run AND w.issue_id = g.issue_id LEFT JOIN s ON s.run = g.run AND s.unit_id = g.unit_id
    QUALIFY row_number() OVER (PARTITION BY g.run, g.issue_id ORDER BY greatest((coalesce(s.s, 0.0) + g.weight - 1) / greatest(w.w - 1, 1)::DOUBLE - g.long, -1.0) DESC, g.unit_id) = 1"""


def run_articles(t):
    return t.articles.withColumn("run", C.kst_date(F.col("published_at")))


def units(t):
    return L.headline_units(run_articles(t), LEX)[0]


def rnd(e, d):
    return f"floor(({e}) * {10 ** d}.0::DOUBLE + 0.5::DOUBLE) / {10 ** d}.0::DOUBLE"


@query("candidate_pairs", "SELECT run, src, dst, shared_title, shared_body, shared_anchors, shared_discriminators, shared_concepts, shared_all FROM fx_token_pairs")
def _(t):
    return L.token_pairs(units(t))


@query("token_blocking_join", "SELECT run, src, dst, shared_all FROM fx_token_pairs WHERE shared_discriminators > 0")
def _(t):
    return L.token_pairs(units(t)).filter("shared_discriminators > 0").select("run", "src", "dst", "shared_all")


BIG = ("shared_title", "shared_body", "shared_anchors", "shared_discriminators", "shared_topic", "shared_distinctive", "shared_actors", "shared_actions", "overlap")


@query("pair_features", f"SELECT run, src, dst, {', '.join(BIG)}, {rnd('title_jaccard', 6)} AS title_jaccard, {rnd('content_jaccard', 6)} AS content_jaccard, similarity, same_category, hard_negative FROM fx_pair_features")
def _(t):
    u = units(t)
    f = L.pair_features(u, L.similar_pairs(u))
    return f.select("run", "src", "dst", *[F.col(c).cast("bigint").alias(c) for c in BIG], C.half_up(F.col("title_jaccard"), 6).alias("title_jaccard"),
                    C.half_up(F.col("content_jaccard"), 6).alias("content_jaccard"), "similarity", "same_category", "hard_negative")


@query("compatible_event", "SELECT run, src, dst, CAST(rule AS BIGINT) AS rule, compatible FROM fx_decided")
def _(t):
    u = units(t)
    return L.compatible_event(L.pair_features(u, L.similar_pairs(u))).select("run", "src", "dst", F.col("rule").cast("bigint").alias("rule"), "compatible")


@query("hard_negative_split", f"SELECT article_id, array_to_string({sides(0)}, ',') AS first_side, array_to_string({sides(1)}, ',') AS second_side FROM fx_articles")
def _(t):
    a, b = X.hard_negative_sides(F.col("title"), HARD)
    return t.articles.select("article_id", F.array_join(F.transform(a, lambda x: x.cast("string")), ",").alias("first_side"), F.array_join(F.transform(b, lambda x: x.cast("string")), ",").alias("second_side"))


@query("event_components", """
    WITH RECURSIVE e AS (SELECT run, src AS a, dst AS b FROM fx_decided WHERE compatible UNION SELECT run, dst, src FROM fx_decided WHERE compatible),
      reach AS (SELECT run, a, b FROM e UNION SELECT r.run, r.a, e.b FROM reach r JOIN e ON e.run = r.run AND e.a = r.b)
    SELECT run, a AS node, least(a, min(b)) AS component FROM reach GROUP BY run, a""")
def _(t):
    u = units(t)
    edges = L.compatible_edges(u)
    return L.connected_components(edges)


@query("complete_link_clusters", "SELECT run, issue_id, article_id, unit_id FROM fx_clustered")
def _(t):
    return L.cluster_articles(run_articles(t), LEX)


@query("representative_article", "SELECT run, issue_id, unit_id AS article_id FROM fx_representatives")
def _(t):
    return L.cluster_members(run_articles(t), LEX).filter("is_representative").select("run", "issue_id", "article_id")


def fixture_members(t):
    return t.members.join(t.articles.select("article_id", "homepage_placement"), "article_id").withColumn("run", F.expr("issue_id % 9"))


VIEWS["fx_components"] = """
    WITH c AS (SELECT issue_id % 9 AS run, issue_id, count(*) AS n, count(DISTINCT source_id) AS s, count(DISTINCT media_group_id) AS g FROM fx_members GROUP BY ALL), m AS (SELECT run, max(n) AS mx FROM c GROUP BY 1)
    SELECT c.run, issue_id, n, s, g, least(100.0::DOUBLE, g / 6.0::DOUBLE * 100.0::DOUBLE) AS d, least(100.0::DOUBLE, ln(1.0::DOUBLE + n) / ln(1.0::DOUBLE + mx) * 100.0::DOUBLE) AS v, CASE WHEN n > 1 THEN (n - s)::DOUBLE / (n - 1) * 100.0::DOUBLE ELSE 0.0 END AS f FROM c JOIN m USING (run)"""


@query("issue_components", f"SELECT run, issue_id, n AS article_count, s AS source_count, g AS group_count, {rnd('d', 6)} AS diversity, {rnd('v', 6)} AS volume, {rnd('f', 6)} AS follow_up FROM fx_components")
def _(t):
    out = I.issue_components(fixture_members(t), 6)
    return out.select("run", "issue_id", "article_count", "source_count", "group_count", *[C.half_up(F.col(c), 6).alias(c) for c in ("diversity", "volume", "follow_up")])


ZONE = "CASE {} WHEN 'top' THEN 100.0::DOUBLE WHEN 'main' THEN 82.0::DOUBLE WHEN 'section' THEN 58.0::DOUBLE WHEN 'list' THEN 35.0::DOUBLE END"
VIEWS["fx_placement"] = f"""
    WITH o AS (SELECT article_id, avg({ZONE.format('zone')}) AS v, count(*) AS n FROM fx_placements GROUP BY 1), a AS (SELECT m.issue_id, CASE WHEN o.n IS NOT NULL THEN o.v ELSE {ZONE.format('homepage_placement')} END AS v,
      coalesce(o.n, CASE WHEN homepage_placement IS NOT NULL THEN 1 ELSE 0 END) AS n FROM fx_members m JOIN fx_articles x ON x.article_id = m.article_id LEFT JOIN o ON o.article_id = m.article_id)
    SELECT issue_id, avg(v) AS placement, count(v) AS placement_observed, CAST(sum(n) AS BIGINT) AS observations FROM a GROUP BY 1"""


@query("placement_score", f"SELECT issue_id, {rnd('placement', 6)} AS placement, placement_observed, observations FROM fx_placement")
def _(t):
    return I.placement_score(fixture_members(t), t.placements).withColumn("placement", C.half_up(F.col("placement"), 6))


@query("issue_cohesion", f"""
    SELECT issue_id, {rnd('(min(similarity) * 0.35::DOUBLE + avg(similarity) * 0.65::DOUBLE) * 100.0::DOUBLE', 1)} AS cohesion_score, CASE WHEN count(*) < 2 THEN 'insufficient_evidence' WHEN min(similarity) >= 0.35::DOUBLE THEN 'cohesive' ELSE 'review_required' END AS cluster_quality FROM fx_members GROUP BY 1""")
def _(t):
    return I.issue_cohesion(t.members)


VIEWS["fx_frame_share"] = f"""
    WITH h AS (SELECT m.issue_id, m.article_id, f.frame, CASE f.frame {' '.join(f"WHEN '{k}' THEN " + ' OR '.join(f"contains(body_text, '{w}')" for w in ws) for k, ws in FRAMES)} END AS b,
        CASE f.frame {' '.join(f"WHEN '{k}' THEN " + ' OR '.join(f"contains(title, '{w}')" for w in ws) for k, ws in FRAMES)} END AS t
      FROM fx_members m JOIN fx_articles a ON a.article_id = m.article_id, (SELECT unnest({[k for k, _ in FRAMES]}) AS frame) f)
    SELECT issue_id, frame, count(*) FILTER (b OR t) AS articles, {rnd('count(*) FILTER (b OR t)::DOUBLE / count(*) * 100.0::DOUBLE', 1)} AS score, coalesce(min(article_id) FILTER (b), min(article_id) FILTER (t)) AS evidence_article_id,
      CASE WHEN bool_or(b) THEN 'body_signal_detected' WHEN bool_or(t) THEN 'headline_signal_detected' ELSE 'not_detected' END AS status FROM h GROUP BY 1, 2"""


@query("frame_signal_share", "SELECT * FROM fx_frame_share")
def _(t):
    return I.frame_signal_share(t.members, t.articles, FRAMES)


@query("issue_report", f"""
    WITH c AS (SELECT issue_id, count(*) AS n, count(DISTINCT source_id) AS s FROM fx_members GROUP BY 1),
      f AS (SELECT issue_id, upper(frame[1]) || frame[2:] AS label FROM fx_frame_share WHERE status <> 'not_detected' QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, list_position({[k for k, _ in FRAMES]}, frame)) = 1)
    SELECT c.issue_id, CASE WHEN label IS NULL THEN '{I.REPORT_NONE}' WHEN n > 0 THEN printf('{I.REPORT_BODY}', n, n, label) ELSE printf('{I.REPORT_TITLE}', s, n, label) END AS summary FROM c LEFT JOIN f ON f.issue_id = c.issue_id""")
def _(t):
    rows = I.frame_signal_share(t.members, t.articles, FRAMES)
    counts = t.members.groupBy("issue_id").agg(F.count(F.lit(1)).alias("article_count"), F.count_distinct("source_id").alias("source_count"), F.count(F.lit(1)).alias("body_articles"))
    names = {k: k.title() for k, _ in FRAMES}
    return I.issue_report(counts.drop("body_articles"), rows, counts, names, tuple(names))


@query("title_key_groups", """
    WITH k AS (SELECT article_id, source_id, array_to_string(list_filter(string_split(regexp_replace(lower(title), '[^0-9a-z가-힣 ]+', ' ', 'g'), ' '), lambda w: length(w) >= 2)[1:3], ' ') AS title_key FROM fx_articles),
      g AS (SELECT title_key, count(*) AS n, count(DISTINCT source_id) AS o, min(article_id) AS f FROM k WHERE title_key <> '' GROUP BY 1 HAVING count(DISTINCT source_id) >= 2),
      r AS (SELECT *, row_number() OVER w AS case_no, 120 - coalesce(sum(n) OVER (ORDER BY o DESC, n DESC, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM g WINDOW w AS (ORDER BY o DESC, n DESC, f))
    SELECT CAST(case_no AS BIGINT) AS case_no, k.title_key, article_id, source_id FROM k JOIN r ON r.title_key = k.title_key WHERE least(n, room) >= 2
    QUALIFY row_number() OVER (PARTITION BY k.title_key ORDER BY source_id, article_id) <= least(n, room)""")
def _(t):
    return I.title_key_groups(t.articles, 120).withColumn("case_no", F.col("case_no").cast("bigint"))


def clustered(t):
    return L.cluster_members(run_articles(t), LEX)


VIEWS["fx_issue_members"] = """
    WITH e AS (SELECT run, src AS u, dst AS v, similarity AS sim FROM fx_edges UNION ALL SELECT run, dst, src, similarity FROM fx_edges)
    SELECT c.run, c.issue_id, c.article_id, r.unit_id AS representative, CASE WHEN c.unit_id = r.unit_id THEN 1.0::DOUBLE ELSE e.sim END AS similarity
    FROM fx_clustered c JOIN fx_representatives r ON r.run = c.run AND r.issue_id = c.issue_id LEFT JOIN e ON e.run = c.run AND e.u = c.unit_id AND e.v = r.unit_id"""
VIEWS["fx_issue_titles"] = f"""
    WITH x AS (SELECT issue_id, m.article_id, unnest({listed(CONCEPTS, lambda r: ' AND '.join(f"regexp_matches(title, '{p}')" for p in r[1]))}) AS concept FROM fx_issue_members m JOIN fx_articles a ON a.article_id = m.article_id),
      l AS (SELECT issue_id, concept FROM x GROUP BY issue_id, concept QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY count(*) DESC, min(article_id), list_position({[c[0] for c in CONCEPTS]}, concept)) = 1),
      n AS (SELECT issue_id, count(*) AS n, {', '.join(f"sum(len(regexp_extract_all(title, '{p}'))) AS s{i}" for i, (_, p) in enumerate(TITLES))} FROM fx_issue_members m JOIN fx_articles a ON a.article_id = m.article_id GROUP BY 1),
      s AS (SELECT issue_id, CASE WHEN greatest(s0, s1) < greatest(2, ceil(n * 0.25)) THEN NULL WHEN s0 >= s1 THEN '{TITLES[0][0]}' ELSE '{TITLES[1][0]}' END AS suffix FROM n),
      t AS (SELECT article_id, count(*) AS n, array_to_string(list(token ORDER BY position)[1:3], ' ') AS words FROM fx_title_tokens GROUP BY 1)
    SELECT r.issue_id, CASE l.concept WHEN 'inone' THEN 'In one' WHEN 'toed' THEN 'To ed' ELSE CASE WHEN length(headline) >= 8 THEN headline WHEN t.n >= 2 THEN words || ' ' || coalesce(suffix, '관련 보도')
      WHEN headline <> '' THEN headline WHEN clean <> '' THEN clean ELSE '주요 이슈' END END AS issue_title
    FROM fx_representatives r JOIN fx_headlines h ON h.article_id = r.unit_id LEFT JOIN l ON l.issue_id = r.issue_id LEFT JOIN s ON s.issue_id = r.issue_id LEFT JOIN t ON t.article_id = r.unit_id"""


@query("issue_title", "SELECT issue_id, issue_title FROM fx_issue_titles")
def _(t):
    m = clustered(t)
    titled = m.join(t.articles.select("article_id", "title"), "article_id")
    return I.issue_title(m, t.articles, L.issue_suffixes(titled, TITLES), CONCEPTS, {"inone": "In one", "toed": "To ed"}, stopwords=STOP)


@query("issue_table", f"""
    WITH m AS (SELECT i.*, a.source_id, coalesce(a.media_group_id, a.source_id) AS g, a.homepage_placement FROM fx_issue_members i JOIN fx_articles a ON a.article_id = i.article_id),
      c AS (SELECT run, issue_id, any_value(representative) AS representative, count(*) AS n, count(DISTINCT source_id) AS s, count(DISTINCT g) AS g, min(similarity) AS low, avg(similarity) AS mean FROM m GROUP BY ALL),
      o AS (SELECT article_id, avg({ZONE.format('zone')}) AS v, count(*) AS n FROM fx_placements GROUP BY 1),
      p AS (SELECT issue_id, avg(CASE WHEN o.n IS NOT NULL THEN o.v ELSE {ZONE.format('homepage_placement')} END) AS p, count(CASE WHEN o.n IS NOT NULL THEN o.v ELSE {ZONE.format('homepage_placement')} END) AS seen FROM m LEFT JOIN o ON o.article_id = m.article_id GROUP BY 1),
      x AS (SELECT c.*, p.p, p.seen, least(100.0::DOUBLE, g / 6.0::DOUBLE * 100.0::DOUBLE) AS d, least(100.0::DOUBLE, ln(1.0::DOUBLE + n) / ln(1.0::DOUBLE + max(n) OVER (PARTITION BY run)) * 100.0::DOUBLE) AS v,
              CASE WHEN n > 1 THEN (n - s)::DOUBLE / (n - 1) * 100.0::DOUBLE ELSE 0.0 END AS f FROM c JOIN p ON p.issue_id = c.issue_id),
      y AS (SELECT x.*, k.category, t.issue_title AS title, {rnd(SCORE, 1)} AS agenda_score, {rnd('(low * 0.35::DOUBLE + mean * 0.65::DOUBLE) * 100.0::DOUBLE', 1)} AS cohesion_score,
              CASE WHEN n < 2 THEN 'insufficient_evidence' WHEN low >= 0.35::DOUBLE THEN 'cohesive' ELSE 'review_required' END AS cluster_quality, CASE WHEN seen > 0 THEN 'observed_components' ELSE 'placement_excluded' END AS score_status
            FROM x JOIN fx_issue_titles t ON t.issue_id = x.issue_id JOIN fx_category k ON k.article_id = x.representative)
    SELECT run, issue_id, row_number() OVER (PARTITION BY run ORDER BY CAST(category = 'german' AS INTEGER), agenda_score DESC, s DESC, n DESC, cohesion_score DESC, title, issue_id) AS agenda_rank, title, category, agenda_score, score_status, n AS article_count, s AS source_count,
      cohesion_score, cluster_quality, {rnd('d', 1)} AS diversity_score, {rnd('v', 1)} AS volume_score, {rnd('p', 1)} AS placement_score, {rnd('f', 1)} AS repetition_score FROM y""")
def _(t):
    m = clustered(t)
    titled = m.join(t.articles.select("article_id", "title", "section"), "article_id")
    titles = I.issue_title(m, t.articles, L.issue_suffixes(titled, TITLES), CONCEPTS, {"inone": "In one", "toed": "To ed"}, stopwords=STOP)
    category = titled.filter("is_representative").select("issue_id", F.coalesce(X.category_classify(F.col("section"), F.col("title"), SECTIONS, TITLES), F.lit("none")).alias("category"))
    out = I.issue_table(m, t.articles, t.placements, titles, category, 12, 6, secondary=("german",))
    return out.select("run", "issue_id", F.col("agenda_rank").cast("bigint").alias("agenda_rank"), "title", "category", "agenda_score", "score_status", "article_count", "source_count", "cohesion_score", "cluster_quality",
                      C.half_up(F.col("diversity"), 1).alias("diversity_score"), C.half_up(F.col("volume"), 1).alias("volume_score"), C.half_up(F.col("placement"), 1).alias("placement_score"), C.half_up(F.col("follow_up"), 1).alias("repetition_score"))
