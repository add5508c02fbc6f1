"""Cross-outlet comparison over the given documents, twenty-five consecutive documents to an issue."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pressgrain.functions import columns as C
from pressgrain.lexicons.frames import DIMENSIONS
from pressgrain.operators import compare as M, framing as P, textops as T
from pressgrain.plans import q_framing as Q
from pressgrain.plans.fixtures import VIEWS
from pressgrain.plans.registry import query
from pressgrain.session import cut_lineage

OFFICIAL = ("government_official", "anonymous_official")


def rnd(e, d):
    return f"floor(({e}) * {10 ** d}.0::DOUBLE + 0.5::DOUBLE) / {10 ** d}.0::DOUBLE"


MEM = "JOIN fx_members m ON m.article_id = x.article_id"
VIEWS["fx_ii"] = f"SELECT x.*, m.issue_id, m.source_id, m.media_group_id FROM fx_items x {MEM}"
VIEWS["fx_is"] = f"SELECT x.*, m.issue_id, m.source_id FROM fx_status x {MEM}"
VIEWS["fx_im"] = f"SELECT x.*, m.issue_id, m.source_id FROM fx_mentions x {MEM}"
VIEWS["fx_id"] = f"SELECT x.*, m.issue_id, m.source_id FROM fx_descriptors x {MEM}"
VIEWS["fx_patterns"] = "SELECT issue_id, dimension, variant_key, voice_scope, min(code) AS code, count(DISTINCT article_id) AS article_count, count(DISTINCT claim_id) AS claim_count, list_sort(list_distinct(list(source_id))) AS outlets, list_sort(list_distinct(list(media_group_id))) AS groups FROM fx_ii GROUP BY ALL"
VIEWS["fx_view"] = "SELECT issue_id, source_id, article_id, dimension, arg_min(code, {'p': paragraph, 's': sentence, 'r': rule_no}) AS family, arg_min(code, {'p': paragraph, 's': sentence, 'r': rule_no}) FILTER (voice_scope = 'narration') AS narrated_family, count(*) FILTER (voice_scope = 'narration') AS narrated, count(*) FILTER (voice_scope = 'source') AS attributed FROM fx_ii GROUP BY ALL"
VIEWS["fx_sizes"] = "SELECT issue_id, count(DISTINCT article_id) AS n FROM fx_members GROUP BY 1"
DORDER = "CASE dimension " + " ".join(f"WHEN '{d}' THEN {i + 1}" for i, d in enumerate(DIMENSIONS)) + " END"


def raw_items(t, s=None):
    """Items are read several times by a comparison, so they are written out once."""
    return cut_lineage(Q.items(t, s))


def items(t, s=None):
    return M.with_issue(raw_items(t, s), t.members)


def both(t, s=None):
    raw = raw_items(t, s)
    return M.with_issue(raw, t.members), M.with_issue(P.dimension_status(t.articles, raw), t.members)


def mentions(t):
    return M.with_issue(Q.mentions(t), t.members)


def descriptors(t):
    return M.with_issue(Q.descriptors(t), t.members)


BIG = Q.BIG


@query("axis_patterns", "SELECT issue_id, dimension, variant_key, voice_scope, article_count, claim_count, array_to_string(outlets, ',') AS outlets, array_to_string(groups, ',') AS groups FROM fx_patterns")
def _(t):
    return M.axis_patterns(items(t)).drop("code").withColumns({"outlets": F.array_join("outlets", ","), "groups": F.array_join("groups", ",")})


@query("axis_evidence", "SELECT issue_id, dimension, variant_key, voice_scope, article_id, row_number() OVER (PARTITION BY issue_id, dimension, variant_key, voice_scope ORDER BY article_id, paragraph, sentence) AS position, sentence_sha256 FROM fx_ii QUALIFY position <= 8")
def _(t):
    return BIG(M.axis_evidence(items(t)).select("issue_id", "dimension", "variant_key", "voice_scope", "article_id", "position", "sentence_sha256"), "position")


@query("comparison_axes_simple", "SELECT issue_id, dimension, voice_scope, code, count(DISTINCT article_id) AS article_count, count(DISTINCT source_id) AS outlet_count, count(DISTINCT (article_id, paragraph, sentence)) AS evidence_count FROM fx_ii GROUP BY ALL")
def _(t):
    return M.comparison_axes_simple(items(t))


VIEWS["fx_observed"] = "SELECT issue_id, dimension, count(*) FILTER (status <> 'not_observed') AS observed, count(*) FILTER (status = 'observed') AS narration, count(*) FILTER (status = 'source_attributed') AS source_only, count(*) FILTER (status = 'not_observed') AS not_observed FROM fx_is GROUP BY ALL"


@query("axis_observation_counts", "SELECT * FROM fx_observed")
def _(t):
    return M.axis_observation_counts(both(t)[1])


VIEWS["fx_lens"] = f"""
    WITH q AS (SELECT * FROM fx_im WHERE direct_quote_count + indirect_attribution_count > 0), o AS (SELECT issue_id, source_id, count(DISTINCT article_id) AS n FROM fx_members GROUP BY ALL), r AS (SELECT DISTINCT issue_id, role FROM q),
      g AS (SELECT r.issue_id, r.role, o.source_id, coalesce(x.a, 0)::DOUBLE / o.n AS rate, x.a FROM r JOIN o ON o.issue_id = r.issue_id LEFT JOIN (SELECT issue_id, role, source_id, count(DISTINCT article_id) AS a FROM q GROUP BY ALL) x ON x.issue_id = r.issue_id AND x.role = r.role AND x.source_id = o.source_id),
      s AS (SELECT issue_id, role, count(DISTINCT article_id) AS article_count, count(DISTINCT article_id) FILTER (direct_quote_count > 0) AS direct_articles, count(DISTINCT article_id) FILTER (indirect_attribution_count > 0) AS indirect_articles, CAST(sum(direct_quote_count) AS BIGINT) AS direct_quote_count, CAST(sum(indirect_attribution_count) AS BIGINT) AS indirect_attribution_count FROM q GROUP BY ALL)
    SELECT s.*, p.outlet_count, p.presence_gap FROM s JOIN (SELECT issue_id, role, count(a) AS outlet_count, {rnd('max(rate) - min(rate)', 3)} AS presence_gap FROM g GROUP BY ALL) p ON p.issue_id = s.issue_id AND p.role = s.role"""


@query("source_role_lens", "SELECT * FROM fx_lens")
def _(t):
    return M.source_role_lens(M.with_issue(cut_lineage(Q.mentions(t)), t.members), t.members)


@query("source_lens_by_outlet", f"""
    WITH b AS (SELECT issue_id, source_id, count(DISTINCT article_id) AS n FROM fx_members GROUP BY ALL), q AS (SELECT issue_id, source_id, count(DISTINCT article_id) AS s, count(DISTINCT article_id) FILTER (role IN {OFFICIAL}) AS o, count(DISTINCT article_id) FILTER (role = 'affected_person') AS a FROM fx_im GROUP BY ALL)
    SELECT b.issue_id, b.source_id, n AS article_count, coalesce(s, 0) AS source_articles, {rnd('o::DOUBLE / s', 3)} AS official_share, {rnd('coalesce(a, 0)::DOUBLE / n', 3)} AS affected_rate FROM b LEFT JOIN q ON q.issue_id = b.issue_id AND q.source_id = b.source_id""")
def _(t):
    return M.source_lens_by_outlet(mentions(t), t.members, OFFICIAL)


@query("source_lens_flat", "SELECT issue_id, source_id, role, CAST(sum(greatest(direct_quote_count + indirect_attribution_count, 1)) AS BIGINT) AS mentions FROM fx_im GROUP BY ALL")
def _(t):
    return M.source_lens_flat(mentions(t))


@query("frame_lens", f"""
    WITH p AS (SELECT issue_id, source_id, code, count(DISTINCT article_id) AS a, CAST(sum(sentence_count) AS BIGINT) AS s FROM fx_id WHERE kind = 'generic' GROUP BY ALL), b AS (SELECT issue_id, source_id, count(DISTINCT article_id) AS n FROM fx_members GROUP BY ALL)
    SELECT p.issue_id, p.source_id, code, a AS article_count, s AS sentence_count, {rnd('a::DOUBLE / n', 3)} AS article_share, {rnd('a::DOUBLE / sum(a) OVER (PARTITION BY p.issue_id, p.source_id)', 3)} AS composition_share FROM p JOIN b ON b.issue_id = p.issue_id AND b.source_id = p.source_id""")
def _(t):
    return M.frame_lens(descriptors(t), t.members)


@query("reporting_style_lens", f"""
    WITH e AS (SELECT issue_id, source_id, article_id, count(*) FILTER (voice_scope = 'narration' AND code = 'm_ein') AS n, count(*) FILTER (voice_scope = 'narration' AND code = 'm_for') AS p, count(*) FILTER (voice_scope = 'source') AS a FROM fx_ii WHERE dimension = 'moral_evaluation' GROUP BY ALL),
      o AS (SELECT issue_id, source_id, avg((p - n)::DOUBLE / nullif(p + n, 0)) AS ev, count(*) FILTER (n > p) AS c, count(*) FILTER (p > n) AS s, count(*) FILTER (n + p = 0 AND a > 0) AS t FROM e GROUP BY ALL),
      z AS (SELECT issue_id, source_id, avg((thematic - episodic)::DOUBLE / nullif(thematic + episodic, 0)) AS sc FROM fx_members m JOIN fx_scope s ON s.article_id = m.article_id GROUP BY ALL), b AS (SELECT issue_id, source_id, count(DISTINCT article_id) AS article_count FROM fx_members GROUP BY ALL)
    SELECT b.*, {rnd('ev', 3)} AS evaluation_index, {rnd('sc', 3)} AS scope_index, coalesce(c, 0) AS critical, coalesce(s, 0) AS supportive, coalesce(t, 0) AS attributed_only FROM b LEFT JOIN o ON o.issue_id = b.issue_id AND o.source_id = b.source_id LEFT JOIN z ON z.issue_id = b.issue_id AND z.source_id = b.source_id""")
def _(t):
    return M.reporting_style_lens(items(t), Q.scopes(t), t.members, Q.NEGATIVE, Q.POSITIVE)


@query("morphology_lens", f"""
    WITH x AS (SELECT t.*, m.issue_id, m.source_id, m.media_group_id FROM fx_terms t JOIN fx_members m ON m.article_id = t.article_id), k AS (SELECT issue_id, term FROM x GROUP BY ALL HAVING count(DISTINCT article_id) >= 2 AND count(DISTINCT media_group_id) >= 2),
      d AS (SELECT issue_id, source_id, sum(n) AS t FROM x GROUP BY ALL), n AS (SELECT x.issue_id, x.source_id, x.term, CAST(sum(n) AS BIGINT) AS n FROM x JOIN k ON k.issue_id = x.issue_id AND k.term = x.term GROUP BY ALL)
    SELECT n.issue_id, n.source_id, term, n, {rnd('n::DOUBLE / t::DOUBLE * 1000.0::DOUBLE', 3)} AS per_thousand, row_number() OVER (PARTITION BY n.issue_id, n.source_id ORDER BY {rnd('n::DOUBLE / t::DOUBLE * 1000.0::DOUBLE', 3)} DESC, n DESC, term) AS position
    FROM n JOIN d ON d.issue_id = n.issue_id AND d.source_id = n.source_id QUALIFY position <= 15""")
def _(t):
    # terms, not tokens, are written out, with their issue while they lie by article; the content tokens are the sum of the terms
    terms = cut_lineage(M.with_issue(T.article_terms(T.segment_sentences(t.articles)), t.members))
    return BIG(M.morphology_lens(terms, terms.withColumnRenamed("n", "content_token_count")), "position")


@query("dominant_secondary", "SELECT issue_id, code, count(DISTINCT article_id) AS article_count, row_number() OVER (PARTITION BY issue_id ORDER BY count(DISTINCT article_id) DESC, code) AS position FROM fx_id WHERE kind = 'policy' GROUP BY issue_id, code QUALIFY position <= 5")
def _(t):
    return BIG(M.dominant_secondary(descriptors(t).filter("kind = 'policy'")), "position")


VIEWS["fx_dominance"] = f"""
    WITH s AS (SELECT DISTINCT issue_id, article_id, dimension, voice_scope FROM fx_ii), c AS (SELECT issue_id, count(*) AS total, count(*) FILTER (voice_scope = 'source') AS attributed FROM s GROUP BY 1),
      b AS (SELECT issue_id, count(*) AS n, bool_and(genre = 'straight_news') AS straight FROM fx_members m JOIN fx_genre g ON g.article_id = m.article_id GROUP BY 1)
    SELECT b.issue_id, coalesce(total, 0) AS total, coalesce(attributed, 0) AS attributed, {rnd('coalesce(attributed::DOUBLE / total, 0)', 3)} AS attributed_share, n >= 2 AND straight AND coalesce(attributed::DOUBLE / total, 0) >= 0.7::DOUBLE AS detected FROM b LEFT JOIN c ON c.issue_id = b.issue_id"""


@query("source_dominance", "SELECT * FROM fx_dominance")
def _(t):
    s = Q.written(t)
    return M.source_dominance(items(t, s), Q.genres(t, s), t.members)


@query("genre_scope_context_counts", """
    WITH v AS (SELECT issue_id, g.genre || '/' || coalesce(s.scope, 'none') AS value, m.article_id FROM fx_members m JOIN fx_genre g ON g.article_id = m.article_id LEFT JOIN fx_scope s ON s.article_id = m.article_id)
    SELECT issue_id, value, count(DISTINCT article_id) AS n, row_number() OVER (PARTITION BY issue_id ORDER BY count(DISTINCT article_id) DESC, value) AS position FROM v GROUP BY issue_id, value""")
def _(t):
    v = Q.genres(t).join(Q.scopes(t).select("article_id", "scope"), "article_id", "left").select("article_id", F.concat_ws("/", "genre", F.coalesce("scope", F.lit("none"))).alias("value"))
    return BIG(M.value_counts(M.with_issue(v, t.members), "value"), "position")


@query("claim_fold", "SELECT article_id, dimension, code, voice_kind, count(*) AS evidence_count, count(DISTINCT (paragraph, sentence)) AS sentences, min({'p': paragraph, 's': sentence}).p AS paragraph, min({'p': paragraph, 's': sentence}).s AS sentence FROM fx_voiced GROUP BY article_id, dimension, code, voice_kind")
def _(t):
    return M.claim_fold(Q.voiced(t))


@query("article_view", "SELECT * FROM fx_view")
def _(t):
    return M.article_view(items(t))


def mode_sql(src, keys, value):
    k = ", ".join(keys)
    return f"""SELECT {k}, arg_min(v, r) AS value, max(n) AS n, coalesce(max(n) FILTER (r = 2) = max(n), false) AS tie FROM (SELECT {k}, {value} AS v, count(*) AS n, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, {value}) AS r
        FROM {src} WHERE {value} IS NOT NULL GROUP BY {k}, {value}) GROUP BY {k}"""


ISD = ("issue_id", "source_id", "dimension")


@query("mode_with_tie", mode_sql("fx_view", ("issue_id", "dimension"), "family"))
def _(t):
    return M.mode_with_tie(M.article_view(items(t)), ["issue_id", "dimension"], "family")


VIEWS["fx_outlet_view"] = f"""
    WITH a AS ({mode_sql('fx_view', ISD, 'family')}), b AS ({mode_sql('fx_view', ISD, 'narrated_family')})
    SELECT a.issue_id, a.source_id, a.dimension, a.value AS lead, a.tie AS lead_tie, b.value AS lead_narrated, b.tie AS narrated_tie FROM a LEFT JOIN b ON b.issue_id = a.issue_id AND b.source_id = a.source_id AND b.dimension = a.dimension"""


@query("outlet_view", "SELECT * FROM fx_outlet_view")
def _(t):
    return M.outlet_view(M.article_view(items(t)))


VIEWS["fx_marked"] = "SELECT i.*, s.status FROM fx_ii i JOIN fx_status s ON s.article_id = i.article_id AND s.dimension = i.dimension"
VIEWS["fx_told"] = "SELECT * FROM fx_marked WHERE status = 'observed'"


@query("layer_view", f"""
    WITH c AS (SELECT issue_id, dimension, count(*) FILTER (status = 'observed') AS a, count(*) FILTER (status = 'source_attributed') AS b FROM fx_marked GROUP BY ALL), o AS (SELECT issue_id, dimension, count(DISTINCT value) AS k, count(*) AS n FROM ({mode_sql('fx_told', ISD, 'code')}) GROUP BY ALL),
      e AS (SELECT issue_id, dimension, count(DISTINCT value) AS k FROM ({mode_sql('fx_marked', ISD, 'code')}) GROUP BY ALL)
    SELECT s.issue_id, s.dimension, s.not_observed, coalesce(c.a, 0) AS narrated_items, coalesce(c.b, 0) AS attributed_items, coalesce(o.k, 0) AS outlet_kinds, coalesce(o.n, 0) AS narrated_outlets, coalesce(e.k, 0) AS outlet_kinds_with_sources
    FROM fx_observed s LEFT JOIN c USING (issue_id, dimension) LEFT JOIN o USING (issue_id, dimension) LEFT JOIN e USING (issue_id, dimension)""")
def _(t):
    return M.layer_view(*both(t))


SHORT = {d: f"d{i}" for i, d in enumerate(DIMENSIONS)}


@query("frame_clusters", f"""
    WITH w AS (SELECT m.issue_id, m.article_id, m.source_id, {', '.join(f"max(v.family) FILTER (v.dimension = '{d}') AS {s}" for d, s in SHORT.items())} FROM fx_members m LEFT JOIN fx_view v ON v.issue_id = m.issue_id AND v.article_id = m.article_id GROUP BY ALL),
      g AS (SELECT issue_id, {', '.join(SHORT.values())}, count(*) AS articles, count(DISTINCT source_id) AS outlets, {" || '|' || ".join(f"coalesce({s}, '-')" for s in SHORT.values())} AS signature FROM w GROUP BY ALL),
      b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY articles DESC, signature) = 1)
    SELECT g.issue_id, g.signature, g.articles, g.outlets, array_to_string(list_filter([{', '.join(f"CASE WHEN g.{s} <> b.{s} THEN '{d}' END" for d, s in SHORT.items())}], lambda x: x IS NOT NULL), ',') AS differs_at,
      array_to_string(list_filter([{', '.join(f"CASE WHEN (g.{s} IS NULL) <> (b.{s} IS NULL) THEN '{d}' END" for d, s in SHORT.items())}], lambda x: x IS NOT NULL), ',') AS partial_at FROM g JOIN b ON b.issue_id = g.issue_id""")
def _(t):
    return M.frame_clusters(M.article_view(items(t)), t.members)


@query("day_rollup", f"""
    SELECT day, issue_id, source_id, count(*) AS articles, count(DISTINCT source_id) AS outlets, CAST(grouping(day, issue_id, source_id) AS BIGINT) AS level, {rnd('count(DISTINCT source_id)::DOUBLE / count(*)', 3)} AS spread
    FROM (SELECT m.*, strftime(published_at + INTERVAL 9 HOURS, '%Y-%m-%d') AS day FROM fx_members m JOIN fx_articles a ON a.article_id = m.article_id) GROUP BY ROLLUP (day, issue_id, source_id) HAVING day IS NOT NULL""")
def _(t):
    m = t.members.join(t.articles.select("article_id", C.kst_date(F.col("published_at")).alias("day")), "article_id")
    return M.day_rollup(m)


@query("day_layers", """
    WITH p AS (SELECT issue_id, dimension, count(DISTINCT lead_narrated) AS o, count(DISTINCT lead) AS a FROM fx_outlet_view GROUP BY ALL)
    SELECT CAST(issue_id // 20 AS BIGINT) AS day, dimension, count(*) FILTER (o >= 2) AS split, count(*) FILTER (a >= 2) AS split_with_sources FROM p GROUP BY ALL""")
def _(t):
    days = t.members.selectExpr("issue_id div 20 as day", "issue_id")
    return M.day_layers(days, M.article_view(items(t)))


VIEWS["fx_ranked"] = "SELECT *, row_number() OVER (PARTITION BY issue_id, dimension ORDER BY article_count DESC, code, variant_key) AS pos FROM fx_patterns WHERE voice_scope = 'narration'"
VIEWS["fx_pairs"] = "SELECT a.issue_id, a.dimension, a.variant_key AS lv, b.variant_key AS rv, a.article_count AS lc, b.article_count AS rc, a.groups AS lg, b.groups AS rg, a.pos AS lp, b.pos AS rp FROM fx_ranked a JOIN fx_ranked b ON b.issue_id = a.issue_id AND b.dimension = a.dimension AND a.pos < b.pos"
VIEWS["fx_overlap"] = """
    WITH n AS (SELECT DISTINCT issue_id, dimension, article_id, variant_key FROM fx_ii WHERE voice_scope = 'narration'), s AS (SELECT p.*, (SELECT count(*) FROM n a JOIN n b ON b.issue_id = a.issue_id AND b.dimension = a.dimension AND b.article_id = a.article_id WHERE a.issue_id = p.issue_id AND a.dimension = p.dimension AND a.variant_key = p.lv AND b.variant_key = p.rv) AS shared FROM fx_pairs p)
    SELECT *, lc + rc - shared AS uni, shared::DOUBLE / (lc + rc - shared) AS overlap FROM s"""
VIEWS["fx_divergence"] = f"SELECT p.issue_id, p.dimension, lv AS left_variant, rv AS right_variant FROM fx_pairs p JOIN fx_observed o ON o.issue_id = p.issue_id AND o.dimension = p.dimension WHERE len(list_filter(lg, lambda x: NOT list_contains(rg, x))) > 0 AND len(list_filter(rg, lambda x: NOT list_contains(lg, x))) > 0 QUALIFY row_number() OVER (PARTITION BY p.issue_id ORDER BY {DORDER.replace('CASE dimension', 'CASE p.dimension')}, observed DESC, lp, rp) = 1"
VIEWS["fx_common"] = f"SELECT p.issue_id, dimension, variant_key, article_count FROM fx_patterns p JOIN fx_sizes s ON s.issue_id = p.issue_id WHERE voice_scope = 'narration' AND article_count >= greatest(2, ceil(n * 0.6)) QUALIFY row_number() OVER (PARTITION BY p.issue_id ORDER BY {DORDER}, article_count DESC, code) = 1"
COVER = "(2.0::DOUBLE * (lc::DOUBLE / n) * (rc::DOUBLE / n) / ((lc::DOUBLE / n) + (rc::DOUBLE / n)))"
VIEWS["fx_axis"] = f"""
    SELECT o.issue_id, lv AS left_variant, rv AS right_variant, {rnd(COVER, 3)} AS balanced_coverage, {rnd('overlap', 3)} AS overlap, {rnd(COVER + ' * (1.0::DOUBLE - o.overlap)', 3)} AS axis_strength, uni AS covered_articles
    FROM fx_overlap o JOIN fx_sizes s ON s.issue_id = o.issue_id WHERE dimension = 'problem_definition' AND lc >= 2 AND rc >= 2
    QUALIFY row_number() OVER (PARTITION BY o.issue_id ORDER BY {rnd(COVER + ' * (1.0::DOUBLE - o.overlap)', 3)} DESC, least(lc, rc) DESC, uni DESC, lv || ':' || rv) = 1"""


@query("divergence_pair", "SELECT * FROM fx_divergence")
def _(t):
    i, s = both(t)
    return M.divergence_pair(M.axis_patterns(i), M.axis_observation_counts(s))


@query("observed_contrast", f"SELECT issue_id, dimension, lv AS left_variant, rv AS right_variant, {rnd('overlap', 3)} AS overlap FROM fx_overlap WHERE overlap < 0.85::DOUBLE AND len(list_distinct(lg || rg)) >= 2 QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY {DORDER}, lp, rp) = 1")
def _(t):
    i = items(t)
    return M.observed_contrast(M.axis_patterns(i), i)


@query("common_ground", "SELECT * FROM fx_common")
def _(t):
    return M.common_ground(M.axis_patterns(items(t)), t.members)


@query("issue_map_pair", "SELECT * FROM fx_axis")
def _(t):
    i = items(t)
    return M.issue_map_pair(M.axis_patterns(i), i, t.members)


@query("issue_map_outlets", f"""
    WITH b AS (SELECT issue_id, count(DISTINCT article_id) AS a, count(DISTINCT source_id) AS o, count(DISTINCT media_group_id) AS g FROM fx_members GROUP BY 1),
      w AS (SELECT b.issue_id, x.left_variant AS lv, x.right_variant AS rv, CASE WHEN a < 4 THEN 'too_few_articles' WHEN o < 3 THEN 'too_few_outlets' WHEN g < 2 THEN 'too_few_media_groups' WHEN coalesce(d.detected, false) THEN 'source_dominated' WHEN x.left_variant IS NULL THEN 'no_axis' END AS withheld
            FROM b LEFT JOIN fx_axis x ON x.issue_id = b.issue_id LEFT JOIN fx_dominance d ON d.issue_id = b.issue_id),
      v AS (SELECT i.issue_id, i.article_id, bool_or(variant_key = lv) AS l, bool_or(variant_key = rv) AS r FROM fx_ii i JOIN w ON w.issue_id = i.issue_id WHERE voice_scope = 'narration' AND dimension = 'problem_definition' GROUP BY ALL),
      p AS (SELECT m.issue_id, m.source_id, count(*) AS article_count, count(*) FILTER (coalesce(l, false) AND NOT coalesce(r, false)) AS left_articles, count(*) FILTER (coalesce(l, false) AND coalesce(r, false)) AS mixed_articles, count(*) FILTER (coalesce(r, false) AND NOT coalesce(l, false)) AS right_articles
            FROM fx_members m LEFT JOIN v ON v.issue_id = m.issue_id AND v.article_id = m.article_id GROUP BY ALL),
      s AS (SELECT p.*, withheld, left_articles + mixed_articles + right_articles AS n, {rnd('(right_articles - left_articles)::DOUBLE / nullif(left_articles + mixed_articles + right_articles, 0)', 3)} AS sc FROM p JOIN w ON w.issue_id = p.issue_id)
    SELECT issue_id, source_id, article_count, left_articles, mixed_articles, right_articles, withheld, CASE WHEN withheld IS NULL THEN CASE WHEN n < 2 THEN 'insufficient' WHEN sc <= -1.0::DOUBLE / 3 THEN 'left' WHEN sc >= 1.0::DOUBLE / 3 THEN 'right' ELSE 'mixed' END END AS classification,
      CASE WHEN withheld IS NULL THEN sc END AS score, CASE WHEN withheld IS NULL THEN {rnd('50.0::DOUBLE + 40.0::DOUBLE * sc', 1)} END AS display_position FROM s""")
def _(t):
    s = Q.written(t)
    i = items(t, s)
    axis = M.issue_map_pair(M.axis_patterns(i), i, t.members)
    return M.issue_map_outlets(axis, i, t.members, M.source_dominance(i, Q.genres(t, s), t.members))


@query("spectrum", f"""
    WITH f AS (SELECT * FROM fx_view WHERE dimension = 'problem_definition'), r AS (SELECT issue_id, family, row_number() OVER (PARTITION BY issue_id ORDER BY count(*) DESC, family) AS r FROM f GROUP BY issue_id, family),
      p AS (SELECT issue_id, max(family) FILTER (r = 1) AS lf, max(family) FILTER (r = 2) AS rf FROM r GROUP BY 1 HAVING max(family) FILTER (r = 2) IS NOT NULL),
      m AS (SELECT f.issue_id, source_id, lf, rf, count(*) FILTER (family = lf) AS l, count(*) FILTER (family = rf) AS r, bool_or(narrated > 0) AS narrated FROM f JOIN p ON p.issue_id = f.issue_id GROUP BY ALL)
    SELECT issue_id, source_id, lf AS left_family, rf AS right_family, {rnd('r::DOUBLE / (l + r)', 3)} AS position, l + r AS article_count, l > 0 AND r > 0 AS both, narrated FROM m WHERE l + r > 0""")
def _(t):
    return M.spectrum(M.article_view(items(t)))


@query("narrative_compatible", """
    WITH k AS (SELECT issue_id, article_id, """ + ", ".join(f"list_sort(coalesce(list(DISTINCT variant_key) FILTER (dimension = '{d}'), [])) AS d{i}" for i, d in enumerate(DIMENSIONS)) + """ FROM fx_ii WHERE voice_scope = 'narration' GROUP BY ALL),
      s AS (SELECT issue_id, min(article_id) AS f, d0, d1, d2, d3, d4 FROM k GROUP BY ALL), p AS (SELECT a.issue_id, a.f AS src, b.f AS dst, """
    + " + ".join(f"CASE WHEN len(a.d{i}) > 0 AND len(b.d{i}) > 0 AND list_has_any(a.d{i}, b.d{i}) THEN 1 ELSE 0 END" for i in range(1, 5)) + " AS matching, "
    + " + ".join(f"CASE WHEN len(a.d{i}) > 0 AND len(b.d{i}) > 0 AND NOT list_has_any(a.d{i}, b.d{i}) THEN 1 ELSE 0 END" for i in range(1, 5)) + """ AS conflicting
      FROM s a JOIN s b ON b.issue_id = a.issue_id AND a.f > b.f AND list_has_any(a.d0, b.d0))
    SELECT issue_id, src, dst, CAST(matching AS BIGINT) AS matching, CAST(conflicting AS BIGINT) AS conflicting, matching >= 2 AND conflicting = 0 AS compatible FROM p""")
def _(t):
    sig, _ = M.narrative_signatures(items(t))
    sig = cut_lineage(sig)
    name = sig.select("issue_id", "signature_id", "first_article")
    p = M.narrative_compatible(sig)
    p = p.join(name.withColumnsRenamed({"signature_id": "a", "first_article": "src"}), ["issue_id", "a"]).join(name.withColumnsRenamed({"signature_id": "b", "first_article": "dst"}), ["issue_id", "b"])
    return BIG(p.select("issue_id", "src", "dst", "matching", "conflicting", "compatible"), "matching", "conflicting")


VIEWS["fx_issue100"] = "SELECT article_id // 100 AS issue_id, article_id, source_id, media_group_id FROM fx_members"
VIEWS["fx_narrated"] = "SELECT m.issue_id, i.article_id, dimension, variant_key, m.source_id, m.media_group_id FROM fx_items i JOIN fx_issue100 m ON m.article_id = i.article_id WHERE voice_scope = 'narration'"
VIEWS["fx_narrative_members"] = """
    WITH RECURSIVE k AS (SELECT issue_id, article_id, """ + ", ".join(f"list_sort(coalesce(list(DISTINCT variant_key) FILTER (dimension = '{d}'), [])) AS d{i}" for i, d in enumerate(DIMENSIONS)) + """ FROM fx_narrated GROUP BY ALL),
      s AS (SELECT issue_id, min(article_id) AS f, count(*) AS w, d0, d1, d2, d3, d4 FROM k GROUP BY ALL),
      p AS (SELECT a.issue_id, a.f AS src, b.f AS dst FROM s a JOIN s b ON b.issue_id = a.issue_id AND a.f > b.f AND list_has_any(a.d0, b.d0) WHERE """ + " + ".join(
    f"CASE WHEN list_has_any(a.d{i}, b.d{i}) THEN 1 ELSE 0 END" for i in range(1, 5)) + " >= 2 AND " + " AND ".join(f"(len(a.d{i}) = 0 OR len(b.d{i}) = 0 OR list_has_any(a.d{i}, b.d{i}))" for i in range(1, 5)) + """),
      e AS MATERIALIZED (SELECT issue_id, src AS u, dst AS v FROM p UNION ALL SELECT issue_id, dst, src FROM p),
      n AS MATERIALIZED (SELECT issue_id, f AS u, w, row_number() OVER (PARTITION BY issue_id ORDER BY f) AS i FROM s),
      grow AS (
        SELECT issue_id, 0::BIGINT AS i, []::STRUCT(u BIGINT, c BIGINT)[] AS placed FROM n GROUP BY issue_id
        UNION ALL (
        WITH now AS (SELECT g.issue_id, g.i, g.placed, n.u FROM grow g JOIN n ON n.issue_id = g.issue_id AND n.i = g.i + 1), m AS (SELECT issue_id, p.u AS v, p.c AS c FROM (SELECT issue_id, unnest(placed) AS p FROM grow)),
          fits AS (SELECT m.issue_id, m.c, sum(n.w) AS w FROM m JOIN now ON now.issue_id = m.issue_id JOIN n ON n.issue_id = m.issue_id AND n.u = m.v LEFT JOIN e ON e.issue_id = m.issue_id AND e.u = now.u AND e.v = m.v GROUP BY ALL HAVING count(e.v) = count(*)),
          best AS (SELECT issue_id, c FROM fits QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY w DESC, c) = 1)
        SELECT now.issue_id, now.i + 1, list_append(now.placed, {'u': now.u, 'c': coalesce(best.c, now.u)}) FROM now LEFT JOIN best ON best.issue_id = now.issue_id)),
      ended AS (SELECT issue_id, p.u AS u, p.c AS c FROM (SELECT issue_id, unnest(placed) AS p FROM grow QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY i DESC) = 1))
    SELECT k.issue_id, k.article_id, ended.c AS group_no FROM k JOIN s ON s.issue_id = k.issue_id AND s.d0 = k.d0 AND s.d1 = k.d1 AND s.d2 = k.d2 AND s.d3 = k.d3 AND s.d4 = k.d4 JOIN ended ON ended.issue_id = s.issue_id AND ended.u = s.f"""
VIEWS["fx_narratives"] = f"""
    WITH j AS (SELECT DISTINCT t.issue_id, r.group_no, t.article_id, t.dimension, t.variant_key FROM fx_narrated t JOIN fx_narrative_members r ON r.issue_id = t.issue_id AND r.article_id = t.article_id),
      o AS (SELECT issue_id, group_no, dimension, count(DISTINCT article_id) AS seen FROM j GROUP BY ALL), p AS (SELECT issue_id, group_no, dimension, variant_key, count(DISTINCT article_id) AS n FROM j GROUP BY ALL),
      q AS (SELECT *, row_number() OVER w AS r, lead(n) OVER w AS second FROM p WINDOW w AS (PARTITION BY issue_id, group_no, dimension ORDER BY n DESC, variant_key)),
      c AS (SELECT q.issue_id, q.group_no, q.dimension, variant_key FROM q JOIN o ON o.issue_id = q.issue_id AND o.group_no = q.group_no AND o.dimension = q.dimension WHERE r = 1 AND n >= 2 AND coalesce(second, 0) < n AND n::DOUBLE / seen >= 0.6::DOUBLE),
      w AS (SELECT issue_id, group_no, {', '.join(f"max(variant_key) FILTER (dimension = '{d}') AS {d}" for d in DIMENSIONS)}, count(*) FILTER (dimension <> '{DIMENSIONS[0]}') AS others FROM c GROUP BY ALL),
      z AS (SELECT r.issue_id, group_no, count(*) AS article_count, count(DISTINCT source_id) AS outlet_count, count(DISTINCT media_group_id) AS group_count, min(r.article_id) AS first_article FROM fx_narrative_members r JOIN fx_issue100 m ON m.issue_id = r.issue_id AND m.article_id = r.article_id GROUP BY ALL)
    SELECT w.issue_id, {', '.join(DIMENSIONS)}, (others + 1) / 5.0::DOUBLE AS completeness, article_count, outlet_count, group_count, first_article,
      row_number() OVER (PARTITION BY w.issue_id ORDER BY article_count DESC, outlet_count DESC, others DESC, group_count DESC, first_article) AS narrative_no
    FROM w JOIN z ON z.issue_id = w.issue_id AND z.group_no = w.group_no WHERE {DIMENSIONS[0]} IS NOT NULL AND others >= 2 AND article_count >= 2 QUALIFY narrative_no <= 2"""


@query("narratives", f"SELECT issue_id, {', '.join(DIMENSIONS)}, completeness, article_count, outlet_count, group_count, first_article, narrative_no FROM fx_narratives")
def _(t):
    m = t.members.withColumn("issue_id", F.expr("article_id div 100"))
    return BIG(M.narratives(M.with_issue(raw_items(t), m), m), "narrative_no")


def of_hundreds(name):
    """Name of the view that is ``name`` with a hundred neighbouring articles as an issue, in it and in all views below it."""
    def depends(view):
        return view == "fx_members" or any(depends(v) for v in set(re.findall(r"\bfx_\w+", VIEWS[view])))

    VIEWS["fx_members_h"] = "SELECT * REPLACE (article_id // 100 AS issue_id) FROM fx_members"
    if name != "fx_members" and f"{name}_h" not in VIEWS:
        VIEWS[f"{name}_h"] = re.sub(r"\bfx_\w+", lambda m: of_hundreds(m[0]) if depends(m[0]) else m[0], VIEWS[name])
    return f"{name}_h"


@query("reader_questions", f"""
    WITH n AS (SELECT a.issue_id FROM fx_narratives a JOIN fx_narratives b ON b.issue_id = a.issue_id AND a.narrative_no = 1 AND b.narrative_no = 2 WHERE {' + '.join(f"CASE WHEN a.{d} <> b.{d} THEN 1 ELSE 0 END" for d in DIMENSIONS)} >= 2),
      g AS (SELECT issue_id, role FROM {of_hundreds('fx_lens')} WHERE presence_gap >= 0.5::DOUBLE QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY CAST(role = 'affected_person' AS INTEGER) DESC, presence_gap DESC, article_count DESC, role) = 1),
      c AS (SELECT issue_id, dimension FROM {of_hundreds('fx_is')} GROUP BY ALL HAVING count(DISTINCT source_id) FILTER (status <> 'not_observed') >= 2 AND count(DISTINCT source_id) FILTER (status = 'not_observed') >= 1 AND count(*) FILTER (status = 'observed') >= 1),
      q AS (SELECT issue_id, 0 AS priority, 'narrative-contrast' AS question_id FROM n UNION ALL SELECT issue_id, 1, 'problem-definition-contrast' FROM {of_hundreds('fx_axis')}
            UNION ALL SELECT issue_id, CASE WHEN role = 'affected_person' THEN 2 ELSE 3 END, 'source-gap-' || role FROM g UNION ALL SELECT issue_id, 3 + {DORDER}, 'context-gap-' || dimension FROM c)
    SELECT issue_id, CAST(priority AS BIGINT) AS priority, question_id, row_number() OVER (PARTITION BY issue_id ORDER BY priority, question_id) AS position FROM q QUALIFY position <= 3""")
def _(t):
    sentences = Q.written(t)
    raw = raw_items(t, sentences)
    m = t.members.withColumn("issue_id", F.expr("article_id div 100"))
    i, s = M.with_issue(raw, m), M.with_issue(P.dimension_status(t.articles, raw), m)
    axis = M.issue_map_pair(M.axis_patterns(i), i, m)
    return BIG(M.reader_questions(M.narratives(i, m), axis, M.source_role_lens(M.with_issue(cut_lineage(Q.mentions(t, sentences)), m), m), s), "priority", "position")


@query("camps", """
    WITH f AS (SELECT issue_id, source_id, article_id, max(family) FILTER (dimension = 'problem_definition') AS p, max(family) FILTER (dimension = 'treatment_recommendation') AS t FROM fx_view GROUP BY ALL),
      c AS (SELECT *, CASE WHEN t IS NULL THEN 'no_treatment' ELSE t END AS camp FROM f)
    SELECT issue_id, camp, count(*) AS articles, count(DISTINCT source_id) AS outlets, min(article_id) AS lead_article, row_number() OVER (PARTITION BY issue_id ORDER BY count(*) DESC, camp) AS position FROM c GROUP BY issue_id, camp QUALIFY position <= 4""")
def _(t):
    return BIG(M.camps(M.article_view(items(t)), t.members), "position")


@query("camp_key", """
    WITH f AS (SELECT issue_id, article_id, max(family) FILTER (dimension = 'problem_definition') AS p, max(family) FILTER (dimension = 'treatment_recommendation') AS t FROM fx_view GROUP BY ALL)
    SELECT issue_id, article_id, CASE WHEN p = 'p_that' AND article_id % 2 = 0 THEN 'legal_institutional' WHEN t IS NULL THEN 'no_treatment' WHEN t = 't_los' THEN 'institutional_check' ELSE t END AS camp FROM f""")
def _(t):
    v = M.article_view(items(t)).groupBy("issue_id", "article_id").agg(
        F.max(F.when(F.col("dimension") == "problem_definition", F.col("family"))).alias("p"), F.max(F.when(F.col("dimension") == "treatment_recommendation", F.col("family"))).alias("t"))
    problem = F.expr("case when p = 'p_that' and article_id % 2 = 0 then 'legal_institutional' else p end")
    treatment = F.expr("case when t = 't_los' then 'institutional_check' else t end")
    return v.select("issue_id", "article_id", M.camp_key(problem, treatment).alias("camp"))


@query("agreement_lines", "SELECT issue_id, dimension, count(DISTINCT family) AS families, count(*) AS articles, CASE WHEN count(DISTINCT family) = 1 THEN 'fact' ELSE 'split' END AS line, CASE WHEN count(DISTINCT family) = 1 THEN min(family) END AS family FROM fx_view GROUP BY ALL")
def _(t):
    return M.agreement_lines(M.article_view(items(t)))


@query("bound_claims", r"""
    WITH c AS (SELECT DISTINCT claim_id, article_id, paragraph, sentence, sentence_sha256 FROM fx_items), x AS (SELECT claim_id, article_id, trim(regexp_replace(title, '\s+', ' ', 'g'), ' ') AS t FROM fx_items i JOIN fx_articles a USING (article_id)),
      e AS (SELECT claim_id, count(*) AS n FROM c WHERE sentence % 2 = 1 GROUP BY 1)
    SELECT DISTINCT x.claim_id, coalesce(n, 0) AS evidence, CASE WHEN contains(t, 'ther') THEN 'review_needed' WHEN n IS NULL THEN 'insufficient_evidence' ELSE 'observed' END AS status, CASE WHEN NOT contains(t, 'ther') AND n IS NOT NULL THEN left(t, 280) END AS text FROM x LEFT JOIN e ON e.claim_id = x.claim_id""")
def _(t):
    i = raw_items(t)
    cited = i.select("claim_id", "article_id", "paragraph", "sentence", "sentence_sha256")  # binding drops repeats
    claims = i.select("claim_id", "article_id").distinct().join(t.articles.select("article_id", F.col("title").alias("text")), "article_id").select("claim_id", "text")
    return M.bound_claims(claims, cited, cited.filter("sentence % 2 = 1"), ("ther",))


@query("comparison_withheld", """
    WITH d AS (SELECT issue_id, set_digest AS g FROM fx_url_sets), q AS (SELECT issue_id, CASE WHEN issue_id % 2 = 0 THEN 'review_required' ELSE 'cohesive' END AS cluster_quality, issue_id % 3 = 0 AS ok FROM d)
    SELECT issue_id, cluster_quality, cluster_quality = 'review_required' AND NOT ok AS withheld, CASE WHEN ok THEN 'approved_same_event' WHEN cluster_quality <> 'review_required' THEN 'automatic_cohesive' END AS cluster_status FROM q""")
def _(t):
    from pressgrain.operators.sets import url_set_signature
    from pressgrain.plans.q_windows import reviewed

    sig = url_set_signature(reviewed(t), minimum=1)
    issues = t.members.select("issue_id").distinct().withColumn("cluster_quality", F.expr("case when issue_id % 2 = 0 then 'review_required' else 'cohesive' end"))
    return M.comparison_withheld(issues, sig, sig.filter("issue_id % 3 = 0"))


@query("comparison_summary", """
    WITH b AS (SELECT issue_id, count(DISTINCT article_id) AS articles, count(DISTINCT source_id) AS outlets FROM fx_members GROUP BY 1)
    SELECT b.*, d.dimension AS divergence_dimension, c.variant_key AS common_variant, s.attributed_share, s.detected AS source_dominated, x.axis_strength FROM b LEFT JOIN fx_divergence d ON d.issue_id = b.issue_id LEFT JOIN fx_common c ON c.issue_id = b.issue_id
      LEFT JOIN fx_dominance s ON s.issue_id = b.issue_id LEFT JOIN fx_axis x ON x.issue_id = b.issue_id""")
def _(t):
    sentences = Q.written(t)
    i, s = both(t, sentences)
    p = M.axis_patterns(i)
    return M.comparison_summary(t.members, M.divergence_pair(p, M.axis_observation_counts(s)), M.common_ground(p, t.members), M.source_dominance(i, Q.genres(t, sentences), t.members), M.issue_map_pair(p, i, t.members))
