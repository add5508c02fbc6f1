"""Frame profiles over the given documents, with rules over words that occur in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrain.functions import columns as C
from pressgrain.lexicons.frames import DIMENSIONS
from pressgrain.operators import framing as P, textops as T
from pressgrain.plans.fixtures import VIEWS
from pressgrain.plans.registry import query
from pressgrain.session import cut_lineage

RULES = (
    ("problem_definition", "p_the", "the and.{0,10}(?:in|on)"),
    ("problem_definition", "p_that", "that .{0,24}(?:with|from)"),
    ("causal_interpretation", "c_this", "this [a-z]{2,4} "),
    ("causal_interpretation", "c_que", "que .{0,20}(?:les|des)"),
    ("responsibility_attribution", "r_ther", "th(?:er|or)[a-z]* "),
    ("moral_evaluation", "m_ein", "(?:eine|einer) "),
    ("moral_evaluation", "m_for", "for [a-z]+ing"),
    ("treatment_recommendation", "t_los", "(?:los|las) "),
    ("treatment_recommendation", "t_was", "was [a-z]+ed"),
)
SPEAKER = "([A-Z][a-z]{2,12}) (?:the|of|and|de|la|der) "
REPORTING = "[a-z]tion |[a-z]ing "
ATTRIBUTION = "Leau|Eron"
ROLES = (("anonymous_official", "^[A-C]"), ("government_official", "^[D-H]"), ("expert_research", "^[I-N]"), ("affected_person", "^[O-S]"))
GENERIC = (("conflict", "thor|ther"), ("human", "hein|then"), ("none", "zzzz"))
POLICY = (("economic", ("thre", "thth", "thnt", "inon"), "onandti"), ("legal", ("eron", "erin", "anea"), "zzz"), ("other", (), "edon"))
SIGNALS = (("history", "then "), ("statistics", "[0-9]"), ("law", "und "), ("compare", "with "), ("cause", "for "), ("counter", "but |non"))
DEVICES = (("statistics", "[0-9]"), ("contrast", "with "), ("example", "thha|elle"))
CONCEPTS = (("a", "that"), ("b", "with"), ("c", "que"), ("d", "this"))
GENRES = (("editorial", "^Is "), ("opinion", "^On"), ("interview", "Reti"), ("fact_check", "^To "), ("analysis_explainer", "tion$|[0-9]"))
LEAD = "[Ii]n [a-z]+ing of"
NEGATIVE, POSITIVE = ("m_ein",), ("m_for",)

VIEWS["fx_fsent"] = "SELECT article_id, paragraph, sentence, replace(text, ' the ', ' “the and” ') AS text FROM fx_sentences"
VIEWS["fx_hits"] = " UNION ALL ".join(
    f"SELECT article_id, paragraph, sentence, text, {i} AS rule_no, '{d}' AS dimension, '{c}' AS code, instr(text, regexp_extract(text, '{p}')) - 1 AS match_at FROM fx_fsent WHERE regexp_matches(text, '{p}')"
    for i, (d, c, p) in enumerate(RULES))
ROLE_SQL = "CASE WHEN {0} IS NULL THEN 'other' " + " ".join(f"WHEN regexp_matches({{0}}, '{p}') THEN '{c}'" for c, p in ROLES) + " ELSE 'other' END"
VIEWS["fx_voiced"] = f"""
    WITH s AS (SELECT *, CASE WHEN regexp_matches(text, '{SPEAKER}') THEN regexp_extract(text, '{SPEAKER}', 1) END AS sp,
        regexp_matches(regexp_replace(substr(text, 1, match_at), '["“‘][^"”’]{{2,}}["”’]', '', 'g') || chr(1) || substr(text, match_at + 1), '["“‘][^"”’]*' || chr(1) || '[^"”’]*["”’]') AS quoted FROM fx_hits),
      v AS (SELECT *, CASE WHEN quoted THEN CASE WHEN sp IS NOT NULL THEN 'direct_quote' ELSE 'uncertain_quote' END
        WHEN (regexp_matches(text, '{REPORTING}') OR regexp_matches(text, '{ATTRIBUTION}')) AND sp IS NOT NULL THEN 'indirect_source' ELSE 'journalist_narration' END AS voice_kind FROM s)
    SELECT * EXCLUDE (sp, quoted), CASE WHEN voice_kind <> 'journalist_narration' THEN sp END AS speaker, CASE WHEN voice_kind <> 'journalist_narration' THEN {ROLE_SQL.format('sp')} END AS speaker_role,
      CASE WHEN voice_kind = 'journalist_narration' THEN 'narration' ELSE 'source' END AS voice_scope FROM v"""
VIEWS["fx_items"] = """
    SELECT article_id, dimension, code, 'rules:' || dimension || ':' || code AS variant_key, voice_kind, voice_scope, speaker, speaker_role, paragraph, sentence, rule_no, sha256('evidence:v1:' || article_id || ':' || text) AS sentence_sha256,
      sha256('claim:v1:' || article_id || ':' || dimension || ':rules:' || dimension || ':' || code || ':' || voice_kind) AS claim_id
    FROM fx_voiced QUALIFY row_number() OVER (PARTITION BY article_id, dimension, code, voice_scope ORDER BY paragraph, sentence, rule_no) = 1"""
VIEWS["fx_status"] = f"""
    SELECT a.article_id, d.dimension, CASE WHEN i.n IS NULL THEN 'not_observed' WHEN i.n > 0 THEN 'observed' ELSE 'source_attributed' END AS status
    FROM fx_articles a CROSS JOIN (SELECT unnest({list(DIMENSIONS)}) AS dimension) d LEFT JOIN (SELECT article_id, dimension, count(*) FILTER (voice_scope = 'narration') AS n FROM fx_items GROUP BY ALL) i ON i.article_id = a.article_id AND i.dimension = d.dimension"""
VIEWS["fx_mentions"] = f"""
    WITH s AS (SELECT *, CASE WHEN regexp_matches(text, '{SPEAKER}') THEN regexp_extract(text, '{SPEAKER}', 1) END AS name, regexp_matches(text, '["“‘][^"”’]{{2,}}["”’]') AS q FROM fx_fsent WHERE regexp_matches(text, '{REPORTING}') OR regexp_matches(text, '{ATTRIBUTION}'))
    SELECT article_id, name, {ROLE_SQL.format('name')} AS role, count(*) FILTER (q) AS direct_quote_count, count(*) FILTER (NOT q) AS indirect_attribution_count,
      array_to_string(list_sort(list({{'p': paragraph, 's': sentence}}))[1:5].list_transform(lambda x: x.p || ':' || x.s), ' ') AS locators FROM s WHERE name IS NOT NULL GROUP BY article_id, name, role"""
VIEWS["fx_lemmas"] = "SELECT article_id, paragraph, sentence, list_distinct(list(lemma)) AS lemmas FROM fx_fmorph WHERE pos IN ('noun', 'predicate', 'foreign') AND length(lemma) BETWEEN 2 AND 20 GROUP BY ALL"
UNITS = r"regexp_extract_all(lower(regexp_replace(text, 'https?://\S+|www\.\S+|[\w.+-]+@[\w.-]+\.[a-z]{2,}', ' ', 'g')), '[가-힣]+|[a-z]+(?:[.-][a-z]+)*|[0-9]+(?:[.,][0-9]+)*')"
VIEWS["fx_fmorph"] = f"SELECT article_id, paragraph, sentence, lemma, CASE WHEN regexp_matches(lemma, '^[0-9]') THEN 'number' ELSE 'foreign' END AS pos FROM (SELECT article_id, paragraph, sentence, unnest({UNITS}) AS lemma FROM fx_fsent)"


def _desc(kind, code, test):
    return f"SELECT s.article_id, '{kind}' AS kind, '{code}' AS code FROM fx_fsent s LEFT JOIN fx_lemmas l ON l.article_id = s.article_id AND l.paragraph = s.paragraph AND l.sentence = s.sentence WHERE {test}"


VIEWS["fx_descriptors"] = "WITH m AS (" + " UNION ALL ".join(
    [_desc("generic", c, f"regexp_matches(text, '{p}')") for c, p in GENERIC]
    + [_desc("policy", c, f"regexp_matches(text, '{p}')" + (f" OR len(list_intersect(coalesce(lemmas, []), {list(ts)})) >= 2" if ts else "")) for c, ts, p in POLICY]) + """)
    SELECT m.article_id, kind, code, count(*) AS sentence_count, floor(count(*)::DOUBLE / any_value(t.n)::DOUBLE * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS share_of_sentences
    FROM m JOIN (SELECT article_id, count(*) AS n FROM fx_fsent GROUP BY 1) t ON t.article_id = m.article_id GROUP BY m.article_id, kind, code"""


def marked(plain):
    return plain.withColumn("text", F.replace("text", F.lit(" the "), F.lit(" “the and” ")))


def sentences(t):
    return marked(T.segment_sentences(t.articles))


def written(t):
    """Sentences that are read several times."""
    return cut_lineage(sentences(t))


def speaker(text):
    return P.speaker_extract(text, (), SPEAKER, "zzzzzzz", (), clean=False)


def voiced(t, s=None):
    return P.voiced_matches(s or sentences(t), RULES, speaker, REPORTING, ATTRIBUTION, ROLES)


def items(t, s=None):
    return P.frame_items(voiced(t, s))


def mentions(t, s=None):
    return P.source_mentions(s or sentences(t), speaker, REPORTING, ATTRIBUTION, ROLES)


def descriptors(t, s=None):
    return P.descriptor_signals(s or sentences(t), GENERIC, POLICY)


BIG = lambda df, *cols: df.withColumns({c: F.col(c).cast("bigint") for c in cols})


@query("rule_matches", "SELECT article_id, paragraph, sentence, dimension, code, CAST(match_at AS BIGINT) AS match_at FROM fx_hits")
def _(t):
    return BIG(P.rule_matches(sentences(t), RULES).drop("text", "rule_no"), "match_at")


@query("speaker_extract", f"SELECT article_id, paragraph, sentence, CASE WHEN regexp_matches(text, '{SPEAKER}') THEN regexp_extract(text, '{SPEAKER}', 1) END AS speaker FROM fx_fsent")
def _(t):
    return sentences(t).select("article_id", "paragraph", "sentence", speaker(F.col("text")).alias("speaker"))


@query("source_role", f"WITH s AS (SELECT article_id, paragraph, sentence, CASE WHEN regexp_matches(text, '{SPEAKER}') THEN regexp_extract(text, '{SPEAKER}', 1) END AS sp FROM fx_fsent) SELECT article_id, paragraph, sentence, {ROLE_SQL.format('sp')} AS role FROM s")
def _(t):
    return sentences(t).select("article_id", "paragraph", "sentence", P.source_role(speaker(F.col("text")), ROLES).alias("role"))


@query("voice_class", "SELECT article_id, paragraph, sentence, code, voice_kind, speaker_role FROM fx_voiced")
def _(t):
    return voiced(t).select("article_id", "paragraph", "sentence", "code", "voice_kind", "speaker_role")


@query("frame_items", "SELECT article_id, dimension, code, variant_key, voice_kind, speaker_role, paragraph, sentence, sentence_sha256, claim_id FROM fx_items")
def _(t):
    return items(t).select("article_id", "dimension", "code", "variant_key", "voice_kind", "speaker_role", "paragraph", "sentence", "sentence_sha256", "claim_id")


@query("dimension_status", "SELECT * FROM fx_status")
def _(t):
    return P.dimension_status(t.articles, items(t))


@query("source_mentions", "SELECT * FROM fx_mentions")
def _(t):
    return mentions(t).withColumn("locators", F.array_join(F.transform("locators", lambda x: F.concat(x["paragraph"], F.lit(":"), x["sentence"])), " "))


@query("descriptor_signals", "SELECT * FROM fx_descriptors")
def _(t):
    return descriptors(t)


def _counts(rules):
    return ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS {c}" for c, p in rules)


@query("context_depth", f"""
    WITH c AS (SELECT article_id, {_counts(SIGNALS)} FROM fx_fsent GROUP BY 1), s AS (SELECT *, least(100, {' + '.join(f'least(3, {c}) * 8' for c, _ in SIGNALS)}) AS score FROM c)
    SELECT *, CASE WHEN score >= 55 THEN 'deep' WHEN score >= 25 THEN 'moderate' ELSE 'shallow' END AS level FROM s""")
def _(t):
    return P.context_depth(sentences(t), SIGNALS)


VIEWS["fx_scope"] = f"""
    WITH c AS (SELECT article_id, {_counts((("episodic", "thor"), ("thematic", "then ")))} FROM fx_fsent GROUP BY 1)
    SELECT *, CASE WHEN episodic > 0 AND thematic > 0 THEN CASE WHEN episodic >= 2 * thematic THEN 'episodic' WHEN 2 * episodic <= thematic THEN 'thematic' ELSE 'mixed' END WHEN episodic > 0 THEN 'episodic' WHEN thematic > 0 THEN 'thematic' ELSE 'not_observed' END AS scope FROM c"""


def scopes(t):
    return P.scope_profile(sentences(t), "thor", "then ")


@query("scope_profile", "SELECT * FROM fx_scope")
def _(t):
    return scopes(t)


VIEWS["fx_genre"] = rf"""
    WITH l AS (SELECT article_id, string_agg(text, ' ' ORDER BY paragraph, sentence) AS lead FROM (SELECT * FROM fx_fsent QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY paragraph, sentence) <= 3) GROUP BY 1),
      h AS (SELECT article_id, regexp_replace(regexp_replace(regexp_replace(title, '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS h FROM fx_articles)
    SELECT h.article_id, CASE WHEN regexp_matches(h, '^Is ') THEN 'editorial' WHEN regexp_matches(h, '^On') THEN 'opinion' WHEN regexp_matches(h, 'Reti') OR coalesce(regexp_matches(lead, '{LEAD}'), false) THEN 'interview'
      WHEN regexp_matches(h, '^To ') THEN 'fact_check' WHEN regexp_matches(h, 'tion$|[0-9]') THEN 'analysis_explainer' ELSE 'straight_news' END AS genre FROM h LEFT JOIN l ON l.article_id = h.article_id"""


def genres(t, s=None):
    return P.genre(t.articles, s or sentences(t), GENRES, LEAD)


@query("genre", "SELECT * FROM fx_genre")
def _(t):
    return genres(t)


@query("framing_devices", f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY paragraph, sentence) AS i FROM fx_fsent)
    {' UNION ALL '.join(f"SELECT article_id, '{c}' AS device, count(*) AS n, bool_or(i <= 2) AS appears_in_lead FROM r WHERE regexp_matches(text, '{p}') GROUP BY 1" for c, p in DEVICES)}
    UNION ALL SELECT article_id, 'evaluative_headline', 1, true FROM fx_articles WHERE regexp_matches(title, 'thor|rett') AND article_id IN (SELECT article_id FROM fx_fsent)""")
def _(t):
    return P.framing_devices(t.articles, sentences(t), DEVICES, "thor|rett")


@query("association_pairs", "WITH c AS (" + " UNION ALL ".join(
    f"SELECT article_id, '{a}' AS a, '{b}' AS b FROM fx_fsent WHERE regexp_matches(text, '{pa}') AND regexp_matches(text, '{pb}')" for i, (a, pa) in enumerate(CONCEPTS) for b, pb in CONCEPTS[i + 1:])
    + ") SELECT article_id, a, b, count(*) AS sentence_count, row_number() OVER (PARTITION BY article_id ORDER BY count(*) DESC, a || ':' || b) AS position FROM c GROUP BY article_id, a, b QUALIFY position <= 12")
def _(t):
    return BIG(P.association_pairs(sentences(t), CONCEPTS), "position")


@query("profile_violations", """
    WITH i AS (SELECT article_id, dimension, voice_kind, CASE WHEN article_id % 40 = 0 THEN 'short' ELSE sentence_sha256 END AS h, CASE WHEN article_id % 41 = 0 THEN 0 ELSE paragraph END AS p, CASE WHEN article_id % 43 = 0 THEN 'robot' ELSE voice_kind END AS v,
        CASE WHEN article_id % 47 = 0 THEN 'Bad Family' ELSE code END AS f FROM fx_items),
      n AS (SELECT article_id, dimension, count(*) FILTER (v = 'journalist_narration') AS n FROM i GROUP BY ALL)
    SELECT article_id, 'bad_hash' AS violation FROM i WHERE NOT regexp_matches(h, '^[0-9a-f]{64}$') UNION ALL SELECT article_id, 'bad_locator' FROM i WHERE p < 1 UNION ALL SELECT article_id, 'bad_voice' FROM i WHERE v = 'robot'
    UNION ALL SELECT article_id, 'bad_family' FROM i WHERE f = 'Bad Family'
    UNION ALL SELECT s.article_id, 'bad_status' FROM fx_status s LEFT JOIN n ON n.article_id = s.article_id AND n.dimension = s.dimension WHERE s.status <> CASE WHEN n.n IS NULL THEN 'not_observed' WHEN n.n > 0 THEN 'observed' ELSE 'source_attributed' END""")
def _(t):
    good = cut_lineage(items(t))
    broken = good.withColumns({
        "sentence_sha256": F.expr("case when article_id % 40 = 0 then 'short' else sentence_sha256 end"), "paragraph": F.expr("case when article_id % 41 = 0 then 0 else paragraph end"),
        "voice_kind": F.expr("case when article_id % 43 = 0 then 'robot' else voice_kind end"), "frame_family": F.expr("case when article_id % 47 = 0 then 'Bad Family' else code end")})
    return P.profile_violations(broken, P.dimension_status(t.articles, good))


@query("public_evidence", """
    SELECT DISTINCT article_id, paragraph, sentence, sentence_sha256 FROM fx_items UNION SELECT DISTINCT article_id, paragraph, sentence, sha256('evidence:v1:' || article_id || ':' || text) FROM fx_fsent WHERE regexp_matches(text, 'thor|ther')""")
def _(t):
    s = written(t)
    other = T.with_fingerprint(s.filter(F.col("text").rlike("thor|ther")))
    return P.public_evidence(items(t, s), other)


@query("evidence_bind", """
    SELECT DISTINCT i.article_id, i.paragraph, i.sentence, i.sentence_sha256 FROM fx_items i JOIN (SELECT DISTINCT article_id, paragraph, sentence, sha256('evidence:v1:' || article_id || ':' || text) AS h FROM fx_fsent) s
      ON s.article_id = i.article_id AND s.paragraph = i.paragraph AND s.sentence = i.sentence AND s.h = i.sentence_sha256 WHERE i.sentence % 3 <> 0""")
def _(t):
    from pressgrain.operators.joins import evidence_bind

    # every third citation names another text than the one at its place
    s = written(t)
    cited = items(t, s).select("article_id", "paragraph", "sentence", F.when(F.col("sentence") % 3 == 0, F.sha2("sentence_sha256", 256)).otherwise(F.col("sentence_sha256")).alias("sentence_sha256"))
    return evidence_bind(cited, T.with_fingerprint(s), t.articles)


@query("actor_paraphrase_join", "SELECT DISTINCT v.article_id, v.paragraph, v.sentence, v.speaker, i.code FROM (SELECT DISTINCT article_id, paragraph, sentence, speaker FROM fx_voiced WHERE speaker IS NOT NULL) v JOIN fx_items i ON i.article_id = v.article_id AND i.paragraph = v.paragraph AND i.sentence = v.sentence")
def _(t):
    from pressgrain.operators.joins import actor_paraphrase_join

    v = voiced(t)
    who = v.filter("speaker is not null").select("article_id", "paragraph", "sentence", "speaker").distinct()
    return actor_paraphrase_join(who, P.frame_items(v).select("article_id", "paragraph", "sentence", "code")).distinct()


@query("public_profile", """
    WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS claim_id, doc_id AS article_id, 'problem_definition' AS dimension, 'family_' || lang AS frame_family, n_chars // 2 AS s, n_chars // 2 + doc_id % 30 AS e FROM documents)
    SELECT claim_id, r.article_id, dimension, frame_family, paragraph, sentence, sha256('evidence:v2:' || r.article_id || ':' || paragraph || ':' || sentence || ':' || q.text) AS sentence_sha256
    FROM r JOIN fx_qsent q ON q.article_id = r.article_id AND q.start <= r.s AND q."end" >= r.e AND q."end" > r.s""")
def _(t):
    results = t.raw("documents").selectExpr("cast(doc_id as string) as claim_id", "doc_id as article_id", "'problem_definition' as dimension", "concat('family_', lang) as frame_family",
                                            "cast(n_chars div 2 as bigint) as start", "cast(n_chars div 2 + doc_id % 30 as bigint) as end")
    return P.public_profile(results, T.segment_sentences_quoted(t.articles))


@query("profile_audit", """
    SELECT count(DISTINCT article_id) AS profiles, count(*) FILTER (status = 'observed') AS observed_dimensions, (SELECT count(*) FROM fx_items) AS items, (SELECT count(DISTINCT article_id) FROM fx_mentions) AS profiles_with_sources,
      (SELECT count(DISTINCT article_id) FROM fx_descriptors) AS profiles_with_descriptors, (SELECT count(DISTINCT article_id) FROM fx_terms) AS profiles_with_terms, CAST(0 AS BIGINT) AS invalid_evidence FROM fx_status""")
def _(t):
    plain = cut_lineage(T.segment_sentences(t.articles))
    s = marked(plain)
    i = cut_lineage(items(t, s))
    # articles with terms are those with a content token; nothing is counted by term
    return P.profile_audit(P.dimension_status(t.articles, i), i, mentions(t, s), descriptors(t, s), T.with_content(plain))
