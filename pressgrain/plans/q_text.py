"""Text features over the given documents, whole texts only."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrain.functions import columns as C, text as X
from pressgrain.operators import textops as T, windows as W
from pressgrain.plans.fixtures import VIEWS
from pressgrain.plans.registry import query

STOP = ("that", "with", "this", "from", "the", "and", "que", "les", "der", "die", "und", "las", "los")
ACTION_WORDS = (("move", ("ation", "tion")), ("thing", ("ther", "thing")), ("stay", ("sta", "stea")), ("rare", ("enher",)))
CONCEPT_RULES = (("pair", ("th", "er")), ("onset", ("^On",)), ("digit", ("[0-9]",)))
FRAMES = (("motion", ("ation", "motion")), ("owner", ("owner", "thble")), ("line", ("erly",)), ("none", ("zzzz",)))
ACTOR = r"([A-Z][a-z]{1,9})\s+(?:the|of|and|de|la)"

NORM = "text"
for _p, _r in ((r"\r\n?", "\n"), (r"(?is)<script\b[^>]*>.*?</script>", " "), (r"(?is)<style\b[^>]*>.*?</style>", " "), (r"<[^>]+>", " "),
               (r"[\x{200B}-\x{200D}\x{FEFF}]", ""), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
    _rr = {"\n": "chr(10)", "\n\n": "chr(10) || chr(10)"}.get(_r, f"'{_r}'")
    NORM = f"regexp_replace({NORM}, '{_p}', {_rr}, 'g')"

VIEWS["fx_norm"] = f"SELECT doc_id AS article_id, {NORM} AS x FROM documents"
VIEWS["fx_sentences"] = r"""
    WITH b AS (SELECT article_id, x, list_filter(string_split_regex(x, '\n{2,}'), lambda p: p <> '') AS blocks, list_filter(string_split_regex(x, '\n+'), lambda p: p <> '') AS lines FROM fx_norm),
      p AS (SELECT article_id, CASE WHEN len(blocks) = 1 AND contains(x, chr(10)) THEN lines ELSE blocks END AS ps FROM b),
      q AS (SELECT article_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS paragraph FROM p),
      s AS (SELECT article_id, paragraph, p, list_filter(list_transform(regexp_extract_all(p, '[^.!?。！？]+(?:[.!?。！？]+["”’]?)?'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 2) AS ss FROM q),
      f AS (SELECT article_id, paragraph, CASE WHEN len(ss) > 0 THEN ss ELSE [p] END AS ss FROM s)
    SELECT article_id, paragraph, generate_subscripts(ss, 1) AS sentence, unnest(ss) AS text FROM f"""
VIEWS["fx_words"] = f"""
    SELECT article_id, w AS token FROM (SELECT doc_id AS article_id, regexp_replace(unnest(string_split(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', ' ', 'g'), '[^0-9a-z가-힣]+', ' ', 'g'), ' ')), '^[0-9]+|[0-9]+$', '', 'g') AS w FROM documents)
    WHERE length(w) >= 2 AND w NOT IN {STOP}"""
VIEWS["fx_body_counts"] = "SELECT article_id, token, count(*) AS n FROM fx_words GROUP BY ALL"
VIEWS["fx_title_tokens"] = f"""
    WITH t AS (SELECT article_id, string_split(regexp_replace(regexp_replace(lower(title), '\\[[^\\]]*\\]|\\([^)]*\\)', ' ', 'g'), '[^0-9a-z가-힣]+', ' ', 'g'), ' ') AS ws FROM fx_articles),
      u AS (SELECT article_id, regexp_replace(unnest(ws), '^[0-9]+|[0-9]+$', '', 'g') AS token, generate_subscripts(ws, 1) AS i FROM t),
      d AS (SELECT article_id, token, min(i) AS i FROM u WHERE length(token) >= 2 AND token NOT IN {STOP} GROUP BY ALL)
    SELECT article_id, token, row_number() OVER (PARTITION BY article_id ORDER BY i) - 1 AS position FROM d"""


def title_tokens(t):
    return t.articles.select("article_id", F.posexplode(X.title_tokens(F.col("title"), stopwords=STOP)).alias("position", "token")).withColumn("position", F.col("position").cast("bigint"))


def sentences(t):
    return T.segment_sentences(t.articles)


@query("title_tokens", "SELECT article_id, position, token FROM fx_title_tokens")
def _(t):
    return title_tokens(t)


@query("body_tokens", """
    SELECT article_id, token, n, row_number() OVER (PARTITION BY article_id ORDER BY n DESC, length(token) DESC, token) AS position FROM fx_body_counts QUALIFY position <= 160""")
def _(t):
    return T.top_tokens(T.body_token_counts(t.articles, stopwords=STOP)).select("article_id", "token", "n", F.col("position").cast("bigint").alias("position"))


@query("document_frequency", """
    WITH d AS (SELECT token, count(*) AS df FROM fx_body_counts GROUP BY 1), n AS (SELECT count(DISTINCT article_id) AS n FROM fx_body_counts)
    SELECT token, df, df <= greatest(5, ceil(n * 0.08)) AS kept, df <= greatest(3, ceil(n * 0.02)) AS anchor FROM d, n""")
def _(t):
    return T.document_frequency(T.body_token_counts(t.articles, stopwords=STOP))


@query("event_features", rf"""
    SELECT article_id, array_to_string(list_sort(list_distinct(regexp_extract_all(title, '{ACTOR}', 1))), ',') AS actors,
      array_to_string(list_filter([{', '.join(f"CASE WHEN {' OR '.join(f'''contains(title || ' ' || body_text, '{w}')''' for w in ws)} THEN '{k}' END" for k, ws in ACTION_WORDS)}], lambda x: x IS NOT NULL), ',') AS actions,
      array_to_string(list_filter([{', '.join(f"CASE WHEN {' AND '.join(f'''regexp_matches(title, '{p}')''' for p in ps)} THEN '{k}' END" for k, ps in CONCEPT_RULES)}], lambda x: x IS NOT NULL), ',') AS concepts,
      regexp_replace(lower(title), '[^0-9a-z가-힣]+', '', 'g') AS title_key FROM fx_articles""")
def _(t):
    f = T.event_features(t.articles, ACTOR, ACTION_WORDS, CONCEPT_RULES)
    return f.select("article_id", F.array_join(F.array_sort("actors"), ",").alias("actors"), F.array_join("actions", ",").alias("actions"), F.array_join("concepts", ",").alias("concepts"), "title_key")


@query("agenda_concepts", f"""
    SELECT article_id, unnest(list_filter([{', '.join(f"CASE WHEN {' AND '.join(f'''regexp_matches(title, '{p}')''' for p in ps)} THEN '{k}' END" for k, ps in CONCEPT_RULES)}], lambda x: x IS NOT NULL)) AS concept FROM fx_articles""")
def _(t):
    return t.articles.select("article_id", F.explode(X.concepts(F.col("title"), CONCEPT_RULES)).alias("concept"))


@query("segment_sentences", "SELECT article_id, paragraph, sentence, sha256(text) AS text_sha, length(text) AS chars FROM fx_sentences")
def _(t):
    return sentences(t).select("article_id", "paragraph", "sentence", F.sha2("text", 256).alias("text_sha"), F.length("text").cast("bigint").alias("chars"))


@query("lead_sentences", """
    SELECT article_id, paragraph, sentence FROM fx_sentences QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY paragraph, sentence) <= 2""")
def _(t):
    return W.lead_sentences(sentences(t)).select("article_id", "paragraph", "sentence")


# character by character: depth of paired quotes (never below zero), parity of straight ones, cuts behind marks outside of both
VIEWS["fx_qsent"] = r"""
    WITH b AS (SELECT article_id, regexp_split_to_array(body_text, '\n\s*\n') AS blocks, list_transform(regexp_extract_all(body_text, '\n\s*\n'), lambda x: length(x)) AS gaps FROM fx_articles),
      p AS (SELECT article_id, k AS paragraph, blocks[k] AS block, coalesce(list_sum(list_transform(blocks[1:k - 1], lambda x: length(x))), 0) + coalesce(list_sum(gaps[1:k - 1]), 0) AS base FROM b, unnest(range(1, len(blocks) + 1)) AS u(k)),
      c AS (SELECT article_id, paragraph, base, i, block[i] AS ch, block[i + 1] AS nxt, CASE WHEN contains('“‘「『《〈', block[i]) THEN 1 WHEN contains('”’」』》〉', block[i]) THEN -1 ELSE 0 END AS step FROM p, unnest(range(1, length(block) + 1)) AS u(i)),
      s AS (SELECT *, sum(step) OVER w AS total, count(*) FILTER (ch = '"') OVER w AS straight FROM c WINDOW w AS (PARTITION BY article_id, paragraph ORDER BY i)),
      d AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY article_id, paragraph ORDER BY i)) AS depth FROM s),
      e AS (SELECT *, (ch = chr(10) OR (contains('.!?。！？', ch) AND regexp_matches(nxt, '\s') AND depth = 0 AND straight % 2 = 0))::INT AS cut FROM d),
      n AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY article_id, paragraph ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM e),
      g AS (SELECT article_id, paragraph, part, string_agg(ch, '' ORDER BY i) AS whole, min(base + i - 1) AS first FROM n GROUP BY 1, 2, 3),
      t AS (SELECT article_id, paragraph, part, regexp_replace(whole, '^\s+|\s+$', '', 'g') AS text, first + length(whole) - length(regexp_replace(whole, '^\s+', '')) AS start FROM g)
    SELECT article_id, paragraph, row_number() OVER (PARTITION BY article_id, paragraph ORDER BY part) AS sentence, CAST(start AS BIGINT) AS start, CAST(start + length(text) AS BIGINT) AS "end", text FROM t WHERE text <> ''"""


@query("segment_sentences_quoted", 'SELECT article_id, paragraph, sentence, start, "end", sha256(text) AS text_sha FROM fx_qsent')
def _(t):
    return T.segment_sentences_quoted(t.articles).select("article_id", "paragraph", "sentence", "start", "end", F.sha2("text", 256).alias("text_sha"))


@query("evidence_in_sentence", """
    WITH s AS (SELECT doc_id AS span_id, doc_id AS article_id, n_chars // 3 AS start, n_chars // 3 + doc_id % 40 AS "end" FROM documents)
    SELECT span_id, article_id, start, "end", EXISTS (SELECT 1 FROM fx_qsent q WHERE q.article_id = s.article_id AND q.start <= s.start AND s.start < q."end" AND s."end" <= q."end") AS fits FROM s""")
def _(t):
    spans = t.raw("documents").selectExpr("doc_id as span_id", "doc_id as article_id", "cast(n_chars div 3 as bigint) as start", "cast(n_chars div 3 + doc_id % 40 as bigint) as end")
    return T.evidence_in_sentence(spans, T.segment_sentences_quoted(t.articles))


UNITS = r"""regexp_extract_all(regexp_replace(regexp_replace(lower(text), 'https?://\S+|www\.\S+|[\w.+-]+@[\w.-]+\.[a-z]{2,}', ' ', 'g'), '[\x{200B}-\x{200D}\x{FEFF}]', ' ', 'g'), '[가-힣]+|[a-z]+(?:[.-][a-z]+)*|[0-9]+(?:[.,][0-9]+)*')"""
VIEWS["fx_morph"] = f"""
    WITH u AS (SELECT article_id, paragraph, sentence, {UNITS} AS us FROM fx_sentences), e AS (SELECT article_id, paragraph, sentence, unnest(us) AS surface, generate_subscripts(us, 1) - 1 AS i FROM u)
    SELECT article_id, paragraph, sentence, i * 2 AS position, surface, CASE WHEN regexp_matches(surface, '^[0-9]') THEN replace(surface, ',', '') ELSE surface END AS lemma,
      CASE WHEN regexp_matches(surface, '^[0-9]') THEN 'number' ELSE 'foreign' END AS pos FROM e"""
NEG = ("on", "the", "non")
CONTENT = "pos IN ('noun', 'predicate', 'foreign') AND length(lemma) BETWEEN 2 AND 20 AND NOT regexp_matches(lemma, 'https?|www\\.|@')"


@query("morph_tokens", "SELECT article_id, paragraph, sentence, position, surface, lemma, pos FROM fx_morph")
def _(t):
    return T.morph_tokens(sentences(t))


@query("negation_nearby", f"""
    SELECT article_id, paragraph, sentence, position // 2 AS position, lemma, coalesce(bool_or(lemma IN {NEG}) OVER (PARTITION BY article_id, paragraph, sentence ORDER BY position ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), false) AS negated FROM fx_morph""")
def _(t):
    return T.negation_nearby(sentences(t), NEG)


@query("morph_summary", f"""
    SELECT article_id, count(*) AS token_count, count(*) FILTER ({CONTENT}) AS content_token_count, count(*) FILTER (lemma IN {NEG}) AS negation_count, count(*) FILTER (pos = 'noun') AS noun_count,
      count(*) FILTER (pos = 'predicate') AS predicate_count, count(*) FILTER (pos = 'particle') AS particle_count, count(*) FILTER (pos = 'number') AS number_count, count(*) FILTER (pos = 'foreign') AS foreign_count FROM fx_morph GROUP BY 1""")
def _(t):
    return T.morph_summary(T.morph_tokens(sentences(t)), NEG)


VIEWS["fx_terms"] = f"SELECT article_id, pos, lemma AS term, count(*) AS n FROM fx_morph WHERE {CONTENT} GROUP BY ALL"


@query("top_terms", "SELECT article_id, term, n, row_number() OVER (PARTITION BY article_id ORDER BY n DESC, term) AS position FROM fx_terms QUALIFY position <= 40")
def _(t):
    from pressgrain.operators.paging import top_terms

    return top_terms(T.article_terms(sentences(t))).select("article_id", "term", "n", F.col("position").cast("bigint").alias("position"))


@query("top_body_tokens", "SELECT article_id, token, n, row_number() OVER (PARTITION BY article_id ORDER BY n DESC, length(token) DESC, token) AS position FROM fx_body_counts QUALIFY position <= 20")
def _(t):
    from pressgrain.operators.paging import top_body_tokens

    return top_body_tokens(T.body_token_counts(t.articles, stopwords=STOP), 20).select("article_id", "token", "n", F.col("position").cast("bigint").alias("position"))


@query("content_lemma_set", f"SELECT article_id, paragraph, sentence, string_agg(DISTINCT lemma, ' ' ORDER BY lemma) AS lemmas FROM fx_morph WHERE {CONTENT} GROUP BY ALL")
def _(t):
    out = T.content_lemma_set(sentences(t))
    return out.filter(F.size("lemmas") > 0).select("article_id", "paragraph", "sentence", F.array_join("lemmas", " ").alias("lemmas"))


@query("term_evidence", f"""
    SELECT article_id, lemma AS term, paragraph, sentence FROM fx_morph WHERE {CONTENT} AND (article_id, lemma) IN (SELECT (article_id, term) FROM fx_terms WHERE n >= 3)
    QUALIFY row_number() OVER (PARTITION BY article_id, lemma ORDER BY paragraph, sentence) = 1""")
def _(t):
    s = sentences(t)
    terms = T.morph_terms(T.morph_tokens(s)).filter("n >= 3")
    return T.term_evidence(terms, T.content_lemma_set(s))


@query("verbatim_leak", r"""
    WITH p AS (SELECT conv_id * 100 + turn AS claim_id, conv_id AS article_id, text AS paraphrase FROM conversations UNION ALL
               SELECT doc_id * 10 + 1000000, doc_id, substr(text, 11, doc_id % 90 + 5) FROM documents),
      n AS (SELECT claim_id, p.article_id, paraphrase, regexp_replace(lower(paraphrase), '[^\p{L}\p{N}]+', '', 'g') AS v, regexp_replace(lower(d.text), '[^\p{L}\p{N}]+', '', 'g') AS b FROM p LEFT JOIN documents d ON d.doc_id = p.article_id)
    SELECT claim_id, CASE WHEN length(paraphrase) > 160 THEN 'too_long' WHEN length(v) >= 24 AND list_bool_or(list_transform(generate_series(1, length(v) - 23), lambda i: contains(b, substr(v, i, 24)))) THEN 'verbatim' END AS reason FROM n""")
def _(t):
    conv = t.raw("conversations").selectExpr("conv_id * 100 + turn as claim_id", "conv_id as article_id", "text as paraphrase")
    docs = t.raw("documents").selectExpr("doc_id * 10 + 1000000 as claim_id", "doc_id as article_id", "substr(text, 11, cast(doc_id % 90 + 5 as int)) as paraphrase")
    return T.verbatim_leak(conv.unionByName(docs), t.articles).select("claim_id", "reason")


@query("align_evidence", """
    WITH p AS (SELECT doc_id, text, doc_id * 7919 % greatest(length(text) - 11, 1) AS place FROM documents),
      q AS (SELECT doc_id, text, substr(text, CAST(place AS INTEGER) + 1, 12) AS quote, CAST(CASE WHEN doc_id % 3 = 0 THEN place ELSE place + doc_id % 7 END AS INTEGER) AS hint FROM p),
      o AS (SELECT *, substr(text, hint + 1, length(quote)) = quote AS exact, strpos(reverse(text[1:hint + length(quote)]), reverse(quote)) AS back, strpos(text[hint + 2:], quote) AS ahead FROM q),
      d AS (SELECT *, CASE WHEN back > 0 THEN least(hint + length(quote), length(text)) - length(quote) - (back - 1) END AS before, CASE WHEN ahead > 0 THEN hint + ahead END AS after FROM o)
    SELECT doc_id AS quote_id, CASE WHEN exact THEN hint WHEN after IS NULL OR hint - before <= after - hint THEN before ELSE after END AS start, CASE WHEN exact THEN 'exact' ELSE 'nearest' END AS method FROM d""")
def _(t):
    place = "doc_id * 7919 % greatest(length(text) - 11, 1)"
    q = t.raw("documents").selectExpr("doc_id as quote_id", "doc_id as article_id", f"substr(text, cast({place} as int) + 1, 12) as quote",
                                      f"cast({place} + case when doc_id % 3 = 0 then 0 else doc_id % 7 end as int) as hint")
    return T.align_evidence(q, t.articles).select("quote_id", "start", "method")


@query("frame_keyword_signals", f"""
    SELECT article_id, unnest(list_filter([{', '.join(f"CASE WHEN {' OR '.join(f'''contains(body_text, '{w}')''' for w in ws)} THEN '{k}' END" for k, ws in FRAMES)}], lambda x: x IS NOT NULL)) AS frame FROM fx_articles""")
def _(t):
    return T.frame_keyword_signals(t.articles, FRAMES)


@query("body_evidence_span", """
    WITH m AS (SELECT article_id, body_text AS b, CASE WHEN contains(body_text, 'tionth') THEN 'tionth' ELSE 'erly' END AS w FROM fx_articles WHERE contains(body_text, 'tionth') OR contains(body_text, 'erly')),
      a AS (SELECT *, instr(b, w) - 1 AS k FROM m), s AS (SELECT *, coalesce(list_max(list_filter(range(0, k + 1), lambda i: substr(b, i + 1, 1) IN ('.', chr(10)))), -1) + 1 AS start,
        list_min(list_filter(range(k, length(b)), lambda i: substr(b, i + 1, 1) IN ('.', chr(10)))) AS nxt FROM a),
      e AS (SELECT *, least(length(b), greatest(start + length(w), CASE WHEN nxt IS NOT NULL THEN nxt + 2 ELSE least(length(b), start + 280) END)) AS e FROM s)
    SELECT article_id, w AS word, start, e AS "end", substr(regexp_replace(substr(b, start + 1, e - start), '^\\s+|\\s+$', '', 'g'), 1, 280) AS excerpt FROM e""")
def _(t):
    return T.body_evidence_span(t.articles, ("tionth", "erly"))


@query("candidate_title_key", """
    SELECT article_id, array_to_string(list_filter(string_split(regexp_replace(lower(title), '[^0-9a-z가-힣 ]+', ' ', 'g'), ' '), lambda w: length(w) >= 2)[1:3], ' ') AS title_key FROM fx_articles""")
def _(t):
    return t.articles.select("article_id", X.candidate_title_key(F.col("title")).alias("title_key"))
