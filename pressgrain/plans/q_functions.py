"""Scalar functions, each run over a whole given table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrain.functions import columns as C, rules as R, text as X
from pressgrain.operators.scans import published_at_from_id
from pressgrain.plans.fixtures import VIEWS, ntz
from pressgrain.plans.q_scans import EXPORT_TS, export
from pressgrain.plans.registry import query

TS = "'%Y-%m-%d %H:%M:%S'"


def rnd(e, d):
    s = f"{10 ** d}.0::DOUBLE"
    return f"floor(({e}) * {s} + 0.5::DOUBLE) / {s}"


VIEWS["fx_raw_urls"] = """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(url, 'example', 'EXAMPLE') WHEN page_id % 7 = 0 THEN regexp_replace(url, '(example\\.[a-z]+)', '\\1:443')
    WHEN page_id % 11 = 0 THEN regexp_replace(url, '(example\\.[a-z]+)', '\\1:8443') ELSE url END || CASE WHEN page_id % 5 = 0 AND NOT contains(url, '?') AND NOT contains(url, '#') THEN '?z=1&gclid=9&a=2&spm=4' ELSE '' END AS url FROM pages"""


def raw_urls(t):
    return t.raw("pages").select("page_id", F.expr("""concat(case when page_id % 3 = 0 then replace(url, 'example', 'EXAMPLE') when page_id % 7 = 0 then regexp_replace(url, '(example\\\\.[a-z]+)', '$1:443')
        when page_id % 11 = 0 then regexp_replace(url, '(example\\\\.[a-z]+)', '$1:8443') else url end,
        case when page_id % 5 = 0 and not contains(url, '?') and not contains(url, '#') then '?z=1&gclid=9&a=2&spm=4' else '' end)""").alias("url"))


def canon_sql(profile):
    names = "|".join(C.TRACKING_PARAMS[profile])
    order = "list_sort" if profile in C.SORTED_PROFILES else ""
    host = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
    port = "regexp_extract(url, '^https?://[^/?#:]*:([0-9]+)', 1)"
    path = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
    q = f"array_to_string({order}(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(utm_.*|{names})$'))), '&')"
    out = f"'https://' || {host} || CASE WHEN {port} IN ('', '443') THEN '' ELSE ':' || {port} END || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END"
    if profile == "trial":
        out = f"regexp_replace({out}, '/$', '')"
    return f"CASE WHEN url LIKE 'https://%' THEN {out} END" if profile in C.HTTPS_ONLY_PROFILES else out


@query("canonical_url", f"SELECT page_id, {', '.join(f'{canon_sql(p)} AS {p}_url' for p in C.TRACKING_PARAMS)} FROM fx_raw_urls")
def _(t):
    return raw_urls(t).select("page_id", *[C.canonical_url(F.col("url"), p).alias(f"{p}_url") for p in C.TRACKING_PARAMS])


@query("article_id_from_url", "SELECT article_id, substr(sha256(canonical_url), 1, 32) AS id32, sha256('feed:' || canonical_url) AS provider_id FROM fx_articles")
def _(t):
    u = F.col("canonical_url")
    return t.articles.select("article_id", C.article_id_from_url(u).alias("id32"), C.article_id_from_url(u, "feed").alias("provider_id"))


@query("body_hash", "SELECT article_id, sha256(body_text) AS body_sha256, canonical_url || '|' || sha256(body_text) || '|v1' AS analysis_key FROM fx_articles")
def _(t):
    h = C.body_hash(F.col("body_text"))
    return t.articles.select("article_id", h.alias("body_sha256"), C.analysis_key(F.col("canonical_url"), h, "v1").alias("analysis_key"))


@query("analysis_key", "SELECT article_id, canonical_url || '|' || sha256(body_text) || '|rules-v2' AS analysis_key FROM fx_articles")
def _(t):
    return t.articles.select("article_id", C.analysis_key(F.col("canonical_url"), C.body_hash(F.col("body_text")), "rules-v2").alias("analysis_key"))


@query("analysis_fingerprint", """
    SELECT article_id, sha256('{"approval":"","article_id":"' || article_id || '","body_hash":"' || sha256(body_text) || '","model":"rules","prompt":"p1","schema":2}') AS fingerprint FROM fx_articles""")
def _(t):
    return t.articles.select("article_id", C.analysis_fingerprint(F.col("article_id").cast("string"), C.body_hash(F.col("body_text")), "rules", "p1", 2).alias("fingerprint"))


@query("canonical_json_digest", """
    SELECT article_id, sha256('{"section":"' || section || '","source":"' || source_id || '","title":"' || replace(replace(title, '\\', '\\\\'), '"', '\\"') || '"}') AS digest FROM fx_articles""")
def _(t):
    return t.articles.select("article_id", C.json_digest({"title": F.col("title"), "source": F.col("source_id"), "section": F.col("section")}).alias("digest"))


@query("evidence_fingerprint", """
    SELECT article_id, paragraph, sentence, sha256('evidence:v1:' || article_id || ':' || text) AS v1, sha256('evidence:v2:' || article_id || ':' || paragraph || ':' || sentence || ':' || text) AS v2 FROM fx_sentences""")
def _(t):
    from pressgrain.operators.textops import segment_sentences

    a, p, s, x = F.col("article_id"), F.col("paragraph"), F.col("sentence"), F.col("text")
    return segment_sentences(t.articles).select("article_id", "paragraph", "sentence", C.evidence_fingerprint(a, x).alias("v1"), C.evidence_fingerprint_located(a, p, s, x).alias("v2"))


@query("claim_id", "SELECT article_id, sha256('claim:v1:' || article_id || ':problem:' || section || ':narration') AS claim_id FROM fx_articles")
def _(t):
    return t.articles.select("article_id", C.claim_id(F.col("article_id"), F.lit("problem"), F.col("section"), F.lit("narration")).alias("claim_id"))


@query("kst_date", "SELECT event_id, strftime(ts + INTERVAL 9 HOURS, '%Y-%m-%d') AS local_date FROM events")
def _(t):
    return t.raw("events").select("event_id", C.kst_date(F.col("ts")).alias("local_date"))


@query("kst_day_bounds", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-11 15:00:00' AND ts < TIMESTAMP '2024-01-12 15:00:00'")
def _(t):
    lo, hi = C.kst_day_bounds("2024-01-12")
    return t.raw("events").filter((F.col("ts") >= lo) & (F.col("ts") < hi)).select("event_id")


@query("published_at_from_id", f'SELECT "URL" AS url, news_id, strftime({EXPORT_TS}, {TS}) AS published_at FROM fx_export')
def _(t):
    return export(t).select(F.col("URL").alias("url"), "news_id", C.stamp(published_at_from_id(F.col("news_id"), F.col("일자"))).alias("published_at"))


@query("parse_timestamp_flexible", f"SELECT event_id, strftime(date_trunc('second', ts) - CASE event_id % 5 WHEN 1 THEN INTERVAL 9 HOURS WHEN 3 THEN INTERVAL 150 MINUTES WHEN 4 THEN -INTERVAL 300 MINUTES ELSE INTERVAL 0 HOURS END, {TS}) AS utc FROM events")
def _(t):
    text = F.expr("""case event_id % 5 when 0 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") when 1 then date_format(ts, 'yyyy-MM-dd HH:mm:ss')
        when 2 then date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'") when 3 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'+02:30'") else date_format(ts, "EEE, d MMM yyyy HH:mm:ss '-0500'") end""")
    return t.raw("events").select("event_id", C.stamp(R.parse_timestamp_flexible(text)).alias("utc"))


@query("freshness_status", f"""
    WITH r AS (SELECT run_id, CASE WHEN run_id % 13 = 0 THEN NULL ELSE target_date END AS d, finished_at, status, run_id % 12 AS s FROM fx_runs), x AS (SELECT *, greatest(0, date_diff('day', CAST(strptime(d, '%Y-%m-%d') AS DATE), DATE '1998-06-01')) AS stale FROM r)
    SELECT run_id, CASE WHEN d IS NULL THEN 'pending' WHEN status = 'failed' OR (s > 0 AND s < 3) THEN 'partial' WHEN stale > 0 THEN 'stale' WHEN TIMESTAMP '1998-05-31 20:00:00' - finished_at > INTERVAL 24 HOURS THEN 'delayed' ELSE 'normal' END AS status,
      CASE WHEN d IS NULL OR status = 'failed' OR (s > 0 AND s < 3) THEN NULL ELSE stale END AS stale_days FROM x""")
def _(t):
    r = t.runs.withColumns({"d": F.expr("case when run_id % 13 = 0 then null else target_date end"), "s": F.expr("run_id % 12"),
                            "c": F.expr("case when status = 'failed' then 'partial' else status end")})
    f = R.freshness_status(F.col("d"), F.col("finished_at"), F.col("c"), F.col("s"), F.lit(3), ntz("1998-05-31 20:00:00"))
    return r.select("run_id", f.alias("f")).select("run_id", "f.status", F.col("f.stale_days").cast("bigint").alias("stale_days"))


@query("schedule_slot", "WITH h AS (SELECT event_id, hour(ts + INTERVAL 9 HOURS) AS h FROM events) SELECT event_id, CAST(CASE WHEN h >= 21 THEN 3 WHEN h >= 15 THEN 2 WHEN h >= 11 THEN 1 WHEN h >= 7 THEN 0 ELSE 3 END AS BIGINT) AS slot FROM h")
def _(t):
    return t.raw("events").select("event_id", R.schedule_slot(F.col("ts"), (7, 11, 15, 21)).alias("slot"))


@query("retry_delay", "SELECT attempt_id, CAST(least(900000, 1000 * pow(2, attempt_count - 1)) AS BIGINT) AS delay_ms, CAST(least(86400000, 900000 * pow(2, least(attempt_count, 6))) AS BIGINT) AS body_delay_ms FROM fx_attempts")
def _(t):
    n = F.col("attempt_count")
    return t.attempts.select("attempt_id", C.retry_delay_ms(n, 1000, 900_000).alias("delay_ms"), R.body_retry_delay_ms(n).alias("body_delay_ms"))


@query("next_attempt_status", "SELECT attempt_id, CASE WHEN attempt_count >= 5 THEN 'terminal' ELSE 'retry_wait' END AS status FROM fx_attempts")
def _(t):
    return t.attempts.select("attempt_id", R.next_attempt_status(F.col("attempt_count"), 5).alias("status"))


@query("normalize_text", "SELECT article_id, sha256(x) AS text_sha, length(x) AS chars FROM fx_norm")
def _(t):
    x = t.articles.select("article_id", X.normalize_text(F.col("body_text")).alias("x"))
    return x.select("article_id", F.sha2("x", 256).alias("text_sha"), F.length("x").cast("bigint").alias("chars"))


@query("normalize_title_key", "SELECT article_id, regexp_replace(lower(title), '[^0-9a-z가-힣]+', '', 'g') AS title_key FROM fx_articles")
def _(t):
    return t.articles.select("article_id", X.title_key(F.col("title")).alias("title_key"))


VIEWS["fx_headlines"] = r"""
    WITH c AS (SELECT article_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '\[[^\]]*\]|\([^)]*\)|<[^>]*>', ' ', 'g'), '^[0-9가-힣A-Za-z]+\s*기자\s*=', ''),
        '["''“”‘’]', ' ', 'g'), '[`()\[\]]', ' ', 'g'), '[.?!…:\-]+', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM fx_articles),
      w AS (SELECT article_id, clean, list_transform(list_filter(string_split(clean, ' '), lambda x: x <> ''), lambda x: [x]) AS ws FROM c),
      d AS (SELECT article_id, clean, CASE WHEN len(ws) = 0 THEN '' ELSE array_to_string(list_reduce(ws, lambda a, x: CASE WHEN a[-1] = x[1] THEN a
        WHEN length(x[1]) >= 2 AND length(a[-1]) >= 2 AND (ends_with(a[-1], x[1]) OR ends_with(x[1], a[-1])) AND abs(length(x[1]) - length(a[-1])) <= 2 THEN CASE WHEN length(x[1]) > length(a[-1]) THEN a[1:len(a) - 1] || x ELSE a END
        ELSE a || x END), ' ') END AS t FROM w),
      e AS (SELECT article_id, clean, trim(regexp_replace(t, '\s+(관련\s+)?이슈$', '')) AS t FROM d),
      f AS (SELECT *, trim(regexp_extract(t, '^(.*?)(\s*[|·]\s*|\s+[―–—]\s+)', 1)) AS clause FROM e)
    SELECT article_id, clean, CASE WHEN length(t) <= 58 THEN t WHEN length(clause) BETWEEN 10 AND 58 THEN clause ELSE rtrim(t[1:57]) || '…' END AS headline FROM f"""


@query("headline_cleanup", "SELECT article_id, headline FROM fx_headlines")
def _(t):
    return t.articles.select("article_id", X.headline_cleanup(F.col("title")).alias("headline"))


SUFFIX = (("ther", "ther|thor"), ("ation", "ation|tion"), ("er", "er[a-z]"))


@query("issue_suffix", """
    WITH j AS (SELECT issue_id, count(*) AS n, string_agg(title, ' ') AS x FROM fx_members m JOIN fx_articles a ON a.article_id = m.article_id GROUP BY 1),
      c AS (SELECT issue_id, n, len(regexp_extract_all(x, 'ther|thor')) AS a, len(regexp_extract_all(x, 'ation|tion')) AS b, len(regexp_extract_all(x, 'er[a-z]')) AS d FROM j)
    SELECT issue_id, CASE WHEN greatest(a, b, d) < greatest(2, ceil(n * 0.25)) THEN NULL WHEN a >= b AND a >= d THEN 'ther' WHEN b >= d THEN 'ation' ELSE 'er' END AS suffix FROM c""")
def _(t):
    from pressgrain.operators.clusters import issue_suffixes

    return issue_suffixes(t.members.join(t.articles.select("article_id", "title"), "article_id"), SUFFIX)


@query("decode_entities", r"""
    SELECT page_id, sha256(replace(replace(replace(replace(replace(replace(html, '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS decoded_sha FROM pages""")
def _(t):
    return t.raw("pages").select("page_id", F.sha2(X.decode_entities(F.col("html")), 256).alias("decoded_sha"))


@query("hangul_particle", "SELECT article_id, source_id || CASE WHEN article_id % 28 > 0 THEN '을' ELSE '를' END AS phrase FROM fx_articles")
def _(t):
    # the source name plus one Hangul syllable whose final consonant cycles through all 28 values
    word = F.col("source_id")
    syllable = F.expr("decode(unhex(hex(44032 + article_id % 28)), 'UTF-16BE')")
    out = C.hangul_particle(F.concat(word, syllable), "을", "를")
    return t.articles.select("article_id", F.concat(word, F.right(out, F.lit(1))).alias("phrase"))


@query("placement_alias", "SELECT observation_id, zone AS zone FROM fx_placements")
def _(t):
    raw = F.expr("case zone when 'top' then ' 최상단' when 'main' then 'MAIN' when 'section' then '섹션 ' else 'list' end")
    return t.placements.select("observation_id", C.placement_alias(raw).alias("zone"))


@query("coverage_factor", f"SELECT issue_id, {rnd('least(1.0::DOUBLE, 0.45::DOUBLE + source_count::DOUBLE / 12.0::DOUBLE * 0.8::DOUBLE)', 6)} AS factor FROM fx_issues")
def _(t):
    return t.issues.select("issue_id", C.half_up(C.coverage_factor(F.col("source_count"), F.lit(12)), 6).alias("factor"))


W = ("(0.0::DOUBLE + d * 0.55::DOUBLE + v * 0.25::DOUBLE + coalesce(p * 0.15::DOUBLE, 0.0::DOUBLE) + f * 0.05::DOUBLE) / (0.0::DOUBLE + 0.55::DOUBLE + 0.25::DOUBLE + CASE WHEN p IS NULL THEN 0.0::DOUBLE ELSE 0.15::DOUBLE END + 0.05::DOUBLE)"
     " * least(1.0::DOUBLE, 0.45::DOUBLE + s::DOUBLE / 12.0::DOUBLE * 0.8::DOUBLE)")


@query("weighted_agenda_score", f"""
    WITH x AS (SELECT issue_id, least(100.0::DOUBLE, source_count * 100.0::DOUBLE / 12.0::DOUBLE) AS d, article_count * 2.0::DOUBLE AS v, CASE WHEN article_count % 3 = 0 THEN NULL ELSE cohesion_score END AS p, agenda_score / 2.0::DOUBLE AS f, source_count AS s FROM fx_issues)
    SELECT issue_id, {rnd(W, 1)} AS score FROM x""")
def _(t):
    s = F.col("source_count")
    p = F.when(F.col("article_count") % 3 != 0, F.col("cohesion_score"))
    score = C.weighted_agenda_score(F.least(F.lit(100.0), s * 100.0 / F.lit(12.0)), F.col("article_count") * 2.0, p, F.col("agenda_score") / 2.0, s, F.lit(12))
    return t.issues.select("issue_id", score.alias("score"))


@query("scoped_score", f"SELECT issue_id, {rnd('(source_count * 60.0::DOUBLE / 12.0::DOUBLE + least(article_count, 10) * 4.0::DOUBLE) * least(1.0::DOUBLE, 0.45::DOUBLE + source_count * 0.8::DOUBLE / 12.0::DOUBLE)', 1)} AS score FROM fx_issues")
def _(t):
    return t.issues.select("issue_id", C.scoped_score(F.col("source_count"), F.col("article_count"), 12).alias("score"))


CONV = """SELECT a.conv_id, a.turn, list_distinct(regexp_extract_all(lower(a.text), '[a-z]+')) AS x, list_distinct(regexp_extract_all(lower(b.text), '[a-z]+')) AS y FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"""


def turn_pairs(t):
    c = t.raw("conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return c.select("conv_id", "turn", F.col("w").alias("x")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("y")), ["conv_id", "turn"])


@query("jaccard", f"WITH c AS ({CONV}) SELECT conv_id, turn, {rnd('coalesce(len(list_intersect(x, y))::DOUBLE / nullif(len(list_distinct(x || y)), 0)::DOUBLE, 0)', 6)} AS jaccard FROM c")
def _(t):
    return turn_pairs(t).select("conv_id", "turn", C.half_up(C.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query("blended_similarity", f"""
    WITH c AS ({CONV}), j AS (SELECT conv_id, turn, coalesce(len(list_intersect(x, y))::DOUBLE / nullif(len(list_distinct(x || y)), 0)::DOUBLE, 0.0::DOUBLE) AS j, len(x) > 30 AS bodies FROM c)
    SELECT conv_id, turn, CASE WHEN bodies THEN {rnd('j * 0.65::DOUBLE + (j / 2.0::DOUBLE) * 0.35::DOUBLE', 3)} ELSE {rnd('j', 6)} END AS similarity FROM j""")
def _(t):
    p = turn_pairs(t).withColumn("j", C.jaccard(F.col("x"), F.col("y")))
    s = C.blended_similarity(F.col("j"), F.col("j") / 2.0, F.size("x") > 30)
    return p.select("conv_id", "turn", F.when(F.size("x") > 30, s).otherwise(C.half_up(s, 6)).alias("similarity"))


@query("category_classify", """
    WITH c AS (SELECT article_id, section, len(regexp_extract_all(title, 'th|er')) AS a, len(regexp_extract_all(title, 'on|an')) AS b FROM fx_articles)
    SELECT article_id, CASE WHEN section = 'fr' THEN 'french' WHEN section = 'de' THEN 'german' WHEN a > 0 AND a >= b THEN 'politics' WHEN b > 0 THEN 'economy' END AS category FROM c""")
def _(t):
    cat = X.category_classify(F.col("section"), F.col("title"), (("french", "^fr$"), ("german", "^de$")), (("politics", "th|er"), ("economy", "on|an")))
    return t.articles.select("article_id", cat.alias("category"))


SUBJECTS = (("state", "th[aeiou]"), ("party", "on[a-z]"), ("court", "er[a-z]"), ("people", "an"))


@query("subject_order", f"""
    WITH h AS (SELECT article_id, list_sort(list_filter([{', '.join(f"CASE WHEN regexp_matches(title, '{p}') THEN {{'at': instr(title, regexp_extract(title, '{p}')), 'rank': {i}, 'label': '{lab}'}} END" for i, (lab, p) in enumerate(SUBJECTS))}], lambda x: x IS NOT NULL)) AS s FROM fx_articles)
    SELECT article_id, array_to_string(list_transform(s, lambda x: x.label), ',') AS subjects, s[1].label AS narrowed FROM h""")
def _(t):
    return t.articles.select("article_id", R.subject_order(F.col("title"), SUBJECTS).alias("s")).select(
        "article_id", F.array_join("s", ",").alias("subjects"), F.try_element_at("s", F.lit(1)).alias("narrowed"))


@query("variant_key", r"""
    SELECT article_id, CASE WHEN article_id % 3 = 0 THEN 'semantic:cause:family:fam_' || section WHEN trim(regexp_replace(lower(title), '[^\p{L}\p{N}_]+', ' ', 'g')) <> '' THEN 'semantic:cause:' || trim(regexp_replace(lower(title), '[^\p{L}\p{N}_]+', ' ', 'g')) ELSE 'code' END AS variant FROM fx_articles""")
def _(t):
    fam = F.expr("case when article_id % 3 = 0 then concat('fam_', section) else 'Not A Family' end")
    return t.articles.select("article_id", R.variant_key(F.lit("cause"), fam, F.col("title"), F.lit("code")).alias("variant"))


AXES = (("focus", "H", "B"), ("voice", "M", "D"), ("range", "O", "C"), ("aim", "R", "P"))


@query("reader_type", """
    WITH a AS (SELECT user_id AS reader_id, CASE event_id % 4 WHEN 0 THEN 'focus' WHEN 1 THEN 'voice' WHEN 2 THEN 'range' ELSE 'aim' END AS axis, CASE WHEN value < 10 THEN 'a' ELSE 'b' END AS answer FROM events),
      c AS (SELECT reader_id, axis, count(*) FILTER (answer = 'a') >= count(*) FILTER (answer = 'b') AS first FROM a GROUP BY ALL), r AS (SELECT DISTINCT reader_id FROM a)
    SELECT r.reader_id, CASE WHEN coalesce(f.first, true) THEN 'H' ELSE 'B' END || CASE WHEN coalesce(v.first, true) THEN 'M' ELSE 'D' END || CASE WHEN coalesce(g.first, true) THEN 'O' ELSE 'C' END || CASE WHEN coalesce(m.first, true) THEN 'R' ELSE 'P' END AS reader_type
    FROM r LEFT JOIN c f ON f.reader_id = r.reader_id AND f.axis = 'focus' LEFT JOIN c v ON v.reader_id = r.reader_id AND v.axis = 'voice' LEFT JOIN c g ON g.reader_id = r.reader_id AND g.axis = 'range' LEFT JOIN c m ON m.reader_id = r.reader_id AND m.axis = 'aim'""")
def _(t):
    a = t.raw("events").selectExpr("user_id as reader_id", "case event_id % 4 when 0 then 'focus' when 1 then 'voice' when 2 then 'range' else 'aim' end as axis", "case when value < 10 then 'a' else 'b' end as answer")
    return R.reader_type(a, AXES).select("reader_id", "reader_type")


@query("strip_evidence_tokens", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '[ \t]{2,}', ' ', 'g'), '[ \t]+([,.;])', '\1', 'g'), ' ')) AS clean_sha FROM documents")
def _(t):
    cited = F.regexp_replace("text", r"\. ", " [P1S2]. ")
    return t.raw("documents").select("doc_id", F.sha2(R.strip_evidence_tokens(cited), 256).alias("clean_sha"))


@query("clean_claim_text", r"SELECT doc_id, substr(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'), 1, 280) AS claim FROM documents")
def _(t):
    cited = F.regexp_replace("text", r"\.", " (p3:s1, p4:s2).")
    return t.raw("documents").select("doc_id", R.clean_claim_text(cited).alias("claim"))


@query("marker_block", "SELECT doc_id, CASE WHEN contains(text, 'tionth') OR contains(text, 'onther') THEN 'ideology' WHEN contains(text, 'erly') THEN 'internal_code' END AS blocked FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", R.marker_block(F.col("text"), ("tionth", "onther"), ("erly",)).alias("blocked"))


@query("metric_rule_check", """
    WITH m AS (SELECT l_returnflag || l_linestatus AS name, count(*)::DOUBLE AS actual FROM lineitem GROUP BY 1), k AS (SELECT CAST(o_orderstatus AS VARCHAR) AS s FROM orders GROUP BY 1),
      r AS (SELECT a || b AS name, CASE a WHEN 'A' THEN 'gte' WHEN 'N' THEN 'lt' WHEN 'R' THEN 'eq' ELSE 'near' END AS operator, 1000.0::DOUBLE AS value FROM (SELECT unnest(['A', 'N', 'R', 'Z']) AS a), (SELECT unnest(['F', 'O', 'P']) AS b))
    SELECT r.name, operator, value, actual, coalesce(actual IS NOT NULL AND operator <> 'near' AND CASE operator WHEN 'gte' THEN actual >= value WHEN 'lt' THEN actual < value ELSE actual = value END, false) AS passed,
      CASE WHEN operator = 'near' THEN 'threshold_rule_invalid' WHEN actual IS NULL THEN 'metric_missing' END AS reason FROM r LEFT JOIN m USING (name)""")
def _(t):
    metrics = t.raw("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("actual"))
    ops = {"A": "gte", "N": "lt", "R": "eq", "Z": "near"}
    rules = t.spark.createDataFrame([(a + b, ops[a], 1000.0) for a in ops for b in "FOP"], "name string, operator string, value double")
    return R.metric_rule_check(rules, metrics)


@query("json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def _(t):
    p = F.from_json("props", "k bigint, missing string")
    return t.raw("events").select("event_id", p.alias("p")).select("event_id", "p.k", "p.missing")
