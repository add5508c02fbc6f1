"""Rule-based frame profiles of articles, kept as tables rather than documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pressgrain.functions import columns as C, text as X
from pressgrain.lexicons import frames as R
from pressgrain.operators.common import top_per_key
from pressgrain.operators.textops import content_lemmas_among

Analyzer = Callable[[DataFrame], DataFrame]


def rule_matches(sentences: DataFrame, rules: Sequence = R.FRAME_RULES) -> DataFrame:
    """Sentence x rule hits with the rule's order and the 0-based match position. Each pattern is tried once."""
    tried = F.array(*[
        F.struct(F.lit(i).alias("rule_no"), F.lit(d).alias("dimension"), F.lit(c).alias("code"), (F.regexp_instr("text", F.lit(p)) - 1).alias("match_at"))
        for i, (d, c, p) in enumerate(rules)])
    hits = sentences.withColumn("_m", F.filter(tried, lambda m: m["match_at"] >= 0))
    # an outer explode, for else Spark asks first which arrays are empty and tries every pattern twice
    return hits.select(*sentences.columns, F.explode_outer("_m").alias("_h")).filter("_h is not null").select(*sentences.columns, "_h.*")


def _clean_name(raw: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(raw, "[\"“”‘’()\\[\\]{}<>]", " "), R.SPEAKER_LEADS, "")
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    name = F.when(bare.endswith("전문가"), bare).otherwise(F.regexp_replace(bare, R.SPEAKER_TAIL, ""))
    ok = (name != "") & (F.length(name) <= 28) & ~name.rlike("^[0-9]+$")
    words = F.split(name, " ")
    return F.when(ok, F.array_join(F.slice(words, F.greatest(F.size(words) - 3, F.lit(1)), 4), " "))


def speaker_extract(text: Column, before_quote: Sequence[str] = R.SPEAKER_BEFORE_QUOTE, according: str = R.SPEAKER_ACCORDING,
                    reporting: str = R.REPORTING, after_reporting: Sequence[str] = R.SPEAKER_REPORTING, clean: bool = True,
                    anonymous: tuple[str, str] = R.SPEAKER_ANONYMOUS) -> Column:
    """Speaker of a sentence: the clause before the quote, an according-to phrase, or the clause before
    the reporting verb; the first pattern that applies decides. ``anonymous`` is a pattern before the quote and how such a speaker's
    name ends, whatever white space the text has there; only texts that hold this ending are searched for it."""
    head = F.trim(F.regexp_extract(text, "(?s)^([^\"“‘]*)", 1))
    unnamed = F.concat(F.regexp_extract(head, anonymous[0], 1), F.lit(anonymous[1]))
    out = F.when(F.contains(text, F.lit(anonymous[1].strip())) & head.rlike(anonymous[0]), _clean_name(unnamed) if clean else unnamed)
    for where, pattern in [(head, p) for p in before_quote] + [(text, according)]:
        name = F.regexp_extract(where, pattern, 1)
        out = out.when(where.rlike(pattern), _clean_name(name) if clean else name)
    verb_at = F.regexp_instr(text, F.lit(reporting))
    prefix = F.left(text, verb_at - 1)
    for pattern in after_reporting:
        name = F.regexp_extract(prefix, pattern, 1)
        out = out.when((verb_at > 0) & prefix.rlike(pattern), _clean_name(name) if clean else name)
    return out


def source_role(name: Column, roles: Sequence[tuple[str, str]] = R.SOURCE_ROLES) -> Column:
    return F.when(name.isNull(), "other").otherwise(X.first_rule(name, roles, "other"))


def inside_quote(text: Column, at: Column) -> Column:
    """Whether position ``at`` lies inside a quotation: quotes closed before it are removed, and an
    opening mark must then reach across it to a closing one."""
    head = F.regexp_replace(F.left(text, at), R.QUOTE, "")
    joined = F.concat(head, F.lit("\u0001"), F.substr(text, at + 1))
    return joined.rlike("[\"“‘][^\"”’]*\u0001[^\"”’]*[\"”’]")


def voice_class(text: Column, at: Column, speaker: Column, reporting: str = R.REPORTING, attribution: str = R.ATTRIBUTION) -> Column:
    return (
        F.when(inside_quote(text, at), F.when(speaker.isNotNull(), "direct_quote").otherwise("uncertain_quote"))
        .when((text.rlike(reporting) | text.rlike(attribution)) & speaker.isNotNull(), "indirect_source")
        .otherwise("journalist_narration"))


def voiced_matches(sentences: DataFrame, rules: Sequence = R.FRAME_RULES, speaker: Callable[[Column], Column] = speaker_extract,
                   reporting: str = R.REPORTING, attribution: str = R.ATTRIBUTION, roles=R.SOURCE_ROLES) -> DataFrame:
    """Rule hits with who speaks: voice kind, speaker and role (null for narration)."""
    hits = rule_matches(sentences, rules)
    named = hits.withColumn("_sp", speaker(F.col("text")))
    voiced = named.withColumn("voice_kind", voice_class(F.col("text"), F.col("match_at"), F.col("_sp"), reporting, attribution))
    told = F.col("voice_kind") == "journalist_narration"
    return voiced.withColumns({
        "speaker": F.when(~told, F.col("_sp")), "speaker_role": F.when(~told, source_role(F.col("_sp"), roles)),
        "voice_scope": F.when(told, "narration").otherwise("source")}).drop("_sp")


def frame_items(voiced: DataFrame) -> DataFrame:
    """One item per (article, dimension, code, voice scope): the earliest sentence, then rule order."""
    first = top_per_key(voiced, ["article_id", "dimension", "code", "voice_scope"], [F.col("paragraph"), F.col("sentence"), F.col("rule_no")])
    variant = F.concat_ws(":", F.lit("rules"), "dimension", "code")
    return first.select(
        "article_id", "dimension", "code", F.col("code").alias("frame_family"), variant.alias("variant_key"), "voice_kind", "voice_scope", "speaker", "speaker_role",
        "paragraph", "sentence", "rule_no",
        C.evidence_fingerprint(F.col("article_id"), F.col("text")).alias("sentence_sha256"),
        C.claim_id(F.col("article_id"), F.col("dimension"), variant, F.col("voice_kind")).alias("claim_id"))


def dimension_status(articles: DataFrame, items: DataFrame, dimensions: Sequence[str] = R.DIMENSIONS) -> DataFrame:
    """Status of every article x dimension: observed, source_attributed or not_observed."""
    spine = articles.select("article_id", F.explode(F.array(*[F.lit(d) for d in dimensions])).alias("dimension"))
    seen = items.groupBy("article_id", "dimension").agg(F.count_if(F.col("voice_kind") == "journalist_narration").alias("_n"))
    return spine.join(seen, ["article_id", "dimension"], "left").select(
        "article_id", "dimension", F.when(F.col("_n").isNull(), "not_observed").when(F.col("_n") > 0, "observed").otherwise("source_attributed").alias("status"))


def source_mentions(sentences: DataFrame, speaker: Callable[[Column], Column] = speaker_extract, reporting: str = R.REPORTING,
                    attribution: str = R.ATTRIBUTION, roles=R.SOURCE_ROLES, keep: int = 5) -> DataFrame:
    """Per article, speaker and role: direct and indirect mentions with the first locators."""
    text = F.col("text")
    told = F.when(text.rlike(reporting) | text.rlike(attribution), F.struct(speaker(text).alias("name"), text.rlike(R.QUOTE).alias("_q")))
    s = sentences.select("article_id", "paragraph", "sentence", F.explode_outer(F.array(told)).alias("_m")).filter("_m.name is not null").select(
        "article_id", "_m.*", F.struct("paragraph", "sentence").alias("_at"))
    # the places of a speaker in one article are fewer than its sentences, which came as one text
    per = s.groupBy("article_id", "name").agg(
        F.count_if("_q").alias("direct_quote_count"), F.count_if(~F.col("_q")).alias("indirect_attribution_count"), F.slice(F.array_sort(F.collect_list("_at")), 1, keep).alias("locators"))
    return per.select("article_id", "name", source_role(F.col("name"), roles).alias("role"), "direct_quote_count", "indirect_attribution_count", "locators")


def descriptor_signals(sentences: DataFrame, generic: Sequence = R.GENERIC_FRAMES, policy: Sequence = R.POLICY_DESCRIPTORS, minimum_terms: int = 2) -> DataFrame:
    """Sentences carrying each descriptor: enough distinct lemmas or a strong pattern; with its share of sentences."""
    # of the lemmas of a sentence only those that a rule names are kept
    named = sorted({t for _, terms, _ in policy for t in terms})
    s = sentences.withColumn("lemmas", content_lemmas_among(F.col("text"), named)) if named else sentences
    text = F.col("text")
    tests = [F.when(text.rlike(p), F.struct(F.lit("generic").alias("kind"), F.lit(c).alias("code"))) for c, p in generic]
    for code, terms, strong in policy:
        hit = text.rlike(strong)
        if terms:
            hit = hit | (F.size(F.array_intersect("lemmas", F.array(*[F.lit(t) for t in terms]))) >= minimum_terms)
        tests.append(F.when(hit, F.struct(F.lit("policy").alias("kind"), F.lit(code).alias("code"))))
    found = s.select("article_id", F.explode_outer(F.array_compact(F.array(*tests))).alias("x")).filter("x is not null").select("article_id", "x.*")
    totals = sentences.groupBy("article_id").agg(F.count(F.lit(1)).alias("_t"))
    per = found.groupBy("article_id", "kind", "code").agg(F.count(F.lit(1)).alias("sentence_count"))
    return per.join(totals, "article_id").select("article_id", "kind", "code", "sentence_count", C.half_up(C.ratio(F.col("sentence_count"), F.col("_t")), 3).alias("share_of_sentences"))


def _signal_counts(sentences: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Per article, number of sentences matching each rule (wide: one column per rule)."""
    return sentences.groupBy("article_id").agg(*[F.count_if(F.col("text").rlike(p)).alias(c) for c, p in rules])


def context_depth(sentences: DataFrame, signals: Sequence = R.CONTEXT_SIGNALS) -> DataFrame:
    """Context score (each signal counts up to three sentences, eight points each) and level."""
    counts = _signal_counts(sentences, signals)
    score = F.least(F.lit(100), sum((F.least(F.lit(3), F.col(c)) * 8 for c, _ in signals), F.lit(0))).cast("bigint")
    return counts.withColumn("score", score).withColumn(
        "level", F.when(F.col("score") >= 55, "deep").when(F.col("score") >= 25, "moderate").otherwise("shallow"))


def scope_profile(sentences: DataFrame, episodic: str = R.EPISODIC, thematic: str = R.THEMATIC) -> DataFrame:
    c = _signal_counts(sentences, (("episodic", episodic), ("thematic", thematic)))
    e, t = F.col("episodic"), F.col("thematic")
    return c.withColumn("scope", F.when((e > 0) & (t > 0), F.when(e >= 2 * t, "episodic").when(2 * e <= t, "thematic").otherwise("mixed"))
                        .when(e > 0, "episodic").when(t > 0, "thematic").otherwise("not_observed"))


def genre(articles: DataFrame, sentences: DataFrame, title_genres: Sequence = R.TITLE_GENRES, lead_interview: str = R.LEAD_INTERVIEW) -> DataFrame:
    """Genre by explicit markers in the title, or a question-and-answer lead."""
    lead = top_per_key(sentences, ["article_id"], [F.col("paragraph"), F.col("sentence")], 3).groupBy("article_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "sentence", "text"))), lambda x: x["text"]), " ").alias("_lead"))
    heading = X.normalize_text(F.col("title"))
    j = articles.select("article_id", heading.alias("_h")).join(lead, "article_id", "left")
    out = F.when(F.col("_h").rlike(title_genres[0][1]), title_genres[0][0])
    for code, pattern in title_genres[1:]:
        hit = F.col("_h").rlike(pattern)
        if code == "interview":
            hit = hit | F.coalesce(F.col("_lead").rlike(lead_interview), F.lit(False))
        out = out.when(hit, code)
    return j.select("article_id", out.otherwise("straight_news").alias("genre"))


def framing_devices(articles: DataFrame, sentences: DataFrame, devices: Sequence = R.DEVICES, headline: str = R.EVALUATIVE_HEADLINE, lead: int = 2) -> DataFrame:
    """Devices used in each article, how often, and whether in its lead."""
    # an article has few sentences: its order is worked out in its own group, over locators only
    heads = top_per_key(sentences.select("article_id", "paragraph", "sentence"), ["article_id"], [F.col("paragraph"), F.col("sentence")], lead).withColumn("_lead", F.lit(True))
    text = F.col("text")
    found = sentences.select("article_id", "paragraph", "sentence", F.explode_outer(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(c)) for c, p in devices]))).alias("device")).filter("device is not null")
    rows = found.join(heads, ["article_id", "paragraph", "sentence"], "left").groupBy("article_id", "device").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("_lead"), F.lit(False)).alias("appears_in_lead"))
    titled = articles.filter(X.normalize_text(F.col("title")).rlike(headline)).select("article_id").join(sentences.select("article_id").distinct(), "article_id", "left_semi")
    return rows.unionByName(titled.select("article_id", F.lit("evaluative_headline").alias("device"), F.lit(1).cast("bigint").alias("n"), F.lit(True).alias("appears_in_lead")))


def association_pairs(sentences: DataFrame, concepts: Sequence = R.CONTROLLED_CONCEPTS, k: int = 12) -> DataFrame:
    """Concepts named in the same sentence, most frequent pairs per article. The pairs of a sentence come
    from the fixed concept list, so their number is bounded by it."""
    codes = sorted(concepts)
    tests = [(a, b, F.col("text").rlike(pa) & F.col("text").rlike(pb)) for i, (a, pa) in enumerate(codes) for b, pb in codes[i + 1:]]
    pairs = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))) for a, b, hit in tests]))
    counts = sentences.select("article_id", F.explode_outer(pairs).alias("p")).filter("p is not null").groupBy("article_id", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("sentence_count"))
    return top_per_key(counts, ["article_id"], [F.col("sentence_count").desc(), F.concat_ws(":", "a", "b")], k, "position")


def profile_violations(items: DataFrame, statuses: DataFrame, dimensions: Sequence[str] = R.DIMENSIONS) -> DataFrame:
    """Rule violations of profiles: (article_id, violation) rows."""
    voices = ("journalist_narration", "direct_quote", "uncertain_quote", "indirect_source")
    rules = [
        ("bad_hash", ~F.coalesce(F.col("sentence_sha256").rlike(C.HEX64), F.lit(False))),
        ("bad_locator", F.coalesce((F.col("paragraph") < 1) | (F.col("sentence") < 1), F.lit(True))),
        ("bad_voice", ~F.coalesce(F.col("voice_kind").isin(*voices), F.lit(False))),
        ("bad_family", ~F.coalesce(F.col("frame_family").rlike("^[a-z0-9_]{2,80}$"), F.lit(False))),
        ("bad_dimension", ~F.coalesce(F.col("dimension").isin(*dimensions), F.lit(False))),
    ]
    per_item = items.select("article_id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules]))).alias("violation"))
    have = items.groupBy("article_id", "dimension").agg(F.count_if(F.col("voice_kind") == "journalist_narration").alias("_n"))
    j = statuses.join(have, ["article_id", "dimension"], "left")
    right = F.when(F.col("_n").isNull(), "not_observed").when(F.col("_n") > 0, "observed").otherwise("source_attributed")
    return per_item.unionByName(j.filter(F.col("status") != right).select("article_id", F.lit("bad_status").alias("violation")))


def public_evidence(*tables: DataFrame) -> DataFrame:
    """Distinct evidence locators over every section of a profile."""
    keys = ["article_id", "paragraph", "sentence", "sentence_sha256"]
    out = tables[0].select(*keys)
    for df in tables[1:]:
        out = out.unionByName(df.select(*keys))
    return out.filter((F.col("paragraph") >= 1) & (F.col("sentence") >= 1)).dropDuplicates(keys)


def public_profile(results: DataFrame, sentences: DataFrame) -> DataFrame:
    """Model results (claims with character spans) as claims with evidence locators: a span must lie in
    one sentence of its article; claims without located evidence are left out."""
    from pressgrain.operators.textops import evidence_in_sentence

    spans = results.withColumn("span_id", F.col("claim_id"))
    fits = evidence_in_sentence(spans, sentences).filter("fits").select("claim_id", "article_id", "dimension", "frame_family", "start", "end")
    width = 512
    s = sentences.select("article_id", "paragraph", "sentence", F.col("start").alias("s0"), F.col("end").alias("s1"), "text",
                         F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("_b"))
    located = fits.withColumn("_b", F.floor(F.col("start") / width)).join(s, ["article_id", "_b"]).filter((F.col("s0") <= F.col("start")) & (F.col("end") <= F.col("s1")))
    return located.select("claim_id", "article_id", "dimension", "frame_family", "paragraph", "sentence",
                          C.evidence_fingerprint_located(F.col("article_id"), F.col("paragraph"), F.col("sentence"), F.col("text")).alias("sentence_sha256"))


def profile_audit(statuses: DataFrame, items: DataFrame, mentions: DataFrame, descriptors: DataFrame, terms: DataFrame) -> DataFrame:
    """One row of batch totals over profiles."""
    from pressgrain.operators.common import scalar

    n = F.count_distinct("article_id")
    bad = items.filter(~F.col("sentence_sha256").rlike(C.HEX64) | (F.col("paragraph") < 1) | (F.col("sentence") < 1))
    return statuses.agg(n.alias("profiles"), F.count_if(F.col("status") == "observed").alias("observed_dimensions")).select(
        "*", scalar(items, F.count(F.lit(1))).alias("items"), scalar(mentions, n).alias("profiles_with_sources"), scalar(descriptors, n).alias("profiles_with_descriptors"),
        scalar(terms, n).alias("profiles_with_terms"), scalar(bad, F.count(F.lit(1))).alias("invalid_evidence"))


def analyze(sentences: DataFrame, analyzer: Analyzer | None = None, **rules) -> DataFrame:
    """Frame items of a sentence table by the default rules or by an injected analyzer with the same output."""
    return analyzer(sentences) if analyzer else frame_items(voiced_matches(sentences, **rules))
