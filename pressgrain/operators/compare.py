"""Comparison of frame profiles across the outlets of one issue.

``items`` below always means frame items joined to their issue (issue_id, source_id, media_group_id).
Pairs are only ever formed between patterns, and patterns come from the rule list, so their number per
issue and dimension is fixed by the rules and not by the number of articles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressgrain.functions import columns as C
from pressgrain.lexicons.frames import DIMENSIONS, OFFICIAL_ROLES
from pressgrain.operators.clusters import complete_link_clusters
from pressgrain.operators.common import top_per_key


def dimension_order(col: Column, dimensions: Sequence[str] = DIMENSIONS) -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in dimensions]), col)


def with_issue(rows: DataFrame, members: DataFrame) -> DataFrame:
    return rows.join(members.select("issue_id", "article_id", "source_id", "media_group_id"), "article_id")


def axis_patterns(items: DataFrame) -> DataFrame:
    """Per issue, dimension and (variant, voice scope): distinct articles, outlets, media groups, claims."""
    return items.groupBy("issue_id", "dimension", "variant_key", "voice_scope").agg(
        F.min("code").alias("code"),
        F.count_distinct("article_id").alias("article_count"),
        F.count_distinct("claim_id").alias("claim_count"),
        F.array_sort(F.collect_set("source_id")).alias("outlets"),
        F.array_sort(F.collect_set("media_group_id")).alias("groups"),
    )


def axis_evidence(items: DataFrame, keep: int = 8) -> DataFrame:
    """First evidence of each pattern, in article and sentence order."""
    return top_per_key(items, ["issue_id", "dimension", "variant_key", "voice_scope"], [F.col("article_id"), F.col("paragraph"), F.col("sentence")], keep, "position")


def comparison_axes_simple(items: DataFrame) -> DataFrame:
    """Simpler axes: one pattern per (scope, family), with distinct articles and distinct evidence."""
    return items.groupBy("issue_id", "dimension", "voice_scope", "code").agg(
        F.count_distinct("article_id").alias("article_count"), F.count_distinct("source_id").alias("outlet_count"),
        F.count_distinct("article_id", "paragraph", "sentence").alias("evidence_count"))


def axis_observation_counts(statuses: DataFrame) -> DataFrame:
    s = F.col("status")
    return statuses.groupBy("issue_id", "dimension").agg(
        F.count_if(s != "not_observed").alias("observed"), F.count_if(s == "observed").alias("narration"),
        F.count_if(s == "source_attributed").alias("source_only"), F.count_if(s == "not_observed").alias("not_observed"))


def _quoted(mentions: DataFrame) -> DataFrame:
    return mentions.filter(F.col("direct_quote_count") + F.col("indirect_attribution_count") > 0)


def source_role_lens(mentions: DataFrame, members: DataFrame) -> DataFrame:
    """Per role: articles, outlets, quote sums and the gap between the outlets' presence rates.

    An outlet without the role counts as rate 0, which needs no outlet x role table: it is enough to
    know that fewer outlets have the role than the issue has.
    """
    m = _quoted(mentions)
    per_outlet = members.groupBy("issue_id", "source_id").agg(F.count_distinct("article_id").alias("_n"))
    outlets = per_outlet.groupBy("issue_id").agg(F.count(F.lit(1)).alias("_outlets"))
    by = m.groupBy("issue_id", "role", "source_id").agg(F.count_distinct("article_id").alias("_a")).join(per_outlet, ["issue_id", "source_id"])
    rates = by.withColumn("_rate", C.ratio(F.col("_a"), F.col("_n"))).groupBy("issue_id", "role").agg(
        F.max("_rate").alias("_hi"), F.min("_rate").alias("_lo"), F.count(F.lit(1)).alias("outlet_count"))
    direct, indirect = F.col("direct_quote_count") > 0, F.col("indirect_attribution_count") > 0
    sums = m.groupBy("issue_id", "role").agg(
        F.count_distinct("article_id").alias("article_count"),
        F.count_distinct(F.when(direct, F.col("article_id"))).alias("direct_articles"),
        F.count_distinct(F.when(indirect, F.col("article_id"))).alias("indirect_articles"),
        F.sum("direct_quote_count").alias("direct_quote_count"), F.sum("indirect_attribution_count").alias("indirect_attribution_count"))
    j = sums.join(rates, ["issue_id", "role"]).join(outlets, "issue_id")
    low = F.when(F.col("outlet_count") < F.col("_outlets"), F.lit(0.0)).otherwise(F.col("_lo"))
    return j.withColumn("presence_gap", C.half_up(F.col("_hi") - low, 3)).drop("_hi", "_lo", "_outlets")


def source_lens_by_outlet(mentions: DataFrame, members: DataFrame, official: Sequence[str] = OFFICIAL_ROLES, affected: str = "affected_person") -> DataFrame:
    """Per outlet: share of sourced articles with an official voice, and presence of affected people."""
    m = _quoted(mentions).groupBy("issue_id", "source_id").agg(
        F.count_distinct("article_id").alias("source_articles"),
        F.count_distinct(F.when(F.col("role").isin(*official), F.col("article_id"))).alias("_off"),
        F.count_distinct(F.when(F.col("role") == affected, F.col("article_id"))).alias("_aff"))
    base = members.groupBy("issue_id", "source_id").agg(F.count_distinct("article_id").alias("article_count"))
    j = base.join(m, ["issue_id", "source_id"], "left")
    return j.select("issue_id", "source_id", "article_count", F.coalesce("source_articles", F.lit(0)).alias("source_articles"),
                    C.half_up(C.ratio(F.col("_off"), F.col("source_articles")), 3).alias("official_share"),
                    C.half_up(C.ratio(F.coalesce("_aff", F.lit(0)), F.col("article_count")), 3).alias("affected_rate"))


def source_lens_flat(mentions: DataFrame) -> DataFrame:
    """Per outlet and role: mentions, where an actor without quotes still counts once."""
    n = F.greatest(F.col("direct_quote_count") + F.col("indirect_attribution_count"), F.lit(1))
    return mentions.groupBy("issue_id", "source_id", "role").agg(F.sum(n).alias("mentions"))


def frame_lens(descriptors: DataFrame, members: DataFrame, kind: str = "generic") -> DataFrame:
    """Per outlet and label: articles, share of its articles, share of its label counts, sentences."""
    base = members.groupBy("issue_id", "source_id").agg(F.count_distinct("article_id").alias("_n"))
    per = descriptors.filter(F.col("kind") == kind).groupBy("issue_id", "source_id", "code").agg(
        F.count_distinct("article_id").alias("article_count"), F.sum("sentence_count").alias("sentence_count"))
    all_labels = per.groupBy("issue_id", "source_id").agg(F.sum("article_count").alias("_all"))
    j = per.join(base, ["issue_id", "source_id"]).join(all_labels, ["issue_id", "source_id"])
    return j.select("issue_id", "source_id", "code", "article_count", "sentence_count",
                    C.half_up(C.ratio(F.col("article_count"), F.col("_n")), 3).alias("article_share"), C.half_up(C.ratio(F.col("article_count"), F.col("_all")), 3).alias("composition_share"))


def reporting_style_lens(items: DataFrame, scopes: DataFrame, members: DataFrame, negative: Sequence[str], positive: Sequence[str]) -> DataFrame:
    """Per outlet: mean evaluation index of its own narration and mean scope index, null when abstained."""
    ev = items.filter(F.col("dimension") == "moral_evaluation")
    told = F.col("voice_scope") == "narration"
    per = ev.groupBy("issue_id", "source_id", "article_id").agg(
        F.count_if(told & F.col("code").isin(*negative)).alias("_n"), F.count_if(told & F.col("code").isin(*positive)).alias("_p"), F.count_if(~told).alias("_a"))
    idx = C.ratio(F.col("_p") - F.col("_n"), F.col("_p") + F.col("_n"))
    ev_out = per.groupBy("issue_id", "source_id").agg(
        F.avg(idx).alias("_e"), F.count_if(F.col("_n") > F.col("_p")).alias("critical"), F.count_if(F.col("_p") > F.col("_n")).alias("supportive"),
        F.count_if((F.col("_n") + F.col("_p") == 0) & (F.col("_a") > 0)).alias("attributed_only"))
    e, t = F.col("episodic"), F.col("thematic")
    sc = members.select("issue_id", "source_id", "article_id").join(scopes.select("article_id", "episodic", "thematic"), "article_id").groupBy("issue_id", "source_id").agg(
        F.avg(C.ratio(t - e, t + e)).alias("_s"))
    base = members.groupBy("issue_id", "source_id").agg(F.count_distinct("article_id").alias("article_count"))
    j = base.join(ev_out, ["issue_id", "source_id"], "left").join(sc, ["issue_id", "source_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("issue_id", "source_id", "article_count", C.half_up(F.col("_e"), 3).alias("evaluation_index"), C.half_up(F.col("_s"), 3).alias("scope_index"),
                    zero("critical"), zero("supportive"), zero("attributed_only"))


def morphology_lens(terms: DataFrame, content_tokens: DataFrame, min_articles: int = 2, min_groups: int = 2, k: int = 15) -> DataFrame:
    """Terms of several articles and media groups; per outlet its rate per thousand content tokens.

    Terms are brought together once, by issue and term, where their articles, groups and counts are seen at once. An outlet's rates are in the order of its
    counts, so its first ``k`` terms are chosen before its total is joined.
    """
    met = terms.groupBy("issue_id", "term").agg(
        F.size(F.collect_set("article_id")).alias("_a"), F.size(F.collect_set("media_group_id")).alias("_g"), F.collect_list(F.struct("source_id", "n")).alias("_x"))
    ok = met.filter((F.col("_a") >= min_articles) & (F.col("_g") >= min_groups)).select("issue_id", "term", F.explode("_x").alias("_x"))
    n = ok.select("issue_id", "_x.source_id", "term", "_x.n").groupBy("issue_id", "source_id", "term").agg(F.sum("n").alias("n"))
    total = content_tokens.groupBy("issue_id", "source_id").agg(F.sum("content_token_count").alias("_t"))
    first = top_per_key(n, ["issue_id", "source_id"], [F.col("n").desc(), F.col("term")], k, "position")
    return first.join(total, ["issue_id", "source_id"]).select(
        "issue_id", "source_id", "term", "n", C.half_up(C.ratio(F.col("n"), F.col("_t")) * 1000.0, 3).alias("per_thousand"), "position")


def dominant_secondary(descriptors: DataFrame, k: int = 5) -> DataFrame:
    per = descriptors.groupBy("issue_id", "code").agg(F.count_distinct("article_id").alias("article_count"))
    return top_per_key(per, ["issue_id"], [F.col("article_count").desc(), F.col("code")], k, "position")


def source_dominance(items: DataFrame, genres: DataFrame, members: DataFrame) -> DataFrame:
    """Share of distinct (article, dimension, scope) observations that are attributed; flagged only for
    issues of at least two straight-news articles."""
    seen = items.select("issue_id", "article_id", "dimension", "voice_scope").distinct().groupBy("issue_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("voice_scope") == "source").alias("attributed"))
    base = members.select("issue_id", "article_id").join(genres, "article_id", "left").groupBy("issue_id").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_and(F.coalesce(F.col("genre") == "straight_news", F.lit(False))).alias("_straight"))
    j = base.join(seen, "issue_id", "left")
    share = F.coalesce(C.ratio(F.col("attributed"), F.col("total")), F.lit(0.0))
    return j.select("issue_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("attributed", F.lit(0)).alias("attributed"), C.half_up(share, 3).alias("attributed_share"),
                    ((F.col("_n") >= 2) & F.col("_straight") & (share >= 0.7)).alias("detected"))


def value_counts(rows: DataFrame, value: str) -> DataFrame:
    """Articles per value of a profile field in each issue, most frequent first."""
    per = rows.groupBy("issue_id", F.col(value).alias("value")).agg(F.count_distinct("article_id").alias("n"))
    w = Window.partitionBy("issue_id").orderBy(F.col("n").desc(), "value")
    return per.withColumn("position", F.row_number().over(w))


def claim_fold(voiced: DataFrame) -> DataFrame:
    """All evidence rows of a claim folded to one: evidence count, distinct sentences, first place."""
    return voiced.groupBy("article_id", "dimension", "code", "voice_kind").agg(
        F.count(F.lit(1)).alias("evidence_count"), F.count_distinct("paragraph", "sentence").alias("sentences"),
        F.min(F.struct("paragraph", "sentence")).alias("_f")).select(
        "article_id", "dimension", "code", "voice_kind", "evidence_count", "sentences", "_f.paragraph", "_f.sentence")


def article_view(items: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Per article and dimension: first family, first narrated family, narrated and attributed items."""
    at = F.struct("paragraph", "sentence", "rule_no")
    told = F.col("voice_scope") == "narration"
    return items.groupBy("issue_id", "source_id", "article_id", "dimension").agg(
        F.min_by("code", at).alias("family"), F.min_by("code", F.when(told, at)).alias("narrated_family"),
        F.count_if(told).alias("narrated"), F.count_if(~told).alias("attributed"))


def mode_with_tie(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per key (smallest on ties), its count, and whether the second is as frequent."""
    per = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    two = top_per_key(per, list(keys), [F.col("n").desc(), F.col("value")], 2, "_r")
    return two.groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, F.col("value"))).alias("value"), F.max("n").alias("n"),
        F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("n"))) == F.max("n"), F.lit(False)).alias("tie"))


def outlet_view(views: DataFrame) -> DataFrame:
    """Per outlet and dimension: its leading family over all items, and over its own narration."""
    keys = ["issue_id", "source_id", "dimension"]
    lead = mode_with_tie(views, keys, "family").select(*keys, F.col("value").alias("lead"), F.col("tie").alias("lead_tie"))
    own = mode_with_tie(views, keys, "narrated_family").select(*keys, F.col("value").alias("lead_narrated"), F.col("tie").alias("narrated_tie"))
    return lead.join(own, keys, "left")


def layer_view(items: DataFrame, statuses: DataFrame) -> DataFrame:
    """Per issue and dimension: narrated and attributed items, silent articles, and how many different
    leading families the outlets have, with and without their sources."""
    keys = ["issue_id", "source_id", "dimension"]
    marked = items.join(statuses.select("article_id", "dimension", "status"), ["article_id", "dimension"])
    counts = marked.groupBy("issue_id", "dimension").agg(
        F.count_if(F.col("status") == "observed").alias("narrated_items"), F.count_if(F.col("status") == "source_attributed").alias("attributed_items"))
    silent = statuses.groupBy("issue_id", "dimension").agg(F.count_if(F.col("status") == "not_observed").alias("not_observed"))
    own = mode_with_tie(marked.filter(F.col("status") == "observed"), keys, "code").groupBy("issue_id", "dimension").agg(
        F.count_distinct("value").alias("outlet_kinds"), F.count(F.lit(1)).alias("narrated_outlets"))
    every = mode_with_tie(marked, keys, "code").groupBy("issue_id", "dimension").agg(F.count_distinct("value").alias("outlet_kinds_with_sources"))
    j = silent
    for df in (counts, own, every):
        j = j.join(df, ["issue_id", "dimension"], "left")
    return j.select("issue_id", "dimension", "not_observed", *[F.coalesce(c, F.lit(0)).alias(c) for c in (
        "narrated_items", "attributed_items", "outlet_kinds", "narrated_outlets", "outlet_kinds_with_sources")])


def frame_clusters(views: DataFrame, members: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Articles grouped by their five leading families; where each group differs from the largest one."""
    wide = views.groupBy("issue_id", "article_id").pivot("dimension", list(dimensions)).agg(F.first("family"))
    rows = members.select("issue_id", "article_id", "source_id").join(wide, ["issue_id", "article_id"], "left")
    groups = rows.groupBy("issue_id", *dimensions).agg(F.count(F.lit(1)).alias("articles"), F.count_distinct("source_id").alias("outlets"))
    groups = groups.withColumn("signature", F.concat_ws("|", *[F.coalesce(d, F.lit("-")) for d in dimensions]))
    base = groups.groupBy("issue_id").agg(F.min_by(F.struct(*dimensions), F.struct(-F.col("articles"), F.col("signature"))).alias("_b"))
    j = groups.join(base, "issue_id")
    both = [F.when(F.col(d).isNotNull() & F.col(f"_b.{d}").isNotNull() & (F.col(d) != F.col(f"_b.{d}")), F.lit(d)) for d in dimensions]
    one = [F.when(F.col(d).isNull() != F.col(f"_b.{d}").isNull(), F.lit(d)) for d in dimensions]
    return j.select("issue_id", "signature", "articles", "outlets", F.array_join(F.array_compact(F.array(*both)), ",").alias("differs_at"), F.array_join(F.array_compact(F.array(*one)), ",").alias("partial_at"))


def day_rollup(members: DataFrame) -> DataFrame:
    """Articles, outlets and spread per day, per (day, issue) and per (day, issue, outlet)."""
    r = members.rollup("day", "issue_id", "source_id").agg(
        F.count(F.lit(1)).alias("articles"), F.count_distinct("source_id").alias("outlets"), F.grouping_id().alias("level"))
    return r.filter(F.col("day").isNotNull()).withColumn("spread", C.half_up(C.ratio(F.col("outlets"), F.col("articles")), 3))


def day_layers(days: DataFrame, views: DataFrame) -> DataFrame:
    """Per day and dimension: in how many issues the outlets' own leading families differ (and with sources)."""
    o = outlet_view(views)
    per = o.groupBy("issue_id", "dimension").agg(F.count_distinct("lead_narrated").alias("_own"), F.count_distinct("lead").alias("_all"))
    return days.select("day", "issue_id").distinct().join(per, "issue_id").groupBy("day", "dimension").agg(
        F.count_if(F.col("_own") >= 2).alias("split"), F.count_if(F.col("_all") >= 2).alias("split_with_sources"))


# -- contrasts between patterns -------------------------------------------------------------------

def _narrated(patterns: DataFrame) -> DataFrame:
    return patterns.filter(F.col("voice_scope") == "narration")


def _pattern_pairs(p: DataFrame) -> DataFrame:
    """Ordered pattern pairs of an (issue, dimension); bounded by the rule list."""
    w = Window.partitionBy("issue_id", "dimension").orderBy(F.col("article_count").desc(), "code", "variant_key")
    ranked = p.withColumn("pos", F.row_number().over(w))
    cols = ["variant_key", "article_count", "groups", "pos"]
    a = ranked.select("issue_id", "dimension", *[F.col(c).alias(f"l_{c}") for c in cols])
    b = ranked.select("issue_id", "dimension", *[F.col(c).alias(f"r_{c}") for c in cols])
    return a.join(b, ["issue_id", "dimension"]).filter(F.col("l_pos") < F.col("r_pos"))


def divergence_pair(patterns: DataFrame, observed: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """First pattern pair of the first dimension in which both sides have a media group of their own."""
    pairs = _pattern_pairs(_narrated(patterns)).filter(
        (F.size(F.array_except("l_groups", "r_groups")) > 0) & (F.size(F.array_except("r_groups", "l_groups")) > 0))
    j = pairs.join(observed.select("issue_id", "dimension", "observed"), ["issue_id", "dimension"])
    order = [dimension_order(F.col("dimension"), dimensions), F.col("observed").desc(), F.col("l_pos"), F.col("r_pos")]
    return top_per_key(j, ["issue_id"], order).select("issue_id", "dimension", F.col("l_variant_key").alias("left_variant"), F.col("r_variant_key").alias("right_variant"))


def pattern_overlap(items: DataFrame) -> DataFrame:
    """Articles shared by two narrated patterns of a dimension; pairs arise inside one article only."""
    n = items.filter(F.col("voice_scope") == "narration").select("issue_id", "dimension", "article_id", "variant_key").distinct()
    a, b = n.withColumnRenamed("variant_key", "va"), n.withColumnRenamed("variant_key", "vb")
    return a.join(b, ["issue_id", "dimension", "article_id"]).filter(F.col("va") < F.col("vb")).groupBy("issue_id", "dimension", "va", "vb").agg(F.count(F.lit(1)).alias("shared"))


def _with_overlap(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Adds article overlap (Jaccard) and union size to pattern pairs."""
    o = pattern_overlap(items)
    keyed = pairs.withColumns({"va": F.least("l_variant_key", "r_variant_key"), "vb": F.greatest("l_variant_key", "r_variant_key")})
    j = keyed.join(o, ["issue_id", "dimension", "va", "vb"], "left").drop("va", "vb")
    shared = F.coalesce("shared", F.lit(0))
    union = F.col("l_article_count") + F.col("r_article_count") - shared
    return j.withColumns({"union_articles": union, "overlap": F.coalesce(C.ratio(shared, union), F.lit(0.0))}).drop("shared")


def observed_contrast(patterns: DataFrame, items: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """First pair whose articles overlap less than .85 and which spans two media groups."""
    pairs = _with_overlap(_pattern_pairs(_narrated(patterns)), items)
    ok = pairs.filter((F.col("overlap") < 0.85) & (F.size(F.array_union("l_groups", "r_groups")) >= 2))
    order = [dimension_order(F.col("dimension"), dimensions), F.col("l_pos"), F.col("r_pos")]
    return top_per_key(ok, ["issue_id"], order).select("issue_id", "dimension", F.col("l_variant_key").alias("left_variant"), F.col("r_variant_key").alias("right_variant"),
                                                       C.half_up(F.col("overlap"), 3).alias("overlap"))


def common_ground(patterns: DataFrame, members: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """First narrated pattern, in dimension order, carried by at least 60% of the issue's articles."""
    n = members.groupBy("issue_id").agg(F.count_distinct("article_id").alias("_n"))
    ok = _narrated(patterns).join(n, "issue_id").filter(F.col("article_count") >= F.greatest(F.lit(2), F.ceil(F.col("_n") * F.lit(0.6))))
    order = [dimension_order(F.col("dimension"), dimensions), F.col("article_count").desc(), F.col("code")]
    return top_per_key(ok, ["issue_id"], order).select("issue_id", "dimension", "variant_key", "article_count")


def issue_map_pair(patterns: DataFrame, items: DataFrame, members: DataFrame, dimension: str = "problem_definition") -> DataFrame:
    """Best axis of an issue: harmonic coverage of two patterns times one minus their article overlap."""
    n = members.groupBy("issue_id").agg(F.count_distinct("article_id").alias("_n"))
    p = _narrated(patterns).filter((F.col("dimension") == dimension) & (F.col("article_count") >= 2))
    j = _with_overlap(_pattern_pairs(p), items).join(n, "issue_id")
    lc, rc = C.ratio(F.col("l_article_count"), F.col("_n")), C.ratio(F.col("r_article_count"), F.col("_n"))
    cover = F.lit(2.0) * lc * rc / (lc + rc)
    j = j.withColumns({
        "balanced_coverage": C.half_up(cover, 3), "axis_strength": C.half_up(cover * (F.lit(1.0) - F.col("overlap")), 3),
        "smaller": F.least("l_article_count", "r_article_count")})
    order = [F.col("axis_strength").desc(), F.col("smaller").desc(), F.col("union_articles").desc(), F.concat_ws(":", "l_variant_key", "r_variant_key")]
    return top_per_key(j, ["issue_id"], order).select("issue_id", F.col("l_variant_key").alias("left_variant"), F.col("r_variant_key").alias("right_variant"),
                                                      "balanced_coverage", C.half_up(F.col("overlap"), 3).alias("overlap"), "axis_strength", F.col("union_articles").alias("covered_articles"))


def issue_map_outlets(axis: DataFrame, items: DataFrame, members: DataFrame, dominance: DataFrame, dimension: str = "problem_definition") -> DataFrame:
    """Outlet positions on the issue's axis, one vote per article; withheld when the issue is too small,
    has no axis or is dominated by its sources."""
    base = members.groupBy("issue_id").agg(F.count_distinct("article_id").alias("_a"), F.count_distinct("source_id").alias("_o"), F.count_distinct("media_group_id").alias("_g"))
    gate = base.join(axis, "issue_id", "left").join(dominance.select("issue_id", "detected"), "issue_id", "left")
    reason = (
        F.when(F.col("_a") < 4, "too_few_articles").when(F.col("_o") < 3, "too_few_outlets").when(F.col("_g") < 2, "too_few_media_groups")
        .when(F.coalesce("detected", F.lit(False)), "source_dominated").when(F.col("left_variant").isNull(), "no_axis"))
    gate = gate.select("issue_id", "left_variant", "right_variant", reason.alias("withheld"))
    votes = items.filter((F.col("voice_scope") == "narration") & (F.col("dimension") == dimension)).join(gate, "issue_id").groupBy("issue_id", "article_id").agg(
        F.bool_or(F.col("variant_key") == F.col("left_variant")).alias("_l"), F.bool_or(F.col("variant_key") == F.col("right_variant")).alias("_r"))
    rows = members.select("issue_id", "article_id", "source_id").join(votes, ["issue_id", "article_id"], "left")
    left, right = F.coalesce("_l", F.lit(False)), F.coalesce("_r", F.lit(False))
    per = rows.groupBy("issue_id", "source_id").agg(
        F.count(F.lit(1)).alias("article_count"), F.count_if(left & ~right).alias("left_articles"), F.count_if(left & right).alias("mixed_articles"), F.count_if(right & ~left).alias("right_articles"))
    n = F.col("left_articles") + F.col("mixed_articles") + F.col("right_articles")
    score = C.half_up(C.ratio(F.col("right_articles") - F.col("left_articles"), n), 3)
    kind = F.when(n < 2, "insufficient").when(score <= F.lit(-1.0) / 3, "left").when(score >= F.lit(1.0) / 3, "right").otherwise("mixed")
    j = per.join(gate.select("issue_id", "withheld"), "issue_id")
    shown = F.col("withheld").isNull()
    return j.select("issue_id", "source_id", "article_count", "left_articles", "mixed_articles", "right_articles", "withheld",
                    F.when(shown, kind).alias("classification"), F.when(shown, score).alias("score"), F.when(shown, C.half_up(F.lit(50.0) + F.lit(40.0) * score, 1)).alias("display_position"))


def spectrum(views: DataFrame, dimension: str = "problem_definition") -> DataFrame:
    """Outlets between the two most common leading families of a dimension; needs two families."""
    v = views.filter((F.col("dimension") == dimension) & F.col("family").isNotNull())
    per = v.groupBy("issue_id", "family").agg(F.count(F.lit(1)).alias("_n"))
    poles = top_per_key(per, ["issue_id"], [F.col("_n").desc(), F.col("family")], 2, "_r").groupBy("issue_id").agg(
        F.max(F.when(F.col("_r") == 1, F.col("family"))).alias("left_family"), F.max(F.when(F.col("_r") == 2, F.col("family"))).alias("right_family")).filter(F.col("right_family").isNotNull())
    marks = v.join(poles, "issue_id").groupBy("issue_id", "source_id", "left_family", "right_family").agg(
        F.count_if(F.col("family") == F.col("left_family")).alias("_l"), F.count_if(F.col("family") == F.col("right_family")).alias("_r"), F.bool_or(F.col("narrated") > 0).alias("narrated"))
    return marks.filter(F.col("_l") + F.col("_r") > 0).select(
        "issue_id", "source_id", "left_family", "right_family", C.half_up(C.ratio(F.col("_r"), F.col("_l") + F.col("_r")), 3).alias("position"),
        (F.col("_l") + F.col("_r")).alias("article_count"), ((F.col("_l") > 0) & (F.col("_r") > 0)).alias("both"), "narrated")


# -- narratives -----------------------------------------------------------------------------------

def narrative_signatures(items: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """(signatures, articles): articles of an issue with the same narrated variants in every dimension are
    one weighted signature, so equal articles never meet in pairs."""
    told = items.filter(F.col("voice_scope") == "narration")
    sets = told.groupBy("issue_id", "article_id").agg(*[
        F.array_sort(F.collect_set(F.when(F.col("dimension") == d, F.col("variant_key")))).alias(d) for d in dimensions])
    keyed = sets.withColumn("signature_id", F.sha2(F.to_json(F.struct(*dimensions)), 256))
    sig = keyed.groupBy("issue_id", "signature_id").agg(F.count(F.lit(1)).alias("weight"), F.min("article_id").alias("first_article"), *[F.first(d).alias(d) for d in dimensions])
    return sig, keyed.select("issue_id", "article_id", "signature_id")


def narrative_compatible(signatures: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Signature pairs sharing a problem key, matching in two other dimensions and conflicting in none."""
    problem, rest = dimensions[0], dimensions[1:]
    s = signatures.select("issue_id", "signature_id", "first_article", *dimensions)
    keys = s.select("issue_id", "signature_id", "first_article", F.explode(problem).alias("key"))
    met = keys.toDF("issue_id", "a", "fa", "key").join(keys.toDF("issue_id", "b", "fb", "key"), ["issue_id", "key"]).filter(F.col("fa") > F.col("fb")).select("issue_id", "a", "b").distinct()
    l = s.select("issue_id", F.col("signature_id").alias("a"), *[F.col(d).alias(f"l_{d}") for d in rest])
    r = s.select("issue_id", F.col("signature_id").alias("b"), *[F.col(d).alias(f"r_{d}") for d in rest])
    j = met.join(l, ["issue_id", "a"]).join(r, ["issue_id", "b"])
    seen = {d: (F.size(f"l_{d}") > 0) & (F.size(f"r_{d}") > 0) for d in rest}
    match = sum((F.when(seen[d] & F.arrays_overlap(f"l_{d}", f"r_{d}"), 1).otherwise(0) for d in rest), F.lit(0))
    clash = sum((F.when(seen[d] & ~F.arrays_overlap(f"l_{d}", f"r_{d}"), 1).otherwise(0) for d in rest), F.lit(0))
    return j.select("issue_id", "a", "b", match.alias("matching"), clash.alias("conflicting")).withColumn("compatible", (F.col("matching") >= 2) & (F.col("conflicting") == 0))


def agreeing_signatures(signatures: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """(issue_id, src, dst) of the compatible pairs of ``narrative_compatible``, by first articles, the later one first.

    Such a pair shares a problem key and a value in each of two other dimensions, so signatures meet under these three values together, and
    those that only share a problem never do.
    """
    problem, rest = dimensions[0], dimensions[1:]
    named = lambda d: F.transform(F.col(d), lambda v: F.struct(F.lit(d).alias("d"), v.alias("v")))
    values = F.flatten(F.array(*[named(d) for d in rest]))
    two = F.flatten(F.transform("values", lambda x: F.transform(F.filter("values", lambda y: y["d"] > x["d"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    keys = signatures.withColumn("values", values).select("issue_id", "first_article", F.explode(problem).alias("problem"), two.alias("two")).select("issue_id", "first_article", "problem", F.explode("two").alias("two"))
    met = keys.withColumnRenamed("first_article", "src").join(keys.withColumnRenamed("first_article", "dst"), ["issue_id", "problem", "two"]).filter(F.col("src") > F.col("dst")).select("issue_id", "src", "dst").distinct()
    side = lambda name, s: signatures.select("issue_id", F.col("first_article").alias(name), *[F.col(d).alias(f"{s}_{d}") for d in rest])
    j = met.join(side("src", "l"), ["issue_id", "src"]).join(side("dst", "r"), ["issue_id", "dst"])
    for d in rest:
        j = j.filter((F.size(f"l_{d}") == 0) | (F.size(f"r_{d}") == 0) | F.arrays_overlap(f"l_{d}", f"r_{d}"))
    return j.select("issue_id", "src", "dst")


def narrative_clusters(signatures: DataFrame, pairs: DataFrame) -> DataFrame:
    """(issue_id, signature_id, group_no): complete-link groups of signatures, in order of their first articles; a signature enters the group that
    then holds most articles. ``pairs`` are (issue_id, src, dst) of ``agreeing_signatures``; a group is named by its first article."""
    units = signatures.select(F.col("issue_id").alias("run"), F.col("first_article").alias("unit_id"), "weight", F.lit(0).alias("title_chars"), F.array().cast("array<string>").alias("idx"))
    edges = pairs.select(F.col("issue_id").alias("run"), "src", "dst", F.lit(0.0).alias("similarity"), F.lit(True).alias("indexed"))
    grown = complete_link_clusters(units, edges, by_size=True)
    return signatures.select("issue_id", "signature_id", "first_article").join(
        grown.select(F.col("run").alias("issue_id"), F.col("unit_id").alias("first_article"), F.col("cluster_id").alias("group_no")), ["issue_id", "first_article"]).drop("first_article")


def narratives(items: DataFrame, members: DataFrame, dimensions: Sequence[str] = DIMENSIONS, top: int = 2) -> DataFrame:
    """Best narratives of each issue: a dominant clause per dimension (two articles, no tie, 60% support),
    a problem clause and at least two others."""
    sig, placed = narrative_signatures(items, dimensions)
    from pressgrain.session import cut_lineage

    sig, placed = cut_lineage(sig), cut_lineage(placed)
    groups = cut_lineage(narrative_clusters(sig, agreeing_signatures(sig, dimensions)))
    rows = placed.join(groups, ["issue_id", "signature_id"]).select("issue_id", "group_no", "article_id")
    told = items.filter(F.col("voice_scope") == "narration").select("issue_id", "article_id", "dimension", "variant_key").distinct()
    j = told.join(rows, ["issue_id", "article_id"])
    observed = j.groupBy("issue_id", "group_no", "dimension").agg(F.count_distinct("article_id").alias("_obs"))
    per = j.groupBy("issue_id", "group_no", "dimension", "variant_key").agg(F.count_distinct("article_id").alias("n"))
    two = top_per_key(per, ["issue_id", "group_no", "dimension"], [F.col("n").desc(), F.col("variant_key")], 2, "_r")
    first = two.groupBy("issue_id", "group_no", "dimension").agg(
        F.max(F.when(F.col("_r") == 1, F.col("variant_key"))).alias("variant"), F.max("n").alias("n"), F.max(F.when(F.col("_r") == 2, F.col("n"))).alias("_second"))
    clause = first.join(observed, ["issue_id", "group_no", "dimension"]).filter(
        (F.col("n") >= 2) & (F.coalesce("_second", F.lit(0)) < F.col("n")) & (C.ratio(F.col("n"), F.col("_obs")) >= 0.6))
    wide = clause.groupBy("issue_id", "group_no").pivot("dimension", list(dimensions)).agg(F.first("variant"))
    others = sum((F.col(d).isNotNull().cast("int") for d in dimensions[1:]), F.lit(0))
    sizes = rows.join(members.select("issue_id", "article_id", "source_id", "media_group_id"), ["issue_id", "article_id"]).groupBy("issue_id", "group_no").agg(
        F.count(F.lit(1)).alias("article_count"), F.count_distinct("source_id").alias("outlet_count"), F.count_distinct("media_group_id").alias("group_count"), F.min("article_id").alias("first_article"))
    ok = wide.filter(F.col(dimensions[0]).isNotNull() & (others >= 2)).withColumn("completeness", (others + 1) / F.lit(float(len(dimensions)))).join(sizes, ["issue_id", "group_no"])
    ok = ok.filter(F.col("article_count") >= 2)
    order = [F.col("article_count").desc(), F.col("outlet_count").desc(), F.col("completeness").desc(), F.col("group_count").desc(), F.col("first_article")]
    return top_per_key(ok, ["issue_id"], order, top, "narrative_no").drop("group_no")


def reader_questions(narrative_rows: DataFrame, axis: DataFrame, lens: DataFrame, statuses: DataFrame, dimensions: Sequence[str] = DIMENSIONS, k: int = 3) -> DataFrame:
    """Up to three question triggers per issue, by priority."""
    a = narrative_rows.filter("narrative_no = 1").select("issue_id", *[F.col(d).alias(f"a_{d}") for d in dimensions])
    b = narrative_rows.filter("narrative_no = 2").select("issue_id", *[F.col(d).alias(f"b_{d}") for d in dimensions])
    differ = sum((F.coalesce((F.col(f"a_{d}") != F.col(f"b_{d}")).cast("int"), F.lit(0)) for d in dimensions), F.lit(0))
    rows = a.join(b, "issue_id").filter(differ >= 2).select("issue_id", F.lit(0).alias("priority"), F.lit("narrative-contrast").alias("question_id"))
    rows = rows.unionByName(axis.select("issue_id", F.lit(1).alias("priority"), F.lit("problem-definition-contrast").alias("question_id")))
    affected = F.col("role") == "affected_person"
    gap = top_per_key(lens.filter(F.col("presence_gap") >= 0.5), ["issue_id"], [affected.cast("int").desc(), F.col("presence_gap").desc(), F.col("article_count").desc(), F.col("role")])
    rows = rows.unionByName(gap.select("issue_id", F.when(affected, 2).otherwise(3).alias("priority"), F.concat(F.lit("source-gap-"), "role").alias("question_id")))
    seen = F.col("status") != "not_observed"
    per = statuses.groupBy("issue_id", "dimension").agg(
        F.count_distinct(F.when(seen, F.col("source_id"))).alias("_p"), F.count_distinct(F.when(~seen, F.col("source_id"))).alias("_a"), F.count_if(F.col("status") == "observed").alias("_n"))
    context = per.filter((F.col("_p") >= 2) & (F.col("_a") >= 1) & (F.col("_n") >= 1)).select(
        "issue_id", (F.lit(3) + dimension_order(F.col("dimension"), dimensions)).cast("int").alias("priority"), F.concat(F.lit("context-gap-"), "dimension").alias("question_id"))
    return top_per_key(rows.unionByName(context), ["issue_id"], [F.col("priority"), F.col("question_id")], k, "position")


# -- synthesis ------------------------------------------------------------------------------------

def camp_key(problem: Column, treatment: Column) -> Column:
    return (
        F.when(problem == "legal_institutional", "legal_institutional").when(treatment.isNull(), "no_treatment")
        .when(treatment == "institutional_check", "institutional_check").when(treatment != "", treatment)
        .otherwise(F.coalesce(F.nullif(problem, F.lit("")), F.lit("other"))))


def camps(views: DataFrame, members: DataFrame, k: int = 4) -> DataFrame:
    """Articles of an issue by camp, with the leading article of each camp; the largest ones."""
    fam = views.groupBy("issue_id", "article_id").agg(
        F.max(F.when(F.col("dimension") == "problem_definition", F.col("family"))).alias("_p"), F.max(F.when(F.col("dimension") == "treatment_recommendation", F.col("family"))).alias("_t"))
    j = members.select("issue_id", "article_id", "source_id").join(fam, ["issue_id", "article_id"])
    per = j.withColumn("camp", camp_key(F.col("_p"), F.col("_t"))).groupBy("issue_id", "camp").agg(
        F.count(F.lit(1)).alias("articles"), F.count_distinct("source_id").alias("outlets"), F.min("article_id").alias("lead_article"))
    return top_per_key(per, ["issue_id"], [F.col("articles").desc(), F.col("camp")], k, "position")


def agreement_lines(views: DataFrame) -> DataFrame:
    """Per dimension: agreed when the observing articles show one family, else split."""
    return views.filter(F.col("family").isNotNull()).groupBy("issue_id", "dimension").agg(
        F.count_distinct("family").alias("families"), F.count(F.lit(1)).alias("articles"), F.min("family").alias("_f")).select(
        "issue_id", "dimension", "families", "articles", F.when(F.col("families") == 1, "fact").otherwise("split").alias("line"), F.when(F.col("families") == 1, F.col("_f")).alias("family"))


def bound_claims(claims: DataFrame, cited: DataFrame, index: DataFrame, ideology: Sequence[str], internal: Sequence[str] = ()) -> DataFrame:
    """Status of generated claims: review_needed for a forbidden marker anywhere in the text, insufficient_evidence
    without bound evidence, else observed with its cleaned text, shortened for display."""
    from pressgrain.functions.rules import clean_claim_text, marker_block
    from pressgrain.operators.joins import evidence_bind

    bound = evidence_bind(cited, index).groupBy("claim_id").agg(F.count(F.lit(1)).alias("evidence"))
    j = claims.join(bound, "claim_id", "left").withColumn("_t", clean_claim_text(F.col("text"), None))
    n = F.coalesce("evidence", F.lit(0))
    status = F.when(marker_block(F.col("_t"), ideology, internal).isNotNull(), "review_needed").when((n == 0) | (F.col("_t") == ""), "insufficient_evidence").otherwise("observed")
    return j.select("claim_id", n.alias("evidence"), status.alias("status"), F.when(status == "observed", clean_claim_text(F.col("_t"))).alias("text"))


def comparison_withheld(issues: DataFrame, signatures: DataFrame, approvals: DataFrame) -> DataFrame:
    """Withhold a comparison whose cluster needs review unless the exact URL set was approved."""
    ok = approvals.select("set_digest").distinct().withColumn("_ok", F.lit(True))
    j = issues.join(signatures.select("issue_id", "set_digest"), "issue_id", "left").join(ok, "set_digest", "left")
    approved = F.coalesce("_ok", F.lit(False))
    withheld = (F.col("cluster_quality") == "review_required") & ~approved
    return j.select("issue_id", "cluster_quality", withheld.alias("withheld"), F.when(approved, "approved_same_event").when(~withheld, "automatic_cohesive").alias("cluster_status"))


def comparison_summary(members: DataFrame, divergence: DataFrame, common: DataFrame, dominance: DataFrame, axis: DataFrame) -> DataFrame:
    """One row per issue with the fields of its short summary."""
    base = members.groupBy("issue_id").agg(F.count_distinct("article_id").alias("articles"), F.count_distinct("source_id").alias("outlets"))
    j = base.join(divergence.select("issue_id", F.col("dimension").alias("divergence_dimension")), "issue_id", "left")
    j = j.join(common.select("issue_id", F.col("variant_key").alias("common_variant")), "issue_id", "left")
    j = j.join(dominance.select("issue_id", "attributed_share", F.col("detected").alias("source_dominated")), "issue_id", "left")
    return j.join(axis.select("issue_id", "axis_strength"), "issue_id", "left")
