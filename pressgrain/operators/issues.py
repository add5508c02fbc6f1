"""Scores, titles and reports of issues, from their membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressgrain.functions import columns as C, text as X
from pressgrain.lexicons import korean as K
from pressgrain.operators.common import top_per_key
from pressgrain.operators.windows import SECONDARY_CATEGORIES, agenda_rank

# fixed values: labels of the agenda concepts
CONCEPT_LABELS = {"supplementary-investigation-authority": "보완수사권 제도 논쟁", "platform-terms-fees": "플랫폼 약관·수수료 정책"}
# fixed values: who and what, for headlines too short to stand alone
TITLE_GROUPS = (
    ("국민의힘 지도부", "국힘|국민의힘|원내지도부"),
    ("민주당", "민주당|더불어민주당"),
    ("정부", "정부|대통령실|대통령"),
    ("검경 수사팀", "검찰|경찰|수사본부"),
    ("쿠팡", "쿠팡"),
)
TITLE_PEOPLE = (("권영진 의원", "권영진"), ("정점식 의원", "정점식"), ("한동훈 대표", "한동훈"), ("이재명 대표", "이재명"), ("윤석열 대통령", "윤석열"))
# fixed value: endings of labels too general to replace a headline
GENERIC_LABEL = "(동향|관련 보도|주요 의제)$"
TITLE_ACTIONS = (
    ("내부 갈등 및 충돌", "멱살|충돌|공방|대립|내홍|소동|파문"),
    ("거취 표명 요구", "거취|사퇴|퇴진"),
    ("수사 진행", "수사|조사|기소|영장|체포"),
    ("운영 정책 논란", "수수료|가격|인상|해지|위반|제재|조사"),
    ("정책 동향", "정책|지원|대책|개편|추진"),
)
TITLE_NOISE = ("멱살", "소동", "파문", "속보")
# fixed values: wording of the report line
REPORT_BODY = "%d건 중 본문 분석 %d건과 제목에서 %s 관련 표현 단서를 확인했습니다. 구조화 프레임 판정 전 단계입니다."
REPORT_TITLE = "%d개 언론사의 %d건 제목에서 %s 관련 표현이 상대적으로 자주 관측됐습니다. 기사 본문에 대한 판단이 아닙니다."
REPORT_NONE = "기사 제목에서 공개할 수 있는 프레임 신호가 확인되지 않았습니다."
FRAME_LABELS = {"conflict": "갈등·대립", "responsibility": "책임 소재", "economy": "경제·생활", "law": "법·제도", "policy": "정책 효과", "citizen": "시민 영향"}


def placement_score(members: DataFrame, observations: DataFrame, keys: Sequence[str] = ("issue_id",)) -> DataFrame:
    """Mean zone weight per article, then mean over the observed articles; articles without any
    observation fall back to their own placement column. Null when nothing was observed."""
    per = observations.groupBy("article_id").agg(F.avg(C.zone_weight(F.col("zone"))).alias("_avg"), F.count(F.lit(1)).alias("_obs"))
    j = members.select(*keys, "article_id", "homepage_placement").join(per, "article_id", "left")
    own = C.zone_weight(F.col("homepage_placement"))
    value = F.when(F.col("_obs").isNotNull(), F.col("_avg")).otherwise(own)
    n_obs = F.coalesce(F.col("_obs"), own.isNotNull().cast("bigint"))
    return j.groupBy(*keys).agg(F.avg(value).alias("placement"), F.count(value).alias("placement_observed"), F.sum(n_obs).alias("observations"))


def issue_components(members: DataFrame, configured_groups: int, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Size, breadth, diversity, volume (against the largest issue of the run) and repeat share."""
    per = members.groupBy(*keys, "issue_id").agg(
        F.count(F.lit(1)).alias("article_count"), F.count_distinct("source_id").alias("source_count"),
        F.count_distinct(F.coalesce("media_group_id", "source_id")).alias("group_count"))
    if keys:
        largest = per.groupBy(*keys).agg(F.max("article_count").alias("_max"))
        per = per.join(largest, list(keys))
    else:
        per = per.withColumn("_max", per.agg(F.max("article_count")).scalar())
    n = F.col("article_count")
    return per.withColumns({
        "diversity": F.least(F.lit(100.0), F.col("group_count") / F.lit(float(max(1, configured_groups))) * 100.0),
        "volume": F.least(F.lit(100.0), F.log1p(n.cast("double")) / F.log1p(F.col("_max").cast("double")) * 100.0),
        "follow_up": F.when(n > 1, (n - F.col("source_count")) / (n - 1) * 100.0).otherwise(0.0),
    }).drop("_max")


def issue_cohesion(members: DataFrame, keys: Sequence[str] = ("issue_id",)) -> DataFrame:
    """Cohesion score and quality label from similarities to the representative."""
    per = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("similarity").alias("_min"), F.avg("similarity").alias("_avg"))
    label = F.when(F.col("_n") < 2, "insufficient_evidence").when(F.col("_min") >= 0.35, "cohesive").otherwise("review_required")
    return per.select(*keys, C.half_up((F.col("_min") * 0.35 + F.col("_avg") * 0.65) * 100.0, 1).alias("cohesion_score"), label.alias("cluster_quality"))


def frame_signal_share(members: DataFrame, articles: DataFrame, frames=K.FRAME_KEYWORDS) -> DataFrame:
    """Per issue and frame: share of articles with any keyword in body or title, with the first evidence
    article (a body hit before a title hit, then id)."""
    def hits(col: str) -> Column:
        return X.classes_containing(F.coalesce(F.col(col), F.lit("")), frames)

    texts = articles.select("article_id", hits("body_text").alias("_b"), hits("title").alias("_t"))
    rows = members.select("issue_id", "article_id").join(texts, "article_id")
    total = rows.groupBy("issue_id").agg(F.count(F.lit(1)).alias("_n"))
    one = rows.select("issue_id", "article_id", "_b", F.explode(F.array_union("_b", "_t")).alias("frame"))
    in_body = F.array_contains("_b", F.col("frame"))
    per = one.groupBy("issue_id", "frame").agg(
        F.count(F.lit(1)).alias("articles"), F.count_if(in_body).alias("body_articles"),
        F.min_by("article_id", F.struct((~in_body).cast("int"), F.col("article_id"))).alias("evidence_article_id"))
    spine = total.select("issue_id", "_n", F.explode(F.array(*[F.lit(k) for k, _ in frames])).alias("frame"))
    out = spine.join(per, ["issue_id", "frame"], "left")
    status = F.when(F.col("body_articles") > 0, "body_signal_detected").when(F.col("articles") > 0, "headline_signal_detected").otherwise("not_detected")
    return out.select("issue_id", "frame", F.coalesce("articles", F.lit(0)).alias("articles"),
                      C.half_up(F.coalesce("articles", F.lit(0)) / F.col("_n") * 100.0, 1).alias("score"), "evidence_article_id", status.alias("status"))


def issue_report(issues: DataFrame, frame_rows: DataFrame, body_counts: DataFrame, labels=FRAME_LABELS, order=tuple(FRAME_LABELS)) -> DataFrame:
    """Report line of each issue from its strongest detected frame."""
    rank = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("frame"))
    strongest = frame_rows.filter(F.col("status") != "not_detected").groupBy("issue_id").agg(F.min_by("frame", F.struct(-F.col("score"), rank)).alias("frame"))
    name = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    j = issues.join(strongest, "issue_id", "left").join(body_counts.select("issue_id", "body_articles"), "issue_id", "left")
    label = F.try_element_at(name, F.col("frame"))
    bodies = F.coalesce("body_articles", F.lit(0))
    line = (
        F.when(F.col("frame").isNull(), REPORT_NONE)
        .when(bodies > 0, F.format_string(REPORT_BODY, "article_count", bodies, label))
        .otherwise(F.format_string(REPORT_TITLE, "source_count", "article_count", label)))
    return j.select("issue_id", line.alias("summary"))


def issue_title(members: DataFrame, articles: DataFrame, suffixes: DataFrame, concept_rules=K.CONCEPTS, labels=CONCEPT_LABELS,
                groups=TITLE_GROUPS, people=TITLE_PEOPLE, actions=TITLE_ACTIONS, stopwords: Sequence[str] = K.STOPWORDS) -> DataFrame:
    """Issue title: the leading concept's label, else the representative's cleaned headline when it is
    readable, else who and what, else its first tokens with the issue's suffix.

    The leading concept is the one of most titles, of equals the first met in article and rule order. Who, what and tokens are
    read from the title as ``headline_text`` cleans it.
    """
    rows = members.join(articles.select("article_id", "title"), "article_id")
    rep = rows.filter("is_representative").select("issue_id", "title")
    found = rows.select("issue_id", "article_id", F.explode(X.concepts(X.nfkc(F.col("title")), concept_rules)).alias("concept"))
    place = F.array_position(F.array(*[F.lit(r[0]) for r in concept_rules]), F.col("concept"))
    counts = found.groupBy("issue_id", "concept").agg(F.count(F.lit(1)).alias("n"), F.min("article_id").alias("first"))
    leading = counts.groupBy("issue_id").agg(F.min_by("concept", F.struct(-F.col("n"), F.col("first"), place)).alias("concept"))
    clean = X.headline_text(F.col("title"))
    j = rep.join(leading, "issue_id", "left").join(suffixes, "issue_id", "left").withColumns({
        "clean": clean, "headline": X.headline_cleanup(F.col("title")), "tokens": X.title_tokens(clean, stopwords)})
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("concept")) if labels else F.lit(None).cast("string")
    named = [F.when(F.contains("clean", F.lit(p)), name) for name, p in people]
    who = F.array_join(F.array_compact(F.array(X.first_rule(F.col("clean"), groups), *named)), "·")
    what = F.array_join(F.array_compact(F.array(*[F.when(F.col("clean").rlike(p), name) for name, p in actions])), " ")
    words = F.filter("tokens", lambda w: ~w.isin(*TITLE_NOISE))
    first = F.array_join(F.slice(words, 1, 3), " ")
    title = (
        F.when(label.isNotNull() & ~label.rlike(GENERIC_LABEL), label)
        .when(F.length("headline") >= 8, F.col("headline"))
        .when((who != "") & (what != ""), F.concat_ws(" ", who, what))
        .when(F.size(words) >= 2, F.concat_ws(" ", first, F.coalesce("suffix", F.lit("관련 보도"))))
        .when(F.col("headline") != "", F.col("headline"))
        .when(F.col("clean") != "", F.col("clean"))
        .otherwise("주요 이슈"))
    return j.select("issue_id", title.alias("issue_title"))


def issue_table(members: DataFrame, articles: DataFrame, observations: DataFrame, titles: DataFrame, categories: DataFrame,
                configured_sources: int, configured_groups: int, max_issues: int | None = None, secondary: Sequence[str] = SECONDARY_CATEGORIES) -> DataFrame:
    """Ranked issues of each run. ``members`` carries run, issue_id, article_id, similarity and the
    representative flag; ids are unique over runs. With ``max_issues`` only the first of each run are returned."""
    m = members.join(articles.select("article_id", "source_id", "media_group_id", "homepage_placement"), "article_id")
    parts = issue_components(m, configured_groups)
    out = parts.join(placement_score(m, observations), "issue_id").join(issue_cohesion(members), "issue_id").join(titles, "issue_id").join(categories, "issue_id")
    score = C.weighted_agenda_score(F.col("diversity"), F.col("volume"), F.col("placement"), F.col("follow_up"), F.col("source_count"), F.lit(configured_sources))
    scored = out.withColumns({
        "agenda_score": score, "title": F.col("issue_title"),
        "score_status": F.when(F.col("placement_observed") > 0, "observed_components").otherwise("placement_excluded")})
    return agenda_rank(scored, ("run",), max_issues, secondary).drop("issue_title")


def title_key_groups(articles: DataFrame, max_articles: int, min_outlets: int = 2) -> DataFrame:
    """Cheap candidate clusters for a review packet: same leading title words, several outlets, widest
    first, until the packet holds ``max_articles`` rows (the last group is cut, but never to one row).

    Only group counts are put in order, and no more than ``max_articles`` of them can matter.
    """
    keyed = articles.withColumn("title_key", X.candidate_title_key(F.col("title"))).filter(F.col("title_key") != "")
    groups = keyed.groupBy("title_key").agg(
        F.count(F.lit(1)).alias("articles"), F.count_distinct("source_id").alias("outlets"), F.min("article_id").alias("_first")).filter(F.col("outlets") >= min_outlets)
    order = [F.col("outlets").desc(), F.col("articles").desc(), F.col("_first")]
    head = groups.orderBy(*order).limit(max_articles)
    before = F.coalesce(F.sum("articles").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = head.withColumns({"case_no": F.row_number().over(Window.orderBy(*order)), "_take": F.least(F.col("articles"), F.lit(max_articles) - before)})
    head = head.filter(F.col("_take") >= 2)
    ranked = top_per_key(keyed.join(head, "title_key"), ["title_key"], [F.col("source_id"), F.col("article_id")], max_articles, "position")
    return ranked.filter(F.col("position") <= F.col("_take")).select("case_no", "title_key", "article_id", "source_id")
