"""Frame profiles: voice, roles and the one-vote rules, with the default Korean rules."""

from pyspark.sql import functions as F

from pressgrain.operators import compare as M, framing as P, textops as T


def profile(spark, *bodies):
    arts = spark.createDataFrame([(i, f"제목 {i}", b) for i, b in enumerate(bodies)], "article_id bigint, title string, body_text string")
    s = T.segment_sentences(arts)
    return arts, P.frame_items(P.voiced_matches(s))


def test_quoted_claim_is_not_narration(spark):
    _, items = profile(spark, "김철수 장관은 \"정책의 실패가 분명하다\"고 말했다. 정책 집행의 실패가 드러났다.")
    got = {(r["code"], r["voice_kind"], r["speaker_role"]) for r in items.collect()}
    assert ("policy_implementation_problem", "direct_quote", "government_official") in got
    assert ("policy_implementation_problem", "journalist_narration", None) in got


def test_same_code_once_per_voice(spark):
    _, items = profile(spark, "정책의 실패가 드러났다. 정책의 실패가 또 드러났다. 정책의 실패가 계속됐다.")
    assert items.filter("code = 'policy_implementation_problem'").count() == 1


def test_patterns_count_articles_not_spans(spark):
    arts, items = profile(spark, "정책의 실패가 드러났다.", "정책의 실패가 드러났다. 제도의 혼선도 있었다.")
    m = arts.select(F.lit(1).alias("issue_id"), "article_id", F.col("article_id").cast("string").alias("source_id"), F.lit("g").alias("media_group_id"))
    p = M.axis_patterns(M.with_issue(items, m)).filter("code = 'policy_implementation_problem'").first()
    assert p["article_count"] == 2


def test_quote_aware_sentences(spark):
    texts = [
        (1, '그는 "간다. 온다." 말했다. 끝이다.\n\n둘째 문단.'), (2, "《가. 나. 다》 이다. 끝."), (3, "닫는” 것. 먼저. “열린 것. 끝.\n새 줄. 또.\n \n\n 문단. 끝."),
        (4, "“가 ‘나. 다’ 라. 마” 바. 사."), (5, ""), (6, None), (7, "\n\n  가.  나. ")]
    rows = T.segment_sentences_quoted(spark.createDataFrame(texts, "article_id int, body_text string")).orderBy("article_id", "start").collect()
    got = {i: [(r["paragraph"], r["sentence"], r["text"]) for r in rows if r["article_id"] == i] for i, _ in texts}
    assert got[1] == [(1, 1, '그는 "간다. 온다." 말했다.'), (1, 2, "끝이다."), (2, 1, "둘째 문단.")]
    assert got[2] == [(1, 1, "《가. 나. 다》 이다."), (1, 2, "끝.")]
    assert got[3] == [(1, 1, "닫는” 것."), (1, 2, "먼저."), (1, 3, "“열린 것. 끝."), (1, 4, "새 줄. 또."), (2, 1, "문단."), (2, 2, "끝.")]
    assert got[4] == [(1, 1, "“가 ‘나. 다’ 라. 마” 바."), (1, 2, "사.")]
    assert got[5] == got[6] == []
    assert got[7] == [(2, 1, "가."), (2, 2, "나.")]
    by_id = dict(texts)
    assert all(by_id[r["article_id"]][r["start"]:r["end"]] == r["text"] for r in rows)


def test_an_unnamed_speaker_is_one_however_it_is_spaced(spark):
    texts = ['검찰관계자는 "수사 중이다"라고 말했다.', '검찰 관계자가 "수사 중이다"라고 말했다.', '검찰  관계자는 "수사 중이다"라고 밝혔다.', '박영희 장관은 "그렇다"고 말했다.']
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(P.speaker_extract(F.col("text"))).collect()] == ["검찰 관계자"] * 3 + ["박영희 장관"]
