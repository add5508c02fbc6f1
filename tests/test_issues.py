from pyspark.sql import functions as F

from pressgrain.operators import issues as I


def test_issue_table_has_every_issue_of_a_run(spark):
    n = 130
    members = spark.createDataFrame([("r", i, f"a{i}-{k}", 0.9, k == 0) for i in range(n) for k in range(2)], "run string, issue_id long, article_id string, similarity double, is_representative boolean")
    articles = members.select("article_id", F.concat(F.lit("s"), F.right("article_id", F.lit(1))).alias("source_id"), F.lit("g").alias("media_group_id"), F.lit("top").alias("homepage_placement"))
    observations = spark.createDataFrame([], "article_id string, zone string")
    titles = spark.createDataFrame([(i, f"title {i}") for i in range(n)], "issue_id long, issue_title string")
    categories = titles.select("issue_id", F.lit("politics").alias("category"))
    args = (members, articles, observations, titles, categories, 10, 10)
    assert sorted(r["agenda_rank"] for r in I.issue_table(*args).collect()) == list(range(1, n + 1))
    assert I.issue_table(*args, max_issues=80).count() == 80


def test_issue_titles_in_the_order_of_their_rules(spark):
    rows = [
        (1, "a1", "쿠팡 수수료", True), (2, "b1", "[속보] 한동훈 사퇴", True), (3, "c1", "검찰 보완수사권 논란", True), (3, "c2", "보완수사권 폐지 논의", False),
        (4, "d1", "짧다 둘", True), (5, "e1", "...", True), (6, "f1", "국회 본회의 예산안 처리 놓고 여야 공방", True)]
    members = spark.createDataFrame([(i, a, r) for i, a, _, r in rows], "issue_id int, article_id string, is_representative boolean")
    articles = spark.createDataFrame([(a, t) for _, a, t, _ in rows], "article_id string, title string")
    suffixes = spark.createDataFrame([(4, "갈등")], "issue_id int, suffix string")
    labels = {"x": "정책 동향", "y": "권한 논쟁"}
    got = {r["issue_id"]: r["issue_title"] for r in I.issue_title(members, articles, suffixes, (("y", ("보완수사권",)), ("x", ("예산안",))), labels).collect()}
    assert got == {1: "쿠팡 운영 정책 논란", 2: "한동훈 대표 거취 표명 요구", 3: "권한 논쟁", 4: "짧다 둘", 5: "주요 이슈", 6: "국회 본회의 예산안 처리 놓고 여야 공방"}
