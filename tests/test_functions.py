"""Golden cases of scalar and text functions."""

from pyspark.sql import functions as F

from pressgrain.functions import columns as C, rules as R, text as X
from pressgrain.lexicons import korean as K


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(col.alias("x")).first()["x"]


def test_title_tokens_strip_particles_and_split_roles(spark):
    got = one(spark, X.title_tokens(F.col("t")), t="[단독] 홍길동검찰총장이 국회에서 사퇴를 발표했다 123")
    assert got[:3] == ["홍길동검찰총장", "홍길동", "검찰총장"]
    assert "국회" in got and "사퇴" in got


def test_nfkc_and_title_key(spark):
    assert one(spark, X.title_key(F.col("t")), t="ＡＢＣ １２ 뉴스!") == "abc12뉴스"


def test_hangul_particle(spark):
    assert one(spark, C.hangul_particle(F.col("w"), "은", "는"), w="정책") == "정책은"
    assert one(spark, C.hangul_particle(F.col("w"), "은", "는"), w="정부") == "정부는"


def test_morphology(spark):
    got = one(spark, F.flatten(F.transform(X.morph_units(F.col("t")), lambda u: X.morph_struct(u))), t="정부가 정책을 강화했다 지지하지 않는다 1,000")
    lemmas = [(r["lemma"], r["pos"]) for r in got]
    assert ("정부", "noun") in lemmas and ("가", "particle") in lemmas
    assert ("강화하다", "predicate") in lemmas and ("1000", "number") in lemmas


def test_category(spark):
    cat = lambda s, t: one(spark, X.category_classify(F.col("s"), F.col("t")), s=s, t=t)
    assert cat("정치", "무엇") == "정치"
    assert cat("야구", "무엇") == K.CATEGORY_SPORTS
    assert cat("연예", "무엇") is None
    assert cat("", "금리 인상에 물가 걱정") == "경제"


def test_headline_cleanup(spark):
    assert one(spark, X.headline_cleanup(F.col("t")), t="[속보] 검찰 수사 재수사 확대…파장") == "검찰 재수사 확대 파장"


def test_unobserved_placement_renormalizes(spark):
    s = lambda p: one(spark, C.weighted_agenda_score(F.lit(80.0), F.lit(50.0), F.lit(p).cast("double"), F.lit(0.0), F.lit(12), F.lit(12)))
    assert s(None) == 66.5  # (44 + 12.5 + 0) / .85
    assert s(100) == 71.5


def test_decode_entities_once(spark):
    assert one(spark, X.decode_entities(F.col("t")), t="a &amp;lt; b &quot;c&quot; &#65;&#x42;") == 'a &lt; b "c" AB'
    assert one(spark, X.decode_entities(F.col("t")), t="a &amp;lt; b") == "a &lt; b"


def test_reader_questions_and_claims(spark):
    assert one(spark, R.clean_claim_text(F.col("t")), t="주장 [P1S2]  입니다 (p3:s1).") == "주장 입니다."
    assert one(spark, R.marker_block(F.col("t")), t="진보 진영") == "ideology"


def test_pair_metrics_half(spark):
    from pressgrain.operators import quality as G, sets as U

    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d")], "group_id int, article_id string")
    pred = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (2, "e")], "group_id int, article_id string")
    m = G.pairwise_metrics(U.pair_confusion(gold, pred)).first()
    assert (m["precision"], m["recall"], m["f1"], m["over_merge"], m["under_merge"]) == (0.5, 0.5, 0.5, 0.5, 0.5)


def test_sets_of_every_size_have_one_digest_formula(spark):
    import hashlib

    from pressgrain.operators.common import set_digest

    def expected(values):
        slots = {}
        for v in sorted(values):
            slots.setdefault(hashlib.sha256(v.encode()).hexdigest()[:3], []).append(v)
        return hashlib.sha256("\n".join(hashlib.sha256("\n".join(slots[k]).encode()).hexdigest() for k in sorted(slots)).encode()).hexdigest()

    for n in (1, 500, 10_001):
        df = spark.range(n).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("v"))
        got = set_digest(df.repartition(7).union(df), ["g"], "v").first()
        assert (got["set_size"], got["set_digest"]) == (n, expected([str(i) for i in range(n)]))
