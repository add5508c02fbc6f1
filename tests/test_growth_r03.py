"""Text steps of the findings of round 3: every pattern runs once, only what has to move is shuffled, and results are as by the plain rules."""

import random

from pyspark.sql import functions as F

from pressgrain.functions import text as X
from pressgrain.operators import framing as P, retrieval as A, textops as T
from pressgrain.plans import QUERIES, q_framing as Q

BASE = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sentences(spark):
    rows = [(1, 1, i, t) for i, t in enumerate(("Anna the “and x” ation y", "Anna the bring c", "Bert of all", "Leau Carl and “so it is”", None), 1)]
    return spark.createDataFrame(rows, "article_id bigint, paragraph bigint, sentence bigint, text string")


def test_patterns_of_rules_are_tried_once(spark):
    assert plan(P.rule_matches(sentences(spark), Q.RULES)).count("regexp_instr") == len(Q.RULES)


def test_mentions_take_one_pass(spark):
    got = P.source_mentions(sentences(spark), Q.speaker, Q.REPORTING, Q.ATTRIBUTION, Q.ROLES, keep=1)
    assert "Join" not in plan(got)
    rows = {r["name"]: (r["role"], r["direct_quote_count"], r["indirect_attribution_count"], [tuple(x) for x in r["locators"]]) for r in got.collect()}
    assert rows == {"Anna": ("anonymous_official", 1, 1, [(1, 1)]), "Carl": ("anonymous_official", 1, 0, [(1, 4)])}


def test_terms_are_counted_where_their_article_lies(spark):
    s = T.segment_sentences(spark.createDataFrame([(1, "aa bb aa. cc 12 aa"), (2, "bb."), (3, None)], "article_id bigint, body_text string"))
    got = T.article_terms(s)
    assert plan(got).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, T.morph_terms(T.morph_tokens(s)).collect()))
    assert plan(QUERIES["top_terms"](spark, BASE)).count("Exchange hashpartitioning") == 1


def test_answers_join_tokens_only(spark, monkeypatch):
    q = spark.createDataFrame([(i, f"alpha beta{i % 3} gamma") for i in range(6)], "question_id bigint, question string")
    p = spark.createDataFrame([(i, f"alpha beta{i % 4}", "x", i % 5) for i in range(40)], "pattern_id bigint, text string, dimension string, article_count bigint")
    whole = sorted(map(tuple, A.rule_answer(q, p, (("y", "beta2"),)).collect()))
    monkeypatch.setattr(A, "PAIRS", 30)
    small = A.rule_answer(q, p, (("y", "beta2"),))
    assert plan(small).count("Join") == 1 and ", 9)" in plan(small)  # 240 pairs in parts of 30
    assert whole and sorted(map(tuple, small.collect())) == whole


def test_cheaper_steps_give_the_same_texts(spark):
    rnd = random.Random(3)
    bits = [" ", "  ", "\t", "\n", "\r\n", "\r", " ", "\u0085", "​", "a", "b.", "c!”", "。", "？", "<b>", "<script>x</script>", "é", "@", "x@y.zz", "www.", "http://", "9", "-", ".", "가"]
    rows = [("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))),) for _ in range(3000)] + [(None,)]
    df = spark.createDataFrame(rows, "t string")
    t = F.col("t")
    out = t
    for p, r in ((r"\r\n?", "\n"), (r"(?is)<script\b[^>]*>.*?</script>", " "), (r"(?is)<style\b[^>]*>.*?</style>", " "), (r"<[^>]+>", " "), ("[​-‍﻿]", ""),
                 (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        out = F.regexp_replace(out, p, r)
    cut = F.filter(F.transform(F.regexp_extract_all(t, F.lit(X.SENTENCE), F.lit(0)), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) >= 2)
    clean = F.regexp_replace(F.regexp_replace(F.lower(t), r"https?://\S+|www\.\S+|[\w.+-]+@[\w.-]+\.[a-z]{2,}", " "), "[​-‍﻿]", " ")
    units = F.regexp_extract_all(clean, F.lit(r"[가-힣]+|[a-z]+(?:[.-][a-z]+)*|[0-9]+(?:[.,][0-9]+)*"), F.lit(0))
    same = df.select("t", X.normalize_text(t).eqNullSafe(out).alias("n"), X.sentences_of(t).eqNullSafe(cut).alias("s"), X.units_of(t).eqNullSafe(units).alias("u"))
    assert same.filter("not (n and s and u)").collect() == []


def test_content_is_looked_for_no_further_than_needed(spark):
    s = T.segment_sentences(spark.createDataFrame([(1, "12 3. a b. 7 word more"), (2, "1 2 3."), (3, None), (4, "a, b"), (5, "정부는 갔다")], "article_id bigint, body_text string"))
    want = {r[0] for r in T.content_tokens(T.morph_tokens(s)).select("article_id").distinct().collect()}
    got = T.with_content(s)
    assert {r["article_id"] for r in got.collect()} == want and "Generate posexplode(transform" not in plan(got)
    lemmas = T.content_lemma_set(s, ()).select("text", F.array_sort(F.array_intersect("lemmas", F.array(F.lit("word"), F.lit("more")))).alias("x"))
    assert lemmas.filter(F.col("x") != F.array_sort(T.content_lemmas_among(F.col("text"), ("word", "more")))).collect() == []


def test_claims_drop_repeats_once(spark):
    """F27 bound_claims: repeats of cited sentences are dropped behind the binding, not on both of its sides as well."""
    from pressgrain.plans import QUERIES

    plan = QUERIES["bound_claims"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 3  # claims, repeats, counts
