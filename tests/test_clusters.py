"""Event clustering on small Korean fixtures: golden cases, order invariance and a brute-force check."""

import random

import pytest
from pyspark.sql import functions as F

from pressgrain.operators import clusters as L, similarity as S

SCHEMA = "run string, article_id string, title string, section string, body_text string"


def articles(spark, titles, section="정치"):
    return spark.createDataFrame([("d1", i, t, section, "") for i, t in titles], SCHEMA)


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["issue_id"], set()).add(r["article_id"])
    return {frozenset(v) for v in out.values()}


SAME = [
    ("a1", "김민수 의원 횡령 의혹 구속영장 청구"),
    ("a2", "검찰, 김민수 의원 횡령 의혹 구속영장 청구"),
    ("a3", "박영희 장관 해외 순방 출국"),
    ("a4", "박영희 장관 해외 순방 마치고 귀국"),
    ("a5", "김민수 의원 횡령 의혹 구속영장 청구"),
]


def test_same_event_merges_and_different_actors_stay_apart(spark):
    got = groups(L.cluster_articles(articles(spark, SAME)))
    assert frozenset({"a1", "a2", "a5"}) in got
    assert all(not ({"a1", "a3"} <= g) for g in got)


def test_order_of_input_does_not_matter(spark):
    rows = SAME[:]
    random.Random(3).shuffle(rows)
    df = articles(spark, rows).repartition(3)
    assert groups(L.cluster_articles(df)) == groups(L.cluster_articles(articles(spark, SAME)))


def test_hard_negative_titles_are_split(spark):
    rows = [("a1", "광복절 경축사 대북 메시지 발표"), ("a2", "광복절 대북 탄도 미사일 메시지 발표")]
    assert len(groups(L.cluster_articles(articles(spark, rows)))) == 2


def _graph(seed, n, p):
    rnd = random.Random(seed)
    edges = [(f"n{a:03}", f"n{b:03}", rnd.randint(25, 99) / 100, rnd.random() < 0.9) for a in range(n) for b in range(a) if rnd.random() < p]
    return [f"n{i:03}" for i in range(n)], edges


def _brute(nodes, edges, chars=10):
    """Reference greedy pass written directly on the edge list."""
    sim = {frozenset((a, b)): (s, i) for a, b, s, i in edges}
    clusters = []
    for u in nodes:
        best = None
        for c in clusters:
            links = [sim.get(frozenset((u, m))) for m in c]
            if None in links or not any(x[1] for x in links):
                continue
            rep, top = c[0], -1.0
            for m in c:
                total = sum(sim[frozenset((m, o))][0] for o in c if o != m)
                score = total / max(1, len(c) - 1) - max(0, chars - 70) / 500
                if score > top:
                    rep, top = m, score
            key = (-sim[frozenset((u, rep))][0], c[0])
            if best is None or key < best[0]:
                best = (key, c)
        if best:
            best[1].append(u)
        else:
            clusters.append([u])
    return {frozenset(c) for c in clusters}


def _grown(spark, nodes, edges, limit, chars=10):
    units = spark.createDataFrame([("r", n, 1, chars, [n]) for n in nodes], "run string, unit_id string, weight bigint, title_chars int, idx array<string>")
    links = spark.createDataFrame([("r", a, b, s, i) for a, b, s, i in edges], "run string, src string, dst string, similarity double, indexed boolean")
    got = {}
    for r in L.complete_link_clusters(units, links, task_limit=limit).collect():
        got.setdefault(r["cluster_id"], set()).add(r["unit_id"])
    return {frozenset(v) for v in got.values()}


@pytest.mark.parametrize("limit", [5000, 0])
@pytest.mark.parametrize("seed,p,chars", [(7, 0.35, 10), (8, 0.8, 10), (9, 0.95, 2000)])
def test_growth_matches_brute_force_in_one_task_and_in_rounds(spark, limit, seed, p, chars):
    nodes, edges = _graph(seed, 14, p)
    assert _grown(spark, nodes, edges, limit, chars) == _brute(nodes, edges, chars)


def test_a_clique_grows_in_few_rounds(spark, monkeypatch):
    written = []
    plain = L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: written.append(1) or plain(df))
    n = 1200
    units = spark.range(n).selectExpr("'r' as run", "id as unit_id", "1L as weight", "10 as title_chars", "array('t') as idx")
    a, b = spark.range(n).toDF("src"), spark.range(n).toDF("dst")
    links = a.join(b, F.col("src") > F.col("dst")).selectExpr("'r' as run", "src", "dst", "0.5D as similarity", "true as indexed")
    out = L.grow_in_rounds(units, links)
    assert out.count() == n and {r["cluster_id"] for r in out.select("cluster_id").distinct().collect()} == {0}
    assert len(written) <= 2 + 2 * 4


def test_prefix_joins_find_every_similar_pair(spark):
    rnd = random.Random(11)
    sets = {i: sorted({f"w{int(rnd.paretovariate(0.7)) % 40}" for _ in range(rnd.randint(0, 14))}) for i in range(120)}
    df = spark.createDataFrame([("r", i, s) for i, s in sets.items()], "run string, unit_id int, c array<string>").repartition(3)
    pairs = {(a, b): (len(set(sets[a]) & set(sets[b])), len(set(sets[a]) | set(sets[b]))) for a in sets for b in range(a)}
    for t in (0.1, 0.15, 0.2495, 0.5, 1.0):
        met = {(r["src"], r["dst"]) for r in S.jaccard_candidates(df, "c", t).collect()}
        assert met >= {p for p, (n, u) in pairs.items() if n and n >= t * u}
    for n in (1, 2, 4):
        assert {(r["src"], r["dst"]) for r in S.overlap_candidates(df, "c", n).collect()} >= {p for p, (m, _) in pairs.items() if m >= n}
    counted = S.shared_counts(S.overlap_candidates(df, "c", 1), df, [("c", "n")]).collect()
    assert {(r["src"], r["dst"]): r["n"] for r in counted} == {p: m for p, (m, _) in pairs.items() if m}


def test_event_pairs_lose_no_compatible_pair(spark):
    base = "/root/testdata/sf0.001"
    from pressgrain.plans.fixtures import Tables
    from pressgrain.plans.q_clusters import LEX, run_articles

    units, _ = L.headline_units(run_articles(Tables(spark, base)), LEX)
    decided = lambda pairs: {tuple(r) for r in L.compatible_event(L.pair_features(units, pairs)).filter("compatible").select("run", "src", "dst", "rule").collect()}
    every = decided(L.token_pairs(units))
    assert every and every == decided(L.event_pairs(units)) == decided(L.similar_pairs(units))


def test_titles_without_key_characters_stay_apart(spark):
    rows = [("a1", "中文标题新闻"), ("a2", "Русский заголовок"), ("a3", "!!!"), ("a4", "김민수 의원 횡령 의혹")]
    assert len(groups(L.cluster_articles(articles(spark, rows)))) == 4
