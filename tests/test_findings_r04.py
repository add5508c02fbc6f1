"""Small cases of the findings of round 4."""

import random

from pyspark.sql import functions as F

from pressgrain.functions import text as X
from pressgrain.operators import clusters as L, compare as M, pairs as P


def test_a_large_component_grows_in_one_pass(spark, monkeypatch):
    """F1 to F4: a component of more than 200,000 edges streams through a task; no rounds of joins."""
    monkeypatch.setattr(L, "grow_in_rounds", lambda *a: 1 / 0)
    n = 660
    units = spark.range(n).selectExpr("'r' as run", "id as unit_id", "1L as weight", "10 as title_chars", "array('t') as idx")
    a, b = spark.range(n).toDF("src"), spark.range(n).toDF("dst")
    links = a.join(b, F.col("src") > F.col("dst")).selectExpr("'r' as run", "src", "dst", "0.5D as similarity", "src % 2 = 0 or dst % 2 = 0 as indexed")
    out = L.complete_link_clusters(units, links).collect()
    # of odd units, that share no index token with each other, each still meets an even one
    assert len(out) == n and {r["cluster_id"] for r in out} == {0}


def test_growth_keeps_sums_as_they_were(spark):
    """Representatives, ties by shared tokens and weights, against the rule written out over all members."""
    rnd = random.Random(4)
    n = 60
    units = [("r", i, rnd.randint(1, 4), rnd.choice([10, 90, 400]), rnd.sample("abcdef", rnd.randint(0, 4))) for i in range(n)]
    edges = [("r", a, b, rnd.choice([0.1, 0.3, 0.3, 0.7]), rnd.random() < 0.8) for a in range(n) for b in range(a) if rnd.random() < 0.7]
    link = {(x, y): (s, i) for _, a, b, s, i in edges for x, y in ((a, b), (b, a))}
    clusters = []
    for _, u, _, _, own in units:
        options = []
        for c in clusters:
            links = [link.get((u, m)) for m in c]
            if None not in links and any(i for _, i in links):
                least = max(1, sum(units[m][2] for m in c) - 1)
                fitness = lambda m: max((units[m][2] - 1 + sum(units[o][2] * link[m, o][0] for o in c if o != m)) / least - max(0, units[m][3] - 70) / 500, -1.0)
                rep = min(c, key=lambda m: (-fitness(m), m))
                options.append((-link[u, rep][0], -len(set(own) & {t for m in c for t in units[m][4]}), c[0], c))
        if options:
            min(options)[3].append(u)
        else:
            clusters.append([u])
    want = {m: c[0] for c in clusters for m in c}
    nodes = spark.createDataFrame(units, "run string, unit_id bigint, weight bigint, title_chars int, idx array<string>")
    links = spark.createDataFrame(edges, "run string, src bigint, dst bigint, similarity double, indexed boolean")
    got = {r["unit_id"]: r["cluster_id"] for r in L.complete_link_clusters(nodes, links).collect()}
    assert got == want


def test_components_are_tied_inside_tasks_first(spark):
    """each task gives out a forest, so the rounds get no more edges than nodes a task."""
    edges = spark.range(400).selectExpr("'r' as run", "id % 40 + 100 as src", "id % 39 + 60 as dst").repartition(2)
    assert L._forests(edges).count() <= 2 * 79
    got = {(r["node"], r["component"]) for r in L.connected_components(edges.union(edges.selectExpr("run", "src + 1000", "dst + 1000"))).collect()}
    assert {c for _, c in got} == {60, 1060} and len(got) == 2 * 79


def test_pairs_bring_their_features_along(spark, monkeypatch):
    """F5 to F7, F9, F10: pairs are never joined, units go to the blocks from their own on only, and features are those of the joins."""
    rnd = random.Random(6)
    words = ["ab", "abcd", "abcde", "abcdef", "xy", "xyz", "gen", "role", *[f"w{i}" for i in range(20)]]
    some = lambda of, n: rnd.sample(of, rnd.randint(0, n))
    rows = []
    for i in range(60):
        t, b = some(words, 6), some(words, 8)
        c = list(dict.fromkeys(t + b))
        d = [x for x in c if x != "gen"]
        topic = [x for x in d if x != "role"]
        rows.append((f"d{i % 2}", i, t, b, b[::2], c, d, topic, [x for x in topic if x in ("ab", "abcd", "xyz")], some(["k1", "k2"], 1), rnd.choice("xy"), some(["Ann", "Bob"], 2), some(["go", "stay"], 2), some([0, 1], 1), some([0, 1], 1)))
    kinds = "t array<string>, b array<string>, k array<string>, c array<string>, d array<string>, topic array<string>, distinctive array<string>, concepts array<string>, category string, actors array<string>, actions array<string>, hn1 array<int>, hn2 array<int>"
    units = spark.createDataFrame(rows, f"run string, unit_id bigint, {kinds}")
    names = ["run", "src", "dst", *(f"shared_{x}" for x in ("title", "body", "anchors", "discriminators", "concepts", "all", "topic", "distinctive", "actors", "actions")), "overlap", "similarity", "title_jaccard", "content_jaccard",
             "same_category", "hard_negative", *(f"{x}_{s}" for x in ("actors", "actions", "distinctive") for s in ("left", "right")), "nd1", "nd2"]
    want = sorted(map(tuple, L.pair_features(units, P.shared(units)).select(names).collect()), key=str)
    for block in (7, 100):
        monkeypatch.setattr(P, "BLOCK", block)
        monkeypatch.setattr(P, "KEPT", 9)
        monkeypatch.setattr(P, "GUESTS", 5)
        got = L.pair_features(units, L.similar_pairs(units))
        assert want and sorted(map(tuple, got.select(names).collect()), key=str) == want
    edges = L.compatible_edges(units)._jdf.queryExecution().optimizedPlan().toString()
    assert edges.count("Join") == 1  # units with the number of blocks of their run
    monkeypatch.setattr(P, "BLOCK", 10)
    dealt = P._dealt(units, 10, True)
    assert dealt.filter("_i < _block").count() == 0 and dealt.groupBy("run", "unit_id").count().filter("count = 3").count() > 0


def test_words_are_cleaned_with_their_text(spark):
    """F1 to F4: one pattern over a text gives the words that one over each word gives."""
    rnd = random.Random(8)
    bits = ["a", "b1", "12", "3", " ", "  ", "\n", ".", "https://x.y/z9 ", "HTTP://Q", "정부는", "정부에서는", "가", "은", "９", "é", "-", "that", "cd", "학교"]
    rows = [("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))),) for _ in range(2000)] + [(None,)]
    t = F.col("t")
    flat = F.regexp_replace(F.regexp_replace(F.lower(X.nfkc(t)), r"https?://\S+", " "), "[^0-9a-z가-힣]+", " ")
    want = F.filter(F.transform(F.split(flat, " "), lambda w: X.clean_token(w)), lambda w: (F.length(w) >= 2) & ~w.isin("that", "학교"))
    stop = ("that", "학교")
    same = spark.createDataFrame(rows, "t string").select("t", X.body_words(t, stop).eqNullSafe(want).alias("w"), X.distinct_body_words(t, stop).eqNullSafe(F.array_distinct(want)).alias("d"))
    assert same.filter("not (w and d)").collect() == []


def test_units_read_texts_once_and_move_them_once(spark, monkeypatch):
    """F1 to F7, F9, F10: tokens of a headline with several articles, and limits by the articles of the run."""
    written = []
    plain = L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: written.append(df) or plain(df))
    rows = [("d1", i, "economy news of the on an day" if i < 3 else f"on an title number{i}x", "", f"common word{i} pair{i // 2} some{i // 4} many{i // 8}") for i in range(80)]
    rows += [("d2", 100, "on an other day", "", None)]
    articles = spark.createDataFrame(rows, "run string, article_id bigint, title string, section string, body_text string")
    lex = L.Lexicon(title_categories=(("economy", "on|an"),), section_categories=(("none", "^none$"),))
    units, membership = L.headline_units(articles, lex)
    got = {r["unit_id"]: r for r in units.collect()}
    assert len(got) == 79 and got[0]["weight"] == 3 and sorted((r["unit_id"], r["article_id"]) for r in membership.filter("unit_id < 3").collect()) == [(0, 0), (0, 1), (0, 2)]
    # 80 articles: up to 7 may hold a token, up to 3 an anchor
    assert got[0]["b"] == sorted(["word", "pair", "some", "many"]) or got[0]["b"] == []
    assert got[100]["b"] == got[100]["k"] == []
    assert "body_text" not in written[0].columns and len(written) == 3 and not {"c", "d", "topic", "idx"} & set(written[-1].columns)


def test_terms_of_the_lens_move_once(spark):
    """F11 morphology_lens: one shuffle of terms instead of one for each distinct count, semi join and sum."""
    rnd = random.Random(2)
    rows = [(i % 3, a, f"s{a % 4}", f"g{a % 4 // 2}", t, rnd.randint(1, 5)) for i in range(3) for a in range(i, 12, 3) for t in rnd.sample("abcdefgh", 4)]
    terms = spark.createDataFrame(rows, "issue_id bigint, article_id bigint, source_id string, media_group_id string, term string, n bigint")
    out = M.morphology_lens(terms, terms.withColumnRenamed("n", "content_token_count"), k=2)
    want = []
    for issue, source in sorted({(r[0], r[2]) for r in rows}):
        own = [r for r in rows if r[0] == issue]
        total = sum(r[5] for r in own if r[2] == source)
        kept = {t for t in "abcdefgh" if len({r[1] for r in own if r[4] == t}) >= 2 and len({r[3] for r in own if r[4] == t}) >= 2}
        n = {t: sum(r[5] for r in own if r[2] == source and r[4] == t) for t in kept}
        best = sorted((-int(n[t] / total * 1e6 + 0.5) / 1e3, -n[t], t) for t in kept if n[t])[:2]
        want += [(issue, source, t, -c, -p, i) for i, (p, c, t) in enumerate(best, 1)]
    got = sorted((r["issue_id"], r["source_id"], r["term"], r["n"], r["per_thousand"], r["position"]) for r in out.collect())
    assert want and got == sorted(want)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Expand") == 0
