"""Cases of texts and passages that an operator once left out."""

import random

from pressgrain.llm import lang_id, line_chunks


def test_language_margin_does_not_sink_with_length(spark):
    rnd = random.Random(3)
    vocabulary = {g: ["".join(rnd.choice(s) for _ in range(rnd.randint(2, 5))) for _ in range(3_000)] for g, s in (("en", ("the", "ing", "wh", "er", "on", "a")), ("de", ("sch", "ung", "ein", "zu", "er", "e")))}
    text = lambda g, n: " ".join(rnd.choice(vocabulary[g]) for _ in range(n))
    learned = spark.createDataFrame([(i, text(g, 200), g) for i in range(60) for g in vocabulary], "doc_id long, text string, lang string")
    rows = [(g, n, text(g, 160_000)[:n]) for g in vocabulary for n in (4_000, 20_000, 200_000, 1_000_000)]
    assert all(len(t) == n for _, n, t in rows)
    docs = spark.createDataFrame([(f"{g} {n}", g, n, t) for g, n, t in rows], "doc_id string, want string, n long, text string")
    got = lang_id.identify(docs, lang_id.fit_dictionaries(learned)).select("want", "n", "lang_pred", "score", "accepted").collect()
    scores = {(r["want"], r["n"]): r["score"] for r in got}
    assert all(r["lang_pred"] == r["want"] and r["accepted"] for r in got)
    assert all(scores[g, 1_000_000] > 0.7 * scores[g, 20_000] for g in vocabulary)


def longest_repeats(texts, least):
    """Words of every longest run of lines that occurs at another place too, if they are ``least`` at least."""
    lines = [t.split("\n") for t in texts]
    found = set()
    for d, a in enumerate(lines):
        for e, b in enumerate(lines):
            for i in range(len(a)):
                for j in range(len(b)):
                    if (d, i) < (e, j) and (i == 0 or j == 0 or a[i - 1] != b[j - 1]):
                        n = 0
                        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                            n += 1
                        if sum(len(x.split()) for x in a[i:i + n]) >= least:
                            found.add((d, i, e, j, n))
    return found


def test_line_chunks_find_every_repeated_passage(spark):
    rnd = random.Random(5)
    line = lambda n: " ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(n))
    shared = [[line(-(-52 // n) if k < 2 else 70 // n) for _ in range(n)] for n in range(1, 7) for k in range(6)]
    short = line(30)
    texts = [["own " + line(20), *p, line(15)] for p in shared] + [[line(9), line(4), *p, "", line(60)] for p in shared]
    texts += [[short, line(20)], [line(21), short], [line(10), *shared[0], *shared[8], line(8), *shared[31]]]
    texts = ["\n".join(t) for t in texts]
    assert len(longest_repeats(texts, 50)) > len(shared)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_chunks.remove_repeated_chunks(docs).collect()}
    after = [got[i]["text"] for i in range(len(texts))]
    assert longest_repeats(after, 50) == set()
    # each line is left once, lines that don't repeat and short ones stay everywhere, first occurrences stay as they are
    passages = {x for p in shared for x in p}
    assert after[: len(shared)] == texts[: len(shared)]
    for old, new in zip(texts[len(shared) :], after[len(shared) :]):
        assert new.split("\n") == [x for x in old.split("\n") if x not in passages]
    assert [got[i]["n_removed_chunks"] for i in (0, len(shared), len(texts) - 1)] == [0, 1, 2]


def test_line_chunks_that_overlap_themselves(spark):
    rnd = random.Random(6)
    a, b = (" ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(30)) for _ in range(2))
    docs = spark.createDataFrame([(1, f"{a}\n{a}\n{a}\n{a}\n{b}"), (2, "x"), (3, f"{b}\n{a}")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_chunks.remove_repeated_chunks(docs).collect()}
    assert got == {1: f"{a}\n{a}\n{b}", 2: "x", 3: f"{b}\n{a}"}
