"""Spelling variants against a comparison of all pairs."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pressgrain.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n long"


def near(a, b):
    """Whether exactly one insertion, deletion or replacement leads from a to b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        mates = sorted(((-counts[v], v) for v in counts if near(w, v)))
        form = mates[0][1] if mates and -mates[0][0] >= ratio * n else None
        out[w] = [form, n, len(mates), counts[form] if form else None]
    rows = []
    for w, (form, n, mates, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, mates, form_n))
    return sorted(rows)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("block", [8192, 16])
def test_equals_all_pairs(spark, block):
    rnd = random.Random(3)
    counts = {}
    for _ in range(60):
        w, n = "".join(rnd.choice("abcéÿ×") for _ in range(rnd.randint(7, 12))), rnd.choice([2, 20, 3000, 3000])
        for _ in range(rnd.randint(1, 9)):
            counts[w] = n
            i, n = rnd.randint(0, len(w)), max(2, n // rnd.choice([1, 3, 10, 11]))
            w = rnd.choice([w[:i] + rnd.choice("abz") + w[i:], w[:i] + "b" + w[i + 1 :], w[:i] + w[i + 1 :]])
            w = w if len(w) >= 7 else w + "aaa"
    counts |= {"a" * k: 5 for k in range(7, 30)} | {"x" * 700: 2, "x" * 701: 50, "x" * 350 + "y" + "x" * 350: 2}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert rows_of(S.spelling_variants(df, block=block)) == brute(counts)


def test_words_of_whole_texts(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcÀÿ×E") for _ in range(rnd.randint(5, 10))) for _ in range(40)]
    rows = [(i if i % 9 else None, " ".join(rnd.choice(words) + rnd.choice(["", "1", "\n", "-ab", "Ā", "."]) for _ in range(rnd.randint(0, 60)))) for i in range(50)] + [(3, None), (3, ""), (4, "x" * 30_000), (5, "x" * 30_000)]
    counts = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    docs = spark.createDataFrame([(i, t, "w", 9) for i, t in rows], SCHEMA)
    assert {r["word"]: r["n"] for r in S.word_counts(docs).collect()} == counts
    assert rows_of(S.spelling_variants(S.word_counts(docs))) == brute(counts)
    assert S.spelling_variants(S.word_counts(docs.filter(F.lit(False)))).count() == 0
