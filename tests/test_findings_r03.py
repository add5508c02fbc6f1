"""Small cases of the findings of round 3."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pressgrain.operators import clusters as L, pairs as P, textops as T, windows as W
from pressgrain.plans import QUERIES


def test_digits_at_the_ends_of_lines_stay(spark):
    text = "0 a0\n1 b1\n1 b1\n 2 c2 \n3"
    row = spark.createDataFrame([(text,)], "t string").select(W.consecutive_line_dedupe(F.col("t")).alias("x")).first()
    assert row["x"] == "0 a0\n1 b1\n2 c2\n3"


@pytest.fixture(scope="module")
def folder_of_files(spark, tmp_path_factory):
    """documents as a folder of several files, more than 5,000 of them on one day."""
    base = tmp_path_factory.mktemp("tables")
    rows = spark.range(6000).selectExpr("id * 720 as doc_id", "concat('title ', id % 7, '\\nbody ', id % 50) as text", "'fr' as lang", "'src1' as source", "20L as n_chars")
    shifted = rows.withColumn("doc_id", F.col("doc_id") + 9)
    shifted.repartition(3).write.parquet(f"{base}/documents.parquet")
    return str(base)


def test_streams_read_tables_that_are_folders(spark, folder_of_files):
    texts = {r["text"] for r in spark.read.parquet(f"{folder_of_files}/documents.parquet").select("text").distinct().collect()}
    urls = {r["canonical_url"] for r in QUERIES["stream_dedupe_articles"](spark, folder_of_files).collect()}
    assert urls == {"https://news.example.com/a/" + hashlib.sha256(t.encode()).hexdigest() for t in texts}
    assert QUERIES["stream_upsert"](spark, folder_of_files).count() == 6000


def test_a_scan_gives_the_newest_5000(spark, folder_of_files):
    rows = QUERIES["scan_articles"](spark, folder_of_files).collect()
    ids = sorted((r["article_id"] for r in rows), reverse=True)
    assert len(ids) == 5000 and ids == [i * 720 + 9 for i in range(5999, 999, -1)]


def test_a_leak_is_told_by_text_where_claim_ids_repeat(spark):
    body = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(1, 7, body[4:40]), (1, 7, "quite another saying of the same claim id"), (1, 8, body[4:40]), (2, 7, body * 4), (3, None, body)]
    claims = spark.createDataFrame(rows, "claim_id bigint, article_id bigint, paraphrase string")
    articles = spark.createDataFrame([(7, body), (8, "nothing alike")], "article_id bigint, body_text string")
    got = {(r["claim_id"], r["article_id"], r["paraphrase"]): r["reason"] for r in T.verbatim_leak(claims, articles).collect()}
    assert T.verbatim_leak(claims, articles).count() == 5
    assert got == dict(zip(rows, ("verbatim", None, None, "too_long", None)))


@pytest.mark.parametrize("block", [7, 100])
def test_pairs_counted_in_blocks_are_those_of_set_operations(spark, monkeypatch, block):
    rnd = random.Random(5)
    words = ["ab", "abcd", "abcde", "abcdef", "xy", "xyz", "xyzzy", "q1", "gen", "role", *[f"w{i}" for i in range(30)]]
    rows = []
    for run in ("d1", "d2"):
        for i in range(40):
            t, b = (rnd.sample(words, rnd.randint(0, 6)) for _ in range(2))
            k = [x for x in b if rnd.random() < 0.5]
            c = list(dict.fromkeys(t + b))
            d = [x for x in c if x != "gen"]
            rows.append((run, f"u{i:02}", t, b, k, c, d, [x for x in d if x != "role"], [x for x in ("ab", "c2") if rnd.random() < 0.1]))
    kinds = ", ".join(f"{n} array<string>" for n in ("t", "b", "k", "c", "d", "topic", "concepts"))
    units = spark.createDataFrame(rows, f"run string, unit_id string, {kinds}")
    a, b = (units.select("run", *[F.col(c).alias(f"{s}_{c}") for c in units.columns[1:]]) for s in "lr")
    both = a.join(b, "run").filter("l_unit_id > r_unit_id")
    names = dict(t="shared_title", b="shared_body", k="shared_anchors", d="shared_discriminators", concepts="shared_concepts", c="shared_all")
    plain = both.select("run", F.col("l_unit_id").alias("src"), F.col("r_unit_id").alias("dst"), *[F.size(F.array_intersect(f"l_{c}", f"r_{c}")).cast("long").alias(n) for c, n in names.items()],
                        L.related_count(F.col("l_topic"), F.col("r_topic")).cast("long").alias("shared_topic")).filter("shared_all > 0 or shared_concepts > 0")
    monkeypatch.setattr(P, "AT_ONCE", 200)
    monkeypatch.setattr(P, "TOGETHER", 10)
    want = sorted(map(tuple, plain.collect()))
    assert want and sorted(map(tuple, P.shared(units, related=True, block=block).select(plain.columns).collect())) == want
    assert sorted(map(tuple, P.shared(units, block=block).collect())) == [w[:-1] for w in want]
    joins = L.token_pairs(units)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in joins  # no row of a pair is joined with the tokens of its units
