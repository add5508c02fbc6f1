"""Removal of repeated byte strings against a dictionary of all strings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressgrain.llm import repeats as R

SCHEMA = "doc_id long, text string, lang string, spans string, doc long, same long"


def brute(rows, length):
    """Per row: bytes removed, runs, and what is left, by the first place of every string."""
    first = {}
    key = lambda i: -(1 << 63) if i is None else i
    raws = [(key(i), (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for at in range(len(raw) - length + 1):
            w = raw[at : at + length]
            first[w] = min(first.get(w, (i, at)), (i, at))
    out = []
    for (doc, _), (i, raw) in zip(rows, raws):
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            if first[raw[at : at + length]] < (i, at):
                gone[at : at + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for n, g in enumerate(gone) if g and (n == 0 or not gone[n - 1]))
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cases(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé \n") for _ in range(rnd.randint(3, 30)))
    passages = ["".join(word() for _ in range(rnd.randint(2, 12))) for _ in range(8)]
    texts = []
    for _ in range(n):
        texts.append("".join(rnd.choice([word(), word(), rnd.choice(passages), rnd.choice(passages)[: rnd.randint(1, 130)]]) for _ in range(rnd.randint(0, 9))))
    texts += [texts[3], texts[4][:-1], "a" * 700, "ab" * 300, "a" * 99, "a" * 100, "", None, "x" * 40 + passages[0], "\x00" * 250]
    return list(enumerate(texts))


@pytest.mark.parametrize("limit,spreads", [(1000, (34, 8, 0)), (3, (34, 8, 0)), (1, (68, 20, 5, 0))])
def test_equals_brute_force(spark, limit, spreads):
    rows = cases(limit, 40)
    docs = spark.createDataFrame([(i, t, "en", "x", 1, 2) for i, t in rows], SCHEMA).repartition(5)
    got = R.remove_repeats(docs, limit=limit, spreads=spreads, bucket_bytes=4096, shard_bytes=1024)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got.collect()), key=str)
    assert got == brute(rows, 100)


def test_repeated_ids_and_rows_null_ids_and_empty_table(spark):
    long = "".join(random.Random(1).choice("abcdef") for _ in range(300))
    rows = [(7, long), (7, long), (7, "zz" + long), (None, long[100:]), (3, "q" + long[:150] + "!"), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, None, None, 1, 2) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in R.remove_repeats(docs).collect()), key=str)
    assert got == brute(rows, 100)
    assert R.remove_repeats(docs.filter(F.lit(False))).count() == 0


def test_merged_transforms_sort_all_suffixes():
    rnd = random.Random(2)
    strings = [bytes(rnd.choice(b"\x00ab\xff") for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    strings += strings[:10]
    shards = [R.ShardTransform.build(strings[i : i + 17]) for i in range(0, len(strings), 17)]
    for length in (1, 3, 8):
        rows, block = R.merged_blocks(shards, length)
        string, offset = R.places(shards)
        found = [(strings[string[r]][offset[r] : offset[r] + length], len(strings[string[r]]) - offset[r] >= length) for r in rows.tolist()]
        whole = [w for w, ok in found if ok]
        assert whole == sorted(whole)
        groups = {}
        for (w, ok), b in zip(found, block.tolist()):
            groups.setdefault(b, []).append((w, ok))
        assert all(len(set(g)) == 1 for g in groups.values()) and all(g[0][1] for g in groups.values() if len(g) > 1)
        assert len([g for g in groups.values() if g[0][1]]) == len(set(whole))


@pytest.mark.parametrize("block", [128, 1 << 20])
def test_every_string_has_one_least_gram_wherever_it_stands(block):
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 100, n).astype(np.uint8).tobytes() for n in (0, 99, 100, 350, 0, 1000)] + [b"a" * 300]
    data, bounds = np.frombuffer(b"".join(texts * 2), np.uint8), np.cumsum([0, *map(len, texts * 2)])
    where, values, first, last = R.sampled_grams(data, bounds, 100, 32, block)
    starts = [s for a, b in zip(bounds, bounds[1:]) for s in range(a, b - 99)]
    owner = {s: (w, v) for w, v, a, b in zip(where.tolist(), values.tolist(), first.tolist(), last.tolist()) for s in range(a, b + 1)}
    assert sorted(owner) == starts and sum(last - first + 1) == len(starts)
    seen = {}
    for s in starts:
        w, v = owner[s]
        assert s <= w <= s + 68
        assert seen.setdefault(bytes(data[s : s + 100]), (w - s, v)) == (w - s, v)
