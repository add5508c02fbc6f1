"""The prefix trie against a plain one, and its hash table by itself."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressgrain.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int"


def brute(rows):
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            said.setdefault(c, []).append((turn is not None, turn or 0, role or "", T_digest(role, text), text or ""))
    said = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in said.items()}
    built = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(said.get(c - c % 5, [])[:h]) + tuple(said[c][h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}

    def below(p):
        leaves, saved = (0 if children[p] else 1), (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        for q in children[p]:
            a, b = below(q)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def T_digest(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def cases():
    rnd = random.Random(4)
    says = [(r, t) for r in ("user", "assistant", None) for t in ("hello", "é ß", "", None, "x" * 40)]
    rows = []
    for c in range(0, 90):
        if c % 10 == 5:
            continue
        opening = [("user", "hello"), ("assistant", "x" * 40)] * rnd.randint(0, 3)
        turns = opening + [rnd.choice(says) for _ in range(rnd.randint(1, 12))] if c % 7 else [("user", "hello")] * 3
        rows += [(c, None if not i and c % 11 == 0 else i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(3, 0, "user", "hello"), (3, 0, "user", "hello"), (3, 1, "user", "again"), (None, 0, "user", "lost"), (10_000_000_004, 2, "user", "far")]
    return rows


@pytest.mark.parametrize("shard_rows", [300_000, 20])
def test_equals_a_plain_trie(spark, shard_rows):
    rows = cases()
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame([(*r, "n", 3) for r in shuffled], SCHEMA).repartition(4)
    got = sorted((tuple(r) for r in T.prefix_trie(df, shard_rows=shard_rows).collect()), key=str)
    assert got == brute(rows)


def test_empty_table_and_one_long_conversation(spark):
    df = spark.createDataFrame([(5, i, "user", f"t{i % 3}", "n", 3) for i in range(1500)], SCHEMA)
    assert T.prefix_trie(df.filter(F.lit(False))).count() == 0
    got = {r["depth"]: r for r in T.prefix_trie(df).collect()}
    assert len(got) == 1501 and all(r["n_convs"] == 1 and r["n_leaves"] == 1 and r["saved_tokens"] == 0 for r in got.values())
    assert got[1500]["n_children"] == 0 and got[1500]["ends_sha256"] == hashlib.sha256(b"5").hexdigest()


def test_perfect_hash_is_minimal_and_knows_its_keys():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64), axis=0)
        keys[: len(keys) // 2, 0] = 7  # halves of keys may agree
        found = T.PerfectHash(keys)
        assert sorted(found.slots(keys).tolist()) == list(range(len(keys)))
        assert (found.slots(rng.integers(0, 1 << 63, (50, 2)).astype(np.uint64)) == -1).all()
