"""Parts of the operators by themselves: coder, packer, signatures, components, suffix automaton, pipeline."""

import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pressgrain.llm.coder import LEAST, _settle, decode_block, encode_block
from pressgrain.llm.graph import components
from pressgrain.llm.packing import pack_histogram
from pressgrain.llm.shingles import shingle_set, super_min_hash
from pressgrain.llm.suffix_tree import A, END, SuffixAutomaton, grams, symbols
from pressgrain.llm.tokens import PieceEncoder


@pytest.mark.parametrize("kind", ["empty", "one", "constant", "uniform", "text", "large ids"])
def test_coder_round_trip(kind):
    rng = np.random.default_rng(5)
    ids = {
        "empty": [], "one": [7], "constant": [3] * 5000, "uniform": rng.integers(0, 50_000, 3000), "text": rng.zipf(1.3, 20_000) % 3000, "large ids": rng.integers(0, 1 << 20, 300)}[kind]
    block = encode_block(np.array(ids, "<u4"))
    assert np.array_equal(decode_block(block), np.array(ids, "<u4"))
    if kind == "constant":
        assert len(block) < 1500
    if len(ids) > 1:
        with pytest.raises(ValueError):
            decode_block(block[:-1] + bytes([block[-1] ^ 1]))


def test_coder_settles_from_every_state():
    """Ranges of exactly 2**48 on an aligned start, which overflow 64 bits when shifted, and 40 million others."""
    rng = np.random.default_rng(4)
    states = [(np.array([0x1234FFFF00000000, 0x1234FFFF00000000, 0x7000_0000_0000_0000, 0], "u8"), np.array([1 << 32, (1 << 32) + 5, 1 << 48, 1 << 48], "u8"))]
    for _ in range(20):
        low = rng.integers(0, 1 << 64, 1_000_000, dtype=np.uint64) >> rng.integers(0, 64, 1_000_000).astype(np.uint64)
        states.append((low, np.uint64(1) << rng.integers(0, 64, len(low)).astype(np.uint64)))
        states.append((low << rng.integers(0, 64, len(low)).astype(np.uint64), rng.integers(1, 1 << 63, len(low), dtype=np.uint64) >> rng.integers(0, 62, len(low)).astype(np.uint64)))
    with np.errstate(over="ignore"):
        for low, span in states:
            span = np.maximum(np.minimum(span, ~low), np.uint64(1))  # a range never passes the end
            rounds = sum(1 for _ in _settle(low, span))
            assert rounds <= 8 and (span >= LEAST).all()


@pytest.mark.parametrize("file,kind", [("byte_bpe_50k.json", "lead"), ("word_bpe_49k.json", "drop")])
def test_piecewise_ids_are_those_of_the_tokenizer(file, kind):
    """20,000 strings of letters whose lower case grows, marks, all sorts of white space and special tokens; a store so small that it is cut again and again."""
    tokenizer, own = Tokenizer.from_file(public_tokenizers.path(file)), PieceEncoder(public_tokenizers.path(file), kind, limit=1000)
    rnd = random.Random(5)
    parts = ["a", "b", "the", "\u00e9", "\u0130", "\u0130!", "d\u0130.", "\u00df", "\u03a3", "\u0958.", " ", " ", " ", "  ", "\n", "\n\n", " \n", "\t", ".", ",", "!", "'s", "'ll", "n't", "1", "23", "\u00a0", "\u3000", "\x00", "\x01", "\x85", "\x0b",
             "\x1f", "\r\n", "<|endoftext|>", " <|endoftext|> ", "<|startoftext|>", "<|ENDOFTEXT|>", "\u4e2d", "\U0001f600", "\u0301", "e\u0301", "\u0120", "\u010a", "</w>", "_", "|", "\u00d7.", "\u00f7"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(20_000)]
    for i in range(0, len(texts), 700):
        some = texts[i : i + 700]
        ids, counts = own.encode(pa.array(some))
        found = np.split(ids, np.cumsum(counts)[:-1])
        for text, got, want in zip(some, found, tokenizer.encode_batch_fast(some, add_special_tokens=False)):
            assert got.tolist() == want.ids, text
    assert [len(x) for x in own.encode(pa.array([None, ""]))] == [0, 2]
    assert [len(x) for x in own.encode(pa.array([], pa.string()))] == [0, 0]


def test_histogram_packing_places_every_piece_once():
    rnd = random.Random(2)
    for _ in range(20):
        capacity = rnd.choice((7, 64, 2048))
        histogram = {rnd.randint(1, capacity): rnd.randint(1, 400) for _ in range(rnd.randint(1, 60))}
        rows = pack_histogram(histogram, capacity)
        filled = {}
        for length, rank, count, first, offset in rows.tolist():
            for k in range(count):
                filled.setdefault(first + k, []).append((offset, length))
        assert {n: sum(r[2] for r in rows.tolist() if r[0] == n) for n in histogram} == histogram
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert sorted(filled) == list(range(len(filled)))
    assert len(pack_histogram({}, 2048)) == 0


def test_super_min_hash_estimates_similarity():
    rng = np.random.default_rng(8)
    for share in (0.5, 0.85):
        n = 400
        common = rng.integers(0, 1 << 63, int(2 * n * share / (1 + share)), dtype=np.int64).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n - len(common), dtype=np.int64).astype(np.uint64)])) for _ in range(2))
        x, y = super_min_hash([a, b], 256)
        assert abs((x == y).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.1
    sets = [shingle_set(" ".join(f"w{rng.integers(50)}" for _ in range(k)), 3) for k in (1, 2, 3, 40, 5000)]
    whole = super_min_hash(sets, 120)
    assert np.array_equal(whole, super_min_hash(sets, 120, at_once=100)) and np.array_equal(whole[3:4], super_min_hash(sets[3:4], 120))


def test_components_against_a_plain_search(spark):
    rnd = random.Random(3)
    cases = [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)], []]
    for edges in cases:
        group = {}
        for a, b in edges:
            group.setdefault(a, {a}), group.setdefault(b, {b})
            merged = group[a] | group[b]
            for x in merged:
                group[x] = merged
        df = spark.createDataFrame(edges, "a long, b long").repartition(5)
        got = {r["node"]: r["component"] for r in components(df).collect()}
        assert got == {x: min(g) for x, g in group.items() if len(g) > 1}


def test_automaton_walks_like_a_search_for_the_longest_suffix():
    rnd = random.Random(6)
    texts = [[("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5)))).encode() for _ in range(rnd.randint(0, 30))] for _ in range(40)]
    stream, depth = symbols(texts), 3
    counts = {}
    for code in grams(stream, depth).tolist():
        for length in range(depth + 1):
            key = code & ((1 << (8 * (length + 1))) - 1)
            if not length or key >> (8 * length):
                counts[key] = counts.get(key, 0) + 1
    contexts = {n: np.unique([k >> 8 for k in counts if k >> (8 * n) and not k >> (8 * n + 8)])[::2] for n in range(1, depth + 1)}
    kept = {0} | {int(c) for n in contexts for c in contexts[n]}
    used = {k: v for k, v in counts.items() if k >> 8 in kept}
    tree = SuffixAutomaton(np.array(list(used)), np.array(list(used.values())), depth, contexts)

    def probability(context, symbol):
        """By the definition: the longest retained suffix, smoothed with the next shorter one."""
        if context == 0:
            parent = 1 / A
        else:
            length = (context.bit_length() + 7) // 8
            shorter = context & ((1 << (8 * (length - 1))) - 1)
            parent = probability(shorter, symbol)
        if context not in kept:
            return parent
        own = {k & 255: v for k, v in used.items() if k >> 8 == context}
        return (own.get(symbol, 0) + len(own) * parent) / (sum(own.values()) + len(own))

    want = [np.log10(probability(code >> 8, code & 255)) for code in grams(stream, depth).tolist()]
    for lanes in (1, 7, 64):
        assert np.allclose(tree.score(stream, lanes), want, atol=1e-5)
    # a distribution: all next symbols together have probability 1
    assert abs(sum(probability(END, s) for s in range(256)) - 1) < 1e-9


def test_pipeline_keeps_clean_documents_and_catches_planted_ones(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(9)
    vocabulary = {g: ["".join(rnd.choice(s) for _ in range(rnd.randint(1, 4))) for _ in range(300)] for g, s in (("en", ("the", "ing", "wh", "er", "on")), ("de", ("sch", "ung", "ß", "ein", "zu")))}
    line = lambda g: " ".join(rnd.choice(vocabulary[g]) for _ in range(12)) + "."
    clean = [(i, "\n".join(line("en" if i % 2 else "de") for _ in range(12)), "en" if i % 2 else "de") for i in range(60)]
    passage = "\n".join(line("en") for _ in range(20))
    leak = line("en") + " " + line("en")
    flat = clean[10][1].replace("\n", " ")
    planted = [(100, flat, "de"), (101, flat.replace(".", ". x", 1), "de"), (102, clean[11][1] + " " + leak, "en"), (103, passage, "en"), (104, line("en") + "\n" + passage + "\n" + line("en"), "en"), (105, "12 34 !!", "en"), (106, None, "en")]
    docs = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in clean + planted], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    here = str(tmp_path)
    told = stages["language_id"](spark, docs, here)
    assert {r["doc_id"] for r in told.collect()} == {i for i, _, _ in clean + planted} - {105, 106}
    lined = {r["doc_id"]: r for r in stages["line_dedup"](spark, told, here).collect()}
    assert all(lined[i]["text"] == t for i, t, _ in clean)
    assert len(lined[104]["text"]) < len(passage) and lined[104]["n_chars"] == len(lined[104]["text"]) and lined[103]["text"] == passage
    near = {r["doc_id"] for r in stages["near_dedup"](spark, docs, here).collect()}
    assert near >= {i for i, _, _ in clean} and not near & {100, 101} and 106 in near
    left = {r["doc_id"] for r in stages["decontamination"](spark, docs, here).collect()}
    assert left == {i for i, _, _ in clean + planted} - {102}
    out = corpus_pipeline.run(spark, here)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} >= {i for i, _, _ in clean}
    none = docs.filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, here).count() == 0


def test_pages_of_broken_markup_are_read_in_linear_time():
    """No exception on 20,000 pages with odd bits of markup put in, and a million characters of hard cases in seconds."""
    from pressgrain.llm.html_text import main_text

    assert main_text("<p>a</p><![foo[x]]><p>b") == "a b"
    rnd = random.Random(1)
    page = "<html><body><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>One, two, three. " + "Words, more words. " * 9 + "</p><ul><li>a<li>b</ul></article><div class=comments><p>No.</p></div></body></html>"
    bits = ["<", ">", "<![", "<![foo[x]]>", "<!", "<!--", "-->", "</", "<p>", "<div>", "<li>", "</li>", "<?", "&#", "&", '"', "'", "<nav>", "</nav>", "<td>", "<table>", "<select>", "<option>", "<![CDATA[", "]]>", "\x00", "<script>", "</script>", "<!DOCTYPE"]
    for _ in range(20_000):
        at = [rnd.randrange(len(page)) for _ in range(rnd.randint(1, 10))]
        mutated = "".join(c + rnd.choice(bits) if i in at else c for i, c in enumerate(page))
        assert isinstance(main_text(mutated), str)
    start = time.process_time()
    for hard in ("<div>a, b " * 50_000, "<span>" * 50_000 + "<h1>x</h1>" * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<nav>" + "<b>" * 50_000 + "</i>" * 50_000, "<span>" * 50_000 + "<li>x</li>" * 50_000, "<a" * 50_000, "<!--" * 50_000, "<option>x" * 50_000):
        main_text(hard)
    assert time.process_time() - start < 60


def test_generated_articles_are_read_whole():
    """A page built from known parts gives back the article's words and nothing of what stands around it."""
    from pressgrain.llm.html_text import main_text

    rnd = random.Random(7)
    words = lambda n: " ".join(rnd.choice(("alpha", "beta", "gamma,", "delta", "epsilon.")) for _ in range(n))
    for _ in range(50):
        parts = [words(rnd.randint(20, 60)) for _ in range(rnd.randint(2, 8))]
        around = f"<header><h1>Site</h1></header><nav><ul><li><a href=a>Home</a></li></ul></nav><aside>{words(30)}</aside>"
        after = f"<div class='comments'><p>{words(40)}</p></div><footer><p>{words(20)}</p></footer><script>var a = 1;</script>"
        body = "".join(f"<p>{p.replace('beta', '<b>beta</b>')}</p>" if rnd.random() < 0.8 else f"<blockquote>{p}</blockquote>" for p in parts)
        assert main_text(f"<html><body>{around}<article>{body}</article>{after}</body></html>") == " ".join(parts)


def test_language_of_marks_and_of_pieces(spark):
    from pressgrain.llm import lang_id

    rnd = random.Random(2)
    make = lambda s: " ".join("".join(rnd.choice(s) for _ in range(3)) for _ in range(60))
    sounds = {"en": ("the", "ing", "wh"), "de": ("sch", "ung", "ein"), "fr": ("eau", "oui", "que")}
    rows = [(i, make(sounds[g]), g, 1.0) for i, g in enumerate(("en", "de", "fr") * 80)]
    odd = [(900, "́", None, 1.0), (901, "12 ं", None, 1.0), (902, None, None, 1.0), (903, "", None, 1.0), (904, rows[0][1], "en", 1.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, Score double")
    dictionaries = lang_id.fit_dictionaries(docs.filter("lang is not null and doc_id % 4 <> 2"), sample_docs=20)
    assert set(dictionaries) == set(sounds) and lang_id.fit_dictionaries(docs.filter("lang is null")) == {}
    told = {r["doc_id"]: r for r in lang_id.identify(docs, dictionaries).collect()}
    assert all(told[i]["lang_pred"] == "und" and told[i]["score"] == 0.0 and not told[i]["accepted"] for i in range(900, 904))
    assert sum(told[i]["lang_pred"] == g for i, _, g, _ in rows) / len(rows) > 0.97
    same = lang_id.identify(docs, {"b": b"same words here", "a": b"same words here"}).collect()
    assert {r["lang_pred"] for r in same if r["doc_id"] < 900} == {"a"} and {r["score"] for r in same} == {0.0}


def test_line_chunks_with_clashing_columns(spark):
    from pressgrain.llm.line_chunks import remove_repeated_chunks

    text = "\n".join(f"line {i} of the passage with some more words in it" for i in range(12))
    docs = spark.createDataFrame([(1, text, 5, "a", "b", 7), (2, "own words\n" + text, 6, "c", None, 8)], "doc_id long, text string, _id int, _key string, _lines string, k0 int")
    got = {r["doc_id"]: r for r in remove_repeated_chunks(docs).collect()}
    assert got[1]["text"] == text and got[2]["text"] == "own words" and (got[2]["_id"], got[2]["_key"], got[2]["_lines"], got[2]["k0"]) == (6, "c", None, 8)


def test_archives_with_long_headers(spark, tmp_path):
    from pressgrain.llm import warc

    rnd = random.Random(3)
    pages = [(1, "http://x/" + "".join(rnd.choice("0123456789abcdef") for _ in range(200_000)), "<p>" + "a" * 2000), (2, "http://y/", "<p>" + "a" * 2000), (3, "u", "short")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    files = warc.write_archives(warc.mark_revisits(df), str(tmp_path))
    got = {r["page_id"]: r for r in warc.read_archives(files, str(tmp_path), split_bytes=30_000).collect()}
    assert sorted(got) == [1, 2, 3] and got[1]["url"] == pages[0][1] and got[1]["record_type"] == "revisit" and got[2]["html"] == pages[1][2]


def test_tree_keeps_the_contexts_that_a_plain_count_keeps(spark):
    import math

    from pressgrain.llm.lm_score import fit_tree, words_of

    rnd = random.Random(12)
    texts = [" ".join("".join(rnd.choice(["ab", "ba", "abc", "c"]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(0, 40))) for _ in range(60)] + [None, ""]
    depth, least_root = 3, 0.2
    counts, total = {}, 0
    for text in texts:
        stream = b" ".join(words_of(text)) + b"\n"
        for i, symbol in enumerate(stream):
            total += 1
            before = (b"\n" + stream[:i])[-depth:]
            for length in range(len(before) + 1):
                counts.setdefault(before[len(before) - length :], {}).setdefault(symbol, 0)
                counts[before[len(before) - length :]][symbol] += 1
    kept = set()
    for context, nexts in counts.items():
        n, shorter = sum(nexts.values()), counts[context[1:]]
        if context and n >= max(2, least_root * math.sqrt(total)):
            gain = sum(c * math.log(c / n / (shorter[s] / sum(shorter.values()))) for s, c in nexts.items())
            if gain > len(nexts) / 2 * math.log(n) + 3:
                kept.add(context)
    tree = fit_tree(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), depth, least_root)
    assert kept and {c for c in kept if len(c) == 3}

    def probability(context, symbol):
        if not context:
            n = counts[b""]
            return (n.get(symbol, 0) + len(n) / A) / (total + len(n))
        parent = probability(context[1:], symbol)
        if context not in kept:
            return parent
        n = counts[context]
        return (n.get(symbol, 0) + len(n) * parent) / (sum(n.values()) + len(n))

    some = [words_of(t) for t in texts[:10]]
    want = []
    for words in some:
        stream = b" ".join(words) + b"\n"
        want += [math.log10(probability((b"\n" + stream[:i])[-depth:], s)) for i, s in enumerate(stream)]
    assert np.allclose(tree.score(symbols(some)), want, atol=1e-4)
