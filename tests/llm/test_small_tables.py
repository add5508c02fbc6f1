"""Every operator on nulls, empty texts, repeated rows, empty tables and further columns with clashing names."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pressgrain.llm import decontaminate, html_text, lang_id, line_chunks, lm_score, near_text, near_vectors, packing, token_file, warc
from pressgrain.llm.common import held_out, shared_folder

SCHEMA = "doc_id long, text string, lang string, node string, chunk string, part string, score string"
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(f"wort{i % 977}" for i in range(20_000))
ROWS = [
    (1, " ".join(WORDS[:60]), "en"), (2, " ".join(WORDS[:60]), "en"), (3, " ".join([*WORDS[:59], "changed"]), "en"),
    (4, " ".join(WORDS[100:160]), "de"), (5, "", "en"), (6, None, "en"), (7, "One", None), (7, "One", None), (8, "?? 12 !!", "fr"),
    (None, "no id here at all", "en"), (9, LONG, "de"), (10, " \n\t ", "en"), (11, "Ünï cödé é́ \x00 a<|endoftext|>b", "fr"), (12, "A\nB\n" * 3, "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, "x", "x", "x", "x") for i, t, g in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def brute_groups(rows, width, percent):
    def shingles(text):
        w = words(text)
        return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    group = {i: i for i, _ in sets}
    for _ in sets:
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    return {i: (len(s), group[i]) for i, s in sets}


def test_near_text(docs, empty):
    for width, percent in ((3, 85), (5, 80)):
        got = near_text.near_duplicates(docs, width, percent).collect()
        want = brute_groups([(i, t) for i, t, _ in ROWS], width, percent)
        assert len(got) == len(ROWS)
        for r in got:
            if r["doc_id"] is None:
                assert (r["component_id"], r["kept"]) == (None, True)
            else:
                assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
                assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_text.near_duplicates(empty).count() == 0


def test_lm_score(docs, empty):
    got = lm_score.score_texts(docs, held_out("doc_id", 5, 1)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = {}
    for i, t, _ in ROWS:
        if not held(i):
            for w in [*words(t), b"\n"]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), held(i), len(words(t)) + 1, sum(w in counts for w in [*words(t), b"\n"]), round(sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), b"\n"]), 6))
        for i, t, _ in ROWS)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert lm_score.score_texts(empty, held_out("doc_id", 5, 1)).count() == 0
    unlearned = lm_score.score_texts(docs, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 for r in unlearned)


def test_language(docs, empty):
    dictionaries = lang_id.fit_dictionaries(docs)
    got = lang_id.identify(docs, dictionaries)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score", "accepted"]
    for r in got.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in ("en", "de", "fr")) == letters and 0 <= r["score"] <= 1
        assert letters or (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
    assert lang_id.fit_dictionaries(empty) == {} and lang_id.identify(empty, dictionaries).count() == 0
    assert {r["lang_pred"] for r in lang_id.identify(docs, {}).collect()} == {"und"}


def test_packing_and_token_files(spark, docs, empty):
    for name, kind, end in (("byte_bpe_50k.json", "lead", 1), ("word_bpe_49k.json", "drop", 2)):
        path = public_tokenizers.path(name)
        tokenizer = Tokenizer.from_file(path)
        ids = {}
        for i, t, _ in ROWS:
            ids.setdefault(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4"))
        pieces = packing.pack(docs, path, kind, end).collect()
        assert sum(r["length"] for r in pieces) == sum(len(ids[i]) for i, _, _ in ROWS)
        sequences = {}
        for r in pieces:
            own = ids[r["doc_id"]]
            assert r["doc_tokens"] == len(own) and zlib.crc32(own[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert packing.pack(empty, path, kind, end).count() == 0

        for block in (1 << 19, 50):
            folder = shared_folder(spark, "token-files")
            got = token_file.read_token_files(token_file.write_token_files(docs, path, kind, end, folder, block), folder).orderBy("start").collect()
            at = 0
            assert [r["doc_id"] for r in got] == sorted((i for i, _, _ in ROWS), key=lambda i: -1 if i is None else i)
            for r in got:
                assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids[r["doc_id"]]), zlib.crc32(ids[r["doc_id"]].tobytes()))
                at += r["n_tokens"]
        folder = shared_folder(spark, "token-files")
        assert token_file.read_token_files(token_file.write_token_files(empty, path, kind, end, folder), folder).count() == 0


def test_line_chunks(spark, empty):
    common = "\n".join(f"this is line {i} of a passage that many documents share" for i in range(30))
    rows = [(i, f"own start {i * 31}\nsecond own line {i * 17}\n{common}\nown end {i * 7}") for i in range(4)]
    rows += [(10, None), (11, ""), (12, "just one line"), (None, "a\nb\nc"), (13, common), (13, common), (14, f"{common}\nafter")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("kept")).withColumn("id", F.lit(7)).withColumn("part", F.lit(1)).withColumn("hash", F.lit(1))
    out = line_chunks.remove_repeated_chunks(docs)
    assert out.columns == [*docs.columns, "n_removed_chunks"]
    got = out.collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        if r["doc_id"] in (0, 10, 11, 12, None):
            assert (r["text"], r["n_removed_chunks"]) == (texts[r["doc_id"]], 0)
        else:
            # what is left is in the order of the text, and own lines are all there
            before, after = texts[r["doc_id"]].split("\n"), r["text"].split("\n")
            assert r["n_removed_chunks"] > 0 and sum("passage" in x for x in after) < 12
            assert [x for x in after if x and "passage" not in x] == [x for x in before if "passage" not in x]
            rest = iter(before)
            assert all(x in rest for x in after if x)
    assert line_chunks.remove_repeated_chunks(empty).count() == 0


def plain_chunks(spark, text, divisor):
    """Chunks by a loop over the lines, with the engine's hash of one value and of two."""
    lines = text.split("\n")
    df = spark.createDataFrame([(i, x.strip(" ")) for i, x in enumerate(lines)], "i int, x string").withColumn("h", F.xxhash64("x"))
    hashes = [r["h"] for r in df.orderBy("i").collect()]
    pairs = spark.createDataFrame([(i, hashes[i - 1] if i else 0, h) for i, h in enumerate(hashes)], "i int, a long, b long").withColumn("r", F.xxhash64("a", "b"))
    chunks, now = [], []
    for x, r in zip(lines, [r["r"] for r in pairs.orderBy("i").collect()]):
        now.append(x)
        if r % divisor == 0:
            chunks.append(now)
            now = []
    return [("\n".join(c), len(c)) for c in [*chunks, now] if c]


def test_chunk_boundaries_do_not_shift(spark):
    body = [f"line number {i} says {i * i}" for i in range(60)]
    texts = ["\n".join(body), "\n".join(["new first line", *body]), "\n".join([*body[:30], "put in", *body[30:]]), "\n\n x \n", ""]
    got = line_chunks.with_chunks(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", 3).orderBy("i").collect()
    for r, text in zip(got, texts):
        assert [(c["part"], c["n"]) for c in r["_chunks"]] == plain_chunks(spark, text, 3)
    first, second, third = ({c["part"] for c in r["_chunks"]} for r in got[:3])
    assert len(first - second) <= 1 and len(first - third) <= 2


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 16))
    rows = [(i, base[i % 12] + rng.standard_normal(16) * (0.0 if i % 3 == 0 else 0.12)) for i in range(90)]
    odd = [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [None] * 16), (205, [1.0] * 5), (206, [2.0] * 5), (207, [float("inf")] + [1.0] * 15), (None, list(map(float, base[0])))]
    data = [(i, [float(np.float32(x)) for x in v]) for i, v in rows] + odd + [(0, [float(np.float32(x)) for x in rows[0][1]])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("node", F.lit("x")).withColumn("copies", F.lit("x"))
    got = near_vectors.near_vectors(df).collect()
    live = [(i, np.array(v, float)) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, group = {}, {i: i for i, _ in live}
    near = [[len(a) == len(b) and a @ b >= 0.9 * np.linalg.norm(a) * np.linalg.norm(b) for _, b in live] for _, a in live]
    for x, (i, _) in enumerate(live):
        links[i] = sum(near[x]) - 1
    for _ in live:
        for x, (i, _) in enumerate(live):
            for y, (j, _) in enumerate(live):
                if near[x][y]:
                    group[i] = group[j] = min(group[i], group[j])
    assert len(got) == len(data)
    for r in got:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"]) == ((links[i], group[i]) if i in links else (0, i))
        assert r["kept"] == (i == r["component_id"])
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_contamination(spark, docs, empty):
    item = "the quick brown fox jumps over the lazy dog while the slow green turtle looks on from the riverbank"
    edited = item.replace("quick", "quack").replace("green ", "").upper()
    rows = [(1, f"before {item} after"), (2, f"x {edited}"), (3, item[:60]), (4, None), (5, ""), (6, "tiny"), (None, item.replace(" ", "\n ")), (7, LONG + item + LONG), (8, item * 3), (8, item * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(5)).withColumn("place", F.lit("p"))
    bench = spark.createDataFrame([(1, item), (2, None), (None, item), (3, ""), (4, "tiny"), (5, item)], "item_id long, text string").withColumn("doc_id", F.lit(0))
    for block in (1 << 21, 10):
        got = decontaminate.contamination(df, bench, block_chars=block)
        found = sorted(((str(r["doc_id"]), r["item_id"], r["edits"]) for r in got.collect()))
        want = [(str(i), k, e) for i, e in ((1, 0), (2, 7), (None, 0), (7, 0), (8, 0), (8, 0)) for k in (1, 5)] + [("6", 4, 0)]
        assert found == sorted(want)
        left = decontaminate.remove_contaminated(df, bench, block_chars=block)
        assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5]
    assert decontaminate.contamination(df, bench.limit(0)).count() == 0 and decontaminate.remove_contaminated(df, bench.limit(0)).count() == len(rows)
    assert decontaminate.contamination(empty, bench).count() == 0


def edit_distance_in(item, text):
    """Least edits from ``item`` to a part of ``text``, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            row[j] = min(last[j - 1] + (a != b), last[j] + 1, row[j - 1] + 1)
    return min(row)


def test_edited_passages_against_the_whole_table():
    import random

    rnd = random.Random(4)
    letters = "aeinrst "
    items = [(i, "".join(rnd.choice(letters) for _ in range(n)).strip()) for i, n in enumerate((12, 25, 60, 110, 200))]
    index = decontaminate.BenchmarkIndex(items, 10, 0.08)
    for i, item in items * 12:
        text = list(item)
        for _ in range(rnd.randint(0, len(item) // 9)):
            at = rnd.randrange(len(text))
            text[at:at + rnd.choice((0, 1, 1))] = rnd.choice(("", "x", "y"))
        doc = decontaminate.normal("".join(rnd.choice(letters) for _ in range(80)) + "".join(text) + "".join(rnd.choice(letters) for _ in range(50)))
        clean = decontaminate.normal(item)
        budget = min(int(0.08 * len(clean)), len(clean) // 10 - 1)
        edits = edit_distance_in(clean, doc)
        found = {k: e for k, _, e in decontaminate.find_in(index, [doc])[0]}
        assert found.get(i) == (edits if edits <= budget else None)


def test_html_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header><a href=/>Home</a></header><nav><ul><li><a href=/x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <div id=main><article><h1>Head&amp;line</h1><p>First&nbsp;para, with <b>bo</b>ld, commas,\n and   space.<br>line<p>Second &#233; para that is long enough to count, really.
    <ul><li>one<li>two</ul><div class="ad">Buy!</div><form><input value=x>Sign up</form></article>
    <aside>Side</aside><section class="comments"><p>A reader, who comments, at length, and more.</p></section></div><footer>&copy; all</footer></body></html>"""
    want = "Head&line First para, with bold, commas, and space. line Second é para that is long enough to count, really. one two"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (3, "v", ""), (4, "w", "<p>cut off <b>here &lt;"), (5, "x", "<div>" * 5000 + "<p>deep, text"), (None, "y", "<!-- open <p>gone"), (6, "z", "<script>never closed <p>x</p>"), (7, "p", "plain text only")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html_text.extract_text(df).collect()}
    texts = {k: t for k, (t, n) in got.items()}
    assert all(n == len(t) for t, n in got.values())
    assert texts[1, "u"] == want
    assert (texts[2, None], texts[3, "v"], texts[4, "w"], texts[5, "x"], texts[7, "p"]) == ("", "", "cut off here <", "deep, text", "plain text only")
    assert texts[6, "z"] == ""
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_warc(spark):
    big = "<p>" + "ü" * 900
    rows = [(1, "u", big), (2, "u", big), (3, None, big), (3, None, big), (4, "a\r\nb", "short"), (5, "b", "short"), (6, "c", None), (7, "d", ""), (None, "e", big), (8, "f", "x" * 999), (9, "f", "x" * 999), (10, "g", LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit(1)).withColumn("bytes", F.lit(1)).repartition(3)
    want = []
    for i, u, h in rows:
        raw = (h or "").encode()
        revisit = h == big and i != 3
        want.append((str(i), (u or "").replace("\r\n", "%0D%0A"), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None, None if revisit else h or ""))
    for split in (4 << 20, 97):
        folder = shared_folder(spark, "warc")
        got = warc.read_archives(warc.write_archives(warc.mark_revisits(df), folder, roll_bytes=1500), folder, split)
        have = [(str(r["page_id"]), r["url"] or "", r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["html"]) for r in got.collect()]
        assert sorted(have, key=repr) == sorted(want, key=repr)
    folder = shared_folder(spark, "warc")
    assert warc.read_archives(warc.write_archives(warc.mark_revisits(df.limit(0)), folder), folder).count() == 0


def test_false_gzip_magic_is_passed_over(tmp_path):
    import pyarrow as pa

    from pressgrain.llm.warc import GZIP_MAGIC, record, records_in

    noise = GZIP_MAGIC + b"\x00" * 40 + GZIP_MAGIC
    parts = [record(i, "u", f"<p>{i}" * 50, len(f"<p>{i}" * 50), "00" * 20, None, False) for i in range(20)]
    data = noise + b"".join(p + (noise if i % 5 == 0 else b"") for i, p in enumerate(parts))
    for step in (13, 200, 10_000):
        found = []
        for start in range(0, len(data), step):
            found += [h["warc-record-id"] for h, _ in records_in(pa.BufferReader(data), start, min(start + step, len(data)))]
        assert found == [f"<urn:page:{i}>" for i in range(20)]


def test_warc_sql_agrees(spark):
    from pressgrain.llm.queries import ORACLES, QUERIES

    base = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{base}/pages.parquet'")
    df = QUERIES["op10_warc"](spark, base)
    cols = sorted(df.columns)
    cur = duck.execute(ORACLES["op10_warc"])
    names = [c[0] for c in cur.description]
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
