"""CPU and memory of the coder, the encoder and their workers (op8_token_files and the pipeline in round 3)."""

import numpy as np
import pyarrow as pa
import pytest

from pressgrain.llm import coder, repeats, tokens


@pytest.mark.parametrize("counts", ["even", "one", "steep"])
def test_parts_of_ids_fill_a_power_of_two(counts):
    """A share is found by a shift and one look-up, and no id is without a part."""
    model = coder._Model(50_000, 8, True)
    model.counts = {"even": np.ones(50_000, np.int64), "one": np.where(np.arange(50_000) == 7, 1 << 22, 1), "steep": (1 << 20) // np.arange(1, 50_001) + 1}[counts].astype(np.int64)
    model._shares()
    assert model.parts.min() >= 1 and int(model.parts.sum(dtype=np.int64)) == 1 << model.bits == len(model.owner)
    assert all(model.owner[model.start[i]] == i == model.owner[model.start[i] + model.parts[i] - 1] for i in (0, 7, 49_999))


def test_lanes_put_out_bits_only_when_they_must():
    low, span = np.full(1000, 1 << 60, np.uint64), np.full(1000, 1 << 44, np.uint64)
    assert list(coder._settle(low, span)) == []
    span[5] = 1 << 30
    assert [go.tolist() for go, _ in coder._settle(low, span)] == [[5]]


def test_slices_and_pieces_of_a_worker_are_bounded():
    batch = pa.record_batch([pa.array(["x" * (1 << 20)] * 12)], ["text"])
    assert max(b.num_rows for b in tokens.text_slices([batch], 0)) <= 4
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    kept = tokens.encoder(path, "drop", 1000)
    assert kept.limit == 1000 and tokens.encoder(path, "drop") is kept and kept.limit == 800_000


def test_pieces_of_letters_are_encoded_without_separators(monkeypatch):
    import public_tokenizers

    own = tokens.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), "drop")
    seen, plain = [], own._ids
    monkeypatch.setattr(own, "_ids", lambda texts: seen.extend(texts) or plain(texts))
    ids, counts = own.encode(pa.array(["Wonderful unheardofword, x9 don't zzqxkj"]))
    assert any("unheardofword" in t and tokens._BETWEEN not in t for t in seen)
    assert ids.tolist() == plain(["Wonderful unheardofword, x9 don't zzqxkj"])[0].tolist() and counts.tolist() == [len(ids)]


def test_pipeline_bounds_the_pieces_its_workers_keep(monkeypatch):
    """The Python workers stay for the later stages, so the packing of the pipeline may not fill them."""
    import corpus_pipeline

    asked = {}
    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda docs, path, **more: asked.update(more))
    corpus_pipeline.sequences(None, None, "")
    assert asked["kept_pieces"] <= 400_000


def test_words_of_two_cases_are_one_piece_and_bypass_the_normalizer(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, whole = tokens.PieceEncoder(path, "drop"), Tokenizer.from_file(path)
    texts = ["Étrange étrange ÉTRANGE$$$ unheardof UnheardOf%%%", None, ".b", "H\u0331 I\u0307x \u0130i <|STARTOFTEXT|> \u1e9e", "\u0250. \u024f. \u00d7! \u00aa?", "", " a  b\n"]
    ids, counts = own.encode(pa.array(texts))
    wanted = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(wanted, []) and counts.tolist() == [len(w) for w in wanted]
    assert {"étrange", "unheardof", "$$$"} <= set(own.known) and not {"Étrange", "UnheardOf", "ÉTRANGE$$$"} & set(own.known)
    monkeypatch.setattr(own, "tokenizer", None)
    assert own.encode(pa.array(["Quiteunseen ÇAUSSI"]))[1].tolist() == [len(whole.encode("quiteunseen çaussi", add_special_tokens=False).ids)]


def test_letters_and_marks_are_the_same_as_in_the_patterns():
    import re

    letter = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), tokens._LETTER))
    assert [i for i in range(len(tokens._LETTERS)) if bool(letter.match(chr(i))) != tokens._LETTERS[i]] == []
    marks = re.compile(tokens._LATIN[tokens._LATIN.rindex("(") :])
    assert [i for i in range(128) if bool(marks.match(chr(i))) != tokens._MARKS[i]] == []


def test_transforms_sort_first_by_as_many_symbols_as_a_word_holds(monkeypatch):
    """op11_repeats: segments share long runs, so every doubling counts."""
    strings = [b"abc" * 40 + bytes([65 + i]) + b"xyz" * 10 for i in range(20)]
    ends = [(s[i:], k, s[i - 1] + 1 if i else 0) for k, s in enumerate(strings) for i in range(len(s) + 1)]
    # end marks are smaller than bytes, and those of earlier strings smaller than later ones
    wanted = [before for _, _, before in sorted(ends, key=lambda e: ([c + len(strings) for c in e[0]] + [e[1]]))]
    sorts, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: sorts.append(1) or plain(*a, **k))
    assert repeats.ShardTransform.build(strings).symbols.tolist() == wanted
    assert len(sorts) <= 7


@pytest.mark.parametrize("width", [1, 2, 3, 64, 69, 100])
def test_least_of_sliding_runs(width):
    x = np.random.default_rng(1).integers(0, 1000, 300).astype(np.uint64)
    assert repeats._sliding(x, width, np.minimum).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]
