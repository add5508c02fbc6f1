"""Token ids of whole texts by the tokenizers library: texts are cut at blanks, and each distinct piece is encoded once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space beside white space or at an end of the text (all that Unicode calls white space).
_UNSAFE = r"[\s\p{Z}\x{85}\x{0b}]{2}|^[\s\p{Z}\x{85}\x{0b}]|[\s\p{Z}\x{85}\x{0b}]$"
#: Punctuation behind a Latin letter begins a pre-token in both kinds. The letters are those below U+0250 but U+0130, whose
#: lower case ends in a combining mark that joins the punctuation.
_LETTER = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]"
_LATIN = rf"({_LETTER})([.,;:!?$%&*#])"
#: The letters by code point, and the punctuation by byte.
_LETTERS = np.array([chr(i).isalpha() and i < 0x250 and i not in (0xAA, 0xB5, 0xBA, 0x130) for i in range(0x280)])
_MARKS = np.isin(np.arange(256), list(b".,;:!?$%&*#"))
#: Words of these letters with a blank between them.
_WORDS = re.compile("[L]+(?: [L]+)*".replace("L", "".join(map(chr, np.flatnonzero(_LETTERS)))))
#: A blank or a line feed and no other white space behind it.
_ONE_WORD = r"^[ \n][^\s\p{Z}\x{85}\x{0b}]+$"
#: Latin letters only: one pre-token, and what a "drop" vocabulary normalizes there is upper case alone.
_WORD = f"^{_LETTER}+$"
#: A control character that stands between pieces encoded in one call; pieces that hold it are encoded alone.
_BETWEEN = "\x01"
_LOADED: dict[tuple[str, str], "PieceEncoder"] = {}


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _for_words(tokenizer, beyond_ascii: bool):
    """The tokenizer with its model alone, for lower-case Latin words with one blank between them: nothing is left to normalize, and white
    space parts the pre-tokens. Letters ``beyond_ascii`` are also to be written as bytes."""
    from tokenizers import Tokenizer, pre_tokenizers

    kept = json.loads(tokenizer.to_str())
    bare = Tokenizer.from_str(json.dumps(kept | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
    blanks = pre_tokenizers.WhitespaceSplit()
    bare.pre_tokenizer = pre_tokenizers.Sequence([blanks, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]) if beyond_ascii else blanks
    return bare


def _cut_and_drop(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces of all texts, bounds of each text's) of a large_string column without nulls: blanks and line feeds go, and punctuation behind a
    Latin letter begins a piece, as the pattern ``_LATIN`` says."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    starts = bounds[:-1] - bounds[0]
    blank = (data == 0x20) | (data == 0x0A)
    marks = np.flatnonzero(_MARKS[data])
    before, ahead = data[np.maximum(marks - 1, 0)].astype(np.int64), data[np.maximum(marks - 2, 0)].astype(np.int64)
    two = (before & 0xC0 == 0x80) & (ahead >= 0xC3) & (ahead <= 0xC9)  # the second byte of a letter of two
    begins = blank.copy()
    begins[marks[_LETTERS[np.where(two, (ahead & 0x1F) << 6 | before & 0x3F, np.where(before < 0x80, before, 0))]]] = True
    at = np.flatnonzero(begins)
    # a text's first piece begins before a blank at its start, or is empty if the text before ends in a letter and this one begins with a mark
    where = np.searchsorted(at, starts)
    gone = np.insert(blank[at], where, False)
    at = np.insert(at, where, starts)
    ends = np.append(at - (np.cumsum(gone) - gone), len(data) - np.count_nonzero(gone))
    pieces = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(data[~blank]))
    return pieces, np.append(where + np.arange(len(where)), len(at))


class PieceEncoder:
    """Encodes columns of texts piece by piece.

    Both kinds of vocabulary end a pre-token at a blank or a line feed between two other characters and before punctuation
    behind a letter, so the ids of a text are the ids of its pieces in order. ``kind`` says what becomes of the blank: "lead" (it starts the next piece) or
    "drop" (it vanishes; line feeds do too). In a "lead" text with two neighbouring white-space characters, or white
    space at an end, the cuts are not safe, and such texts are one piece. Distinct pieces of a column are looked
    up in the pieces met before, missing ones are encoded many a call, and the ids are gathered by an Arrow ``take``.
    Once ``limit`` pieces are kept, the more used half of them stays.
    """

    def __init__(self, path: str, kind: str, limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lead, self.limit = kind == "lead", limit
        if self.lead:
            names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
            # fixed values: how a byte-level vocabulary writes a blank and a line feed
            self.starts = {m: np.array([n.startswith(c) for n in names]) for m, c in ((" ", "Ġ"), ("\n", "Ċ"))}
        else:
            self.words, self.plain = _for_words(self.tokenizer, True), _for_words(self.tokenizer, False)
            # fixed value: how the other vocabulary writes the end of a pre-token
            self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        self.known: dict[str, int] = {}
        self.ids, self.sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        self.uses = np.zeros(0, np.int64)
        self.lists = pa.array([], pa.list_(pa.uint32()))

    def _forget(self) -> None:
        """Keep the half of the limit that was used most."""
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: self.limit // 2])
        names = list(self.known)
        self.known = {names[i]: n for n, i in enumerate(stay.tolist())}
        self.uses = self.uses[stay]
        self.lists = self.lists.take(pa.array(stay))
        self.ids, self.sizes = [self.lists.flatten().to_numpy()], [self.sizes[0][stay]]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        tokenizer = self.tokenizer
        if not self.lead and all(t.islower() and _WORDS.fullmatch(t) for t in texts):
            tokenizer = self.plain if all(map(str.isascii, texts)) else self.words
        return [np.asarray(e.ids, dtype=np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str], mark: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without white space, and how many each has, many pieces a call.

        A "lead" piece begins with ``mark``, a blank or a line feed, whose id starts with that character as no other id
        of the piece does; "drop" pieces are told apart by an id that none of them holds, or, if ``mark`` says that they are letters only and so
        one pre-token each, by the ids that end one.
        """
        if self.lead:
            ids = self._ids(["".join(pieces)])[0]
            at = np.flatnonzero(self.starts[mark][ids])
            if len(at) == len(pieces) and at[0] == 0:
                return ids, np.diff(np.append(at, len(ids)))
        elif mark == "word":
            ids = self._ids([" ".join(pieces)])[0]
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(pieces) and at[-1] == len(ids):
                return ids, np.diff(at, prepend=0)
        else:
            ids = self._ids([f" {_BETWEEN} ".join(pieces)])[0]
            between = self._ids([_BETWEEN])[0]
            at = np.flatnonzero(ids == between[0]) if len(between) == 1 else between
            if len(at) == len(pieces) - 1:
                kept = np.delete(ids, at)
                ends = np.append(at - np.arange(len(at)), len(kept))
                return kept, np.diff(ends, prepend=0)
        alone = self._ids(pieces)
        return np.concatenate(alone), np.array([len(a) for a in alone], np.int64)

    def _learn(self, missing: pa.Array) -> None:
        """Encode pieces that the store lacks and add them to it. A piece is written as it stands in the text, with the
        white space before it ("lead") or without ("drop")."""
        odd = pc.match_substring(missing, _BETWEEN)
        if self.lead:
            odd = pc.or_(odd, pc.invert(pc.match_substring_regex(missing, _ONE_WORD)))
            line = pc.starts_with(missing, "\n")
            groups = [(mark, missing.filter(pc.and_(pc.invert(odd), at))) for mark, at in ((" ", pc.invert(line)), ("\n", line))]
        else:
            word = pc.match_substring_regex(missing, _WORD)
            plain = pc.and_(word, pc.string_is_ascii(missing))
            groups = [("word", missing.filter(plain)), ("word", missing.filter(pc.and_not(word, plain))), ("", missing.filter(pc.invert(pc.or_(odd, word))))]
        for mark, group in groups:
            pieces = _strings(group)
            for i in range(0, len(pieces), 1000):
                some = pieces[i : i + 1000]
                self._add(some, *self._joined(some, mark))
        alone = _strings(missing.filter(odd))
        for i in range(0, len(alone), 1000):
            ids = self._ids(alone[i : i + 1000])
            self._add(alone[i : i + 1000], np.concatenate(ids), np.array([len(a) for a in ids], np.int64))

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.ids.append(ids)
        self.sizes.append(sizes)

    def _look_up(self, wanted: pa.Array) -> np.ndarray:
        """Place in the store of each of these distinct pieces, missing ones added."""
        if len(self.known) + len(wanted) > self.limit and len(self.known) > self.limit // 2:
            self._forget()
        names = _strings(wanted)
        at = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            self._learn(wanted.take(pa.array(fresh)))
            self.ids, self.sizes = [np.concatenate(self.ids)], [np.concatenate(self.sizes)]
            offsets = np.concatenate([[0], np.cumsum(self.sizes[0])]).astype(np.int32)
            self.lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.ids[0]))
            self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])
            at[fresh] = [self.known[names[i]] for i in fresh.tolist()]
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each) of a string column; null counts as empty."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole = None
        if self.lead:
            # every piece begins with its white space; a text's first one, with a line feed that is taken away again
            nothing, line = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
            whole = pc.or_(pc.match_substring(texts, "\x00"), pc.or_(pc.match_substring_regex(texts, _UNSAFE), pc.equal(texts, "")))
            marked = pc.binary_join_element_wise(line, pc.if_else(whole, nothing, texts), nothing)
            marked = pc.replace_substring(pc.replace_substring(marked, "\n", "\x00\n"), " ", "\x00 ")
            pieces = pc.split_pattern(pc.replace_substring_regex(marked, _LATIN, "\\1\x00\\2"), "\x00")
            flat, offsets = pieces.flatten().dictionary_encode(), pieces.offsets.to_numpy()
        else:
            flat, offsets = _cut_and_drop(texts)
            flat = flat.dictionary_encode()
        names = flat.dictionary
        if self.lead:
            at = self._look_up(names)
        else:
            # words that differ in case only are one piece
            lower = pc.if_else(pc.match_substring_regex(names, _WORD), pc.utf8_lower(names), names).dictionary_encode()
            at = self._look_up(lower.dictionary)[lower.indices.to_numpy()]
        np.add.at(self.uses, at, np.bincount(flat.indices.to_numpy(), minlength=len(at)))
        # first the lists of this column's pieces, so that the second, larger take reads a small store
        found = self.lists.take(pa.array(at)).take(flat.indices)
        ids, counts = found.flatten().to_numpy(), np.diff(found.offsets.to_numpy().astype(np.int64)[offsets - offsets[0]])
        if self.lead:
            keep = np.ones(len(ids), bool)
            keep[np.cumsum(counts) - counts] = False
            ids, counts = ids[keep], counts - 1
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False)) if whole else ()
        if len(odd):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for row, found in zip(odd.tolist(), self._ids(texts.take(pa.array(odd)).to_pylist())):
                parts[row] = found
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts


def encoder(path: str, kind: str, limit: int = 800_000) -> PieceEncoder:
    """The encoder of this Python worker for ``path``; it is loaded once and keeps ``limit`` pieces at most (600,000 take some 140 MB)."""
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = PieceEncoder(path, kind)
    _LOADED[path, kind].limit = limit
    return _LOADED[path, kind]


def closed(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` behind each text."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(counts + 1) - 1] = False
    out[inner] = ids
    return out, counts + 1


def text_slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut where their texts pass ``size`` bytes, so that memory follows the longest text and not the batch. What
    Arrow has freed goes back to the system after each slice, since the worker stays while other stages run."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
                pa.default_memory_pool().release_unused()
