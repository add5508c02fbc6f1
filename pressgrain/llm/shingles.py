"""Word shingles as hashes, and SuperMinHash signatures of their sets."""

from __future__ import annotations

import numpy as np
import xxhash

from pressgrain.llm.common import mix64


class _Words(dict):
    """Hash of each word; kept for the words met first, so that memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000:
            self[word] = value
        return value


_WORDS = _Words()
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words, A-Z lower-cased, words split at ASCII white space.

    With fewer words the whole sequence is one shingle; no words give the empty set.
    """
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    used = min(n, width)
    with np.errstate(over="ignore"):
        run = np.full(n - used + 1, used, np.uint64)
        for i in range(used):
            run = mix64(run * _ODD[0] + hashes[i : n - used + 1 + i])
    return np.unique(run)


def super_min_hash(sets: list[np.ndarray], size: int, at_once: int = 1 << 16) -> np.ndarray:
    """SuperMinHash signatures (Ertl 2017) of non-empty sets, one row of ``size`` 32-bit words for each.

    Every element walks through a random permutation of the positions, one place a level, with a random fraction; at level j
    it offers j + fraction to the position it is at, and a position keeps the least offer. So the offers of one
    element are spread evenly over the positions, which lowers the variance. Once all positions of a set hold offers of
    earlier levels nothing can change any more, and its elements stop. Elements are handled side by side in pieces of
    ``at_once``, and a set that is cut into pieces takes the least offers of them.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    best = np.full(len(sets) * size, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(every), at_once):
        seed, doc = every[start : start + at_once], owner[start : start + at_once]
        first, last = doc[0], doc[-1] + 1
        local = np.full((last - first) * size, np.iinfo(np.uint64).max, np.uint64)
        row = doc - first
        order = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.int32), (len(seed), 1))
        with np.errstate(over="ignore"):
            for level in range(size):
                u = mix64(seed + _ODD[1] * np.uint64(level + 1))
                swap = level + ((u >> np.uint64(32)) % np.uint64(size - level)).astype(np.int64)
                each = np.arange(len(seed))
                place = order[each, swap]
                order[each, swap] = order[:, level]
                order[:, level] = place
                np.minimum.at(local, row * size + place, (np.uint64(level) << np.uint64(32)) | (u & np.uint64(0xFFFFFFFF)))
                # offers of later levels are larger than all of this one
                open_sets = (local.reshape(-1, size) >= np.uint64(level + 1) << np.uint64(32)).any(axis=1)
                go = open_sets[row]
                if not go.all():
                    seed, row, order = seed[go], row[go], order[go]
                    if not len(seed):
                        break
        part = best[first * size : last * size]
        np.minimum(part, local, out=part)
    return (mix64(best) & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(len(sets), size)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """64-bit key of each band of ``rows`` positions, the band's number included."""
    n, size = signatures.shape
    bands = signatures.reshape(n, size // rows, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix64(np.arange(size // rows) + 1), (n, size // rows))
        for i in range(rows):
            key = mix64(key * _ODD[2] + bands[:, :, i])
    return key.astype(np.int64)
