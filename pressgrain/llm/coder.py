"""Range coder for token ids whose model mixes predictions of order 0 to 2.

One block codes ``n`` ids. The ids are cut into lanes of equal length that are coded side by side, so that every step is
a few array operations over all lanes; the model is shared by the lanes and starts anew in each block.

Model. Order 2 (the last two ids, hashed) and order 1 (the last id) each predict one id, the one that followed there
last, with a confidence of 0 to 3 from how often the prediction held. Order 0 predicts every id by its adaptive
frequency. The three are mixed with weights learned as coding goes on, one set of weights for each pair of confidences
and for whether the predictions agree. A coded id narrows the range to the share of the first order that predicts it,
and then to its share within that order, which is its frequency in order 0 and the whole in the others. Predictions are learned at every step, weights and frequencies at the steps
of ``_counted``. All shares are parts of a power of two, and order 0 has a table of which id a part belongs to.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"PGT3"
HEAD = "<4sIIIIII"  # magic, ids, lanes, steps, alphabet, bytes after the head, crc32 of those bytes
LANES, TABLE_BITS, FLAG_BITS, TOTAL_BITS = 8192, 18, 12, 20
FLAGS = 1 << FLAG_BITS
GAIN, LIMIT = 24, 1 << 22
U = np.uint64
LEAST = U(1 << 40)
TOP = U(48)


def _counted(step: int) -> bool:
    return step % 32 == 0 or step in (1, 2, 4, 8, 16)


class _Model:
    def __init__(self, alphabet: int, lanes: int, finds: bool):
        """``finds``: whether ids will be sought by their parts, which only the decoder does."""
        self.alphabet, self.finds = alphabet, finds
        self.bits = max(TOTAL_BITS, alphabet.bit_length() + 1)
        # guesses of order 2, then those of order 1, as id and confidence in one number
        self.kind = np.uint32 if alphabet < 1 << 30 else np.uint64
        self.guess = np.zeros((1 << TABLE_BITS) + alphabet, self.kind)
        self.last, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.place = np.empty((2, lanes), np.int64)
        self.hits = np.ones((32, 3), np.float64)
        self.hits[:, 2] = 4
        self.counts = np.ones(alphabet, np.int64)
        self.ids: list[np.ndarray] = []
        self.outcomes: list[np.ndarray] = []
        self.step = 0
        self._shares()

    def _shares(self) -> None:
        """Parts of FLAGS for each context and flag (order 2, order 1, order 0), and parts of 2**bits for each id."""
        size = np.empty((32, 3), np.uint64)
        size[:, :2] = (self.hits[:, :2] * ((FLAGS - 3) / self.hits.sum(axis=1))[:, None]).astype(np.uint64) + U(1)
        size[:, 2] = U(FLAGS) - size[:, 0] - size[:, 1]
        first = np.cumsum(size, axis=1) - size
        self.size, self.first = size.ravel(), first.ravel()
        self.until2, self.until1 = size[:, 0].copy(), first[:, 2].copy()
        total, whole = self.counts.sum(), 1 << self.bits
        # one part at least for each id; what is left or missing then is the most frequent id's
        parts = np.maximum(self.counts * (whole - np.count_nonzero(self.counts * whole < total)) // total, 1)
        if parts.sum() - whole > parts.max() // 2:
            parts = 1 + self.counts * (whole - self.alphabet) // total
        parts[parts.argmax()] += whole - parts.sum()
        # behind the ids stands what an order that predicts one id gives it
        self.starts, self.widths = np.zeros(self.alphabet + 1, np.uint64), np.full(self.alphabet + 1, whole, np.uint64)
        self.start, self.parts = self.starts[:-1], self.widths[:-1]
        self.start[:], self.parts[:] = np.cumsum(parts) - parts, parts
        if self.finds:
            self.owner = np.repeat(np.arange(self.alphabet, dtype=np.uint16 if self.alphabet <= 1 << 16 else self.kind), parts)

    def predict(self) -> None:
        """Guesses of both orders, and the context of their weights."""
        self.place[0] = (self.before * np.uint32(0x9E3779B1) + self.last * np.uint32(0x85EBCA6B)) >> np.uint32(32 - TABLE_BITS)
        np.add(self.last, 1 << TABLE_BITS, out=self.place[1], casting="unsafe", dtype=np.int64)
        self.held = self.guess.take(self.place, mode="clip")
        self.sure = self.held & self.kind(3)
        self.p = self.held >> self.kind(2)
        self.context = (self.sure[0] * self.kind(8) + self.sure[1] * self.kind(2) + (self.p[0] == self.p[1])).astype(np.int64)

    def learn(self, ids: np.ndarray, outcome: np.ndarray) -> None:
        """``outcome`` is the context times 3 and the flag."""
        sure = self.sure
        other = np.where(sure > 1, self.held - self.kind(2), ids << self.kind(2))
        self.guess[self.place] = np.where(self.p == ids, self.held + (sure < 3), other)
        self.before, self.last = self.last, ids.astype(np.uint32, copy=False)
        self.ids.append(ids)
        self.outcomes.append(outcome)
        self.step += 1
        if _counted(self.step):
            self.hits += np.bincount(np.concatenate(self.outcomes), minlength=96).reshape(32, 3)
            if self.hits.sum() > 1 << 17:
                self.hits = self.hits / 2 + 0.5
            self.counts += GAIN * np.bincount(np.concatenate(self.ids), minlength=self.alphabet)
            self.ids, self.outcomes = [], []
            if self.counts.sum() > LIMIT:
                self.counts = (self.counts + 1) >> 1
            self._shares()


def _settle(low: np.ndarray, span: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Put out 16 bits of every lane whose range has become small, until none is left: (lanes, their bits), a few rounds at most.

    A small range is kept within one run of equal upper bits first.
    """
    go = np.flatnonzero(span < LEAST)
    while len(go):
        a, b = low[go], span[go]
        across = np.flatnonzero((a ^ (a + b - U(1))) >> TOP)
        if len(across):
            b[across] = (~a[across] + U(1)) & (LEAST - U(1))
        bits, b = a >> TOP, b << U(16)
        low[go], span[go] = a << U(16), b
        yield go, bits
        go = go[b < LEAST]


def encode_block(ids: np.ndarray) -> bytes:
    """One self-contained block for ``ids`` (any unsigned integers below 2**31)."""
    n = len(ids)
    lanes = min(LANES, max(1, -(-n // 128)))
    steps = -(-n // lanes)
    alphabet = int(ids.max()) + 1 if n else 1
    model = _Model(alphabet, lanes, False)
    grid = np.zeros(lanes * steps, model.kind)
    grid[:n] = ids
    columns = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    out_lane, out_word = [], []
    with np.errstate(over="ignore"):
        for t in range(steps):
            now = columns[t]
            model.predict()
            miss2, miss1 = now != model.p
            miss = miss2 & miss1
            outcome = model.context * 3
            outcome += miss2
            outcome += miss
            unit = span >> U(FLAG_BITS)
            low += unit * model.first.take(outcome)
            unit *= model.size.take(outcome)
            unit >>= U(model.bits)
            sought = np.where(miss, now, model.alphabet)
            low += unit * model.starts.take(sought)
            span = unit * model.widths.take(sought)
            for go, bits in _settle(low, span):
                out_lane.append(go.astype(np.uint16))
                out_word.append(bits.astype("<u2"))
            model.learn(now, outcome)
        last = (low + (LEAST - U(1))) & ~(LEAST - U(1))
        every = np.arange(lanes, dtype=np.uint16)
        for shift in (48, 32):
            out_lane.append(every)
            out_word.append(((last >> U(shift)) & U(0xFFFF)).astype("<u2"))
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    body = np.bincount(lane, minlength=lanes).astype("<u4").tobytes() + word[np.argsort(lane, kind="stable")].tobytes()
    return struct.pack(HEAD, MAGIC, n, lanes, steps, alphabet, len(body), zlib.crc32(body)) + body


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; raises ValueError if it isn't whole."""
    magic, n, lanes, steps, alphabet, size, crc = struct.unpack_from(HEAD, block)
    body = block[struct.calcsize(HEAD) : struct.calcsize(HEAD) + size]
    if magic != MAGIC or len(body) != size or zlib.crc32(body) != crc:
        raise ValueError("damaged block")
    lengths = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    # four zeros stand for what lies behind the end of the last lane
    words = np.concatenate([np.frombuffer(body, "<u2", offset=4 * lanes), np.zeros(4, "<u2")]).astype(np.uint64)
    ends = np.cumsum(lengths)
    at = ends - lengths

    def take(which: np.ndarray) -> np.ndarray:
        here = at[which]
        at[which] = here + 1
        return np.where(here < ends[which], words.take(here, mode="clip"), U(0))

    model = _Model(alphabet, lanes, True)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    code, every = np.zeros(lanes, np.uint64), np.arange(lanes)
    columns = np.empty((steps, lanes), model.kind)
    with np.errstate(over="ignore"):
        for _ in range(4):
            code = (code << U(16)) | take(every)
        for t in range(steps):
            model.predict()
            unit, above = span >> U(FLAG_BITS), code - low
            miss2, miss = above >= unit * model.until2.take(model.context), above >= unit * model.until1.take(model.context)
            outcome = model.context * 3
            outcome += miss2
            outcome += miss
            skip = unit * model.first.take(outcome)
            unit *= model.size.take(outcome)
            unit >>= U(model.bits)
            above -= skip
            found = model.owner.take((above // unit).view(np.int64), mode="clip")
            now = np.where(miss, found, np.where(miss2, model.p[1], model.p[0]))
            sought = np.where(miss, found, model.alphabet)
            skip += unit * model.starts.take(sought)
            low += skip
            span = unit * model.widths.take(sought)
            for go, _ in _settle(low, span):
                code[go] = (code[go] << U(16)) | take(go)
            model.learn(now, outcome)
            columns[t] = now
    return columns.T.reshape(-1)[:n].astype(np.uint32)
