"""Probabilistic suffix tree over the bytes of tokens, and its automaton."""

from __future__ import annotations

import numpy as np

#: Bytes between tokens and behind the last one; no token holds white space. A zero byte in a token counts as byte 1.
BLANK, END = 0x20, 0x0A
A = 256


def symbols(texts: list[list[bytes]]) -> np.ndarray:
    """Bytes of the tokens of some texts: a blank between two tokens, END behind the last."""
    joined = b"\n".join(b" ".join(words) for words in texts) + b"\n"
    out = np.frombuffer(joined, np.uint8).copy()
    out[out == 0] = 1
    return out


def grams(stream: np.ndarray, depth: int) -> np.ndarray:
    """Code of each position: the symbol in the lowest byte, the symbols before it above, the nearest lowest.

    A context reaches back to the END before its text at most; what would lie before that is 0.
    """
    padded = np.concatenate([np.zeros(depth, np.uint8), [np.uint8(END)], stream])
    code = padded[depth + 1 :].astype(np.int64)
    ended = np.zeros(len(stream), bool)
    for back in range(1, depth + 1):
        older = padded[depth + 1 - back : len(padded) - back].astype(np.int64)
        older[ended] = 0
        code |= older << (8 * back)
        ended |= older == END
    return code


class GramCounter:
    """Counts of codes, merged as they come; holds the distinct codes only."""

    def __init__(self, buffer: int = 1 << 21):
        self.codes, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size, self.buffer = 0, buffer

    def add(self, codes: np.ndarray) -> None:
        self.waiting.append(codes)
        self.size += len(codes)
        if self.size >= self.buffer:
            self.merge()

    def merge(self) -> None:
        if self.waiting:
            new, n = np.unique(np.concatenate(self.waiting), return_counts=True)
            codes = np.concatenate([self.codes, new])
            order = np.argsort(codes, kind="stable")
            codes, counts = codes[order], np.concatenate([self.counts, n])[order]
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
            self.codes, self.counts = codes[first], np.add.reduceat(counts, first) if len(first) else counts
            self.waiting, self.size = [], 0


class SuffixAutomaton:
    """States of the tree with their next-symbol distributions and moves."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int, contexts: dict[int, np.ndarray], block: int = 4096):
        """``codes`` and ``counts``: next symbols (lowest byte) of all candidate contexts, as many bytes above as the
        context is long. ``contexts``: by length, the contexts that passed the divergence test."""
        # prefixes of a context are needed to walk to it; they predict as their longest retained suffix does
        states = {0: np.zeros(1, np.int64), 1: np.union1d(contexts.get(1, np.empty(0, np.int64)), [END])}
        for length in range(2, depth + 1):
            states[length] = np.unique(contexts.get(length, np.empty(0, np.int64)))
        for length in range(depth, 1, -1):
            states[length - 1] = np.union1d(states[length - 1], states[length] >> 8)
        self.base = np.cumsum([0] + [len(states[n]) for n in range(depth + 1)])
        total = int(self.base[-1])
        used = np.zeros(A, bool)
        used[np.unique(codes & 0xFF)] = True
        used[[BLANK, END]] = True
        #: symbols that never occurred share column 0
        self.column = np.where(used, np.cumsum(used), 0).astype(np.uint8 if used.sum() < 256 else np.uint16)
        width = int(used.sum()) + 1
        self.move = np.zeros((total, width), np.int32)
        # probabilities, turned into logarithms in place at the end
        self.log = np.empty((total, width), np.float32)
        alphabet = np.concatenate([[0], np.flatnonzero(used)])
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
        retained = {n: np.isin(states[n], contexts.get(n, np.empty(0, np.int64))) for n in range(1, depth + 1)}
        for length in range(depth + 1):
            # some thousand states at a time, so that the tables above are all that grows with their number
            for at in range(0, len(states[length]), block):
                self._predict(states, codes, counts, retained, length, at, block)
            here = states[length]
            rows = self.base[length] + np.arange(len(here))
            for k in range(1, width):
                self.move[rows, k] = self._longest(states, (here << 8) | alphabet[k], min(length + 1, depth))
        for at in range(0, total, block):
            np.log10(self.log[at : at + block], out=self.log[at : at + block])
        self.start = int(self.base[1] + np.searchsorted(states[1], END))
        self.depth = depth

    def _predict(self, states: dict[int, np.ndarray], codes: np.ndarray, counts: np.ndarray, retained: dict[int, np.ndarray], length: int, start: int, block: int) -> None:
        """Next-symbol probabilities of some states, from their counts and the states of the next shorter contexts."""
        here = states[length][start : start + block]
        rows = slice(int(self.base[length]) + start, int(self.base[length]) + start + len(here))
        width = self.log.shape[1]
        if length:
            parents = self._longest(states, here & ((1 << (8 * (length - 1))) - 1), length - 1)
            parent_prob = self.log[parents].astype(np.float64)
        else:
            parent_prob = np.full((1, width), 1.0 / A)
        # next-symbol counts of the contexts here; each length has its own range of codes
        lo, hi = np.searchsorted(codes, here << 8), np.searchsorted(codes, (here << 8) + 256)
        row = np.repeat(np.arange(len(here)), hi - lo)
        at = np.arange(len(row)) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
        seen = np.zeros((len(here), width))
        seen[row, self.column[codes[at] & 0xFF]] = counts[at]
        if length:
            seen[~retained[length][start : start + block]] = 0
        n, kinds = seen.sum(axis=1, keepdims=True), (seen > 0).sum(axis=1, keepdims=True)
        # Witten-Bell: as much goes to the shorter context as there were kinds of next symbols
        self.log[rows] = np.where(n > 0, (seen + kinds * parent_prob) / np.maximum(n + kinds, 1), parent_prob)

    def _longest(self, states: dict[int, np.ndarray], wanted: np.ndarray, longest: int) -> np.ndarray:
        """Row of the longest state that is a suffix of each wanted context."""
        found = np.zeros(len(wanted), np.int64)
        todo = np.ones(len(wanted), bool)
        for length in range(longest, 0, -1):
            key = wanted & ((1 << (8 * length)) - 1)
            at = np.minimum(np.searchsorted(states[length], key), len(states[length]) - 1) if len(states[length]) else None
            if at is not None:
                hit = todo & (states[length][at] == key)
                found[hit] = self.base[length] + at[hit]
                todo &= ~hit
        return found

    def score(self, stream: np.ndarray, lanes: int = 2048) -> np.ndarray:
        """log10 probability of each symbol. The stream is walked in lanes side by side; a state depends on the last
        ``depth`` symbols only, so each lane starts as many symbols early."""
        n, depth = len(stream), self.depth
        steps = max(-(-n // lanes), 4 * depth)
        lanes = -(-n // steps)
        column = self.column[np.concatenate([np.full(depth, END, np.uint8), stream, np.full(lanes * steps - n, END, np.uint8)])]
        grid = np.lib.stride_tricks.sliding_window_view(column, depth + steps)[::steps].T
        state = np.zeros(lanes, np.int64)
        out = np.empty((steps, lanes), np.float32)
        width = self.move.shape[1]
        move, log = self.move.reshape(-1), self.log.reshape(-1)
        for t in range(depth + steps):
            at = state * width + grid[t]
            if t >= depth:
                out[t - depth] = log[at]
            state = move[at]
        return out.T.reshape(-1)[:n]
