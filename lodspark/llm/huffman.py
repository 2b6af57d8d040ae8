"""Canonical length-limited Huffman codes: lengths by package-merge, vectorised coding and table-driven decoding."""

from __future__ import annotations

import numpy as np


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for symbols with these counts; 0 where the count is 0.

    Package-merge: each level merges the symbols with pairs of the level below; of the first 2n - 2
    items of the top level, symbols get one bit each and pairs are followed down.
    """
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit in codes of {limit} bits")
    if n < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    level, flags = weights, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([weights, pairs])
        by = np.argsort(merged, kind="stable")
        flags.append(by < n)
        level = merged[by]
    own, k = np.zeros(n, np.int64), 2 * n - 2
    for is_symbol in reversed(flags):
        symbols = int(is_symbol[:k].sum())
        own[:symbols] += 1
        k = 2 * (k - symbols)
    lengths[order] = own
    return lengths


class Code:
    """Canonical code of given lengths: shorter codes first, equal lengths in order of the symbols."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        self.width = max(int(self.lengths.max(initial=0)), 1)
        span = (1 << (self.width - self.lengths[order].astype(np.int64))).astype(np.int64)
        left = np.concatenate([[0], np.cumsum(span)])
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[order] = left[:-1] >> (self.width - self.lengths[order].astype(np.int64))
        #: For the next `width` bits: the symbol they begin with, and its length.
        self.symbols = np.zeros(1 << self.width, np.int32)
        self.steps = np.ones(1 << self.width, np.int64)
        self.symbols[: left[-1]] = np.repeat(order, span)
        self.steps[: left[-1]] = np.repeat(self.lengths[order], span)

    def encode(self, ids: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bits of consecutive documents, each from a whole byte on.

        `first` has the index of each document's first id, and the number of ids at its end. Returns
        the bytes, the first byte of each document (and their number), and the bit of each id.
        """
        size = self.lengths[ids].astype(np.int64)
        if (size == 0).any():
            raise ValueError("an id has no code")
        total = np.concatenate([[0], np.cumsum(size)])
        used = (np.diff(total[first]) + 7) // 8
        start = np.concatenate([[0], np.cumsum(used)])
        at = total[:-1] + np.repeat(start[:-1] * 8 - total[first[:-1]], np.diff(first))
        value = self.codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
        word, n = at >> 5, int(start[-1] // 4 + 3)
        # Bits never overlap, so sums of 32-bit words are exact in doubles.
        out = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        return out.astype(np.uint32).astype(">u4").tobytes()[: start[-1]], start, at

    def decode(self, bits: bytes, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Ids of independent runs: run k starts at bit at[k] and has n[k] ids. All runs advance together."""
        raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        peek = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        order = np.argsort(-n, kind="stable")
        pos, sizes = at[order].astype(np.int64), n[order]
        place = (np.cumsum(n) - n)[order]
        out = np.empty(int(n.sum()), np.int32)
        active = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), "left")
        for step, k in enumerate(active.tolist()):
            p = pos[:k]
            window = peek[p >> 3] >> (32 - self.width - (p & 7)).astype(np.uint32) & np.uint32((1 << self.width) - 1)
            out[place[:k] + step] = self.symbols[window]
            p += self.steps[window]
        return out
