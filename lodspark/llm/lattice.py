"""Subword lattice likelihood: all segmentations of each word into pieces of an existing vocabulary.

A word is a run of pieces whose last one is final. The first piece and later pieces have weights of
their own (a piece may be final or not in each place), so the chances of all words add up to 1. The
pieces are those of a public vocabulary file, never trained here.

No public file stores unigram log-probabilities. The one that stores a score a piece,
piece_bpe_32k.model, has 0, -1, -2, ...: the negative rank of the merge, as the others have by their
order; as log-probabilities these would leave all pieces but the first dozen without weight. So a
stored rank r is read as what it says of frequency, a share of 1 / (r + 100) (Zipf's law), and these
weights are fitted to the training words by expectation-maximisation over all segmentations. The
marginal probability of a word is a log-space forward recursion over its bytes: words of equal length
together, very long ones by themselves, in parts that hand on the sums within a piece's reach.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np

from .words import mix

#: Words above LONG bytes go by themselves, PART places at a time; their sums are scaled anew once in _STRETCH places.
LONG, PART, _STRETCH = 1024, 1 << 16, 16
#: Rows of the weight tables.
FIRST_OPEN, FIRST_LAST, LATER_OPEN, LATER_LAST = range(4)
_STEP, _SIZE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = -1e30


def vocabulary(path: str) -> list[bytes]:
    """Byte strings of the pieces of a byte-level vocabulary file, of whatever length, in the file's order, each once; every single byte is among them.

    The file marks word ends with `</w>`; here the lattice decides which piece is last, so a piece
    and its word-end form count as one. Pieces in upper case can't occur in lower-cased words.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    pieces: dict[bytes, None] = dict.fromkeys(bytes([b]) for b in range(256))
    for piece in sorted(ids, key=ids.__getitem__):
        raw = piece.removesuffix("</w>")
        if raw and all(c in byte for c in raw):
            raw = bytes(byte[c] for c in raw)
            if raw == raw.lower():
                pieces.setdefault(raw)
    return list(pieces)


def piece_hashes(matrix: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of `lengths`, in ascending order: the hash of that many bytes from each place of the rows on. Each length goes on from the one before."""
    wide = matrix.astype(np.uint64)
    h, width = np.zeros(wide.shape, np.uint64), wide.shape[1]
    wanted = {x for x in lengths if x <= width}
    for k in range(max(wanted, default=0)):
        h = h[:, : width - k] * _STEP + wide[:, k:]
        if k + 1 in wanted:
            yield k + 1, mix(h ^ (np.full(1, k + 1, np.uint64) * _SIZE))


class Lattice:
    """Pieces with log weights (4 rows: first or later, open or last), looked up by hash."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        self.weights = weights
        self.lengths = sorted({len(p) for p in pieces})
        hashes, sizes = np.zeros(len(pieces), np.uint64), np.array(list(map(len, pieces)))
        for size in self.lengths:
            at = np.flatnonzero(sizes == size)
            matrix = np.frombuffer(b"".join(pieces[k] for k in at), np.uint8).reshape(len(at), size)
            hashes[at] = next(piece_hashes(matrix, [size]))[1][:, 0]
        # Small tables in turn: a piece whose place is taken goes to the next one, by other bits of its hash.
        self.levels: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        left, low = np.arange(len(pieces)), 64
        while len(left):
            bits = 19 if not self.levels else 15
            low = low - bits if low >= bits else 64 - bits
            place = (hashes[left] >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64)
            key, piece = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            key[place], piece[place] = hashes[left], left
            self.levels.append((low, bits, key, piece))
            left = left[piece[place] != left]

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Piece number at each place, or -1, by the hashes there."""
        found = np.full(h.shape, -1, np.int32)
        for low, bits, key, piece in self.levels:
            at = (h >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64)
            found = np.where(key[at] == h, piece[at], found)
        return found

    def _pass(self, matrix: np.ndarray, gather: np.ndarray | None, times: np.ndarray | None) -> np.ndarray:
        """Natural-log probability of words of equal length; with `gather`, expected uses of pieces are added to it."""
        rows, n = matrix.shape
        found = {size: self.look_up(h) for size, h in piece_hashes(matrix, self.lengths)}
        # Places where some word has a piece of that size: the others have no arc and add nothing to the sums.
        met = {size: (f >= 0).any(0) for size, f in found.items()}
        weight = np.concatenate([self.weights, np.full((4, 1), _NONE)], axis=1)

        def arc(at: int, size: int) -> np.ndarray:
            kind = (FIRST_OPEN if at == 0 else LATER_OPEN) + (at + size == n)
            return weight[kind][found[size][:, at]]

        alpha = np.full((n + 1, rows), _NONE)
        alpha[0] = 0
        for end in range(1, n + 1):
            ways = np.array([alpha[end - size] + arc(end - size, size) for size in found if size <= end and met[size][end - size]])
            if not len(ways):
                continue
            most = ways.max(0)
            alpha[end] = most + np.log(np.exp(ways - most).sum(0))
        if gather is not None:
            beta = np.full((n + 1, rows), _NONE)
            beta[n] = 0
            for at in range(n - 1, -1, -1):
                sizes = [size for size in found if at + size <= n and met[size][at]]
                if not sizes:
                    continue
                arcs = [arc(at, size) for size in sizes]
                ways = np.array([a + beta[at + size] for size, a in zip(sizes, arcs, strict=True)])
                most = ways.max(0)
                beta[at] = most + np.log(np.exp(ways - most).sum(0))
                for size, a in zip(sizes, arcs, strict=True):
                    share = np.exp(np.minimum(alpha[at] + a + beta[at + size] - alpha[n], 0)) * times
                    used = found[size][:, at] >= 0
                    kind = (FIRST_OPEN if at == 0 else LATER_OPEN) + (at + size == n)
                    gather[kind] += np.bincount(found[size][used, at], share[used], gather.shape[1])
        return alpha[n]

    def _arcs(self, word: np.ndarray, low: int) -> tuple[list[int], list[int], list[float], np.ndarray]:
        """Arcs from PART places of one long word on: how many start at each place, and by place their lengths, chances and weights' numbers."""
        n, most = len(word), self.lengths[-1]
        high = min(low + PART, n)
        at, sizes, pieces = [], [], []
        for size, h in piece_hashes(word[None, low : high + most - 1], self.lengths):
            found = self.look_up(h)[0, : high - low]
            here = np.flatnonzero(found >= 0)
            at.append(here)
            sizes.append(np.full(len(here), size))
            pieces.append(found[here])
        at, sizes, pieces = np.concatenate(at), np.concatenate(sizes), np.concatenate(pieces)
        by = np.argsort(at, kind="stable")
        at, sizes, pieces = at[by], sizes[by], pieces[by]
        kind = np.where(at + low == 0, FIRST_OPEN, LATER_OPEN) + (at + low + sizes == n)
        chances = np.exp(self.weights[kind, pieces])
        return np.bincount(at, minlength=high - low).tolist(), sizes.tolist(), chances.tolist(), kind * self.weights.shape[1] + pieces

    def _alone(self, word: np.ndarray, gather: np.ndarray | None, times: float) -> float:
        """`_pass` for one long word, PART places at a time.

        A place is reached from the longest piece's length before it at most, so that many sums are
        all that one part hands to the next, as shares of the largest with its logarithm. With
        `gather` these are kept for every part, and going back each part is computed again from its
        own: memory is that of one part and of the sums between parts, whatever the word's length.
        """
        n, most = len(word), self.lengths[-1]
        ahead, scale, marks = [1.0] + [0.0] * (most - 1), 0.0, []
        for low in range(0, n, PART):
            marks.append((ahead, scale))
            count, sizes, chances, _ = self._arcs(word, low)
            alpha, scales = _forward(count, sizes, chances, ahead, scale)
            ahead, scale = alpha[len(count) : len(count) + most], scales[-1]
        total = scale + math.log(ahead[0]) if ahead[0] > 0 else _NONE
        if gather is None or total == _NONE:
            return total
        flat = gather.reshape(-1)
        after, back = [1.0] + [0.0] * most, 0.0  # of the places behind a part: nearest first
        for low in range((n - 1) // PART * PART, -1, -PART):
            count, sizes, chances, numbers = self._arcs(word, low)
            alpha, scales = _forward(count, sizes, chances, *marks.pop())
            beta = [0.0] * len(count) + after
            used, k = [0.0] * len(sizes), len(sizes)
            for at in range(len(count) - 1, -1, -1):
                if at % _STRETCH == _STRETCH - 1:
                    top = max(beta[at + 1 : at + 1 + most]) or 1.0
                    beta[at + 1 : at + 1 + most] = [x / top for x in beta[at + 1 : at + 1 + most]]
                    back += math.log(top)
                share = alpha[at] * math.exp(scales[at // _STRETCH] + back - total) * times
                x = 0.0
                for j in range(k - count[at], k):
                    through = chances[j] * beta[at + sizes[j]]
                    used[j] = share * through
                    x += through
                beta[at] = x
                k -= count[at]
            flat += np.bincount(numbers, used, len(flat))
            after = beta[: most + 1]
        return total

    def run(self, words: list[bytes], gather: np.ndarray | None = None, times: np.ndarray | None = None, cells: int = 1 << 18) -> np.ndarray:
        """Natural-log probability of each word (not empty). Words of equal length go together, `cells` bytes at a time."""
        out = np.zeros(len(words))
        sizes = np.array(list(map(len, words)), np.int64)
        order = np.argsort(sizes, kind="stable")
        edges = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=1 << 60))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            n = int(sizes[order[low]])
            if n > LONG:
                for k in order[low:high].tolist():
                    out[k] = self._alone(np.frombuffer(words[k], np.uint8), gather, 1.0 if times is None else float(times[k]))
                continue
            step = max(1, cells // n)
            for at in range(low, high, step):
                part = order[at : min(at + step, high)]
                matrix = np.frombuffer(b"".join([words[k] for k in part]), np.uint8).reshape(len(part), n)
                out[part] = self._pass(matrix, gather, None if times is None else times[part])
        return out


def _forward(count: list[int], sizes: list[int], chances: list[float], ahead: list[float], scale: float) -> tuple[list[float], list[float]]:
    """Sums over all ways to each place of a part and behind it, and the logarithm by which those of each stretch of places are divided.

    `ahead` and `scale` are those of the part's first places. Sums are divided by the largest within
    reach once a stretch: in between a chance falls by less than a double can hold.
    """
    most, k, scales = len(ahead), 0, []
    alpha = ahead + [0.0] * len(count)
    for at, n in enumerate(count):
        if at % _STRETCH == 0:
            top = max(alpha[at : at + most]) or 1.0
            alpha[at : at + most] = [x / top for x in alpha[at : at + most]]
            scale += math.log(top)
            scales.append(scale)
        x = alpha[at]
        for j in range(k, k + n):
            alpha[at + sizes[j]] += x * chances[j]
        k += n
    return alpha, scales


def first_weights(pieces: list[bytes]) -> np.ndarray:
    """Starting weights from the vocabulary's own order: the share of rank r falls as 1 / (r + 100)."""
    score = 1.0 / (np.arange(len(pieces)) + 100.0)
    return normalised(np.tile(score, (4, 1)), 0.0)


def normalised(uses: np.ndarray, extra: float) -> np.ndarray:
    """Log weights from uses: those of first pieces add up to 1, and those of later pieces; `extra` is added to each use."""
    uses = uses + extra
    out = np.empty(uses.shape)
    for rows in (slice(0, 2), slice(2, 4)):
        out[rows] = np.log(uses[rows] / uses[rows].sum())
    return out
