"""Vectorised words: ASCII letters in lower case, digits and all non-ASCII bytes make words.

A word is `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case. Its hash is a
polynomial of its bytes modulo 2**64, taken from prefix sums, so no loop runs over words.
"""

from __future__ import annotations

import numpy as np

_FOLD = np.full(256, 32, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _FOLD[_b] = _b
for _b in range(65, 91):
    _FOLD[_b] = _b + 32
FOLD_BYTES = _FOLD.tobytes()

_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_power: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of a 64-bit hash."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**j and B**-j modulo 2**64 for j < n."""
    if len(_power.get("up", ())) < n:
        size = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _power[key] = np.multiply.accumulate(steps)
    return _power["up"], _power["down"]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts, and the first word's index of each text (n + 1 of them)."""
    at = offsets - offsets[0]
    folded = _FOLD[data[offsets[0] : offsets[-1]]]
    n = len(folded)
    word = folded != 32
    first = np.zeros(n + 1, bool)
    first[at] = True
    opens = word.copy()
    opens[1:] &= ~word[:-1] | first[1:n]
    closes = word.copy()
    closes[:-1] &= ~word[1:] | first[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = _powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(folded.astype(np.uint64) * up[:n], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts]), np.searchsorted(starts, at)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive words (empty if there are fewer)."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    total = words[:n].copy()
    for k in range(1, size):
        total = total * _STEP + words[k : k + n]
    return mix(total)


def split_words(text: bytes) -> list[bytes]:
    """The words of one text, in order."""
    return text.translate(FOLD_BYTES).split()
