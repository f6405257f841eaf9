"""Word and shingle hashes of whole texts, vectorised over many texts at once.

Words are runs of bytes other than space and 0x09-0x0D, after A-Z are lower-cased. A word's 64-bit
hash is a polynomial in an odd base over a table of random byte values, taken from one running sum.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RNG.integers(1 << 61, 1 << 62, dtype=np.uint64)) | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_ORDER = _RNG.integers(1, 1 << 63, size=64, dtype=np.uint64) | np.uint64(1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """The first n powers of the base, or of its inverse modulo 2**64."""
    if len(_powers[which]) < n:
        size = max(n, 1 << 20)
        steps = np.full(size, _BASE if which == "up" else _INVERSE, dtype=np.uint64)
        steps[0] = 1
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class WordParts(NamedTuple):
    hashes: np.ndarray  # of the words of all texts, one after the other
    heads: list[np.ndarray]  # of their first four, five ... eight bytes
    tails: np.ndarray  # of their last two bytes
    capitals: np.ndarray  # whether they have at least two capitals A-Z, and no small a-z
    at: np.ndarray  # where each text's words begin, and the end


def _spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(begin and end of each word in the joined texts, where each text's words begin, the joined texts)."""
    joined = b"\n".join(texts) + b"\n"
    blank = _BLANK[np.frombuffer(joined, dtype=np.uint8)]
    word = ~blank
    begin = np.flatnonzero(word & np.concatenate(([True], blank[:-1])))
    end = np.flatnonzero(blank & np.concatenate(([False], word[:-1])))
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    return begin, end, np.searchsorted(begin, np.concatenate(([0], np.cumsum(sizes)))), joined


def _hasher(joined: bytes):
    data = np.frombuffer(joined.lower(), dtype=np.uint8)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power("up", len(data)), out=sums[1:])
    down = _power("down", len(data))
    return lambda begin, end: mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, one after the other; where each text's words begin, and the end)."""
    begin, end, at, joined = _spans(texts)
    return _hasher(joined)(begin, end), at


def word_parts(texts: list[bytes]) -> WordParts:
    begin, end, at, joined = _spans(texts)
    hashed, data = _hasher(joined), np.frombuffer(joined, dtype=np.uint8)
    count = lambda low, high: np.concatenate(([0], np.cumsum((data >= low) & (data <= high))))
    big, small = count(65, 90), count(97, 122)
    capitals = (big[end] - big[begin] >= 2) & (small[end] == small[begin])
    heads = [hashed(begin, np.minimum(end, begin + n)) for n in range(4, 9)]
    return WordParts(hashed(begin, end), heads, hashed(np.maximum(begin, end - 2), end), capitals, at)


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles of ``size`` words; a shorter sequence of words is one shingle."""
    words, at = word_hashes(texts)
    n = max(0, len(words) - size + 1)
    shingles = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        shingles += words[i : i + n] * _ORDER[i]
    shingles = mixed(shingles)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(shingles[a : b - size + 1]))
        elif b > a:
            out.append(mixed((words[a:b] * _ORDER[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
