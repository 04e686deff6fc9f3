"""Word and shingle hashes of many texts at once, in numpy.

Texts are laid end to end as bytes. A word's hash is a difference of prefix
sums of a polynomial over 64-bit byte values, so no Python work is done per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word (a 64-bit finaliser)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, 1 << 18)
        for key, base in (("p", _BASE), ("i", _INV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[key] = np.cumprod(a)
    return _powers["p"], _powers["i"]


def chunks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes; a longer text is a range of its own."""
    lo, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield lo, i
            lo, total = i, 0
        total += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes and, for every word, its start, end and text number."""
    joined = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    gap = _SPACE[joined]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    first = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return joined, starts, ends, np.searchsorted(first, starts, side="right") - 1


def hash_spans(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _power(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[joined] * power[: len(joined)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every word of ``texts``: its 64-bit hash and its text number (ascending)."""
    joined, starts, ends, owner = word_spans(texts)
    return hash_spans(joined, starts, ends), owner


def one_word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of single words, equal to those that ``word_hashes`` gives."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    return word_hashes(words)[0]


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct k-word shingle hashes of one text, sorted; fewer words make one shingle."""
    if not len(hashes):
        return hashes
    k = min(k, len(hashes))
    n = len(hashes) - k + 1
    out = np.full(n, U(k), dtype=np.uint64)
    for j in range(k):
        out = mix(out * U(_BASE) + hashes[j : j + n])
    return np.unique(out)
