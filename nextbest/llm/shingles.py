"""Word shingles as 64-bit hashes, vectorised over the UTF-8 bytes of many texts.

Words are the runs of bytes other than 0x20 and 0x09-0x0D; A-Z are
lower-cased.  A word's hash is a polynomial of its bytes, taken as a
difference of prefix sums, so no Python runs per word.  Hashes stand for the
shingles: two different shingles of one pair of texts meet with a chance of
about 2^-64.
"""

from __future__ import annotations

import functools

import numpy as np

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3,
         0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2545F4914F6CDD1D]

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = pow(_BASE, -1, 2**64)
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, dtype=np.uint64)]), dtype=np.uint64)
                 for b in (np.uint64(_BASE), np.uint64(inverse)))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    return _powers(size)


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each text's first word (one more entry than texts)."""
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)  # the space between texts ends a word
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = ~IS_SPACE[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_BYTE[LOWER] if lower else _BYTE)[data] * up[: len(data)], out=sums[1:])
    words = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(_STEP[7]))
    first = np.concatenate([[0], np.searchsorted(start, ends)])
    return words, first


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words
    has its whole sequence as one shingle, a text without words none."""
    hashes, first = word_hashes(texts)
    sets = []
    n = max(0, len(hashes) - words + 1)
    runs = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        runs += hashes[k : k + n] * np.uint64(_STEP[k % 7] + 2 * (k // 7))
    runs = mix(runs)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            sets.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            whole = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                whole = mix(whole * np.uint64(_STEP[6]) + hashes[k : k + 1])
            sets.append(whole)
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
