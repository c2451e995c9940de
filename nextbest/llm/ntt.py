"""Exact convolutions of many short rows: a number-theoretic transform on whole numbers held in float64.

All values stay below 2^53 in size, so every operation is exact; a product is reduced by one multiplication, one
``floor`` and one subtraction, which numpy runs over whole arrays.
"""

from __future__ import annotations

import functools

import numpy as np

#: A prime, 7 * 2^20 + 1, with the primitive root 3: transforms of up to 2^20 values.
PRIME, ROOT, LARGEST = 7340033, 3, 1 << 20
_INVERSE = 1.0 / PRIME


def reduced(x: np.ndarray) -> np.ndarray:
    """``x`` less a multiple of the prime, in place: between -PRIME and 2 * PRIME."""
    parts = x * _INVERSE
    np.floor(parts, out=parts)
    parts *= PRIME
    x -= parts
    return x


@functools.lru_cache(maxsize=64)
def _factors(size: int, sign: int) -> list[np.ndarray]:
    """The factors of each level: the ring modulo x^2h - c^2 splits into those modulo x^h - c and x^h + c."""
    root = pow(ROOT, (PRIME - 1) // size, PRIME)
    powers = np.ones(size, dtype=np.int64)
    for k in range(size.bit_length() - 1):
        powers[1 << k : 2 << k] = powers[: 1 << k] * pow(root, 1 << k, PRIME) % PRIME
    turn, out = np.zeros(1, dtype=np.int64), []
    while len(turn) < size:
        half = turn // 2
        out.append(powers[sign * half % size].astype(np.float64)[:, None, None])
        turn = np.stack([half, half + size // 2], axis=1).ravel()
    return out


def forward(x: np.ndarray) -> np.ndarray:
    """Transform the columns of ``x`` (size x rows), in place."""
    size, rows = x.shape
    for c in _factors(size, 1):
        y = x.reshape(len(c), 2, size // (2 * len(c)), rows)
        t = reduced(y[:, 1] * c)
        np.subtract(y[:, 0], t, out=y[:, 1])
        y[:, 0] += t
    return x


def backward(x: np.ndarray) -> np.ndarray:
    """Undo ``forward`` but for the factor 1 / size, in place."""
    size, rows = x.shape
    for level, c in enumerate(reversed(_factors(size, -1))):
        if level % 4 == 0:
            reduced(x)  # sums double with every level
        y = x.reshape(len(c), 2, size // (2 * len(c)), rows)
        t = y[:, 0] - y[:, 1]
        y[:, 0] += y[:, 1]
        y[:, 1] = reduced(t * c)
    return x


def correlate(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Of each column: the sums over t of ``blocks[t] * windows[i + t]`` (i + t modulo the size), modulo the prime.
    Values from 0 to PRIME - 1; ``windows`` is overwritten."""
    size = len(windows)
    turned = np.zeros_like(windows)
    turned[0] = blocks[0]
    turned[size - len(blocks) + 1 :] = blocks[:0:-1]
    x = reduced(forward(turned)) * reduced(forward(windows))
    return reduced(backward(reduced(x)) * 1.0) * pow(size, -1, PRIME)
