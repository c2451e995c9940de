"""Texts cut into runs of bytes, and the ids of texts gathered from the ids of their distinct runs.

A tokenizer's ids of a text are those of the pieces that its pattern cuts, one after the other.  Where a cut
is certain, the parts can be encoded apart; most parts of a batch are alike, so each is encoded once and the ids
of all texts are one gather.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE, DIGIT, MARK, LETTER, OTHER = range(5)

#: The class of a byte: OTHER are controls and what is not ASCII, but for the letters that ``classes`` finds.
_CLASS = np.full(256, OTHER, dtype=np.uint8)
for _c in range(0x21, 0x7F):
    _CLASS[_c] = DIGIT if chr(_c).isdigit() else LETTER if chr(_c).isalpha() else MARK
_CLASS[list(b" \t\n\r\x0b\x0c")] = SPACE


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte; both bytes of U+00C0 to U+00FF are letters, but for the two signs among them."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    lead = lead[(second >> 6 == 2) & (second & 0xDF != 0x97)]
    kind[lead] = kind[lead + 1] = LETTER
    return kind


def numbered(data: bytes | np.ndarray, starts: np.ndarray) -> pa.DictionaryArray:
    """The runs that start in ``starts``, each up to the next, as numbers of distinct ones."""
    edges = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()


def distinct(data: bytes | np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each run its number among the distinct runs, and these."""
    runs = numbered(data, starts)
    _, edges, flat = runs.dictionary.buffers()
    flat, edges = flat.to_pybytes() if flat else b"", np.frombuffer(edges, dtype=np.int64)[: len(runs.dictionary) + 1].tolist()
    return np.asarray(runs.indices), [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def gather(index: np.ndarray, ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the runs ``index``, one after the other, and where each run's begin (one more entry than runs);
    run k has ``size[k]`` ids from ``begin[k]`` on."""
    size = size[index]
    stop = np.concatenate([[0], np.cumsum(size)])
    return ids[np.arange(stop[-1]) + np.repeat(begin[index] - stop[:-1], size)], stop
