"""A bidirectional FM-index over word numbers, for phrases of bounded length.

The text is an array of numbers from 1 on with 0 between its pieces and at both ends.  The index of a text holds its
Burrows-Wheeler transform: the number before each suffix, in the order of the suffixes.  Suffixes are sorted by
their first ``depth`` numbers only, which is what intervals of phrases up to that length need.  A phrase is an interval
of suffixes; all phrases of one length are extended to the left by one word at once, and the interval of the
reversed phrase in the index of the reversed text follows along, so that phrases extend to the right the same way.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np


def _ranked(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Dense ranks of sorted keys, from 1 on, back in place."""
    new = np.ones(len(key), dtype=np.int32)
    new[1:] = np.diff(key[order]) != 0
    rank = np.empty(len(key), dtype=np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32)
    return rank


class Index:
    """``before``: the number before each suffix; ``step``: where the suffix with it in front stands; ``start[c]``: the
    first suffix that begins with c."""

    def __init__(self, text: np.ndarray, depth: int):
        rank, reach = text.astype(np.int32), 1
        while reach < depth:
            key = rank.astype(np.int64) * (int(rank.max(initial=0)) + 1)
            key[: max(len(rank) - reach, 0)] += rank[reach:]
            order = np.argsort(key, kind="stable").astype(np.int32)
            rank, reach = _ranked(order, key), 2 * reach
        del key
        suffixes = np.argsort(rank, kind="stable").astype(np.int32)
        self.before = text[suffixes - 1].astype(np.int32)  # 0 stands before the first suffix too, at the end of the text
        del rank, suffixes
        self.step = np.empty(len(text), dtype=np.int32)
        self.step[np.argsort(self.before, kind="stable")] = np.arange(len(text), dtype=np.int32)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text))])


@dataclass
class Phrases:
    """Phrases of one length, a row of word numbers each, with their intervals: of ``size`` suffixes from ``ahead`` on in
    the text's index, and from ``back`` on in that of the reversed text."""

    words: np.ndarray
    ahead: np.ndarray
    back: np.ndarray
    size: np.ndarray


def _extended(index: Index, low: np.ndarray, size: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each interval by each word before it: (interval, word, low, size, low in the other index)."""
    stop = np.cumsum(size)
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    at = np.arange(len(owner), dtype=np.int32) + np.repeat((low - stop + size).astype(np.int32), size)
    word = index.before[at]
    key = owner.astype(np.int64) * len(index.start) + word
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.diff(key[order], prepend=-1) != 0)
    many = np.diff(np.append(head, len(key)))
    first = order[head]
    del key, order
    owner, word, at = owner[first], word[first], at[first]
    real = word > 0  # the phrase's other places have nothing before them
    into = head - (stop - size)[owner]
    return owner[real], word[real], index.step[at][real], many[real], (other[owner] + into)[real]


class Bidirectional:
    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth = text, depth
        self.ahead = Index(text, depth)

    @functools.cached_property
    def back(self) -> Index:
        """The index of the reversed text, made when a phrase is first extended to the right."""
        return Index(self.text[::-1], self.depth)

    def single(self) -> Phrases:
        """All words."""
        words = np.arange(1, len(self.ahead.start) - 1)
        size = np.diff(self.ahead.start)[1:]
        some = size > 0
        low = self.ahead.start[1:-1][some]
        return Phrases(words[some][:, None], low, low, size[some])

    def left(self, phrases: Phrases) -> Phrases:
        """All phrases with one more word in front."""
        owner, word, ahead, size, back = _extended(self.ahead, phrases.ahead, phrases.size, phrases.back)
        return Phrases(np.column_stack([word, phrases.words[owner]]), ahead, back, size)

    def right(self, phrases: Phrases) -> Phrases:
        """All phrases with one more word behind."""
        owner, word, back, size, ahead = _extended(self.back, phrases.back, phrases.size, phrases.ahead)
        return Phrases(np.column_stack([phrases.words[owner], word]), ahead, back, size)
