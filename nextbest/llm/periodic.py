"""Periodic runs of words: every maximal stretch that repeats with some smallest period, found by block convolution.

A run of period q and length of at least 2 q holds, for a block size B with q >= 2 B - 1, a whole block at a multiple
of B that occurs again q words later inside the run.  So at dyadic scales every block of B words is looked for in the
window that holds the distances from 2 B to 4 B - 1: the squared differences of word numbers between a block and
every place of its window are summed by exact number-theoretic transforms (``ntt``), and a sum of zero is an
occurrence (compared word by word after that, since sums are modulo a prime).  Distances below 8 take blocks of 2 words.

Neighbouring blocks with an occurrence at one distance form a chain, and a chain is extended by less than a block on
either side to the maximal stretch that agrees at this distance.  Of stretches with equal ends the smallest distance is
the period.  Beyond the largest transform, windows at further distances follow one another, so no period is left out.

All texts of a batch are worked on together, and an occurrence counts only inside one text.

Defined results: a null or empty text has no runs and collapses to the empty text; very long texts are searched whole;
rows with null or repeated ids come back one for one; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nextbest.llm import ntt
from nextbest.llm.common import id_and_text, slices, texts_of
from nextbest.llm.runs import numbered

LEAST_LENGTH = 12
_SLICE = 4 << 20
#: Values of one transform of many rows, and of one table of comparisons.
_VALUES, _CELLS = 1 << 17, 1 << 21


def scales(longest: int, largest: int = ntt.LARGEST // 4) -> Iterator[tuple[int, int, int]]:
    """(block, least distance, number of distances) up to the period ``longest``."""
    block, least, many = 2, 1, 7
    while least <= longest:
        yield block, least, many
        least += many
        if block < largest:
            block = 4 if block == 2 else 2 * block
        many = 2 * block if block > 2 else 8


def gaps(code: np.ndarray) -> np.ndarray:
    """How many words later each word comes again; more than there are words if it does not."""
    order = np.argsort(code, kind="stable")
    out = np.full(len(code), len(code) + 1, dtype=np.int64)
    again = np.flatnonzero(code[order[1:]] == code[order[:-1]])
    out[order[again]] = order[again + 1] - order[again]
    return out


def occurrences(code: np.ndarray, gap: np.ndarray, first: np.ndarray, stop: np.ndarray, block: int, least: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of blocks that occur again ``least`` to ``least + many - 1`` words later in the same text.

    ``code`` numbers the words; ``first`` and ``stop`` say of each word where its text starts and stops.  A block with
    a word that does not come again within the window (``gap``) is not there either and is left out beforehand."""
    at = np.arange(0, len(code) - block + 1, block)
    near = gap[: len(at) * block].reshape(-1, block).max(axis=1, initial=0) < least + many
    at = at[near & (at + least + block <= stop[at]) & (stop[at] - first[at] >= max(LEAST_LENGTH, 2 * least))]
    size = 1 << (many + block - 2).bit_length()
    value = np.concatenate([code % ntt.PRIME, np.zeros(least + size, dtype=np.int64)])
    square = np.concatenate([[0], np.cumsum(value * value % ntt.PRIME)])
    norm = (square[block:] - square[:-block]).astype(np.float64)  # of each place of a block
    value = value.astype(np.float64)
    positions, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows = max(1, _VALUES // size)
    inside, shift = np.arange(block)[:, None], np.arange(many)[:, None]
    used = np.arange(many + block - 1)[:, None]
    for k in range(0, len(at), rows):
        j = at[k : k + rows]
        window = np.zeros((size, len(j)))
        window[: len(used)] = value[j + least + used]
        products = ntt.correlate(value[j + inside], window)[:many]
        place = j + least + shift
        rest = norm[j] + norm[np.minimum(place, len(norm) - 1)] - 2.0 * products
        rest -= np.rint(rest / ntt.PRIME) * ntt.PRIME
        i, column = np.nonzero((rest == 0) & (place + block <= stop[j]))
        positions.append(j[column])
        distances.append(least + i)
    position, distance = np.concatenate(positions), np.concatenate(distances)
    right = np.concatenate([np.zeros(0, bool), *[
        (code[p[:, None] + inside.T] == code[(p + d)[:, None] + inside.T]).all(axis=1)
        for p, d in _blocks(block, position, distance)]])
    return position[right], distance[right]


def _blocks(width: int, *columns: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    rows = max(1, _CELLS // width)
    for k in range(0, len(columns[0]), rows):
        yield tuple(c[k : k + rows] for c in columns)


def stretches(code: np.ndarray, first: np.ndarray, stop: np.ndarray, block: int, position: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, distance) of the maximal stretches that agree with themselves ``distance`` words later, from the
    blocks that do; ``stop`` is where the later copy ends."""
    order = np.lexsort((position, distance))
    position, distance = position[order], distance[order]
    new = np.ones(len(position), dtype=bool)
    new[1:] = (np.diff(position) != block) | (np.diff(distance) != 0) | (first[position[1:]] != first[position[:-1]])
    head = np.flatnonzero(new)
    low, d = position[head], distance[head]
    high = position[np.append(head[1:], len(position)) - 1] + block if len(head) else low
    step = np.arange(block)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b, gap in _blocks(block, low, high, d):
        before, after = a[:, None] - 1 - step, b[:, None] + step
        same = (before >= first[a][:, None]) & (code[np.maximum(before, 0)] == code[np.maximum(before, 0) + gap[:, None]])
        left.append(a - np.where(same.all(axis=1), block, same.argmin(axis=1)))
        inside = after + gap[:, None] < stop[a][:, None]
        later = np.minimum(after + gap[:, None], len(code) - 1)
        same = inside & (code[np.minimum(after, len(code) - 1)] == code[later])
        right.append(b + np.where(same.all(axis=1), block, same.argmin(axis=1)))
    return np.concatenate(left), np.concatenate(right) + d, d


def runs_of(code: np.ndarray, edges: np.ndarray, largest: int = ntt.LARGEST // 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of all runs of texts that lie one after the other, in order of start and period; text k has
    the words from ``edges[k]`` to ``edges[k + 1]``."""
    size = np.diff(edges)
    first, stop = np.repeat(edges[:-1], size), np.repeat(edges[1:], size)
    found = [np.zeros((3, 0), dtype=np.int64)]
    gap = gaps(code)
    for block, least, many in scales(int(size.max(initial=0)) // 2, largest):
        low, high, d = stretches(code, first, stop, block, *occurrences(code, gap, first, stop, block, least, many))
        long = high - low >= np.maximum(LEAST_LENGTH, 2 * d)
        found.append(np.stack([low[long], high[long], d[long]]))
    low, high, d = np.concatenate(found, axis=1)
    order = np.lexsort((d, high, low))
    low, high, d = low[order], high[order], d[order]
    new = np.ones(len(low), dtype=bool)
    new[1:] = (np.diff(low) != 0) | (np.diff(high) != 0)  # the smallest distance of equal stretches comes first
    low, high, d = low[new], high[new], d[new]
    order = np.lexsort((d, low))
    return low[order], high[order], d[order]


_STRUCT = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _found(reorder: Callable[[int | None, int], np.ndarray | None] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _SLICE):
                doc_ids, words = batch.column("doc_id").to_pylist(), [t.split() for t in texts_of(batch.column("text"))]
                if reorder:
                    for k, (doc_id, own) in enumerate(zip(doc_ids, words, strict=True)):
                        if (order := reorder(doc_id, len(own))) is not None:
                            words[k] = [own[i] for i in order.tolist()]
                edges = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
                data = b"".join([b" ".join(w) + b" " for w in words if w])
                starts = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 0x20)
                starts = np.concatenate([[0], starts[:-1] + 1]) if len(starts) else np.zeros(0, np.int64)
                code = np.asarray(numbered(data, starts).indices).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
                low, high, period = runs_of(code, edges)
                drop = np.zeros(len(code) + 1, dtype=np.int64)
                np.add.at(drop, low + period, 1)
                np.add.at(drop, high, -1)
                drop = np.cumsum(drop) > 0
                cut = np.searchsorted(low, edges)
                some, texts = [], []
                for k, own in enumerate(words):
                    base = int(edges[k])
                    mine = slice(cut[k], cut[k + 1])
                    some.append([{"start": a - base, "length": b - a, "period": q} for a, b, q in zip(low[mine].tolist(), high[mine].tolist(), period[mine].tolist(), strict=True)])
                    if some[-1]:
                        gone = drop[base : base + len(own)].tolist()
                        own = [w for w, g in zip(own, gone, strict=True) if not g]
                    texts.append(b" ".join(own))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(some, _STRUCT), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  reorder: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """(doc_id, runs, collapsed): the runs of each text in order of start and period (word numbers), and its words joined
    by one space without those that a run repeats.  ``reorder`` may name, for an id and a number of words, the words to
    read instead, as word numbers; None leaves them as they are."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_found(reorder), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
