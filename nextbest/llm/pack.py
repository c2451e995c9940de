"""Best-fit packing of documents into fixed-length sequences under several capacities.

A document's ids and one terminator make one item; only items longer than a
sequence are cut, into full pieces and a last one that may be shorter.  A
sequence has capacities for tokens, documents and attention cost (the sum
of squared piece lengths).  Pieces go longest first; of the sequences with
room under every capacity a piece takes the one with the least weighted
residual norm after placing it (``score="norm"``) or the largest weighted dot
product of its demand with the residual (``score="dot"``).

Pieces of one length are alike, so the plan is made from the number of pieces
of each length alone, for whole ranges of equal sequences at a time: at most
``tokens`` numbers reach the driver, however many documents there are.  Spark
numbers the pieces of each length, and the plan tells each number its place.

Defined results: null texts count as empty and pack as one terminator; rows
with null or repeated ids are packed one for one; only the id and the text
are read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextbest.llm.bpe import encoder
from nextbest.llm.common import id_and_text, number_within, slices, texts_of, written

_SLICE = 1 << 20
#: Words whose ids a worker keeps.
_WORDS = 400_000


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, and the weights of the three residuals in the score."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    score: str = "norm"


@dataclass(frozen=True)
class Placement:
    """Pieces of ``length`` numbered from ``rank``: ``each`` of them go to each of the ``count`` sequences from ``sequence`` on, at ``offset``."""

    length: int
    rank: int
    each: int
    count: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], limits: Limits) -> list[Placement]:
    """Places for ``histogram[length]`` pieces of each length, longest first."""
    caps = np.array([limits.tokens, limits.documents, limits.cost], dtype=np.int64)
    weights = np.array(limits.weights) / 1.0
    room = np.zeros((0, 3), dtype=np.int64)  # residuals of ranges of equal sequences
    first, count = [], []
    out, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        demand = np.array([length, 1, length * length], dtype=np.int64)
        if (demand > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        left, rank = histogram[length], 0
        while left:
            fits = np.flatnonzero((room >= demand).all(axis=1))
            if len(fits):
                share = room[fits] / caps
                if limits.score == "dot":
                    at = int(fits[np.argmax((share * (demand / caps)) @ weights)])
                else:
                    at = int(fits[np.argmin(((share - demand / caps) ** 2) @ weights)])
            else:
                at = len(first)
                each = int((caps // demand).min())
                first.append(sequences)
                count.append(-(-left // each))
                sequences += count[-1]
                room = np.vstack([room, caps])
            each = min(int((room[at] // demand).min()), left)
            bins = min(count[at], left // each)
            out.append(Placement(length, rank, each, bins, first[at], int(limits.tokens - room[at, 0])))
            if bins < count[at]:
                first.append(first[at] + bins)
                count.append(count[at] - bins)
                room = np.vstack([room, room[at]])
                count[at] = bins
            room[at] -= each * demand
            rank += each * bins
            left -= each * bins
        full = (room[:, 0] == 0) | (room[:, 1] == 0)
        if full.any():
            room = room[~full]
            first = [x for x, y in zip(first, full, strict=True) if not y]
            count = [x for x, y in zip(count, full, strict=True) if not y]
    return out


def _cut(path: str, tokens: int, terminator: int, with_ids: bool):
    end = np.array([terminator], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, entries=_WORDS)
        for whole in batches:
            for batch in slices(whole, "text", _SLICE):
                rows = [[] for _ in range(6)]
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode_all(texts_of(batch.column("text"))), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * tokens)):
                        part = ids[at : at + 4 * tokens]
                        for column, value in zip(rows, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                used = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows[:used], kinds[:used], strict=True)], names=names[:used])
    return run


def pieces(docs: DataFrame, path: str, tokens: int = 2048, terminator: int = 0, with_ids: bool = True,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): ids as little-endian unsigned 32-bit bytes."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return id_and_text(docs, id_col, text_col).mapInArrow(_cut(path, tokens, terminator, with_ids), schema)


def _place(placements):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[int, np.ndarray] = {}
        for p in placements.value:
            table.setdefault(p.length, []).append((p.rank, p.each, p.sequence, p.offset))
        table = {k: np.array(v, dtype=np.int64) for k, v in table.items()}
        for batch in batches:
            length = np.asarray(batch.column("length"))
            rank = np.asarray(batch.column("rank"))
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                row = table[int(size)]
                own = row[np.searchsorted(row[:, 0], rank[at], side="right") - 1]
                into = rank[at] - own[:, 0]
                sequence[at] = own[:, 2] + into // own[:, 1]
                offset[at] = own[:, 3] + into % own[:, 1] * size
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(sequence), pa.array(offset)],
                                             names=[*kept, "sequence_id", "offset"])
    return run


def pack(cut: DataFrame, limits: Limits | None = None, sub_groups: int = 64) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces."""
    limits = limits or Limits()
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a length
    placements = cut.sparkSession.sparkContext.broadcast(plan(histogram, limits))
    sub = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(sub_groups, sum(histogram.values()) // 10_000_000)))
    ranked = number_within(cut, ["length"], ["doc_id", "piece", "ids_crc32"], sub, "rank").select(*cut.columns, "rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_place(placements), schema)


def packed(docs: DataFrame, path: str, limits: Limits | None = None, terminator: int = 0, with_ids: bool = True,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with their places; ``with_ids`` carries the ids themselves."""
    limits = limits or Limits()
    return pack(written(pieces(docs, path, limits.tokens, terminator, with_ids, id_col, text_col), "pack-pieces"), limits)
