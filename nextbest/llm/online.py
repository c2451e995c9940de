"""Bounded-space online packing of documents into sequences of fixed length.

Each task packs the documents of its partition as they come.  It keeps at most ``windows`` sequences open.  A
document's ids and one terminator go, after full sequences of their own, to the open window that they fit best; if
they fit none, a new window is opened, or, with all of them open, the fullest is filled with the document's next
ids and emitted, and the rest is placed anew.  So a task holds ``windows`` sequences and nothing else, every emitted
sequence is full, and a document is cut only where nothing else fits.

What is left open at the end of each partition is merged: the left windows are laid end to end (a prefix sum over
their lengths in two levels) and cut anew at every full length.  The last remainder, shorter than a sequence,
becomes sequences whose lengths are different powers of two, the lengths that need no padding.

Defined results: null and empty texts pack as one terminator; very long texts are cut, never shortened; equal
windows and documents are told apart by their order in the partition; rows with null or repeated ids are packed
one for one; only the id and the text are read; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nextbest.llm.bytebpe import encoder
from nextbest.llm.common import id_and_text, slices, texts_of, written

TOKENS, WINDOWS = 1024, 64
_SLICE = 4 << 20
#: A window's number is its partition's times 2^32 plus its own; partitions are summed up in groups of 2^10.
_OWN, _GROUP = 32, 10
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, full boolean, ids binary"
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]
_TYPES = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]


class Packer:
    """Open windows of one partition, as (free tokens, window number) in order, and their pieces."""

    def __init__(self, tokens: int, windows: int, number: int):
        self.tokens, self.windows, self.number = tokens, windows, number
        self.free: list[tuple[int, int]] = []
        self.pieces: dict[int, list[tuple]] = {}

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple[int, list[tuple]]]:
        """Place one document; the windows that became full, with their pieces (doc_id, start, ids, doc_tokens, offset)."""
        n, at = len(ids), 0
        while at < n:
            rest = n - at
            if rest >= self.tokens:
                yield self._open(), [(doc_id, at, ids[at : at + self.tokens], n, 0)]
                at += self.tokens
                continue
            k = bisect.bisect_left(self.free, (rest, -1))
            if k == len(self.free):
                if len(self.free) < self.windows:
                    window = self._open()
                    self.pieces[window] = []
                    bisect.insort(self.free, (self.tokens, window))
                    continue
                k = 0
            free, window = self.free.pop(k)
            take = min(free, rest)
            self.pieces[window].append((doc_id, at, ids[at : at + take], n, self.tokens - free))
            at += take
            if take == free:
                yield window, self.pieces.pop(window)
            else:
                bisect.insort(self.free, (free - take, window))

    def _open(self) -> int:
        self.number += 1
        return self.number - 1


def _rows(windows: list[tuple[int, list[tuple]]], full: bool, with_ids: bool) -> pa.RecordBatch:
    rows = [(doc_id, start, len(ids), raw, n, window, offset) for window, pieces in windows for doc_id, start, ids, n, offset in pieces for raw in [ids.tobytes()]]
    doc_id, start, length, raw, n, window, offset = zip(*rows, strict=True) if rows else [()] * 7
    columns = [doc_id, start, length, [zlib.crc32(x) for x in raw], n, window, offset, [full] * len(rows), raw if with_ids else [None] * len(rows)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _packed(path: str, ranks: str, tokens: int, windows: int, terminator: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path, ranks)
        packer = Packer(tokens, windows, TaskContext.get().partitionId() << _OWN)
        end = np.array([terminator], dtype="<u4")
        for whole in batches:
            for batch in slices(whole, "text", _SLICE):
                done: list[tuple[int, list[tuple]]] = []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode_all(texts_of(batch.column("text"))), strict=True):
                    done.extend(packer.add(doc_id, np.concatenate([ids, end])))
                yield _rows(done, True, with_ids)
        yield _rows(sorted(packer.pieces.items()), False, True)
    return run


def tail_lengths(rest: int) -> list[int]:
    """The powers of two that add up to ``rest``, largest first."""
    return [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def _merged(tokens: int, total: int):
    """Cut pieces that lie on one line from 0 to ``total`` at the ends of its sequences."""
    whole = total // tokens
    edges = whole * tokens + np.concatenate([[0], np.cumsum(tail_lengths(total % tokens))]).astype(np.int64)

    def place(at: int) -> tuple[int, int, int]:
        """The sequence that holds position ``at``, where it begins and ends."""
        if at < edges[0]:
            k = at // tokens
            return k, k * tokens, (k + 1) * tokens
        k = int(np.searchsorted(edges, at, side="right"))
        return whole + k - 1, int(edges[k - 1]), int(edges[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids, at, done = r["ids"], r["base"] + r["offset"], 0
                while done < r["length"]:
                    sequence, begin, stop = place(at + done)
                    take = min(stop - at - done, r["length"] - done)
                    part = ids[4 * done : 4 * (done + take)]
                    rows.append((r["doc_id"], r["start"] + done, take, zlib.crc32(part), r["doc_tokens"], -1 - sequence, at + done - begin, True, part))
                    done += take
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)
    return run


def packed(docs: DataFrame, path: str, ranks: str, tokens: int = TOKENS, windows: int = WINDOWS, terminator: int = 0, with_ids: bool = True,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): every piece with its place; ids as
    little-endian unsigned 32-bit bytes.  Merged sequences have negative numbers."""
    base = id_and_text(docs, id_col, text_col)
    pieces = written(base.mapInArrow(_packed(path, ranks, tokens, windows, terminator, with_ids), _PIECE), "online-pieces")
    left = pieces.where("NOT full")
    sizes = left.groupBy("window").agg(F.sum("length").alias("n")).withColumn("grp", F.shiftright("window", _OWN + _GROUP))
    before = [Window.unboundedPreceding, -1]
    inner = F.sum("n").over(Window.partitionBy("grp").orderBy("window").rowsBetween(*before))
    groups = sizes.groupBy("grp").agg(F.sum("n").alias("n"))  # a row for 2^10 partitions
    outer = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("grp").rowsBetween(*before))
    at = sizes.withColumn("inner", inner).join(groups.select("grp", outer.alias("outer")), "grp")
    at = at.select("window", (F.coalesce("inner", F.lit(0)) + F.coalesce("outer", F.lit(0))).alias("base"))
    total = left.agg(F.sum("length")).first()[0] or 0
    merged = left.join(at, "window").mapInArrow(_merged(tokens, total), _PIECE)
    out = pieces.where("full").unionByName(merged)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("window").alias("sequence_id"), "offset", *(["ids"] if with_ids else []))
