"""BPE encoding and decoding of whole texts, with content-defined chunk reuse.

``WordEncoder`` encodes with a tokenizer whose pre-tokenizer drops white
space: the ids of a text are those of its runs, one after the other, and a run
is encoded by the library the first time it comes.

``encode_decode`` cuts texts into content-defined chunks (a rolling hash over
32 bytes picks the cuts, so equal passages of different documents are cut
alike).  Chunks that several documents share are encoded once.  A document is
then put together from the ids of its shared chunks and of what lies between, each encoded by itself.  A join
may tear a word, so the window around it is encoded again and replaces the ids of both
sides there; it is widened until the ids of the words at its ends, its context, agree exactly with those already there.

Two passes read the documents: one counts chunks, one encodes the documents without
shared chunks and sets the others aside.  Only counts of chunk hashes, the texts of
shared chunks and the documents that hold one are shuffled.  Which documents
those are is told by a filter of fixed size (``filter_bits``) over the hashes
of shared chunks.  A false hit costs a shuffle, never a wrong result.

Defined results: a null text counts as empty (no ids, empty decoded text);
rows with null or repeated ids come back one for one; only the id and the
text are read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextbest.llm.common import id_and_text, slices, texts_of, written
from nextbest.llm.runs import DIGIT, LETTER, OTHER, SPACE, classes, distinct, gather

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Content-defined chunks: average, least and largest number of bytes.
AVERAGE, LEAST, MOST = 512, 128, 8192
FILTER_BITS = 1 << 24
_PROBES = 4
_SLICE = 4 << 20
_GEAR = np.random.default_rng(4).integers(0, 2**32, 256, dtype=np.uint32)


class Store:
    """Ids of strings met so far, at most ``entries``: of two generations the old one goes when the young one is full,
    and what is met again moves to the young one."""

    def __init__(self, entries: int):
        self.entries = entries // 2
        self.young: dict = {}
        self.old: dict = {}

    def lacking(self, keys: set) -> list:
        """Make room, take over what the old generation has, and name the rest."""
        fresh = keys.difference(self.young)
        if len(self.young) + len(fresh) > self.entries:
            self.young, self.old = {}, self.young
            fresh = keys
        old = self.old
        kept = {k: old[k] for k in fresh if k in old}
        self.young.update(kept)
        return list(fresh.difference(kept))


#: A run of letters, one digit or a run of punctuation: one piece of the tokenizer's pattern.
_PURE = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]|[!-/:-@\[-`{-~]+")


class WordEncoder:
    """Encode UTF-8 texts to little-endian unsigned 32-bit ids, for tokenizers that drop white space, keep runs of
    letters, single digits and runs of punctuation apart, fold case and end each run with ``</w>`` (checked on samples when loaded).

    Texts are cut at white space and between letters, digits and punctuation of ASCII and U+00C0 to U+00FF, not
    beside other characters, which may combine, nor between an apostrophe and a letter, which may be a contraction."""

    def __init__(self, path: str, specials_as_text: bool = False, entries: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if specials_as_text:
            self.tokenizer.encode_special_tokens = True
        self.specials = [] if specials_as_text else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.runs = Store(entries), Store(entries // 2)
        self.ends = np.array([x.endswith(b"</w>") for x in self.decode_table()])
        for parts in ((b"a", b"b", b"\xc3\xa9"), (b"Word", b"(other),", b"!!")):
            if self.plain(b" \n".join(parts)) != b"".join(map(self.plain, parts)):
                raise ValueError("the tokenizer's pre-tokenizer must drop white space")
        if self.plain(b"(Other),12x") != b"".join(map(self.plain, (b"(", b"other", b"),", b"1", b"2", b"x"))):
            raise ValueError("the tokenizer must fold case and keep letters, digits and punctuation apart")

    def plain(self, text: bytes) -> bytes:
        """The library's own encoding, nothing reused."""
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        """Ids of one short text."""
        words = text.split()
        self._learn(self.words.lacking(set(words)))
        return b"".join(map(self.words.young.__getitem__, words))

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        whole = {i: self.plain(t) for i, t in enumerate(texts) if any(x in t for x in self.specials)}
        data = b" ".join([b"" if i in whole else t for i, t in enumerate(texts)]) + b" "
        raw = np.frombuffer(data, dtype=np.uint8)
        kind = classes(raw)
        left, right = kind[:-1], kind[1:]
        apart = (left != SPACE) & (left != OTHER) & (right != SPACE) & (right != OTHER) & ((left != right) | (left == DIGIT))
        apart &= (raw[:-1] != ord("'")) | (right != LETTER)
        begins = np.concatenate([[kind[0] != SPACE], apart | ((left == SPACE) & (right != SPACE))])
        starts, letters = np.flatnonzero(begins), kind != SPACE
        index, runs = distinct(raw[letters], np.flatnonzero(begins[letters]))
        self._learn(self.words.lacking(set(runs)))
        got = list(map(self.words.young.__getitem__, runs))
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        ids, at = gather(index, np.frombuffer(b"".join(got), dtype="<u4"), np.cumsum(size) - size, size)
        flat = ids.tobytes()
        begin = np.concatenate([[0], np.cumsum(np.fromiter((0 if i in whole else len(t) for i, t in enumerate(texts)), np.int64, len(texts)) + 1)])
        cut = (4 * at[np.searchsorted(starts, begin)]).tolist()
        return [whole[i] if i in whole else flat[a:b] for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]

    def _learn(self, words: list[bytes]) -> None:
        kept = self.words.young
        pure: list[tuple[bytes, bytes]] = []
        for word in words:
            run = word.lower()
            if _PURE.fullmatch(run):
                pure.append((word, word if run == word else run))  # one object for both stores
            else:
                kept[word] = self.plain(word)
        fresh = self.runs.lacking({run for _, run in pure})
        known = self.runs.young
        for i in range(0, len(fresh), 1000):
            some = fresh[i : i + 1000]
            ids = np.frombuffer(self.plain(b" ".join(some)), dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("the tokenizer must end each run with </w>")
            flat, at = ids.tobytes(), 0
            for run, stop in zip(some, (4 * stops).tolist(), strict=True):
                known[run] = flat[at:stop]
                at = stop
        for word, run in pure:
            kept[word] = known[run]

    def decode_table(self) -> list[bytes]:
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        return [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]


def decode(ids: bytes, table: list[bytes]) -> bytes:
    """UTF-8 of the text for a tokenizer without a decoder: its tokens, joined by spaces."""
    return b" ".join(map(table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, specials_as_text: bool = False, entries: int = 800_000) -> WordEncoder:
    """One encoder for each tokenizer and Python worker, which keeps the ids of at most ``entries`` words (some 250 bytes each)."""
    key = (path, specials_as_text, entries)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, specials_as_text, entries)
    return _ENCODERS[key]


def cuts(texts: list[bytes]) -> list[list[int]]:
    """Ends of the content-defined chunks of each text, the last one its length."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    rolled = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        rolled[shift:] = rolled[shift:] + (rolled[:-shift] << np.uint32(shift))
    # a cut stands before a byte that begins a character
    marks = np.flatnonzero((rolled >> np.uint32(32 - AVERAGE.bit_length() + 1)) == 0) + 1
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = np.searchsorted(marks, starts)
    out = []
    for i, text in enumerate(texts):
        last, ends, origin = 0, [], int(starts[i])
        for at in (marks[found[i] : found[i + 1]] - origin).tolist() + [len(text)]:
            while at - last > MOST:
                last = _character(text, last + MOST)
                ends.append(last)
            if at - last >= LEAST and at >= 32 and (at := _character(text, at)) < len(text):
                ends.append(at)
                last = at
        if last < len(text):
            ends.append(len(text))
        out.append(ends)
    return out


def _character(text: bytes, at: int) -> int:
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def _keys(text: bytes, ends: list[int]) -> np.ndarray:
    """128-bit hashes of the chunks of a text, as pairs of longs."""
    start, digests = 0, []
    for end in ends:
        digests.append(hashlib.blake2b(text[start:end], digest_size=16).digest())
        start = end
    return np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """The filter's bits of each key, a column for each probe."""
    one, two = keys.astype(np.uint64).T
    return np.stack([(one + np.uint64(k) * (two | np.uint64(1))) & np.uint64(bits - 1) for k in range(_PROBES)], axis=1)


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", _SLICE):
            texts = texts_of(batch.column("text"))
            keys = [np.unique(_keys(t, e), axis=0) for t, e in zip(texts, cuts(texts), strict=True) if t]
            flat = np.concatenate(keys) if keys else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["k1", "k2"])


def _maybe_shared(texts: list[bytes], words: np.ndarray) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Chunk ends, keys, and which chunks the filter takes for shared, of each text."""
    bits = 64 * len(words)
    for text, ends in zip(texts, cuts(texts), strict=True):
        keys = _keys(text, ends) if text else np.zeros((0, 2), np.int64)
        at = _probes(keys, bits)
        yield ends, keys, ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def _shared_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of the holders, each once a batch."""
    for whole in batches:
        for batch in slices(whole, "text", _SLICE):
            found: dict[tuple[int, int], bytes] = {}
            places = zip(*[batch.column(c).to_pylist() for c in ("starts", "stops", "k1s", "k2s")], strict=True)
            for text, place in zip(texts_of(batch.column("text")), places, strict=True):
                for start, stop, k1, k2 in zip(*place, strict=True):
                    found[k1, k2] = text[start:stop]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()), pa.array(list(found.values()), pa.binary())],
                names=["k1", "k2", "chunk"])


def _encode_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in slices(whole, "chunk", _SLICE):
                chunks = batch.column("chunk").to_pylist()
                ids = enc.encode_all(chunks)
                yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(ids, pa.binary())], names=["k1", "k2", "ids"])
    return run


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(doc_ids: list, ids: list[bytes], table: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
         pa.array([hashlib.sha256(decode(x, table)).hexdigest() for x in ids], pa.string())], schema=_DIGEST)


def _decoded(doc_ids: list, ids: list[bytes], table: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array([np.frombuffer(x, dtype="<i4") for x in ids], pa.list_(pa.int32())),
         pa.array([decode(x, table).decode() for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])


#: What a document that may hold shared chunks is kept with: its text, and ends and keys of those chunks.
_HOLDER = [("text", pa.binary()), *[(c, pa.list_(pa.int64())) for c in ("starts", "stops", "k1s", "k2s")]]


def _parted(path: str, words, finish):
    """Encode documents that certainly hold no shared chunk (``alone``); the others are left to the join, as ``_HOLDER``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        table = enc.decode_table()
        result = finish([], [], table).schema
        schema = pa.schema([*result, ("alone", pa.bool_()), *_HOLDER])
        for whole in batches:
            for batch in slices(whole, "text", _SLICE):
                texts, doc_ids = texts_of(batch.column("text")), batch.column("doc_id")
                alone, rows = [], []
                for i, (ends, keys, hit) in enumerate(_maybe_shared(texts, words.value)):
                    if hit.any():
                        at = np.flatnonzero(hit)
                        edge = np.array([0, *ends])
                        rows.append((i, edge[at], edge[at + 1], keys[at, 0], keys[at, 1]))
                    else:
                        alone.append(i)
                if alone:
                    n = len(alone)
                    done = finish(doc_ids.take(pa.array(alone)).to_pylist(), enc.encode_all([texts[i] for i in alone]), table)
                    yield pa.RecordBatch.from_arrays([*done.columns, pa.array([True] * n), *[pa.nulls(n, kind) for _, kind in _HOLDER]], schema=schema)
                if rows:
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids.take(pa.array([r[0] for r in rows])), *[pa.nulls(n, f.type) for f in list(result)[1:]], pa.array([False] * n),
                         pa.array([texts[r[0]] for r in rows], pa.binary()), *[pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (1, 2, 3, 4)]],
                        schema=schema)
    return run


_WORD = re.compile(rb"\S+")


def _last_words(text: bytes, a: int, b: int, k: int) -> list[tuple[int, int]]:
    """Where the last k words of text[a:b] start and stop."""
    size = 32 * k
    while True:
        low = max(a, b - size)
        found = [m.span() for m in _WORD.finditer(text, low, b)][1 if low > a else 0 :]
        if len(found) >= k or low == a:
            return found[-k:]
        size *= 2


def _first_words(text: bytes, a: int, b: int, k: int) -> list[tuple[int, int]]:
    """Where the first k words of text[a:b] start and stop."""
    return [m.span() for m, _ in zip(_WORD.finditer(text, a, b), range(k), strict=False)]


def assemble(text: bytes, shared: list[tuple[int, int, bytes]], enc: WordEncoder) -> bytes:
    """Ids of a text from the ids of some of its chunks (start, stop, ids of the chunk by itself), in order."""
    parts, at = [], 0
    for start, stop, ids in shared:
        if len(_first_words(text, start, stop, 3)) < 3:
            continue  # a chunk of so few words may be torn on both sides
        if start > at:
            parts.append((at, start, None))
        parts.append((start, stop, ids))
        at = stop
    if at < len(text):
        parts.append((at, len(text), None))
    fresh = iter(enc.encode_all([text[a:b] for a, b, ids in parts if ids is None]))
    out: list[bytes] = []
    begin, known = 0, b""
    for a, b, ids in parts:
        ids = next(fresh) if ids is None else ids
        if a:
            repaired = repair(text, begin, a, known, b, ids, enc)
            if repaired is None:
                return enc.plain(text)
            done, begin, ids = repaired
            out.append(done)
        known = ids
    return b"".join([*out, known])


def repair(text: bytes, a: int, at: int, left: bytes, b: int, right: bytes, enc: WordEncoder) -> tuple[bytes, int, bytes] | None:
    """Join ``left``, the ids of text[a:at], and ``right``, those of text[at:b], each encoded by itself.

    The words around the join are encoded again as they stand in the text, which replaces what the two sides had
    there.  The window's first and last words are context: their new ids must be exactly the old ones, else the
    window is widened.  Gives the ids before the window, where the window starts, and the ids from there on; None
    if they do not agree over all of both sides.
    """
    k = 2
    while True:
        before, after = _last_words(text, a, at, k), _first_words(text, at, b, k)
        low, high = before[0][0] if before else at, after[-1][1] if after else at
        tail, head, window = enc.encode(text[low:at]), enc.encode(text[at:high]), enc.encode(text[low:high])
        front = enc.encode(text[slice(*before[0])]) if len(before) > 1 else b""
        back = enc.encode(text[slice(*after[-1])]) if len(after) > 1 else b""
        if left.endswith(tail) and right.startswith(head) and window.startswith(front) and window.endswith(back):
            return left[: len(left) - len(tail)], low, window + right[len(head) :]
        if len(before) < k and len(after) < k:
            return None
        k *= 2


def _join_chunks(path: str, finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        table = enc.decode_table()
        for whole in batches:
            for batch in slices(whole, "text", _SLICE):
                ids = []
                for text, parts in zip(texts_of(batch.column("text")), batch.column("parts").to_pylist(), strict=True):
                    parts = sorted((p["start"], p["stop"], p["ids"]) for p in parts or [])
                    ids.append(assemble(text, parts, enc))
                yield finish(batch.column("doc_id").to_pylist(), ids, table)
    return run


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False,
                  filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, ids, decoded) of every row, or with ``digests`` (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    base = id_and_text(docs, id_col, text_col)
    spark = base.sparkSession
    finish, schema = (_digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string") if digests else (
        _decoded, "doc_id long, ids array<int>, decoded string")

    counts = base.mapInArrow(_count_chunks, "k1 long, k2 long").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    shared = written(counts.where("n > 1").select("k1", "k2"), "bpe-shared")
    mask = F.lit(filter_bits - 1)
    one, two = F.col("k1").bitwiseAND(mask), F.col("k2").bitwiseOR(F.lit(1)).bitwiseAND(mask)  # as in _probes; small, so that no sum overflows
    bit = F.explode(F.array(*[(one + F.lit(k) * two).bitwiseAND(mask) for k in range(_PROBES)])).alias("bit")
    marks = shared.select(bit).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("m"))
    found = marks.groupBy("word").agg(F.bit_or("m").alias("m")).toPandas()  # filter_bits / 64 rows at most
    words = np.zeros(filter_bits // 64, dtype=np.uint64)
    words[found["word"].to_numpy(dtype=np.int64)] = found["m"].to_numpy(dtype=np.int64).astype(np.uint64)
    words = spark.sparkContext.broadcast(words)

    parted = base.mapInArrow(_parted(path, words, finish), f"{schema}, alone boolean, text binary, starts array<long>, stops array<long>, k1s array<long>, k2s array<long>")
    parted = written(parted.withColumn("row", F.monotonically_increasing_id()), "bpe-parted")
    alone = parted.where("alone").select(*finish([], [], []).schema.names)
    held = parted.where("NOT alone").select("row", "doc_id", "text", "starts", "stops", "k1s", "k2s")

    chunks = held.select("text", "starts", "stops", "k1s", "k2s").mapInArrow(_shared_texts, "k1 long, k2 long, chunk binary").join(shared, ["k1", "k2"], "left_semi")
    once = chunks.groupBy("k1", "k2").agg(F.first("chunk").alias("chunk"))
    encoded = written(once.mapInArrow(_encode_chunks(path), "k1 long, k2 long, ids binary"), "bpe-chunks")

    lists = held.select("row", F.explode(F.arrays_zip("starts", "stops", "k1s", "k2s")).alias("x")).select(
        "row", F.col("x.starts").alias("start"), F.col("x.stops").alias("stop"), F.col("x.k1s").alias("k1"), F.col("x.k2s").alias("k2"))
    parts = lists.join(encoded, ["k1", "k2"]).groupBy("row").agg(F.collect_list(F.struct("start", "stop", "ids")).alias("parts"))
    joined = held.select("row", "doc_id", "text").join(parts, "row", "left").select("doc_id", "text", "parts")
    return alone.unionByName(joined.mapInArrow(_join_chunks(path, finish), schema))
