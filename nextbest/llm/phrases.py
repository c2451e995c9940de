"""Phrases of two to four words that occur together more than their parts, mined exactly over all documents.

Texts are cut into pieces and words.  Each task makes shards: the words of one language in its partition, numbered,
up to ``SHARD_BYTES`` of text.  A shard's phrases are enumerated by interval extension in a bidirectional FM-index
(``fmindex``), and counts are summed across shards:

* words first; a word of fewer than ``least`` occurrences is in no candidate, so the shards drop it;
* pairs of what remains; a pair of fewer occurrences is in no candidate either, so the shards cut their texts there;
* phrases of three and four words of what remains, by extension to the right and to the left.

A shard gets back by join which of its own words and pairs are frequent; nothing that grows with the data is
broadcast, and no task holds more than one shard's words or pairs.  Every count that is at least ``least`` is exact,
and so are those of all parts of a candidate, since they occur at least as often.

Defined results: a null or empty text has no words; a null language is ``und``; rows with null or repeated ids each
count; only the text and the language are read; an empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nextbest.llm.common import slices, texts_of, written
from nextbest.llm.fmindex import Bidirectional
from nextbest.llm.runs import numbered

SHARD_BYTES, TASK_BYTES = 3 << 20, 16 << 20
#: Letters A-Z in lower case, what ends a piece as a line end, a tab as a blank.
_TABLE = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_GROUPS = 64
_SLICE = 2 << 20
#: Shards whose pairs make one part, on average: some hundred thousand for each, sorted in one task.
_SHARDS_A_PART = 4
#: A shard's row (its text and the numbers of its words) and its rows of pairs; frequent pairs; phrases of three and four words.
_LONGS = pa.list_(pa.int64())
_PAIRS = pa.schema([("shard", pa.int64()), ("ids", pa.binary()), ("word", _LONGS), ("part", pa.int64()), ("pairs", pa.binary())])
_TWOS = pa.schema([("shard", pa.int64()), ("held", pa.binary()), ("w1", _LONGS), ("w2", _LONGS), ("f", _LONGS)])
_MORE = pa.schema([("part", pa.int64()), ("phrases", pa.binary())])


def numbers(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of many texts as numbers from 1 on, with 0 around every piece; the distinct words, and how often each occurs."""
    raw = np.frombuffer(b"\n".join(texts).translate(_TABLE), dtype=np.uint8)
    inside = (raw != 32) & (raw != 10)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(1, np.int32), pa.array([], pa.string()), np.zeros(0, np.int64)
    coded = numbered(raw[inside], np.flatnonzero(begins[inside]))
    number = np.asarray(coded.indices)
    apart = np.diff(np.searchsorted(np.flatnonzero(raw == 10), starts), prepend=-1) != 0
    del raw, inside, begins
    out = np.zeros(len(starts) + int(apart.sum()) + 1, dtype=np.int32)
    out[np.arange(len(starts)) + np.cumsum(apart)] = number + 1
    return out, coded.dictionary.cast(pa.large_string()).cast(pa.string()), np.bincount(number)


def chains(text: np.ndarray, least: int, apart: np.ndarray | None = None) -> np.ndarray:
    """The stretches of at least ``least`` words, 0 around each; ``apart`` marks places before which a stretch ends as well."""
    word = text != 0
    head = word.copy()
    head[1:] &= ~word[:-1] if apart is None else ~word[:-1] | apart[1:]
    own = np.cumsum(head)[word] - 1
    size = np.bincount(own) if len(own) else np.zeros(0, np.int64)
    keep = (size >= least)[own]
    kept, own = text[word][keep], own[keep]
    new = np.diff(own, prepend=-1) != 0
    out = np.zeros(len(kept) + int(new.sum()) + 1, dtype=np.int64)
    out[np.arange(len(kept)) + np.cumsum(new)] = kept
    return out


def _shards(shard_bytes: int, task_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[str, list[bytes]] = defaultdict(list)
        size: dict[str, int] = defaultdict(int)
        shard = TaskContext.get().partitionId() << 32

        def made(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal shard
            ids, words, counts = numbers(held.pop(lang))
            del size[lang]
            if len(words):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), pa.array([lang]), pa.array([int(counts.sum())], pa.int64()), pa.array([squeezed(ids)], pa.binary()),
                     pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.array([counts], pa.list_(pa.int64()))],
                    names=["shard", "lang", "n", "ids", "words", "counts"])
                shard += 1

        for batch in (part for whole in batches for part in slices(whole, "text", _SLICE)):
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch.column("text")), strict=True):
                lang = "und" if lang is None else lang
                held[lang].append(text)
                size[lang] += len(text) + 1
                if size[lang] >= shard_bytes:
                    yield from made(lang)
                elif sum(size.values()) >= task_bytes:
                    yield from made(max(size, key=size.__getitem__))
        for lang in sorted(held):
            yield from made(lang)
    return run


def squeezed(*columns: np.ndarray) -> bytes:
    """Whole numbers, columns of one length: first bytes, second bytes and so on together, compressed."""
    raw = np.ascontiguousarray(np.stack(columns).astype("<i8").view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def spread(blob: bytes, k: int) -> list[np.ndarray]:
    """The k columns that were squeezed."""
    size = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8)
    return list(np.ascontiguousarray(raw.reshape(k, 8, -1).transpose(0, 2, 1)).view("<i8").reshape(k, -1))


def _by_part(words: list[np.ndarray], count: np.ndarray, rank: np.ndarray, word: np.ndarray, parts: int) -> tuple[np.ndarray, list[bytes]]:
    """Phrases of one shard, given by its own numbers (from 1 on; 0: no word), as one blob for each part of all phrases:
    the phrase's word numbers (-1: no word), the first as differences, and its count."""
    mixed = np.zeros(len(count), np.uint64)
    known = np.append(word, -1)
    columns = [known[w - 1] for w in words]
    for w in columns:
        mixed = (mixed ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    part = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int64) % parts
    order = np.argsort((part * len(known) + rank[words[0] - 1]) * len(known) + rank[words[1] - 1], kind="stable")
    part = part[order]
    heads = np.flatnonzero(np.diff(part, prepend=-1) != 0)
    blobs = []
    for low, high in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=False):
        some = order[low:high]
        blobs.append(squeezed(np.diff(columns[0][some], prepend=0), *[c[some] for c in columns[1:]], count[some]))
    return part[heads], blobs


def _ranks(word: np.ndarray) -> np.ndarray:
    rank = np.empty(len(word), dtype=np.int64)
    rank[np.argsort(word)] = np.arange(len(word))
    return rank


def _pairs(parts: int):
    def run(shard: pa.Table, marks: pa.Table) -> pa.Table:
        """Of one shard and the numbers ``w`` of its frequent words (``at``: its own): a row of its text of these, and its
        pairs, those of a part of all pairs in a row."""
        if not marks.num_rows or not shard.num_rows:
            return _PAIRS.empty_table()
        at, word = marks.column("at").to_numpy(), marks.column("w").to_numpy()
        number = shard.column("shard")[0].as_py()
        text = spread(shard.column("ids")[0].as_py(), 1)[0]
        own = np.zeros(int(text.max(initial=0)) + 1, dtype=np.int32)
        own[at + 1] = np.arange(1, len(at) + 1)
        text = chains(own[text], 2)
        index = Bidirectional(text, 2)
        two = index.left(index.single())
        del index
        part, blobs = _by_part([two.words[:, 0], two.words[:, 1]], two.size, _ranks(word), word, parts)
        n = len(part)
        whole = pa.Table.from_arrays([pa.array([number], pa.int64()), pa.array([squeezed(text)], pa.binary()), pa.array([word], _LONGS), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())], schema=_PAIRS)
        rest = pa.Table.from_arrays([pa.array(np.full(n, number)), pa.nulls(n, pa.binary()), pa.nulls(n, _LONGS), pa.array(part), pa.array(blobs, pa.binary())], schema=_PAIRS)
        return pa.concat_tables([whole, rest])
    return run


def _merged(blobs: list[bytes], k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of many blobs in order: their k word numbers, counts, which blob each is from; and of each distinct one
    the first place and the sum of its counts."""
    columns = [spread(x, k + 1) for x in blobs]
    source = np.repeat(np.arange(len(blobs)), [len(x[0]) for x in columns])
    columns = [np.concatenate([np.cumsum(x[0]) if c == 0 else x[c] for x in columns]) for c in range(k + 1)]
    order = np.lexsort(columns[k - 1 :: -1])
    columns, source = [x[order] for x in columns], source[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in columns[:k]], axis=0)
    head = np.flatnonzero(new)
    return columns[:k], source, new, head, np.add.reduceat(columns[k], head)


def _frequent(least: int):
    def run(part: pa.Table) -> pa.Table:
        """Of one part of the pairs, in all shards: its frequent pairs with their counts (``shard`` null), and which of them each
        shard holds."""
        (one, other), source, new, head, f = _merged(part.column("pairs").to_pylist(), 2)
        often = f >= least
        held = np.flatnonzero(often[np.cumsum(new) - 1])
        if not len(held):
            return _TWOS.empty_table()
        held = held[np.argsort(source[held], kind="stable")]
        from_ = source[held]
        each = np.flatnonzero(np.diff(from_, prepend=-1) != 0)
        blobs = [squeezed(np.diff(one[x], prepend=0), other[x]) for x in np.split(held, each[1:])]
        head, n = head[often], len(each)
        sums = pa.Table.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *[pa.array([x], _LONGS) for x in (one[head], other[head], f[often])]], schema=_TWOS)
        rows = pa.Table.from_arrays([pa.array(part.column("shard").to_numpy()[from_[each]]), pa.array(blobs, pa.binary()), *[pa.nulls(n, _LONGS)] * 3], schema=_TWOS)
        return pa.concat_tables([sums, rows])
    return run


def _longer(parts: int):
    def run(shard: pa.Table, marks: pa.Table) -> pa.Table:
        """Of one shard's text and its frequent pairs: its phrases of three and four words, those of a part in a row."""
        if not marks.num_rows or not shard.num_rows:
            return _MORE.empty_table()
        word = np.asarray(shard.column("word")[0].values)
        pairs = [spread(x, 2) for x in marks.column("held").to_pylist()]
        one, other = np.concatenate([np.cumsum(x[0]) for x in pairs]), np.concatenate([x[1] for x in pairs])
        del pairs
        text = spread(shard.column("ids")[0].as_py(), 1)[0]
        order = np.argsort(word)

        def local(x: np.ndarray) -> np.ndarray:
            return order[np.searchsorted(word, x, sorter=order)] + 1

        width = len(word) + 1
        known = np.sort(local(one) * width + local(other))
        key = np.concatenate([[0], text[:-1] * width + text[1:]])
        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
        text = chains(text, 3, apart=known[place] != key)
        del key, place, known, one, other
        index = Bidirectional(text, 4)
        three = index.right(index.left(index.single()))
        four = index.left(three)
        del index, text
        words = [np.concatenate([three.words[:, k] if k < 3 else np.zeros(len(three.size), np.int64), four.words[:, k]]) for k in range(4)]
        part, blobs = _by_part(words, np.concatenate([three.size, four.size]), _ranks(word), word, parts)
        return pa.Table.from_arrays([pa.array(part), pa.array(blobs, pa.binary())], schema=_MORE)
    return run


def _sums(least: int):
    def run(part: pa.Table) -> pa.Table:
        """Of one part of the phrases of three and four words: the frequent ones with their counts."""
        columns, _, _, head, f = _merged(part.column("phrases").to_pylist(), 4)
        head, f = head[f >= least], f[f >= least]
        return pa.Table.from_arrays([*[pa.array(x[head], mask=x[head] < 0) for x in columns], pa.array(f)], names=["w1", "w2", "w3", "w4", "f"])
    return run


def frequencies(docs: DataFrame, least: int, lang_col: str = "lang", text_col: str = "text", shard_bytes: int = SHARD_BYTES, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of phrases of one to four words that occur ``least`` times or more: (key, f), where a key lists word numbers;
    (lang, word, w) of the words among them; and (lang, n), all words of each language."""
    base = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    shards = written(base.mapInArrow(_shards(shard_bytes, task_bytes), "shard long, lang string, n long, ids binary, words array<string>, counts array<long>"), "phrase-shards")
    each = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select(
        "shard", "lang", "at", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    often = each.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    words = written(often.withColumn("w", F.monotonically_increasing_id()), "phrase-words")
    marks = each.join(words.select("lang", "word", "w"), ["lang", "word"]).select(F.col("shard").alias("home"), "at", "w")
    parts = shards.count() // _SHARDS_A_PART + 1  # grows with the texts, so that no task sorts more
    # a shard and the rows about its own words meet as one group, so a task holds one shard at a time
    pairs = shards.select("shard", "ids").groupBy("shard").cogroup(marks.groupBy("home")).applyInArrow(
        _pairs(parts), "shard long, ids binary, word array<long>, part long, pairs binary")
    pairs = written(pairs, "phrase-pairs")
    often = pairs.where("ids IS NULL").select("part", "shard", "pairs").groupBy("part").applyInArrow(
        _frequent(least), "shard long, held binary, w1 array<long>, w2 array<long>, f array<long>")
    often = written(often, "phrase-twos")
    twos = often.where("shard IS NULL").select(F.explode(F.arrays_zip("w1", "w2", "f")).alias("x")).select(
        F.col("x.w1").alias("w1"), F.col("x.w2").alias("w2"), F.col("x.f").alias("f"))
    more = pairs.where("ids IS NOT NULL").select("shard", "ids", "word").groupBy("shard").cogroup(
        often.where("shard IS NOT NULL").select(F.col("shard").alias("home"), "held").groupBy("home")).applyInArrow(_longer(parts), "part long, phrases binary")
    more = more.groupBy("part").applyInArrow(_sums(least), "w1 long, w2 long, w3 long, w4 long, f long")
    key = F.filter(F.array("w1", "w2", "w3", "w4"), lambda x: x.isNotNull()).alias("key")
    counts = words.select(F.array("w").alias("key"), "f").unionByName(twos.select(F.array("w1", "w2").alias("key"), "f")).unionByName(more.select(key, "f"))
    return written(counts, "phrase-counts"), words, shards.groupBy("lang").agg(F.sum("n").alias("n"))


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, percent: int = 80, lang_col: str = "lang", text_col: str = "text",
                 shard_bytes: int = SHARD_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.  A phrase of ``a`` occurrences,
    cut after its first words into parts of ``l`` and ``r`` occurrences, scores floor(2000000 a / (l + r)); its lowest-scoring
    cut counts, the one after the fewest words among equals.  Phrases inside a longer one with ``percent`` of their
    occurrences or more are left out."""
    counts, words, totals = frequencies(docs, least, lang_col, text_col, shard_bytes, task_bytes)
    phrases = counts.where(F.size("key") > 1).withColumnRenamed("f", "a")
    cut = phrases.select("key", "a", F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k"))
    cut = cut.withColumn("first", F.slice("key", F.lit(1), F.col("k"))).withColumn("rest", F.expr("slice(key, k + 1, size(key) - k)"))
    cut = cut.join(counts.select(F.col("key").alias("first"), F.col("f").alias("l")), "first").join(counts.select(F.col("key").alias("rest"), F.col("f").alias("r")), "rest")
    cut = cut.withColumn("score", F.expr("(cast(a as decimal(19,0)) * 2000000) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    scored = cut.groupBy("key").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("x"))
    inside = counts.where(F.size("key") > 2).select("key", "f", F.explode(F.sequence(F.lit(2), F.size("key") - 1)).alias("size"))
    inside = inside.select("f", "key", "size", F.explode(F.expr("sequence(1, size(key) - size + 1)")).alias("at")).select(F.expr("slice(key, at, size)").alias("key"), "f")
    inside = inside.groupBy("key").agg(F.max("f").alias("f"))
    kept = scored.join(inside, "key", "left").where(F.col("f").isNull() | (_exact("f") * 100 < _exact("a") * percent))
    spelled = kept.select("key", "a", "x.score", "x.l", "x.r", F.posexplode("key").alias("at", "w")).join(words.select("w", "word", "lang"), "w")
    spelled = spelled.groupBy("key").agg(F.first("a").alias("a"), F.first("score").alias("score"), F.first("l").alias("l"), F.first("r").alias("r"), F.first("lang").alias("lang"),
                                         F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of groups of a language's phrases, then the first of these
    some = spelled.withColumn("grp", F.pmod(F.xxhash64("phrase"), F.lit(_GROUPS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "grp").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
