"""Encoding, chunk reuse, packing and flat files against the tokenizers library and plain loops."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, empty, odd_documents, texts, words
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nextbest.llm import bpe, flat, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def packed_ids(ids):
    return np.array(ids, dtype="<u4").tobytes()


CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'S", "'T", "'RE", "'Ve", "'M", "'LL", "'D", "'the", " 'some", "('t", "'data'", "say 's"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \n\t'sStTaAéÉßİ.!#<|>́ 　\x1c\x85×÷Ç19")), st.sampled_from(CONTRACTIONS)), max_size=40).map("".join))
def test_words_encode_as_the_library_does(text):
    enc = bpe.encoder(PATH)
    assert enc.encode_all([text.encode()])[0] == packed_ids(ids_of(text))
    if "<|" not in text:
        assert enc.encode(text.encode()) == packed_ids(ids_of(text))
    table = enc.decode_table()
    assert bpe.decode(packed_ids(ids_of(text)), table).decode() == TOKENIZER.decode(ids_of(text), skip_special_tokens=False)


def test_random_texts_together():
    """30,000 texts, encoded in batches, so that runs of one text are reused in others."""
    rng = random.Random(3)
    parts = [*" \n'aAéÉ.!#12日́", *CONTRACTIONS, "the", "data", "<|endoftext|>"]
    many = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(30_000)]
    enc = bpe.encoder(PATH)
    for i in range(0, len(many), 5000):
        some = many[i : i + 5000]
        want = [packed_ids(x.ids) for x in TOKENIZER.encode_batch(some, add_special_tokens=False)]
        assert enc.encode_all([t.encode() for t in some]) == want
    assert enc.encode_all([]) == []


def test_special_strings_and_small_stores():
    text = "a <|endoftext|> b<|startoftext|>c <|EndOfText|>"
    assert bpe.WordEncoder(PATH).encode_all([text.encode()])[0] == packed_ids(ids_of(text))
    plain = bpe.WordEncoder(PATH, specials_as_text=True).encode_all([text.encode()])[0]
    assert 49407 not in np.frombuffer(plain, "<u4")
    small = bpe.WordEncoder(PATH, entries=8)
    for k in range(30):
        t = " ".join(words(12, k % 7))
        assert small.encode_all([t.encode()])[0] == packed_ids(ids_of(t))


def test_cuts_follow_the_content():
    rng = random.Random(1)
    shared = " ".join(words(1500, 3)).encode()
    one, two = (" ".join(words(300, s)).encode() + b" " + shared for s in (8, 9))
    a, b = bpe.cuts([one, two])
    tails = [{e - len(t) for e in ends if e > len(t) - len(shared)} for t, ends in ((one, a), (two, b))]
    assert len(tails[0] & tails[1]) > 0.8 * len(tails[0])
    for text, ends in ((one, a), (two, b), (("é日" * 5000).encode(), bpe.cuts([("é日" * 5000).encode()])[0])):
        assert ends[-1] == len(text) and ends == sorted(set(ends)) and all(bytes([text[e]])[0] & 0xC0 != 0x80 for e in ends[:-1])
    assert bpe.cuts([b""]) == [[]] and rng


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(list("ab é.\n'1")), st.sampled_from(CONTRACTIONS)), max_size=120).map("".join), st.lists(st.integers(0, 300), max_size=8))
def test_any_chunks_join_exactly(text, at):
    """Ids of arbitrary chunks, each encoded by itself, joined and repaired, are the whole text's."""
    enc = bpe.encoder(PATH)
    data = text.encode()
    ends = sorted({bpe._character(data, min(x, len(data))) for x in at} | {len(data)})
    chunks = [(a, b) for a, b in zip([0, *ends], ends, strict=False) if b > a]
    shared = [(a, b, enc.encode_all([data[a:b]])[0]) for k, (a, b) in enumerate(chunks) if k % 3 != 2]
    assert bpe.assemble(data, shared, enc) == packed_ids(ids_of(text))


def test_a_join_replaces_torn_words():
    enc = bpe.encoder(PATH)
    left, right = b"some words before hel", b"lo and more words"
    ids = [enc.encode_all([x])[0] for x in (left, right)]
    assert ids[0] + ids[1] != enc.plain(left + right)
    done, low, rest = bpe.repair(left + right, 0, len(left), ids[0], len(left + right), ids[1], enc)
    assert done + rest == enc.plain(left + right) and 0 < low < len(left)
    assert bpe.repair(left + right, 0, len(left), b"1234", len(left + right), ids[1], enc) is None


def test_encode_decode_of_a_table(spark):
    shared = " ".join(words(900, 77))
    docs = documents(spark).unionByName(documents(spark, [(100 + k, f"Start {k} {shared} end.{k}", None, None, 0) for k in range(12)]))
    docs = docs.unionByName(documents(spark, [(200 + k, t, None, None, 0) for k, t in enumerate([" ", " ", " ab ", " ab ", "ab", "ab", " " * 700, " " * 700, "\n" + "x" * 600 + " ", "\n" + "x" * 600 + " "])]))
    got = bpe.encode_decode(docs, PATH, digests=True).collect()
    want = []
    for r in docs.collect():
        ids = ids_of(r.text)
        want.append((r.doc_id or -1, len(ids), hashlib.sha256(packed_ids(ids)).hexdigest(), hashlib.sha256(TOKENIZER.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    plain = bpe.encode_decode(texts(spark, [(1, "Hello there"), (2, None)]), PATH).collect()
    assert {r.doc_id: (list(r.ids), r.decoded) for r in plain} == {1: (ids_of("Hello there"), TOKENIZER.decode(ids_of("Hello there"), skip_special_tokens=False)), 2: ([], "")}
    assert bpe.encode_decode(empty(spark), PATH).count() == 0


def test_a_filter_of_few_bits_changes_nothing(spark):
    shared = " ".join(words(600, 7))
    docs = texts(spark, [(k, f"{' '.join(words(200, 50 + k))} {shared}") for k in range(8)])
    many, few = (sorted(map(tuple, bpe.encode_decode(docs, PATH, digests=True, filter_bits=bits).collect())) for bits in (1 << 20, 64))
    assert many == few


def test_encode_decode_reads_the_documents_twice(spark):
    shared = " ".join(words(600, 7))
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = texts(spark, [(k, f"{' '.join(words(200, 50 + k))} {shared if k % 2 else ''}") for k in range(8)])
    got = bpe.encode_decode(docs.mapInArrow(read, docs.schema), PATH, digests=True).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((r.doc_id, len(ids_of(r.text))) for r in docs.collect())
    assert seen.value == 2 * 8


# -- packing -----------------------------------------------------------------------------------------------------------
def check_packing(rows, limits):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= limits.tokens and len(parts) <= limits.documents and sum(n * n for _, n in parts) <= limits.cost
    return len(bins)


def test_packed_table(spark):
    docs = documents(spark)
    limits = pack.Limits(tokens=64)
    got = pack.packed(docs, PATH, limits).collect()
    check_packing(got, limits)
    by_piece = sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got)
    want = []
    for r in docs.collect():
        ids = [*ids_of(r.text), 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = packed_ids(ids[at : at + 64])
            want.append((r.doc_id or -1, k, at, len(part) // 4, zlib.crc32(part), part))
    assert by_piece == sorted(want)
    assert pack.packed(empty(spark), PATH).count() == 0


def best_fit_decreasing(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room)


@pytest.mark.parametrize("score", ["norm", "dot"])
@settings(max_examples=60, deadline=None)
@given(lengths=st.lists(st.integers(1, 100), min_size=0, max_size=150), documents_=st.integers(2, 100), cost=st.integers(10_000, 30_000))
def test_plan_keeps_every_capacity(score, lengths, documents_, cost):
    limits = pack.Limits(tokens=100, documents=documents_, cost=cost, score=score)
    histogram = {n: lengths.count(n) for n in set(lengths)}
    places = pack.plan(histogram, limits)
    seen = {n: set() for n in histogram}
    bins: dict[int, list] = {}
    for p in places:
        for k in range(p.each * p.count):
            assert p.rank + k not in seen[p.length]
            seen[p.length].add(p.rank + k)
            bins.setdefault(p.sequence + k // p.each, []).append((p.offset + k % p.each * p.length, p.length))
    assert {n: len(s) for n, s in seen.items()} == histogram
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 100 and len(parts) <= documents_ and sum(n * n for _, n in parts) <= cost
    if score == "norm" and documents_ == 100 and cost == 30_000:
        assert len(bins) <= best_fit_decreasing(lengths, 100) + 1


def test_plan_is_close_to_the_bound():
    rng = random.Random(1)
    lengths = [min(2048, int(rng.expovariate(1 / 300)) + 1) for _ in range(20_000)]
    places = pack.plan({n: lengths.count(n) for n in set(lengths)}, pack.Limits())
    used = max(p.sequence + p.count for p in places)
    assert used <= -(-sum(lengths) // 2048) * 1.002 + 1


# -- flat files --------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [1 << 20, 7, 1])
def test_flat_files(spark, tmp_path, block):
    docs = documents(spark, [r for r in odd_documents() if r[0] not in (7, 8, 9)]) if block == 1 else documents(spark)
    target = f"{tmp_path}/flat"
    names = flat.write_flat(docs.repartition(3), target, PATH, 49407)
    found = flat.scan(spark, target, 49407, block)
    got = sorted((r.doc_id or -1, r.n_tokens) for r in flat.named(found, names).collect())
    assert got == sorted((r.doc_id or -1, len(ids_of(r.text))) for r in docs.collect())
    assert found.where("NOT terminated").count() == 0


def test_unterminated_and_empty_files(spark, tmp_path):
    np.array([5, 6, 9, 9, 7], dtype="<u2").tofile(tmp_path / "a.bin")
    np.array([], dtype="<u2").tofile(tmp_path / "b.bin")
    np.array([9], dtype="<u2").tofile(tmp_path / "c.bin")
    for block in (1, 2, 3, 100):
        got = sorted((r.uri[-5:], r.ordinal, r.start, r.n_tokens, r.terminated) for r in flat.scan(spark, f"file://{tmp_path}", 9, block).collect())
        assert got == [("a.bin", 0, 0, 2, True), ("a.bin", 1, 3, 0, True), ("a.bin", 2, 4, 1, False), ("c.bin", 0, 0, 0, True)]


def test_empty_table_of_documents(spark, tmp_path):
    assert flat.write_flat(empty(spark), f"{tmp_path}/flat", PATH, 49407).count() == 0
    assert flat.scan(spark, f"{tmp_path}/flat", 49407).count() == 0


def test_files_of_failed_tasks_are_not_named(spark, tmp_path):
    names = flat.write_flat(texts(spark, [(1, "some words"), (2, "and more")]), f"{tmp_path}/flat", PATH, 49407)
    np.array([5, 49407], dtype="<u2").tofile(tmp_path / "flat" / "part-00000-left.bin")
    assert {r.doc_id for r in flat.named(flat.scan(spark, f"{tmp_path}/flat", 49407), names).collect()} == {1, 2}
