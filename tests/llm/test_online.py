"""The byte-level encoder and bounded-space packing against the tokenizers library and plain checks."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, empty, texts, words
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nextbest.llm import bytebpe, online, queries

PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = Tokenizer.from_file(PATH)
PARTS = [*" \n\t'aZéÉ.!#12日́×\x1c\x85　", "  ", "   ", " \n", "'s", " 't", "'re", "'LL", "<|endoftext|>", "the", "data"]


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(PARTS)), max_size=30).map("".join), max_size=4))
def test_texts_encode_as_the_library_does(some):
    got = bytebpe.encoder(PATH, RANKS).encode_all([t.encode() for t in some])
    assert [x.tolist() for x in got] == [ids_of(t)[:-1] for t in some]


def test_random_texts_together():
    rng = random.Random(3)
    for parts in (PARTS, [p for p in PARTS if p.isascii() and "<" not in p]):
        many = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(15_000)]
        enc = bytebpe.ByteEncoder(PATH, RANKS, entries=500)  # runs come and go
        for i in range(0, len(many), 3000):
            want = [x.ids for x in TOKENIZER.encode_batch(many[i : i + 3000], add_special_tokens=False)]
            assert [x.tolist() for x in enc.encode_all([t.encode() for t in many[i : i + 3000]])] == want


def test_bytes_that_are_no_characters():
    enc = bytebpe.ByteEncoder(PATH, RANKS)
    for _ in range(2):
        assert [x.tolist() for x in enc.encode_all([b"ok \xff\xfe", b"fine"])] == [enc.plain(b"ok \xff\xfe").tolist(), enc.plain(b"fine").tolist()]


def check(rows, docs, tokens):
    """Each id in one piece, sequences gapless, all but the tail full."""
    want = sorted((r.doc_id or -1, tuple(ids_of(r.text))) for r in docs.collect())
    bins, parts = {}, {}
    for r in rows:
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        parts.setdefault((r.doc_id or -1, r.doc_tokens), []).append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    lengths = []
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        lengths.append(sum(n for _, n in places))
    total = sum(len(ids) for _, ids in want)
    assert sorted(lengths, reverse=True) == [tokens] * (total // tokens) + online.tail_lengths(total % tokens)
    for (doc_id, n), pieces in parts.items():
        same = [ids for d, ids in want if d == doc_id and len(ids) == n]
        pieces.sort()
        covered = sum(len(ids) for _, ids in pieces)
        assert covered == n * len(same)
        if len(same) == 1:
            assert [x for _, ids in pieces for x in ids] == list(same[0])
        else:  # repeated rows: every position as often as it is there
            at = sorted((s + k, x) for s, ids in pieces for k, x in enumerate(ids))
            assert at == sorted((k, x) for ids in same for k, x in enumerate(ids))
    assert sum(len(ids) for ps in parts.values() for _, ids in ps) == total


@pytest.mark.parametrize(("tokens", "windows"), [(64, 4), (1024, 64), (16, 1), (7, 2)])
def test_packing_of_a_table(spark, tokens, windows):
    docs = documents(spark).repartition(5)
    check(online.packed(docs, PATH, RANKS, tokens, windows).collect(), docs, tokens)


def test_many_partitions_and_empty_tables(spark):
    docs = texts(spark, [(k, " ".join(words(k % 90, k))) for k in range(300)]).repartition(40)
    check(online.packed(docs, PATH, RANKS, 128, 3).collect(), docs, 128)
    assert online.packed(empty(spark), PATH, RANKS).count() == 0
    bare = online.packed(docs, PATH, RANKS, 128, 3, with_ids=False)
    assert "ids" not in bare.columns and bare.agg({"length": "sum"}).first()[0] == sum(len(ids_of(r.text)) for r in docs.collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(1, 32), st.integers(1, 6))
def test_windows_are_bounded_and_emitted_full(lengths, tokens, windows):
    packer, kept = online.Packer(tokens, windows, 5), {}
    for k, n in enumerate(lengths):
        for window, pieces in packer.add(k, np.arange(n)):
            assert sum(len(p[2]) for p in pieces) == tokens and window not in kept
            kept[window] = pieces
        assert len(packer.pieces) == len(packer.free) <= windows
    parts = {}
    for pieces in [*kept.values(), *packer.pieces.values()]:
        for doc, start, ids, n, _ in pieces:
            assert n == lengths[doc] and ids.tolist() == list(range(start, start + len(ids)))
            parts.setdefault(doc, []).extend(ids.tolist())
    assert {d: sorted(x) for d, x in parts.items()} == {d: list(range(n)) for d, n in enumerate(lengths)}


def test_a_document_goes_where_it_fits_best():
    packer = online.Packer(10, 3, 0)
    for k, n in enumerate((4, 7, 8)):
        assert not list(packer.add(k, np.arange(n)))
    assert packer.free == [(2, 2), (3, 1), (6, 0)]
    [(window, pieces)] = packer.add(3, np.arange(3))
    assert window == 1 and [p[0] for p in pieces] == [1, 3]
    assert not list(packer.add(4, np.arange(9)))
    [(window, pieces)] = packer.add(5, np.arange(8))  # fits none: the fullest takes one token, the next the rest or is cut
    assert window == 3 and len(pieces[-1][2]) == 1


def test_the_query_reads_its_whole_table(spark):
    rows = queries.op13_bounded_space_packing(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {r.doc_id: np.array(ids_of(r.text), "<u4") for r in docs}
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    for r in rows:
        part = want[r.doc_id][r.start : r.start + r.length].tobytes()
        assert zlib.crc32(part) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
