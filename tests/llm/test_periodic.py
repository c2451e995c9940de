"""Periodic runs against their definition, transforms against plain sums."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import documents, empty, texts, words
from hypothesis import given, settings
from hypothesis import strategies as st

from nextbest.llm import ntt, periodic, queries


def plain_runs(seq):
    """Every maximal stretch for every period, straight from the definition."""
    n, best = len(seq), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and seq[j] == seq[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b, q) for (a, b), q in best.items())


@pytest.mark.parametrize("size", [1, 2, 8, 16, 256, 4096])
def test_correlation_is_exact(size):
    rng = np.random.default_rng(size)
    for block in {1, max(1, size // 4), size}:
        b, w = rng.integers(ntt.PRIME - 50, ntt.PRIME, (block, 3)), rng.integers(0, ntt.PRIME, (size, 3))
        got = np.remainder(ntt.correlate(b.astype(float), w.astype(float)), ntt.PRIME)
        for c in range(3):
            for i in {0, size // 2, size - 1}:
                assert got[i, c] == sum(int(b[t, c]) * int(w[(i + t) % size, c]) for t in range(block)) % ntt.PRIME


def runs(seqs, largest=ntt.LARGEST // 4):
    edges = np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).astype(np.int64)
    code = np.array([x for s in seqs for x in s], dtype=np.int64)
    return [tuple(x) for x in zip(*(c.tolist() for c in periodic.runs_of(code, edges, largest)), strict=True)], edges


def want(seqs, edges):
    return [(int(edges[k]) + a, int(edges[k]) + b, q) for k, s in enumerate(seqs) for a, b, q in plain_runs(s)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=90), max_size=4), st.sampled_from([2, 4, 1 << 18]))
def test_runs_of_few_words(seqs, largest):
    got, edges = runs(seqs, largest)
    assert got == want(seqs, edges)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 130), st.integers(0, 9), st.integers(0, 5)), min_size=1, max_size=4), st.sampled_from([4, 8, 1 << 18]))
def test_planted_runs(parts, largest):
    seq, fresh = [], 100
    for period, length, gap, seed in parts:
        unit = [random.Random(seed).randrange(12) for _ in range(period)]
        seq += [unit[i % period] for i in range(length)] + list(range(fresh, fresh + gap))
        fresh += gap
    got, edges = runs([seq, seq[::-1]], largest)
    assert got == want([seq, seq[::-1]], edges)


def test_every_period_is_found():
    rng = random.Random(5)
    for q in [*range(1, 70), 127, 128, 129, 255, 256, 257, 700]:
        unit = [rng.randrange(10**6) for _ in range(q)]
        n = max(12, 2 * q) + rng.randrange(q)
        head = [10**7 + k for k in range(rng.randrange(9))]
        seq = head + [unit[i % q] for i in range(n)] + [10**8]
        got, edges = runs([seq])
        assert got == [(len(head), len(head) + n, q)]
        short = head + [unit[i % q] for i in range(max(12, 2 * q) - 1)] + [10**8]
        assert runs([short])[0] == []


def test_words_whose_numbers_agree_modulo_the_prime_stay_apart():
    seq = [k if i < 8 else k + ntt.PRIME for i in range(16) for k in (i % 8,)]
    assert runs([seq])[0] == []


def test_one_word_many_times():
    got, _ = runs([[3] * 20_000])
    assert got == [(0, 20_000, 1)]


def brute(doc_id, text):
    own = (text or "").encode().split()
    n = len(own)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = [w if i < a else own[a + (i - a) % p] for i, w in enumerate(own)]
    found = plain_runs(own)
    gone = {i for a, b, q in found for i in range(a + q, b)}
    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in found)
    top = max(found, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    four = (None,) * 4 if top is None else (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2])
    sha = [hashlib.sha256(x).hexdigest() for x in (listed.encode(), b" ".join(w for i, w in enumerate(own) if i not in gone))]
    return (doc_id, len(found), *four, *sha)


def test_the_query_against_the_definition(spark, tmp_path):
    rows = [(k, " ".join(words(20 + k, k))) for k in range(120)]
    rows += [(1000 + k, " ".join((words(k, k) * 9)[: 7 * k + 3])) for k in range(1, 25)] + [(2000, "same line\n" * 40 + "x " * 15), (2001, "a"), (2002, "a b " * 6)]
    docs = documents(spark).unionByName(documents(spark, [(i, t, "en", "s", 1) for i, t in rows])).where("doc_id IS NULL OR doc_id NOT IN (7, 8, 9)")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((brute(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert sum(r.n_runs for r in got) > 30


def test_operator_gives_runs_and_texts(spark):
    got = {r.doc_id: r for r in periodic.periodic_runs(texts(spark, [(1, "go " + "a b c " * 5 + "end"), (2, None), (3, " \n")])).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 15, 3)] and got[1].collapsed == "go a b c end"
    assert (got[2].runs, got[2].collapsed, got[3].runs, got[3].collapsed) == ([], "", [], "")
    assert periodic.periodic_runs(empty(spark)).count() == 0
