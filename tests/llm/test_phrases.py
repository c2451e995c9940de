"""Phrases and their index against counting every sequence of words."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import documents, empty, texts, words
from hypothesis import given, settings
from hypothesis import strategies as st

from nextbest.llm import fmindex, phrases, queries


def pieces_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def brute(rows, least, top, percent=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in pieces_of(text):
            n[lang or "und"] += len(piece)
            for k in range(1, 5):
                f.update((lang or "und", *piece[i : i + k]) for i in range(len(piece) - k + 1))
    f = {g: c for g, c in f.items() if c >= least}
    inside = Counter()
    for (lang, *g), c in f.items():
        for m in range(2, len(g)):
            for i in range(len(g) - m + 1):
                inside[lang, *g[i : i + m]] = max(inside[lang, *g[i : i + m]], c)
    out = []
    for (lang, *g), a in f.items():
        if len(g) > 1 and 100 * inside[lang, *g] < percent * a:
            score, _, l, r = min((2000000 * a // (l + r), k, l, r) for k in range(1, len(g)) for l, r in [(f[lang, *g[:k]], f[lang, *g[k:]])])
            out.append((lang, -score, -a, " ".join(g).encode(), l, r))
    rows, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=30), max_size=6))
def test_index_counts_every_phrase(pieces):
    text = np.array([0] + [x for p in pieces for x in (*p, 0)], dtype=np.int64)
    index = fmindex.Bidirectional(phrases.chains(text, 1), 4)
    want = [Counter(tuple(p[i : i + k]) for p in pieces for i in range(len(p) - k + 1)) for k in range(5)]
    one = index.single()
    for found in ([one, index.left(one)], [one, index.right(one)], [one, index.left(one), index.right(index.left(one)), index.left(index.right(index.left(one)))],
                  [one, index.right(one), index.right(index.right(one)), index.right(index.right(index.right(one)))]):
        for k, x in enumerate(found, 1):
            assert dict(zip(map(tuple, x.words.tolist()), x.size.tolist(), strict=True)) == want[k]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=list("aB \t.\n\r\x0bé!"), max_size=20), max_size=5))
def test_numbers_are_the_words(some):
    ids, known, counts = phrases.numbers([t.encode() for t in some])
    want = [p for t in some for p in pieces_of(t) if p]
    got, piece = [], []
    for x in ids.tolist():
        if x:
            piece.append(known[x - 1].as_py())
        elif piece:
            got.append(piece)
            piece = []
    assert got == want and counts.tolist() == [Counter(w for p in want for w in p)[k.as_py()] for k in known]


def test_chains():
    text = np.array([0, 1, 0, 2, 3, 0, 4, 5, 6, 0])
    assert phrases.chains(text, 2).tolist() == [0, 2, 3, 0, 4, 5, 6, 0]
    apart = np.zeros(10, bool)
    apart[7] = True
    assert phrases.chains(text, 2, apart).tolist() == [0, 2, 3, 0, 5, 6, 0]
    assert phrases.chains(text, 4).tolist() == [0] and phrases.chains(np.zeros(1, np.int64), 1).tolist() == [0]


@pytest.mark.parametrize(("shard", "task"), [(8 << 20, 48 << 20), (300, 700)])
def test_phrases_against_brute_force(spark, shard, task):
    rng = random.Random(2)
    common = words(9, 1)
    rows = [(k, ". ".join(" ".join(rng.choice(common) for _ in range(rng.randint(1, 9))) for _ in range(9)) + " New York City Hall", ["en", "de", None][k % 3], "s", 0) for k in range(150)]
    docs = documents(spark).unionByName(documents(spark, rows)).repartition(7)
    for least, top in ((5, 2000), (12, 7)):
        got = sorted(map(tuple, phrases.collocations(docs, least, top, shard_bytes=shard, task_bytes=task).collect()))
        assert got == brute([(r.lang, r.text) for r in docs.collect()], least, top) and len(got) > 10


def test_tables_without_phrases(spark):
    assert phrases.collocations(empty(spark)).count() == 0
    assert phrases.collocations(texts(spark, [(1, "a b c"), (2, None), (3, "")])).count() == 0
    assert phrases.collocations(texts(spark, [(k, "one. two. three") for k in range(40)])).count() == 0


def test_the_query_equals_its_sql(spark):
    got = sorted(map(tuple, queries.op12_phrase_index(spark, "/root/testdata/sf0.001").collect()))
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    assert got == sorted(con.execute("SELECT lang, rank, phrase, a, l, r, n, score FROM (" + queries.OP12_SQL + ")").fetchall()) and len(got) >= 50


@given(st.integers(1, 4).flatmap(lambda k: st.lists(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=k, max_size=k), max_size=30).map(lambda rows: (k, rows))))
def test_squeezed_columns_come_back(case):
    k, rows = case
    columns = [np.array([r[c] for r in rows], dtype=np.int64) for c in range(k)]
    assert [x.tolist() for x in phrases.spread(phrases.squeezed(*columns), k)] == [x.tolist() for x in columns]
