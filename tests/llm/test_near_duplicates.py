"""MinHash lists and vectors against brute force over all pairs."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from helpers import documents, empty, texts, words

from nextbest.llm import common, minhash, shingles, vectors

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, groups(ids, linked)


def edited(rng, base, share):
    return " ".join(w + "x" + str(rng.randrange(10**6)) if rng.random() < share else w for w in base)


@pytest.mark.parametrize("blocks", [1024, 7])
def test_hot_groups_against_brute_force(spark, monkeypatch, blocks):
    """A group of near copies of which some reach no other, passages that many share, exact copies."""
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", blocks)
    rng = random.Random(3)
    base, passage = words(120, 1), words(60, 2)
    rows = [(i, edited(rng, base, rng.choice([0, 0.01, 0.02, 0.04, 0.06, 0.1]))) for i in range(90)]
    rows += [(200 + i, " ".join(passage + words(rng.randint(10, 80), 1000 + i))) for i in range(40)]
    rows += [(300 + i, " ".join(base)) for i in range(20)] + [(400 + i, " ".join(words(80, 5000 + i))) for i in range(30)]
    rng.shuffle(rows)
    sets, want = brute(rows)
    got = minhash.near_duplicates(texts(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len(got) == len(rows) and len(set(want.values())) > 30


def test_odd_documents(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets, want = brute([r for r in rows if r[0] is not None])
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_shingle_hashes_tell_sets_apart():
    rng = random.Random(1)
    some = [" ".join(rng.choice(["a", "b", "C", "dd", "é"]) for _ in range(rng.randint(0, 40))).encode() for _ in range(300)]
    for text, hashes in zip(some, shingles.shingle_sets(some), strict=True):
        assert len(hashes) == len(shingle_set(text.decode()))


def test_signature_threshold_misses_hardly_any():
    """The chance that two sets at the threshold agree in fewer coordinates than are asked for."""
    n, k = minhash.COORDINATES, minhash.MATCHES
    assert sum(math.comb(n, i) * 0.75**i * 0.25 ** (n - i) for i in range(k)) < 1e-5


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 501), (501, 500), (7, 7)]
    rng.shuffle(links)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 500: 500, 501: 500}


def vector_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("tile", [4096, 16])
def test_vectors_against_brute_force(spark, tile):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 24))
    x = np.concatenate([c + rng.normal(size=(n, 24)) * s for c, n, s in zip(centres, (60, 20, 10, 5, 30, 1), (0.15, 0.25, 0.02, 0.3, 0.2, 0), strict=True)])
    x = np.concatenate([x, np.repeat(x[:1], 25, axis=0), x[1:3] * 7.5]).astype(np.float32)
    ids = rng.permutation(len(x)).tolist()
    rows = [(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)]
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    want = groups(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    got = vectors.near_vectors(vector_frame(spark, rows), 0.95, tile=tile).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {
        ids[k]: (int(near[k].sum()) - 1, want[ids[k]], want[ids[k]] == ids[k]) for k in range(len(ids))}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], None), (3, None, 0), (4, [], 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0),
            (8, [None, 1.0], 0), (9, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (10, [-0.0, 1.0], 0), (11, [0.0, 1.0], 0), (1, [1.0, 0.0], 0)]
    frame = vector_frame(spark, rows).selectExpr("*", "'x' AS tile", "'y' AS rep", "1 AS n_links")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(frame, 0.95).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)]
    assert got == sorted([(0, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), *alone, (10, 1, 10, True), (11, 1, 10, False)], key=lambda r: r[0])
    assert vectors.near_vectors(vector_frame(spark, []), 0.95).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(5)
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(200, 48)), rng.normal(size=(150, 48))))
    qa, sa, ea = vectors.quantised(a)
    qb, sb, eb = vectors.quantised(b)
    about = (qa.astype(float) @ qb.T.astype(float)) * sa[:, None] * sb[None, :]
    bound = np.linalg.norm(qa * sa[:, None], axis=1)[:, None] * eb[None, :] + ea[:, None]
    assert (np.abs(a @ b.T - about) <= bound + 1e-12).all()
    found = {(i, j) for i, j in zip(*map(np.concatenate, zip(*vectors.tile_links(a, b, 0.3, False), strict=True)), strict=True)}
    assert found == set(zip(*np.nonzero(a @ b.T >= 0.3), strict=True))
