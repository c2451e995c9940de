"""Sharding and the pipeline on small tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
from helpers import documents, empty, texts, words

import corpus_pipeline
from nextbest.llm import shard


def check_shards(rows, docs, shards):
    by_text = sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows)
    assert by_text == sorted((r.doc_id or -1, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    for s in {r.shard for r in rows}:
        assert 0 <= s < shards
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_odd_documents(spark):
    docs = documents(spark)
    check_shards(shard.balanced(docs, 4).collect(), docs, 4)
    assert shard.balanced(empty(spark), 4).count() == 0


def test_balance_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(words(rng.randint(5, 200), i))) for i in range(2400)] + [(5000 + i, "one text of a third of all rows") for i in range(1200)]
    rows += [(9000 + i, "a small group of copies") for i in range(9)]
    docs = texts(spark, rows)
    got = shard.balanced(docs, 8).collect()
    check_shards(got, docs, 8)
    size = np.bincount([r.shard for r in got], [r.size for r in got])
    assert size.max() / size.min() < 1.01
    homes = {}
    for r in got:
        homes.setdefault(r.text_crc32, set()).add(r.shard)
    hot = zlib.crc32(b"one text of a third of all rows")
    assert len(homes[hot]) > 1 and all(len(h) == 1 for c, h in homes.items() if c != hot)


def test_place_prefers_the_largest_dot_product():
    units = np.array([[10.0, 1, 1], [9, 9, 1], [8, 1, 9], [1, 1, 1]])
    at = shard.place(units, 2)
    assert at[0] != at[1] and sorted(np.bincount(at)) == [2, 2]


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        w = words(rng.randint(30, 80), i)
        bad, toxic = i % 6 == 0, i % 6 == 1
        if toxic:
            for _ in range(len(w) // 10):
                w.insert(rng.randrange(len(w)), rng.choice(["moronic", "scumbag", "worthless"]))
        if bad:
            w = [x + "##" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000 + k, rows[2][1] + " extra") for k in range(5)] + [(2000, None), (2001, "")]
    rows[3] = (3, rows[3][1] + ' token = "0123456789abcdef0123456789abcdef01234567"')
    texts(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == columns
    clean = {i for i in range(240) if i % 6 > 1}
    assert clean <= kept["quality_rules"] and not {i for i in range(0, 240, 6)} & kept["quality_rules"] and not {2000, 2001} & kept["quality_rules"]
    assert len(clean - kept["toxicity"]) <= 2 and len({i for i in range(1, 240, 6)} & kept["toxicity"]) <= 4
    assert not {1000, 1001, 1002, 1003, 1004} & kept["near_duplicates"] and 2 in kept["near_duplicates"]
    assert kept["secrets"] == kept["near_duplicates"] == kept["packing"]
    text = spark.read.parquet(f"{tmp_path}/secrets").where("doc_id = 3").first()
    assert "0123456789abcdef" not in text.text and text.n_chars == len(text.text)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_different_texts_of_one_id_all_stay(spark):
    one, two, three = (" ".join(words(40, k)) for k in (1, 2, 3))
    rows = [(1, one, "en", "b", 5), (1, one, "en", "a", 9), (1, two, "de", "c", 7), (2, three, None, None, None), (2, three, None, None, None), (3, one, "en", "a", 1), (None, "", "en", "x", 0)]
    docs = documents(spark, rows, clashing=False)
    for parts in (1, 5):
        out = corpus_pipeline.near_duplicates(spark, docs.repartition(parts), "")
        assert out.columns == docs.columns
        want = [rows[1], rows[2], rows[3], rows[6]]
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
