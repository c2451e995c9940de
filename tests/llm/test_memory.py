"""What a Python worker holds at once: batches by bytes, arrays of a slice, the rows to learn from."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from helpers import words

from nextbest.llm import bpe, minhash, pack, queries, toxicity


def most_mb(work) -> float:
    """MB that Python and numpy hold at most, beyond what they held before."""
    work()  # tables that are made once
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def batch(rows: int, each: int, seed: int = 1) -> pa.RecordBatch:
    texts = [" ".join(words(each, seed + i)) for i in range(rows)]
    return pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array(texts)], names=["doc_id", "text"])


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat(cast(id AS string), 2000) AS text").write.parquet(str(tmp_path / "documents.parquet"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"])

    docs = queries.table(spark, str(tmp_path), "documents")
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 1024
    got = [r.size for r in docs.mapInArrow(sizes, "size long").collect()]
    assert sum(got) > 16e6 and max(got) < 6e6


def test_signatures_of_a_large_batch_take_little():
    rows = batch(40, 10_000)
    assert rows.nbytes > 2e6

    def work():
        for _ in minhash._sign(5)(iter([rows])):
            pass

    assert most_mb(work) < 20


def test_packing_keeps_few_words():
    for _ in pack._cut(queries.TOKENIZER, 2048, 0, True)(iter([batch(2, 50)])):
        pass
    assert bpe.encoder(queries.TOKENIZER, entries=pack._WORDS).words.entries <= 200_000


def test_gathered_rows_make_the_bags_of_their_texts():
    rows = batch(30, 60).append_column("toxic", pa.array([i % 2 for i in range(30)], pa.int32()))
    parts = [out for at in range(0, 30, 7) for out in toxicity._bag(iter([rows.slice(at, 7)]))]
    table = pa.Table.from_batches(parts[::-1])  # in another order than the ids
    got, toxic = toxicity.gathered(table)
    want = toxicity.bags_of([t.encode() for t in rows.column("text").to_pylist()])
    assert got.n == want.n and toxic.tolist() == [i % 2 for i in range(30)]
    for one, other in zip(got.words + got.subwords, want.words + want.subwords, strict=True):
        assert np.array_equal(one, other)


def test_gathering_takes_little_beside_the_rows():
    rows = batch(60, 4000).append_column("toxic", pa.array([i % 2 for i in range(60)], pa.int32()))
    parts = list(toxicity._bag(iter([rows])))
    size = sum(p.nbytes for p in parts) / 1e6
    held = [pa.Table.from_batches(parts)]
    del parts
    assert most_mb(lambda: toxicity.gathered(held[0])) < 3.6 * size
