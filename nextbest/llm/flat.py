"""Token counts from flat token files without an index.

``write_flat`` writes the ids of documents one after the other as
little-endian unsigned 16-bit numbers, each document followed by a separator
id; nothing else is in the files.  Each task writes the documents that it reads
to a file of its own, so nothing is shuffled; what comes back are the names of
the documents in the order of each file.  A file whose task failed is not named there.

``scan`` finds the documents again: it reads the files in blocks of fixed size,
searches each block for the separator with one vectorised comparison, and
stitches documents that cross blocks with a prefix scan over the blocks'
summaries (separators so far, last separator so far).  The scan has two levels,
so that no task takes the summaries of a whole large file.

Files are written, and read as byte ranges, by ``pyarrow.fs``, which knows local,
s3, gs and hdfs paths; the file sizes come from Spark's listing.

Defined results: an empty document counts 0 tokens; ids after the last
separator form a document with ``terminated`` false; an empty file has none.
Null texts count as empty; only the id and the text are read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nextbest.llm.bpe import encoder
from nextbest.llm.common import id_and_text, slices, texts_of, written

BLOCK_TOKENS = 1 << 20
_SLICE = 4 << 20
_GROUP = 1024


def uri_of(path: str) -> str:
    """A path with a scheme; Hadoop writes local ones with one slash."""
    return re.sub("^file:/+", "file:///", path) if ":" in path else f"file://{path}"


def _flat(path: str, separator: int, target: str):
    end = np.array([separator], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        enc = encoder(path, specials_as_text=True)
        # each attempt has a file of its own
        uri = f"{target}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bin"
        store, place = fs.FileSystem.from_uri(uri)
        out, ordinal = None, 0
        for whole in batches:
            for batch in slices(whole, "text", _SLICE):
                out = out or store.open_output_stream(place)
                for ids in enc.encode_all(texts_of(batch.column("text"))):
                    ids = np.frombuffer(ids, dtype="<u4")
                    if (ids >= 1 << 16).any() or (ids == separator).any():
                        raise ValueError("ids must fit 16 bits and differ from the separator")
                    out.write(ids.astype("<u2").tobytes() + end)
                numbers = np.arange(ordinal, ordinal + batch.num_rows)
                ordinal += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([uri] * batch.num_rows, pa.string()), pa.array(numbers, pa.int64())],
                                                 names=["doc_id", "uri", "ordinal"])
        if out:
            out.close()
    return run


def write_flat(docs: DataFrame, target: str, path: str, separator: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write flat files below ``target``, a folder that all executors share; (doc_id, uri, ordinal) of what they hold."""
    from pyarrow import fs

    target = uri_of(target)
    store, place = fs.FileSystem.from_uri(target)
    store.create_dir(place, recursive=True)
    return written(id_and_text(docs, id_col, text_col).mapInArrow(_flat(path, separator, target), "doc_id long, uri string, ordinal long"), "flat-names")


def _blocks(separator: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["uri"])
                start = row["block"] * block_tokens
                with store.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(min(2 * block_tokens, row["bytes"] - 2 * start), 2 * start), dtype="<u2")
                stops = np.flatnonzero(ids == separator) + start
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["uri"]]), pa.array([row["block"]], pa.int64()), pa.array([row["bytes"] // 2], pa.int64()), pa.array([stops], pa.list_(pa.int64()))],
                    names=["uri", "block", "tokens", "stops"])
    return run


def scan(spark: SparkSession, source: str, separator: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(uri, ordinal, start, n_tokens, terminated): the documents of each flat file, in order, without their separators."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    sized = listed.select(F.regexp_replace("path", "^file:/+", "file:///").alias("uri"), F.col("length").alias("bytes")).where("bytes > 1")
    last = F.floor((F.col("bytes") / 2 - 1) / block_tokens).cast("long")
    tasks = sized.select("uri", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    n = max(1, spark.sparkContext.defaultParallelism * 4)
    blocks = written(tasks.repartition(n, "uri", "block").mapInArrow(_blocks(separator, block_tokens), "uri string, block long, tokens long, stops array<long>"), "flat-blocks")

    ends = blocks.select("uri", "block", F.size("stops").cast("long").alias("n"), F.array_max("stops").alias("stop"))
    ends = ends.withColumn("grp", F.floor(F.col("block") / _GROUP))
    inner = Window.partitionBy("uri", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("uri").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = ends.groupBy("uri", "grp").agg(F.sum("n").alias("n"), F.max("stop").alias("stop"))
    groups = groups.select("uri", "grp", F.sum("n").over(outer).alias("n0"), F.max("stop").over(outer).alias("stop0"))
    before = ends.select("uri", "block", "grp", F.sum("n").over(inner).alias("n1"), F.max("stop").over(inner).alias("stop1")).join(groups, ["uri", "grp"])
    before = before.select("uri", "block", (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("base"),
                           F.coalesce("stop1", "stop0", F.lit(-1).cast("long")).alias("before"))

    joined = blocks.join(before, ["uri", "block"])
    found = joined.select("uri", "base", "before", "stops", F.posexplode("stops").alias("k", "stop")).select(
        "uri", (F.col("base") + F.col("k")).alias("ordinal"),
        (F.when(F.col("k") > 0, F.element_at("stops", F.greatest("k", F.lit(1)))).otherwise(F.col("before")) + 1).alias("start"), "stop")
    found = found.select("uri", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(True).alias("terminated"))
    tail = blocks.groupBy("uri").agg(F.sum(F.size("stops")).alias("ordinal"), F.max(F.array_max("stops")).alias("stop"), F.max("tokens").alias("tokens"))
    tail = tail.select("uri", "ordinal", (F.coalesce("stop", F.lit(-1).cast("long")) + 1).alias("start"), "tokens").where("start < tokens")
    return found.unionByName(tail.select("uri", "ordinal", "start", (F.col("tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated")))


def named(found: DataFrame, names: DataFrame) -> DataFrame:
    """Documents found by ``scan`` with the ids that ``write_flat`` gave them."""
    return found.join(names, ["uri", "ordinal"])
