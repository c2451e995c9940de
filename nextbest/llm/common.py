"""Helpers shared by the operators: Arrow text access, written tables, gapless numbering, components.

All intermediate tables go to the shared folder of ``spark.checkpoint.dir``
(see ``nextbest.session``), so a lost executor recomputes from files that
every executor can read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nextbest.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, under fixed names, so that
    further columns of the caller can neither clash nor travel along."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts exceed ``max_bytes`` (one longer text stays whole)."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def number_within(df: DataFrame, keys: list[str], order: list[str], sub: Column, out: str) -> DataFrame:
    """Gapless numbers from 0 for the rows of each key, without one task per key.

    ``sub`` deals the rows of a key into sub-groups; rows are numbered inside
    their sub-group, and the counts of the sub-groups before it are added.
    Rows equal in ``order`` get their numbers in any order.
    """
    dealt = df.withColumn("_sub", sub)
    counts = dealt.groupBy(*keys, "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*keys, "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys, "_sub").orderBy(*order)
    numbered = dealt.withColumn("_rn", F.row_number().over(inner).cast("long") - 1)
    return numbered.join(bases, [*keys, "_sub"]).withColumn(out, F.col("_rn") + F.col("_base")).drop("_sub", "_rn", "_base")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node reachable.

    Alternating large-star and small-star rounds; every round is written to
    the shared folder, and only two sums come back to the driver to see
    whether a round changed anything.
    """
    edges = links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, name)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m0")).select(
            F.col("u").alias("n"), F.least("u", "m0").alias("m"))
        large = both.join(least, both.u == least.n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        joined = large.join(down, large.u == down.n)
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            down.select(F.col("n").alias("u"), F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(now):
            break
        state = tuple(now)
    stars = edges.groupBy("u").agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("component"))
    return stars.unionByName(roots).select(F.col("u").alias("node"), "component")
