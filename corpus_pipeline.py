"""A training-data pipeline over ``documents``: each stage's rows are written as Parquet and read by the next.

quality rules -> toxicity -> near duplicates -> secrets -> packing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nextbest.llm import minhash, pack, quality, queries, secrets, toxicity
from nextbest.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject."""
    rules = quality.learn(quality.labelled_statistics(docs, queries.table(spark, sf_dir, "labels")))
    return quality.judged(quality.statistics(docs, keep_row=True), rules).where("kept").select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    return toxicity.clean(docs, toxicity.fit(docs, queries.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; of rows equal in id and text, the one with the smallest other columns.
    Different texts of one id all stay."""
    kept = minhash.near_duplicates(docs).where("kept").select("doc_id")
    rows = _those(docs, kept)
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    named = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("_"), *others)).alias("row"))
    named = named.select(*[c if c in ("doc_id", "text") else F.col("row").getField(c).alias(c) for c in docs.columns])
    return named.unionByName(rows.where("doc_id IS NULL"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows the text."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids and places in sequences."""
    return pack.packed(docs, queries.TOKENIZER)


def _those(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with an id among ``ids``; a null id counts as one."""
    return docs.join(ids.distinct(), docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")


STAGES = [("quality_rules", quality_rules), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("secrets", secret_spans), ("packing", packing)]

#: Learned rules and models, links and packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
