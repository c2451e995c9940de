"""Sinks and materialisation.

Written tables go to the shared folder named by ``spark.checkpoint.dir`` (see
``nextbest.session``); a written table is also how long lineages are cut, so
a lost executor only recomputes from the last written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextbest.session import scratch_path
from nextbest.sources.published import PublishedTable


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header line, no index column, replacing what was there; quotes
    inside a field are doubled, and fields with line breaks are quoted."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def materialize(df: DataFrame, name: str, kind: str = "view", path: str | None = None) -> DataFrame:
    """``view``: a lazy named view.  ``table``: rebuilt as parquet and read back."""
    spark = df.sparkSession
    if kind == "view":
        df.createOrReplaceTempView(name)
        return spark.table(name)
    if kind != "table":
        raise ValueError(f"unknown materialisation {kind!r}")
    target = path or scratch_path(spark, name)
    write_parquet(df, target)
    out = spark.read.parquet(target)
    out.createOrReplaceTempView(name)
    return out


def lower_columns(df: DataFrame) -> DataFrame:
    """Column names to lower case (tables read back from an upper-case store)."""
    return df.toDF(*[c.lower() for c in df.columns])


def upper_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


# Published layout of the final recommendations: fixed order and types.
HYBRID_COLUMNS = [
    ("customer_id", "string"),
    ("product_name", "string"),
    ("als_score_norm", "double"),
    ("cb_score_norm", "double"),
    ("segment", "string"),
    ("affinity_score", "double"),
    ("affinity_score_norm", "double"),
    ("hybrid_score", "double"),
]


def publish_layout(recs: DataFrame) -> DataFrame:
    """Drop helper columns, fix order/types, upper-case the column names."""
    return upper_columns(recs.select(*[F.col(c).cast(t).alias(c) for c, t in HYBRID_COLUMNS]))


def publish_hybrid(recs: DataFrame, path: str | None = None) -> DataFrame:
    """CREATE OR REPLACE the published table with the final recs: readers see the rows before or all new ones."""
    spark = recs.sparkSession
    return PublishedTable(spark, path or scratch_path(spark, "hybrid_recommendations")).replace(publish_layout(recs))
