"""Literal dimension tables (catalog, product profiles, product labels).

Each has a fixed, tiny row count (8 rows), so broadcasting them is always
safe; they are built with ``createDataFrame`` and joined with ``broadcast``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nextbest import constants as C

CATALOG_SCHEMA = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("min_credit_score", T.StringType()),
    T.StructField("min_income", T.StringType()),
    T.StructField("target_segment", T.StringType()),
])


def bronze_product_catalog(spark: SparkSession) -> DataFrame:
    """The 8-row catalog as raw text columns, like a CSV load would give."""
    rows = [(pid, name, cat, str(cs), str(inc), seg) for pid, name, cat, cs, inc, seg in C.CATALOG_ROWS]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def product_norm(name: str) -> float:
    return math.sqrt(sum(w * w for w in C.PRODUCT_PROFILES[name]))


def product_profiles(spark: SparkSession) -> DataFrame:
    """Product x spend-category weights, long form, with the product ordinal."""
    rows = []
    for ordinal, name in enumerate(C.PRODUCT_NAMES):
        for cat_ord, (cat, w) in enumerate(zip(C.SPEND_CATEGORIES, C.PRODUCT_PROFILES[name])):
            rows.append((ordinal, name, cat_ord, cat, float(w)))
    schema = "product_ordinal INT, product_name STRING, category_ordinal INT, category STRING, weight DOUBLE"
    return spark.createDataFrame(rows, schema)


def product_labels(spark: SparkSession) -> DataFrame:
    """product_id, product_name, flag column, emoji, display name, ordinal."""
    rows = [
        (i, pid, name, flag, C.PRODUCT_EMOJIS[name], name.replace("_", " ").title())
        for i, (pid, name, flag) in enumerate(zip(C.PRODUCT_IDS, C.PRODUCT_NAMES, C.FLAG_COLUMNS))
    ]
    schema = "product_ordinal INT, product_id STRING, product_name STRING, flag_column STRING, emoji STRING, display_name STRING"
    return spark.createDataFrame(rows, schema)


def product_index(spark: SparkSession) -> DataFrame:
    """Dense item ids 0..7 in declaration order (collaborative-filtering items)."""
    return spark.createDataFrame(list(enumerate(C.PRODUCT_NAMES)), "item_id INT, product_name STRING")


def small(df: DataFrame) -> DataFrame:
    """Mark a literal (fixed 8-row) dimension for broadcast."""
    return F.broadcast(df)
