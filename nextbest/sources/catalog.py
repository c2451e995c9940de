"""Source readers: bronze CSV scans, table scans, the bronze source catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from nextbest.sources import bindings, dims, splitcsv

# Explicit bronze schemas: raw text columns, no inference (inference is a full
# extra pass over the files and guesses types per file).
_TEXT = T.StringType()
BRONZE_SCHEMAS = {
    "customers": T.StructType([T.StructField(c, _TEXT) for c in (
        "customer_id", "name", "age", "email", "city", "state", "income", "credit_score",
        "employment_type", "marital_status", "tenure_months", "segment")]),
    "transactions": T.StructType([T.StructField(c, _TEXT) for c in (
        "transaction_id", "customer_id", "date", "category", "amount", "merchant")]),
    "products_held": T.StructType([T.StructField(c, _TEXT) for c in (
        "customer_id", "product_id", "product_name", "opened_date")]),
    "product_catalog": dims.CATALOG_SCHEMA,
}

BRONZE_TABLES = ("customers", "transactions", "products_held", "product_catalog")


def read_bronze_csv(spark: SparkSession, directory: str, table: str, bad_rows: str = "FAILFAST") -> DataFrame:
    """CSV scan with a header line and the declared bronze schema: a file
    ``<table>.csv`` or a folder ``<table>`` of files.

    Fields may be quoted, hold doubled quotes, separators and line breaks; files are read in splits (``splitcsv``).
    Rows that do not fit the schema are errors; ``bad_rows="PERMISSIVE"`` keeps
    them, with the text of the row in ``_corrupt_record``."""
    base = f"{directory.rstrip('/')}/{table}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}.csv")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    schema = BRONZE_SCHEMAS[table]
    if bad_rows == "PERMISSIVE":
        schema = T.StructType([*schema.fields, T.StructField("_corrupt_record", _TEXT)])
    return splitcsv.read_csv(spark, f"{base}.csv" if store.exists(path) else base, schema, bad_rows)


def read_table(spark: SparkSession, table: str, fmt: str = "parquet") -> DataFrame:
    """``SELECT * FROM SCHEMA.TABLE`` of a declared table (``published.declare``), or the table at a path: a lazy scan;
    Catalyst prunes columns later."""
    return spark.read.format(fmt).load(table) if "/" in table else spark.table(table)


def bronze_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The declared bronze source catalog, bound to the driver tables."""
    return {
        "customers": bindings.bind(spark, sf_dir, "bronze_customers"),
        "transactions": bindings.bind(spark, sf_dir, "bronze_transactions"),
        "products_held": bindings.bind(spark, sf_dir, "bronze_products_held"),
        "product_catalog": dims.bronze_product_catalog(spark),
    }


def register(frames: dict[str, DataFrame], prefix: str = "bronze_") -> None:
    """Name each source: one temp view per declared source."""
    for name, df in frames.items():
        df.createOrReplaceTempView(f"{prefix}{name}")


def register_bronze(spark: SparkSession, sf_dir: str, prefix: str = "bronze_") -> dict[str, DataFrame]:
    """Resolve bronze tables by name: one temp view per declared source."""
    frames = bronze_frames(spark, sf_dir)
    register(frames, prefix)
    return frames
