"""Silver layer: typed, lower-cased, null-key filtered views over bronze.

Silver stays lazy (a view): Catalyst folds it into whatever gold plan reads
it, so the null-key filters and the column selection reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stamp() -> F.Column:
    """Processing timestamp (one value per query)."""
    return F.current_timestamp().alias("updated_at")


def silver_customers(bronze: DataFrame) -> DataFrame:
    """Strict INT casts (bad text is an error under ANSI), lower-cased codes."""
    return (bronze
            .where(F.col("customer_id").isNotNull())
            .select(
                "customer_id", "name",
                F.col("age").cast("int").alias("age"),
                "email", "city", "state",
                F.col("income").cast("int").alias("income"),
                F.col("credit_score").cast("int").alias("credit_score"),
                F.lower("employment_type").alias("employment_type"),
                F.lower("marital_status").alias("marital_status"),
                F.col("tenure_months").cast("int").alias("tenure_months"),
                F.lower("segment").alias("segment"),
                stamp()))


def silver_transactions(bronze: DataFrame) -> DataFrame:
    """Safe date and amount parsing: unparseable text becomes NULL."""
    return (bronze
            .where(F.col("transaction_id").isNotNull() & F.col("customer_id").isNotNull())
            .select(
                "transaction_id", "customer_id",
                F.try_to_date("date").alias("transaction_date"),
                F.lower("category").alias("category"),
                F.col("amount").try_cast("double").alias("amount"),
                "merchant",
                stamp()))


def silver_products_held(bronze: DataFrame) -> DataFrame:
    """Holdings with a customer; a NULL product id is kept."""
    return (bronze
            .where(F.col("customer_id").isNotNull())
            .select(
                "customer_id", "product_id",
                F.lower("product_name").alias("product_name"),
                F.try_to_date("opened_date").alias("opened_date"),
                stamp()))


def silver_product_catalog(bronze: DataFrame) -> DataFrame:
    return (bronze
            .where(F.col("product_id").isNotNull())
            .select(
                "product_id",
                F.lower("product_name").alias("product_name"),
                F.lower("category").alias("category"),
                F.col("min_credit_score").cast("int").alias("min_credit_score"),
                F.col("min_income").cast("int").alias("min_income"),
                F.lower("target_segment").alias("target_segment"),
                stamp()))


def without_stamp(df: DataFrame) -> DataFrame:
    """Drop the non-deterministic processing timestamp before comparing."""
    return df.drop("updated_at")
