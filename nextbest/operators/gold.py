"""Gold layer: customer features, user-item matrix, segment product affinity.

Scale notes
-----------
* Transactions are pre-aggregated per customer before the join (partial
  aggregation map-side, so a customer holding a third of all rows costs one
  row per map task, not a hot reducer).  The join key equals the group key,
  so the aggregate's hash partitioning already satisfies the join.
* Holdings are reduced to distinct (customer, product) pairs before any join
  (``distinct_holdings``); a hot customer's duplicates are removed map-side.
* The affinity table has one row per (segment, product): its size is bounded
  by segments x products, not by customers; joins against it are left to the
  runtime size check of AQE (broadcast when small, sort-merge otherwise).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nextbest import constants as C
from nextbest.functions.scalars import flag_when, round_half_up, safe_ratio
from nextbest.operators.silver import stamp


#: Amounts are summed as whole ten-thousandths, their upper bits and lower 32 bits apart: exact, and neither sum can overflow.
_LOW = 32


def _money_sum(units: F.Column) -> F.Column:
    """Exact DECIMAL(28, 4) sum of amounts given as whole ten-thousandths."""
    high = F.sum(F.shiftright(units, _LOW)).cast("decimal(20,0)")
    low = F.sum(units.bitwiseAND(F.lit((1 << _LOW) - 1))).cast("decimal(20,0)")
    return ((high * F.lit(1 << _LOW).cast("decimal(10,0)") + low) * F.lit("0.0001").cast("decimal(4,4)")).cast("decimal(28,4)")


def transaction_stats(txn: DataFrame) -> DataFrame:
    """Per customer: count, sum, avg, max of amount and 8 category spends.

    Money is summed exactly as whole ten-thousandths (amounts count as
    DECIMAL(18, 4)): sums, mean and shares do not depend on the order in which
    partial sums meet, and no row makes a big decimal for each column."""
    units = F.col("units")
    rows = txn.select("customer_id", "category", (F.col("amount").cast("decimal(18,4)") * 10000).cast("long").alias("units"))
    spends = [
        _money_sum(F.when(F.col("category") == cat, units).otherwise(F.lit(0).cast("long"))).cast("double").alias(f"{cat}_spend")
        for cat in C.SPEND_CATEGORIES
    ]
    total, n = _money_sum(units), F.count("units").cast("decimal(20,0)")
    most = (F.max("units").cast("decimal(18,0)") * F.lit("0.0001").cast("decimal(4,4)")).cast("decimal(18,4)")
    return rows.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        total.cast("double").alias("total_spend"),
        (total / F.nullif(n, F.lit(0).cast("decimal(20,0)"))).cast("decimal(22,8)").alias("avg_transaction"),
        most.cast("double").alias("max_transaction"),
        *spends,
    )


def category_spend(txn: DataFrame) -> DataFrame:
    """Only the 8 conditional-sum spend columns (ELSE 0, never NULL-by-pivot)."""
    return transaction_stats(txn).select("customer_id", *[f"{c}_spend" for c in C.SPEND_CATEGORIES])


def distinct_holdings(held: DataFrame) -> DataFrame:
    """The different holdings: flags, matrix and affinity do not depend on how often one is listed."""
    return held.select("customer_id", "product_id", "product_name").distinct()


def product_flags(held: DataFrame) -> DataFrame:
    """Distinct product count and 8 ownership flags per customer."""
    name = F.col("product_name")
    flags = [
        F.max(flag_when(name == prod)).alias(flag)
        for prod, flag in zip(C.PRODUCT_NAMES, C.FLAG_COLUMNS)
    ]
    return held.groupBy("customer_id").agg(
        F.countDistinct("product_id").alias("num_products"), *flags)


def customer_features(cust: DataFrame, txn: DataFrame, held: DataFrame) -> DataFrame:
    """gold_customer_features: 30 columns, unmatched customers keep NULLs."""
    stats = transaction_stats(txn)
    flags = product_flags(held)
    total = F.col("t.total_spend")
    shares = [
        round_half_up(safe_ratio(F.col(f"t.{cat}_spend"), total), 3).alias(f"{cat}_pct")
        for cat in C.SPEND_CATEGORIES
    ]
    return (cust.alias("c")
            .join(stats.alias("t"), F.col("c.customer_id") == F.col("t.customer_id"), "left")
            .join(flags.alias("p"), F.col("c.customer_id") == F.col("p.customer_id"), "left")
            .select(
                F.col("c.customer_id"), "c.age", "c.income", "c.credit_score", "c.tenure_months",
                "c.segment", "c.employment_type", "c.marital_status",
                F.col("t.total_transactions"),
                round_half_up(total, 2).alias("total_spend"),
                round_half_up("t.avg_transaction", 2).cast("double").alias("avg_transaction"),
                round_half_up("t.max_transaction", 2).alias("max_transaction"),
                *shares,
                F.col("p.num_products"),
                *[F.col(f"p.{f}") for f in C.FLAG_COLUMNS],
                stamp()))


def user_item_matrix(cust: DataFrame, held: DataFrame) -> DataFrame:
    """gold_user_item_matrix: every distinct customer with 8 0/1 flags.

    Holdings are reduced to one flag row per customer first (partial
    aggregation map-side, one exchange on customer_id); the distinct
    customers are co-partitioned on the same key, so the left join adds no
    further shuffle.  Customers without holdings get 0 flags."""
    name = F.col("product_name")
    owned = (held.where(name.isin(C.PRODUCT_NAMES)).groupBy("customer_id")
             .agg(*[F.max(flag_when(name == prod)).alias(prod) for prod in C.PRODUCT_NAMES]))
    return (cust.select("customer_id").distinct()
            .join(owned, "customer_id", "left")
            .select("customer_id", *[F.coalesce(F.col(p), F.lit(0)).alias(p) for p in C.PRODUCT_NAMES]))


def customer_segments(cust: DataFrame) -> DataFrame:
    """Distinct (customer, segment) pairs."""
    return cust.select("customer_id", "segment").distinct()


def customer_products(cust: DataFrame, held: DataFrame) -> DataFrame:
    """customers LEFT JOIN holdings, keeping rows with a product name.

    Written as the inner join it reduces to (the not-null product filter
    removes every unmatched row), on distinct pairs from both sides.
    """
    pairs = held.where(F.col("product_name").isNotNull()).select("customer_id", "product_name").distinct()
    return customer_segments(cust).join(pairs, "customer_id", "inner")


def segment_totals(cust: DataFrame) -> DataFrame:
    """Distinct customers per segment."""
    return (customer_segments(cust).groupBy("segment")
            .agg(F.count(F.lit(1)).alias("total_customers")))


def segment_product_counts(cust: DataFrame, held: DataFrame) -> DataFrame:
    """Distinct adopting customers per (segment, product)."""
    return (customer_products(cust, held)
            .groupBy("segment", "product_name")
            .agg(F.count(F.lit(1)).alias("customers_with_product")))


def product_affinity(cust: DataFrame, held: DataFrame) -> DataFrame:
    """gold_product_affinity: conversion rate (3 dp) and RANK within segment
    by adopters (gaps on ties); ordered by segment, rate desc."""
    counts = segment_product_counts(cust, held)
    totals = segment_totals(cust)
    w = Window.partitionBy("segment").orderBy(F.col("customers_with_product").desc())
    return (counts.join(totals, "segment", "inner")
            .select(
                "segment", "product_name", "customers_with_product", "total_customers",
                round_half_up(F.col("customers_with_product") / F.col("total_customers"), 3).alias("conversion_rate"),
                F.rank().over(w).alias("rank_within_segment"),
                stamp()))
