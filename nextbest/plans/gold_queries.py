"""Registered silver and gold queries (P*, A1-A7, J1-J4, W1, F3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nextbest import constants as C
from nextbest.operators import gold
from nextbest.operators.silver import without_stamp
from nextbest.plans.oracles import with_prelude
from nextbest.plans.registry import query


@query("silver_customers", with_prelude(select="SELECT * FROM silver_customers"))
def q_silver_customers(m):
    return without_stamp(m.silver_customers)


@query("silver_transactions", with_prelude(select="SELECT * FROM silver_transactions"))
def q_silver_transactions(m):
    return without_stamp(m.silver_transactions)


@query("silver_products_held", with_prelude(select="SELECT * FROM silver_products_held"))
def q_silver_products_held(m):
    return without_stamp(m.silver_products_held)


@query("safe_cast_dirty", with_prelude(select="""
SELECT b.transaction_id, b.date AS raw_date, b.amount AS raw_amount,
       TRY_CAST(b.date AS DATE) AS transaction_date, TRY_CAST(b.amount AS DOUBLE) AS amount
FROM bronze_transactions b
WHERE b.transaction_id IS NOT NULL AND b.customer_id IS NOT NULL
  AND (TRY_CAST(b.date AS DATE) IS NULL OR TRY_CAST(b.amount AS DOUBLE) IS NULL)"""))
def q_safe_cast_dirty(m):
    """Rows whose date or amount text did not parse: the safe casts give NULL."""
    b = m.bronze["transactions"]
    return (b.where(F.col("transaction_id").isNotNull() & F.col("customer_id").isNotNull())
            .select("transaction_id", F.col("date").alias("raw_date"), F.col("amount").alias("raw_amount"),
                    F.try_to_date("date").alias("transaction_date"),
                    F.col("amount").try_cast("double").alias("amount"))
            .where(F.col("transaction_date").isNull() | F.col("amount").isNull()))


@query("transaction_stats", with_prelude(select="""
SELECT customer_id, CAST(total_transactions AS BIGINT) AS total_transactions,
       ROUND(total_spend, 2) AS total_spend, ROUND(avg_transaction, 2) AS avg_transaction,
       ROUND(max_transaction, 2) AS max_transaction
FROM o_transaction_stats"""))
def q_transaction_stats(m):
    s = gold.transaction_stats(m.silver_transactions)
    return s.select("customer_id", "total_transactions",
                    F.round("total_spend", 2).alias("total_spend"),
                    F.round("avg_transaction", 2).cast("double").alias("avg_transaction"),
                    F.round("max_transaction", 2).alias("max_transaction"))


@query("category_spend", with_prelude(select="SELECT customer_id, "
       + ", ".join(f"ROUND({c}_spend, 2) AS {c}_spend" for c in C.SPEND_CATEGORIES)
       + " FROM o_transaction_stats"))
def q_category_spend(m):
    s = gold.category_spend(m.silver_transactions)
    return s.select("customer_id", *[F.round(f"{c}_spend", 2).alias(f"{c}_spend") for c in C.SPEND_CATEGORIES])


@query("product_flags", with_prelude(select="SELECT customer_id, CAST(num_products AS BIGINT) AS num_products, "
       + ", ".join(f"CAST({f} AS INTEGER) AS {f}" for f in C.FLAG_COLUMNS) + " FROM o_product_flags"))
def q_product_flags(m):
    return gold.product_flags(m.silver_products_held)


@query("spend_shares", with_prelude(select="SELECT customer_id, "
       + ", ".join(f"{c}_pct" for c in C.SPEND_CATEGORIES) + " FROM gold_customer_features"))
def q_spend_shares(m):
    """Guarded ratios: zero or missing totals give NULL shares, never an error."""
    return m.gold_customer_features.select("customer_id", *C.SHARE_COLUMNS)


_FEATURE_COLS = (["customer_id", "age", "income", "credit_score", "tenure_months", "segment", "employment_type",
                  "marital_status", "total_transactions", "total_spend", "avg_transaction", "max_transaction"]
                 + C.SHARE_COLUMNS + ["num_products"] + C.FLAG_COLUMNS)


@query("gold_customer_features", with_prelude(select="SELECT "
       + ", ".join(
           f"CAST({c} AS BIGINT) AS {c}" if c in ("total_transactions", "num_products")
           else f"CAST({c} AS INTEGER) AS {c}" if c in C.FLAG_COLUMNS else c
           for c in _FEATURE_COLS)
       + " FROM gold_customer_features"))
def q_gold_customer_features(m):
    return without_stamp(m.gold_customer_features)


@query("gold_user_item_matrix", with_prelude(select="SELECT customer_id, "
       + ", ".join(f"CAST({p} AS INTEGER) AS {p}" for p in C.PRODUCT_NAMES)
       + " FROM gold_user_item_matrix ORDER BY customer_id"))
def q_gold_user_item_matrix(m):
    return m.gold_user_item_matrix.orderBy("customer_id")


@query("customer_products", with_prelude(select="""
SELECT DISTINCT customer_id, segment, product_name FROM o_customer_products WHERE product_name IS NOT NULL"""))
def q_customer_products(m):
    return gold.customer_products(m.silver_customers, m.silver_products_held)


@query("segment_totals", with_prelude(select="""
SELECT segment, CAST(total_customers AS BIGINT) AS total_customers FROM o_segment_totals"""))
def q_segment_totals(m):
    return gold.segment_totals(m.silver_customers)


@query("segment_product_counts", with_prelude(select="""
SELECT segment, product_name, CAST(customers_with_product AS BIGINT) AS customers_with_product
FROM o_segment_product_counts"""))
def q_segment_product_counts(m):
    return gold.segment_product_counts(m.silver_customers, m.silver_products_held)


@query("gold_product_affinity", with_prelude(select="""
SELECT segment, product_name, CAST(customers_with_product AS BIGINT) AS customers_with_product,
       CAST(total_customers AS BIGINT) AS total_customers, conversion_rate,
       CAST(rank_within_segment AS INTEGER) AS rank_within_segment
FROM gold_product_affinity ORDER BY segment, conversion_rate DESC"""))
def q_gold_product_affinity(m):
    return without_stamp(m.gold_product_affinity).orderBy(F.col("segment"), F.col("conversion_rate").desc())
