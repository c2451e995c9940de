"""Registered insight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from nextbest.operators import insights as I
from nextbest.plans.oracles import with_prelude
from nextbest.plans.registry import query
from nextbest.plans.signal_queries import sig


def _value_counts_sql(table: str, col: str) -> str:
    return with_prelude(select=f"""
SELECT {col}, CAST(COUNT(*) AS BIGINT) AS count FROM {table} WHERE {col} IS NOT NULL
GROUP BY {col} ORDER BY count DESC, {col}""")


@query("segment_distribution", _value_counts_sql("silver_customers", "segment"))
def q_segment_distribution(m):
    return I.value_counts(m.silver_customers, "segment")


@query("category_counts", _value_counts_sql("silver_transactions", "category"))
def q_category_counts(m):
    return I.value_counts(m.silver_transactions, "category")


@query("product_ownership_counts", _value_counts_sql("silver_products_held", "product_name"))
def q_product_ownership_counts(m):
    return I.value_counts(m.silver_products_held, "product_name")


# exact half-up mean of two-decimal amounts, in integer arithmetic
_AVG4 = ("CAST((200 * SUM(CAST(ROUND(amount * 100) AS HUGEINT)) + COUNT(amount)) // (2 * COUNT(amount)) AS DOUBLE)"
         " / 10000")


@query("avg_amount_by_category", with_prelude(select=f"""
SELECT category, {_AVG4} AS avg_amount FROM silver_transactions WHERE category IS NOT NULL
GROUP BY category ORDER BY avg_amount DESC, category"""))
def q_avg_amount_by_category(m):
    """Mean amount per category (exact decimal mean, 4 dp)."""
    txn = m.silver_transactions.withColumn("amount", F.col("amount").cast("decimal(38,10)"))
    out = I.avg_amount_by_category(txn)
    return out.select("category", F.round("avg_amount", 4).cast("double").alias("avg_amount"))


_PPC = "SELECT customer_id, COUNT(product_id) AS num_products FROM silver_products_held " \
       "WHERE customer_id IS NOT NULL GROUP BY customer_id"


@query("products_per_customer", with_prelude(select=f"""
SELECT customer_id, CAST(num_products AS BIGINT) AS num_products FROM ({_PPC}) t"""))
def q_products_per_customer(m):
    return I.products_per_customer(m.silver_products_held)


@query("products_per_customer_stats", with_prelude(select=f"""
SELECT CAST((200 * SUM(num_products) + COUNT(*)) // (2 * COUNT(*)) AS DOUBLE) / 100 AS avg_products,
       CAST(MAX(num_products) AS BIGINT) AS max_products, CAST(MIN(num_products) AS BIGINT) AS min_products
FROM ({_PPC}) t"""))
def q_products_per_customer_stats(m):
    return I.products_per_customer_stats(m.silver_products_held)


@query("products_histogram", with_prelude(select=f"""
WITH p AS ({_PPC}),
s AS (SELECT CASE WHEN MIN(num_products) = MAX(num_products) THEN CAST(MIN(num_products) AS DOUBLE) - 0.5
                  ELSE CAST(MIN(num_products) AS DOUBLE) END AS lo,
             CASE WHEN MIN(num_products) = MAX(num_products) THEN CAST(MAX(num_products) AS DOUBLE) + 0.5
                  ELSE CAST(MAX(num_products) AS DOUBLE) END AS hi FROM p),
b AS (SELECT CAST(LEAST(FLOOR((CAST(num_products AS DOUBLE) - lo) / (hi - lo) * 8), 7) AS INTEGER) AS bin,
             COUNT(*) AS cnt FROM p CROSS JOIN s GROUP BY 1)
SELECT g.bin, s.lo + g.bin * ((s.hi - s.lo) / 8) AS bin_start, s.lo + (g.bin + 1) * ((s.hi - s.lo) / 8) AS bin_end,
       CAST(COALESCE(b.cnt, 0) AS BIGINT) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(0, 8)) g CROSS JOIN s LEFT JOIN b ON b.bin = g.bin
ORDER BY g.bin"""))
def q_products_histogram(m):
    return I.histogram(m.products_distribution, "num_products", 8)


@query("age_box_by_segment", with_prelude(select="""
WITH q AS (SELECT segment, quantile_cont(CAST(age AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(age AS DOUBLE), 0.5) AS median,
                  quantile_cont(CAST(age AS DOUBLE), 0.75) AS q3
           FROM silver_customers WHERE age IS NOT NULL GROUP BY segment),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.segment, f.q1, f.median, f.q3,
       MIN(CASE WHEN c.age >= f.lo AND c.age <= f.hi THEN CAST(c.age AS DOUBLE) END) AS whisker_low,
       MAX(CASE WHEN c.age >= f.lo AND c.age <= f.hi THEN CAST(c.age AS DOUBLE) END) AS whisker_high,
       CAST(SUM(CASE WHEN c.age >= f.lo AND c.age <= f.hi THEN 0 ELSE 1 END) AS BIGINT) AS outliers
FROM silver_customers c JOIN f ON c.segment = f.segment WHERE c.age IS NOT NULL
GROUP BY f.segment, f.q1, f.median, f.q3 ORDER BY f.segment"""))
def q_age_box_by_segment(m):
    return I.box_of(m.age_distribution, "age", "segment")


_MISSING_SQL = """
SELECT h.customer_id, k.product_id
FROM (SELECT DISTINCT customer_id FROM silver_products_held WHERE customer_id IS NOT NULL) h
CROSS JOIN bronze_product_catalog k
WHERE NOT EXISTS (SELECT 1 FROM silver_products_held p WHERE p.customer_id = h.customer_id AND p.product_id = k.product_id)"""


@query("missing_products", with_prelude(select=_MISSING_SQL))
def q_missing_products(m):
    return I.missing_products(m.silver_products_held)


_MISSING_COUNTS_SQL = f"""
SELECT x.product_id, k.product_name, CAST(COUNT(*) AS BIGINT) AS missing_count
FROM ({_MISSING_SQL}) x JOIN bronze_product_catalog k ON k.product_id = x.product_id
GROUP BY x.product_id, k.product_name"""


@query("missing_product_counts", with_prelude(select=_MISSING_COUNTS_SQL + " ORDER BY missing_count DESC, product_name"))
def q_missing_product_counts(m):
    return I.missing_product_counts(m.silver_products_held)


@query("insight_summary", with_prelude(select=f"""
WITH top AS (SELECT product_name, missing_count FROM ({_MISSING_COUNTS_SQL}) t
             ORDER BY missing_count DESC, product_name LIMIT 1),
ppc AS ({_PPC})
SELECT (SELECT CAST(COUNT(*) AS BIGINT) FROM silver_customers) AS total_customers,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM silver_transactions) AS total_transactions,
       (SELECT CAST((200 * SUM(num_products) + COUNT(*)) // (2 * COUNT(*)) AS DOUBLE) / 100 FROM ppc)
           AS avg_products_per_customer,
       top.product_name AS biggest_opportunity, top.missing_count AS biggest_opportunity_count,
       ROUND(top.missing_count / (SELECT COUNT(*) FROM silver_customers) * 100, 1) AS cross_sell_gap_pct
FROM top"""))
def q_insight_summary(m):
    return I.insight_summary(m.silver_customers, m.silver_transactions, m.silver_products_held)


_BRONZE_TXN_COLS = ["transaction_id", "customer_id", "date", "category", "amount", "merchant"]


@query("null_profile", with_prelude(select=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS null_count FROM bronze_transactions"
    for c in _BRONZE_TXN_COLS)))
def q_null_profile(m):
    """Missing values per column of the raw (bronze) transactions."""
    return I.null_profile(m.bronze["transactions"])


@query("owned_sets", with_prelude(select="""
SELECT customer_id, list_sort(array_agg(DISTINCT product_id)) AS owned
FROM silver_products_held WHERE customer_id IS NOT NULL AND product_id IS NOT NULL GROUP BY customer_id"""))
def q_owned_sets(m):
    return I.owned_sets(m.silver_products_held)


@query("table_overview", with_prelude(select=" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(COUNT(*) AS BIGINT) AS row_count, {n} AS column_count FROM bronze_{t}"
    for t, n in (("customers", 12), ("transactions", 6), ("products_held", 4), ("product_catalog", 6)))))
def q_table_overview(m):
    return I.table_overview(m.bronze)


@query("service_summary", sig("""
SELECT (SELECT CAST(COUNT(*) AS BIGINT) FROM gold_customer_features) AS total_customers,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM o_hybrid_top3) AS total_recommendations"""))
def q_service_summary(m):
    return I.service_summary(m.gold_customer_features, m.checked_hybrid_recommendations)
