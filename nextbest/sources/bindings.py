"""Test-data binding: derive the four bronze banking tables from the driver's
star-schema parquet tables.

The statements are dialect-neutral text with ``{table}`` placeholders.  Spark
fills them with DataFrames (``spark.sql(text, customer=df, ...)``), the DuckDB
oracles fill them with the pre-registered view names, so both sides start from
byte-identical bronze rows.  Bronze is text-typed and deliberately dirty (NULL
keys, impossible dates, non-numeric amounts, duplicate holdings) so the silver
layer has real work to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCE_TABLES = ("region", "nation", "customer", "orders", "lineitem", "part")

BRONZE_CUSTOMERS = """
SELECT 'C_' || lpad(CAST(c_custkey + 1 AS STRING), CAST(greatest(5, length(CAST(c_custkey + 1 AS STRING))) AS INT), '0') AS customer_id,
       c_name AS name,
       CAST(22 + c_custkey % 48 AS STRING) AS age,
       'c' || CAST(c_custkey AS STRING) || '@example.com' AS email,
       n_name AS city,
       r_name AS state,
       CAST(CAST(floor(40000 + 32 * (c_acctbal + 1000)) AS INT) AS STRING) AS income,
       CAST(550 + (c_custkey * 7) % 300 AS STRING) AS credit_score,
       CASE c_nationkey % 3 WHEN 0 THEN 'Salaried' WHEN 1 THEN 'Self_Employed' ELSE 'Business_Owner' END AS employment_type,
       CASE c_custkey % 3 WHEN 0 THEN 'Single' WHEN 1 THEN 'Married' ELSE 'Divorced' END AS marital_status,
       CAST(1 + c_custkey % 120 AS STRING) AS tenure_months,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Young_Professional' WHEN 'BUILDING' THEN 'Mid_Career'
            WHEN 'FURNITURE' THEN 'Family' WHEN 'MACHINERY' THEN 'High_Net_Worth' ELSE 'Near_Retirement' END AS segment
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

BRONZE_TRANSACTIONS = """
SELECT CASE WHEN l_orderkey % 103 = 0 THEN NULL ELSE 'T_' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) END AS transaction_id,
       CASE WHEN l_orderkey % 101 = 0 OR o_custkey % 50 = 7 THEN NULL ELSE 'C_' || lpad(CAST(o_custkey + 1 AS STRING), CAST(greatest(5, length(CAST(o_custkey + 1 AS STRING))) AS INT), '0') END AS customer_id,
       CASE WHEN l_orderkey % 89 = 0 THEN '2024-13-45' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date,
       CASE p_size % 8 WHEN 0 THEN 'Travel' WHEN 1 THEN 'Dining' WHEN 2 THEN 'Groceries' WHEN 3 THEN 'RENT'
            WHEN 4 THEN 'entertainment' WHEN 5 THEN 'Utilities' WHEN 6 THEN 'healthcare' ELSE 'Shopping' END AS category,
       CASE WHEN l_orderkey % 97 = 0 THEN 'n/a' ELSE CAST(l_extendedprice AS STRING) END AS amount,
       'M_' || CAST(l_suppkey AS STRING) AS merchant
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
"""

# every line item is a holding; a customer's parts fall into one to four of the eight products
BRONZE_PRODUCTS_HELD = """
SELECT 'C_' || lpad(CAST(o_custkey + 1 AS STRING), CAST(greatest(5, length(CAST(o_custkey + 1 AS STRING))) AS INT), '0') AS customer_id,
       'P00' || CAST((o_custkey * 3 + l_partkey % (1 + o_custkey % 4)) % 8 + 1 AS STRING) AS product_id,
       CASE (o_custkey * 3 + l_partkey % (1 + o_custkey % 4)) % 8
            WHEN 0 THEN 'Checking_Account' WHEN 1 THEN 'Savings_Account' WHEN 2 THEN 'Travel_Credit_Card'
            WHEN 3 THEN 'Cashback_Credit_Card' WHEN 4 THEN 'Personal_Loan' WHEN 5 THEN 'Home_Loan'
            WHEN 6 THEN 'Investment_Fund' ELSE 'Fixed_Deposit' END AS product_name,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS opened_date
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

PROFILE_FORMS = """
SELECT 'N_' || CAST(c_custkey AS STRING) AS profile_id,
       CAST(18 + c_custkey % 53 AS INT) AS age,
       CAST(20000 + 5000 * (c_custkey % 77) AS DOUBLE) AS income,
       CAST(500 + (c_custkey * 11) % 351 AS INT) AS credit_score,
       CASE c_custkey % 6 WHEN 0 THEN 'young_professional' WHEN 1 THEN 'mid_career' WHEN 2 THEN 'family'
            WHEN 3 THEN 'high_net_worth' WHEN 4 THEN 'near_retirement' ELSE 'unknown_segment' END AS segment,
       CAST((c_custkey * 7) % 41 AS INT) AS travel, CAST((c_custkey * 11) % 31 AS INT) AS dining,
       CAST((c_custkey * 13) % 31 AS INT) AS groceries, CAST((c_custkey * 17) % 41 AS INT) AS rent,
       CAST((c_custkey * 19) % 21 AS INT) AS shopping
FROM {customer}
"""

BINDINGS = {
    "bronze_customers": BRONZE_CUSTOMERS,
    "bronze_transactions": BRONZE_TRANSACTIONS,
    "bronze_products_held": BRONZE_PRODUCTS_HELD,
    "profile_forms": PROFILE_FORMS,
}


def source_frame(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Lazy parquet scan of one driver table (column pruning and filter
    pushdown happen when the binding selects from it)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One bronze table (or the profile form table) as a lazy DataFrame."""
    text = BINDINGS[name]
    used = {t: source_frame(spark, sf_dir, t) for t in SOURCE_TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duckdb_text(name: str) -> str:
    """The same binding statement for DuckDB, reading the pre-registered views."""
    return BINDINGS[name].format(**{t: t for t in SOURCE_TABLES})
