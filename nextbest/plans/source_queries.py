"""Registered source/sink queries (S1-S8, J9 in long form).

Round trips write to fresh folders below the shared checkpoint folder
(``spark.checkpoint.dir``) and read the written files back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from nextbest import constants as C
from nextbest.operators import gold
from nextbest.operators.silver import without_stamp
from nextbest.operators import signals as S
from nextbest.plans.gold_queries import _FEATURE_COLS
from nextbest.plans.oracles import with_prelude
from nextbest.plans.registry import query
from nextbest.plans.signal_queries import SIGNAL_CTES
from nextbest.session import scratch_path
from nextbest.sources import catalog, dims, published, sinks


@query("csv_roundtrip", with_prelude(select="SELECT * FROM bronze_transactions"))
def q_csv_roundtrip(m):
    """Bronze transactions written as CSV (header, no index) and scanned back
    with the declared schema: NULLs and dirty text survive unchanged."""
    spark = m.spark
    root = scratch_path(spark, "bronze-csv")
    sinks.write_csv(m.bronze["transactions"], f"{root}/transactions")
    return catalog.read_bronze_csv(spark, root, "transactions")


@query("scan_table", with_prelude(select="SELECT "
       + ", ".join(
           f"CAST({c} AS BIGINT) AS {c}" if c in ("total_transactions", "num_products")
           else f"CAST({c} AS INTEGER) AS {c}" if c in C.FLAG_COLUMNS else c
           for c in _FEATURE_COLS)
       + " FROM gold_customer_features"))
def q_scan_table(m):
    """gold_customer_features rebuilt as a table, declared as GOLD.CUSTOMER_FEATURES, then ``SELECT *`` from it by name."""
    path = scratch_path(m.spark, "gold_customer_features")
    sinks.write_parquet(m.gold_customer_features, path)
    published.declare(m.spark, "GOLD.CUSTOMER_FEATURES", path, m.gold_customer_features.schema)
    return without_stamp(catalog.read_table(m.spark, "GOLD.CUSTOMER_FEATURES"))


@query("bronze_row_counts", with_prelude(select=" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(COUNT(*) AS BIGINT) AS row_count FROM bronze_{t}"
    for t in catalog.BRONZE_TABLES)))
def q_bronze_row_counts(m):
    """Bronze sources resolved by name through the declared source catalog."""
    spark = m.spark
    catalog.register(m.bronze, prefix="bronze_")
    parts = [spark.table(f"bronze_{t}").agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(t).alias("table_name"), "row_count") for t in catalog.BRONZE_TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("ref_chain", with_prelude(select="""
SELECT segment, product_name, CAST(customers_with_product AS BIGINT) AS customers_with_product,
       CAST(total_customers AS BIGINT) AS total_customers, conversion_rate,
       CAST(rank_within_segment AS INTEGER) AS rank_within_segment
FROM gold_product_affinity"""))
def q_ref_chain(m):
    """Silver models materialised as named views; the gold model resolves its
    references by name."""
    spark = m.spark
    for name in ("silver_customers", "silver_products_held"):
        sinks.materialize(m.ref(name), f"ref_{name}", "view")
    return without_stamp(gold.product_affinity(spark.table("ref_silver_customers"),
                                                spark.table("ref_silver_products_held")))


@query("gold_roundtrip", with_prelude(*SIGNAL_CTES, select="SELECT "
       + ", ".join(f"{c} AS {c.upper()}" for c, _ in sinks.HYBRID_COLUMNS) + " FROM o_hybrid_top3"))
def q_gold_roundtrip(m):
    """Final recommendations published with the fixed upper-case layout and
    read back from the written table."""
    return sinks.publish_hybrid(m.checked_hybrid_recommendations)


_PROFILE_SUM_SQL = f"""
SELECT f.customer_id, p.product_name,
       ROUND(SUM(COALESCE(x.share, CAST(0.0 AS DOUBLE)) * x.weight), 10) AS dot
FROM gold_customer_features f
CROSS JOIN (SELECT product_name, category, share_col, weight FROM (VALUES {", ".join(
    f"('{n}', '{c}', '{c}_pct', CAST({w!r} AS DOUBLE))"
    for n in C.PRODUCT_NAMES for c, w in zip(C.SPEND_CATEGORIES, C.PRODUCT_PROFILES[n]))})
            AS t(product_name, category, share_col, weight)) p
CROSS JOIN LATERAL (SELECT CASE p.share_col {" ".join(f"WHEN '{c}' THEN f.{c}" for c in C.SHARE_COLUMNS)} END AS share,
                           p.weight AS weight) x
GROUP BY f.customer_id, p.product_name"""


@query("product_profiles_long", with_prelude(select=_PROFILE_SUM_SQL))
def q_product_profiles_long(m):
    """Dot products through the long product-profile dimension: shares
    unpivoted per customer, joined to the 64-row (product, category, weight)
    literal (broadcast), summed per (customer, product)."""
    shares = (S.customer_vectors(m.gold_customer_features)
              .unpivot("customer_id", C.SHARE_COLUMNS, "share_col", "share")
              .withColumn("category", F.regexp_replace("share_col", "_pct$", "")))
    profiles = dims.small(dims.product_profiles(m.spark).select("product_name", "category", "weight"))
    return (shares.join(profiles, "category")
            .groupBy("customer_id", "product_name")
            .agg(F.round(F.sum(F.col("share") * F.col("weight")), 10).alias("dot")))


@query("product_catalog_dim", with_prelude(select="""
SELECT c.product_id, c.product_name, c.category, c.min_credit_score, c.min_income, c.target_segment,
       """ + "CASE c.product_id " + " ".join(
    f"WHEN '{pid}' THEN '{flag}'" for pid, flag in zip(C.PRODUCT_IDS, C.FLAG_COLUMNS)) + """ END AS flag_column,
       l.emoji, CAST(COALESCE(h.holders, 0) AS BIGINT) AS holders
FROM silver_product_catalog c
JOIN product_labels l ON l.product_id = c.product_id
LEFT JOIN (SELECT product_id, COUNT(DISTINCT customer_id) AS holders FROM silver_products_held
           WHERE product_id IS NOT NULL GROUP BY product_id) h ON h.product_id = c.product_id"""))
def q_product_catalog_dim(m):
    """The typed catalog with its labels and flag column (broadcast literal
    dimension) and the number of distinct customers holding each product."""
    holders = (m.silver_products_held.where(F.col("product_id").isNotNull())
               .select("product_id", "customer_id").distinct()
               .groupBy("product_id").agg(F.count(F.lit(1)).alias("holders")))
    labels = dims.small(dims.product_labels(m.spark).select("product_id", "flag_column", "emoji"))
    catalog_typed = without_stamp(m.silver_product_catalog).join(labels, "product_id")
    return (catalog_typed.join(holders, "product_id", "left")
            .withColumn("holders", F.coalesce(F.col("holders"), F.lit(0)).cast("bigint")))
