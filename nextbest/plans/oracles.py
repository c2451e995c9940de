"""Independent DuckDB SQL oracles.

Every oracle is plain SQL over the driver's pre-registered views.  The bronze
binding text is shared with Spark (so both start from identical rows); from
silver on, the SQL below is written independently of the DataFrame code it
checks.
"""

from __future__ import annotations

import math

from nextbest import constants as C
from nextbest.sources import bindings


def dbl(x) -> str:
    """A DOUBLE literal (DuckDB reads a bare 0.1 as DECIMAL)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def _catalog_values() -> str:
    rows = ", ".join(
        f"('{pid}', '{name}', '{cat}', '{cs}', '{inc}', '{seg}')" for pid, name, cat, cs, inc, seg in C.CATALOG_ROWS)
    return ("SELECT * FROM (VALUES " + rows + ") AS t(product_id, product_name, category, "
            "min_credit_score, min_income, target_segment)")


def _profiles_values() -> str:
    rows = []
    for ordinal, name in enumerate(C.PRODUCT_NAMES):
        w = C.PRODUCT_PROFILES[name]
        norm = math.sqrt(sum(float(x) * float(x) for x in w))
        rows.append(f"({ordinal}, '{name}', " + ", ".join(dbl(x) for x in w) + f", {dbl(norm)})")
    cols = ", ".join(f"w_{c}" for c in C.SPEND_CATEGORIES)
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(product_ordinal, product_name, {cols}, w_norm)"


def _labels_values() -> str:
    rows = ", ".join(
        f"({i}, '{pid}', '{name}', '{C.PRODUCT_EMOJIS[name]}')"
        for i, (pid, name) in enumerate(zip(C.PRODUCT_IDS, C.PRODUCT_NAMES)))
    return f"SELECT * FROM (VALUES {rows}) AS t(product_ordinal, product_id, product_name, emoji)"


# money in whole hundredths of a cent, so that sums are exact
_SPEND = ", ".join(f"COALESCE(SUM(units) FILTER (category = '{c}'), 0) / {dbl(10000)} AS {c}_spend" for c in C.SPEND_CATEGORIES)
_SHARES = ", ".join(f"ROUND({c}_spend / NULLIF(total_spend, {dbl(0)}), 3) AS {c}_pct" for c in C.SPEND_CATEGORIES)
_HOLDS = ", ".join(f"list_contains(names, '{p}')::INTEGER AS {f}" for p, f in zip(C.PRODUCT_NAMES, C.FLAG_COLUMNS))
_MATRIX = ", ".join(f"COALESCE(list_contains(names, '{p}'), false)::INTEGER AS {p}" for p in C.PRODUCT_NAMES)

PRELUDE_PARTS = [
    ("bronze_customers", bindings.duckdb_text("bronze_customers")),
    ("bronze_transactions", bindings.duckdb_text("bronze_transactions")),
    ("bronze_products_held", bindings.duckdb_text("bronze_products_held")),
    ("bronze_product_catalog", _catalog_values()),
    ("profile_forms", bindings.duckdb_text("profile_forms")),
    ("product_profiles", _profiles_values()),
    ("product_labels", _labels_values()),
    ("silver_customers", """
SELECT customer_id, name, CAST(age AS INTEGER) AS age, email, city, state,
       CAST(income AS INTEGER) AS income, CAST(credit_score AS INTEGER) AS credit_score,
       lower(employment_type) AS employment_type, lower(marital_status) AS marital_status,
       CAST(tenure_months AS INTEGER) AS tenure_months, lower(segment) AS segment
FROM bronze_customers WHERE customer_id IS NOT NULL"""),
    ("silver_transactions", """
SELECT transaction_id, customer_id, TRY_CAST(date AS DATE) AS transaction_date, lower(category) AS category,
       TRY_CAST(amount AS DOUBLE) AS amount, merchant
FROM bronze_transactions WHERE transaction_id IS NOT NULL AND customer_id IS NOT NULL"""),
    ("silver_products_held", """
SELECT customer_id, product_id, lower(product_name) AS product_name, TRY_CAST(opened_date AS DATE) AS opened_date
FROM bronze_products_held WHERE customer_id IS NOT NULL"""),
    ("silver_product_catalog", """
SELECT product_id, lower(product_name) AS product_name, lower(category) AS category,
       CAST(min_credit_score AS INTEGER) AS min_credit_score, CAST(min_income AS INTEGER) AS min_income,
       lower(target_segment) AS target_segment
FROM bronze_product_catalog WHERE product_id IS NOT NULL"""),
    ("o_transaction_stats", f"""
SELECT customer_id, COUNT(*) AS total_transactions, SUM(units) / {dbl(10000)} AS total_spend,
       -- exact half-up mean of whole units, to two decimals
       CAST((2 * SUM(units) + 100 * COUNT(units)) // (200 * COUNT(units)) AS DOUBLE) / 100 AS avg_transaction,
       MAX(amount) AS max_transaction, {_SPEND}
FROM (SELECT *, CAST(ROUND(amount * 10000) AS HUGEINT) AS units FROM silver_transactions) AS priced
GROUP BY ALL"""),
    # one row per customer with holdings: the list of its product names, its number of product ids
    ("o_held", """
SELECT customer_id, list(DISTINCT product_name) AS names, COUNT(DISTINCT product_id) AS num_products
FROM silver_products_held GROUP BY ALL"""),
    ("o_product_flags", f"SELECT customer_id, num_products, {_HOLDS} FROM o_held"),
    ("gold_customer_features", f"""
SELECT customer_id, age, income, credit_score, tenure_months, segment, employment_type, marital_status, total_transactions,
       ROUND(total_spend, 2) AS total_spend, avg_transaction, ROUND(max_transaction, 2) AS max_transaction, {_SHARES},
       num_products, {', '.join(C.FLAG_COLUMNS)}
FROM (FROM silver_customers LEFT JOIN o_transaction_stats USING (customer_id)) LEFT JOIN o_product_flags USING (customer_id)"""),
    ("gold_user_item_matrix", f"""
SELECT DISTINCT customer_id, {_MATRIX} FROM silver_customers LEFT JOIN o_held USING (customer_id)"""),
    # adopters of a product are the customers whose list has it; rank = 1 + products of the segment with more adopters
    ("o_adopters", """
SELECT segment, product_name, COUNT(DISTINCT customer_id) AS adopters
FROM (SELECT segment, customer_id, unnest(names) AS product_name FROM silver_customers JOIN o_held USING (customer_id))
WHERE product_name IS NOT NULL GROUP BY ALL"""),
    ("o_customer_products", """
SELECT DISTINCT customer_id, segment, product_name
FROM (SELECT customer_id, segment, unnest(names) AS product_name FROM silver_customers JOIN o_held USING (customer_id))"""),
    ("o_segment_totals", """
SELECT segment, len(list(DISTINCT customer_id)) AS total_customers FROM silver_customers GROUP BY ALL"""),
    ("o_segment_product_counts", "SELECT segment, product_name, adopters AS customers_with_product FROM o_adopters"),
    ("gold_product_affinity", """
SELECT segment, product_name, adopters AS customers_with_product, total_customers,
       ROUND(adopters / total_customers, 3) AS conversion_rate,
       1 + (SELECT COUNT(*) FROM o_adopters more WHERE more.segment = own.segment AND more.adopters > own.adopters) AS rank_within_segment
FROM o_adopters own JOIN o_segment_totals USING (segment)"""),
]


def with_prelude(*extra: tuple[str, str], select: str) -> str:
    """``WITH <bronze..gold>, <extra CTEs> <select>``."""
    parts = PRELUDE_PARTS + list(extra)
    ctes = ",\n".join(f"{name} AS (\n{body.strip()}\n)" for name, body in parts)
    body = select.strip()
    if body[:5].upper() == "WITH ":
        # the final statement brings its own CTEs: append them to the list
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
