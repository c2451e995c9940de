"""Registered starter-model and data-quality queries.

The starter models are re-aimed at the real tables: model 1 is a UNION ALL
of customer ids with the NULL customer ids of the raw transactions (so, like
the starter model, it has unique ids plus NULL rows); model 2 selects from
another model with an equality filter.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from nextbest import constants as C
from nextbest.operators import quality as Q
from nextbest.plans.oracles import with_prelude
from nextbest.plans.registry import query

_UNION_SQL = """
SELECT customer_id AS id FROM silver_customers
UNION ALL
SELECT customer_id AS id FROM bronze_transactions WHERE customer_id IS NULL"""

_FILTER_SQL = "SELECT customer_id, " + ", ".join(f"CAST({p} AS INTEGER) AS {p}" for p in C.PRODUCT_NAMES) \
              + " FROM gold_user_item_matrix WHERE checking_account = 1"


def union_model(m):
    ids = m.silver_customers.select(F.col("customer_id").alias("id"))
    nulls = m.bronze["transactions"].where(F.col("customer_id").isNull()).select(F.col("customer_id").alias("id"))
    return ids.unionByName(nulls)


def filter_model(m):
    return m.gold_user_item_matrix.where(F.col("checking_account") == 1)


@query("example_union_all", with_prelude(select=_UNION_SQL))
def q_example_union_all(m):
    return union_model(m)


@query("example_filter", with_prelude(select=_FILTER_SQL))
def q_example_filter(m):
    return filter_model(m)


@query("dq_unique", with_prelude(select="""
SELECT transaction_id, CAST(COUNT(*) AS BIGINT) AS n_records FROM silver_transactions
WHERE transaction_id IS NOT NULL GROUP BY transaction_id HAVING COUNT(*) > 1"""))
def q_dq_unique(m):
    return Q.check_unique(m.silver_transactions, "transaction_id")


@query("dq_not_null", with_prelude(select=f"SELECT id FROM ({_UNION_SQL}) t WHERE id IS NULL"))
def q_dq_not_null(m):
    return Q.check_not_null(union_model(m), "id")


DECLARED = [
    ("example_union_all", "id", "unique"),
    ("example_union_all", "id", "not_null"),
    ("example_filter", "customer_id", "unique"),
    ("example_filter", "customer_id", "not_null"),
    ("silver_customers", "customer_id", "unique"),
    ("silver_customers", "customer_id", "not_null"),
    ("silver_transactions", "transaction_id", "unique"),
    ("silver_transactions", "customer_id", "not_null"),
]

_SQL_SOURCES = {"example_union_all": f"({_UNION_SQL})", "example_filter": f"({_FILTER_SQL})",
                "silver_customers": "silver_customers", "silver_transactions": "silver_transactions"}


def _suite_sql() -> str:
    parts = []
    for model, col, test in DECLARED:
        src = _SQL_SOURCES[model]
        if test == "unique":
            fail = (f"(SELECT COUNT(*) FROM (SELECT {col} FROM {src} t WHERE {col} IS NOT NULL "
                    f"GROUP BY {col} HAVING COUNT(*) > 1) u)")
        else:
            fail = f"(SELECT COUNT(*) - COUNT({col}) FROM {src} t)"
        parts.append(f"SELECT '{model}' AS model, '{col}' AS column_name, '{test}' AS test, "
                     f"CAST({fail} AS BIGINT) AS failures")
    return "SELECT *, failures = 0 AS passed FROM (" + " UNION ALL ".join(parts) + ") s"


@query("dq_suite", with_prelude(select=_suite_sql()))
def q_dq_suite(m):
    models = {"example_union_all": union_model(m), "example_filter": filter_model(m),
              "silver_customers": m.silver_customers, "silver_transactions": m.silver_transactions}
    return Q.run_checks(models, DECLARED)
