"""Batch build: every model and answer table in one run.

``build_all(spark, sf_dir)`` rebuilds silver (views), gold (written tables),
the recommendation signals, the published hybrid recommendations and the
answer tables, writing each once to the shared checkpoint folder and
returning the written tables by name.  ``python -m nextbest.plans.build
<sf_dir>`` prints their row counts.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from nextbest.operators import answers
from nextbest.plans.models import Models
from nextbest.session import apply_tuning, scratch_path
from nextbest.sources import sinks


def build_all(spark: SparkSession, sf_dir: str, use_als: bool = True, buckets: int | None = None) -> dict[str, DataFrame]:
    """Every table, built now from the files as they are: the run has a model
    graph of its own and shares no table with other runs."""
    apply_tuning(spark)
    m = Models(spark, sf_dir, buckets=buckets)
    for name in ("silver_customers", "silver_transactions", "silver_products_held", "silver_product_catalog"):
        sinks.materialize(m.ref(name), name, "view")
    out = {
        "gold_customer_features": m.gold_customer_features,
        "gold_user_item_matrix": m.gold_user_item_matrix,
        "gold_product_affinity": m.gold_product_affinity,
    }
    recs = m.hybrid_recommendations if use_als else m.checked_hybrid_recommendations
    if use_als:
        out["als_recommendations"] = m.als_recommendations
    out["hybrid_recommendations"] = recs
    existing = answers.existing_customer_recs(m.gold_customer_features, recs, m.gold_product_affinity, pairs=m.affinity_pairs)
    profiles = answers.prepare_profiles(m.profile_forms)
    new = answers.new_customer_recs(profiles, m.gold_product_affinity)
    for name, df in (("existing_customer_recs", existing), ("new_customer_recs", new)):
        path = scratch_path(spark, name)
        sinks.write_parquet(df, path)
        out[name] = spark.read.parquet(path)
    return out


def main(argv: list[str]) -> None:
    from nextbest.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    for name, df in build_all(spark, sf_dir).items():
        print(f"{name}: {df.count()} rows")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
