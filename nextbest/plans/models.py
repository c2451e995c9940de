"""Model graph: each model is a function of the models it references.

``Models(spark, sf_dir)`` resolves the bronze sources and exposes every
silver/gold model as a lazy DataFrame (the ``ref()`` of a model is plain
attribute access).  Silver models are views (lazy); gold models are written
once by the ``Models`` object that first refers to them, and belong to it: a new
object builds them again from the files as they are then, and ``close()``
removes its files and catalog entries.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from nextbest.operators import gold, signals, silver
from nextbest.session import remove_path, scratch_path
from nextbest.sources import bindings, catalog, sinks
from nextbest.sources.published import PublishedTable

#: Of a run: customers, each of which has one row of rank 1.
_RUN = {"firsts": "sum(CASE WHEN rank = 1 THEN 1 END)"}


class Models:
    def __init__(self, spark: SparkSession, sf_dir: str, materialize_models: bool = True, buckets: int | None = None):
        """``buckets``: write per-customer tables as external bucketed tables with
        so many buckets (a number to fit the data; None writes plain parquet)."""
        self.spark = spark
        self.sf_dir = sf_dir
        self.materialize_models = materialize_models
        self.buckets = buckets
        self._paths: list[str] = []
        self._tables: list[str] = []
        self._observed: dict[str, dict[str, int]] = {}
        self._metrics: dict[str, DataFrame] = {}

    # -- bronze sources ----------------------------------------------------
    @cached_property
    def bronze(self) -> dict[str, DataFrame]:
        return catalog.bronze_frames(self.spark, self.sf_dir)

    @cached_property
    def profile_forms(self) -> DataFrame:
        return bindings.bind(self.spark, self.sf_dir, "profile_forms")

    # -- silver views ------------------------------------------------------
    @cached_property
    def silver_customers(self) -> DataFrame:
        return silver.silver_customers(self.bronze["customers"])

    @cached_property
    def silver_transactions(self) -> DataFrame:
        return silver.silver_transactions(self.bronze["transactions"])

    @cached_property
    def silver_products_held(self) -> DataFrame:
        return silver.silver_products_held(self.bronze["products_held"])

    @cached_property
    def silver_product_catalog(self) -> DataFrame:
        return silver.silver_product_catalog(self.bronze["product_catalog"])

    # -- gold tables (materialised once per application, read back) --------
    @cached_property
    def distinct_holdings(self) -> DataFrame:
        """Different holdings, written once: the gold tables read them instead of all rows."""
        return self.written("distinct_holdings", lambda: gold.distinct_holdings(self.silver_products_held))

    @cached_property
    def gold_customer_features(self) -> DataFrame:
        return self.written("gold_customer_features", lambda: gold.customer_features(
            self.silver_customers, self.silver_transactions, self.distinct_holdings), bucket_by="customer_id")

    @cached_property
    def gold_user_item_matrix(self) -> DataFrame:
        return self.written("gold_user_item_matrix", lambda: gold.user_item_matrix(
            self.silver_customers, self.distinct_holdings), bucket_by="customer_id")

    @cached_property
    def gold_product_affinity(self) -> DataFrame:
        return self.written("gold_product_affinity", lambda: gold.product_affinity(
            self.silver_customers, self.distinct_holdings))

    @cached_property
    def products_distribution(self) -> DataFrame:
        """(num_products, weight): customers by number of products, a row per number."""
        from nextbest.operators import insights

        return self.written("products_distribution", lambda: insights.value_weights(
            insights.products_per_customer(self.silver_products_held), "num_products"))

    @cached_property
    def age_distribution(self) -> DataFrame:
        """(segment, age, weight, part): customers by segment and age, in ranges of both."""
        from nextbest.operators import insights

        return self.written("age_distribution", lambda: insights.ranged_weights(self.silver_customers, "age", "segment"))

    @cached_property
    def affinity_pairs(self) -> int | None:
        """Rows of the affinity table, as its write counted them; None where it is not written."""
        self.ref("gold_product_affinity")
        return self._observed.get("gold_product_affinity", {}).get("rows")

    # -- shared lazy signal frames (built once per model graph) -------------
    @cached_property
    def content_recommendations(self) -> DataFrame:
        return signals.content_recommendations(self.gold_customer_features)

    @cached_property
    def standin_signal(self) -> DataFrame:
        """Deterministic collaborative stand-in (segment popularity)."""
        return signals.segment_popularity_signal(self.gold_customer_features, self.gold_product_affinity, pairs=self.affinity_pairs)

    @cached_property
    def new_customer_profiles(self) -> DataFrame:
        from nextbest.operators import answers

        return answers.prepare_profiles(self.profile_forms)

    @cached_property
    def new_customer_recs(self) -> DataFrame:
        from nextbest.operators import answers

        return answers.new_customer_recs(self.new_customer_profiles, self.gold_product_affinity)

    # -- model outputs -----------------------------------------------------
    @cached_property
    def als_recommendations(self) -> DataFrame:
        """Implicit-ALS top-3 per trained customer, trained once and written."""
        return self.written("als_recommendations", lambda: signals.als_recommendations(
            self.gold_user_item_matrix, self.customer_index, ranked=True), observe=_RUN).drop("rank")

    @cached_property
    def hybrid_recommendations(self) -> DataFrame:
        """Published hybrid top-3 on the real ALS signal."""
        return self.written("hybrid_recommendations", lambda: signals.hybrid_recommendations(
            self.als_recommendations, self.content_recommendations,
            self.gold_customer_features, self.gold_product_affinity, pairs=self.affinity_pairs), bucket_by="customer_id", observe=_RUN)

    @cached_property
    def checked_hybrid_recommendations(self) -> DataFrame:
        """Published hybrid top-3 on the deterministic collaborative stand-in
        (the SQL-checkable variant)."""
        feats, aff = self.gold_customer_features, self.gold_product_affinity
        return self.written("checked_hybrid_recommendations", lambda: signals.hybrid_recommendations(
            self.standin_signal, self.content_recommendations, feats, aff, pairs=self.affinity_pairs), bucket_by="customer_id", observe=_RUN)

    @cached_property
    def customer_index(self) -> DataFrame:
        """Dense customer ids, computed once and written: several frames refer to them."""
        return self.written("customer_index", lambda: signals.dense_index(self.gold_user_item_matrix, "customer_id"))

    @cached_property
    def published_features(self) -> DataFrame:
        """Customer features, partitioned by the prefix of the id for lookups."""
        return self.published("published_features", self.gold_customer_features)

    @cached_property
    def published_answers(self) -> DataFrame:
        """Answer rows on the deterministic collaborative stand-in, partitioned by the prefix of the id for lookups."""
        from nextbest.operators import answers

        return self.published("published_answers", answers.existing_customer_recs(
            self.gold_customer_features, self.checked_hybrid_recommendations, self.gold_product_affinity, pairs=self.affinity_pairs))

    def published(self, name: str, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, name)
        self._paths.append(path)
        return PublishedTable(self.spark, path).replace(df, prefix_of="customer_id")

    def run_metrics(self, name: str) -> DataFrame:
        """(total_recommendations, unique_customers) of a written model of recommendations, one row written beside it: the
        write itself counted them, so the table is not read again."""
        if name in self._metrics:
            return self._metrics[name]
        recs, seen = self.ref(name), self._observed.get(name)
        if seen is None:  # not written by this graph
            return recs.agg(F.count(F.lit(1)).alias("total_recommendations"), F.countDistinct("customer_id").alias("unique_customers"))
        path = scratch_path(self.spark, f"{name}-metrics")
        self._paths.append(path)
        one = self.spark.createDataFrame([(seen["rows"], seen["firsts"] or 0)], "total_recommendations bigint, unique_customers bigint")
        sinks.write_parquet(one, path)
        self._metrics[name] = self.spark.read.parquet(path)
        return self._metrics[name]

    def written(self, name: str, build, bucket_by: str | None = None, observe: dict[str, str] | None = None) -> DataFrame:
        """Build a model once as a parquet table in the shared checkpoint
        folder and read it back: later references scan the table (and a lost
        executor recomputes from it, not from the raw inputs).  The write counts
        its rows, and takes the aggregates of ``observe`` (SQL by name) along."""
        if not self.materialize_models:
            return build()
        path = scratch_path(self.spark, name)
        self._paths.append(path)
        # observed in the stage that writes: a task run again counts once
        seen, measures = Observation(), [F.count(F.lit(1)).alias("rows"), *[F.expr(sql).alias(n) for n, sql in (observe or {}).items()]]
        if bucket_by and self.buckets:
            table = f"nb_{uuid.uuid4().hex[:10]}_{name}"
            (build().repartition(self.buckets, bucket_by).observe(seen, *measures).write.mode("overwrite").bucketBy(self.buckets, bucket_by).sortBy(bucket_by)
             .option("path", path).format("parquet").saveAsTable(table))
            self._tables.append(table)
            out = self.spark.table(table)
        else:
            sinks.write_parquet(build().observe(seen, *measures), path)
            out = self.spark.read.parquet(path)
        self._observed[name] = seen.get
        return out

    def close(self) -> None:
        """Remove the tables this object wrote; its frames cannot be read afterwards."""
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        for path in self._paths:
            remove_path(self.spark, path)
        self._tables, self._paths = [], []

    def ref(self, name: str) -> DataFrame:
        """Resolve a model by name."""
        return getattr(self, name)

    def materialize(self, name: str, kind: str = "table") -> DataFrame:
        """Rebuild a model as a table (parquet in the shared checkpoint folder)
        and use the written table for every later reference."""
        out = sinks.materialize(self.ref(name), name, kind)
        self.__dict__[name] = out
        return out
