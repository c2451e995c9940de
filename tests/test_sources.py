"""Sources and sinks: ids beyond five digits, CSV as pandas writes it, rebuilds, the checkpoint folder."""

from __future__ import annotations

import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from nextbest import session
from nextbest.plans.build import build_all
from nextbest.sources import bindings, catalog, sinks

TABLES = ("region", "nation", "customer", "orders", "lineitem", "part")


def test_ids_beyond_five_digits_stay_apart(spark):
    n = 150_000
    customer = spark.range(n).select(
        F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit(1.0).alias("c_acctbal"), F.lit(0).cast("long").alias("c_nationkey"),
        F.lit("BUILDING").alias("c_mktsegment"))
    frames = {"customer": customer, "nation": spark.createDataFrame([(0, "N", 0)], "n_nationkey long, n_name string, n_regionkey long"),
              "region": spark.createDataFrame([(0, "R")], "r_regionkey long, r_name string")}
    ids = spark.sql(bindings.BRONZE_CUSTOMERS, **frames).select("customer_id")
    assert ids.distinct().count() == n
    assert {r.customer_id for r in ids.where("customer_id IN ('C_00001', 'C_99999', 'C_100000', 'C_150000')").collect()} == {
        "C_00001", "C_99999", "C_100000", "C_150000"}


def test_every_line_item_is_a_holding(spark):
    held = bindings.bind(spark, SF_SMALL, "bronze_products_held")
    assert held.count() == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    per = held.groupBy("customer_id").agg(F.countDistinct("product_id").alias("n")).agg(F.min("n"), F.max("n")).first()
    assert per[0] == 1 and per[1] == 4


def test_csv_as_pandas_writes_it(spark, tmp_path):
    rows = [("C_1", 'Smith "The Best", Inc'), ("C_2", "two\nlines"), ("C_3", "a,b"), ("C_4", "plain")]
    frame = pd.DataFrame([{c: "" for c in (f.name for f in catalog.BRONZE_SCHEMAS["customers"])} | {"customer_id": i, "name": n} for i, n in rows])
    frame.to_csv(tmp_path / "customers.csv", index=False)
    got = catalog.read_bronze_csv(spark, str(tmp_path), "customers")
    assert sorted((r.customer_id, r.name) for r in got.collect()) == rows
    again = str(tmp_path / "back" / "customers")
    sinks.write_csv(got, again)
    assert sorted((r.customer_id, r.name) for r in catalog.read_bronze_csv(spark, str(tmp_path / "back"), "customers").collect()) == rows


def test_bad_csv_rows_are_reported(spark, tmp_path):
    (tmp_path / "products_held.csv").write_text("customer_id,product_id,product_name,opened_date\nC_1,P001,x,d\nC_2,P001\n")
    with pytest.raises(Exception):
        catalog.read_bronze_csv(spark, str(tmp_path), "products_held").collect()
    kept = catalog.read_bronze_csv(spark, str(tmp_path), "products_held", bad_rows="PERMISSIVE").collect()
    assert [r._corrupt_record for r in kept] == [None, "C_2,P001"]


def test_a_rebuild_reads_the_files_again(spark, tmp_path):
    for t in TABLES:
        shutil.copy(f"{SF_SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    first = build_all(spark, str(tmp_path), use_als=False)["gold_user_item_matrix"].count()
    half = pd.read_parquet(tmp_path / "customer.parquet").iloc[: first // 2]
    half.to_parquet(tmp_path / "customer.parquet", index=False)
    assert build_all(spark, str(tmp_path), use_als=False)["gold_user_item_matrix"].count() == first // 2


def test_a_cluster_must_name_its_checkpoint_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_a_failed_publish_leaves_the_rows_before_it(spark, tmp_path):
    from nextbest.sources.published import PublishedTable

    table = PublishedTable(spark, f"{tmp_path}/recs")
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.replace(spark.range(10)).count() == 10
    # half of the tasks write their rows, then one fails
    broken = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") == 900, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        table.replace(broken)
    assert table.read().count() == 10 and len(table.versions()) == 1
    planned = table.read()
    assert table.replace(spark.range(25)).count() == 25 and planned.count() == 10
    table.replace(spark.range(3))
    assert len(table.versions()) == 2 and table.read().count() == 3


def test_pointers_that_are_not_complete_do_not_count(spark, tmp_path):
    from nextbest.sources.published import PublishedTable

    table = PublishedTable(spark, f"{tmp_path}/t")
    table.replace(spark.range(4))
    (tmp_path / "t" / "_pointers" / f"{2:020d}").write_text("")
    (tmp_path / "t" / "_pointers" / f"{3:020d}").write_text("v-half")
    assert table.read().count() == 4
    assert table.replace(spark.range(5)).count() == 5


def test_tables_by_name_hold_what_is_declared(spark, tmp_path):
    from nextbest.sources.published import SchemaMismatch, declare

    spark.range(5).selectExpr("id", "cast(id AS string) AS name").write.parquet(f"{tmp_path}/a")
    frame = spark.read.parquet(f"{tmp_path}/a")
    declare(spark, "GOLD.PEOPLE", f"{tmp_path}/a", frame.schema)
    assert catalog.read_table(spark, "gold.people").count() == 5
    for wrong in (frame.selectExpr("cast(id AS int) AS id").schema, frame.selectExpr("id AS other").schema):
        with pytest.raises(SchemaMismatch):
            declare(spark, "GOLD.PEOPLE", f"{tmp_path}/a", wrong)
    with pytest.raises(ValueError):
        declare(spark, "PEOPLE", f"{tmp_path}/a", frame.schema)
    frame.unionByName(frame).write.parquet(f"{tmp_path}/b")
    declare(spark, "GOLD.PEOPLE", f"{tmp_path}/b", frame.schema)
    assert catalog.read_table(spark, "GOLD.PEOPLE").count() == 10 and frame.count() == 5
    spark.sql("DROP DATABASE gold CASCADE")
