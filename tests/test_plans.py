"""Plan-shape regression tests: the scale properties the design relies on."""

from __future__ import annotations

from conftest import SF_SMALL

from __spark_entry__ import queries
from nextbest.operators import gold
from nextbest.operators import answers as A
from nextbest.plans.models import Models


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_transactions_aggregate_before_the_exchange(spark):
    m = Models(spark, SF_SMALL, materialize_models=False)
    plan = plan_of(gold.transaction_stats(m.silver_transactions))
    exchange_at = plan.index("Exchange hashpartitioning(customer_id")
    assert "partial_sum" in plan[exchange_at:] and "partial_count" in plan[exchange_at:]


def test_money_is_summed_as_longs(spark):
    m = Models(spark, SF_SMALL, materialize_models=False)
    plan = plan_of(gold.transaction_stats(m.silver_transactions))
    assert "partial_sum(shiftright(units" in plan and "partial_sum(amount" not in plan


def test_gold_tables_read_the_holdings_once(spark):
    m = Models(spark, SF_SMALL)
    held, seen = m.silver_products_held.cache(), spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    m.__dict__["silver_products_held"] = held.mapInArrow(read, held.schema)
    for name in ("gold_customer_features", "gold_user_item_matrix", "gold_product_affinity"):
        m.ref(name).count()
    assert seen.value == held.count()
    held.unpersist()
    m.close()


def test_small_partitions_are_joined_without_a_sort(spark):
    df = Models(spark, SF_SMALL, materialize_models=False).silver_products_held
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = df.groupBy("customer_id").count()
        df.collect()
        assert "ShuffledHashJoin" in plan_of(df) and "SortMergeJoin" not in plan_of(df).split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_scan(spark):
    m = Models(spark, SF_SMALL, materialize_models=False)
    plan = plan_of(m.silver_products_held)
    assert "PushedFilters: [IsNotNull(o_orderkey), IsNotNull(o_custkey)]" in plan or "IsNotNull(l_orderkey)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan


def test_content_top3_has_no_shuffle(spark):
    df = queries()["content_top3"](spark, SF_SMALL)
    assert "Exchange" not in plan_of(df)


def test_answers_join_bucketed_tables_without_shuffle(spark):
    m = Models(spark, SF_SMALL, buckets=8)
    feats, recs, affinity = m.gold_customer_features, m.checked_hybrid_recommendations, m.gold_product_affinity
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(recs.join(feats, "customer_id"))
        answer = plan_of(A.existing_customer_recs(feats, recs, affinity))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert "hashpartitioning(customer_id" not in answer
    m.close()


def test_building_frames_starts_no_job(spark):
    """Once the gold tables are written, no query's frame runs anything before it is read."""
    from nextbest.plans import registry

    registry.load_all()
    m = registry.models_for(spark, SF_SMALL)
    for fn in registry.MODEL_QUERIES.values():
        fn(m)
    sc = spark.sparkContext
    started = set()
    try:
        for name, fn in registry.MODEL_QUERIES.items():
            sc.setJobGroup(f"frame of {name}", "")
            fn(m)
            if sc.statusTracker().getJobIdsForGroup(f"frame of {name}"):
                started.add(name)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    # these are about writing tables and reading them back, or read which prefixes are asked for
    assert started <= {"csv_roundtrip", "gold_roundtrip", "ref_chain", "scan_table", "pruned_lookup"}


def test_suites_read_each_model_once(spark):
    from nextbest.plans import registry

    registry.load_all()
    plan = plan_of(registry.MODEL_QUERIES["insight_summary"](Models(spark, SF_SMALL, materialize_models=False)))
    assert plan.count("hashpartitioning(customer_id") <= 1


def test_no_python_udfs_in_headline_plans(spark):
    qs = queries()
    for name in ("gold_customer_features", "hybrid_top3", "existing_customer_recs", "new_customer_recs"):
        plan = plan_of(qs[name](spark, SF_SMALL))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def partitions_read(df) -> list[int]:
    """Of every scan of a plan that has run: the number of partition folders it opened."""
    found = []

    def walk(node):
        if node.nodeName().strip() == "Scan parquet":
            found.append(node.metrics().apply("numPartitions").value())
        inner = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if "QueryStage" in node.nodeName() else None
        for child in [inner] if inner else [node.children().apply(k) for k in range(node.children().size())]:
            walk(child)

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_lookups_read_only_the_partitions_asked_for(spark, tmp_path):
    from nextbest.sources.published import PREFIX, PublishedTable, key_prefix, rows_of

    people = spark.range(4000).selectExpr("concat('C_', id) AS customer_id", "id AS v")
    table = PublishedTable(spark, f"{tmp_path}/people").replace(people, prefix_of="customer_id", prefixes=64)
    requests = spark.createDataFrame([("C_7",), ("C_7",), ("C_99",), ("nobody",), (None,)], "customer_id string")
    found = rows_of(table, requests, "customer_id", prefixes=64)
    assert {r.v for r in found.collect()} == {7, 99}
    asked = requests.where("customer_id IS NOT NULL").select(key_prefix("customer_id", 64)).distinct().count()
    assert 1 < asked <= 3 and table.select(PREFIX).distinct().count() == 64
    assert max(partitions_read(found)) == asked
    assert rows_of(table, requests.where("customer_id IS NULL"), "customer_id", prefixes=64).count() == 0


def test_rates_are_looked_up_without_a_shuffle_by_segment(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = queries()["affinity_lookup"](spark, SF_SMALL)
        rows = found.count()
        plan = plan_of(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert rows > 0 and "hashpartitioning(customer_id" in plan
    # what is shuffled by segment are the few rates inside the subqueries; no customer is joined on it
    assert "Join [segment" not in plan and "_salt" not in plan


def test_box_numbers_sort_no_group_as_a_whole(spark):
    from nextbest.operators import insights

    rows = spark.range(2000).selectExpr("'a' AS g", "id / 7.0 AS v")
    plan = plan_of(insights.box_stats(rows, "v", "g"))
    windows = [line for line in plan.splitlines() if " Window [" in line]
    assert windows and all("part#" in line for line in windows)


def test_run_metrics_come_from_the_write(spark):
    from nextbest.plans import registry

    registry.load_all()
    m = registry.models_for(spark, SF_SMALL)
    for name in ("checked_hybrid_recommendations", "als_recommendations"):
        recs = m.ref(name)
        got = m.run_metrics(name)
        assert got.inputFiles() and not set(got.inputFiles()) & set(recs.inputFiles())
        assert tuple(got.first()) == (recs.count(), recs.select("customer_id").distinct().count())
    lazy = Models(spark, SF_SMALL, materialize_models=False)
    assert tuple(lazy.run_metrics("checked_hybrid_recommendations").first()) == tuple(m.run_metrics("checked_hybrid_recommendations").first())


def test_changed_files_give_a_new_graph(spark, tmp_path):
    import pathlib
    import shutil

    from nextbest.plans import registry

    registry.load_all()
    folder = f"{tmp_path}/tables"
    shutil.copytree(SF_SMALL, folder)
    run = registry.QUERIES["gold_user_item_matrix"]
    first, before = registry.models_for(spark, folder), run(spark, folder).count()
    assert registry.models_for(spark, folder) is first  # reading changes nothing
    customers = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    one = orders.select("o_custkey").where("o_custkey IS NOT NULL").first()[0]
    customers.where(customers.c_custkey == one).write.parquet(f"{tmp_path}/fewer")
    part = next(pathlib.Path(tmp_path, "fewer").glob("part-*.parquet"))
    shutil.copyfile(part, f"{folder}/customer.parquet")
    assert registry.models_for(spark, folder) is not first
    assert run(spark, folder).count() < before
    registry.forget(spark, folder)
