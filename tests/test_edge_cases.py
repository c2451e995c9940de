"""Inline edge-case rows for the operators (semantics that are easy to get wrong)."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from nextbest import constants as C
from nextbest.functions import scalars as X
from nextbest.operators import answers as A
from nextbest.operators import gold, insights, quality, signals, silver

CUST_COLS = ["customer_id", "name", "age", "email", "city", "state", "income", "credit_score",
             "employment_type", "marital_status", "tenure_months", "segment"]


def bronze_customers(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in CUST_COLS))


def cust_row(cid, segment="Family", age="30"):
    return (cid, "n", age, "e", "c", "s", "50000", "700", "Salaried", "Single", "12", segment)


def txns(spark, rows):
    return spark.createDataFrame(rows, "transaction_id string, customer_id string, date string, category string, "
                                       "amount string, merchant string")


def held(spark, rows):
    return spark.createDataFrame(rows, "customer_id string, product_id string, product_name string, opened_date string")


def features_of(spark, cust, tx, hd):
    return gold.customer_features(silver.silver_customers(cust), silver.silver_transactions(tx),
                                  silver.silver_products_held(hd))


# -- casts -----------------------------------------------------------------
def test_strict_int_cast_raises(spark):
    df = silver.silver_customers(bronze_customers(spark, [cust_row("C_1", age="abc")]))
    with pytest.raises(Exception):
        df.collect()


def test_safe_casts_give_null(spark):
    tx = txns(spark, [("T1", "C_1", "n/a", "Travel", "n/a", "m"),
                      ("T2", "C_1", "2024-13-45", "Travel", "1.0", "m"),
                      ("T3", "C_1", None, "Travel", None, "m"),
                      ("T4", "C_1", "2024-01-02", "Travel", " 12.5 ", "m")])
    got = {r.transaction_id: (r.transaction_date, r.amount) for r in silver.silver_transactions(tx).collect()}
    assert got["T1"] == (None, None)
    assert got["T2"][0] is None and got["T2"][1] == 1.0
    assert got["T3"] == (None, None)
    assert got["T4"][1] == 12.5 and str(got["T4"][0]) == "2024-01-02"


def test_null_key_rows_are_dropped(spark):
    tx = txns(spark, [(None, "C_1", "2024-01-01", "x", "1", "m"), ("T", None, "2024-01-01", "x", "1", "m")])
    assert silver.silver_transactions(tx).count() == 0


# -- features --------------------------------------------------------------
def test_unmatched_customer_nulls_vs_matrix_zeros(spark):
    cust = bronze_customers(spark, [cust_row("C_1"), cust_row("C_2")])
    tx = txns(spark, [("T1", "C_1", "2024-01-01", "Travel", "10.0", "m")])
    hd = held(spark, [("C_1", "P001", "Checking_Account", "2024-01-01")])
    f = {r.customer_id: r for r in features_of(spark, cust, tx, hd).collect()}
    assert f["C_2"].total_transactions is None and f["C_2"].has_checking is None and f["C_2"].travel_pct is None
    assert f["C_1"].travel_pct == 1.0 and f["C_1"].num_products == 1
    m = {r.customer_id: r for r in gold.user_item_matrix(silver.silver_customers(cust),
                                                         silver.silver_products_held(hd)).collect()}
    assert m["C_2"].checking_account == 0 and m["C_1"].checking_account == 1


def test_zero_total_spend_gives_null_shares(spark):
    cust = bronze_customers(spark, [cust_row("C_1")])
    tx = txns(spark, [("T1", "C_1", "2024-01-01", "Travel", "5.0", "m"),
                      ("T2", "C_1", "2024-01-01", "Dining", "-5.0", "m")])
    r = features_of(spark, cust, tx, held(spark, [])).collect()[0]
    assert r.total_spend == 0.0 and r.travel_pct is None and r.dining_pct is None


def test_distinct_vs_plain_product_counts(spark):
    hd = held(spark, [("C_1", "P001", "Checking_Account", "d"), ("C_1", "P001", "Checking_Account", "d"),
                      ("C_1", None, "x", "d")])
    flags = gold.product_flags(silver.silver_products_held(hd)).collect()[0]
    per = insights.products_per_customer(silver.silver_products_held(hd)).collect()[0]
    assert flags.num_products == 1 and per.num_products == 2


# -- content signal ----------------------------------------------------------
def _features(spark, rows):
    cols = ["customer_id", "segment", "num_products", *C.SHARE_COLUMNS, *C.FLAG_COLUMNS]
    schema = ("customer_id string, segment string, num_products bigint, "
              + ", ".join(f"{c} double" for c in C.SHARE_COLUMNS) + ", "
              + ", ".join(f"{c} int" for c in C.FLAG_COLUMNS))
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], schema)


def test_zero_vector_scores_zero_and_ties_by_name(spark):
    f = _features(spark, [dict(customer_id="C_0", segment="family", **{c: 0.0 for c in C.SHARE_COLUMNS})])
    recs = signals.content_recommendations(f).collect()
    assert [r.product_name for r in recs] == sorted(C.PRODUCT_NAMES)[:3]
    assert all(r.cb_score == 0.0 for r in recs)


def test_owners_of_6_7_8_products_get_2_1_0(spark):
    rows = []
    for n in (6, 7, 8):
        r = dict(customer_id=f"C_{n}", segment="family", travel_pct=0.5, dining_pct=0.5)
        for flag in C.FLAG_COLUMNS[:n]:
            r[flag] = 1
        rows.append(r)
    recs = signals.content_recommendations(_features(spark, rows))
    counts = {r.customer_id: r["count"] for r in recs.groupBy("customer_id").count().collect()}
    assert counts.get("C_6") == 2 and counts.get("C_7") == 1 and "C_8" not in counts


def test_cosine_matches_numpy(spark):
    import numpy as np

    shares = [0.3, 0.1, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05]
    f = _features(spark, [dict(customer_id="C_1", segment="family", **dict(zip(C.SHARE_COLUMNS, shares)))])
    got = signals.cosine_wide(f).collect()[0]
    v = np.array(shares)
    for name, w in C.PRODUCT_PROFILES.items():
        w = np.array(w)
        assert got[f"{name}_score"] == pytest.approx(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), abs=1e-12)


# -- scaling and hybrid -------------------------------------------------------
def test_min_max_constant_column_is_zero(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.5)], "id int, s double")
    assert {r.n for r in signals.min_max(df, "s", "n").collect()} == {0.0}


def test_hybrid_zero_fill_default_affinity_and_owned_filter(spark):
    als = spark.createDataFrame([("C_1", "home_loan", 0.9), ("C_1", "savings_account", 0.1),
                                 ("C_2", "home_loan", 0.5)], "customer_id string, product_name string, als_score double")
    cb = spark.createDataFrame([("C_1", "savings_account", 0.2), ("C_1", "fixed_deposit", 0.6),
                                ("C_2", "investment_fund", 0.4)], "customer_id string, product_name string, cb_score double")
    feats = _features(spark, [dict(customer_id="C_1", segment="family", has_home_loan=1),
                              dict(customer_id="C_2", segment="unknown")])
    aff = spark.createDataFrame([("family", "savings_account", 0.5), ("family", "fixed_deposit", 0.25)],
                                "segment string, product_name string, conversion_rate double")
    scored = {(r.customer_id, r.product_name): r for r in signals.hybrid_scores(als, cb, feats, aff).collect()}
    assert len(scored) == 5
    only_als = scored[("C_2", "home_loan")]
    assert only_als.cb_score_norm == 0.0 and only_als.affinity_score == 0.0
    only_cb = scored[("C_1", "fixed_deposit")]
    assert only_cb.als_score_norm == 0.0 and only_cb.cb_score_norm == 1.0
    assert scored[("C_1", "home_loan")].is_owned
    top = signals.hybrid_recommendations(als, cb, feats, aff).collect()
    assert ("C_1", "home_loan") not in {(r.customer_id, r.product_name) for r in top}
    assert {r["rank"] for r in top if r.customer_id == "C_1"} == {1, 2}


# -- answers -------------------------------------------------------------------
def test_rec_type_and_bands(spark):
    df = spark.createDataFrame([(None, 60.0), (2, 60.0), (3, 50.0), (3, 50.1)], "n bigint, s double")
    assert [r.t for r in df.select(X.rec_type_existing("n", "s").alias("t")).collect()] == \
        ["upsell", "cross-sell", "cross-sell", "upsell"]
    b = spark.createDataFrame([(40.0,), (40.1,), (70.0,), (70.1,)], "s double")
    assert [r.b for r in b.select(X.score_band("s").alias("b")).collect()] == ["low", "mid", "mid", "high"]
    n = spark.createDataFrame([(70.0, "high_net_worth"), (70.1, "high_net_worth"), (90.0, "family")], "s double, g string")
    assert [r.t for r in n.select(X.rec_type_new("s", "g").alias("t")).collect()] == ["cross-sell", "upsell", "cross-sell"]


def test_text_formats(spark):
    df = spark.createDataFrame([(58024.9, 0.596, 0.29, "travel_credit_card")], "i double, p double, r double, n string")
    r = df.select(X.currency_text("i").alias("c"), X.percent_text("p").alias("p"), X.percent_int("r").alias("r"),
                  X.display_name("n").alias("d"), X.parse_percent(X.percent_text("p")).alias("back")).collect()[0]
    assert (r.c, r.p, r.r, r.d, r.back) == ("$58,024", "59.6%", 28, "Travel Credit Card", 59.6)


def test_existing_reason_templates_and_fallback(spark):
    rows = [("travel_credit_card", 0.596, 0.1, 0.2, 0.3, None), ("checking_account", 0.1, 0.1, 0.2, 0.3, None),
            ("gold_card", 0.1, 0.2, 0.9, 0.3, 0.29), ("gold_card", 0.1, 0.9, 0.2, 0.3, 0.29),
            ("gold_card", 0.1, 0.5, 0.5, 0.5, 0.29), ("gold_card", 0.1, 0.5, 0.5, 0.5, None)]
    df = spark.createDataFrame(rows, "p string, travel_pct double, als double, cb double, aff double, rate double")
    df = df.withColumn("seg", F.lit("young_professional"))
    shares = {c: (F.col("travel_pct") if c == "travel_pct" else F.lit(0.1)) for c in C.SHARE_COLUMNS}
    got = [r.x for r in df.select(X.explain_existing("p", "seg", shares, "als", "cb", "aff", "rate").alias("x")).collect()]
    assert got == [
        "You spend 59.6% on travel — earn rewards on every trip!",
        "100% of young professional customers use a checking account",
        C.REASON_CB_DOMINANT,
        C.REASON_ALS_DOMINANT,
        "28% of young professional customers own this product",
        C.REASON_DEFAULT,
    ]


def test_lookup_statuses(spark):
    feats = _features(spark, [dict(customer_id="C_1", segment="family"), dict(customer_id="C_8", segment="family")])
    answers = spark.createDataFrame([("C_1", 1)], "customer_id string, rank int")
    req = spark.createDataFrame([("C_1",), ("C_8",), ("C_404",)], "customer_id string")
    got = {r.customer_id: r.status for r in A.lookup_customers(req, feats, answers).collect()}
    assert got == {"C_1": "ok", "C_8": "no_recommendations", "C_404": "customer_not_found"}


def test_profile_forms_validation_and_completion(spark):
    forms = spark.createDataFrame(
        [("a", 30, 50000.0, 700, "family", 20, 20, 20, 20, 19),   # 99 -> remainder 1
         ("b", 30, 50000.0, 700, "family", 20, 20, 20, 20, 20),   # 100 exact
         ("c", 30, 50000.0, 700, "family", 20, 20, 20, 20, 21),   # 101 rejected
         ("d", 30, 50000.0, 700, "family", 20, 20, 20, 20, 18),   # remainder 2
         ("e", 30, 50000.0, 700, "family", 10, 10, 10, 10, 10)],  # remainder 50
        "profile_id string, age int, income double, credit_score int, segment string, travel int, dining int, "
        "groceries int, rent int, shopping int")
    v = {r.profile_id: r for r in A.validate_profiles(forms).collect()}
    assert [v[k].status for k in "abc"] == ["remainder", "exact", "rejected"]
    assert v["c"].over_by == 1 and v["c"].progress == 100 and v["a"].remaining == 1
    c = {r.profile_id: r for r in A.complete_profiles(forms).collect()}
    assert (c["a"].entertainment_pct, c["a"].healthcare_pct, c["a"].utilities_pct) == (0.0, 0.0, 0.01)
    assert (c["d"].entertainment_pct, c["d"].healthcare_pct, c["d"].utilities_pct) == (0.0, 0.0, 0.02)
    assert (c["e"].entertainment_pct, c["e"].healthcare_pct, c["e"].utilities_pct) == (0.16, 0.16, 0.18)
    prepared = {r.profile_id for r in A.prepare_profiles(forms).collect()}
    assert prepared == {"a", "b", "d", "e"}


def test_default_profile_shares(spark):
    raw = spark.createDataFrame([("p", 30, 1.0, 700, "family", None), ("q", None, 1.0, 700, "family", 0.3)],
                                "profile_id string, age int, income double, credit_score int, segment string, "
                                "travel_pct double")
    got = {r.profile_id: r for r in A.default_profiles(raw).collect()}
    assert got["p"].travel_pct == 0.1 and got["p"].groceries_pct == 0.2 and got["p"].status == "ok"
    assert got["q"].travel_pct == 0.3 and got["q"].status == "missing_required"


def test_new_customer_ties_keep_declaration_order(spark):
    prof = spark.createDataFrame([("z", 30, 1000.0, 700, "nobody") + (0.0,) * 8],
                                 "profile_id string, age int, income double, credit_score int, segment string, "
                                 + ", ".join(f"{c} double" for c in C.SHARE_COLUMNS))
    aff = spark.createDataFrame([], "segment string, product_name string, conversion_rate double")
    got = [r.product_name for r in A.new_customer_scores(prof, aff).orderBy("rank").collect()]
    assert got == C.PRODUCT_NAMES[:3]


def test_documents_are_json(spark):
    feats = _features(spark, [dict(customer_id="C_1", segment="family", travel_pct=0.5, has_checking=1)])
    feats = feats.withColumn("age", F.lit(30)).withColumn("income", F.lit(58024)).withColumn(
        "credit_score", F.lit(700)).withColumn("tenure_months", F.lit(5))
    answers = spark.createDataFrame([("C_1", 1, "Home Loan", "🏠", 36.7, "cross-sell", "r")],
                                    "customer_id string, rank int, product string, emoji string, score double, "
                                    "type string, reason string")
    doc = json.loads(A.existing_customer_documents(feats, answers).collect()[0].document)
    assert doc["profile"]["income"] == "$58,024" and doc["current_products"] == ["🏦 Checking Account"]
    assert doc["recommendations"][0]["rank"] == 1 and doc["spending"]["travel"] == "50.0%"


# -- insights ---------------------------------------------------------------------
def test_histogram_edges(spark):
    df = insights.value_weights(spark.createDataFrame([(1,), (2,), (7,)], "x int"), "x")
    h = [r["count"] for r in insights.histogram(df, "x", 8).collect()]
    assert h == [1, 1, 0, 0, 0, 0, 0, 1]
    same = insights.value_weights(spark.createDataFrame([(3,), (3,)], "x int"), "x")
    h2 = insights.histogram(same, "x", 8).collect()
    assert [r["count"] for r in h2] == [0, 0, 0, 0, 2, 0, 0, 0] and h2[0].bin_start == 2.5


def test_missing_counts_equal_pairs(spark):
    hd = silver.silver_products_held(held(spark, [("C_1", "P001", "Checking_Account", "d"),
                                                  ("C_2", "P001", "Checking_Account", "d"),
                                                  ("C_2", "P009", "Gold_Card", "d")]))
    pairs = insights.missing_products(hd)
    counts = {r.product_id: r.missing_count for r in insights.missing_product_counts(hd).collect()}
    by_pairs = {r.product_id: r["count"] for r in pairs.groupBy("product_id").count().collect()}
    assert counts == by_pairs and "P001" not in counts and counts["P002"] == 2


# -- quality ----------------------------------------------------------------------
def test_starter_models(spark):
    first = spark.createDataFrame([(1,), (None,)], "id int")
    second = first.where(F.col("id") == 1)
    res = {(r.model, r.test): r.passed for r in quality.run_checks(
        {"first": first, "second": second},
        [("first", "id", "unique"), ("first", "id", "not_null"),
         ("second", "id", "unique"), ("second", "id", "not_null")]).collect()}
    assert res == {("first", "unique"): True, ("first", "not_null"): False,
                   ("second", "unique"): True, ("second", "not_null"): True}


# -- ids and split ----------------------------------------------------------------
def test_dense_index_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(f"C_{i:05d}",) for i in (5, 3, 9, 1, 3, 7)], "customer_id string").repartition(3)
    got = sorted((r.user_id, r.customer_id) for r in signals.dense_index(df, "customer_id").collect())
    assert [u for u, _ in got] == list(range(5))
    assert [c for _, c in got] == sorted({"C_00005", "C_00003", "C_00009", "C_00001", "C_00007"})


def test_split_is_partitioning_independent(spark):
    df = spark.createDataFrame([(f"C_{i}", f"P00{i % 8 + 1}") for i in range(200)], "customer_id string, product_id string")
    a = {r.customer_id for r in df.repartition(1).where(signals.split_flag()).collect()}
    b = {r.customer_id for r in df.repartition(7).where(signals.split_flag()).collect()}
    assert a == b and 120 < len(a) < 190


def test_silver_catalog_and_column_case(spark):
    from nextbest.sources import dims, sinks

    cat = silver.silver_product_catalog(dims.bronze_product_catalog(spark))
    rows = {r.product_id: r for r in cat.collect()}
    assert len(rows) == 8 and rows["P003"].min_credit_score == 700 and rows["P004"].min_income == 30000
    assert rows["P007"].target_segment == "high_net_worth,near_retirement"
    up = sinks.upper_columns(cat.select("product_id", "product_name"))
    assert up.columns == ["PRODUCT_ID", "PRODUCT_NAME"]
    assert sinks.lower_columns(up).columns == ["product_id", "product_name"]


def test_owner_of_all_products_gets_no_hybrid_recs(spark):
    als = spark.createDataFrame([("C_8", "home_loan", 0.9), ("C_1", "home_loan", 0.5)],
                                "customer_id string, product_name string, als_score double")
    cb = spark.createDataFrame([("C_8", "savings_account", 0.2), ("C_1", "fixed_deposit", 0.6)],
                               "customer_id string, product_name string, cb_score double")
    owner = dict(customer_id="C_8", segment="family", **{f: 1 for f in C.FLAG_COLUMNS})
    feats = _features(spark, [owner, dict(customer_id="C_1", segment="family")])
    aff = spark.createDataFrame([("family", "home_loan", 0.5)], "segment string, product_name string, conversion_rate double")
    recs = signals.hybrid_recommendations(als, cb, feats, aff).collect()
    assert {r.customer_id for r in recs} == {"C_1"}
    req = spark.createDataFrame([("C_8",), ("C_1",)], "customer_id string")
    status = {r.customer_id: r.status for r in A.lookup_customers(req, feats, spark.createDataFrame(
        [(r.customer_id,) for r in recs], "customer_id string")).collect()}
    assert status == {"C_8": "no_recommendations", "C_1": "ok"}


def test_hybrid_on_a_given_als_table(spark):
    """The whole blend on a given collaborative table, against rows computed by hand."""
    als = spark.createDataFrame([("C_1", "home_loan", 0.9), ("C_1", "savings_account", 0.5), ("C_2", "home_loan", 0.1)],
                                "customer_id string, product_name string, als_score double")
    cb = spark.createDataFrame([("C_1", "savings_account", 0.2), ("C_2", "fixed_deposit", 0.6)],
                               "customer_id string, product_name string, cb_score double")
    feats = _features(spark, [dict(customer_id="C_1", segment="family"), dict(customer_id="C_2", segment="mid_career")])
    aff = spark.createDataFrame([("family", "savings_account", 0.5), ("mid_career", "fixed_deposit", 0.25)],
                                "segment string, product_name string, conversion_rate double")
    got = [(r.customer_id, r["rank"], r.product_name, round(r.als_score_norm, 6), round(r.cb_score_norm, 6),
            round(r.affinity_score_norm, 6), round(r.hybrid_score, 6))
           for r in signals.hybrid_recommendations(als, cb, feats, aff).orderBy("customer_id", "rank").collect()]
    assert got == [
        ("C_1", 1, "home_loan", 1.0, 0.0, 0.0, 0.4),
        ("C_1", 2, "savings_account", 0.5, 0.0, 1.0, 0.4),
        ("C_2", 1, "fixed_deposit", 0.0, 1.0, 0.5, 0.5),
        ("C_2", 2, "home_loan", 0.0, 0.0, 0.0, 0.0)]


def test_box_stats_interpolate_and_find_outliers(spark):
    rows = [("a", v) for v in (1, 2, 3, 4, 100)] + [("b", 5), ("b", None), (None, 3)]
    got = {r.g: r for r in insights.box_stats(spark.createDataFrame(rows, "g string, v int"), "v", "g").collect()}
    assert (got["a"].q1, got["a"].median, got["a"].q3) == (2.0, 3.0, 4.0)
    assert (got["a"].whisker_low, got["a"].whisker_high, got["a"].outliers) == (1.0, 4.0, 1)
    assert (got["b"].q1, got["b"].q3, got["b"].outliers) == (5.0, 5.0, 0) and set(got) == {"a", "b"}


def test_box_stats_equal_numpy_over_many_parts(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    values = {"a": np.round(rng.normal(0, 50, 3000), 2), "b": np.array([7.0] * 40), "c": np.round(rng.exponential(9, 11), 3), "d": np.array([1.0, 4.0])}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, v double")
    spread = insights.value_weights(rows, "v", "g").repartitionByRange(23, "g", "v").withColumn("part", F.spark_partition_id())
    for got in (insights.box_of(spread.checkpoint(), "v", "g"), insights.box_stats(rows, "v", "g")):
        found = {r.g: r for r in got.collect()}
        assert set(found) == set(values)
        for g, vs in values.items():
            q1, median, q3 = np.quantile(vs, [0.25, 0.5, 0.75])
            near = vs[(vs >= q1 - 1.5 * (q3 - q1)) & (vs <= q3 + 1.5 * (q3 - q1))]
            r = found[g]
            assert np.allclose([r.q1, r.median, r.q3, r.whisker_low, r.whisker_high], [q1, median, q3, near.min(), near.max()], atol=1e-9)
            assert r.outliers == len(vs) - len(near)
    assert insights.box_stats(rows.where("false"), "v", "g").count() == 0


def test_rates_in_the_row_and_by_salted_join_agree(spark):
    rates = spark.createDataFrame([("s1", "p", 0.5), ("s", "1p", 0.25), ("s2", "p", None), (None, "p", 0.9)], "segment string, product_name string, conversion_rate double")
    rows = spark.createDataFrame([(f"C_{i}", s, p) for i, (s, p) in enumerate([("s1", "p"), ("s", "1p"), ("s2", "p"), (None, "p"), ("s1", None), ("s3", "p")] * 5)],
                                 "customer_id string, segment string, product_name string")

    def got(pairs):
        return sorted((r.customer_id, r.affinity_rate) for r in signals.with_rates(rows, rates, pairs).select("customer_id", "affinity_rate").collect())

    assert got(4) == got(None) == got(signals.MOST_RATES + 1)
    assert dict(got(4))["C_0"] == 0.5 and dict(got(4))["C_1"] == 0.25 and sum(v is not None for _, v in got(4)) == 10


def test_exact_money(spark):
    """Sums, mean and shares do not depend on how rows are dealt out."""
    rows = [(f"T{i}", "C_1", "2024-01-01", "Travel" if i % 3 else "Dining", "0.1", "m") for i in range(300)]
    tx = silver.silver_transactions(txns(spark, rows))
    one, many = (gold.transaction_stats(tx.repartition(n)).collect()[0] for n in (1, 17))
    assert one == many and one.total_spend == 30.0 and one.dining_spend == 10.0 and float(one.avg_transaction) == 0.1


def test_large_and_negative_money(spark):
    """Sums pass 64 bits of ten-thousandths; a customer without any amount has none."""
    rows = [(f"T{i}", "C_1", "2024-01-01", "Travel", "12345678901234.5", "m") for i in range(400)]
    rows += [("U1", "C_2", "2024-01-01", "Dining", "-0.0001", "m"), ("U2", "C_2", "2024-01-01", "Travel", "n/a", "m"), ("V1", "C_3", "2024-01-01", "Travel", "n/a", "m")]
    got = {r.customer_id: r for r in gold.transaction_stats(silver.silver_transactions(txns(spark, rows)).repartition(3)).collect()}
    assert got["C_1"].total_spend == got["C_1"].travel_spend == 12345678901234.5 * 400 and got["C_1"].max_transaction == 12345678901234.5
    assert float(got["C_1"].avg_transaction) == 12345678901234.5 and got["C_1"].dining_spend == 0
    assert got["C_2"].total_spend == got["C_2"].dining_spend == got["C_2"].max_transaction == -0.0001 and got["C_2"].travel_spend == 0
    assert float(got["C_2"].avg_transaction) == -0.0001 and got["C_2"].total_transactions == 2
    c3 = got["C_3"]
    assert (c3.total_transactions, c3.total_spend, c3.avg_transaction, c3.max_transaction, c3.travel_spend, c3.dining_spend) == (1, None, None, None, None, 0)
