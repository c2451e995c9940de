"""Generated-input property tests for the scalar and scaling operators, and
the batch build."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL

from nextbest import constants as C
from nextbest.operators import answers as A
from nextbest.operators import signals

PCT = st.integers(min_value=0, max_value=100)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(PCT, PCT, PCT, PCT, PCT), min_size=1, max_size=20))
def test_completed_profiles_sum_to_one(spark, forms):
    rows = [(f"p{i}", 30, 1000.0, 700, "family", *f) for i, f in enumerate(forms)]
    df = spark.createDataFrame(rows, "profile_id string, age int, income double, credit_score int, segment string, "
                                     "travel int, dining int, groceries int, rent int, shopping int")
    checked = {r.profile_id: r for r in A.validate_profiles(df).collect()}
    for r in A.complete_profiles(df).collect():
        total = sum(r[c] for c in C.SHARE_COLUMNS)
        if checked[r.profile_id].total <= 100:
            assert abs(total - 1.0) < 1e-9
        assert min(r[c] for c in C.SHARE_COLUMNS) >= 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=30))
def test_min_max_bounds(spark, xs):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "id int, s double")
    got = [r.n for r in signals.min_max(df, "s", "n").collect()]
    assert all(0.0 <= v <= 1.0 for v in got)
    if max(xs) > min(xs):
        assert min(got) == 0.0 and max(got) == 1.0
    else:
        assert set(got) == {0.0}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(min_value=0, max_value=1, allow_nan=False), min_size=8, max_size=8))
def test_content_top3_is_best_unowned(spark, shares):
    df = spark.createDataFrame([("C", "family", *[float(s) for s in shares])],
                               "customer_id string, segment string, " + ", ".join(f"{c} double" for c in C.SHARE_COLUMNS))
    for f in C.FLAG_COLUMNS:
        df = df.withColumn(f, df["customer_id"].isNull().cast("int"))
    top = [r.product_name for r in signals.content_recommendations(df).collect()]
    full = signals.content_scores(df).orderBy("score_rank").collect()
    assert top == [r.product_name for r in full[:3]]


def test_build_all(spark):
    from nextbest.plans.build import build_all

    out = build_all(spark, SF_SMALL, use_als=False)
    assert set(out) >= {"gold_customer_features", "hybrid_recommendations", "existing_customer_recs",
                        "new_customer_recs"}
    assert out["existing_customer_recs"].count() == out["hybrid_recommendations"].count()
