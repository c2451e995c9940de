"""The collaborative model: its fit against the normal equations, its top list against the library's."""

from __future__ import annotations

import random

import pytest

from nextbest.operators import signals


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(4)
    rows = [(u, i, 1.0) for u in range(300) for i in rng.sample(range(8), rng.randint(1, 5))]
    train = spark.createDataFrame(rows, "user_id int, item_id int, rating float").cache()
    return signals.fit_als(train), train


def test_top_items_are_the_library_s(trained):
    model, _ = trained
    mine = {r.user_id: r.recommendations for r in signals.als_top_items(model, 3).collect()}
    for r in model.recommendForAllUsers(3).collect():
        assert [x.item_id for x in mine[r.user_id]] == [x.item_id for x in r.recommendations]
        assert [x.rating for x in mine[r.user_id]] == pytest.approx([x.rating for x in r.recommendations], abs=1e-5)
    plan = signals.als_top_items(model, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_many_items_are_left_to_the_library(trained, monkeypatch):
    model, _ = trained
    monkeypatch.setattr(signals, "MOST_FACTORS", model.rank * 7)
    assert signals.item_factors(model) is None
    assert signals.als_top_items(model, 3).count() == 300


def test_user_factors_solve_their_normal_equations(spark, trained):
    model, train = trained
    rows = signals.als_residuals(model, train).collect()
    assert len(rows) == 300 and max(r.residual for r in rows) < 1e-4
    wrong = train.where("item_id > 0").unionByName(train.selectExpr("user_id", "0 AS item_id", "cast(1 AS float) AS rating").distinct())
    assert max(r.residual for r in signals.als_residuals(model, wrong).collect()) > 1e-2
