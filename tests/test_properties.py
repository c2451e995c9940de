"""Property checks for the rows-only (non-SQL) queries and the entry point."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from conftest import SF_SMALL

import __spark_entry__ as entry_mod
from nextbest import constants as C
from nextbest.plans.models import Models


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() >= 0
    assert "hybrid_score" in df.columns


def test_als_top3_properties(spark):
    recs = entry_mod.queries()["als_top3"](spark, SF_SMALL)
    rows = recs.collect()
    assert rows
    per = recs.groupBy("customer_id").count().agg(F.max("count")).collect()[0][0]
    assert per <= C.TOP_K
    assert all(r.product_name in C.PRODUCT_NAMES for r in rows)
    assert all(round(r.als_score, 4) == r.als_score for r in rows)
    # join keys exist: every recommended customer is a known customer
    known = Models(spark, SF_SMALL).gold_customer_features.select("customer_id")
    assert recs.join(known, "customer_id", "left_anti").count() == 0


def test_hybrid_recs_als_properties(spark):
    recs = entry_mod.queries()["hybrid_recs_als"](spark, SF_SMALL)
    m = Models(spark, SF_SMALL)
    owned = (m.gold_user_item_matrix.unpivot("customer_id", C.PRODUCT_NAMES, "product_name", "owned")
             .where(F.col("owned") == 1).select("customer_id", "product_name"))
    assert recs.join(owned, ["customer_id", "product_name"], "inner").count() == 0
    ranks = recs.groupBy("customer_id").agg(F.collect_list("rank").alias("r")).collect()
    assert all(sorted(x.r) == list(range(1, len(x.r) + 1)) and len(x.r) <= 3 for x in ranks)
    bounds = recs.agg(F.min("hybrid_score"), F.max("hybrid_score")).collect()[0]
    assert 0.0 <= bounds[0] <= bounds[1] <= 1.0


def test_documents_properties(spark):
    docs = entry_mod.queries()["existing_customer_documents"](spark, SF_SMALL).collect()
    assert docs
    for d in docs[:50]:
        j = json.loads(d.document)
        assert 1 <= len(j["recommendations"]) <= 3
        assert [r["rank"] for r in j["recommendations"]] == list(range(1, len(j["recommendations"]) + 1))
    new_docs = entry_mod.queries()["new_customer_documents"](spark, SF_SMALL).collect()
    assert new_docs and all(len(json.loads(d.document)["recommendations"]) == 3 for d in new_docs)


def test_new_documents_match_flat_answers(spark):
    qs = entry_mod.queries()
    flat = {}
    for r in qs["new_customer_recs"](spark, SF_SMALL).collect():
        flat.setdefault(r.profile_id, []).append((r["rank"], r.product, r.emoji, r.score, r.type, r.reason))
    docs = qs["new_customer_documents"](spark, SF_SMALL).collect()
    assert len(docs) == len(flat)
    for d in docs:
        recs = [(x["rank"], x["product"], x["emoji"], x["score"], x["type"], x["reason"])
                for x in json.loads(d.document)["recommendations"]]
        assert recs == sorted(flat[d.profile_id])
