"""Recommendation answers as batch jobs.

The per-request service logic is re-expressed over whole tables: every
customer (or every requested id, or every submitted profile) is answered in
one job.  Texts are built with built-in string expressions (no UDFs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextbest import constants as C
from nextbest.functions import scalars as X
from nextbest.operators import signals as S
from nextbest.sources.published import rows_of

_GIVEN = ["travel", "dining", "groceries", "rent", "shopping"]


# ---------------------------------------------------------------------------
# existing customers
# ---------------------------------------------------------------------------
def _profile_columns() -> list:
    return [
        F.coalesce(F.col("age"), F.lit(0)).cast("int").alias("age"),
        X.currency_text(F.coalesce(F.col("income"), F.lit(0))).alias("income"),
        F.coalesce(F.col("credit_score"), F.lit(0)).cast("int").alias("credit_score"),
        X.display_name(F.coalesce(F.col("segment"), F.lit(""))).alias("segment"),
        F.coalesce(F.col("tenure_months"), F.lit(0)).cast("int").alias("tenure_months")]


def _spending_columns() -> list:
    return [X.percent_text(f"{c}_pct").alias(c) for c in _GIVEN]


def _current_products_column():
    labels = F.array(*[
        F.when(F.col(flag) == 1, F.lit(f"{C.PRODUCT_EMOJIS.get(name, '')} {name.replace('_', ' ').title()}"))
        for name, flag in zip(C.PRODUCT_NAMES, C.FLAG_COLUMNS)])
    return F.filter(labels, lambda x: x.isNotNull()).alias("current_products")


def formatted_profiles(features: DataFrame) -> DataFrame:
    """Profile block: age, currency income, credit score, display segment, tenure."""
    return features.select("customer_id", *_profile_columns())


def spending_text(features: DataFrame) -> DataFrame:
    """Five spending texts (``59.6%``); a missing share prints ``0.0%``."""
    return features.select("customer_id", *_spending_columns())


def current_products(features: DataFrame) -> DataFrame:
    """Owned products in flag order as ``<emoji> <Display Name>`` labels."""
    return features.select("customer_id", _current_products_column())


def existing_customer_recs(features: DataFrame, recs: DataFrame, affinity: DataFrame,
                           k: int = C.TOP_K, pairs: int | None = None) -> DataFrame:
    """Flat answer rows: up to k recs per customer with rank, display name,
    emoji, score (percent, 1 dp), type and reason.

    ``recs`` is the published hybrid table; the features join is on
    customer_id (both sides keyed by it), the affinity rates are looked up by
    ``signals.with_rates``; ``pairs`` is their number, if known."""
    ranked = recs.where(F.col("rank") <= k) if "rank" in recs.columns else S.top_k(recs, "hybrid_score", k)
    cust = features.select("customer_id", F.col("segment").alias("customer_segment"), "num_products",
                           *C.SHARE_COLUMNS)
    j = S.with_rates(ranked.join(cust, "customer_id", "inner"), affinity, pairs, "customer_segment")
    score = X.percent_number("hybrid_score")
    shares = {c: F.col(c) for c in C.SHARE_COLUMNS}
    return j.select(
        "customer_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("product_name"),
        X.display_name("product_name").alias("product"),
        X.emoji_for("product_name").alias("emoji"),
        score.alias("score"),
        X.rec_type_existing("num_products", score).alias("type"),
        X.explain_existing("product_name", "customer_segment", shares, "als_score_norm", "cb_score_norm",
                           "affinity_score_norm", "affinity_rate").alias("reason"))


def signal_reasons(recs: DataFrame, features: DataFrame, affinity: DataFrame, pairs: int | None = None) -> DataFrame:
    """The signal-dominance reason of every recommendation (the sentence used
    for products without a product template)."""
    cust = features.select("customer_id", F.col("segment").alias("customer_segment"))
    j = S.with_rates(recs.join(cust, "customer_id", "left"), affinity, pairs, "customer_segment")
    reason = X.signal_reason("customer_segment", "als_score_norm", "cb_score_norm", "affinity_score_norm", "affinity_rate")
    return j.select("customer_id", "product_name", reason.alias("reason"))


def lookup_customers(requests: DataFrame, features: DataFrame, answers: DataFrame) -> DataFrame:
    """Batched point lookup: one status row per requested id --
    ``customer_not_found``, ``no_recommendations`` or ``ok`` with the count."""
    known = features.select("customer_id", F.lit(True).alias("_known")).dropDuplicates(["customer_id"])
    counts = answers.groupBy("customer_id").agg(F.count(F.lit(1)).alias("recommendations"))
    out = (requests.select("customer_id").distinct()
           .join(known, "customer_id", "left")
           .join(counts, "customer_id", "left"))
    status = (F.when(F.col("_known").isNull(), F.lit("customer_not_found"))
              .when(F.col("recommendations").isNull(), F.lit("no_recommendations"))
              .otherwise(F.lit("ok")))
    return out.select("customer_id", status.alias("status"),
                      F.coalesce(F.col("recommendations"), F.lit(0)).cast("bigint").alias("recommendations"))


def lookup_published(requests: DataFrame, features: DataFrame, answers: DataFrame) -> DataFrame:
    """``lookup_customers`` over published tables that are partitioned by the prefix of ``customer_id``: rows of other
    customers are left out before anything is counted, and their partitions are not read."""
    return lookup_customers(requests, rows_of(features, requests, "customer_id"), rows_of(answers, requests, "customer_id"))


def existing_customer_documents(features: DataFrame, answers: DataFrame) -> DataFrame:
    """Nested answer document per customer (profile, spending, current
    products, ordered recommendations) and its JSON text."""
    recs = (answers.groupBy("customer_id")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "product", "emoji", "score", "type", "reason")))
                 .alias("recommendations")))
    # one projection of the feature row (no self-joins), one join with the recs
    blocks = features.select("customer_id", F.struct(*_profile_columns()).alias("profile"),
                             F.struct(*_spending_columns()).alias("spending"), _current_products_column())
    doc = blocks.join(recs, "customer_id", "inner")
    return doc.withColumn("document", F.to_json(F.struct("customer_id", "profile", "spending",
                                                         "current_products", "recommendations")))


# ---------------------------------------------------------------------------
# profile intake and new customers
# ---------------------------------------------------------------------------
def validate_profiles(forms: DataFrame) -> DataFrame:
    """Form check: total of the 5 given percents; > 100 rejected, = 100
    exact, < 100 the remainder goes to the other three categories."""
    total = sum((F.col(c) for c in _GIVEN[1:]), F.col(_GIVEN[0]))
    return forms.select(
        "profile_id", total.alias("total"),
        F.when(total > 100, F.lit("rejected")).when(total == 100, F.lit("exact")).otherwise(F.lit("remainder"))
        .alias("status"),
        F.least(total, F.lit(100)).alias("progress"),
        F.greatest(F.lit(100) - total, F.lit(0)).alias("remaining"),
        F.greatest(total - F.lit(100), F.lit(0)).alias("over_by"))


def complete_profiles(forms: DataFrame) -> DataFrame:
    """Split the remainder: entertainment and healthcare get rem // 3 each,
    utilities the rest; all 8 shares as fractions."""
    total = sum((F.col(c) for c in _GIVEN[1:]), F.col(_GIVEN[0]))
    rem = F.greatest(F.lit(100) - total, F.lit(0))
    third = F.floor(rem / 3).cast("int")
    given = [(F.col(c) / 100).alias(f"{c}_pct") for c in _GIVEN]
    return forms.select(
        "profile_id", "age", "income", "credit_score", "segment", *given,
        (third / 100).alias("entertainment_pct"),
        (third / 100).alias("healthcare_pct"),
        ((rem - 2 * third) / 100).alias("utilities_pct"))


def default_profiles(raw: DataFrame) -> DataFrame:
    """API intake: missing shares take their defaults; age, income,
    credit_score and segment are required (status ``missing_required``)."""
    required = ["age", "income", "credit_score", "segment"]
    missing = None
    for c in required:
        cond = F.col(c).isNull()
        missing = cond if missing is None else (missing | cond)
    shares = [F.coalesce(F.col(c).cast("double") if c in raw.columns else F.lit(None).cast("double"),
                         F.lit(d)).alias(c) for c, d in C.PROFILE_DEFAULTS.items()]
    return raw.select("profile_id", F.col("age").cast("int").alias("age"),
                      F.col("income").cast("double").alias("income"),
                      F.col("credit_score").cast("int").alias("credit_score"), "segment", *shares,
                      F.when(missing, F.lit("missing_required")).otherwise(F.lit("ok")).alias("status"))


def prepare_profiles(forms: DataFrame) -> DataFrame:
    """Validate, drop rejected forms, complete the remainder, apply defaults.
    The validity test is row-local: a filter, not a join back to the forms."""
    total = sum((F.col(c) for c in _GIVEN[1:]), F.col(_GIVEN[0]))
    completed = complete_profiles(forms.where(total <= 100))
    return default_profiles(completed).where(F.col("status") == "ok").drop("status")


def _segment_rates(affinity: DataFrame) -> DataFrame:
    """One row per segment with its 8 conversion rates (segments x 8 cells)."""
    return affinity.groupBy("segment").agg(*[
        F.max(F.when(F.col("product_name") == n, F.col("conversion_rate"))).alias(f"_rate_{i}")
        for i, n in enumerate(C.PRODUCT_NAMES)])


def _new_top(profiles: DataFrame, affinity: DataFrame, k: int) -> DataFrame:
    """Profile rows with their top-k array of (rank key, ordinal, product,
    score) -- all 8 products scored and ranked inside the row."""
    j = S.with_vector(profiles.join(_segment_rates(affinity), "segment", "left"))
    cos = S.cosine_columns()
    structs = []
    for i, name in enumerate(C.PRODUCT_NAMES):
        aff = F.coalesce(F.col(f"_rate_{i}"), F.lit(0.0))
        score = cos[name] * C.NEW_CB_WEIGHT + aff * C.NEW_AFFINITY_WEIGHT
        structs.append(F.struct((-F.round(score, S.SCORE_KEY_DP)).alias("key"), F.lit(i).alias("ordinal"),
                                F.lit(name).alias("product_name"), score.alias("score")))
    keep = ["profile_id", "age", "income", "credit_score", "segment", *C.SHARE_COLUMNS]
    return j.select(*keep, F.slice(F.sort_array(F.array(*structs)), 1, k).alias("_top"))


def new_customer_scores(profiles: DataFrame, affinity: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """Top-k of all 8 products per profile: 0.7 x raw cosine + 0.3 x segment
    conversion rate (unknown segment -> 0).  Ties keep declaration order.
    Row-local after one join with the per-segment rate row."""
    keep = ["profile_id", "segment", "income", *C.SHARE_COLUMNS]
    return (_new_top(profiles, affinity, k).select(*keep, F.posexplode("_top").alias("pos", "s"))
            .select(*keep, (F.col("pos") + 1).cast("int").alias("rank"),
                    F.col("s.product_name").alias("product_name"), F.col("s.score").alias("score")))


def _new_answer(product, score, segment, travel, dining, rent, income) -> dict:
    pct = X.percent_number(score)
    return {
        "product": X.display_name(product),
        "emoji": X.emoji_for(product),
        "score": pct,
        "type": X.rec_type_new(pct, segment),
        "reason": X.explain_new(product, segment, travel, dining, rent, income),
    }


def new_customer_recs(profiles: DataFrame, affinity: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """Flat answer rows for new-customer profiles."""
    scored = new_customer_scores(profiles, affinity, k)
    a = _new_answer(F.col("product_name"), F.col("score"), F.col("segment"), F.col("travel_pct"),
                    F.col("dining_pct"), F.col("rent_pct"), F.col("income"))
    return scored.select("profile_id", "rank", "product_name", *[c.alias(n) for n, c in a.items()])


def new_customer_documents(profiles: DataFrame, affinity: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """Nested new-customer answer: summary + ordered recommendations + JSON.
    Built inside each profile row from its top-k array: no explode, no
    regrouping, no join."""
    top = _new_top(profiles, affinity, k)

    def answer(s, i):
        a = _new_answer(s["product_name"], s["score"], F.col("segment"), F.col("travel_pct"),
                        F.col("dining_pct"), F.col("rent_pct"), F.col("income"))
        return F.struct((i + 1).alias("rank"), *[c.alias(n) for n, c in a.items()])

    doc = top.select(
        "profile_id", F.lit("new").alias("customer_type"),
        F.struct(F.col("age"), X.currency_text("income").alias("income"), F.col("credit_score"),
                 X.display_name("segment").alias("segment")).alias("profile_summary"),
        F.transform("_top", answer).alias("recommendations"))
    return doc.withColumn("document", F.to_json(F.struct("customer_type", "profile_summary", "recommendations")))


def score_bands(answers: DataFrame) -> DataFrame:
    return answers.select("customer_id", "product_name", "score", X.score_band("score").alias("band"))
