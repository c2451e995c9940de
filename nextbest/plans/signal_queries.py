"""Registered signal queries: content (M7, M8, F7, W2, L4), stand-in
collaborative signal, hybrid merge/scale/blend/filter/top-k (J6, J8, J10, J11,
F8, F9, M9, M10, W3, A17, A19, A20) and ALS (M1-M6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nextbest import constants as C
from nextbest.operators import signals as S
from nextbest.plans.oracles import dbl, with_prelude
from nextbest.plans.registry import query

# ---------------------------------------------------------------------------
# oracle CTEs
# ---------------------------------------------------------------------------
_S = [f"s{i}" for i in range(len(C.SHARE_COLUMNS))]
_DOT = " + ".join(f"v.{s} * p.w_{c}" for s, c in zip(_S, C.SPEND_CATEGORIES))
_SQ = " + ".join(f"v.{s} * v.{s}" for s in _S)
_OWNED = ("COALESCE(CASE p.product_name "
          + " ".join(f"WHEN '{n}' THEN v.{f}" for n, f in zip(C.PRODUCT_NAMES, C.FLAG_COLUMNS))
          + " END, 0) = 1")
_CTX_OWNED = ("COALESCE(CASE m.product_name "
              + " ".join(f"WHEN '{n}' THEN f.{fl}" for n, fl in zip(C.PRODUCT_NAMES, C.FLAG_COLUMNS))
              + " END, 0) = 1")

SIGNAL_CTES = [
    ("o_vectors", "SELECT customer_id, "
     + ", ".join(f"COALESCE({c}, {dbl(0)}) AS {s}" for c, s in zip(C.SHARE_COLUMNS, _S))
     + ", " + ", ".join(C.FLAG_COLUMNS) + " FROM gold_customer_features"),
    ("o_content", f"""
SELECT v.customer_id, p.product_name, p.product_ordinal,
       CASE WHEN sqrt({_SQ}) = 0 THEN {dbl(0)} ELSE ({_DOT}) / (sqrt({_SQ}) * p.w_norm) END AS score,
       {_OWNED} AS owned
FROM o_vectors v CROSS JOIN product_profiles p"""),
    ("o_cb", """
SELECT customer_id, product_name, ROUND(score, 4) AS cb_score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY ROUND(score, 10) DESC, product_name) AS r
  FROM o_content WHERE NOT owned) t
WHERE r <= 3"""),
    ("o_seg_top", """
SELECT segment, product_name, ROUND(customers_with_product / total_customers, 4) AS als_score,
       ROW_NUMBER() OVER (PARTITION BY segment ORDER BY customers_with_product DESC, product_name) AS r
FROM gold_product_affinity"""),
    ("o_als", """
SELECT f.customer_id, t.product_name, t.als_score
FROM gold_customer_features f JOIN o_seg_top t ON f.segment = t.segment WHERE t.r <= 3"""),
    ("o_merged", """
SELECT COALESCE(a.customer_id, c.customer_id) AS customer_id, COALESCE(a.product_name, c.product_name) AS product_name,
       a.als_score, c.cb_score
FROM o_als a FULL OUTER JOIN o_cb c ON a.customer_id = c.customer_id AND a.product_name = c.product_name"""),
    ("o_ctx", f"""
SELECT m.customer_id, m.product_name, m.als_score, m.cb_score, f.segment,
       af.conversion_rate AS affinity_rate, COALESCE(af.conversion_rate, {dbl(0)}) AS affinity_score,
       {_CTX_OWNED} AS is_owned
FROM o_merged m
LEFT JOIN gold_customer_features f ON m.customer_id = f.customer_id
LEFT JOIN gold_product_affinity af ON af.segment = f.segment AND af.product_name = m.product_name"""),
    ("o_stats", """
SELECT MIN(als_score) AS als_lo, MAX(als_score) AS als_hi, MIN(cb_score) AS cb_lo, MAX(cb_score) AS cb_hi,
       MIN(affinity_score) AS aff_lo, MAX(affinity_score) AS aff_hi FROM o_ctx"""),
    ("o_norm", f"""
SELECT c.*,
  CASE WHEN als_score IS NULL THEN {dbl(0)}
       ELSE COALESCE((als_score - als_lo) / NULLIF(als_hi - als_lo, {dbl(0)}), {dbl(0)}) END AS als_score_norm,
  CASE WHEN cb_score IS NULL THEN {dbl(0)}
       ELSE COALESCE((cb_score - cb_lo) / NULLIF(cb_hi - cb_lo, {dbl(0)}), {dbl(0)}) END AS cb_score_norm,
  COALESCE((affinity_score - aff_lo) / NULLIF(aff_hi - aff_lo, {dbl(0)}), {dbl(0)}) AS affinity_score_norm
FROM o_ctx c CROSS JOIN o_stats"""),
    ("o_scored", f"""
SELECT *, {dbl(C.ALS_WEIGHT)} * als_score_norm + {dbl(C.CB_WEIGHT)} * cb_score_norm
          + {dbl(C.AFFINITY_WEIGHT)} * affinity_score_norm AS hybrid_score
FROM o_norm"""),
    ("o_hybrid_top3", """
SELECT * FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY ROUND(hybrid_score, 10) DESC, product_name) AS rank
  FROM o_scored WHERE NOT is_owned) t
WHERE rank <= 3"""),
]


def sig(select: str) -> str:
    return with_prelude(*SIGNAL_CTES, select=select)


_PUBLISHED_SQL = ("customer_id, product_name, als_score_norm, cb_score_norm, segment, affinity_score, "
                  "affinity_score_norm, hybrid_score")


# ---------------------------------------------------------------------------
# shared Spark building blocks
# ---------------------------------------------------------------------------
def _cb(m):
    return m.content_recommendations


def _als_standin(m):
    return m.standin_signal


def _scored(m):
    return S.hybrid_scores(_als_standin(m), _cb(m), m.gold_customer_features, m.gold_product_affinity, m.affinity_pairs)


# ---------------------------------------------------------------------------
# content signal
# ---------------------------------------------------------------------------
@query("customer_vectors", sig("SELECT customer_id, "
                               + ", ".join(f"{s} AS {c}" for s, c in zip(_S, C.SHARE_COLUMNS)) + " FROM o_vectors"))
def q_customer_vectors(m):
    return S.customer_vectors(m.gold_customer_features)


@query("cosine_scores", sig("SELECT customer_id, "
                            + ", ".join(f"MAX(CASE WHEN product_name = '{n}' THEN score END) AS {n}_score"
                                        for n in C.PRODUCT_NAMES)
                            + " FROM o_content GROUP BY customer_id"))
def q_cosine_scores(m):
    return S.cosine_wide(m.gold_customer_features)


@query("content_scores", sig("""
SELECT customer_id, product_name, score, ROUND(score, 4) AS cb_score, owned FROM o_content"""))
def q_content_scores(m):
    return (S.content_scores(m.gold_customer_features)
            .select("customer_id", "product_name", "score", F.round("score", 4).alias("cb_score"), "owned"))


@query("customer_score_profile", sig("""
SELECT customer_id, product_name, ROUND(score, 4) AS cb_score,
       CAST(ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY ROUND(score, 10) DESC, product_name) AS INTEGER)
           AS score_rank
FROM o_content"""))
def q_customer_score_profile(m):
    """Every customer's 8 products ranked by cosine (the per-customer sample view, batched)."""
    return (S.content_scores(m.gold_customer_features)
            .select("customer_id", "product_name", F.round("score", 4).alias("cb_score"),
                    F.col("score_rank").cast("int").alias("score_rank")))


@query("content_top3", sig("SELECT customer_id, product_name, cb_score FROM o_cb"))
def q_content_top3(m):
    return _cb(m)


@query("cb_run_metrics", sig("""
SELECT CAST(COUNT(*) AS BIGINT) AS total_recommendations,
       CAST(COUNT(DISTINCT customer_id) AS BIGINT) AS unique_customers FROM o_cb"""))
def q_cb_run_metrics(m):
    return _cb(m).agg(F.count(F.lit(1)).alias("total_recommendations"),
                      F.countDistinct("customer_id").alias("unique_customers"))


@query("minmax_scores", sig(f"""
SELECT customer_id, product_name, cb_score,
       COALESCE((cb_score - lo) / NULLIF(hi - lo, {dbl(0)}), {dbl(0)}) AS cb_score_norm
FROM o_cb CROSS JOIN (SELECT MIN(cb_score) AS lo, MAX(cb_score) AS hi FROM o_cb) s"""))
def q_minmax_scores(m):
    return S.min_max(_cb(m), "cb_score", "cb_score_norm")


@query("cb_score_range", sig(f"""
SELECT MIN(cb_score) AS before_min, MAX(cb_score) AS before_max,
       MIN(cb_score_norm) AS after_min, MAX(cb_score_norm) AS after_max FROM (
  SELECT cb_score, COALESCE((cb_score - lo) / NULLIF(hi - lo, {dbl(0)}), {dbl(0)}) AS cb_score_norm
  FROM o_cb CROSS JOIN (SELECT MIN(cb_score) AS lo, MAX(cb_score) AS hi FROM o_cb) s) t"""))
def q_cb_score_range(m):
    scaled = S.min_max(_cb(m), "cb_score", "cb_score_norm")
    return scaled.agg(F.min("cb_score").alias("before_min"), F.max("cb_score").alias("before_max"),
                      F.min("cb_score_norm").alias("after_min"), F.max("cb_score_norm").alias("after_max"))


# ---------------------------------------------------------------------------
# stand-in collaborative signal and hybrid
# ---------------------------------------------------------------------------
@query("segment_popularity_signal", sig("SELECT customer_id, product_name, als_score FROM o_als"))
def q_segment_popularity_signal(m):
    return _als_standin(m)


@query("merge_signals", sig("SELECT customer_id, product_name, als_score_norm, cb_score_norm FROM o_norm"))
def q_merge_signals(m):
    return _scored(m).select("customer_id", "product_name", "als_score_norm", "cb_score_norm")


@query("affinity_lookup", sig("""
SELECT customer_id, product_name, segment, affinity_score FROM o_ctx"""))
def q_affinity_lookup(m):
    return _scored(m).select("customer_id", "product_name", "segment", "affinity_score")


@query("normalised_signals", sig("""
SELECT customer_id, product_name, als_score_norm, cb_score_norm, affinity_score_norm FROM o_norm"""))
def q_normalised_signals(m):
    return _scored(m).select("customer_id", "product_name", "als_score_norm", "cb_score_norm", "affinity_score_norm")


@query("hybrid_scores", sig(f"SELECT {_PUBLISHED_SQL}, is_owned FROM o_scored"))
def q_hybrid_scores(m):
    return _scored(m).select(*S.PUBLISHED, "is_owned")


@query("ownership_flagged", sig("SELECT customer_id, product_name, is_owned FROM o_scored"))
def q_ownership_flagged(m):
    return _scored(m).select("customer_id", "product_name", "is_owned")


@query("unowned_candidates", sig("SELECT customer_id, product_name, hybrid_score FROM o_scored WHERE NOT is_owned"))
def q_unowned_candidates(m):
    return _scored(m).where(~F.col("is_owned")).select("customer_id", "product_name", "hybrid_score")


@query("hybrid_top3", sig(f"SELECT {_PUBLISHED_SQL}, CAST(rank AS INTEGER) AS rank FROM o_hybrid_top3"))
def q_hybrid_top3(m):
    return m.checked_hybrid_recommendations


@query("hybrid_run_metrics", sig("""
SELECT CAST(COUNT(*) AS BIGINT) AS total_recommendations,
       CAST(COUNT(DISTINCT customer_id) AS BIGINT) AS unique_customers FROM o_hybrid_top3"""))
def q_hybrid_run_metrics(m):
    return m.run_metrics("checked_hybrid_recommendations")


@query("affinity_pairs", with_prelude(select="""
SELECT CAST(COUNT(*) AS BIGINT) AS pairs FROM (SELECT DISTINCT segment, product_name FROM gold_product_affinity) t"""))
def q_affinity_pairs(m):
    return (m.gold_product_affinity.select("segment", "product_name").dropDuplicates()
            .agg(F.count(F.lit(1)).alias("pairs")))


# ---------------------------------------------------------------------------
# collaborative filtering (ALS)
# ---------------------------------------------------------------------------
_INDEX_SQL = "SELECT customer_id, CAST(ROW_NUMBER() OVER (ORDER BY customer_id) - 1 AS INTEGER) AS user_id " \
             "FROM (SELECT DISTINCT customer_id FROM gold_user_item_matrix) t"
_INTERACTIONS_SQL = f"""
SELECT x.customer_id, l.product_id, x.product_name, i.user_id, CAST(l.product_ordinal AS INTEGER) AS item_id,
       CAST(1.0 AS FLOAT) AS rating
FROM (UNPIVOT gold_user_item_matrix ON {', '.join(C.PRODUCT_NAMES)} INTO NAME product_name VALUE owned) x
JOIN product_labels l ON l.product_name = x.product_name
JOIN ({_INDEX_SQL}) i ON i.customer_id = x.customer_id
WHERE x.owned = 1"""


@query("customer_index", with_prelude(select=_INDEX_SQL))
def q_customer_index(m):
    return m.customer_index


@query("interactions_long", with_prelude(select=_INTERACTIONS_SQL))
def q_interactions_long(m):
    return S.interactions(m.gold_user_item_matrix, m.customer_index)


@query("interaction_split", with_prelude(select=f"""
SELECT customer_id, product_name, user_id, item_id,
       CAST(('0x' || substr(md5(customer_id || '|' || product_id || '|{C.ALS_SEED}'), 1, 8)) AS BIGINT) % 100
           < {C.TRAIN_PERCENT} AS is_train
FROM ({_INTERACTIONS_SQL}) t"""))
def q_interaction_split(m):
    pairs = S.interactions(m.gold_user_item_matrix, m.customer_index)
    return pairs.select("customer_id", "product_name", "user_id", "item_id", S.split_flag().alias("is_train"))


@query("als_top3")
def q_als_top3(m):
    """Implicit ALS top-3 per trained customer (rows-only check: iterative fit)."""
    return m.als_recommendations


@query("hybrid_recs_als")
def q_hybrid_recs_als(m):
    """The hybrid recommendations on the real ALS signal (rows-only check)."""
    return m.hybrid_recommendations


@query("als_run_metrics", with_prelude(select=f"""
WITH train AS (SELECT * FROM ({_INTERACTIONS_SQL}) t
               WHERE CAST(('0x' || substr(md5(customer_id || '|' || product_id || '|{C.ALS_SEED}'), 1, 8)) AS BIGINT)
                     % 100 < {C.TRAIN_PERCENT})
SELECT (SELECT CAST(COUNT(*) AS BIGINT) FROM train) AS training_rows,
       (SELECT CAST(COUNT(DISTINCT customer_id) * {C.TOP_K} AS BIGINT) FROM train) AS total_recommendations,
       (SELECT CAST(COUNT(DISTINCT customer_id) AS BIGINT) FROM train) AS unique_customers"""))
def q_als_run_metrics(m):
    """Training rows, recommendations and customers of the ALS run (every
    trained customer gets k of the 8 products)."""
    pairs = S.owned_pairs(m.gold_user_item_matrix)
    train = pairs.where(S.split_flag()).agg(F.count(F.lit(1)).alias("training_rows"))
    run = m.run_metrics("als_recommendations")
    return train.select("training_rows", *[run.select(c).scalar().alias(c) for c in run.columns])
