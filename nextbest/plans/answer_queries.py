"""Registered answer queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from nextbest import constants as C
from nextbest.operators import answers as A
from nextbest.plans.oracles import dbl, with_prelude
from nextbest.plans.registry import query
from nextbest.plans.signal_queries import SIGNAL_CTES

_GIVEN = ["travel", "dining", "groceries", "rent", "shopping"]

# ---------------------------------------------------------------------------
# SQL text helpers for the oracles
# ---------------------------------------------------------------------------
_PH = re.compile(r"\{(\w+)\}")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_text(template: str, **parts: str) -> str:
    """A template with ``{name}`` placeholders as a SQL concatenation."""
    out, pos = [], 0
    for m in _PH.finditer(template):
        if m.start() > pos:
            out.append(_q(template[pos:m.start()]))
        out.append(f"({parts[m.group(1)]})")
        pos = m.end()
    if pos < len(template):
        out.append(_q(template[pos:]))
    return " || ".join(out)


def pct_sql(expr: str) -> str:
    return f"CAST(ROUND(COALESCE({expr}, {dbl(0)}) * 100, 1) AS VARCHAR)"


def display_sql(expr: str) -> str:
    return (f"array_to_string(list_transform(string_split(replace({expr}, '_', ' '), ' '), "
            "lambda w: upper(w[1]) || lower(w[2:])), ' ')")


def currency_sql(expr: str) -> str:
    return f"'$' || format('{{:,}}', CAST(trunc({expr}) AS BIGINT))"


def emoji_sql(expr: str, default: str = C.DEFAULT_EMOJI) -> str:
    whens = " ".join(f"WHEN {_q(n)} THEN {_q(e)}" for n, e in C.PRODUCT_EMOJIS.items())
    return f"CASE {expr} {whens} ELSE {_q(default)} END"


def _existing_reason_sql() -> str:
    seg = "replace(COALESCE(f.segment, ''), '_', ' ')"
    whens = []
    for name, (share, template) in C.EXISTING_REASONS.items():
        parts = {"segment": seg}
        if share:
            parts["pct"] = pct_sql(f"f.{share}")
        whens.append(f"WHEN {_q(name)} THEN {sql_text(template, **parts)}")
    fallback = (
        "CASE WHEN h.cb_score_norm > h.als_score_norm AND h.cb_score_norm > h.affinity_score_norm "
        f"THEN {_q(C.REASON_CB_DOMINANT)} "
        "WHEN h.als_score_norm > h.cb_score_norm AND h.als_score_norm > h.affinity_score_norm "
        f"THEN {_q(C.REASON_ALS_DOMINANT)} "
        "WHEN af.conversion_rate IS NOT NULL THEN "
        + sql_text(C.REASON_AFFINITY, rate="CAST(CAST(trunc(af.conversion_rate * 100) AS INTEGER) AS VARCHAR)",
                   segment=seg)
        + f" ELSE {_q(C.REASON_DEFAULT)} END")
    return f"CASE h.product_name {' '.join(whens)} ELSE {fallback} END"


_SCORE_PCT = "ROUND(h.hybrid_score * 100, 1)"
_EXISTING_TYPE = (f"CASE WHEN f.num_products <= {C.CROSS_SELL_MAX_PRODUCTS} THEN {_q(C.CROSS_SELL)} "
                  f"WHEN {_SCORE_PCT} > {C.UPSELL_SCORE_EXISTING} THEN {_q(C.UPSELL)} ELSE {_q(C.CROSS_SELL)} END")

ANSWER_CTES = [
    ("o_existing", f"""
SELECT h.customer_id, CAST(h.rank AS INTEGER) AS rank, h.product_name,
       {display_sql('h.product_name')} AS product, {emoji_sql('h.product_name')} AS emoji,
       {_SCORE_PCT} AS score, {_EXISTING_TYPE} AS type, {_existing_reason_sql()} AS reason
FROM o_hybrid_top3 h
JOIN gold_customer_features f ON f.customer_id = h.customer_id
LEFT JOIN gold_product_affinity af ON af.segment = f.segment AND af.product_name = h.product_name"""),
]


def ans(select: str) -> str:
    return with_prelude(*SIGNAL_CTES, *ANSWER_CTES, select=select)


# ---------------------------------------------------------------------------
# new-customer oracle CTEs
# ---------------------------------------------------------------------------
_TOTAL = " + ".join(_GIVEN)
_NEW_SQ = " + ".join(f"v.{c} * v.{c}" for c in C.SHARE_COLUMNS)
_NEW_DOT = " + ".join(f"v.{c} * p.w_{cat}" for c, cat in zip(C.SHARE_COLUMNS, C.SPEND_CATEGORIES))


def _new_reason_sql() -> str:
    parts = {"travel": pct_sql("s.travel_pct"), "dining": pct_sql("s.dining_pct"), "rent": pct_sql("s.rent_pct"),
             "income": currency_sql("s.income"), "segment": "replace(s.segment, '_', ' ')"}
    whens = []
    for seg, overrides in C.NEW_SEGMENT_REASONS.items():
        for name, template in overrides.items():
            whens.append(f"WHEN s.segment = {_q(seg)} AND s.product_name = {_q(name)} THEN {sql_text(template, **parts)}")
    for name, template in C.NEW_REASONS.items():
        whens.append(f"WHEN s.product_name = {_q(name)} THEN {sql_text(template, **parts)}")
    return f"CASE {' '.join(whens)} ELSE {sql_text(C.NEW_REASON_DEFAULT, **parts)} END"


NEW_CTES = [
    ("o_forms_checked", f"""
SELECT profile_id, {_TOTAL} AS total,
       CASE WHEN {_TOTAL} > 100 THEN 'rejected' WHEN {_TOTAL} = 100 THEN 'exact' ELSE 'remainder' END AS status,
       LEAST({_TOTAL}, 100) AS progress, GREATEST(100 - ({_TOTAL}), 0) AS remaining,
       GREATEST(({_TOTAL}) - 100, 0) AS over_by
FROM profile_forms"""),
    ("o_forms_completed", f"""
SELECT profile_id, age, income, credit_score, segment,
       {', '.join(f'{c} / 100 AS {c}_pct' for c in _GIVEN)},
       CAST(FLOOR(GREATEST(100 - ({_TOTAL}), 0) / 3) AS INTEGER) / 100 AS entertainment_pct,
       CAST(FLOOR(GREATEST(100 - ({_TOTAL}), 0) / 3) AS INTEGER) / 100 AS healthcare_pct,
       (GREATEST(100 - ({_TOTAL}), 0) - 2 * CAST(FLOOR(GREATEST(100 - ({_TOTAL}), 0) / 3) AS INTEGER)) / 100
           AS utilities_pct
FROM profile_forms"""),
    ("o_profiles", """
SELECT c.* FROM o_forms_completed c JOIN o_forms_checked k ON k.profile_id = c.profile_id
WHERE k.status <> 'rejected'"""),
    ("o_new_scored", f"""
SELECT v.profile_id, v.segment, v.income, v.travel_pct, v.dining_pct, v.rent_pct, p.product_name, p.product_ordinal,
       {dbl(C.NEW_CB_WEIGHT)} * (CASE WHEN sqrt({_NEW_SQ}) = 0 THEN {dbl(0)}
                                  ELSE ({_NEW_DOT}) / (sqrt({_NEW_SQ}) * p.w_norm) END)
       + {dbl(C.NEW_AFFINITY_WEIGHT)} * COALESCE(af.conversion_rate, {dbl(0)}) AS score
FROM o_profiles v CROSS JOIN product_profiles p
LEFT JOIN gold_product_affinity af ON af.segment = v.segment AND af.product_name = p.product_name"""),
    ("o_new_top3", """
SELECT * FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY profile_id ORDER BY ROUND(score, 10) DESC, product_ordinal)
                 AS INTEGER) AS rank
  FROM o_new_scored) t WHERE rank <= 3"""),
    ("o_new_recs", f"""
SELECT s.profile_id, s.rank, s.product_name, {display_sql('s.product_name')} AS product,
       {emoji_sql('s.product_name')} AS emoji, ROUND(s.score * 100, 1) AS score,
       CASE WHEN ROUND(s.score * 100, 1) > {C.UPSELL_SCORE_NEW} AND s.segment = 'high_net_worth'
            THEN {_q(C.UPSELL)} ELSE {_q(C.CROSS_SELL)} END AS type,
       {_new_reason_sql()} AS reason
FROM o_new_top3 s"""),
]


def new(select: str) -> str:
    return with_prelude(*NEW_CTES, select=select)


# ---------------------------------------------------------------------------
# Spark building blocks
# ---------------------------------------------------------------------------
def _hybrid(m):
    """The published (stand-in signal) hybrid recommendations table."""
    return m.checked_hybrid_recommendations


def _existing(m):
    return A.existing_customer_recs(m.gold_customer_features, _hybrid(m), m.gold_product_affinity, pairs=m.affinity_pairs)


def _profiles(m):
    return m.new_customer_profiles


def _new(m):
    return m.new_customer_recs


# ---------------------------------------------------------------------------
# existing customers
# ---------------------------------------------------------------------------
@query("formatted_profiles", with_prelude(select=f"""
SELECT customer_id, CAST(COALESCE(age, 0) AS INTEGER) AS age, {currency_sql('COALESCE(income, 0)')} AS income,
       CAST(COALESCE(credit_score, 0) AS INTEGER) AS credit_score, {display_sql("COALESCE(segment, '')")} AS segment,
       CAST(COALESCE(tenure_months, 0) AS INTEGER) AS tenure_months
FROM gold_customer_features"""))
def q_formatted_profiles(m):
    return A.formatted_profiles(m.gold_customer_features)


@query("spending_text", with_prelude(select="SELECT customer_id, "
                                     + ", ".join(f"{pct_sql(c + '_pct')} || '%' AS {c}" for c in _GIVEN)
                                     + ", " + ", ".join(f"ROUND(COALESCE({c}_pct, {dbl(0)}) * 100, 1) AS {c}_value"
                                                        for c in _GIVEN)
                                     + " FROM gold_customer_features"))
def q_spending_text(m):
    """Spending texts and their parsed-back values (the page reads them back)."""
    from nextbest.functions.scalars import parse_percent
    t = A.spending_text(m.gold_customer_features)
    return t.select("customer_id", *_GIVEN, *[parse_percent(c).alias(f"{c}_value") for c in _GIVEN])


@query("current_products", with_prelude(select="SELECT customer_id, list_filter(list_value("
                                        + ", ".join(
                                            f"CASE WHEN {fl} = 1 THEN "
                                            f"{_q(C.PRODUCT_EMOJIS[n] + ' ' + n.replace('_', ' ').title())} END"
                                            for n, fl in zip(C.PRODUCT_NAMES, C.FLAG_COLUMNS))
                                        + "), lambda x: x IS NOT NULL) AS current_products FROM gold_customer_features"))
def q_current_products(m):
    return A.current_products(m.gold_customer_features)


@query("existing_customer_recs", ans("SELECT * FROM o_existing"))
def q_existing_customer_recs(m):
    return _existing(m)


@query("explain_existing", ans("SELECT customer_id, rank, reason FROM o_existing"))
def q_explain_existing(m):
    return _existing(m).select("customer_id", "rank", "reason")


@query("explain_fallback", ans(f"""
SELECT h.customer_id, h.product_name,
  CASE WHEN h.cb_score_norm > h.als_score_norm AND h.cb_score_norm > h.affinity_score_norm THEN {_q(C.REASON_CB_DOMINANT)}
       WHEN h.als_score_norm > h.cb_score_norm AND h.als_score_norm > h.affinity_score_norm THEN {_q(C.REASON_ALS_DOMINANT)}
       WHEN af.conversion_rate IS NOT NULL THEN {sql_text(C.REASON_AFFINITY,
           rate="CAST(CAST(trunc(af.conversion_rate * 100) AS INTEGER) AS VARCHAR)",
           segment="replace(COALESCE(f.segment, ''), '_', ' ')")}
       ELSE {_q(C.REASON_DEFAULT)} END AS reason
FROM o_hybrid_top3 h
LEFT JOIN gold_customer_features f ON f.customer_id = h.customer_id
LEFT JOIN gold_product_affinity af ON af.segment = f.segment AND af.product_name = h.product_name"""))
def q_explain_fallback(m):
    """Signal-dominance sentence of every recommendation (the fallback text)."""
    return A.signal_reasons(_hybrid(m), m.gold_customer_features, m.gold_product_affinity, m.affinity_pairs)


@query("score_bands", ans(f"""
SELECT customer_id, product_name, score,
       CASE WHEN score > {C.BAND_HIGH} THEN 'high' WHEN score > {C.BAND_MID} THEN 'mid' ELSE 'low' END AS band
FROM o_existing"""))
def q_score_bands(m):
    return A.score_bands(_existing(m))


_REQUESTS_SQL = """
SELECT customer_id FROM silver_customers UNION SELECT customer_id FROM silver_transactions
UNION SELECT customer_id FROM silver_products_held"""


@query("batch_lookup", ans(f"""
SELECT r.customer_id,
       CASE WHEN k.customer_id IS NULL THEN 'customer_not_found'
            WHEN c.n IS NULL THEN 'no_recommendations' ELSE 'ok' END AS status,
       CAST(COALESCE(c.n, 0) AS BIGINT) AS recommendations
FROM ({_REQUESTS_SQL}) r
LEFT JOIN (SELECT DISTINCT customer_id FROM gold_customer_features) k ON k.customer_id = r.customer_id
LEFT JOIN (SELECT customer_id, COUNT(*) AS n FROM o_existing GROUP BY customer_id) c ON c.customer_id = r.customer_id"""))
def q_batch_lookup(m):
    """Every id referenced by the customer, transaction or holding tables,
    answered in one job."""
    requests = (m.silver_customers.select("customer_id")
                .unionByName(m.silver_transactions.select("customer_id"))
                .unionByName(m.silver_products_held.select("customer_id")))
    return A.lookup_customers(requests, m.gold_customer_features, _existing(m))


_ASKED_SQL = """SELECT customer_id FROM silver_customers WHERE customer_id LIKE '%77'
UNION SELECT replace(customer_id, 'C_', 'X_') FROM silver_customers WHERE customer_id LIKE '%77'"""


@query("pruned_lookup", ans(f"""
SELECT r.customer_id,
       CASE WHEN k.customer_id IS NULL THEN 'customer_not_found'
            WHEN c.n IS NULL THEN 'no_recommendations' ELSE 'ok' END AS status,
       CAST(COALESCE(c.n, 0) AS BIGINT) AS recommendations
FROM ({_ASKED_SQL}) r
LEFT JOIN (SELECT DISTINCT customer_id FROM gold_customer_features) k ON k.customer_id = r.customer_id
LEFT JOIN (SELECT customer_id, COUNT(*) AS n FROM o_existing GROUP BY customer_id) c ON c.customer_id = r.customer_id"""))
def q_pruned_lookup(m):
    """A hundredth of the customers, and as many ids that nobody has, looked up in the published tables."""
    some = m.silver_customers.where(F.col("customer_id").like("%77")).select("customer_id")
    requests = some.unionByName(some.select(F.replace("customer_id", F.lit("C_"), F.lit("X_")).alias("customer_id")))
    return A.lookup_published(requests, m.published_features, m.published_answers)


_REC_STRUCT = "{'rank': rank, 'product': product, 'emoji': emoji, 'score': score, 'type': type, 'reason': reason}"
_LABELS = "list_filter([" + ", ".join(
    f"CASE WHEN {fl} = 1 THEN {_q(C.PRODUCT_EMOJIS[n] + ' ' + n.replace('_', ' ').title())} END"
    for n, fl in zip(C.PRODUCT_NAMES, C.FLAG_COLUMNS)) + "], lambda x: x IS NOT NULL)"


@query("existing_customer_documents", ans(f"""
SELECT customer_id, CAST(to_json({{
  'customer_id': customer_id,
  'profile': {{'age': CAST(COALESCE(age, 0) AS INTEGER), 'income': {currency_sql('COALESCE(income, 0)')},
               'credit_score': CAST(COALESCE(credit_score, 0) AS INTEGER), 'segment': {display_sql("COALESCE(segment, '')")},
               'tenure_months': CAST(COALESCE(tenure_months, 0) AS INTEGER)}},
  'spending': {{{', '.join(f"'{c}': {pct_sql(c + '_pct')} || '%'" for c in _GIVEN)}}},
  'current_products': {_LABELS},
  'recommendations': recommendations}}) AS VARCHAR) AS document
FROM gold_customer_features
JOIN (SELECT customer_id, list({_REC_STRUCT} ORDER BY rank) AS recommendations FROM o_existing GROUP BY customer_id) USING (customer_id)"""))
def q_existing_customer_documents(m):
    """The nested answer document of every customer, as JSON."""
    return A.existing_customer_documents(m.gold_customer_features, _existing(m)).select("customer_id", "document")


# ---------------------------------------------------------------------------
# profile intake and new customers
# ---------------------------------------------------------------------------
@query("validate_profiles", new("SELECT * FROM o_forms_checked"))
def q_validate_profiles(m):
    return A.validate_profiles(m.profile_forms)


@query("complete_profiles", new("SELECT * FROM o_forms_completed"))
def q_complete_profiles(m):
    return A.complete_profiles(m.profile_forms)


@query("default_profiles", new("SELECT profile_id, age, income, credit_score, segment, "
                               + ", ".join(f"{c} / 100 AS {c}_pct" for c in _GIVEN) + ", "
                               + ", ".join(f"{dbl(C.PROFILE_DEFAULTS[c + '_pct'])} AS {c}_pct"
                                           for c in ("entertainment", "healthcare", "utilities"))
                               + ", CASE WHEN age IS NULL OR income IS NULL OR credit_score IS NULL OR segment IS NULL "
                                 "THEN 'missing_required' ELSE 'ok' END AS status FROM profile_forms"))
def q_default_profiles(m):
    """Profiles sent with only the five form shares: the other three take
    their defaults."""
    raw = m.profile_forms.select("profile_id", "age", "income", "credit_score", "segment",
                                 *[(F.col(c) / 100).alias(f"{c}_pct") for c in _GIVEN])
    return A.default_profiles(raw)


@query("new_customer_top3", new("SELECT profile_id, rank, product_name, score FROM o_new_top3"))
def q_new_customer_top3(m):
    return A.new_customer_scores(_profiles(m), m.gold_product_affinity).select(
        "profile_id", "rank", "product_name", "score")


@query("new_customer_recs", new("SELECT * FROM o_new_recs"))
def q_new_customer_recs(m):
    return _new(m)


@query("explain_new", new("SELECT profile_id, rank, reason FROM o_new_recs"))
def q_explain_new(m):
    return _new(m).select("profile_id", "rank", "reason")


@query("new_customer_documents", new(f"""
SELECT profile_id, CAST(to_json({{
  'customer_type': 'new',
  'profile_summary': {{'age': age, 'income': {currency_sql('income')}, 'credit_score': credit_score, 'segment': {display_sql('segment')}}},
  'recommendations': recommendations}}) AS VARCHAR) AS document
FROM o_profiles
JOIN (SELECT profile_id, list({_REC_STRUCT} ORDER BY rank) AS recommendations FROM o_new_recs GROUP BY profile_id) USING (profile_id)"""))
def q_new_customer_documents(m):
    """The nested answer document of every new-customer profile, as JSON."""
    return A.new_customer_documents(_profiles(m), m.gold_product_affinity).select("profile_id", "document")


@query("display_names", with_prelude(select=f"""
SELECT segment, product_name, {display_sql('segment')} AS segment_display, {display_sql('product_name')} AS product_display
FROM gold_product_affinity"""))
def q_display_names(m):
    from nextbest.functions.scalars import display_name
    return m.gold_product_affinity.select("segment", "product_name", display_name("segment").alias("segment_display"),
                                          display_name("product_name").alias("product_display"))

