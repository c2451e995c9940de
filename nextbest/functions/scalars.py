"""Scalar Column expressions.

All of them are built-in Spark expressions (JVM side, whole-stage codegen);
no Python UDFs.  Each takes and returns ``Column``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from nextbest import constants as C

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, n: int) -> Column:
    """ROUND(x, n) with half-up ties (Spark's and SQL's ROUND)."""
    return F.round(col(c), n)


def safe_ratio(num, den) -> Column:
    """``num / NULLIF(den, 0)``: zero or NULL denominators give NULL (no error)."""
    return col(num) / F.nullif(col(den), F.lit(0))


def flag_when(cond: Column, value=1, otherwise=0) -> Column:
    return F.when(cond, F.lit(value)).otherwise(F.lit(otherwise))


def display_name(c) -> Column:
    """``checking_account`` -> ``Checking Account``."""
    return F.initcap(F.regexp_replace(col(c), "_", " "))


def spaced(c) -> Column:
    """``high_net_worth`` -> ``high net worth``."""
    return F.regexp_replace(col(c), "_", " ")


def currency_text(c) -> Column:
    """``$58,024``: truncated to a whole number, thousands separators."""
    return F.concat(F.lit("$"), F.format_number(col(c).cast("bigint"), 0))


def percent_number(c) -> Column:
    """Share (0..1) -> percent rounded to one decimal; NULL share counts as 0."""
    return F.round(F.coalesce(col(c), F.lit(0.0)) * 100, 1)


def percent_text(c) -> Column:
    """Share -> ``59.6%``."""
    return F.concat(percent_number(c).cast("string"), F.lit("%"))


def parse_percent(c) -> Column:
    """``59.6%`` -> 59.6."""
    return F.regexp_replace(col(c), "%", "").cast("double")


def percent_int(c) -> Column:
    """``int(rate * 100)``: truncation toward zero (0.29 -> 28)."""
    return (col(c) * 100).cast("int")


def rec_type_existing(num_products, score_pct) -> Column:
    """<= 2 products -> cross-sell; else score > 50 -> upsell; else cross-sell.
    A NULL product count fails the first test and falls to the score test."""
    n = col(num_products)
    s = col(score_pct)
    return (F.when(n <= C.CROSS_SELL_MAX_PRODUCTS, F.lit(C.CROSS_SELL))
            .when(s > C.UPSELL_SCORE_EXISTING, F.lit(C.UPSELL))
            .otherwise(F.lit(C.CROSS_SELL)))


def rec_type_new(score_pct, segment) -> Column:
    return (F.when((col(score_pct) > C.UPSELL_SCORE_NEW) & (col(segment) == "high_net_worth"), F.lit(C.UPSELL))
            .otherwise(F.lit(C.CROSS_SELL)))


def score_band(score_pct) -> Column:
    s = col(score_pct)
    high, mid, low = C.BANDS
    return F.when(s > C.BAND_HIGH, F.lit(high)).when(s > C.BAND_MID, F.lit(mid)).otherwise(F.lit(low))


def emoji_for(product) -> Column:
    """Emoji label per product, the fallback label for unknown products."""
    p = col(product)
    expr = None
    for name, emoji in C.PRODUCT_EMOJIS.items():
        expr = (F.when(p == name, F.lit(emoji)) if expr is None else expr.when(p == name, F.lit(emoji)))
    return expr.otherwise(F.lit(C.DEFAULT_EMOJI))


def _fill(template: str, **parts: Column) -> Column:
    """``concat`` over a template with ``{name}`` placeholders."""
    pieces: list[Column] = []
    pos = 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            pieces.append(F.lit(template[pos:m.start()]))
        pieces.append(parts[m.group(1)])
        pos = m.end()
    if pos < len(template):
        pieces.append(F.lit(template[pos:]))
    return pieces[0] if len(pieces) == 1 else F.concat(*pieces)


def signal_reason(segment, als_norm, cb_norm, aff_norm, affinity_rate) -> Column:
    """The sentence of the dominant signal (strict ``>``); ties go to the
    segment-affinity sentence, or to the default one without an affinity row."""
    als, cb, aff = col(als_norm), col(cb_norm), col(aff_norm)
    seg = spaced(F.coalesce(col(segment), F.lit("")))
    return (F.when((cb > als) & (cb > aff), F.lit(C.REASON_CB_DOMINANT))
            .when((als > cb) & (als > aff), F.lit(C.REASON_ALS_DOMINANT))
            .when(col(affinity_rate).isNotNull(),
                  _fill(C.REASON_AFFINITY, rate=percent_int(affinity_rate).cast("string"), segment=seg))
            .otherwise(F.lit(C.REASON_DEFAULT)))


def explain_existing(product, segment, shares: dict, als_norm, cb_norm, aff_norm, affinity_rate) -> Column:
    """Reason text of an existing-customer recommendation.

    Product templates first; for products without a template the dominant
    signal decides (strict ``>``); ties go to the segment-affinity sentence,
    or to the default sentence when the segment has no affinity row.
    ``shares`` maps a share column name to its Column; ``affinity_rate`` is
    the (segment, product) conversion rate or NULL when absent.
    """
    p = col(product)
    seg = spaced(F.coalesce(col(segment), F.lit("")))
    expr = None
    for name, (share_col, template) in C.EXISTING_REASONS.items():
        parts = {"segment": seg}
        if share_col:
            parts["pct"] = percent_number(shares[share_col]).cast("string")
        text = _fill(template, **parts)
        expr = F.when(p == name, text) if expr is None else expr.when(p == name, text)
    return expr.otherwise(signal_reason(segment, als_norm, cb_norm, aff_norm, affinity_rate))


def explain_new(product, segment, travel_pct, dining_pct, rent_pct, income) -> Column:
    """Reason text of a new-customer recommendation: segment overrides first,
    then product templates, else the segment default sentence."""
    p = col(product)
    s = col(segment)
    parts = {
        "travel": percent_number(travel_pct).cast("string"),
        "dining": percent_number(dining_pct).cast("string"),
        "rent": percent_number(rent_pct).cast("string"),
        "income": currency_text(income),
        "segment": spaced(s),
    }
    expr = None
    for seg_name, overrides in C.NEW_SEGMENT_REASONS.items():
        for name, template in overrides.items():
            cond = (s == seg_name) & (p == name)
            text = _fill(template, **parts)
            expr = F.when(cond, text) if expr is None else expr.when(cond, text)
    for name, template in C.NEW_REASONS.items():
        expr = expr.when(p == name, _fill(template, **parts))
    return expr.otherwise(_fill(C.NEW_REASON_DEFAULT, **parts))
