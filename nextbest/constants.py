"""Domain constants.

FIXED VALUES — these must equal the values of the system being re-built for
results to match (product ids/names, spend-category order, product spending
profiles, weights, thresholds, labels and explanation texts).  They are data,
not logic, and are kept together here in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: product catalog (id, name, category, min_credit_score,
# min_income, target_segment) in declaration order P001..P008.
# ---------------------------------------------------------------------------
CATALOG_ROWS = [
    ("P001", "checking_account", "deposit", 580, 0, "all"),
    ("P002", "savings_account", "deposit", 580, 0, "all"),
    ("P003", "travel_credit_card", "credit_card", 700, 60000, "mid_career,high_net_worth"),
    ("P004", "cashback_credit_card", "credit_card", 640, 30000, "young_professional,family"),
    ("P005", "personal_loan", "loan", 640, 40000, "young_professional,mid_career"),
    ("P006", "home_loan", "loan", 680, 60000, "family,mid_career"),
    ("P007", "investment_fund", "investment", 680, 80000, "high_net_worth,near_retirement"),
    ("P008", "fixed_deposit", "investment", 620, 30000, "family,near_retirement"),
]

PRODUCT_IDS = [r[0] for r in CATALOG_ROWS]
PRODUCT_NAMES = [r[1] for r in CATALOG_ROWS]

# FIXED VALUES: ownership flag column of each product (P001..P008 order).
FLAG_COLUMNS = [
    "has_checking",
    "has_savings",
    "has_travel_card",
    "has_cashback_card",
    "has_personal_loan",
    "has_home_loan",
    "has_investment",
    "has_fixed_deposit",
]

# FIXED VALUES: customer segments.
SEGMENTS = ["young_professional", "mid_career", "family", "high_net_worth", "near_retirement"]

# FIXED VALUES: spend categories in feature-vector order.
SPEND_CATEGORIES = [
    "travel",
    "dining",
    "groceries",
    "rent",
    "shopping",
    "entertainment",
    "healthcare",
    "utilities",
]
SHARE_COLUMNS = [f"{c}_pct" for c in SPEND_CATEGORIES]

# FIXED VALUES: ideal spending profile per product, columns in SPEND_CATEGORIES order.
PRODUCT_PROFILES = {
    "checking_account": [0.1, 0.1, 0.2, 0.3, 0.1, 0.1, 0.05, 0.05],
    "savings_account": [0.1, 0.1, 0.2, 0.2, 0.1, 0.1, 0.1, 0.1],
    "travel_credit_card": [0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.02, 0.03],
    "cashback_credit_card": [0.1, 0.2, 0.3, 0.1, 0.2, 0.05, 0.02, 0.03],
    "personal_loan": [0.1, 0.1, 0.2, 0.3, 0.1, 0.05, 0.05, 0.1],
    "home_loan": [0.05, 0.1, 0.2, 0.4, 0.1, 0.05, 0.05, 0.05],
    "investment_fund": [0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1],
    "fixed_deposit": [0.1, 0.1, 0.2, 0.1, 0.1, 0.1, 0.1, 0.2],
}

# FIXED VALUES: emoji label per product, and the fallback label.
PRODUCT_EMOJIS = {
    "checking_account": "🏦",
    "savings_account": "💰",
    "travel_credit_card": "✈️",
    "cashback_credit_card": "💳",
    "personal_loan": "💵",
    "home_loan": "🏠",
    "investment_fund": "📈",
    "fixed_deposit": "🔒",
}
DEFAULT_EMOJI = "💼"

# FIXED VALUES: signal weights.
ALS_WEIGHT = 0.4
CB_WEIGHT = 0.4
AFFINITY_WEIGHT = 0.2
NEW_CB_WEIGHT = 0.7
NEW_AFFINITY_WEIGHT = 0.3

# FIXED VALUES: collaborative-filtering settings.
ALS_RANK = 10
ALS_MAX_ITER = 10
ALS_REG_PARAM = 0.1
ALS_SEED = 42
TRAIN_PERCENT = 80
TOP_K = 3

# FIXED VALUES: default spend shares of a new-customer profile.
PROFILE_DEFAULTS = {
    "travel_pct": 0.1,
    "dining_pct": 0.1,
    "groceries_pct": 0.2,
    "rent_pct": 0.2,
    "shopping_pct": 0.1,
    "entertainment_pct": 0.1,
    "healthcare_pct": 0.1,
    "utilities_pct": 0.1,
}

# FIXED VALUES: thresholds.
CROSS_SELL_MAX_PRODUCTS = 2  # num_products <= 2 -> cross-sell
UPSELL_SCORE_EXISTING = 50  # score > 50 -> upsell
UPSELL_SCORE_NEW = 70  # score > 70 and high_net_worth -> upsell
BAND_HIGH = 70
BAND_MID = 40

# FIXED VALUES: explanation texts for existing customers.  "{pct}" is the
# spend percentage with one decimal, "{segment}" the segment with spaces.
EXISTING_REASONS = {
    "travel_credit_card": ("travel_pct", "You spend {pct}% on travel — earn rewards on every trip!"),
    "cashback_credit_card": ("dining_pct", "You spend {pct}% on dining — earn cashback on purchases!"),
    "home_loan": ("rent_pct", "Based on your rent spending of {pct}% — consider owning instead!"),
    "personal_loan": (None, "Customers with your credit profile frequently use personal loans for financial flexibility"),
    "investment_fund": (None, "With your income level, growing wealth through investments is the next step"),
    "savings_account": (None, "Building an emergency fund is recommended for your financial profile"),
    "fixed_deposit": (None, "Secure your savings with guaranteed returns matching your risk profile"),
    "checking_account": (None, "100% of {segment} customers use a checking account"),
}
REASON_CB_DOMINANT = "Your spending behavior closely matches this product profile"
REASON_ALS_DOMINANT = "Customers with similar product ownership frequently choose this"
REASON_AFFINITY = "{rate}% of {segment} customers own this product"
REASON_DEFAULT = "Recommended based on your financial profile"

# FIXED VALUES: explanation texts for new customers.  Placeholders:
# {travel}, {dining}, {rent} one-decimal percents, {income} currency text,
# {segment} segment with spaces.
NEW_REASONS = {
    "travel_credit_card": "High travel spending ({travel}%) makes this ideal for maximizing rewards and premium benefits",
    "cashback_credit_card": "Your dining spend ({dining}%) means cashback rewards add up fast every month",
    "home_loan": "With {rent}% going to rent, owning a home could be more cost-effective long term",
    "personal_loan": "Customers with your credit profile use personal loans for smart financial flexibility",
    "investment_fund": "Your income level ({income}) makes diversified investments key for long-term wealth growth",
    "savings_account": "Building a 6-month emergency fund is the recommended next step for your profile",
    "fixed_deposit": "Lock in guaranteed returns — ideal for securing a portion of your savings safely",
    "checking_account": "A premium checking account supports high-value transactions and daily liquidity needs",
}
NEW_SEGMENT_REASONS = {
    "high_net_worth": {
        "investment_fund": "High net worth customers grow wealth through diversified investment portfolios",
        "checking_account": "Premium checking accounts offer exclusive benefits for high net worth clients",
        "fixed_deposit": "Secure high-yield fixed deposits are ideal for wealth preservation",
    },
    "young_professional": {
        "investment_fund": "Start investing early — even small amounts compound significantly over time",
        "travel_credit_card": "Your travel lifestyle ({travel}% spending) deserves premium travel rewards",
    },
    "family": {
        "home_loan": "With {rent}% going to rent, a home loan builds long-term family wealth",
        "fixed_deposit": "Secure your family's financial future with guaranteed fixed deposit returns",
    },
}
NEW_REASON_DEFAULT = "Recommended based on your {segment} profile"

# Recommendation type and band labels.
CROSS_SELL = "cross-sell"
UPSELL = "upsell"
BANDS = ("high", "mid", "low")
