"""Fixed values.

Everything in this module must equal the values the original solution uses,
or results differ.  They are stated plainly, in their natural order.
"""

# --- fixed values: the 31 master tags (30 tags plus "na" for a missing tag
# list), in the order of the flag vector -------------------------------------
MASTER_TAGS = [
    "animals",
    "biz durable asset",
    "eco-friendly",
    "elderly",
    "fabrics",
    "female education",
    "first loan",
    "health and sanitation",
    "job creator",
    "na",
    "orphan",
    "parent",
    "refugee",
    "repair renew replace",
    "repeat borrower",
    "schooling",
    "single",
    "single parent",
    "supporting family",
    "sustainable ag",
    "technology",
    "trees",
    "unique",
    "us black-owned business",
    "us immigrant",
    "user_favorite",
    "vegan",
    "volunteer_like",
    "volunteer_pick",
    "widowed",
    "woman-owned business",
]

# Tag assigned to a row without tags (before lower-casing).
MISSING_TAGS = "NA"

# --- fixed values: currencies whose stated amount may override the model ---
TRUSTED_CURRENCIES = [
    "PHP", "KES", "UGX", "INR", "PKR", "KGS", "IDR", "TJS", "KHR", "JOD", "HNL", "USD",
]

# --- fixed values: text normalisation.  The texts carry escape sequences as
# literal characters (a backslash followed by letters), not the control
# characters themselves.  Applied in this order, literally. --------------------
ESCAPE_REPLACEMENTS = [
    ("\\r", " "),
    ("\\n", " "),
    ("\\u2028", " "),
    ("\\t", " "),
    ("\\xa0", " "),
    ("\\u200b", " "),
    ("\\xad", ""),
    ("\\u2060", ""),
    ("\\u200e", " "),
    ("\\u200f", " "),
    ("\\\\", " "),
    ("\\'", "'"),
]

# --- fixed values: tokens that a default CSV reader turns into null ---------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- fixed values: category variables --------------------------------------
# Composite categories: name -> parts joined with " > ".
COMPOSITES = {
    "SECTOR_NAME > ACTIVITY_NAME": ["SECTOR_NAME", "ACTIVITY_NAME"],
    "COUNTRY_CODE > COUNTRY_NAME": ["COUNTRY_CODE", "COUNTRY_NAME"],
    "COUNTRY_CODE > COUNTRY_NAME > TOWN_NAME": ["COUNTRY_CODE", "COUNTRY_NAME", "TOWN_NAME"],
    "CURRENCY_POLICY > CURRENCY_EXCHANGE_COVERAGE_RATE": [
        "CURRENCY_POLICY", "CURRENCY_EXCHANGE_COVERAGE_RATE"],
}

# The ten category variables of the first model family, in dictionary order.
CATEGORY_VARIABLES_10 = [
    "ORIGINAL_LANGUAGE",
    "SECTOR_NAME",
    "SECTOR_NAME > ACTIVITY_NAME",
    "COUNTRY_CODE > COUNTRY_NAME",
    "COUNTRY_CODE > COUNTRY_NAME > TOWN_NAME",
    "CURRENCY_POLICY",
    "CURRENCY_EXCHANGE_COVERAGE_RATE",
    "CURRENCY",
    "REPAYMENT_INTERVAL",
    "DISTRIBUTION_MODEL",
]

# The nine category variables of the later family (policy and rate merged).
CATEGORY_VARIABLES_9 = [
    "ORIGINAL_LANGUAGE",
    "SECTOR_NAME",
    "SECTOR_NAME > ACTIVITY_NAME",
    "COUNTRY_CODE > COUNTRY_NAME",
    "COUNTRY_CODE > COUNTRY_NAME > TOWN_NAME",
    "CURRENCY_POLICY > CURRENCY_EXCHANGE_COVERAGE_RATE",
    "CURRENCY",
    "REPAYMENT_INTERVAL",
    "DISTRIBUTION_MODEL",
]

# Text a missing number becomes when cast to text before joining.
NULL_NUMBER_TEXT = "nan"

# --- fixed values: stated-amount search --------------------------------------
# Number forms, each tried with the currency code before it (then a space)
# and after it (with a space before the number), in this order; the first
# form that matches at a position wins.
AMOUNT_NUMBER_FORMS = [
    "[0-9]{1,3} ?, ?[0-9]{3} ?, ?[0-9]{3}",
    "[0-9]{1,3} ?, ?[0-9]{3}",
    "[0-9]{1,9}",
    r"[0-9]{1,3} ?, ?[0-9]{3} ?, ?[0-9]{3}\.[0-9]{2}",
    r"[0-9]{1,3} ?, ?[0-9]{3}\.[0-9]{2}",
    r"[0-9]{1,9}\.[0-9]{2}",
]

# Loans newer than this id are the base of the exchange-rate median.
RECENT_LOAN_ID = 1800000

# Outputs are kept for these training epochs (1-based).
KEPT_EPOCHS = [8, 9, 10]

# Holdout split: 80 % train.
TRAIN_FRACTION = 0.8

# Density-ratio weights are bounded to [0, 50].
WEIGHT_UPPER_BOUND = 50.0

# Distance quantile used as the kernel parameter.
KERNEL_DISTANCE_QUANTILE = 0.01

# Step metrics are reported on every 10th step.
REPORT_EVERY = 10
