"""Column names, feature sets and other fixed values of the listing data model."""

from pyspark.sql import types as T

# The raw listing columns, all nullable strings.
RAW_COLUMNS = [
    "product_id",
    "product_name",
    "category",
    "discounted_price",
    "actual_price",
    "discount_percentage",
    "rating",
    "rating_count",
    "about_product",
    "user_id",
    "user_name",
    "review_id",
    "review_title",
    "review_content",
    "img_link",
    "product_link",
]
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

# Feature sets, in their documented order.
NUMERIC = ["actual_price", "discounted_price", "discount_percentage", "rating", "rating_count"]
PRICE_COLUMNS = ["actual_price", "discounted_price"]
COUNT_COLUMNS = ["rating", "rating_count", "discount_percentage"]
DISCOUNT_FEATURES = ["actual_price", "discounted_price", "rating", "rating_count"]
DISCOUNT_TARGET = "discount_percentage"
PRICE_FEATURES = ["actual_price", "rating", "rating_count", "discount_percentage"]
PRICE_TARGET = "discounted_price"

TASKS = {
    "discount": (DISCOUNT_FEATURES, DISCOUNT_TARGET),
    "price": (PRICE_FEATURES, PRICE_TARGET),
}

KEY = "product_id"
TOP_CATEGORY = "top_category"

# Text that a CSV reader must take as a missing value.
NULL_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Readable feature names.
FEATURE_LABELS = {
    "actual_price": "Actual Price (MRP)",
    "discounted_price": "Discounted Price",
    "discount_percentage": "Discount %",
    "rating": "Rating",
    "rating_count": "Rating Count",
    "category_label": "Category (Label)",
    "category_freq": "Category (Frequency)",
    "category_target": "Category (Target)",
}

# One context sentence per feature.
FEATURE_CONTEXT = {
    "actual_price": "Premium products (higher MRP) are often discounted more aggressively to attract buyers.",
    "discounted_price": "The selling price naturally moves with the discount — a lower selling price relative to MRP means a bigger discount.",
    "rating": "Customer satisfaction and discount levels are linked — either high-rated products attract larger discounts, or discounts drive more purchases and reviews.",
    "rating_count": "More popular products (more reviews) may face different pricing dynamics than niche ones.",
    "category_label": "Integer codes are arbitrary alphabetical assignments — tree models discover meaningful splits regardless of ordering, but linear models may not extract full signal.",
    "category_freq": "Higher values mean a more-populated category. Captures how 'mainstream' a product type is within this dataset.",
    "category_target": "Directly encodes average pricing behaviour per category — the most predictive single-column representation, but uses the target variable in its construction.",
}

# Feature names used for component loadings.
LOADING_LABELS = {
    "actual_price": "Actual Price",
    "discounted_price": "Discounted Price",
    "discount_percentage": "Discount %",
    "rating": "Rating",
    "rating_count": "Rating Count",
}

# The three example listings offered for scoring.
SCENARIOS = [
    ("Budget item", 299.0, 149.0, 3.8, 500.0),
    ("Mid-range", 1999.0, 1199.0, 4.2, 5000.0),
    ("Premium", 15000.0, 9999.0, 4.5, 20000.0),
]

# Accepted input ranges per scoring task, inclusive.
INPUT_BOUNDS = {
    "discount": {
        "actual_price": (10.0, 200000.0),
        "discounted_price": (1.0, 200000.0),
        "rating": (1.0, 5.0),
        "rating_count": (1.0, 500000.0),
    },
    "price": {
        "actual_price": (10.0, 200000.0),
        "discount_percentage": (0.0, 95.0),
        "rating": (1.0, 5.0),
        "rating_count": (1.0, 500000.0),
    },
}
