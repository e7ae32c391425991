"""Raw listings to typed listings: one narrow stage, no shuffle."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceloom.functions.cleaning import digits_to_double, missing_to_null, price_to_double, top_level
from priceloom.schema import COUNT_COLUMNS, NUMERIC, PRICE_COLUMNS, TASKS, TOP_CATEGORY


def normalise_nulls(df: DataFrame) -> DataFrame:
    """Replace missing-value text by null in every string column."""
    return df.withColumns({name: missing_to_null(name) for name, kind in df.dtypes if kind == "string"})


def parse_numbers(df: DataFrame, strict: bool = False) -> DataFrame:
    """Parse the five numeric columns in place.

    The parsed values pass through a one-row generator, through which the optimizer moves no
    filter: a later null check reads them instead of parsing every text a second time.
    """
    parsed = {c: price_to_double(c, strict) for c in PRICE_COLUMNS}
    parsed |= {c: digits_to_double(c, strict) for c in COUNT_COLUMNS}
    others = [c for c in df.columns if c not in parsed]
    return df.withColumns(parsed).select(*others, F.inline(F.array(F.struct(*parsed)))).select(*df.columns)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with a null or NaN in any of the five numeric columns."""
    return df.na.drop(subset=NUMERIC)


def clean_listings(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Typed listings: five non-null doubles, all other columns unchanged."""
    return raw.transform(normalise_nulls).transform(parse_numbers, strict).transform(drop_incomplete)


def rejected_counts(raw: DataFrame) -> DataFrame:
    """How many rows cleaning drops, and how many lack each numeric column."""
    parsed = raw.transform(normalise_nulls).transform(parse_numbers)
    gaps = {c: F.col(c).isNull() | F.isnan(c) for c in NUMERIC}
    any_gap = F.array_contains(F.array(*gaps.values()), True)
    return parsed.agg(
        F.count("*").alias("rows_read"),
        F.count_if(any_gap).alias("rows_dropped"),
        *[F.count_if(gap).alias(f"bad_{c}") for c, gap in gaps.items()],
    )


def feature_target(df: DataFrame, task: str, keep: tuple = ()) -> DataFrame:
    """Feature columns in their documented order, then the target (``discount`` or ``price``)."""
    features, target = TASKS[task]
    return df.select(*keep, *features, target)


def with_top_category(df: DataFrame) -> DataFrame:
    """Add the top-level category on the same row."""
    return df.withColumn(TOP_CATEGORY, top_level("category"))
