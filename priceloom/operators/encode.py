"""Turning the top-level category into numbers."""

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priceloom.operators.clean import with_top_category
from priceloom.operators.joins import join_materialised, materialise_small
from priceloom.operators.ordinal import with_ordinal
from priceloom.schema import TOP_CATEGORY


def category_codes(df: DataFrame) -> tuple[DataFrame, bool]:
    """One row per category with its 0-based place in sorted order, and whether that table is proven small."""
    names, small = materialise_small(df.select(TOP_CATEGORY).distinct())
    if small:
        order = Window.partitionBy(F.lit(0)).orderBy(TOP_CATEGORY)
        return names.withColumn("category_label", (F.row_number().over(order) - 1).cast("double")), True
    numbered = with_ordinal(names, [TOP_CATEGORY], "category_label")
    return numbered.withColumn("category_label", F.col("category_label").cast("double")), False


def label_encode(df: DataFrame) -> tuple[DataFrame, list[str]]:
    codes, small = category_codes(df)
    return join_materialised(df, codes, small, [TOP_CATEGORY]), ["category_label"]


def frequency_encode(df: DataFrame) -> tuple[DataFrame, list[str]]:
    counts, small = materialise_small(df.groupBy(TOP_CATEGORY).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n").alias("_total"))
    share = (F.col("_n") / F.col("_total")).alias("category_freq")
    shares = counts.crossJoin(F.broadcast(total)).select(TOP_CATEGORY, share)
    return join_materialised(df, shares, small, [TOP_CATEGORY]), ["category_freq"]


def target_encode(df: DataFrame, target: str, fit_on: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Mean target per category, by default over all rows; ``fit_on`` names training rows instead.

    A category that ``fit_on`` lacks gets the mean over all its rows.
    """
    source = df if fit_on is None else _ready(fit_on)
    means, small = materialise_small(
        source.groupBy(TOP_CATEGORY).agg(F.count(target).alias("_n"), F.avg(target).alias("category_target"))
    )
    encoded = join_materialised(df, means.drop("_n"), small, [TOP_CATEGORY])
    if fit_on is None:
        return encoded, ["category_target"]
    overall = means.agg((F.sum(F.col("_n") * F.col("category_target")) / F.sum("_n")).alias("_overall"))
    filled = F.coalesce("category_target", "_overall")
    encoded = encoded.crossJoin(F.broadcast(overall)).withColumn("category_target", filled)
    return encoded.drop("_overall"), ["category_target"]


def one_hot_encode(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """One 0/1 column per category, in sorted order, none dropped.

    The names become columns of the plan, so they are read when this is called, after they were measured to be few.
    ``one_hot_vector`` holds the same indicators in one sparse column, for more categories than a table should
    have columns.
    """
    found, small = materialise_small(df.select(TOP_CATEGORY).distinct())
    if not small:
        raise ValueError("too many categories for one column each: use one_hot_vector")
    names = [r[0] for r in found.collect()]
    flags = [F.when(F.col(TOP_CATEGORY) == n, 1.0).otherwise(0.0).alias(f"cat_{n}") for n in sorted(names)]
    # A plain select: names that differ only in case are distinct categories.
    return df.select("*", *flags), [f"cat_{n}" for n in sorted(names)]


def one_hot_vector(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The same indicators as one sparse vector, for any number of categories."""
    encoded, (label,) = label_encode(_ready(df))
    encoder = OneHotEncoder(inputCol=label, outputCol="category_vector", dropLast=False)
    return encoder.fit(encoded).transform(encoded).drop(label), ["category_vector"]


def _ready(df: DataFrame) -> DataFrame:
    return df if TOP_CATEGORY in df.columns else with_top_category(df)


def encode_category(df: DataFrame, method: str, target_col: str = "discount_percentage",
                    fit_on: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Add the encoded category columns; returns the table and their names."""
    ready = _ready(df)
    if method == "label":
        return label_encode(ready)
    if method == "frequency":
        return frequency_encode(ready)
    if method == "target":
        return target_encode(ready, target_col, fit_on)
    if method == "onehot":
        return one_hot_encode(ready)
    raise ValueError(f"unknown encoding {method!r}: choose label, frequency, target or onehot")
