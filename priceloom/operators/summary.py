"""KPIs, per-feature tables and per-category summaries."""

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priceloom.operators.clean import with_top_category
from priceloom.operators.histogram import feature_histograms
from priceloom.operators.joins import materialise_small, with_scalars
from priceloom.operators.ordinal import with_running_total
from priceloom.operators.quantile import column_quantiles, quantile_row
from priceloom.schema import NUMERIC, TOP_CATEGORY
from priceloom.session import held


def kpis(df: DataFrame) -> DataFrame:
    """Rows, distinct full category paths, mean discount, mean rating and median selling price.

    Computed at once, as one row: the passes of the median share the columns that the means need.
    """
    with held(df.select("category", "discount_percentage", "rating", "discounted_price")) as data:
        base = data.agg(
            F.count("*").alias("products"),
            F.countDistinct("category").alias("categories"),
            F.avg("discount_percentage").alias("avg_discount"),
            F.avg("rating").alias("avg_rating"),
        )
        row, _ = materialise_small(with_scalars(base, quantile_row(data, "discounted_price", {"median_price": 0.5})))
    return row


def sample_products(df: DataFrame, rows: int = 30) -> DataFrame:
    """The first listings by key, with display names."""
    return df.orderBy("product_id").limit(rows).select(
        "product_name",
        F.col("discounted_price").alias("price (₹)"),
        F.col("actual_price").alias("MRP (₹)"),
        F.col("discount_percentage").alias("discount %"),
        "rating",
        "rating_count",
    )


# The names of the per-feature aggregates.
_AGGREGATES = {
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "std": F.stddev_samp,
}


def describe_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """min, max, mean and sample standard deviation: one row per feature, one pass."""
    columns = columns or NUMERIC
    wide = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in _AGGREGATES.items()])
    rows = [F.struct(F.lit(c).alias("feature"), *[F.col(f"{n}_{c}").alias(n) for n in _AGGREGATES]) for c in columns]
    return wide.select(F.inline(F.array(*rows)))


def training_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean and sample standard deviation per feature, over the whole table."""
    return describe_features(df, features).select("feature", "mean", "std")


def feature_ranges(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Min, max and range per feature."""
    return describe_features(df, columns).select("feature", "min", "max", (F.col("max") - F.col("min")).alias("range"))


def category_summary(df: DataFrame, order: str = "count") -> DataFrame:
    """Count and means per top-level category; largest first, or ascending by the named mean."""
    table = with_top_category(df).groupBy(TOP_CATEGORY).agg(
        F.count("discount_percentage").alias("count"),
        F.avg("discount_percentage").alias("avg_discount"),
        F.avg("actual_price").alias("avg_actual_price"),
        F.avg("discounted_price").alias("avg_disc_price"),
        F.avg("rating").alias("avg_rating"),
    )
    first = F.col(order).desc() if order == "count" else F.col(order).asc()
    return table.orderBy(first, TOP_CATEGORY)


def melt(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Wide to long: one (Feature, Value) row per listing and feature."""
    return df.unpivot([], columns or NUMERIC, "Feature", "Value")


def distribution_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Five-number summary per feature, raw with the top 2 % clipped, and Min-Max scaled.

    Clipping and scaling keep the order of values, so both follow from quantiles of the raw
    column: nothing is clipped or scaled row by row.
    """
    points = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "cap": 0.98, "top": 1.0}
    columns = columns or NUMERIC
    with held(df.select(*columns)) as data:
        long = column_quantiles(data, columns, list(points.values()))
    wide = long.groupBy("Feature").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in points.items()]
    )
    span = F.nullif(F.col("top") - F.col("q0"), F.lit(0.0))
    scaled = {f"scaled_{n}": F.coalesce((F.col(n) - F.col("q0")) / span, F.lit(0.0)) for n in ("q25", "q50", "q75")}
    return wide.select(
        "Feature", F.col("q0").alias("raw_min"), F.col("q25").alias("raw_q25"), F.col("q50").alias("raw_median"),
        F.col("q75").alias("raw_q75"), F.col("cap").alias("raw_max"),
        *[c.alias(n) for n, c in scaled.items()],
    )


def distribution_histograms(df: DataFrame, columns: list[str] | None = None, bins: int = 40) -> DataFrame:
    """A histogram per feature, with the top 2 % clipped."""
    return feature_histograms(df, columns or NUMERIC, bins, 0.98)


def percentile_rank(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Percentage of rows at or below each distinct ``value`` of a table.

    A short list of values cuts the column into buckets that are counted in one pass, without
    comparing every row with every value. For a long list both sides are reduced to value counts,
    put in one order, and summed up to each value.
    """
    data = df.select(F.col(column).cast("double").alias("value")).where(F.col("value").isNotNull())
    asked, small = materialise_small(values.select(F.col("value").cast("double")).where("not isnan(value)").distinct())
    if small:
        return _bucketed_rank(data, sorted(r["value"] for r in asked.where("value is not null").collect()))
    both = (
        data.groupBy("value").agg(F.count("*").alias("_n"), F.lit(0).alias("_asked"))
        .unionByName(asked.select("value", F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_asked")))
        .groupBy("value").agg(F.sum("_n").alias("_n"), F.max("_asked").alias("_asked"))
    )
    total = data.agg(F.count("*").alias("_total"))
    summed = with_running_total(both, "value", "_n", "_upto").where("_asked = 1")
    share = F.try_divide(F.col("_upto"), F.col("_total")) * 100
    return with_scalars(summed, total).select("value", share.alias("percent"))


def _bucketed_rank(data: DataFrame, asked: list[float]) -> DataFrame:
    """Buckets are closed on the left, so the negated column is cut at the negated values."""
    cuts = sorted({-v for v in asked if abs(v) != float("inf")})
    infinite = float("inf")
    bucketizer = Bucketizer(splits=[-infinite, *(cuts or [0.0]), infinite], inputCol="_y", outputCol="_bucket",
                            handleInvalid="keep")
    cut = bucketizer.transform(data.withColumn("_y", -F.col("value")))
    lowest, missing = F.col("value") == -infinite, F.isnan("value")
    counts = cut.groupBy(F.when(missing, -2.0).when(lowest, -1.0).otherwise(F.col("_bucket")).alias("b")).agg(
        F.count("*").alias("n")).collect()
    counts = {int(r["b"]): r["n"] for r in counts}
    total, lows = sum(counts.values()), counts.get(-1, 0)
    upto, running = {infinite: total - counts.get(-2, 0), -infinite: lows}, lows
    for bucket in range(len(cuts), 0, -1):
        running += counts.get(bucket, 0)
        upto[-cuts[bucket - 1]] = running
    rows = [(v, 100.0 * upto[v] / total if total else None) for v in asked]
    return data.sparkSession.createDataFrame(rows, "value double, percent double")


def points_below_cap(df: DataFrame, actual: str, predicted: str, prob: float = 0.97) -> DataFrame:
    """Actual and predicted values, both at or below a quantile of the actual values."""
    capped = with_scalars(df, quantile_row(df, actual, {"_cap": prob}))
    return capped.where((F.col(actual) <= F.col("_cap")) & (F.col(predicted) <= F.col("_cap"))).drop("_cap")


def axis_range(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Smallest and largest value over both columns."""
    return df.agg(
        F.least(F.min(actual), F.min(predicted)).alias("axis_min"),
        F.greatest(F.max(actual), F.max(predicted)).alias("axis_max"),
    )


def running_share(df: DataFrame, order: str, share: str, name: str = "cumulative") -> DataFrame:
    """Running total over a table with one row per component or step."""
    window = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(share).over(window))
