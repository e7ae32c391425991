"""Input drift: how far a value lies from the training mean, in training deviations."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceloom.operators.joins import with_scalars

# The flag is raised above 3 deviations; shown z-scores have 3 decimals.
THRESHOLD = 3.0
DECIMALS = 3


def stats_row(stats: DataFrame, features: list[str]) -> DataFrame:
    """The (feature, mean, std) table as one row, which is one row even for an empty table."""
    return stats.agg(
        *[F.max(F.when(F.col("feature") == f, F.col(s))).alias(f"_{s}_{f}") for f in features for s in ("mean", "std")]
    )


def z_score(value: Column, mean: Column, std: Column) -> Column:
    """|value - mean| / std; 0 for a constant feature, null for a feature without statistics."""
    z = F.abs((value - mean) / F.nullif(std, F.lit(0.0)))
    return F.when(mean.isNotNull(), F.when(std > 0, z).otherwise(F.when(value.isNotNull(), F.lit(0.0))))


def with_z_scores(df: DataFrame, stats: DataFrame, features: list[str]) -> DataFrame:
    """Add the unrounded ``z_<feature>`` columns. The statistics are one broadcast row."""
    wide = with_scalars(df, stats_row(stats, features))
    columns = {f"z_{f}": z_score(F.col(f), F.col(f"_mean_{f}"), F.col(f"_std_{f}")) for f in features}
    return wide.withColumns(columns).drop(*[f"_{s}_{f}" for f in features for s in ("mean", "std")])


def beyond(z: Column) -> Column:
    """True above the threshold; NaN and null are not drift."""
    return F.coalesce(F.when(F.isnan(z), F.lit(False)).otherwise(z > THRESHOLD), F.lit(False))


def check_drift(df: DataFrame, stats: DataFrame, features: list[str]) -> DataFrame:
    """Add ``drift_detected`` and the map ``z_scores`` of rounded z-scores.

    The flag is decided before rounding. A feature without statistics is left out of the map.
    """
    scored = with_z_scores(df, stats, features)
    z = {f: F.col(f"z_{f}") for f in features}
    found = reduce(or_, [beyond(c) for c in z.values()])
    pairs = F.map_from_arrays(F.array(*[F.lit(f) for f in z]), F.array(*[F.round(c, DECIMALS) for c in z.values()]))
    shown = F.map_filter(pairs, lambda _, v: v.isNotNull())
    return scored.withColumns({"drift_detected": found, "z_scores": shown}).drop(*[f"z_{f}" for f in features])


def drift_report(df: DataFrame, stats: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: rows checked, rows beyond the threshold and the largest z-score."""
    scored = with_z_scores(df, stats, features)
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f"z_{f}").alias("z")) for f in features]
    long = scored.select(F.inline(F.array(*cells))).where(F.col("z").isNotNull())
    return long.groupBy("feature").agg(
        F.count("*").alias("checked"), F.count_if(beyond(F.col("z"))).alias("flagged"),
        F.max(F.when(~F.isnan("z"), F.col("z"))).alias("max_z"),
    )
