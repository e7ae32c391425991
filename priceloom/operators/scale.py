"""Min-Max scaling."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceloom.functions.scalars import bounded
from priceloom.operators.joins import with_scalars
from priceloom.schema import NUMERIC


def normalize_features(df: DataFrame, columns: list[str] | None = None, fit_on: DataFrame | None = None,
                       suffix: str = "") -> DataFrame:
    """Scale columns to [0, 1] by the range of ``fit_on`` (by default ``df``) and clip to it.

    A constant column gives 0. Other columns are kept; ``suffix`` names the scaled columns, and
    without it they replace the given ones. One global aggregate, then a projection.
    """
    columns = columns or NUMERIC
    source = df if fit_on is None else fit_on
    limits = source.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])

    def scaled(c):
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        share = (F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0))
        return F.when(hi > lo, bounded(share, F.lit(0.0), F.lit(1.0))).otherwise(F.lit(0.0))

    wide = with_scalars(df, limits)
    return wide.withColumns({c + suffix: scaled(c) for c in columns}).drop(*limits.columns)
