"""Quality of predictions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """RMSE, MAE and R2 in one pass; R2 is null when the actual values do not vary."""
    y, error = F.col(actual), F.col(actual) - F.col(predicted)
    spread = F.var_pop(y) * F.count(y)
    return df.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.sum(error * error) / F.nullif(spread, F.lit(0.0))).alias("r2"),
    )


def with_residual(df: DataFrame, actual: str, predicted: str, out: str = "residual") -> DataFrame:
    return df.withColumn(out, F.col(actual) - F.col(predicted))
