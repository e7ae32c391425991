"""Forward feature selection, and regression on the first components, from moments alone."""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priceloom.operators.moments import Moments, fit_quality, least_squares, split_moments
from priceloom.operators.split import IS_TEST, with_split
from priceloom.schema import DISCOUNT_FEATURES, DISCOUNT_TARGET, KEY

PATH_SCHEMA = "step bigint, feature_added string, r2 double"


def both_sides(df: DataFrame, columns: list[str], key: str = KEY, test_size: float = 0.2) -> tuple[Moments, Moments]:
    """Train and test moments in one pass."""
    ready = df if IS_TEST in df.columns else with_split(df, key, test_size)
    sides = split_moments(ready, columns, IS_TEST)
    if set(sides) != {True, False}:
        raise ValueError("both sides of the split need rows")
    return sides[False], sides[True]


def feature_selection_path(df: DataFrame, features: list[str] | None = None, target: str = DISCOUNT_TARGET,
                           key: str = KEY) -> DataFrame:
    """Greedy forward selection by the R2 of least squares on the test side.

    All candidate models are solved from the same moments: the listings are read once.
    """
    features = list(features or DISCOUNT_FEATURES)
    train, test = both_sides(df, [*features, target], key)
    chosen, path = [], []
    while len(chosen) < len(features):
        scores = {}
        for name in features:
            if name not in chosen:
                columns = [*chosen, name]
                r2, _ = fit_quality(test, columns, target, *least_squares(train, columns, target))
                scores[name] = -np.inf if np.isnan(r2) else r2
        best = max(scores, key=scores.get)
        chosen.append(best)
        path.append((len(chosen), best, float(scores[best])))
    return df.sparkSession.createDataFrame(path, PATH_SCHEMA)


# A path has one row per feature, so the window below orders a handful of rows.
def selection_gains(path: DataFrame) -> DataFrame:
    """R2 and its gain per step; the first gain is the first R2."""
    window = Window.partitionBy(F.lit(0)).orderBy("step")
    return path.withColumn("gain", F.col("r2") - F.lag("r2", 1, 0.0).over(window))


def threshold_step(path: DataFrame, threshold: float = 0.90) -> DataFrame:
    """The first step that reaches the threshold, or the last one, with the features so far."""
    reached = F.min(F.when(F.col("r2") >= threshold, F.col("step")))
    needed = path.agg(F.coalesce(reached, F.max("step")).alias("needed"))
    kept = path.crossJoin(F.broadcast(needed)).where("step <= needed")
    names = F.transform(F.array_sort(F.collect_list(F.struct("step", "feature_added"))), lambda x: x["feature_added"])
    return kept.agg(
        F.max("needed").alias("step"), F.max_by("r2", "step").alias("r2"), F.concat_ws(", ", names).alias("features")
    )


def best_k(results: DataFrame) -> DataFrame:
    """The number of components with the best rounded R2, the smallest one on a tie."""
    return results.orderBy(F.round("r2", 4).desc(), "k").limit(1)
