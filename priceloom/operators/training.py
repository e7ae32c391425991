"""Regression models by name: training, scoring, hold-out quality, what a model relies on."""

import json
from functools import reduce
from math import isnan

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.operators.boosting import BoostedTrees
from priceloom.operators.clean import feature_target
from priceloom.operators.forest import DeepForest
from priceloom.operators.metrics import evaluate
from priceloom.operators.moments import fit_quality, least_squares, moment_aggregates, moments_of_row, pooled
from priceloom.operators.split import IS_TEST, fold_of, in_test, with_split
from priceloom.schema import KEY, TASKS
from priceloom.session import ensure_checkpoint_dir, held

SEED = 42
# The deepest tree the built-in learners grow; it stands for "no limit".
DEEPEST = 30
# Up to this depth a forest is small whatever the rows, and the built-in learner grows it.
SHALLOW = 12

# Model names and their default parameters.
MODELS = {
    "Linear Regression": {},
    "Ridge Regression": {"alpha": 1.0},
    "Random Forest": {"n_estimators": 200, "max_depth": None, "min_samples_split": 2},
    "Gradient Boosting": {"n_estimators": 200, "learning_rate": 0.1, "max_depth": 3},
}

# Accepted parameter ranges, inclusive; a forest depth of 0 means no limit.
PARAMETER_RANGES = {
    "Linear Regression": {},
    "Ridge Regression": {"alpha": (0.01, 100.0)},
    "Random Forest": {"n_estimators": (50, 500), "max_depth": (0, 30), "min_samples_split": (2, 20)},
    "Gradient Boosting": {"n_estimators": (50, 500), "learning_rate": (0.01, 0.5), "max_depth": (2, 10)},
}


def model_parameters(name: str, overrides: dict | str | None = None) -> dict:
    """Defaults of a model with checked overrides, a dict or its JSON text, on top."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}: choose one of {', '.join(MODELS)}")
    given = json.loads(overrides) if isinstance(overrides, str) else overrides or {}
    merged = {**MODELS[name], **given}
    for key, value in merged.items():
        if key not in PARAMETER_RANGES[name]:
            raise ValueError(f"{name} has no parameter {key!r}")
        low, high = PARAMETER_RANGES[name][key]
        if value is not None and not low <= value <= high:
            raise ValueError(f"{key}={value} is outside {low} to {high}")
    return merged


def _estimator(train: DataFrame, name: str, params: dict, target: str):
    common = {"labelCol": target, "featuresCol": "_features", "predictionCol": "prediction"}
    if name == "Linear Regression":
        return LinearRegression(solver="normal", regParam=0.0, **common)
    if name == "Ridge Regression":
        # The built-in penalty is per row and on the scaled target; this gives alpha * |w|^2.
        spread = train.agg(F.count("*").alias("n"), F.stddev_pop(target).alias("s")).first()
        penalty = params["alpha"] * (spread["s"] or 0.0) / max(spread["n"], 1)
        return LinearRegression(solver="normal", standardization=False, elasticNetParam=0.0, regParam=penalty, **common)
    depth = params.get("max_depth") or DEEPEST
    if name == "Random Forest":
        if depth > SHALLOW:
            return DeepForest(target, params["n_estimators"], depth, max(1, params.get("min_samples_split", 2) // 2), SEED)
        return RandomForestRegressor(
            numTrees=params["n_estimators"], maxDepth=depth, seed=SEED, featureSubsetStrategy="all",
            minInstancesPerNode=max(1, params.get("min_samples_split", 2) // 2), maxBins=128, maxMemoryInMB=1024,
            cacheNodeIds=True, checkpointInterval=10, **common,
        )
    return BoostedTrees(target, params["n_estimators"], params["learning_rate"], depth)


def fit_model(train: DataFrame, name: str, features: list[str], target: str,
              overrides: dict | str | None = None) -> PipelineModel:
    """Fit a model by name on every row of ``train``."""
    ensure_checkpoint_dir(train.sparkSession)
    params = model_parameters(name, overrides)
    with held(train.select(*features, target)) as rows:
        stages = [VectorAssembler(inputCols=features, outputCol="_features"), _estimator(rows, name, params, target)]
        return Pipeline(stages=stages).fit(rows)


def train_model(df: DataFrame, name: str, task: str, overrides: dict | str | None = None, fit_on: str = "train",
                key: str = KEY) -> PipelineModel:
    """Fit a model for a task (``discount`` or ``price``) on the training side, or on ``all`` rows."""
    if fit_on not in ("train", "all"):
        raise ValueError("fit_on is 'train' or 'all'")
    features, target = TASKS[task]
    rows = df if fit_on == "all" else df.where(~in_test(F.col(key)))
    return fit_model(rows, name, features, target, overrides)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``prediction``; features are found by name, and the input columns are kept."""
    return model.transform(df).drop("_features")


def holdout_predictions(df: DataFrame, name: str, task: str, overrides: dict | str | None = None, fit_on: str = "train",
                        key: str = KEY) -> DataFrame:
    """Test rows with ``actual`` and ``prediction``; ``fit_on='all'`` lets the model see them too."""
    model = train_model(df, name, task, overrides, fit_on, key)
    target = TASKS[task][1]
    test = feature_target(df.where(in_test(F.col(key))), task, keep=(key,))
    return score(model, test).withColumnRenamed(target, "actual")


def holdout_quality(model: PipelineModel, df: DataFrame, task: str, key: str = KEY) -> DataFrame:
    """RMSE, MAE and R2 of a given model, such as a loaded one, on the test side."""
    return evaluate(score(model, df.where(in_test(F.col(key)))), TASKS[task][1], "prediction")


def parameter_sweep(df: DataFrame, name: str, task: str, settings: list[dict], key: str = KEY) -> DataFrame:
    """Hold-out quality of each parameter set: ``(parameters, rmse, mae, r2)``, best first.

    All sets are checked against the accepted ranges before the first fit; every set is one fit. Features and
    target are read once and held for all of them. ``ridge_folds`` answers many ridge penalties without a fit each.
    """
    for overrides in settings:
        model_parameters(name, overrides)
    features, target = TASKS[task]
    rows = []
    with held(with_split(df, key).select(IS_TEST, *features, target)) as ready:
        train, test = ready.where(~F.col(IS_TEST)), ready.where(F.col(IS_TEST))
        for overrides in settings:
            found = evaluate_model(fit_model(train, name, features, target, overrides), test, target)
            rows.append((json.dumps(overrides, sort_keys=True), found["rmse"], found["mae"], found["r2"]))
    table = df.sparkSession.createDataFrame(rows, "parameters string, rmse double, mae double, r2 double")
    return table.orderBy("rmse", "parameters")


def ridge_folds(df: DataFrame, task: str, alphas: list[float], folds: int = 5, key: str = KEY) -> DataFrame:
    """Cross-validated ridge regression: ``(alpha, fold, rows, rmse, r2)``, all penalties from one scan.

    The scan sums up counts, means and covariances of every fold, ``folds`` rows of d x d numbers. Moments add up, so
    the training side of a fold is the sum of the others, and neither a fit nor the quality on the fold left out
    needs the rows again. ``r2`` is null where the target does not vary in a fold; a fold that is empty, or whose
    training side is, has no row.
    """
    for alpha in alphas:
        model_parameters("Ridge Regression", {"alpha": alpha})
    if folds < 2:
        raise ValueError("cross-validation takes two folds at least")
    features, target = TASKS[task]
    columns = [*features, target]
    sums = (df.groupBy(fold_of(F.col(key), folds).alias("fold")).agg(*moment_aggregates(columns))
            .where("fold is not null").collect())
    found = {row["fold"]: moments_of_row(row, columns) for row in sums}
    rows = []
    for fold, test in sorted(found.items()):
        others = [m for f, m in found.items() if f != fold]
        if not others:
            continue
        train = reduce(pooled, others)
        for alpha in alphas:
            quality = fit_quality(test, features, target, *least_squares(train, features, target, alpha))
            r2, rmse = (None if isnan(v) else v for v in quality)
            rows.append((float(alpha), fold, test.n, rmse, r2))
    return df.sparkSession.createDataFrame(rows, "alpha double, fold int, rows long, rmse double, r2 double")


def train_random_forest(df: DataFrame, features: list[str], target: str, test_size: float = 0.2, trees: int = 100,
                        max_depth: int | None = None, key: str = KEY) -> tuple[PipelineModel, dict]:
    """A forest and its quality on held-out rows."""
    overrides = {"n_estimators": trees, "max_depth": max_depth}
    return _fit_and_evaluate(df, "Random Forest", features, target, test_size, overrides, key)


def train_linear_regression(df: DataFrame, features: list[str], target: str, test_size: float = 0.2,
                            key: str = KEY) -> tuple[PipelineModel, dict]:
    """Least squares and its quality on held-out rows."""
    return _fit_and_evaluate(df, "Linear Regression", features, target, test_size, None, key)


def _fit_and_evaluate(df, name, features, target, test_size, overrides, key):
    with held(with_split(df, key, test_size).select(IS_TEST, *features, target)) as ready:
        model = fit_model(ready.where(~F.col(IS_TEST)), name, features, target, overrides)
        return model, evaluate_model(model, ready.where(F.col(IS_TEST)), target)


def evaluate_model(model: PipelineModel, df: DataFrame, target: str) -> dict:
    """RMSE, MAE and R2 of a model on the rows of ``df``."""
    return evaluate(score(model, df), target, "prediction").first().asDict()


def feature_influence(model: PipelineModel, features: list[str]) -> DataFrame | None:
    """Importances of a tree model or coefficients of a linear one; None for any other model.

    Rows are ``(feature, kind, value, positive)``, largest value first.
    """
    fitted = model.stages[-1]
    if hasattr(fitted, "featureImportances"):
        kind, values = "importance", fitted.featureImportances.toArray()
    elif hasattr(fitted, "coefficients"):
        kind, values = "coefficient", fitted.coefficients.toArray()
    else:
        return None
    spark = SparkSession.active()
    rows = [(f, kind, float(v), bool(v > 0)) for f, v in zip(features, values)]
    table = spark.createDataFrame(rows, "feature string, kind string, value double, positive boolean")
    return table.orderBy(F.desc("value"), "feature")

