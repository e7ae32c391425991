import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from priceloom.operators.pca import (
    component_regression,
    components_needed,
    explained_variance,
    fit_pca,
    loading_sentences,
    loadings_table,
    pca_scores,
)
from priceloom.operators.selection import best_k, feature_selection_path, selection_gains, threshold_step
from priceloom.operators.split import in_test, with_split
from priceloom.operators.training import (
    MODELS,
    evaluate_model,
    feature_influence,
    fit_model,
    holdout_predictions,
    model_parameters,
    score,
    train_linear_regression,
    train_random_forest,
)
from priceloom.schema import DISCOUNT_FEATURES, DISCOUNT_TARGET, NUMERIC, PRICE_FEATURES, PRICE_TARGET
from priceloom.sources.models import load_model, save_model

X = ["x0", "x1", "x2", "x3"]


def as_arrays(df, features, target):
    pdf = df.orderBy("product_id").toPandas()
    return pdf[features].to_numpy(), pdf[target].to_numpy()


def test_random_forest(linear_data):
    model, quality = train_random_forest(linear_data, X, "y", trees=100, max_depth=8)
    assert set(quality) == {"rmse", "mae", "r2"} and quality["r2"] > 0.5
    influence = feature_influence(model, X).collect()
    assert influence[0].feature == "x0" and influence[0].kind == "importance"
    assert sum(r.value for r in influence) == pytest.approx(1.0) and min(r.value for r in influence) >= 0


def test_linear_regression(linear_data):
    model, quality = train_linear_regression(linear_data, X, "y")
    assert quality["r2"] > 0.9 and quality["rmse"] >= 0 and quality["r2"] <= 1.0
    x, y = as_arrays(linear_data.where(~in_test(F.col("product_id"))), X, "y")
    expected = np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), y, rcond=None)[0]
    fitted = model.stages[-1]
    assert np.allclose([*fitted.coefficients, fitted.intercept], expected, atol=1e-9)


@pytest.mark.parametrize("alpha", [0.01, 1.0, 100.0])
def test_ridge_solves_the_penalised_problem(linear_data, alpha):
    model = fit_model(linear_data, "Ridge Regression", X, "y", {"alpha": alpha})
    x, y = as_arrays(linear_data, X, "y")
    xc, yc = x - x.mean(axis=0), y - y.mean()
    expected = np.linalg.solve(xc.T @ xc + alpha * np.eye(4), xc.T @ yc)
    assert np.allclose(model.stages[-1].coefficients.toArray(), expected, atol=1e-9)


def test_gradient_boosting(linear_data):
    model = fit_model(linear_data, "Gradient Boosting", X, "y", {"n_estimators": 50})
    assert evaluate_model(model, linear_data, "y")["r2"] > 0.9
    assert feature_influence(model, X).first().feature == "x0"


def test_save_and_load(spark, linear_data, tmp_path):
    model = fit_model(linear_data, "Random Forest", X, "y", {"n_estimators": 50, "max_depth": 4})
    path = save_model(model, str(tmp_path), "forest")
    assert path == f"{tmp_path}/forest"
    both = score(load_model(str(tmp_path), "forest"), score(model, linear_data).withColumnRenamed("prediction", "p"))
    assert both.where("p <> prediction").count() == 0
    with pytest.raises(FileNotFoundError):
        load_model(str(tmp_path), "none")


def test_parameters():
    assert model_parameters("Random Forest")["n_estimators"] == 200
    assert model_parameters("Ridge Regression", {"alpha": 5.0}) == {"alpha": 5.0}
    assert model_parameters("Gradient Boosting", '{"n_estimators": 100}')["n_estimators"] == 100
    for name, overrides in [("Nearest", {}), ("Linear Regression", {"alpha": 1.0}), ("Ridge Regression", {"alpha": 0.0}),
                            ("Gradient Boosting", {"max_depth": 11}), ("Random Forest", {"n_estimators": 501})]:
        with pytest.raises(ValueError):
            model_parameters(name, overrides)
    assert set(MODELS) == {"Linear Regression", "Ridge Regression", "Random Forest", "Gradient Boosting"}


def test_no_influence_for_other_models(linear_data):
    assembler = Pipeline(stages=[VectorAssembler(inputCols=X, outputCol="f")]).fit(linear_data)
    assert feature_influence(assembler, X) is None


@pytest.fixture(scope="module")
def priced(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        actual = float(rng.lognormal(6, 1))
        percent = float(rng.integers(0, 90))
        sold = actual * (1 - percent / 100) + float(rng.normal(0, 5))
        rows.append((f"P{i}", actual, sold, percent, float(rng.integers(10, 51)) / 10, float(rng.integers(1, 5000))))
    return spark.createDataFrame(rows, "product_id string, " + ", ".join(f"{c} double" for c in NUMERIC))


def test_split_is_stable(priced):
    one = {r.product_id: r.is_test for r in with_split(priced.coalesce(1)).collect()}
    many = {r.product_id: r.is_test for r in with_split(priced.repartition(8)).collect()}
    assert one == many and 0.1 < np.mean(list(one.values())) < 0.3
    other = {r.product_id: r.is_test for r in with_split(priced, salt="7").collect()}
    assert other != one


def test_holdout_never_sees_test_rows(priced):
    test = {r.product_id for r in priced.where(in_test(F.col("product_id"))).collect()}
    found = holdout_predictions(priced, "Linear Regression", "price")
    assert {r.product_id for r in found.collect()} == test
    x, y = as_arrays(priced.where(~in_test(F.col("product_id"))), PRICE_FEATURES, PRICE_TARGET)
    w = np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), y, rcond=None)[0]
    got = {r.product_id: r.prediction for r in found.collect()}
    pdf = priced.toPandas().set_index("product_id").loc[list(got)]
    assert np.allclose(list(got.values()), pdf[PRICE_FEATURES].to_numpy() @ w[:-1] + w[-1])
    with pytest.raises(ValueError):
        holdout_predictions(priced, "Linear Regression", "price", fit_on="test")


def r2_of(train, test, columns, target):
    x, y = as_arrays(train, columns, target)
    w = np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), y, rcond=None)[0]
    x, y = as_arrays(test, columns, target)
    return 1 - ((y - x @ w[:-1] - w[-1]) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_forward_selection_is_greedy(priced):
    flag = in_test(F.col("product_id"))
    train, test = priced.where(~flag), priced.where(flag)
    chosen = []
    for row in feature_selection_path(priced).orderBy("step").collect():
        scores = {f: r2_of(train, test, [*chosen, f], DISCOUNT_TARGET) for f in DISCOUNT_FEATURES if f not in chosen}
        best = max(scores, key=scores.get)
        assert row.feature_added == best and row.r2 == pytest.approx(scores[best], abs=1e-9)
        chosen.append(best)
    assert len(chosen) == 4


def test_steps_and_gains(spark):
    path = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.92), (3, "c", 0.95)], "step bigint, feature_added string, r2 double")
    assert [r.gain for r in selection_gains(path).orderBy("step").collect()] == pytest.approx([0.5, 0.42, 0.03])
    assert tuple(threshold_step(path).first()) == (2, 0.92, "a, b")
    assert threshold_step(path, 0.99).first().step == 3
    results = spark.createDataFrame([(1, 0.1), (2, 0.91234), (3, 0.912339), (4, 0.5)], "k bigint, r2 double")
    assert best_k(results).first().k == 2


def scaled_arrays(df):
    x = df.orderBy("product_id").toPandas()[NUMERIC].to_numpy()
    return (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0))


def test_pca_matches_svd_and_the_built_in(spark, priced):
    fitted = fit_pca(priced)
    x = scaled_arrays(priced)
    u, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(fitted.ratio, s**2 / (s**2).sum(), atol=1e-12)
    assert np.allclose(np.abs(fitted.loadings), np.abs(v.T), atol=1e-8)
    assert np.allclose(fitted.loadings.T @ fitted.loadings, np.eye(5), atol=1e-12)
    assert (np.abs(fitted.loadings).max(axis=0) == fitted.loadings.max(axis=0)).all()
    got = pca_scores(priced, fitted).orderBy("product_id").toPandas()[fitted.names].to_numpy()
    assert np.allclose(got, (x - x.mean(axis=0)) @ fitted.loadings, atol=1e-9)

    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in NUMERIC))
    stages = [VectorAssembler(inputCols=NUMERIC, outputCol="f"),
              StandardScaler(inputCol="f", outputCol="c", withMean=True, withStd=False),
              PCA(k=5, inputCol="c", outputCol="s")]
    model = Pipeline(stages=stages).fit(rows)
    assert np.allclose(model.stages[-1].explainedVariance.toArray(), fitted.ratio, atol=1e-9)
    first = np.array(model.transform(rows).select(vector_to_array("s")[0]).toPandas().iloc[:, 0])
    assert np.allclose(np.abs(first), np.abs(got[:, 0]), atol=1e-8)


def test_pca_of_a_constant_column(priced):
    fitted = fit_pca(priced.withColumn("rating", F.lit(4.0)), k=3)
    assert np.allclose(fitted.loadings[NUMERIC.index("rating")], 0) and len(fitted.names) == 3


def test_component_tables(spark, priced):
    fitted = fit_pca(priced)
    variance = explained_variance(spark, fitted)
    assert variance.orderBy(F.desc("pc")).first().cumulative == pytest.approx(1.0)
    rows = spark.createDataFrame([(1, 0.7, 0.7), (2, 0.22, 0.92), (3, 0.08, 1.0)], "pc bigint, ratio double, cumulative double")
    assert tuple(components_needed(rows).first()) == (2, 3, 0, pytest.approx(0.0))
    assert tuple(components_needed(rows.where("pc = 1")).first()) == (None, None, None, None)
    assert loadings_table(spark, fitted).count() == 25
    loads = spark.createDataFrame([("rating", 1, 0.3), ("actual_price", 1, 0.9), ("rating_count", 1, 0.25), ("rating", 2, -0.4)],
                                  "feature string, pc bigint, loading double")
    got = {r.pc: (r.rises_with, r.falls_with) for r in loading_sentences(loads).collect()}
    assert got == {1: ("**Actual Price** (+0.90), **Rating** (+0.30)", "none above threshold"),
                   2: ("none above threshold", "**Rating** (-0.40)")}


def test_component_regression(priced):
    flag = in_test(F.col("product_id"))
    fitted = fit_pca(priced)
    scored = pca_scores(priced, fitted)
    got = component_regression(priced, fit_on="all").orderBy("k").collect()
    for row in got:
        expected = r2_of(scored.where(~flag), scored.where(flag), fitted.names[: row.k], DISCOUNT_TARGET)
        assert row.r2 == pytest.approx(expected, abs=1e-8)
        assert row.cumulative == pytest.approx(fitted.ratio[: row.k].sum())
    train = component_regression(priced).orderBy("k").collect()
    assert train[-1].r2 == pytest.approx(1.0) and len(train) == 5
    with pytest.raises(ValueError):
        component_regression(priced, fit_on="test")
