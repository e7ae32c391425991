from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

import priceloom.operators.boosting as boosting
from priceloom.operators.training import feature_influence, fit_model, score
from priceloom.sources.models import load_model, save_model

X = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def stepped(spark):
    rng = np.random.default_rng(5)
    rows = [(f"r{i:04}", float(a), float(b), float(c), float(np.sin(a) + b * (c > 2) / 5 + rng.normal() / 10 + 40))
            for i, (a, b, c) in enumerate(rng.integers(0, (19, 12, 5), (900, 3)))]
    return spark.createDataFrame(rows, "product_id string, x0 double, x1 double, x2 double, y double").repartition(3).cache()


def predicted(model, df):
    return np.array([r.prediction for r in score(model, df).orderBy("product_id").collect()])


@pytest.fixture(scope="module")
def model(stepped):
    return fit_model(stepped, "Gradient Boosting", X, "y", {"n_estimators": 50})


def assembled(df):
    return VectorAssembler(inputCols=X, outputCol="_features").transform(df)


def test_trees_are_those_of_the_built_in_learner(stepped, model):
    # Rows are packed, a byte per feature and one number each, and no longer objects of the built-in learner.
    assert isinstance(model.stages[-1], boosting.BoostedTreesModel) and len(model.stages[-1].trees) == 50
    rows = assembled(stepped)
    built_in = GBTRegressor(featuresCol="_features", labelCol="y", maxIter=50, stepSize=0.1, maxDepth=3, maxBins=128, seed=42).fit(rows)
    expected = np.array([r.prediction for r in built_in.transform(rows).orderBy("product_id").collect()])
    got = predicted(model, stepped)
    # Splits that are as good may be decided otherwise, by sums in another order.
    assert np.isclose(got, expected).mean() > 0.95 and np.abs(got - expected).max() < 0.1
    found = {r.feature: r.value for r in feature_influence(model, X).collect()}
    assert found == pytest.approx(dict(zip(X, built_in.featureImportances.toArray())), abs=0.01)


def test_rows_dealt_to_many_tasks_and_nodes_to_executors(stepped, monkeypatch):
    rows, learner = assembled(stepped), boosting.BoostedTrees("y", 6, 0.3, 5)
    whole = [r.prediction for r in learner.fit(rows).transform(rows).orderBy("product_id").collect()]
    for name, value in (("BLOCK_ROWS", 70), ("TASK_ROWS", 200), ("CHAINED", 4), ("DRIVER_BYTES", 0)):
        monkeypatch.setattr(boosting, name, value)
    dealt = [r.prediction for r in learner.fit(rows).transform(rows).orderBy("product_id").collect()]
    assert np.isclose(whole, dealt).mean() > 0.95


def test_a_block_takes_a_byte_per_bin_and_a_number_per_row():
    cells, y = np.arange(600, dtype=np.uint8).reshape(200, 3), np.arange(200.0)
    block = boosting._block(np.ascontiguousarray(cells.T), y)
    assert block.num_rows == 1 and block.nbytes < 200 * (3 + 8) + 100
    [(back, left)] = boosting._blocks(iter([block]), 3)
    assert (back.T == cells).all() and (left == y).all()


def test_both_walks_end_in_the_same_nodes(monkeypatch):
    tree = boosting.Tree(np.array([1, -1, 0, -1, 2, -1, -1], np.int16), np.array([3, 0, 5, 0, 1, 0, 0], np.uint8),
                         np.array([1, 0, 3, 0, 5, 0, 0], np.uint16), np.arange(7.0))
    cells = np.random.default_rng(1).integers(0, 8, (3, 500)).astype(np.uint8)
    brute = np.where(cells[1] <= 3, 1, np.where(cells[0] <= 5, 3, np.where(cells[2] <= 1, 5, 6)))
    assert (boosting._place(tree, cells) == brute).all()
    monkeypatch.setattr(boosting, "FEW_NODES", 0)
    assert (boosting._place(tree, cells) == brute).all()


def test_saved_loaded_and_on_a_stream(spark, stepped, model, tmp_path):
    save_model(model, f"{tmp_path}/models", "boosted")
    loaded = load_model(f"{tmp_path}/models", "boosted")
    expected = predicted(model, stepped)
    assert (predicted(loaded, stepped) == expected).all()
    assert loaded.stages[-1].featureImportances == model.stages[-1].featureImportances
    stepped.write.parquet(f"{tmp_path}/rows")
    stream = score(loaded, spark.readStream.schema(stepped.schema).parquet(f"{tmp_path}/rows"))
    query = stream.writeStream.format("memory").queryName("boosted_scores").trigger(availableNow=True).start()
    query.awaitTermination()
    assert np.array_equal([r.prediction for r in spark.table("boosted_scores").orderBy("product_id").collect()], expected)


def test_one_value_and_what_cannot_be_fitted(stepped):
    constant = fit_model(stepped.withColumn("y", F.lit(7.0)), "Gradient Boosting", X, "y", {"n_estimators": 50})
    assert set(predicted(constant, stepped)) == {7.0} and constant.stages[-1].featureImportances.toArray().sum() == 0
    for bad in (stepped.limit(0), stepped.withColumn("y", F.when(F.col("x0") > 0, F.col("y"))),
                stepped.withColumn("x1", F.lit(None).cast("double"))):
        with pytest.raises(Exception):
            fit_model(bad, "Gradient Boosting", X, "y", {"n_estimators": 50})


def test_rows_of_one_set_of_bins_are_one_entry(stepped, model):
    cells, n, total = np.array([[0, 1], [2, 1]], np.uint8), np.array([3.0, 1.0]), np.array([6.0, -2.0])
    batch = pa.record_batch({"cell": pa.array([bytes(c) for c in cells], pa.binary()), "total": total, "n": n})
    blocks = list(boosting._packed(2)(iter([batch])))
    tree = boosting.Tree(np.array([0, -1, -1], np.int16), np.array([1, 0, 0], np.uint8), np.array([1, 0, 0], np.uint16), np.array([0.0, 0.5, -2.0]))
    [(_, left, weight)] = boosting._blocks(boosting._after([tree], 2)(iter(blocks)), 2)
    assert (weight == n).all() and (left == [6.0 - 3 * 0.5, -2.0 + 2.0]).all()
    # Rows that come four times make the same trees of as many entries, whatever their order.
    four = reduce(type(stepped).unionByName, [stepped] * 4).repartition(7)
    again = fit_model(four, "Gradient Boosting", X, "y", {"n_estimators": 50})
    assert np.isclose(predicted(again, stepped), predicted(model, stepped)).mean() > 0.95
