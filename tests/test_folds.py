import hashlib

import numpy as np
import pytest

from priceloom.operators.training import feature_influence, parameter_sweep, ridge_folds, train_model
from priceloom.plans.listing import listings
from priceloom.plans.modelling import _IMPORTANCES
from priceloom.schema import DISCOUNT_FEATURES, DISCOUNT_TARGET, KEY

SMALL = "/root/testdata/sf0.001"


def fold(key, folds):
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % folds


def test_folds_match_fits_on_the_rows(spark):
    df = listings(spark, SMALL)
    rows = df.select(KEY, *DISCOUNT_FEATURES, DISCOUNT_TARGET).toPandas()
    part = rows[KEY].map(lambda k: fold(k, 4)).to_numpy()
    x, y = rows[DISCOUNT_FEATURES].to_numpy(float), rows[DISCOUNT_TARGET].to_numpy(float)
    found = {(r.alpha, r.fold): r for r in ridge_folds(df, "discount", [0.01, 100.0], 4).collect()}
    assert len(found) == 8
    for (alpha, f), row in found.items():
        a, b = x[part != f], y[part != f]
        centred = a - a.mean(axis=0)
        w = np.linalg.solve(centred.T @ centred + alpha * np.eye(4), centred.T @ (b - b.mean()))
        error = y[part == f] - (b.mean() + (x[part == f] - a.mean(axis=0)) @ w)
        assert row.rows == (part == f).sum()
        assert row.rmse == pytest.approx(np.sqrt((error**2).mean()), rel=1e-6)
        assert row.r2 == pytest.approx(1 - (error**2).mean() / y[part == f].var(), rel=1e-6)


def test_one_scan_for_any_number_of_penalties(spark):
    counter = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    df = listings(spark, SMALL)
    counted = df.mapInArrow(seen, df.schema)
    assert ridge_folds(counted, "discount", [0.01, 0.1, 1.0, 10.0, 100.0]).count() == 25
    once = counter.value
    assert once == df.count()
    parameter_sweep(counted, "Ridge Regression", "discount", [{"alpha": a} for a in (0.01, 1.0, 100.0)])
    assert counter.value == 2 * once


def test_folds_of_edge_cases(spark):
    empty = listings(spark, SMALL).where("false")
    assert ridge_folds(empty, "discount", [1.0]).count() == 0
    with pytest.raises(ValueError):
        ridge_folds(empty, "discount", [1.0], folds=1)
    with pytest.raises(ValueError):
        ridge_folds(empty, "discount", [1000.0])


def test_importances_have_a_margin(spark):
    model = train_model(listings(spark, SMALL), "Random Forest", "discount", {"n_estimators": 50, "max_depth": 8})
    found = {r.feature: r.value for r in feature_influence(model, DISCOUNT_FEATURES).collect()}
    assert sum(found.values()) == pytest.approx(1)
    for feature, (rank, tenths) in _IMPORTANCES.items():
        assert abs(found[feature] - tenths) < 0.045
        assert (found[feature] > 0.1) == (rank is not None)
    assert found["discounted_price"] - found["actual_price"] > 0.1
