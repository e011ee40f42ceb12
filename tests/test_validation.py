"""Splits, curves and shuffled targets against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import regression, validation


def fit(rows):
    model = regression.ols(rows, ["x"], "y")
    return lambda df: df.withColumn("prediction", model.fitted())


@pytest.fixture(scope="module")
def table(spark):
    dice = np.random.default_rng(3)
    x = dice.normal(0, 1, 300)
    y = 2 * x + dice.normal(0, 0.5, 300) + np.arange(300) / 100
    p = np.arange(300) // 50
    rows = [(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x, y, p, strict=True))]
    return spark.createDataFrame(rows, "i long, x double, y double, p int").repartition(3).cache(), x, y, p


def test_splits_keep_their_distance(spark, table):
    df, *_ = table
    found = validation.splits(df, "p", 2, embargo=1)
    assert [(s.first, s.last, s.test, s.train_rows, s.test_rows, s.purged) for s in found] == [(0, 2, 4, 150, 50, 50), (0, 3, 5, 200, 50, 50)]
    found = validation.splits(df, "p", 2, embargo=0, window=2)
    assert [(s.first, s.last, s.test, s.purged) for s in found] == [(2, 3, 4, 0), (3, 4, 5, 0)]
    assert validation.splits(df.where("p = 0"), "p", 3) == [] and validation.splits(df.limit(0), "p", 3) == []


def line(x, y):
    return np.polyfit(x, y, 1)


def test_cross_validation(table):
    df, x, y, p = table
    folds = validation.splits(df, "p", 2, embargo=1)
    for got, (last, at) in zip(validation.cross_validate(df, "y", "p", folds, fit), ((2, 4), (3, 5)), strict=True):
        b, a = line(x[p <= last], y[p <= last])
        e = y[p == at] - a - b * x[p == at]
        assert got["rmse"] == pytest.approx(np.sqrt((e**2).mean())) and got["r2"] == pytest.approx(1 - (e**2).sum() / ((y[p == at] - y[p == at].mean()) ** 2).sum())


def test_learning_curve_keeps_the_latest(table):
    df, x, y, p = table
    split = validation.splits(df, "p", 1, embargo=0)[0]
    for got in validation.learning_curve(df, "y", "p", ["i"], split, fit, (0.1, 0.5, 1.0)):
        some = slice(250 - got["train_rows"], 250)
        b, a = line(x[some], y[some])
        assert got["train_rmse"] == pytest.approx(np.sqrt(((y[some] - a - b * x[some]) ** 2).mean()))
        assert got["test_rmse"] == pytest.approx(np.sqrt(((y[250:] - a - b * x[250:]) ** 2).mean()))


def test_shuffled_targets_are_beaten(table):
    df, *_ = table
    folds = validation.splits(df, "p", 1, embargo=0)
    got = validation.permutation_null(df, "y", "p", ["i"], folds, fit, runs=4)
    assert got["observed"] > 0.3 > got["null_mean"] and got["p"] == 0.2 and got["runs"] == 4
