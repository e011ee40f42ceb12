"""Explanations of models whose answers are known."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import explain


@pytest.fixture(scope="module")
def rows(spark):
    dice = random.Random(1)
    data = [(i, dice.uniform(0, 10), dice.gauss(0, 2), dice.random()) for i in range(400)]
    return spark.createDataFrame(data, "id long, a double, b double, c double").repartition(3).withColumn("y", 2 * F.col("a") - 3 * F.col("b")).cache()


def line(df):
    return df.withColumn("prediction", 2 * F.col("a") - 3 * F.col("b") + 1)


def product(df):
    return df.withColumn("prediction", F.col("a") * F.col("b"))


NAMES = ["a", "b", "c"]


def test_importance_of_used_and_unused_features(spark, rows):
    got = {r["feature"]: r for r in explain.permutation_importance(line, rows.withColumn("y", F.col("y") + 1), NAMES, "y", ["id"]).collect()}
    assert got["c"]["importance"] == 0 and got["c"]["sd"] == 0
    sd = {c: rows.selectExpr(f"stddev_samp({c})").first()[0] for c in "ab"}
    # of independent values the squared error of a shuffled column is twice its variance
    assert got["a"]["importance"] == pytest.approx(2 * sd["a"] * 2**0.5, rel=0.1) and got["b"]["importance"] == pytest.approx(3 * sd["b"] * 2**0.5, rel=0.1)
    again = {r["feature"]: r["importance"] for r in explain.permutation_importance(line, rows.withColumn("y", F.col("y") + 1).repartition(7), NAMES, "y", ["id"]).collect()}
    assert again == pytest.approx({k: v["importance"] for k, v in got.items()})


def test_a_shuffled_column_keeps_its_values(spark, rows):
    seen = []

    def model(df):
        seen.append(df)
        return line(df)

    explain.permutation_importance(model, rows, NAMES, "y", ["id"], repeats=2)
    values = defaultdict(list)
    for r in seen[0].collect():
        values[r["feature"], r["repeat"]].append((r["a"], r["b"], r["c"]))
    base = sorted(x[0] for x in values["", 0])
    for (feature, repeat), v in values.items():
        assert sorted(x[0] for x in v) == base and (feature != "a" or repeat == 0 or sorted(v) != sorted(values["", 0]))
    assert len(values) == 7


def test_dependence_of_a_line(spark, rows):
    got = explain.partial_dependence(line, rows, "a", NAMES, ["id"], points=5, sample=100).orderBy("value").collect()
    steps = [(y["prediction"] - x["prediction"]) / (y["value"] - x["value"]) for x, y in zip(got, got[1:], strict=False)]
    assert len(got) == 5 and steps == pytest.approx([2.0] * 4) and len({round(r["sd"], 9) for r in got}) == 1
    low, high = rows.selectExpr("min(a)", "max(a)").first()
    assert (got[0]["value"], got[-1]["value"]) == (low, pytest.approx(high))
    assert explain.partial_dependence(line, rows.withColumn("a", F.lit(1.0)), "a", NAMES, ["id"]).collect() == []
    assert explain.expectations(line, rows, "b", NAMES, ["id"], points=4, sample=10).count() == 40


def test_attributions_of_a_line(spark, rows):
    some = rows.where("id < 5")
    got = explain.shapley(line, some, rows, NAMES, ["id"], samples=200, size=100).collect()
    floor = [r.asDict() for r in explain._sample(rows, ["id"], NAMES, 100, 1).collect()]
    mean = {c: sum(r[c] for r in floor) / len(floor) for c in NAMES}
    values = {r["id"]: r for r in some.collect()}
    for r in got:
        x = values[r["id"]]
        want = {"a": 2 * (x["a"] - mean["a"]), "b": -3 * (x["b"] - mean["b"]), "c": 0.0}[r["feature"]]
        assert r["contribution"] == pytest.approx(want, abs=1.5) and r["prediction"] == pytest.approx(2 * x["a"] - 3 * x["b"] + 1)
        assert r["baseline"] == pytest.approx(2 * mean["a"] - 3 * mean["b"] + 1)
    assert len(got) == 15


def test_interactions(spark, rows):
    assert explain.interaction(line, rows, "a", "b", NAMES, ["id"]).first()["strength"] == pytest.approx(0, abs=1e-9)
    sample = [(r["a"], r["b"]) for r in explain._sample(rows, ["id"], NAMES, 500, 1).collect()]
    (la, ha), (lb, hb) = (rows.selectExpr(f"min({c})", f"max({c})").first() for c in "ab")
    ga, gb = ([lo + (hi - lo) * k / 5 for k in range(6)] for lo, hi in ((la, ha), (lb, hb)))
    n = len(sample)
    ma, mb, all_ = sum(a for a, _ in sample) / n, sum(b for _, b in sample) / n, sum(a * b for a, b in sample) / n
    spread = (sum((a * b - all_) ** 2 for a, b in sample) / (n - 1)) ** 0.5
    apart = [(x * y - (x * mb + ma * y - all_)) ** 2 for x in ga for y in gb]
    assert explain.interaction(product, rows, "a", "b", NAMES, ["id"]).first()["strength"] == pytest.approx((sum(apart) / len(apart)) ** 0.5 / spread)
    assert explain.interaction(line, rows.withColumn("a", F.lit(1.0)), "a", "b", NAMES, ["id"]).first()["strength"] is None
