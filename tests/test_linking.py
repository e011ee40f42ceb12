"""Nested lookups, names, joins within tolerances and fitted goals against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import goals, linking


def test_lists_keep_order_nulls_and_unknown_ids(spark):
    rows = [(1, [(7, "a"), (9, "b"), None, (None, "c"), (8, "d")]), (2, []), (3, None), (4, [(9, "x")])]
    df = spark.createDataFrame(rows, "id long, items array<struct<who: long, what: string>>").repartition(3)
    lookup = spark.createDataFrame([(7, "seven"), (8, "eight"), (8, "acht"), (None, "none")], "k long, v string")
    got = {r["id"]: r["items"] for r in linking.nested_lookup(df, ["id"], "items", "who", lookup, "k", "v", "name").collect()}
    assert [x and tuple(x) for x in got[1]] == [(7, "a", "seven"), (9, "b", None), None, (None, "c", None), (8, "d", "eight")]
    assert got[2] == [] and got[3] is None and [tuple(x) for x in got[4]] == [(9, "x", None)]
    rejects = linking.unresolved(df, ["id"], "items", "who", lookup, "k").collect()
    assert sorted(map(tuple, rejects)) == [(1, 1, 9), (4, 0, 9)]


def test_names_by_alias_and_unique_prefix(spark):
    names = spark.createDataFrame([("wolverhampton", 1), ("manchestercity", 2), ("manchesterunited", 3), ("spurs", 4), ("twin", 5), ("twin", 6)], "n string, o int")
    aliases = spark.createDataFrame([("mancity", "manchestercity"), ("nobody", "nowhere")], "alias string, name string")
    wanted = {"wolverhampton": 1, "wolver": 1, "wol": None, "manchester": None, "manchesterc": 2, "mancity": 2, "nobody": None, "spur": 4, "spurs": 4, "twin": None, "x": None, None: None}
    df = spark.createDataFrame([(k,) for k in wanted], "name string")
    got = linking.resolved(df, "name", names, "n", "o", aliases, "owner")
    assert {r["name"]: r["owner"] for r in got.collect()} == wanted
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    return a == b or (min(len(a), len(b)) >= 4 and (a.startswith(b) or b.startswith(a)))


def test_pairs_near_in_time_and_name(spark):
    dice, stems = random.Random(3), ["arsenal", "brighton", "brightonandhove", "spurs", "spu", "abc", "abcd", "abcde"]
    left = [(i, dice.uniform(0, 500), dice.choice(stems), dice.choice(stems)) for i in range(120)]
    right = [(i, None if i % 17 == 0 else dice.uniform(0, 500), dice.choice(stems), dice.choice(stems)) for i in range(120)]
    a, b = spark.createDataFrame(left, "a int, t double, h string, g string"), spark.createDataFrame(right, "b int, u double, x string, y string")
    got = linking.near_in_time_and_name(a, b, ("t", "u"), [("h", "x"), ("g", "y")], 36.0)
    want = sorted((p[0], q[0]) for p in left for q in right if q[1] is not None and abs(p[1] - q[1]) < 36 and same(p[2], q[2]) and same(p[3], q[3]))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want and len(want) > 20


def test_kernel_pairs_equal_all_pairs(spark):
    dice = random.Random(4)
    left = [(m, i, dice.random(), dice.random()) for m in range(20) for i in range(11)]
    right = [(m, i, dice.random(), dice.random(), dice.choice([0.16, 0.25, 1 / 3])) for m in range(20) for i in range(11)]
    a, b = spark.createDataFrame(left, "m int, i int, x double, y double"), spark.createDataFrame(right, "m int, j int, u double, v double, reach double")
    got = linking.kernel_pairs(a, b, ["m"], ["m", "i"], [("x", "u", "reach"), ("y", "v", 0.55)], [1 / 3, 0.55])
    want = {}
    for m, i, x, y in left:
        near = {j: (1 - abs(x - u) / r) * (1 - abs(y - v) / 0.55) for n, j, u, v, r in right if n == m and abs(x - u) <= r and abs(y - v) <= 0.55}
        near = {j: w for j, w in near.items() if w > 0}
        near = {j: w / sum(near.values()) for j, w in near.items()}
        near = {j: w for j, w in near.items() if w >= 0.03}
        want |= {(m, i, j): w / sum(near.values()) for j, w in near.items()}
    assert {(r["m"], r["i"], r["j"]): r["weight"] for r in got.collect()} == pytest.approx(want)


def slow(home, away):
    def pmf(k, rate):
        return math.exp(-rate + k * math.log(rate) - sum(math.log(i) for i in range(2, k + 1)))

    cells = [(h, a, pmf(h, home) * pmf(a, away)) for h in range(16) for a in range(16)]
    return [sum(p for h, a, p in cells if c(h, a)) for c in (lambda h, a: h > a, lambda h, a: h == a, lambda h, a: h < a, lambda h, a: h + a > 2.5)]


def test_outcomes_of_expectations():
    pairs = [(0.05, 0.05), (1.4, 1.1), (4.5, 0.3), (2.0, 4.5)]
    assert np.allclose(goals.outcomes(*np.array(pairs).T), [slow(*p) for p in pairs], atol=1e-12)


def test_fitted_goals_equal_the_full_search(spark):
    dice, rows = random.Random(5), []
    for i in range(12):
        p = [dice.uniform(0.1, 1) for _ in range(3)]
        rows.append((i, *(x / sum(p) for x in p), None if i % 3 == 0 else dice.uniform(0.2, 0.8)))
    rows += [(90, None, 0.3, 0.3, 0.5), (91, *slow(1.37, 0.92)), (92, 1.0, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "i int, h double, d double, a double, o double").repartition(2)
    got = {r["i"]: r["goals"] for r in goals.goal_expectations(df, F.col("h"), F.col("d"), F.col("a"), F.col("o")).collect()}
    at = [0.05 + 0.05 * k for k in range(90)]
    model = goals.outcomes(np.repeat(at, 90), np.tile(at, 90))
    for i, *target in rows:
        if target[0] is None:
            assert got[i] is None
            continue
        width = 3 if target[3] is None else 4
        k = int(((model[:, :width] - np.array(target[:width])) ** 2).sum(1).argmin())
        h, a = at[k // 90], at[k % 90]
        fine = [(sum((x - y) ** 2 for x, y in zip(slow(u, v)[:width], target[:width], strict=True)), u, v) for u in (min(4.5, max(0.05, h + 0.01 * s)) for s in range(-5, 6)) for v in (min(4.5, max(0.05, a + 0.01 * s)) for s in range(-5, 6))]
        assert got[i]["error"] == pytest.approx(min(fine)[0], abs=1e-12)
    assert got[91]["home"] == pytest.approx(1.37) and got[91]["away"] == pytest.approx(0.92)


def test_forecasts_of_expectations(spark):
    pairs = [(0.3, 2.1), (1.4, 1.1), (3.0, 3.0)]
    got = goals.forecast(spark.createDataFrame(pairs, "h double, a double"), F.col("h"), F.col("a")).collect()
    for r in got:
        want = slow(r["h"], r["a"])
        assert [r["home_win"], r["draw"], r["away_win"], r["over25"]] == pytest.approx(want, abs=1e-9)
        assert r["both_to_score"] == pytest.approx((1 - math.exp(-r["h"])) * (1 - math.exp(-r["a"]))) and len(r["scores"]) == 5
        assert [s["p"] for s in r["scores"]] == sorted((s["p"] for s in r["scores"]), reverse=True)


def test_names_meet_by_whole_names_not_by_first_letters(spark):
    names = ["nation1", "nation12", "nation123", "nation2", "nat", "nati", None, "other"]
    left = spark.createDataFrame([(i, n, 0.0) for i, n in enumerate(names)], "i long, x string, s double")
    right = spark.createDataFrame([(i, n, 1.0) for i, n in enumerate(names)], "j long, y string, t double")
    pairs = linking.agreeing(left, right, ("x", "y"), "_to", 4)
    agree = lambda a, b: a == b or min(len(a), len(b)) >= 4 and (a.startswith(b) or b.startswith(a))
    want = sorted((a, b) for a in names for b in names if a and b and agree(a, b))
    assert sorted((r["x"], r["_to"]) for r in pairs.collect()) == want
    met = linking.near_in_time_and_name(left, right, ("s", "t"), [("x", "y")], 2.0)
    assert sorted((r["x"], r["y"]) for r in met.collect()) == want
