"""Association, regression and resampling against plain numpy."""

from __future__ import annotations

import json
import math
import random
import subprocess
import sys
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.operators import concordance, regression, resampling, stats, windows


def pairs_of(rows):
    c = d = tx = ty = 0
    for (x, y), (u, v) in combinations(rows, 2):
        s = (x - u) * (y - v)
        c, d, tx, ty = c + (s > 0), d + (s < 0), tx + (x == u and y != v), ty + (y == v and x != u)
    return c, d, tx, ty


@pytest.mark.parametrize("parts", [1, 4, 32])
@pytest.mark.parametrize("kind", ["plain", "ties", "hot", "line"])
def test_kendall_counts_every_pair(spark, parts, kind):
    dice = random.Random(3)
    rows = {
        "plain": [(dice.random(), dice.random()) for _ in range(300)],
        "ties": [(float(dice.randint(0, 6)), float(dice.randint(0, 5))) for _ in range(300)],
        "hot": [(1.0 if dice.random() < 0.5 else dice.random(), 2.0 if dice.random() < 0.5 else dice.random()) for _ in range(300)],
        "line": [(float(i), float(-i)) for i in range(200)],
    }[kind]
    df = spark.createDataFrame([*rows, (None, 1.0), (1.0, None)], "x double, y double")
    got = concordance.kendall(df, "x", "y", parts).first()
    c, d, tx, ty = pairs_of(rows)
    assert (got["n"], int(got["concordant"]), int(got["discordant"]), int(got["tied_x"]), int(got["tied_y"])) == (len(rows), c, d, tx, ty)
    assert got["tau"] == pytest.approx((c - d) / math.sqrt((c + d + tx) * (c + d + ty)))


def test_kendall_of_too_little(spark):
    for rows in ([], [(1.0, 2.0)], [(1.0, 2.0)] * 5):
        assert concordance.kendall(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()["tau"] is None


def test_inversions_of_heavy_rows():
    y, w = np.array([3.0, 1.0, 2.0, 1.0]), np.array([5, 2, 1, 4]) * 10**10
    assert concordance.inversions(y, w) == (5 * 2 + 5 * 1 + 5 * 4 + 1 * 4) * 10**20


def table(spark, n=400):
    dice = np.random.default_rng(1)
    a, b = dice.normal(50, 4, n), dice.exponential(2, n)
    y = 3 + 0.5 * a - 2 * b + dice.normal(0, 1 + b, n)
    rows = [(i, *map(float, v)) for i, v in enumerate(zip(a, b, y, strict=True))]
    return spark.createDataFrame([*rows, (n, None, 1.0, 1.0)], "i long, a double, b double, y double").repartition(3), np.column_stack([np.ones(n), a, b]), y


@pytest.mark.parametrize("robust", [False, True])
def test_least_squares_with_diagnostics(spark, robust):
    df, x, y = table(spark)
    fit = regression.ols(df, ["a", "b"], "y", robust)
    beta, inverse = np.linalg.lstsq(x, y, rcond=None)[0], np.linalg.inv(x.T @ x)
    e = y - x @ beta
    h, s2 = np.einsum("ij,jk,ik->i", x, inverse, x), e @ e / (len(y) - 3)
    cov = inverse @ (x.T * e**2 @ x) @ inverse * len(y) / (len(y) - 3) if robust else inverse * s2
    assert fit.beta == pytest.approx(beta, rel=1e-9)
    assert [t[2] for t in fit.coefficients()] == pytest.approx(np.sqrt(np.diag(cov)), rel=1e-8)
    got = sorted(fit.rows(df).select("i", "fitted", "residual", "leverage", "cooks").collect())
    assert [r["leverage"] for r in got] == pytest.approx(h, rel=1e-8) and [r["residual"] for r in got] == pytest.approx(e, abs=1e-8)
    assert [r["cooks"] for r in got] == pytest.approx(e**2 * h / (3 * s2 * (1 - h) ** 2), rel=1e-7)
    s = fit.summary(df, ["i"])
    assert s["durbin_watson"] == pytest.approx(((e[1:] - e[:-1]) ** 2).sum() / (e @ e)) and s["breusch_pagan"] == pytest.approx(len(y) * np.corrcoef(e**2, x @ beta)[0, 1] ** 2)
    assert s["r2"] == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum())


def test_ridge_over_folds(spark):
    df, x, y = table(spark)
    fit = regression.ridge(df, ["a", "b"], "y", F.pmod("i", F.lit(5)))
    z = (x[:, 1:] - x[:, 1:].mean(0)) / x[:, 1:].std(0)
    t, i, path = y - y.mean(), np.arange(len(y)), []
    for lam in (0.01, 0.1, 1, 3, 10, 30, 100, 300, 1000):
        err = 0
        for f in range(5):
            m = i % 5 != f
            b = np.linalg.solve(z[m].T @ z[m] + lam * np.eye(2), z[m].T @ t[m])
            err += ((t[~m] - z[~m] @ b) ** 2).sum()
        path.append(err / len(y))
    assert [e for _, e in fit["path"]] == pytest.approx(path, rel=1e-9)
    b = np.linalg.solve(z.T @ z + fit["penalty"] * np.eye(2), z.T @ t) / x[:, 1:].std(0)
    assert fit["slopes"] == pytest.approx(b, rel=1e-9) and fit["intercept"] == pytest.approx(y.mean() - b @ x[:, 1:].mean(0))


def test_inflation(spark):
    df, x, _ = table(spark)
    rows = df.dropna().withColumn("c", F.col("a") + F.col("b") * 3 + F.sin("i"))
    got = {r["term"]: r["vif"] for r in regression.inflation(rows, ["a", "b", "c"]).collect()}
    m = np.column_stack([x[:, 1], x[:, 2], x[:, 1] + 3 * x[:, 2] + np.sin(np.arange(len(x)))])
    assert list(got.values()) == pytest.approx(np.diag(np.linalg.inv(np.corrcoef(m.T))), rel=1e-7)
    assert regression.inflation(rows.withColumn("d", F.col("a") * 2), ["a", "d"]).first()["vif"] is None


def test_logistic_by_reweighting(spark):
    df, x, y = table(spark)
    label = (y > np.median(y)).astype(float)
    rows = df.dropna().withColumn("y", (F.col("y") > float(np.median(y))).cast("int"))
    fit, beta = regression.logistic(rows, ["a", "b"], "y"), np.zeros(3)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-x @ beta))
        g = x.T * (mu * (1 - mu)) @ x
        beta = beta + np.linalg.solve(g, x.T @ (label - mu))
    ll = (label * np.log(mu) + (1 - label) * np.log(1 - mu)).sum()
    assert [t[1] for t in fit["coefficients"]] == pytest.approx(beta, rel=1e-8) and [t[2] for t in fit["coefficients"]] == pytest.approx(np.sqrt(np.diag(np.linalg.inv(g))), rel=1e-8)
    assert fit["converged"] and fit["pseudo_r2"] == pytest.approx(1 - ll / (len(y) * math.log(0.5))) and fit["separated"] == 0


def test_logistic_of_separated_rows(spark):
    rows = spark.createDataFrame([(float(i), int(i >= 10)) for i in range(20)], "x double, y int")
    fit = regression.logistic(rows, ["x"], "y")
    assert not fit["converged"] and fit["separated"] > 0


def test_tails():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803477, rel=1e-8) and special.t_critical(0.95, 10) == pytest.approx(2.228138852, rel=1e-8)
    assert special.f_upper(4.0, 2, 20) == pytest.approx((1 + 2 * 4.0 / 20) ** -10) and special.t_two_sided(0.0, 3) == 1.0
    assert special.beta_share(0.3, 2, 3) == pytest.approx(0.3483) and special.normal_two_sided(1.959963985) == pytest.approx(0.05)


def hashes(spark, ids, resamples, seed):
    rows = spark.createDataFrame([(i,) for i in ids], "i long").withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    return {(r["i"], r["resample"]): r["h"] for r in rows.withColumn("h", F.xxhash64(F.lit(seed), "resample", "i")).collect()}


def test_bootstrap_against_plain_weights(spark):
    dice = random.Random(1)
    rows = [(i, dice.gauss(5, 2) if i % 9 else None) for i in range(80)]
    found = []
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "i long, v double").repartition(parts)
        found.append(tuple(resampling.bootstrap(df, "v", ["i"], 99, seed=4, level=0.9).first()))
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
    h, stats = hashes(spark, range(80), 99, 4), []
    for b in range(1, 100):
        w = {i: int((((h[i, b] % 2**64) >> 11) / 2**53 >= cdf).sum()) for i, v in rows if v is not None}
        stats.append(sum(w[i] * v for i, v in rows if v is not None) / sum(w.values()))
    stats.sort()
    known = [v for _, v in rows if v is not None]
    want = (sum(known) / len(known), stats[math.floor(0.05 * 98)], stats[math.ceil(0.95 * 98)], np.std(stats, ddof=1), 99)
    assert found[0] == pytest.approx(want) and found[1] == pytest.approx(want)


def test_poisson_weights_have_mean_and_variance_one(spark):
    w = spark.range(200_000).select(resampling.poisson_weight(F.xxhash64("id")).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert w[0] == pytest.approx(1, abs=0.01) and w[1] == pytest.approx(1, abs=0.02)


@pytest.mark.parametrize("n", [60, 12_000])
def test_permutations_against_plain_choice(spark, n):
    dice = random.Random(2)
    rows = [(i, dice.gauss(0, 1) + (0.6 if i % 4 == 0 else 0), int(i % 4 == 0)) for i in range(n)]
    df = spark.createDataFrame([*rows, (n, None, 1), (n + 1, 1.0, None)], "i long, v double, a int").repartition(3)
    h, n1, value = hashes(spark, range(n), 19, 7), sum(r[2] for r in rows), {r[0]: r[1] for r in rows}
    want, total = {}, sum(value.values())
    for b in range(1, 20):
        taken = sorted(value, key=lambda i: ((h[i, b] % 2**64) >> 1, h[i, b], i))[:n1]
        s = sum(value[i] for i in taken)
        want[b] = s / n1 - (total - s) / (n - n1)
    got = {r["resample"]: r["statistic"] for r in resampling.permuted(df, "v", "a", ["i"], 19, seed=7).collect()}
    assert got == pytest.approx(want)
    seen = sum(v for i, v, a in rows if a) / n1 - sum(v for i, v, a in rows if not a) / (n - n1)
    for side, extreme in (("two-sided", sum(abs(s) >= abs(seen) for s in want.values())), ("greater", sum(s >= seen for s in want.values())), ("less", sum(s <= seen for s in want.values()))):
        test = resampling.permutation_test(df, "v", "a", ["i"], 19, seed=7, alternative=side).first()
        assert test["observed"] == pytest.approx(seen) and test["p"] == (extreme + 1) / 20


def test_partial_autocorrelation(spark):
    dice = np.random.default_rng(2)
    v = [0.0]
    for e in dice.normal(0, 1, 200):
        v.append(float(0.7 * v[-1] + e))
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)] + [("b", 0, 1.0), ("b", 1, 2.0), ("c", 0, 1.0), ("c", 1, 1.0), ("c", 2, 1.0), ("d", 0, 1.0), ("d", 1, 3.0), ("d", 2, 2.0)], "k string, i int, v double")
    got = windows.partial_autocorrelation(df, "v", ["k"], ["i"], 6).collect()
    d = np.array(v) - np.mean(v)
    r = np.array([(d[k:] * d[: len(d) - k]).sum() / (d @ d) for k in range(7)])
    for k in range(1, 7):
        m = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert next(x["pacf"] for x in got if (x["k"], x["lag"]) == ("a", k)) == pytest.approx(np.linalg.solve(m, r[1 : k + 1])[-1])
    assert {x["k"] for x in got} == {"a", "d"} and max(x["lag"] for x in got if x["k"] == "d") == 2


def test_p_values(spark):
    dice = np.random.default_rng(4)
    x, y = dice.normal(0.3, 1, 60), dice.normal(0, 2, 60)
    df = spark.createDataFrame([(float(a), float(b), int(a > 0)) for a, b in zip(x, y, strict=True)], "x double, y double, l int")
    got = stats.pearson(df, "x", "y").first()
    assert got["p"] == pytest.approx(special.t_two_sided(got["t"], 58)) and stats.pearson(df.withColumn("y", F.col("x") * 2), "x", "y").first()["p"] < 1e-12
    one = stats.one_sample(df, "x", 0.1).first()
    assert one["t"] == pytest.approx((x.mean() - 0.1) / (x.std(ddof=1) / 60**0.5)) and one["p"] == pytest.approx(special.t_two_sided(one["t"], 59))
    w = stats.welch(df, "y", "l").first()
    assert w["p"] == pytest.approx(special.t_two_sided(w["t"], w["df"]))
    u = stats.rank_sum(df, "y", "l").first()
    assert u["p"] == pytest.approx(special.normal_two_sided(u["z"]), abs=1e-6)


def test_distances_from_distributions(spark):
    dice = np.random.default_rng(5)
    v = np.round(dice.uniform(0, 1, 90), 2)
    got = stats.departure(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", lambda x: x * x).first()
    s = np.sort(v)
    i = np.arange(90)
    d = max(np.abs((i + 1) / 90 - s * s).max(), np.abs(s * s - i / 90).max())
    assert got["d"] == pytest.approx(d) and got["p"] == pytest.approx(special.kolmogorov_upper(d, 90))
    k = dice.poisson(3.2, 400)
    fit = stats.poisson_fit(spark.createDataFrame([(int(x),) for x in k], "k int"), "k").first()
    rate, n = k.mean(), len(k)
    e = [n * math.exp(-rate + j * math.log(rate) - math.lgamma(j + 1)) for j in range(k.max() + 1)]
    cells = [(int((k == j).sum()), x) for j, x in enumerate(e) if x >= 5]
    cells.append((n - sum(o for o, _ in cells), n - sum(x for _, x in cells)))
    want = sum((o - x) ** 2 / x for o, x in cells)
    assert (fit["cells"], fit["df"]) == (len(cells), len(cells) - 2) and fit["statistic"] == pytest.approx(want) and fit["p"] == pytest.approx(special.chi2_upper(want, len(cells) - 2))
    assert special.chi2_upper(3.841458821, 1) == pytest.approx(0.05) and special.chi2_upper(30.0, 10) == pytest.approx(0.000856641, rel=1e-5)


def test_cuts_are_found_by_halving(spark):
    from tessera.operators import ordering

    cuts = [float(x) for x in range(0, 26, 2)]
    values = [None, -1.0, 0.0, 1.0, 13.0, 24.0, 99.0, float("nan"), float("inf")]
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(1)
    got = rows.select("v", ordering.cuts_upto(cuts, F.col("v")).alias("n")).collect()
    assert all(r["n"] == (0 if r["v"] is None else len(cuts) if r["v"] != r["v"] else sum(c <= r["v"] for c in cuts)) for r in got)


NEW_SESSION = """
import json
from pyspark.sql import SparkSession
from tessera.operators import stats

conf = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
# p is column 5 of the session, as low as a lambda variable's id
df = spark.range(60).selectExpr("id AS a", "id AS b", "id AS c", "id AS d", "(id * 7 % 15 + 1) / 256.0D AS p")
print("rows " + json.dumps([list(r) for r in stats.false_discovery(df, "p").select("p", "q").collect()]))
"""


def test_false_discovery_of_ties_in_a_new_session():
    run = subprocess.run([sys.executable, "-c", NEW_SESSION], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=300)
    rows = [line for line in run.stdout.splitlines() if line.startswith("rows ")]
    assert rows, run.stderr[-2000:]
    got = json.loads(rows[0][5:])
    p = sorted((i * 7 % 15 + 1) / 256 for i in range(60))
    raw = [(v, v * 60 / (i + 1)) for i, v in enumerate(p)]
    # equal p share the q of the last of them
    want = {v: min([1.0, *(x for w, x in raw if w >= v)]) for v in p}
    assert sorted(r[0] for r in got) == p and all(q == pytest.approx(want[v]) for v, q in got)


def test_a_resample_has_few_ranges_and_takes_the_least_hashes(spark):
    n = 40_000
    df = spark.range(n).select("id", (F.col("id") % 1009).cast("double").alias("v"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    got = {r["resample"]: r["statistic"] for r in resampling.permuted(df, "v", "y", ["id"], 3).collect()}
    for k in (1, 2, 3):
        code = F.xxhash64(F.lit(1), F.lit(k), "id")
        rows = df.select("v", F.shiftrightunsigned(code, 1).alias("u")).orderBy("u").limit(n // 5).agg(F.sum("v")).first()[0]
        total = df.agg(F.sum("v")).first()[0]
        assert abs(got[k] - (rows / (n // 5) - (total - rows) / (n - n // 5))) < 1e-9
