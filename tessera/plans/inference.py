"""Rank association, regressions, resampling and neighbours over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import concordance, explain, regression, resampling, stats, windows
from tessera.plans.tables import PANEL, panel, query, r, table


@query(
    "K9_kendall",
    """WITH c AS (SELECT l_quantity AS x, l_discount AS y, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL GROUP BY 1, 2),
p AS (SELECT sum(a.n * b.n) FILTER (a.x < b.x AND a.y < b.y) AS c, sum(a.n * b.n) FILTER (a.x < b.x AND a.y > b.y) AS d, sum(a.n * b.n) FILTER (a.x = b.x AND a.y < b.y) AS tx, sum(a.n * b.n) FILTER (a.x < b.x AND a.y = b.y) AS ty FROM c a, c b),
t AS (SELECT (SELECT CAST(sum(n) AS BIGINT) FROM c) AS n, CAST(c AS BIGINT) AS concordant, CAST(d AS BIGINT) AS discordant, CAST(tx AS BIGINT) AS tied_x, CAST(ty AS BIGINT) AS tied_y, (c - d) / sqrt(CAST(c + d + tx AS DOUBLE) * (c + d + ty)) AS tau FROM p)
SELECT n, concordant, discordant, tied_x, tied_y, round(tau, 9) AS tau, round(tau / sqrt(2.0 * (2 * n + 5) / (9.0 * n * (n - 1))), 6) AS z FROM t""",
)
def kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = concordance.kendall(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount")
    counts = (F.col(c).cast("long").alias(c) for c in ("concordant", "discordant", "tied_x", "tied_y"))
    return k.select("n", *counts, r("tau", 9).alias("tau"), r("z").alias("z"))


@query("K9_kendall_continuous")
def kendall_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of many distinct values; no pair of rows is joined."""
    return concordance.kendall(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_orderkey")


@query(
    "K11_partial_autocorrelation",
    f"""WITH {PANEL}, d AS (SELECT entity, period, revenue - avg(revenue) OVER (PARTITION BY entity) AS d FROM panel), l AS (SELECT entity, d, lag(d, 1) OVER w AS a, lag(d, 2) OVER w AS b, lag(d, 3) OVER w AS c FROM d WINDOW w AS (PARTITION BY entity ORDER BY period)),
q AS (SELECT entity, count(*) AS n, sum(d * a) / sum(d * d) AS r1, sum(d * b) / sum(d * d) AS r2, sum(d * c) / sum(d * d) AS r3 FROM l GROUP BY 1 HAVING count(*) >= 4),
p AS (SELECT *, (r2 - r1 * r1) / (1 - r1 * r1) AS p2 FROM q), s AS (SELECT *, r1 - p2 * r1 AS f1 FROM p)
SELECT entity, CAST(u.lag AS INTEGER) AS lag, round(CASE u.lag WHEN 1 THEN r1 WHEN 2 THEN p2 ELSE (r3 - f1 * r2 - p2 * r1) / (1 - f1 * r1 - p2 * r2) END, 6) AS pacf, round(1.96 / sqrt(n), 6) AS band FROM s, unnest([1, 2, 3]) AS u(lag)""",
)
def partial_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.partial_autocorrelation(panel(spark, sf_dir), "revenue", ["entity"], ["period"], 3)
    return found.select("entity", "lag", r("pacf").alias("pacf"), r("band").alias("band"))


#: A straight line of revenue on quantity, with what the diagnostics need.
LINE = f"""{PANEL}, m AS (SELECT count(*) AS n, avg(qty) AS mx, avg(revenue) AS my, regr_sxx(revenue, qty) AS sxx, regr_slope(revenue, qty) AS b, regr_intercept(revenue, qty) AS a, regr_syy(revenue, qty) AS syy FROM panel),
f AS (SELECT entity, period, a + b * qty AS fitted, revenue - a - b * qty AS e, 1.0 / m.n + (qty - mx) * (qty - mx) / sxx AS h, qty - mx AS xc, m.n AS n, sxx, syy FROM panel, m), v AS (SELECT sum(e * e) / (max(n) - 2) AS s2 FROM f)"""


@query("K20_row_diagnostics", f"WITH {LINE} SELECT entity, period, round(fitted, 3) AS fitted, round(e, 3) AS residual, round(h, 9) AS leverage, round(e * e * h / (2 * s2 * (1 - h) * (1 - h)), 8) AS cooks FROM f, v")
def row_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir)
    out = regression.ols(rows, ["qty"], "revenue").rows(rows)
    return out.select("entity", "period", r("fitted", 3).alias("fitted"), r("residual", 3).alias("residual"), r("leverage", 9).alias("leverage"), r("cooks", 8).alias("cooks"))


@query(
    "K20_summary",
    f"""WITH {LINE}, d AS (SELECT e - lag(e) OVER (ORDER BY entity, period) AS step FROM f), s AS (SELECT max(n) AS n, sum(e * e) AS rss, max(syy) AS tss, max(sxx) AS sxx, sum(e * e * xc * xc) AS meat, corr(e * e, fitted) AS c FROM f)
SELECT CAST(n AS BIGINT) AS n, round(1 - rss / tss, 9) AS r2, round(1 - (rss / tss) * (n - 1) / (n - 2), 9) AS adjusted_r2, round((tss - rss) / (rss / (n - 2)), 2) AS f, round(-2 * (-0.5 * n * (ln(2 * pi()) + ln(rss / n) + 1)) + 6, 4) AS aic,
 round(n * c * c, 5) AS breusch_pagan, round((SELECT sum(step * step) FROM d) / rss, 6) AS durbin_watson, round(sqrt(meat * n / (n - 2)) / sxx, 6) AS robust_se FROM s""",
)
def regression_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir)
    fit = regression.ols(rows, ["qty"], "revenue", robust=True)
    s = fit.summary(rows, ["entity", "period"])
    places = {"r2": 9, "adjusted_r2": 9, "f": 2, "aic": 4, "breusch_pagan": 5, "durbin_watson": 6}
    values = [s["n"], *(round(s[k], p) for k, p in places.items()), round(fit.coefficients()[1][2], 6)]
    return spark.createDataFrame([values], f"n long, {', '.join(f'{k} double' for k in places)}, robust_se double")


@query(
    "K21_ridge_over_folds",
    """WITH b AS (SELECT l_extendedprice AS y, l_quantity AS x, l_orderkey % 5 AS f FROM lineitem), m AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my FROM b), z AS (SELECT f, (x - mx) / sx AS z, y - my AS t FROM b, m),
s AS (SELECT f, count(*) AS n, sum(z * z) AS zz, sum(z * t) AS zt, sum(t * t) AS tt FROM z GROUP BY 1), g AS (SELECT sum(n) AS n, sum(zz) AS zz, sum(zt) AS zt, sum(tt) AS tt FROM s),
e AS (SELECT lam, sum(s.tt - 2 * b * s.zt + b * b * s.zz) / max(gn) AS err FROM (SELECT s.*, g.n AS gn, lam, (g.zt - s.zt) / (g.zz - s.zz + lam) AS b FROM s, g, unnest([0.01, 0.1, 1, 3, 10, 30, 100, 300, 1000]) AS u(lam)) s GROUP BY 1)
SELECT CAST(lam AS DOUBLE) AS penalty, round(err / 1e6, 5) AS error, lam = (SELECT lam FROM e ORDER BY err, lam LIMIT 1) AS chosen, round((SELECT zt / (zz + lam) / sx FROM g, m), 4) AS slope FROM e""",
)
def ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of every penalty, and the slope that each gives over all rows."""
    lines = table(spark, sf_dir, "lineitem")
    fit = regression.ridge(lines, ["l_quantity"], "l_extendedprice", F.pmod("l_orderkey", F.lit(5)))
    slopes = {p: regression.ridge(lines, ["l_quantity"], "l_extendedprice", F.pmod("l_orderkey", F.lit(5)), (p,))["slopes"][0] for p, _ in fit["path"]}
    rows = [(float(p), round(e / 1e6, 5), p == fit["penalty"], round(slopes[p], 4)) for p, e in fit["path"]]
    return spark.createDataFrame(rows, "penalty double, error double, chosen boolean, slope double")


@query(
    "K22_logistic",
    """WITH RECURSIVE x AS (SELECT (l_quantity - 25) / 10 AS x, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem),
w AS (SELECT 0 AS it, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS va, CAST(0 AS DOUBLE) AS vb UNION ALL
 SELECT it + 1, (sxx * t - sx * tx) / (s * sxx - sx * sx), (s * tx - sx * t) / (s * sxx - sx * sx), sxx / (s * sxx - sx * sx), s / (s * sxx - sx * sx) FROM (
 SELECT it, sum(g) AS s, sum(g * x) AS sx, sum(g * x * x) AS sxx, sum(g * v) AS t, sum(g * v * x) AS tx FROM (SELECT it, x, mu * (1 - mu) AS g, eta + (y - mu) / (mu * (1 - mu)) AS v FROM (SELECT it, x, y, a + b * x AS eta, 1 / (1 + exp(-(a + b * x))) AS mu FROM w, x WHERE it < 8)) GROUP BY it)),
k AS (SELECT * FROM w WHERE it = 8), l AS (SELECT sum(y * ln(p) + (1 - y) * ln(1 - p)) AS ll, avg(y) AS q, count(*) AS n FROM (SELECT y, 1 / (1 + exp(-(a + b * x))) AS p FROM x, k))
SELECT 'intercept' AS term, round(a, 8) AS estimate, round(sqrt(va), 8) AS standard_error, round(1 - ll / (n * (q * ln(q) + (1 - q) * ln(1 - q))), 9) AS pseudo_r2 FROM k, l
UNION ALL SELECT 'x', round(b, 8), round(sqrt(vb), 8), round(1 - ll / (n * (q * ln(q) + (1 - q) * ln(1 - q))), 9) FROM k, l""",
)
def logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").selectExpr("(l_quantity - 25) / 10 AS x", "CAST(l_returnflag = 'R' AS INT) AS y")
    fit = regression.logistic(x, ["x"], "y")
    rows = [(t[0], round(t[1], 8), round(t[2], 8), round(fit["pseudo_r2"], 9)) for t in fit["coefficients"]]
    return spark.createDataFrame(rows, "term string, estimate double, standard_error double, pseudo_r2 double")


@query(
    "K23_inflation",
    """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, corr(l_extendedprice, l_discount) AS bc FROM lineitem), d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM c)
SELECT 'l_quantity' AS term, round((1 - bc * bc) / det, 6) AS vif FROM d UNION ALL SELECT 'l_extendedprice', round((1 - ac * ac) / det, 6) FROM d UNION ALL SELECT 'l_discount', round((1 - ab * ab) / det, 6) FROM d""",
)
def inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression.inflation(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("vif", r("vif"))


@query("K29_bootstrap")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean price a unit: a ratio of sums, which has no textbook error."""
    return resampling.bootstrap(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber"], resamples=200, over="l_quantity")


@query("K30_permutation")
def permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return resampling.permutation_test(orders, "o_totalprice", "y", ["o_orderkey"], resamples=200)


def _line_of_two(spark: SparkSession, sf_dir: str):
    """The panel, and a model of its revenue by quantity and lines."""
    rows = panel(spark, sf_dir)
    fit = regression.ols(rows, ["qty", "n"], "revenue")
    return rows, lambda df: df.withColumn("prediction", fit.fitted())


@query(
    "L12_partial_dependence",
    f"""WITH {PANEL}, m AS (SELECT var_pop(qty) AS c11, var_pop(n) AS c22, covar_pop(qty, n) AS c12, covar_pop(qty, revenue) AS c1, covar_pop(n, revenue) AS c2, avg(qty) AS mq, avg(n) AS mn, avg(revenue) AS my, min(qty) AS lo, max(qty) AS hi, stddev_samp(n) AS sn FROM panel),
f AS (SELECT *, (c22 * c1 - c12 * c2) / (c11 * c22 - c12 * c12) AS b1, (c11 * c2 - c12 * c1) / (c11 * c22 - c12 * c12) AS b2 FROM m)
SELECT round(lo + (hi - lo) * k / 19.0, 6) AS value, round(my + b1 * (lo + (hi - lo) * k / 19.0 - mq), 3) AS prediction, round(abs(b2) * sn, 3) AS sd FROM f, unnest(range(20)) AS u(k)""",
)
def partial_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _line_of_two(spark, sf_dir)
    found = explain.partial_dependence(model, rows, "qty", ["qty", "n"], ["entity", "period"], sample=None)
    return found.select(r("value").alias("value"), r("prediction", 3).alias("prediction"), r("sd", 3).alias("sd"))


@query("L12_permutation_importance")
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _line_of_two(spark, sf_dir)
    return explain.permutation_importance(model, rows, ["qty", "n"], "revenue", ["entity", "period"], repeats=3)


@query("L12_shapley")
def shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions of every month of every twentieth supplier."""
    rows, model = _line_of_two(spark, sf_dir)
    return explain.shapley(model, rows.where("entity % 20 = 0"), rows, ["qty", "n"], ["entity", "period"], samples=20)


@query("K25_one_sample", f"WITH {PANEL} SELECT entity, count(*) AS n, count(*) - 1 AS df, round((avg(qty) - 30) / (stddev_samp(qty) / sqrt(count(*))), 6) AS t FROM panel GROUP BY 1")
def one_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.one_sample(panel(spark, sf_dir), "qty", 30.0, ["entity"]).select("entity", "n", "df", r("t").alias("t"))


@query(
    "K16_departure",
    """WITH m AS (SELECT avg(o_totalprice) AS m, count(*) AS n FROM orders), k AS (SELECT 1 - exp(-o_totalprice / m) AS f, n, row_number() OVER (ORDER BY o_totalprice) AS i FROM orders, m) SELECT max(n) AS n, round(max(greatest(abs(i / n - f), abs(f - (i - 1) / n))), 9) AS d FROM k""",
)
def departure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far prices are from an exponential distribution of their mean."""
    orders = table(spark, sf_dir, "orders")
    mean = orders.agg(F.avg("o_totalprice")).first()[0]
    return stats.departure(orders, "o_totalprice", lambda x: 1 - F.exp(-x / mean)).select("n", r("d", 9).alias("d"))


@query(
    "K17_poisson_fit",
    f"""WITH {PANEL}, m AS (SELECT count(*) AS c, avg(n) AS rate, max(n) AS top FROM panel), o AS (SELECT n AS k, count(*) AS o FROM panel GROUP BY 1), e AS (SELECT g.k, c, c * exp(-rate + g.k * ln(rate) - lgamma(g.k + 1)) AS e FROM m, unnest(range(CAST(top + 1 AS BIGINT))) AS g(k)),
x AS (SELECT c, e, coalesce(o, 0) AS o FROM e LEFT JOIN o USING (k) WHERE e >= 5), s AS (SELECT max(c) AS n, count(*) AS m, sum(e) AS se, sum(o) AS so, sum(pow(o - e, 2) / e) AS x FROM x)
SELECT n, m + 1 AS cells, round(x + pow((n - so) - (n - se), 2) / (n - se), 4) AS statistic, greatest(1, m - 1) AS df FROM s""",
)
def poisson_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.poisson_fit(panel(spark, sf_dir), "n").select("n", "cells", r("statistic", 4).alias("statistic"), "df")
