"""Statistics as aggregations; what needs an algebra of fixed size is solved on sums."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import special

from .ordering import least_after, running, value_ranks
from .windows import average_rank


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p value of a t statistic; meant for one row a test or group."""
    def tails(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(k) or k <= 0 else special.t_two_sided(x, k) for x, k in zip(t, df, strict=True)], dtype="float64")

    return F.pandas_udf(tails, "double")(t.cast("double"), df.cast("double"))


def quantile(c: str, p: float) -> Column:
    """Exact type-7 quantile."""
    return F.percentile(c, F.lit(p))


def adjusted_skewness(c: str) -> Column:
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1.0)) / F.when(n > 2, n - 2.0))


def adjusted_kurtosis(c: str) -> Column:
    """Excess kurtosis corrected for the sample's size."""
    n = F.count(c).cast("double")
    return F.when(n > 3, ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / F.when(n > 3, (n - 2) * (n - 3)))


def describe(df: DataFrame, c: str, by: list[str] | None = None) -> DataFrame:
    """Count, missing, moments, quantiles and shape of the present values."""
    mean, sd = F.avg(c), F.stddev_samp(c)
    return df.groupBy(*(by or [])).agg(
        F.count(c).alias("count"), F.count_if(F.col(c).isNull()).alias("missing"), mean.alias("mean"), sd.alias("sd"), F.var_samp(c).alias("variance"),
        F.try_divide(sd, F.sqrt(F.count(c))).alias("se"), F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c).alias("sum"),
        *(quantile(c, p).alias(name) for p, name in ((0.05, "p05"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (0.95, "p95"))),
        (quantile(c, 0.75) - quantile(c, 0.25)).alias("iqr"), F.try_divide(sd, F.abs(mean)).alias("cv"),
        adjusted_skewness(c).alias("skewness"), adjusted_kurtosis(c).alias("kurtosis"),
    )


def histogram(df: DataFrame, c: str, most: int = 500) -> DataFrame:
    """``bin``, ``low``, ``high`` and ``n``: Freedman-Diaconis widths, Sturges where that fails."""
    edge = df.agg(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"), (quantile(c, 0.75) - quantile(c, 0.25)).alias("iqr")).first()
    if not edge["n"]:
        return df.sparkSession.createDataFrame([], "bin long, low double, high double, n long")
    span, width = edge["hi"] - edge["lo"], 2 * edge["iqr"] / edge["n"] ** (1 / 3)
    bins = math.ceil(span / width) if width > 0 else math.ceil(math.log2(edge["n"]) + 1)
    bins = min(most, max(1, bins)) if span > 0 else 1
    step = span / bins if span > 0 else 1.0
    at = F.least(F.lit(bins - 1), F.floor((F.col(c) - edge["lo"]) / step)).cast("long")
    found = df.where(F.col(c).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"), (edge["lo"] + F.col("id") * step).alias("low"), (edge["lo"] + (F.col("id") + 1) * step).alias("high"))
    return every.join(found, "bin", "left").fillna(0, ["n"])


def density(df: DataFrame, c: str, points: int = 64) -> DataFrame:
    """Gaussian kernel density on a grid, Silverman's width; values are binned by the grid of the sum only."""
    s = df.agg(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.stddev_samp(c).alias("sd"), (quantile(c, 0.75) - quantile(c, 0.25)).alias("iqr")).first()
    spread = min(v for v in (s["sd"], (s["iqr"] or 0) / 1.34 or s["sd"]) if v is not None) if s["n"] and s["n"] > 1 else 0
    if not spread:
        return df.sparkSession.createDataFrame([], "x double, density double")
    h = 0.9 * spread * s["n"] ** -0.2
    lo, step = s["lo"] - 3 * h, (s["hi"] - s["lo"] + 6 * h) / (points - 1)
    # one sum for each of a fixed number of points: a single pass of partial aggregates
    grid = [lo + i * step for i in range(points)]
    sums = df.agg(*(F.sum(F.exp(-0.5 * F.pow((F.col(c) - x) / h, F.lit(2)))).alias(f"s{i}") for i, x in enumerate(grid)))
    each = F.array(*(F.struct(F.lit(x).alias("x"), (F.col(f"s{i}") / (s["n"] * h * math.sqrt(2 * math.pi))).alias("density")) for i, x in enumerate(grid)))
    return sums.select(F.explode(each).alias("e")).select("e.x", "e.density")


def ecdf(df: DataFrame, c: str) -> DataFrame:
    """``value`` and ``share`` of values up to it: counts of distinct values, then a running sum."""
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))  # one row
    upto = running(counts, "value", {"_before": "n"}).crossJoin(F.broadcast(total))
    return upto.select("value", ((F.col("_before") + F.col("n")) / F.col("_all")).alias("share"))


def box(df: DataFrame, c: str, by: list[str]) -> DataFrame:
    """Tukey's box: quartiles, whiskers within 1.5 quartile distances and the number beyond."""
    q = df.groupBy(*by).agg(*(quantile(c, p).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))))
    q = q.withColumns({"_lo": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), "_hi": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    rows = df.where(F.col(c).isNotNull()).join(q, by)
    inside = (F.col(c) >= F.col("_lo")) & (F.col(c) <= F.col("_hi"))
    return rows.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(c))).alias("low"), F.max(F.when(inside, F.col(c))).alias("high"), F.count_if(~inside).alias("outliers")
    )


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r of complete pairs; of a constant missing."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pearson(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """``n``, ``r``, its t statistic, two-sided ``p`` and Fisher interval; missing below three pairs, p 0 for a perfect line."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    out = rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), correlation(F.col(a), F.col(b)).alias("_r"))
    r = F.when((F.col("n") >= 3) & F.col("_r").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_r"))))
    out = out.withColumn("r", r).drop("_r")
    t = F.when(F.abs("r") < 1, F.col("r") * F.sqrt((F.col("n") - 2) / F.when(F.abs("r") < 1, 1 - F.col("r") * F.col("r"))))
    z, half = F.when(F.abs("r") < 1, F.atanh(F.col("r"))), F.when(F.col("n") > 3, 1.959963984540054 / F.sqrt(F.col("n") - 3.0))
    out = out.withColumns({"t": t, "low": F.tanh(z - half), "high": F.tanh(z + half)})
    return out.withColumn("p", F.when(F.abs("r") >= 1, 0.0).otherwise(t_p_value(F.col("t"), F.col("n") - 2)))


def spearman(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Pearson's r of average ranks; over all rows the ranks come from counts of distinct values."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    if by:
        ranked = rows.select(*by, average_rank(F.col(a), by).alias("a"), average_rank(F.col(b), by).alias("b"))
        return pearson(ranked, "a", "b", by)
    rows = rows.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    for c, name in (("_a", "a"), ("_b", "b")):
        rows = rows.join(value_ranks(rows, c).select(F.col("value").alias(c), F.col("rank").alias(name)), c)
    return pearson(rows, "a", "b")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a``, ``b``, ``r`` and ``n`` of every ordered pair, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    sums = df.agg(
        *(correlation(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)),
        *(F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n{i}") for i, (a, b) in enumerate(pairs)),
    )
    each = []
    for i, (a, b) in enumerate(pairs):
        for x, y in ((a, b), (b, a)):
            each.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")))
    each += [F.struct(F.lit(a).alias("a"), F.lit(a).alias("b"), F.lit(1.0).alias("r"), F.lit(0).cast("long").alias("n")) for a in columns]
    return sums.select(F.explode(F.array(*each)).alias("e")).select("e.*")


def gram(df: DataFrame, xs: list[str], y: str, by: list[str] | None = None) -> DataFrame:
    """Sums of products of (1, xs, y) over complete rows: all that least squares needs."""
    names = ["_one", *xs, y]
    rows = df.dropna(subset=[*xs, y]).withColumn("_one", F.lit(1.0))
    sums = [F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *sums)


def least_squares(df: DataFrame, xs: list[str], y: str, ridge: float = 0.0) -> dict:
    """Ordinary (or ridge) least squares from one aggregation: coefficients, errors, R2 and AIC."""
    s, k = gram(df, xs, y).first(), len(xs) + 1
    n = s["n"]
    g = np.zeros((k + 1, k + 1))
    for i in range(k + 1):
        for j in range(i, k + 1):
            g[i, j] = g[j, i] = s[f"g{i}_{j}"] or 0.0
    if n <= k:
        raise ValueError(f"{n} complete rows do not determine {k} coefficients")
    scale = np.sqrt(np.diag(g)[:k])
    scale[scale == 0] = 1
    penalty = ridge * np.diag([0.0, *[1.0] * (k - 1)])
    a = g[:k, :k] / np.outer(scale, scale) + penalty
    beta = np.linalg.solve(a, g[:k, k] / scale) / scale
    rss = float(g[k, k] - 2 * beta @ g[:k, k] + beta @ g[:k, :k] @ beta)
    tss = g[k, k] - g[0, k] ** 2 / n
    cov = np.linalg.inv(a) / np.outer(scale, scale) * rss / (n - k)
    return {
        "n": n, "names": ["intercept", *xs], "beta": beta.tolist(), "se": np.sqrt(np.diag(cov)).tolist(), "r2": 1 - rss / tss if tss > 0 else None,
        "rss": rss, "aic": n * math.log(max(rss, 1e-300) / n) + 2 * k, "bic": n * math.log(max(rss, 1e-300) / n) + k * math.log(n),
    }


def regression(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Slope, intercept and R2 of y on x for every group."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"),
        F.pow(correlation(F.col(x), F.col(y)), F.lit(2)).alias("r2"),
    )


def welch(df: DataFrame, c: str, label: str) -> DataFrame:
    """Welch's t, its degrees of freedom, two-sided ``p`` and Cohen's d of the values labelled 1 against 0."""
    sides = [F.when(F.col(label) == k, F.col(c)) for k in (1, 0)]
    m = [F.avg(x) for x in sides]
    v = [F.var_samp(x) for x in sides]
    n = [F.count(x).cast("double") for x in sides]
    e = [F.try_divide(v[i], n[i]) for i in (0, 1)]
    pooled = F.sqrt(F.try_divide((n[0] - 1) * v[0] + (n[1] - 1) * v[1], n[0] + n[1] - 2))
    out = df.agg(
        n[0].cast("long").alias("n_1"), n[1].cast("long").alias("n_0"), (m[0] - m[1]).alias("difference"), F.try_divide(m[0] - m[1], F.sqrt(e[0] + e[1])).alias("t"),
        F.try_divide(F.pow(e[0] + e[1], F.lit(2)), F.try_divide(e[0] * e[0], n[0] - 1) + F.try_divide(e[1] * e[1], n[1] - 1)).alias("df"),
        F.try_divide(m[0] - m[1], pooled).alias("d"),
    )
    return out.withColumn("p", t_p_value(F.col("t"), F.col("df")))


def rank_sum(df: DataFrame, c: str, label: str) -> DataFrame:
    """Mann-Whitney U (the lesser of both labels'), label 1's normal score with tie correction and the rank biserial.

    Ranks come from counts of distinct values, so ties cost nothing.
    """
    rows = df.where(F.col(c).isNotNull() & F.col(label).isin(0, 1))
    counts = rows.groupBy(F.col(c).alias("v")).agg(F.count_if(F.col(label) == 1).alias("a"), F.count_if(F.col(label) == 0).alias("b"))
    counts = counts.withColumn("t", F.col("a") + F.col("b"))
    t = F.col("t")
    ranked = running(counts, "v", {"_before": "t"}).withColumn("rank", F.col("_before") + (t + 1) / 2.0)
    s = ranked.agg(
        F.sum("a").alias("n_1"), F.sum("b").alias("n_0"), F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum(F.pow(t.cast("double"), F.lit(3)) - t).alias("ties")
    )
    n1, n0 = F.col("n_1").cast("double"), F.col("n_0").cast("double")
    n, u = n1 + n0, F.col("r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(u - n1 * n0 / 2, sd)
    return s.select("n_1", "n_0", F.least(u, n1 * n0 - u).alias("u"), z.alias("z"), normal_p_value(z).alias("p"), (2 * F.try_divide(u, n1 * n0) - 1).alias("biserial"))


def proportions(df: DataFrame, success: str, label: str) -> DataFrame:
    """Two-proportion z of label 1 against 0."""
    x = [F.count_if((F.col(success) == 1) & (F.col(label) == k)).cast("double") for k in (1, 0)]
    n = [F.count(F.when(F.col(label) == k, F.col(success))).cast("double") for k in (1, 0)]
    p = [F.try_divide(x[i], n[i]) for i in (0, 1)]
    pool = F.try_divide(x[0] + x[1], n[0] + n[1])
    z = F.try_divide(p[0] - p[1], F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), n[0]) + F.try_divide(F.lit(1.0), n[1]))))
    return df.agg(p[0].alias("p_1"), p[1].alias("p_0"), z.alias("z")).withColumn("p", normal_p_value(F.col("z")))


def one_sample(df: DataFrame, c: str, against: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """Mean, t, degrees of freedom and two-sided ``p`` of the present values against a number; of a difference of two columns it is the paired test."""
    n, sd = F.count(c), F.stddev_samp(c)
    out = df.groupBy(*(by or [])).agg(n.alias("n"), F.avg(c).alias("mean"), F.try_divide(F.avg(c) - against, sd / F.sqrt(n)).alias("t"), (n - 1).alias("df"))
    return out.withColumn("p", t_p_value(F.col("t"), F.col("df")))


def false_discovery(df: DataFrame, p: str) -> DataFrame:
    """Benjamini-Hochberg: ``q`` is the least p * m / rank of this and larger p."""
    rows = df.where(F.col(p).isNotNull()).withColumn("_one", F.lit(1))
    total = rows.agg(F.count(F.lit(1)).alias("_all"))  # one row
    ranked = running(rows, p, {"_before": "_one"}).crossJoin(F.broadcast(total))
    ranked = ranked.withColumn("_raw", F.col(p) * F.col("_all") / (F.col("_before") + 1))
    return least_after(ranked, p, "_raw", "_q").withColumn("q", F.least(F.lit(1.0), "_q")).drop("_one", "_before", "_all", "_raw", "_q")


def standard_normal_cdf(x: Column) -> Column:
    """By Abramowitz and Stegun 7.1.26 (error below 2e-7)."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return 0.5 * (1 + F.signum(x) * erf)


def normal_p_value(z: Column) -> Column:
    return 2 * (1 - standard_normal_cdf(F.abs(z)))


def classification(df: DataFrame, score: str, label: str, cut: float = 0.5) -> DataFrame:
    """AUC by ranks, Brier score, log loss, accuracy, precision and recall in one row."""
    # the share of pairs that label 1 wins, which the lesser U would fold to at most a half
    auc = rank_sum(df, score, label).select(((F.col("biserial") + 1) / 2).alias("auc"))
    p = F.least(F.greatest(F.col(score), F.lit(1e-12)), F.lit(1 - 1e-12))
    hit, y = (F.col(score) >= cut).cast("int"), F.col(label)
    rest = df.where(F.col(score).isNotNull() & y.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(score) - y, F.lit(2))).alias("brier"), F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"),
        F.avg((hit == y).cast("double")).alias("accuracy"), F.try_divide(F.sum(hit * y), F.sum(hit)).alias("precision"), F.try_divide(F.sum(hit * y), F.sum(y)).alias("recall"),
    )
    return auc.crossJoin(F.broadcast(rest))  # one row each


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    at = F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).cast("long")
    return df.where(F.col(score).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("predicted"), F.avg(label).alias("observed"))


def errors(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """n, RMSE, MAE, bias and R2 of predictions."""
    d = F.col(predicted) - F.col(actual)
    rows = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"),
        (1 - F.try_divide(F.sum(d * d), F.var_pop(actual) * F.count(F.lit(1)))).alias("r2"),
    )


def fits(df: DataFrame, c: str, by: list[str]) -> DataFrame:
    """Parameters of five distributions fitted to the present values of each group, by moments or likelihood.

    Normal (``mean``, ``sd``), Poisson (``rate``), exponential (``decay``, missing for a mean
    of 0), negative binomial (``size``, ``chance``, missing unless the variance exceeds a
    positive mean) and beta (``alpha``, ``beta``, 1 and 1 for a constant or a mean beyond 0 to 1).
    """
    rows = df.where(F.col(c).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), F.var_samp(c).alias("_v"))
    m, v = F.col("mean"), F.col("_v")
    wide, share = (v > m) & (m > 0), (v > 0) & (m > 0) & (m < 1)
    common = F.try_divide(m * (1 - m), v) - 1
    return rows.select(
        *by, "n", "mean", F.sqrt(v).alias("sd"), m.alias("rate"), F.try_divide(F.lit(1.0), m).alias("decay"), F.when(wide, F.try_divide(m * m, v - m)).alias("size"), F.when(wide, m / v).alias("chance"),
        F.when(share, m * common).otherwise(1.0).alias("alpha"), F.when(share, (1 - m) * common).otherwise(1.0).alias("beta"),
    )


def normal_plot(df: DataFrame, c: str) -> DataFrame:
    """``value``, ``n``, and the ``low`` and ``high`` plotting positions (place - 3/8) / (count + 1/4) of equal values.

    A normal quantile of a position against its value is a point of the plot; equal
    values are one row, numbered by ranges.
    """
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))  # one row
    placed = running(counts, "value", {"_before": "n"}).crossJoin(F.broadcast(total))
    at = lambda place: (place - 0.375) / (F.col("_all") + 0.25)
    return placed.select("value", "n", at(F.col("_before") + 1).alias("low"), at(F.col("_before") + F.col("n")).alias("high"))


def _of_two(tail: Callable[[float, float], float], a: Column, b: Column) -> Column:
    """A tail probability of two columns; meant for one row a test."""
    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) else tail(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(each, "double")(a.cast("double"), b.cast("double"))


def departure(df: DataFrame, c: str, share: Callable[[Column], Column]) -> DataFrame:
    """Kolmogorov-Smirnov: ``n``, the greatest distance ``d`` of the present values from a distribution function, and ``p``.

    Equal values are one row, numbered by ranges.
    """
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    total = counts.agg(F.sum("k").alias("n"))  # one row
    placed = running(counts, "v", {"_before": "k"}).crossJoin(F.broadcast(total)).withColumn("_f", share(F.col("v")))
    apart = F.greatest(F.abs((F.col("_before") + F.col("k")) / F.col("n") - F.col("_f")), F.abs(F.col("_f") - F.col("_before") / F.col("n")))
    found = placed.agg(F.max("n").alias("n"), F.max(apart).alias("d"))
    return found.withColumn("p", _of_two(special.kolmogorov_upper, F.col("d"), F.col("n")))


def poisson_fit(df: DataFrame, c: str) -> DataFrame:
    """Chi-square of counts against a Poisson of their mean: ``n``, ``cells``, ``statistic``, ``df`` and ``p``.

    Counts whose expectation is below 5, and all beyond the largest, are one cell.
    """
    value = F.round(F.col(c)).cast("long")
    seen = df.where(F.col(c).isNotNull()).groupBy(value.alias("k")).agg(F.count(F.lit(1)).alias("o"), F.sum(F.col(c).cast("double")).alias("s"))
    total = seen.agg(F.sum("o").alias("n"), (F.sum("s") / F.sum("o")).alias("rate"), F.max("k").alias("top"))  # one row
    # beyond so many deviations no count is expected five times in any table
    last = F.least("top", F.ceil(F.col("rate") + 40 * F.sqrt("rate") + 40).cast("long"))
    grid = total.where("rate > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    logs = F.sum(F.ln(F.greatest("k", F.lit(1)).cast("double"))).over(Window.orderBy("k"))  # as many rows as the rate calls for
    expected = F.col("n") * F.exp(-F.col("rate") + F.col("k") * F.ln("rate") - F.col("_logs"))
    cells = grid.withColumn("_logs", logs).withColumn("e", expected).where("e >= 5").join(seen.select("k", "o"), "k", "left").fillna(0, ["o"])
    sums = cells.groupBy("n").agg(F.count(F.lit(1)).alias("m"), F.sum("e").alias("se"), F.sum("o").alias("so"), F.sum(F.pow(F.col("o") - F.col("e"), F.lit(2)) / F.col("e")).alias("x"))
    rest, pooled = F.col("n") - F.col("se"), F.col("n") - F.col("so")
    out = sums.select("n", (F.col("m") + 1).alias("cells"), (F.col("x") + F.pow(pooled - rest, F.lit(2)) / rest).alias("statistic"), F.greatest(F.lit(1), F.col("m") - 1).cast("long").alias("df"))
    return out.withColumn("p", _of_two(special.chi2_upper, F.col("statistic"), F.col("df")))
