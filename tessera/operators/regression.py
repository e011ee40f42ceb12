"""Least squares with diagnostics, ridge over folds, logistic regression and inflation factors.

A fit is a few aggregations whose results have the size of the predictors; what is
said of single rows is column algebra with the solved coefficients.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import special

from .ordering import running

TERMS = "term string, estimate double, standard_error double, t double, p double, lower double, upper double"


def _dot(columns: list[Column], factors: np.ndarray) -> Column:
    out = F.lit(0.0)
    for c, f in zip(columns, factors.tolist(), strict=True):
        out = out + c * f
    return out


def _products(rows: DataFrame, columns: list[Column], by: list[str] | None = None, weight: Column | None = None) -> list[tuple[list, np.ndarray]]:
    """For each group its key and the matrix of sums of products of ``columns``, in one aggregation."""
    k, weight = len(columns), F.lit(1.0) if weight is None else weight
    sums = [F.sum(weight * columns[i] * columns[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    out = []
    for row in rows.groupBy(*(by or [])).agg(*sums).collect():  # one row a group; groups are folds
        m = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                m[i, j] = m[j, i] = row[f"p{i}_{j}"] or 0.0
        out.append(([row[c] for c in by or []], m))
    return out


def _complete(df: DataFrame, xs: list[str], y: str) -> tuple[DataFrame, np.ndarray]:
    """Rows without a missing value, and the means of xs and y."""
    rows = df.dropna(subset=[*xs, y])
    means = rows.agg(*(F.avg(F.col(c).cast("double")) for c in (*xs, y))).first()
    return rows, np.array([m if m is not None else 0.0 for m in means])


def _centred(names: list[str], means: np.ndarray) -> list[Column]:
    return [F.col(c).cast("double") - float(m) for c, m in zip(names, means, strict=True)]


def _uncentred(inverse: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The covariance of (intercept, slopes) from that with centred predictors."""
    shift = np.eye(len(inverse))
    shift[0, 1:] = -means
    return shift @ inverse @ shift.T


@dataclass(frozen=True)
class LeastSquares:
    """A fit of y on an intercept and xs; ``inverse`` belongs to centred predictors."""

    xs: list[str]
    y: str
    means: np.ndarray
    beta: np.ndarray
    inverse: np.ndarray
    covariance: np.ndarray
    n: int
    rss: float
    tss: float

    @property
    def k(self) -> int:
        return len(self.xs) + 1

    def fitted(self) -> Column:
        return F.lit(float(self.beta[0])) + _dot([F.col(c).cast("double") for c in self.xs], self.beta[1:])

    def rows(self, df: DataFrame) -> DataFrame:
        """Add ``fitted``, ``residual``, ``leverage`` and Cook's distance ``cooks`` to the complete rows."""
        x = [F.lit(1.0), *_centred(self.xs, self.means[:-1])]
        leverage = _dot([_dot(x, line) * c for c, line in zip(x, self.inverse, strict=True)], np.ones(self.k))
        out = df.dropna(subset=[*self.xs, self.y]).withColumns({"fitted": self.fitted(), "leverage": leverage})
        out = out.withColumn("residual", F.col(self.y).cast("double") - F.col("fitted"))
        h, s2 = F.col("leverage"), self.rss / (self.n - self.k)
        cooks = F.try_divide(F.col("residual") * F.col("residual") * h, self.k * s2 * (1 - h) * (1 - h))
        return out.withColumn("cooks", F.when(h >= 1, F.lit(math.inf)).otherwise(cooks))

    def coefficients(self, level: float = 0.95) -> list[tuple]:
        """A tuple of the columns ``TERMS`` for each term."""
        df, out = self.n - self.k, []
        reach = special.t_critical(level, df)
        for name, b, v in zip(["intercept", *self.xs], self.beta.tolist(), np.diag(self.covariance).tolist(), strict=True):
            se = math.sqrt(v)
            t = b / se if se else None
            out.append((name, b, se, t, special.t_two_sided(t, df) if t is not None else None, b - reach * se, b + reach * se))
        return out

    def summary(self, df: DataFrame, order: list[str] | None = None) -> dict:
        """Measures of the whole fit; Durbin-Watson if ``order`` names the rows' total order."""
        n, k, free = self.n, self.k, self.n - self.k
        r2 = 1 - self.rss / self.tss if self.tss > 0 else None
        f = (self.tss - self.rss) / (k - 1) / (self.rss / free) if k > 1 and self.rss > 0 else None
        likelihood = -0.5 * n * (math.log(2 * math.pi) + math.log(self.rss / n) + 1) if self.rss > 0 else None
        rows = self.rows(df)
        e2 = F.col("residual") * F.col("residual")
        # Breusch-Pagan: n R2 of squared residuals on the fit
        share = rows.agg(F.corr(e2, F.col("fitted"))).first()[0]
        lm = n * share * share if n >= k + 3 and share is not None and not math.isnan(share) else None
        out = {
            "n": n, "k": k, "r2": r2, "adjusted_r2": 1 - (1 - r2) * (n - 1) / free if r2 is not None else None, "f": f,
            "f_p": special.f_upper(f, k - 1, free) if f is not None else None, "residual_se": math.sqrt(self.rss / free), "log_likelihood": likelihood,
            "aic": None if likelihood is None else -2 * likelihood + 2 * (k + 1), "bic": None if likelihood is None else -2 * likelihood + math.log(n) * (k + 1),
            "breusch_pagan": lm, "breusch_pagan_p": None if lm is None else special.normal_two_sided(math.sqrt(lm)),
        }
        if order:
            out["durbin_watson"] = durbin_watson(rows, order)
        return out


def durbin_watson(rows: DataFrame, order: list[str]) -> float | None:
    """Squared steps between neighbouring residuals over their sum of squares.

    ``order`` is a total order whose first column is a number; places come from sums
    over ranges of it, and neighbours meet by an equi join on the place.
    """
    one = rows.select(*order, "residual").withColumn("_one", F.lit(1))
    placed = running(one, order[0], {"_at": "_one"}, tie=order[1:]).select("_at", "residual")
    before = placed.select((F.col("_at") + 1).alias("_at"), F.col("residual").alias("_before"))
    step = F.col("residual") - F.col("_before")
    found = placed.join(before, "_at", "left").agg(F.sum(step * step), F.sum(F.col("residual") * F.col("residual"))).first()
    return None if not found[1] else (found[0] or 0.0) / found[1]


def ols(df: DataFrame, xs: list[str], y: str, robust: bool = False) -> LeastSquares:
    """Ordinary least squares of the complete rows; ``robust`` gives HC1 errors from a second pass."""
    rows, means = _complete(df, xs, y)
    centred = _centred([*xs, y], means)
    (_, m), = _products(rows, [F.lit(1.0), *centred])
    n, k = int(m[0, 0]), len(xs) + 1
    if n <= k:
        raise ValueError(f"{n} complete rows do not determine {k} coefficients")
    scale = np.sqrt(np.diag(m)[:k])
    scale[scale == 0] = 1
    inverse = np.linalg.inv(m[:k, :k] / np.outer(scale, scale)) / np.outer(scale, scale)
    slopes = inverse @ m[:k, k]
    rss = max(0.0, float(m[k, k] - slopes @ m[:k, k]))
    beta = slopes.copy()
    beta[0] = means[-1] + slopes[0] - means[:-1] @ slopes[1:]
    if robust:
        e = centred[-1] - _dot([F.lit(1.0), *centred[:-1]], slopes)
        (_, meat), = _products(rows, [F.lit(1.0), *centred[:-1]], weight=e * e)
        covariance = inverse @ meat @ inverse * n / (n - k)
    else:
        covariance = inverse * rss / (n - k)
    return LeastSquares(list(xs), y, means, beta, inverse, _uncentred(covariance, means[:-1]), n, rss, float(m[k, k] - m[0, k] ** 2 / n))


def ridge(df: DataFrame, xs: list[str], y: str, fold: Column, lambdas: tuple[float, ...] = (0.01, 0.1, 1, 3, 10, 30, 100, 300, 1000)) -> dict:
    """Ridge over predictors in population deviations, its penalty chosen by the error over folds.

    One aggregation gives the products within each fold; the penalties' errors on the
    fold that is left out follow from those.  Returns ``penalty``, ``intercept``, ``slopes``, ``r2``, ``n`` and the ``path``.
    """
    rows, means = _complete(df, xs, y)
    k = len(xs)
    columns = [F.lit(1.0), *_centred([*xs, y], means)]
    parts = [m for _, m in _products(rows.withColumn("_fold", fold), columns, by=["_fold"])]
    if not parts or sum(m[0, 0] for m in parts) <= 2:
        raise ValueError("too few complete rows")
    whole = sum(parts)
    sds = np.sqrt(np.diag(whole)[1 : k + 1] / whole[0, 0])
    sds[sds == 0] = 1
    scale = 1 / np.concatenate(([1.0], sds, [1.0]))
    parts, whole = [m * np.outer(scale, scale) for m in parts], whole * np.outer(scale, scale)
    x, t = slice(1, k + 1), k + 1

    def solved(m: np.ndarray, penalty: float) -> np.ndarray:
        return np.linalg.solve(m[x, x] + penalty * np.eye(k), m[x, t])

    def error(m: np.ndarray, beta: np.ndarray) -> float:
        return float(m[t, t] - 2 * beta @ m[x, t] + beta @ m[x, x] @ beta)

    path = [(p, float(sum(error(m, solved(whole - m, p)) for m in parts) / whole[0, 0])) for p in lambdas]
    penalty = min(path, key=lambda entry: entry[1])[0]
    beta = solved(whole, penalty)
    slopes = beta / sds
    return {
        "penalty": penalty, "intercept": float(means[-1] - slopes @ means[:-1]), "slopes": slopes.tolist(), "n": int(whole[0, 0]), "path": path,
        "r2": 1 - error(whole, beta) / whole[t, t] if whole[t, t] > 0 else None,
    }


def inflation(df: DataFrame, xs: list[str]) -> DataFrame:
    """``term`` and ``vif``: the diagonal of the inverse correlation matrix of the complete rows; missing where one is a sum of others."""
    rows, means = _complete(df, xs[1:], xs[0])
    means = np.append(means[-1], means[:-1])
    (_, m), = _products(rows, _centred(xs, means))
    scale = np.sqrt(np.diag(m))
    r = m / np.where(scale > 0, scale, 1)[:, None] / np.where(scale > 0, scale, 1)[None, :]
    known = bool((scale > 0).all()) and np.linalg.matrix_rank(r) == len(xs)
    found = np.diag(np.linalg.inv(r)).tolist() if known else [None] * len(xs)
    return df.sparkSession.createDataFrame(list(zip(xs, found, strict=True)), "term string, vif double")


def logistic(df: DataFrame, xs: list[str], y: str, most: int = 50, tolerance: float = 1e-9) -> dict:
    """Logistic regression by iteratively reweighted least squares.

    Every step is one aggregation over the complete rows, which are kept for them.
    Returns ``coefficients`` (as ``TERMS``, z in the place of t), ``n``,
    ``log_likelihood``, ``null_log_likelihood``, ``pseudo_r2`` (McFadden), ``aic``,
    ``converged``, ``iterations`` and ``separated`` (rows fitted to within 1e-8 of 0 or 1).
    """
    rows, means = _complete(df, xs, y)
    rows = rows.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(xs)), F.col(y).cast("double").alias("y")).persist()
    try:
        x = [F.lit(1.0), *_centred([f"x{i}" for i in range(len(xs))], means[:-1])]
        k, beta, covariance = len(x), np.zeros(len(x)), None
        n, positives = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
        if n <= k:
            raise ValueError(f"{n} complete rows do not determine {k} coefficients")
        converged, steps = False, 0
        while steps < most and not converged:
            steps += 1
            eta = _dot(x, beta)
            mu = 1 / (1 + F.exp(-eta))
            weight = F.greatest(mu * (1 - mu), F.lit(1e-10))
            working = eta + (F.col("y") - mu) / weight
            (_, m), = _products(rows, [*x, working], weight=weight)
            scale = np.sqrt(np.diag(m)[:k])
            scale[scale == 0] = 1
            g = m[:k, :k] / np.outer(scale, scale)
            if np.linalg.cond(g) > 1e14:
                break
            now = np.linalg.solve(g, m[:k, k] / scale) / scale
            covariance = np.linalg.inv(g) / np.outer(scale, scale)
            step = now - beta
            step[0] -= means[:-1] @ step[1:]  # of the intercept where the predictors are 0
            converged, beta = float(np.abs(step).max()) < tolerance, now
        p = F.least(F.greatest(1 / (1 + F.exp(-_dot(x, beta))), F.lit(1e-12)), F.lit(1 - 1e-12))
        likelihood, separated = rows.agg(F.sum(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p)), F.count_if((p < 1e-8) | (p > 1 - 1e-8))).first()
    finally:
        rows.unpersist()
    base = min(max(positives / n, 1e-12), 1 - 1e-12)
    null = positives * math.log(base) + (n - positives) * math.log(1 - base)
    errors = np.sqrt(np.diag(_uncentred(covariance, means[:-1]))).tolist() if covariance is not None else [math.nan] * k
    raw = [float(beta[0] - means[:-1] @ beta[1:]), *beta[1:].tolist()]
    terms = []
    for name, b, se in zip(["intercept", *xs], raw, errors, strict=True):
        z = b / se if se else math.nan
        terms.append((name, b, se, z, special.normal_two_sided(z), b - 1.959963985 * se, b + 1.959963985 * se))
    return {
        "coefficients": terms, "n": n, "log_likelihood": likelihood, "null_log_likelihood": null, "pseudo_r2": 1 - likelihood / null if null else None,
        "aic": -2 * likelihood + 2 * k, "converged": converged, "iterations": steps, "separated": separated,
    }
