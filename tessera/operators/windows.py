"""Windows over ordered series: every one takes a total order and yields NULL for missing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def zscore(c: Column, over: WindowSpec) -> Column:
    """Distance from the mean in sample deviations; of a constant missing."""
    return F.try_divide(c - F.avg(c).over(over), F.stddev_samp(c).over(over))


def ordinal(c: Column, by: list[str], tie: list[str]) -> Column:
    """1-based place among the present values, ties in the order of ``tie``."""
    spec = Window.partitionBy(*by, c.isNull()).orderBy(c, *tie)
    return F.when(c.isNotNull(), F.row_number().over(spec))


def share_rank(c: Column, by: list[str], tie: list[str]) -> Column:
    """Place from 0 to 1; 0.5 for a lone value."""
    n = F.count(c).over(Window.partitionBy(*by))
    place = ordinal(c, by, tie)
    return F.when(place.isNotNull(), F.when(n > 1, (place - 1) / F.when(n > 1, n - 1)).otherwise(0.5))


def average_rank(c: Column, by: list[str]) -> Column:
    """1-based rank in which tied values share the mean of their places."""
    spec = Window.partitionBy(*by, c.isNull())
    return F.when(c.isNotNull(), F.rank().over(spec.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2.0)


def difference(c: Column, over: WindowSpec, n: int = 1) -> Column:
    return c - F.lag(c, n).over(over)


def rolling(c: Column, over: WindowSpec, n: int, how: str, at_least: int | None = None) -> Column:
    """``how`` of the last n rows.

    Without ``at_least`` it is missing until n rows exist and skips missing values
    among them; with it, missing until so many values are present.
    """
    frame = over.rowsBetween(-(n - 1), 0)
    value = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "sd": F.stddev_samp}[how](c).over(frame)
    ready = F.count(F.lit(1)).over(frame) >= n if at_least is None else F.count(c).over(frame) >= at_least
    return F.when(ready, value)


def running_total(c: Column, over: WindowSpec) -> Column:
    """Total so far, carried over missing values; missing before the first."""
    return F.sum(c).over(over.rowsBetween(Window.unboundedPreceding, 0))


def drawdown(c: Column, over: WindowSpec) -> Column:
    return c - F.max(c).over(over.rowsBetween(Window.unboundedPreceding, 0))


def smoothed(df: DataFrame, c: str, name: str, by: list[str], order: list[str], half_life: float) -> DataFrame:
    """Add the exponentially weighted mean of ``c``; a missing value carries the state on.

    The frame ends where weights fall below the precision of a double, so a row costs
    the same however long its series is.
    """
    alpha = 1 - math.exp(-math.log(2) / half_life)
    reach = max(1, math.ceil(60 * half_life))
    seen = df.withColumn("_seen", F.count(c).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    # by values seen, so that missing rows don't use up the frame
    held = F.collect_list(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).cast("double").alias("_x")))).over(
        Window.partitionBy(*by).orderBy("_seen").rangeBetween(-reach, 0)
    )
    mean = F.aggregate(
        F.array_sort(held), F.lit(None).cast("double"), lambda s, v: F.when(s.isNull(), v["_x"]).otherwise(s + alpha * (v["_x"] - s))
    )
    return seen.withColumn(name, mean).drop("_seen")


def forward_strict(c: Column, over: WindowSpec, steps: int) -> Column:
    """Sum of the next ``steps`` rows, missing if any of them is."""
    frame = over.rowsBetween(1, steps)
    return F.when(F.count(c).over(frame) == steps, F.sum(c).over(frame))


def forward_lenient(c: Column, over: WindowSpec, steps: int) -> Column:
    """Sum of the present values of the next ``steps`` rows, which must exist."""
    frame = over.rowsBetween(1, steps)
    return F.when(F.count(F.lit(1)).over(frame) == steps, F.coalesce(F.sum(c).over(frame), F.lit(0.0)))


def half_life(df: DataFrame, c: str, by: list[str], order: list[str]) -> DataFrame:
    """``phi`` (slope on the previous present value) and ``half_life`` of every series."""
    rows = df.where(F.col(c).isNotNull())
    rows = rows.withColumn("_before", F.lag(c).over(Window.partitionBy(*by).orderBy(*order)))
    fitted = rows.where("_before IS NOT NULL").groupBy(*by).agg(
        F.try_divide(F.covar_pop(c, "_before"), F.var_pop("_before")).alias("phi")
    )
    decays = (F.col("phi") > 0) & (F.col("phi") < 1)
    return fitted.withColumn("half_life", F.when(decays, -math.log(2) / F.ln(F.when(decays, F.col("phi")))).otherwise(float("inf")))


def seasonality(df: DataFrame, c: str, by: list[str], order: list[str], period: int) -> DataFrame:
    """Mean by place in the period, and its distance from the series' mean."""
    at = F.pmod(F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1, F.lit(period)).alias("phase")
    rows = df.select(*by, at, F.col(c).alias("_v"), F.avg(c).over(Window.partitionBy(*by)).alias("_mean"))
    return rows.groupBy(*by, "phase").agg(F.avg("_v").alias("mean"), (F.avg("_v") - F.first("_mean")).alias("effect"))


def autocorrelation(df: DataFrame, c: str, by: list[str], order: list[str], lags: int) -> DataFrame:
    """``lag``, ``acf`` and ``pairs`` of every series, about its own mean."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.where(F.col(c).isNotNull()).withColumn("_d", F.col(c) - F.avg(c).over(Window.partitionBy(*by)))
    rows = rows.select(*by, "_d", *(F.lag("_d", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)))
    out = rows.groupBy(*by).agg(
        F.sum(F.col("_d") * F.col("_d")).alias("_s"),
        *(F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_p{k}") for k in range(1, lags + 1)),
        *(F.count(f"_l{k}").alias(f"_n{k}") for k in range(1, lags + 1)),
    )
    each = F.array(*(F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_p{k}"), F.col("_s")).alias("acf"), F.col(f"_n{k}").alias("pairs")) for k in range(1, lags + 1)))
    return out.select(*by, F.explode(each).alias("e")).select(*by, "e.lag", "e.acf", "e.pairs")


def partial_autocorrelation(df: DataFrame, c: str, by: list[str], order: list[str], lags: int) -> DataFrame:
    """``lag``, ``pacf`` and Bartlett's ``band`` of every series, by Durbin and Levinson's recursion.

    A series shorter than three values or constant has no rows; one of n values has lags up to n - 1.
    """
    r = autocorrelation(df, c, by, order, lags).where("acf IS NOT NULL AND pairs > 0")
    each = r.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("lag", "acf"))).alias("_r"), F.max(F.col("pairs") + F.col("lag")).alias("_n")).where("_n >= 3")
    each = each.withColumn("_r", F.col("_r.acf"))
    # phi holds the coefficients of the last order, out the last one of every order
    following = """aggregate(sequence(1, size(_r)), named_struct('phi', array_repeat(0.0D, 0), 'out', array_repeat(0.0D, 0)), (a, k) -> transform(array(
      coalesce(try_divide(_r[k - 1] - aggregate(transform(a.phi, (p, j) -> p * _r[k - 2 - j]), 0.0D, (s, p) -> s + p), 1 - aggregate(transform(a.phi, (p, j) -> p * _r[j]), 0.0D, (s, p) -> s + p)), 0.0D)),
      v -> named_struct('phi', concat(transform(a.phi, (p, j) -> p - v * a.phi[k - 2 - j]), array(v)), 'out', concat(a.out, array(v))))[0], a -> a.out)"""
    found = each.select(*by, (1.96 / F.sqrt("_n")).alias("band"), F.posexplode(F.expr(following)).alias("_i", "pacf"))
    return found.select(*by, (F.col("_i") + 1).alias("lag"), "pacf", "band")


def tied_awards(score: Column, by: list[str], awards: tuple[int, ...] = (3, 2, 1)) -> Column:
    """Awards by rank; a tied group takes the award of its first place and uses up its places."""
    rank = F.rank().over(Window.partitionBy(*by).orderBy(score.desc()))
    return F.coalesce(F.get(F.array(*map(F.lit, awards)), rank - 1), F.lit(0))
