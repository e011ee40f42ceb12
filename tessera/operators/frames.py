"""Grouping, pivoting, binning and summaries of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running

AGGREGATIONS = {
    "mean": F.avg,
    "sum": F.sum,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "sd": F.stddev_samp,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "p10": lambda c: F.percentile(c, F.lit(0.1)),
    "p90": lambda c: F.percentile(c, F.lit(0.9)),
}


def group(df: DataFrame, keys: list[str], wanted: list[tuple[str, str, str]]) -> DataFrame:
    """Aggregates (column, aggregation, name) by keys, and ``count`` of all rows."""
    return df.groupBy(*keys).agg(*(AGGREGATIONS[how](F.col(c)).alias(name) for c, how, name in wanted), F.count(F.lit(1)).alias("count"))


def pivot(df: DataFrame, row: str, column: str, value: str, how: str, labels: list) -> DataFrame:
    """One column for each label; a cell without rows is missing."""
    return df.groupBy(row).pivot(column, labels).agg(AGGREGATIONS[how](F.col(value)))


def bin_of(c: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin, the upper edge in the last."""
    width = F.try_divide(high - low, F.lit(float(bins)))
    return F.when(c.isNotNull(), F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide(c - low, width))), F.lit(0))).cast("long")


def surface(df: DataFrame, x: str, y: str, z: str, bins: int, how: str = "mean") -> DataFrame:
    """``how`` of z on a dense grid of x and y; cells without rows are missing, with count 0."""
    bins = min(40, max(4, bins))
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    edge = rows.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    placed = rows.crossJoin(F.broadcast(edge)).select(  # one row of edges
        bin_of(F.col(x), F.col("x0"), F.col("x1"), bins).alias("x_bin"), bin_of(F.col(y), F.col("y0"), F.col("y1"), bins).alias("y_bin"), F.col(z).alias("z")
    )
    found = placed.groupBy("x_bin", "y_bin").agg(AGGREGATIONS[how](F.col("z")).alias("value"), F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(bins * bins).select((F.col("id") % bins).alias("x_bin"), F.expr(f"id div {bins}").alias("y_bin"))
    return grid.join(found, ["x_bin", "y_bin"], "left").fillna(0, ["count"])


def summary(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.count(c).alias("count"), F.count_if(F.col(c).isNull()).alias("missing"))


def strided(df: DataFrame, key: str, limit: int, tie: list[str] | None = None) -> DataFrame:
    """Every k-th row in order of a numeric key, k the least that leaves ``limit`` rows or fewer."""
    k = max(1, -(-df.count() // limit))
    numbered = running(df.withColumn("_one", F.lit(1)), key, {"_n": "_one"}, tie)
    return numbered.where(F.col("_n") % k == 0).drop("_n", "_one")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def first_flagged(df: DataFrame, flag: Column, order: list[Column]) -> DataFrame:
    """The first row, in ``order``, for which ``flag`` holds; no row if none does."""
    return df.where(flag).orderBy(*order).limit(1)


def listed(df: DataFrame, filters: list[Column], order: list[Column], offset: int, limit: int, most: int = 500) -> DataFrame:
    """A page of at most ``most`` rows that all filters hold for."""
    for one in filters:
        df = df.where(one)
    return page(df, order, max(0, offset), max(1, min(most, limit)))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    spec = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(spec)).where(F.col("place") <= n)


def modal(df: DataFrame, by: list[str], label: str, when: str) -> DataFrame:
    """The commonest label of each group; of equal ones that seen last."""
    counted = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"), F.max(when).alias("_last"))
    return counted.groupBy(*by).agg(F.max_by(label, F.struct("n", "_last", label)).alias(label), F.max("n").alias("n"))


def validate(df: DataFrame, rules: dict[str, Column], most: int = 10) -> None:
    """Raise with at most ``most`` rows that break a rule (null counts as kept)."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items())), lambda r: r.isNotNull())
    bad = df.withColumn("_broken", broken).where(F.size("_broken") > 0).limit(most).collect()
    if bad:
        raise ValueError("; ".join(f"{r['_broken']}: {r.asDict()}" for r in bad))
