"""Evaluating a score against later results: (id, period, factor, forward) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import previous, quantiles
from .windows import average_rank, ordinal


def period_correlations(obs: DataFrame, least: int = 10) -> DataFrame:
    """``ic`` (Spearman, average ranks) and ``n`` of every period with ``least`` complete rows."""
    rows = obs.where("factor IS NOT NULL AND forward IS NOT NULL")
    ranked = rows.select("period", average_rank(F.col("factor"), ["period"]).alias("a"), average_rank(F.col("forward"), ["period"]).alias("b"))
    found = ranked.groupBy("period").agg(
        F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")).alias("ic"), F.count(F.lit(1)).alias("n")
    )
    return found.where((F.col("n") >= least) & F.col("ic").isNotNull())


def information_coefficient(obs: DataFrame, least: int = 10) -> DataFrame:
    """One row: periods, mean, sd, ratio, t statistic and the share of correlations with the mean's sign."""
    ics = period_correlations(obs, least)
    ratio = F.try_divide(F.avg("ic"), F.stddev_samp("ic"))
    positive = F.count_if(F.col("ic") > 0)
    periods = F.count(F.lit(1))
    hits = F.when(F.avg("ic") >= 0, positive).otherwise(periods - positive)
    return ics.agg(
        F.count(F.lit(1)).alias("periods"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("sd_ic"), ratio.alias("ratio"),
        (ratio * F.sqrt(F.count(F.lit(1)))).alias("t"), F.try_divide(hits, periods).alias("hit_rate"),
    )


def bucket_count(k: int) -> int:
    """Buckets are held to 2..20."""
    return max(2, min(20, k))


def buckets(obs: DataFrame, k: int, tie: str = "id", least: int | None = None) -> DataFrame:
    """Add ``bucket``, floor(place / n * k) within the period in order of factor.

    Periods with fewer than ``least`` complete rows (2 k unless given) are left out.
    """
    least, k = 2 * k if least is None else least, bucket_count(k)
    rows = obs.where("factor IS NOT NULL AND forward IS NOT NULL")
    w = Window.partitionBy("period")
    place = F.row_number().over(w.orderBy("factor", tie)) - 1
    rows = rows.withColumns({"_place": place, "_n": F.count(F.lit(1)).over(w)}).where(F.col("_n") >= least)
    return rows.withColumn("bucket", F.least(F.lit(k - 1), F.floor(F.col("_place") * F.lit(k) / F.col("_n"))).cast("int")).drop("_place", "_n")


def quantile_means(obs: DataFrame, k: int) -> DataFrame:
    return buckets(obs, k).groupBy("bucket").agg(F.avg("forward").alias("mean_forward"), F.count(F.lit(1)).alias("n"))


def spread(obs: DataFrame, k: int) -> DataFrame:
    """One row: mean, sd and t of the periods' top less bottom bucket."""
    rows, k = buckets(obs, k), bucket_count(k)
    tops = rows.groupBy("period").agg(
        (F.avg(F.when(F.col("bucket") == k - 1, F.col("forward"))) - F.avg(F.when(F.col("bucket") == 0, F.col("forward")))).alias("d")
    )
    t = F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("d")))
    return tops.agg(F.count("d").alias("periods"), F.avg("d").alias("mean_spread"), F.stddev_samp("d").alias("sd_spread"), t.alias("t"))


def top_turnover(obs: DataFrame, k: int) -> DataFrame:
    """``shared`` and ``turnover`` of each period's top 1/k against that of the period before it.

    The period before is the last one with a factor; where either has fewer than ``k``
    rows there is no result.
    """
    rows = obs.where("factor IS NOT NULL")
    w = Window.partitionBy("period")
    place = F.row_number().over(w.orderBy(F.desc("factor"), "id"))
    count = F.count(F.lit(1)).over(w)
    top = rows.select("id", "period", place.alias("place"), count.alias("n")).where((F.col("n") >= k) & (F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") / k))))
    top = top.select("id", "period").distinct()
    order = previous(rows.select("period").distinct(), "period", "before")
    sizes = top.groupBy("period").agg(F.count(F.lit(1)).alias("size"))
    met = order.join(sizes, "period").join(sizes.select(F.col("period").alias("before")), "before")
    current = top.join(met, "period")
    earlier = top.select("id", F.col("period").alias("before"), F.lit(1).alias("held"))
    kept = current.join(earlier, ["id", "before"], "left")
    found = kept.groupBy("period", "size").agg(F.count("held").alias("shared"))
    return found.select("period", "shared", (1 - F.col("shared") / F.col("size")).alias("turnover"))


def winsorised(df: DataFrame, c: str, share: float) -> DataFrame:
    """``c`` clamped to its own quantiles ``share`` and 1 - ``share``."""
    edge = quantiles(df, c, {"_lo": share, "_hi": 1 - share})  # one row
    return df.crossJoin(F.broadcast(edge)).withColumn(c, F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col("_lo")), F.col("_hi")))).drop("_lo", "_hi")


def rank_normalised(c: str, by: list[str], tie: list[str]):
    """(place + 0.5) / n within the group."""
    return (ordinal(F.col(c), by, tie) - 0.5) / F.count(c).over(Window.partitionBy(*by))
