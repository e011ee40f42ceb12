"""Bootstrap and permutations by hashes of (row, resample): the same draws for any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of hashes around the place where a resample is expected to end.
RANGES = 64


def _hash(key: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("resample"), *(F.col(f"_k{i}") for i in range(len(key))))


def _narrow(df: DataFrame, key: list[str], **columns: Column) -> DataFrame:
    return df.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), *(v.alias(k) for k, v in columns.items()))


def _resampled(rows: DataFrame, resamples: int) -> DataFrame:
    return rows.withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples))))


def poisson_weight(code: Column) -> Column:
    """A Poisson(1) count from a 64-bit hash: how many of the distribution's steps it passes."""
    u = F.shiftrightunsigned(code, 11) / float(1 << 53)
    steps, share = [], 0.0
    for k in range(18):
        share += math.exp(-1) / math.factorial(k)
        steps.append((u >= share).cast("int"))
    out = steps[0]
    for step in steps[1:]:
        out = out + step
    return out


def draws(df: DataFrame, value: str, key: list[str], resamples: int, seed: int = 1, over: str | None = None) -> DataFrame:
    """``resample`` and its ``statistic``: the mean of ``value``, or the ratio of its sum to that of ``over``.

    Every row takes part in a resample as often as a Poisson weight says, so all
    resamples are partial sums of one pass.  Rows are told apart by ``key``.
    """
    rows = _narrow(df, key, v=F.col(value).cast("double"), o=F.col(over).cast("double") if over else F.lit(1.0)).where("v IS NOT NULL AND o IS NOT NULL")
    weighed = _resampled(rows, resamples).select("resample", "v", "o", poisson_weight(_hash(key, seed)).alias("w")).where("w > 0")
    sums = weighed.groupBy("resample").agg(F.sum(F.col("w") * F.col("v")).alias("v"), F.sum(F.col("w") * F.col("o")).alias("o"))
    return sums.select("resample", F.try_divide("v", "o").alias("statistic"))


def bootstrap(df: DataFrame, value: str, key: list[str], resamples: int = 2000, seed: int = 1, level: float = 0.95, over: str | None = None) -> DataFrame:
    """``estimate``, percentile bounds ``lower`` and ``upper`` by order statistics, ``standard_error`` and ``resamples`` in one row."""
    low, high = math.floor((1 - level) / 2 * (resamples - 1)), math.ceil((1 - (1 - level) / 2) * (resamples - 1))
    found = draws(df, value, key, resamples, seed, over).agg(  # as many numbers as resamples
        F.sort_array(F.collect_list("statistic")).alias("all"), F.stddev_samp("statistic").alias("standard_error"), F.count("statistic").alias("resamples")
    )
    v, o = F.col(value).cast("double"), F.col(over).cast("double") if over else F.lit(1.0)
    both = v.isNotNull() & o.isNotNull()
    estimate = df.agg(F.try_divide(F.sum(F.when(both, v)), F.sum(F.when(both, o))).alias("estimate"))
    return estimate.crossJoin(F.broadcast(found)).select("estimate", F.get("all", F.lit(low)).alias("lower"), F.get("all", F.lit(high)).alias("upper"), "standard_error", "resamples")


def permuted(df: DataFrame, value: str, label: str, key: list[str], resamples: int, seed: int = 1) -> DataFrame:
    """``resample`` and ``statistic``, the difference of means after the labels were shuffled.

    Each resample takes the rows with the least hashes, as many as label 1 has.  A sum
    for each (resample, range of hashes) tells the range in which they end; only rows
    of that range are ranked, so no task sorts a whole resample.  Hashes are spread evenly, so
    they end within some deviations of a known place: ranges are narrow there, and what
    lies below and above is one range each, whose number is the same for any table.
    """
    rows = _narrow(df, key, v=F.col(value).cast("double"), a=F.col(label).cast("int")).where("v IS NOT NULL AND a IN (0, 1)")
    n, n_1, total = rows.agg(F.count(F.lit(1)), F.sum("a"), F.sum("v")).first()
    if not n or not n_1 or n_1 == n:
        return df.sparkSession.createDataFrame([], "resample int, statistic double")
    share = n_1 / n
    reach = 8 * math.sqrt(share * (1 - share) / n) + 2 / n
    low, high = (int(min(1.0, max(0.0, share + side * reach)) * (1 << 62)) * 2 for side in (-1, 1))
    step = max(1, (high - low) // RANGES)
    coded = _resampled(rows, resamples).select("resample", "v", _hash(key, seed).alias("code"), *(f"_k{i}" for i in range(len(key))))
    inside = F.floor((F.shiftrightunsigned("code", 1) - F.lit(low)) / F.lit(step))
    coded = coded.withColumn("range", F.greatest(F.lit(-1).cast("long"), F.least(F.lit(RANGES).cast("long"), inside)))
    upto = Window.partitionBy("resample").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = coded.groupBy("resample", "range").agg(F.count(F.lit(1)).alias("m"), F.sum("v").alias("s"))  # RANGES and a few rows a resample
    ranges = ranges.withColumns({"before": F.coalesce(F.sum("m").over(upto), F.lit(0)), "below": F.coalesce(F.sum("s").over(upto), F.lit(0.0))})
    last = ranges.where((F.col("before") < n_1) & (F.col("before") + F.col("m") >= n_1)).select("resample", "range", "before", "below")
    place = F.row_number().over(Window.partitionBy("resample").orderBy(F.shiftrightunsigned("code", 1), "code", *(f"_k{i}" for i in range(len(key)))))
    taken = coded.join(F.broadcast(last), ["resample", "range"]).withColumn("place", place)  # a row a resample
    chosen = taken.groupBy("resample").agg((F.first("below") + F.sum(F.when(F.col("place") <= n_1 - F.col("before"), F.col("v")).otherwise(0.0))).alias("s"))
    return chosen.select("resample", (F.col("s") / n_1 - (F.lit(total) - F.col("s")) / (n - n_1)).alias("statistic"))


def permutation_test(df: DataFrame, value: str, label: str, key: list[str], resamples: int = 2000, seed: int = 1, alternative: str = "two-sided") -> DataFrame:
    """``observed`` difference of the means of labels 1 and 0, ``extreme`` resamples, ``p`` = (extreme + 1) / (resamples + 1)."""
    a = F.col(label).cast("int")
    observed = df.agg((F.avg(F.when(a == 1, F.col(value))) - F.avg(F.when(a == 0, F.col(value)))).alias("observed"))
    met = permuted(df, value, label, key, resamples, seed).crossJoin(F.broadcast(observed))  # one row
    room = 1e-12 * F.abs("observed")  # sums of the same rows in another order
    beyond = {
        "two-sided": F.abs("statistic") >= F.abs("observed") - room, "greater": F.col("statistic") >= F.col("observed") - room,
        "less": F.col("statistic") <= F.col("observed") + room,
    }[alternative]
    return met.groupBy("observed").agg(F.count_if(beyond).alias("extreme"), F.count(F.lit(1)).alias("resamples")).withColumn("p", (F.col("extreme") + 1.0) / (F.col("resamples") + 1))
