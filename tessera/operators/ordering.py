"""Running totals and ranks in the order of a number, without one task for all rows.

The order is cut at approximate quantiles, taken once; each part is one window, and
what comes before a part is a running sum over one row a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cuts_upto(cuts: list[float], value: Column) -> Column:
    """How many of the ascending ``cuts`` are at most the value, 0 for a missing one: found by halving, as rows are many."""
    if not cuts:
        return F.lit(0)
    held = F.array(*map(F.lit, cuts))
    steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    passed = lambda v, at, step: F.coalesce(F.get(held, at + step - 1) <= v, F.lit(False))
    upto = lambda v: F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(passed(v, at, step), at + step).otherwise(at))
    # no lambda names a column: where its id is as low as a lambda variable's, a join that infers filters would overlook it and fail
    return F.get(F.transform(F.array(value), upto), 0)


def part_of(df: DataFrame, c: str, parts: int | None = None) -> Column:
    """The part, 0 upwards, of each value of a numeric column; equal values share one."""
    parts = parts or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.select(F.col(c).cast("double").alias(c)).approxQuantile(c, [i / parts for i in range(1, parts)], 0.5 / parts))) if parts > 1 else []
    return cuts_upto(cuts, F.col(c))


def running(df: DataFrame, c: str, sums: dict[str, str], tie: list[str] | None = None, part: Column | None = None) -> DataFrame:
    """Add for each name the sum of a column over the rows before, in order of ``c`` and ``tie``.

    ``part`` is a number that rises with ``c``, for an order whose ranges are known; else they are found.
    """
    rows = df.withColumn("_part", part_of(df, c) if part is None else part)
    inside = Window.partitionBy("_part").orderBy(c, *(tie or [])).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part").agg(*(F.sum(v).alias(f"_t_{k}") for k, v in sums.items()))
    base = totals.select("_part", *(F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums))
    rows = rows.withColumns({k: F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()})
    joined = rows.join(F.broadcast(base), "_part")  # one row a part
    return joined.withColumns({k: F.col(k) + F.col(f"_b_{k}") for k in sums}).drop("_part", *(f"_b_{k}" for k in sums))


def value_ranks(df: DataFrame, c: str) -> DataFrame:
    """``value``, ``n`` and ``rank`` (the mean place of equal values, from 1) of the present values."""
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return running(counts, "value", {"_before": "n"}).select("value", "n", (F.col("_before") + (F.col("n") + 1) / 2.0).alias("rank"))


def least_after(df: DataFrame, c: str, value: str, name: str) -> DataFrame:
    """Add the least ``value`` of this row and all with a greater or equal ``c``."""
    rows = df.withColumn("_part", part_of(df, c))
    inside = Window.partitionBy("_part").orderBy(F.col(c).desc()).rangeBetween(Window.unboundedPreceding, 0)
    later = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_part").agg(F.min(value).alias("_m")).select("_part", F.min("_m").over(later).alias("_later"))
    return rows.withColumn("_own", F.min(value).over(inside)).join(F.broadcast(base), "_part").withColumn(name, F.least("_own", "_later")).drop("_part", "_own", "_later")


def greatest_upto(df: DataFrame, c: str, value: str, name: str) -> DataFrame:
    """Add the greatest ``value`` of this row and all with a lesser or equal ``c``; null if none is present."""
    rows = df.withColumn("_part", part_of(df, c))
    inside = Window.partitionBy("_part").orderBy(c).rangeBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a part
    base = rows.groupBy("_part").agg(F.max(value).alias("_m")).select("_part", F.max("_m").over(earlier).alias("_earlier"))
    return rows.withColumn("_own", F.max(value).over(inside)).join(F.broadcast(base), "_part").withColumn(name, F.greatest("_own", "_earlier")).drop("_part", "_own", "_earlier")


def previous(df: DataFrame, c: str, name: str) -> DataFrame:
    """Add the next lesser ``c`` to each row of a table of distinct values of it."""
    rows = df.withColumn("_part", part_of(df, c))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a part
    base = rows.groupBy("_part").agg(F.max(c).alias("_m")).select("_part", F.max("_m").over(earlier).alias("_earlier"))
    own = F.lag(c).over(Window.partitionBy("_part").orderBy(c))
    return rows.withColumn("_own", own).join(F.broadcast(base), "_part").withColumn(name, F.coalesce("_own", "_earlier")).drop("_part", "_own", "_earlier")


def quantiles(df: DataFrame, c: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact type-7 quantiles of the present values, by name, one row a group.

    Counts of distinct values are numbered by ranges, so no task or buffer holds the
    values of a group: each quantile is two order statistics.
    """
    by = by or []
    rows = df.where(F.col(c).isNotNull()).groupBy(*by, F.col(c).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("_part", part_of(df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("_v")), "_v"))
    inside = Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a part
    sums = rows.groupBy(*by, "_part").agg(F.sum("_n").alias("_s"))
    base = sums.select(*by, "_part", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"), F.sum("_s").over(Window.partitionBy(*by)).alias("_all"))
    placed = rows.withColumn("_upto", F.sum("_n").over(inside)).join(base, [*by, "_part"])
    upto = F.col("_before") + F.col("_upto")

    def at(place: Column) -> Column:
        """The value at a place counted from 0."""
        return F.max(F.when((upto - F.col("_n") <= place) & (place < upto), F.col("_v")))

    out = []
    for name, share in shares.items():
        place = (F.col("_all") - 1) * F.lit(float(share))
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return placed.groupBy(*by).agg(*out)
