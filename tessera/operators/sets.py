"""Upserts, differences and dominance between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(*frames: DataFrame) -> DataFrame:
    """All rows; columns that a frame lacks are missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def upsert(stored: DataFrame, run: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows whose key the run lacks, and the run."""
    return union(stored.join(run.select(*key).distinct(), key, "left_anti"), run)


def difference(before: DataFrame, after: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """``change`` (added, removed or changed), ``field``, ``old`` and ``new`` of each key.

    An added or removed row is one change without a field; values are text.
    """
    a = before.select(*key, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("_a"))
    b = after.select(*key, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("_b"))
    met = a.join(b, key, "full")
    changed = F.filter(
        F.array(*(F.struct(F.lit("changed").alias("change"), F.lit(f).alias("field"), F.col(f"_a.{f}").alias("old"), F.col(f"_b.{f}").alias("new"), F.equal_null(F.col(f"_a.{f}"), F.col(f"_b.{f}")).alias("same")) for f in fields)),
        lambda e: ~e["same"],
    )
    none = F.lit(None).cast("string")

    def whole(word: str):
        return F.array(F.struct(F.lit(word).alias("change"), none.alias("field"), none.alias("old"), none.alias("new"), F.lit(False).alias("same")))

    each = F.when(F.col("_a").isNull(), whole("added")).when(F.col("_b").isNull(), whole("removed")).otherwise(changed)
    return met.select(*key, F.explode(each).alias("e")).select(*key, "e.change", "e.field", "e.old", "e.new")


def skyline(df: DataFrame, cost: str, gain: str, by: list[str]) -> DataFrame:
    """Rows of each group that no other one matches in both lower ``cost`` and higher ``gain``.

    Of rows equal in both all stay.  A running maximum in order of cost decides.
    """
    dearer = Window.partitionBy(*by).orderBy(cost).rangeBetween(Window.unboundedPreceding, -1)
    level = Window.partitionBy(*by, cost)
    cheaper_best, same_best = F.max(gain).over(dearer), F.max(gain).over(level)
    rows = df.withColumn("_less", cheaper_best).withColumn("_same", same_best)
    return rows.where((F.col("_less").isNull() | (F.col(gain) > F.col("_less"))) & (F.col(gain) >= F.col("_same"))).drop("_less", "_same")


def kept_share(df: DataFrame, entity: str, period: str) -> DataFrame:
    """``shared`` and ``turnover`` of each period's entities against the next consecutive period's."""
    held = df.select(entity, period).distinct()
    later = held.select(entity, (F.col(period) - 1).alias(period))
    shared = held.join(later, [entity, period]).groupBy(period).agg(F.count(F.lit(1)).alias("shared"))
    sizes = held.groupBy(period).agg(F.count(F.lit(1)).alias("size"))
    following = sizes.select((F.col(period) - 1).alias(period), F.col("size").alias("next_size"))
    met = sizes.join(following, period).join(shared, period, "left").fillna(0, ["shared"])
    return met.withColumn("turnover", 1 - F.col("shared") / F.col("next_size"))


def distinct_sets(df: DataFrame, members: str, keep: str) -> DataFrame:
    """One row for each set of members, whatever their order and repetitions: the one with the smallest ``keep``, and how ``often`` it came."""
    rows = df.withColumn("_set", F.array_sort(F.array_distinct(members)))
    return rows.groupBy("_set").agg(F.min_by(F.struct(*df.columns), keep).alias("_row"), F.count(F.lit(1)).alias("often")).select("_row.*", "often")
