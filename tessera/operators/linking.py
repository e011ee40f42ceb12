"""Lookups into nested lists, names by aliases and prefixes, and joins within tolerances.

Every join here is an equi join: on an exploded element, on prefixes or their first
letters, on buckets of time, or on cells of a grid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested_lookup(df: DataFrame, key: list[str], items: str, field: str, lookup: DataFrame, found: str, value: str, name: str) -> DataFrame:
    """Add to each struct of the list ``items`` the field ``name``: ``lookup``'s ``value`` where ``found`` equals ``field``.

    ``key`` names a row.  Elements are exploded with their places, joined by key and put
    back in order; missing elements, and elements without or with an unknown id, stay
    with a null.  Null lists stay null and empty ones empty.  Of several values of an id the greatest counts.
    """
    single = lookup.where(F.col(found).isNotNull()).groupBy(F.col(found).alias("_id")).agg(F.max(value).alias("_value"))
    each = df.select(*key, F.posexplode(items).alias("_at", "_item")).withColumn("_id", F.col(f"_item.{field}"))
    met = each.join(single, "_id", "left")
    whole = F.when(F.col("_item").isNotNull(), F.col("_item").withField(name, F.col("_value")))
    lists = met.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_at", whole.alias("_item")))).alias("_all"))  # the elements of one row
    # an empty or null list has nothing to explode
    kind = lists.select(F.col("_all._item").alias("x")).schema["x"].dataType
    empty = F.when(F.col(items).isNotNull(), F.array().cast(kind))
    return df.join(lists, key, "left").withColumn(items, F.coalesce(F.col("_all._item"), empty)).drop("_all")


def unresolved(df: DataFrame, key: list[str], items: str, field: str, lookup: DataFrame, found: str) -> DataFrame:
    """The rejects of :func:`nested_lookup`: ``key``, ``place`` (from 0) and ``unknown``, an id that nothing has."""
    each = df.select(*key, F.posexplode(items).alias("place", "_item")).select(*key, "place", F.col(f"_item.{field}").alias("unknown")).where("unknown IS NOT NULL")
    return each.join(lookup.select(F.col(found).alias("unknown")).distinct(), "unknown", "left_anti").select(*key, "place", "unknown")


def prefix_owners(names: DataFrame, name: str, owner: str, least: int = 4) -> DataFrame:
    """``prefix`` and ``owner`` of every proper prefix of ``least`` letters or more that one owner alone has."""
    each = names.where(F.length(name) > least).select(F.col(owner).alias("owner"), F.explode(F.transform(F.sequence(F.lit(least), F.length(name) - 1), lambda n: F.substring(F.col(name), F.lit(1), n))).alias("prefix"))
    return each.groupBy("prefix").agg(F.min("owner").alias("owner"), F.max("owner").alias("_other")).where("owner = _other").drop("_other")


def resolved(df: DataFrame, c: str, names: DataFrame, name: str, owner: str, aliases: DataFrame, to: str, least: int = 4) -> DataFrame:
    """Add ``to``: the owner of the name in ``c``, else of what ``aliases`` (alias, name) calls it, else of the only name that it begins.

    A name that several owners share, and a prefix of names of several owners, give null; so does a missing name.
    """
    def single(df: DataFrame, key: str, value: str) -> DataFrame:
        both = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(value).alias("_v"), F.max(value).alias("_w"))
        return both.select("_k", F.when(F.col("_v") == F.col("_w"), F.col("_v")).alias("_v"), F.lit(True).alias("_hit"))

    exact = single(names, name, owner)
    called = aliases.select(F.col("alias"), F.col("name").alias("_n")).join(exact.select(F.col("_k").alias("_n"), F.col("_v").alias("_o")), "_n", "left")
    steps = [exact, single(called, "alias", "_o"), prefix_owners(names, name, owner, least).select(F.col("prefix").alias("_k"), F.col("owner").alias("_v"), F.lit(True).alias("_hit"))]
    out = df
    for i, step in enumerate(steps):
        out = out.join(step.select(F.col("_k").alias(c), F.col("_v").alias(f"_v{i}"), F.col("_hit").alias(f"_h{i}")), c, "left")
    # the first step that knows the name decides, even if it can't tell whose it is
    choice = reduce(lambda rest, i: F.when(F.col(f"_h{i}"), F.col(f"_v{i}")).otherwise(rest), (1, 0), F.col("_v2"))
    return out.withColumn(to, choice).drop(*(f"_{x}{i}" for x in "vh" for i in range(3)))


def same_name(a: Column, b: Column, least: int = 4) -> Column:
    """Equal, or one begins the other and both have ``least`` letters."""
    return (a == b) | ((F.length(a) >= least) & (F.length(b) >= least) & (F.startswith(a, b) | F.startswith(b, a)))


def agreeing(left: DataFrame, right: DataFrame, pair: tuple[str, str], name: str, least: int) -> DataFrame:
    """A row for each two distinct names of ``left`` and ``right`` that agree by :func:`same_name`: ``pair[0]`` and ``name``, the right one.

    Names meet by equi joins on themselves and their prefixes.
    """
    a, b = (df.select(F.col(c).alias("_n")).where("_n IS NOT NULL").distinct() for df, c in zip((left, right), pair, strict=True))

    def begun(df: DataFrame) -> DataFrame:
        lengths = F.sequence(F.lit(least), F.length("_n") - 1)
        return df.where(F.length("_n") > least).select(F.col("_n").alias("_whole"), F.explode(F.transform(lengths, lambda n: F.substring(F.col("_n"), F.lit(1), n))).alias("_n"))

    mine, theirs = F.col("_n").alias(pair[0]), F.col("_n").alias(name)
    whole = F.col("_whole")
    same = a.join(b, "_n").select(mine, theirs)
    return same.union(begun(a).join(b, "_n").select(whole.alias(pair[0]), theirs)).union(a.join(begun(b), "_n").select(mine, whole.alias(name)))


def near_in_time_and_name(left: DataFrame, right: DataFrame, at: tuple[str, str], names: list[tuple[str, str]], within: float, least: int = 4) -> DataFrame:
    """Pairs of rows less than ``within`` apart in time whose names agree by :func:`same_name`.

    ``at`` and ``names`` give (left, right) columns; the sides' columns are named apart.
    The names that agree are told from the distinct ones, and times are within a bucket of
    width ``within`` or the next one, so pairs meet by an equi join on whole names and
    time, however much names have in common.
    """
    mine, theirs = at
    keys = [f"_n{i}" for i in range(len(names))]
    a = left.withColumn("_b", F.floor(F.col(mine) / within))
    for k, pair in zip(keys, names, strict=True):
        a = a.join(agreeing(left, right, pair, k, least), pair[0])
    b = right.withColumns({k: F.col(y) for k, (_, y) in zip(keys, names, strict=True)})
    bucket = F.floor(F.col(theirs) / within)
    b = b.where(F.col(theirs).isNotNull()).withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    return a.join(b, ["_b", *keys]).where(F.abs(F.col(mine) - F.col(theirs)) < within).drop("_b", *keys)


def kernel_pairs(left: DataFrame, right: DataFrame, by: list[str], key: list[str], axes: list[tuple[str, str, str | float]], widest: list[float], least: float = 0.03) -> DataFrame:
    """Pairs within a tolerance on each axis, weighted by a product of triangles and normed within each left row.

    ``axes`` are (left column, right column, tolerance: a number or a right column); no
    tolerance is above ``widest``, which is the size of the grid's cells.  Pairs below
    the share ``least`` are dropped and the rest normed again (column ``weight``).  ``key`` names a
    left row; apart from ``by`` the sides' columns are named apart.
    """
    cells = [f"_c{i}" for i in range(len(axes))]
    a = left.withColumns({c: F.floor(F.col(x) / w) for c, (x, _, _), w in zip(cells, axes, widest, strict=True)})
    b = right
    for c, (_, y, _), w in zip(cells, axes, widest, strict=True):
        cell = F.floor(F.col(y) / w)
        b = b.withColumn(c, F.explode(F.array(cell - 1, cell, cell + 1)))
    met, weight = a.join(b, [*by, *cells]), F.lit(1.0)
    for x, y, tolerance in axes:
        reach = F.col(tolerance) if isinstance(tolerance, str) else F.lit(float(tolerance))
        gap = F.abs(F.col(x) - F.col(y))
        met = met.where(gap <= reach)
        weight = weight * (1 - F.try_divide(gap, reach))
    met = met.drop(*cells).withColumn("_w", weight).where("_w > 0")
    for floor in (least, 0.0):
        total = met.groupBy(*key).agg(F.sum("_w").alias("_total"))
        met = met.join(total, key).withColumn("_w", F.col("_w") / F.col("_total")).drop("_total").where(F.col("_w") >= floor)
    return met.withColumnRenamed("_w", "weight")
