"""What a fitted model does: importance, dependence, attributions and interactions.

A model is a function from a DataFrame with the features to the same with a column
``prediction``.  Each question is one pass of the model over rows that Spark makes:
grids and attributions take a bounded sample, chosen by hashes of the key, so the
answer does not depend on how the rows are dealt; importance takes all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running

Model = Callable[[DataFrame], DataFrame]


def _hash(key: list[str], *also: Column) -> Column:
    return F.xxhash64(*also, *(F.col(c) for c in key))


def _at_hash_place(df: DataFrame, key: list[str], name: str, *also: Column) -> DataFrame:
    """Add a row's place (from 0) in the order of a hash of its key, by sums over ranges of the hash.

    Hashes are spread evenly, so their first bits are the ranges and no pass looks for them.
    """
    rows = df.withColumns({"_h": _hash(key, *also), "_one": F.lit(1)})
    bits = (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length()
    return running(rows, "_h", {name: "_one"}, tie=key, part=F.shiftright("_h", 64 - bits)).drop("_h", "_one")


def _sample(df: DataFrame, key: list[str], features: list[str], n: int | None, seed: int) -> DataFrame:
    """Key and features of the ``n`` rows with the least hashes (None: of all)."""
    rows = df.select(*key, *features)
    return rows if n is None else rows.orderBy(_hash(key, F.lit(seed)), *key).limit(n)


def permutation_importance(model: Model, df: DataFrame, features: list[str], target: str, key: list[str], repeats: int = 5, seed: int = 1) -> DataFrame:
    """``feature``, ``importance`` and its ``sd``: how much the root of the mean squared error rises if a column is shuffled.

    A repeat gives every row the row that has its place in another order as a donor, so
    a shuffled column holds each value as often as before; all columns and repeats are scored in one pass.
    """
    rows = df.where(F.col(target).isNotNull()).select(*key, *features, F.col(target).cast("double").alias("_target")).persist()  # each order reads them
    placed = _at_hash_place(rows, key, "_at", F.lit(seed))
    donors = None
    for repeat in range(1, repeats + 1):
        one = _at_hash_place(rows, key, "_at", F.lit(seed), F.lit(repeat)).select("_at", F.lit(repeat).alias("repeat"), F.struct(*features).alias("_donor"))
        donors = one if donors is None else donors.union(one)
    paired = placed.join(donors, "_at").withColumn("feature", F.explode(F.array(*map(F.lit, features))))
    shuffled = paired.withColumns({f: F.when(F.col("feature") == f, F.col(f"_donor.{f}")).otherwise(F.col(f)) for f in features})
    whole = rows.withColumns({"repeat": F.lit(0), "feature": F.lit("")})
    names = ["feature", "repeat", "_target", *features]
    error = F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("_target"), F.lit(2))))
    errors = model(shuffled.select(*names).union(whole.select(*names))).groupBy("feature", "repeat").agg(error.alias("rmse"))
    base = errors.where("repeat = 0").select(F.col("rmse").alias("_base"))  # one row
    rises = errors.where("repeat > 0").crossJoin(F.broadcast(base)).withColumn("rise", F.col("rmse") - F.col("_base"))
    return rises.groupBy("feature").agg(F.avg("rise").alias("importance"), F.stddev_samp("rise").alias("sd"))


def _grid(df: DataFrame, feature: str, points: int) -> list[float]:
    low, high = df.agg(F.min(F.col(feature).cast("double")), F.max(F.col(feature).cast("double"))).first()
    return [] if low is None or not high > low else [low + (high - low) * step / (points - 1) for step in range(points)]


def expectations(model: Model, df: DataFrame, feature: str, features: list[str], key: list[str], points: int = 20, sample: int | None = 2000, seed: int = 1) -> DataFrame:
    """``key``, ``value`` and ``prediction``: each sampled row's prediction as ``feature`` goes over an even grid of its range.

    A feature without two different values has no rows.
    """
    grid = _grid(df, feature, max(4, min(40, points)))
    rows = _sample(df, key, features, sample, seed)
    spread = rows.withColumn(feature, F.explode(F.array(*map(F.lit, grid)).cast("array<double>")))
    return model(spread).select(*key, F.col(feature).alias("value"), "prediction")


def partial_dependence(model: Model, df: DataFrame, feature: str, features: list[str], key: list[str], points: int = 20, sample: int | None = 2000, seed: int = 1) -> DataFrame:
    """``value``, the mean ``prediction`` of the sampled rows there, and its ``sd`` over them."""
    each = expectations(model, df, feature, features, key, points, sample, seed)
    return each.groupBy("value").agg(F.avg("prediction").alias("prediction"), F.stddev_samp("prediction").alias("sd"))


def shapley(model: Model, rows: DataFrame, background: DataFrame, features: list[str], key: list[str], samples: int = 60, size: int = 100, seed: int = 1) -> DataFrame:
    """``key``, ``feature`` and ``contribution``: sampled Shapley values of the rows, with ``prediction`` and ``baseline``.

    Each draw starts from one of ``size`` background rows and takes over the row's
    features in a random order; a contribution is the mean step that a feature makes.
    """
    floor = _sample(background, key, features, size, seed).select(F.struct(*features).alias("_b"))
    held = floor.agg(F.collect_list("_b").alias("_all"))  # at most ``size`` rows
    drawn = rows.select(*key, F.struct(*features).alias("_r")).crossJoin(F.broadcast(held)).where(F.size("_all") > 0)
    drawn = drawn.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    pick = F.pmod(_hash(key, F.lit(seed), F.lit("from"), F.col("draw")), F.size("_all").cast("long"))
    order = F.sort_array(F.array(*(F.struct(_hash(key, F.lit(seed), F.lit(f), F.col("draw")).alias("h"), F.lit(f).alias("f")) for f in features)))
    drawn = drawn.select(*key, "draw", "_r", F.get("_all", pick.cast("int")).alias("_b"), F.transform(order, lambda x: x["f"]).alias("_order"))
    steps = drawn.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    taken = F.slice("_order", F.lit(1), F.col("step"))
    mixed = {f: F.when(F.array_contains(taken, F.lit(f)), F.col(f"_r.{f}")).otherwise(F.col(f"_b.{f}")) for f in features}
    scored = model(steps.select(*key, "draw", "step", F.get("_order", F.col("step") - 1).alias("feature"), *(v.alias(f) for f, v in mixed.items())))
    walk = Window.partitionBy(*key, "draw").orderBy("step")
    moved = scored.withColumn("_move", F.col("prediction") - F.lag("prediction").over(walk))
    found = moved.where("step > 0").groupBy(*key, "feature").agg(F.avg("_move").alias("contribution"))
    base = model(floor.select("_b.*")).agg(F.avg("prediction").alias("baseline"))  # one row
    return found.join(model(rows.select(*key, *features)).select(*key, "prediction"), key).crossJoin(F.broadcast(base))


def interaction(model: Model, df: DataFrame, first: str, second: str, features: list[str], key: list[str], points: int = 6, sample: int | None = 500, seed: int = 1) -> DataFrame:
    """``strength``: how far the joint effect of two features is from the sum of theirs, over the spread of the predictions.

    Missing where a feature or all predictions are constant.
    """
    points = max(3, min(12, points))
    a, b = (_grid(df, f, points) for f in (first, second))
    rows = _sample(df, key, features, sample, seed).withColumns({"_i": F.lit(-1), "_j": F.lit(-1)})
    spots = [(i, j) for i in range(-1, len(a)) for j in range(-1, len(b))]  # -1 leaves a feature as it is
    spot = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in spots)))

    def at(grid: list[float], place: str, f: str) -> Column:
        value = F.get(F.array(*map(F.lit, grid)).cast("array<double>"), F.greatest(F.col(place), F.lit(0)))
        return F.when(F.col(place) < 0, F.col(f).cast("double")).otherwise(value)

    spread = rows.withColumn("_s", spot).withColumns({"_i": F.col("_s.i"), "_j": F.col("_s.j")}).drop("_s")
    means = model(spread.withColumns({first: at(a, "_i", first), second: at(b, "_j", second)})).groupBy("_i", "_j").agg(F.avg("prediction").alias("p"), F.stddev_samp("prediction").alias("sd"))
    own = means.where("_i < 0 AND _j < 0").select(F.col("p").alias("all"), "sd")  # one row
    of_a, of_b = means.where("_i >= 0 AND _j < 0").select("_i", F.col("p").alias("pa")), means.where("_i < 0 AND _j >= 0").select("_j", F.col("p").alias("pb"))
    both = means.where("_i >= 0 AND _j >= 0").drop("sd").join(of_a, "_i").join(of_b, "_j").crossJoin(F.broadcast(own))
    apart = F.col("p") - (F.col("pa") + F.col("pb") - F.col("all"))
    return both.agg(F.try_divide(F.sqrt(F.avg(apart * apart)), F.max("sd")).alias("strength"))
