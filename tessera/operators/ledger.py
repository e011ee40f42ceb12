"""Rules replayed over periods, legality of selections, and change points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import greatest_upto, previous, running


def replay(panel: DataFrame, entity: str, period: str, score: str, actual: str, size: int, transfer_cost: float, free: int = 1) -> DataFrame:
    """A rule that holds the ``size`` best by ``score`` in each period, one row a period.

    The best of them counts twice; changes beyond ``free`` cost ``transfer_cost`` each
    (none in the first period).  ``net`` is the running total's gain and ``drawdown``
    its distance from the highest total so far.
    """
    order = Window.partitionBy(period).orderBy(F.desc_nulls_last(score), entity)
    held = panel.where(F.col(score).isNotNull()).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= size)
    points = F.coalesce(F.col(actual).cast("double"), F.lit(0.0))
    sums = held.groupBy(period).agg(F.sum(points).alias("points"), F.max(F.when(F.col("_place") == 1, points)).alias("captain"), F.count(F.lit(1)).alias("held"))
    sums = previous(sums, period, "_before")
    stayed = held.select(entity, period).join(sums.select(period, "_before"), period)
    stayed = stayed.join(held.select(entity, F.col(period).alias("_before")), [entity, "_before"]).groupBy(period).agg(F.count(F.lit(1)).alias("stayed"))
    led = sums.join(stayed, period, "left").fillna(0, ["stayed"])
    changes = F.when(F.col("_before").isNull(), 0).otherwise(F.col("held") - F.col("stayed"))
    led = led.withColumn("changes", changes).withColumn("cost", F.greatest(F.col("changes") - free, F.lit(0)) * transfer_cost)
    led = led.withColumn("net", F.col("points") + F.col("captain") - F.col("cost"))
    led = running(led, period, {"_sofar": "net"}).withColumn("total", F.col("_sofar") + F.col("net"))
    led = greatest_upto(led, period, "total", "_top").withColumn("drawdown", F.col("total") - F.col("_top"))
    return led.select(period, "points", "captain", "changes", "cost", "net", "total", "drawdown")


def violations(members: DataFrame, squad: str, quotas: dict[str, int], position: str, club: str, per_club: int, price: str, budget: float) -> DataFrame:
    """``issue`` and ``detail`` of every rule that a squad breaks; legal squads have no row."""
    size = sum(quotas.values())
    whole = members.groupBy(squad).agg(F.count(F.lit(1)).alias("n"), F.sum(price).alias("cost"), *(F.count_if(F.col(position) == p).alias(f"_q{i}") for i, p in enumerate(quotas)))
    each = [F.when(F.col("n") != size, F.struct(F.lit("size").alias("issue"), F.col("n").cast("string").alias("detail")))]
    each.append(F.when(F.col("cost") > budget, F.struct(F.lit("budget").alias("issue"), F.format_string("%.2f", "cost").alias("detail"))))
    each += [F.when(F.col(f"_q{i}") != q, F.struct(F.lit("quota").alias("issue"), F.lit(str(p)).alias("detail"))) for i, (p, q) in enumerate(quotas.items())]
    broken = whole.select(squad, F.explode(F.array_compact(F.array(*each))).alias("e")).select(squad, "e.*")
    crowded = members.groupBy(squad, club).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_club)
    return broken.union(crowded.select(squad, F.lit("club").alias("issue"), F.col(club).cast("string").alias("detail")))


def change_points(df: DataFrame, by: str, order: str, value: str, most: int = 3, least: int = 4) -> DataFrame:
    """Binary segmentation of each series on squared error: ``place``, ``order`` value and gain of each cut.

    A series is one group's rows; its length is that of its history.
    """

    def best(v: np.ndarray) -> tuple[float, int]:
        n = np.arange(1, len(v))
        s, q = np.cumsum(v), np.cumsum(v * v)
        left = q[:-1] - s[:-1] ** 2 / n
        right = (q[-1] - q[:-1]) - (s[-1] - s[:-1]) ** 2 / (len(v) - n)
        gain = (q[-1] - s[-1] ** 2 / len(v)) - left - right
        gain[: least - 1] = gain[len(v) - least :] = -1
        at = int(gain.argmax())
        return float(gain[at]), at + 1

    def cut(frames: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        series = frames.dropna(subset=[value]).sort_values(order)
        v, parts, out = series[value].to_numpy(float), [(0, len(series))], []
        for _ in range(most):
            found = [(*best(v[a:b]), a, b) for a, b in parts if b - a >= 2 * least]
            found = [f for f in found if f[0] > 1e-12]
            if not found:
                break
            gain, at, a, b = max(found)
            parts.remove((a, b))
            parts += [(a, a + at), (a + at, b)]
            out.append((frames[by].iloc[0], a + at, series[order].iloc[a + at], gain))
        return pd.DataFrame(out, columns=[by, "place", order, "gain"])

    kinds = dict(df.dtypes)
    return df.select(by, order, value).groupBy(by).applyInPandas(cut, f"{by} {kinds[by]}, place long, {order} {kinds[order]}, gain double")
