"""Splits in time, cross-validation, learning curves, shuffled targets and what is predicted.

A fitter takes training rows and returns a model: a function that adds ``prediction``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .explain import Model, _at_hash_place
from .ordering import running
from .stats import errors

Fitter = Callable[[DataFrame], Model]


@dataclass(frozen=True)
class Split:
    """Periods [first, last] to train on and the one to test on; ``purged`` rows lie between."""

    fold: int
    first: Any
    last: Any
    test: Any
    train_rows: int
    test_rows: int
    purged: int

    def train(self, df: DataFrame, period: str) -> DataFrame:
        return df.where((F.col(period) >= F.lit(self.first)) & (F.col(period) <= F.lit(self.last)))

    def tested(self, df: DataFrame, period: str) -> DataFrame:
        return df.where(F.col(period) == F.lit(self.test))


def splits(df: DataFrame, period: str, folds: int, embargo: int = 1, window: int | None = None, least: int = 1) -> list[Split]:
    """One split for each of the last ``folds`` periods.

    It is trained on the periods before it less ``embargo`` of them, on the last ``window``
    of these alone if that is given, and left out where fewer than ``least`` are there.
    """
    need = folds + embargo + (window or 0)
    counts = df.groupBy(period).agg(F.count(F.lit(1)).alias("n")).where(F.col(period).isNotNull())
    late = counts.orderBy(F.desc(period)).limit(need).collect() if window else counts.collect()  # periods: a row each
    sizes = sorted((r[period], r["n"]) for r in late)
    out = []
    for at in range(max(0, len(sizes) - folds), len(sizes)):
        known = sizes[: max(0, at - embargo)]
        known = known[-window:] if window else known
        if len(known) >= max(1, least):
            purged = sum(n for _, n in sizes[max(0, at - embargo) : at])
            out.append(Split(len(out), known[0][0], known[-1][0], sizes[at][0], sum(n for _, n in known), sizes[at][1], purged))
    return out


def cross_validate(df: DataFrame, target: str, period: str, folds: list[Split], fit: Fitter) -> list[dict]:
    """The errors of a model fitted again for each split: n, rmse, mae, bias and r2."""
    out = []
    for split in folds:
        model = fit(split.train(df, period))
        out.append({"fold": split.fold, "period": split.test, **errors(model(split.tested(df, period)), "prediction", target).first().asDict()})
    return out


def learning_curve(df: DataFrame, target: str, period: str, order: list[str], split: Split, fit: Fitter, shares: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 1.0)) -> list[dict]:
    """``train_rows``, ``train_rmse`` and ``test_rmse`` with the latest share of the training rows alone.

    ``order`` is a total order whose first column is a number; places come from sums over ranges of it.
    """
    placed = running(split.train(df, period).withColumn("_one", F.lit(1)), order[0], {"_place": "_one"}, tie=order[1:]).persist()
    n, test, out = split.train_rows, split.tested(df, period), []
    for share in shares:
        size = max(2, round(n * share))
        rows = placed.where(F.col("_place") >= n - size)
        model = fit(rows)
        of = {k: errors(model(x), "prediction", target).first()["rmse"] for k, x in (("train_rmse", rows), ("test_rmse", test))}
        out.append({"train_rows": size, **of})
    placed.unpersist()
    return out


def permutation_null(df: DataFrame, target: str, period: str, key: list[str], folds: list[Split], fit: Fitter, runs: int = 10, seed: int = 1) -> dict:
    """The mean r2 over the splits against that of models whose targets were shuffled over all rows.

    A run gives each row the target of the row at its place in another order of hashes.
    ``p`` is (runs as good + 1) / (runs + 1).
    """
    def score(rows: DataFrame) -> float | None:
        found = [f["r2"] for f in cross_validate(rows, target, period, folds, fit) if f["r2"] is not None]
        return sum(found) / len(found) if found else None

    df = df.persist()  # each split and run reads it
    observed, draws = score(df), []
    placed = _at_hash_place(df, key, "_at", F.lit(seed)).drop(target).persist()
    for run in range(1, runs + 1):
        other = _at_hash_place(df, key, "_at", F.lit(seed), F.lit(run)).select("_at", target)
        shuffled = placed.join(other, "_at").drop("_at").persist()
        draws.append(score(shuffled))
        shuffled.unpersist()
    placed.unpersist()
    df.unpersist()
    draws = [d for d in draws if d is not None]
    mean = sum(draws) / len(draws) if draws else None
    sd = (sum((d - mean) ** 2 for d in draws) / (len(draws) - 1)) ** 0.5 if len(draws) > 1 else None
    beaten = sum(observed is not None and d >= observed for d in draws)
    return {"observed": observed, "null_mean": mean, "null_sd": sd, "p": (beaten + 1) / (len(draws) + 1), "runs": len(draws)}


#: Minutes of a full appearance, and below which a rate is noise.
FULL, LEAST = 60, 20


def targets(rows: DataFrame, player: str, season: str, week: str, club: str, position: str) -> DataFrame:
    """What the components predict: ``player``, ``season``, ``week``, ``component`` and ``value`` of each row that counts for it.

    Rows have minutes, goals, assists, clean_sheets, conceded, saves, bps, yellows, reds and
    price.  Rates are per ninety minutes from ``LEAST`` minutes on, saves those of keepers.
    ``clean_sheet`` and ``conceded_rate`` are the same for all of a club, so the
    eligible player with the smallest id stands for it.  ``price_rise`` needs the next
    week of the same season.
    """
    minutes, on = F.col("minutes"), F.col("minutes") >= LEAST

    def rate(c: str) -> Column:
        return F.when(on, F.col(c) * 90.0 / F.nullif(minutes, F.lit(0)))

    ahead = Window.partitionBy(player).orderBy(season, week)
    follows = (F.lead(season).over(ahead) == F.col(season)) & (F.lead(week).over(ahead) == F.col(week) + 1)
    later = F.lead("price").over(ahead)
    of_club = {"clean_sheet": F.when(minutes >= FULL, (F.col("clean_sheets") > 0).cast("double")), "conceded_rate": rate("conceded")}
    of_player = {
        "minutes": (minutes >= FULL).cast("double"), "goal_rate": rate("goals"), "assist_rate": rate("assists"), "save_rate": F.when(F.col(position) == "GKP", rate("saves")), "bps_rate": rate("bps"),
        "card_rate": F.when(on, (F.col("yellows") + F.col("reds") > 0).cast("double")),
        "price_rise": F.when(follows & later.isNotNull() & F.col("price").isNotNull(), (later > F.col("price")).cast("double")),
    }
    valued = rows.select(player, season, week, club, *(v.alias(k) for k, v in (of_player | of_club).items()))

    def long(df: DataFrame, names: list[str]) -> DataFrame:
        each = F.array(*(F.struct(F.lit(k).alias("component"), F.col(k).alias("value")) for k in names))
        return df.select(player, season, week, club, F.explode(each).alias("e")).select(player, season, week, club, "e.*").where("value IS NOT NULL")

    one = long(valued, list(of_club)).groupBy(season, week, club, "component").agg(F.min_by(F.struct(player, "value"), player).alias("_first"))
    stands = one.select(F.col(f"_first.{player}").alias(player), season, week, "component", F.col("_first.value").alias("value"))
    return long(valued, list(of_player)).drop(club).union(stands)
