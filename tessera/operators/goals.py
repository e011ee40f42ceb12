"""Goal expectations that a market's probabilities imply."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Goals of a side at most, and the range and steps of the search.
MOST_GOALS, LOW, HIGH, COARSE, FINE = 15, 0.05, 4.5, 0.05, 0.01
_FIT = "home double, away double, error double"


def outcomes(home: np.ndarray, away: np.ndarray) -> np.ndarray:
    """Probabilities of a home win, a draw, an away win and of three goals or more, one row a pair of expectations."""
    k = np.arange(MOST_GOALS + 1)
    factorial = np.concatenate(([0.0], np.cumsum(np.log(k[1:]))))

    def shares(rate: np.ndarray) -> np.ndarray:
        return np.exp(-rate[:, None] + k * np.log(rate[:, None]) - factorial)

    h, a = shares(np.asarray(home, float)), shares(np.asarray(away, float))
    draw, below = (h * a).sum(1), np.cumsum(a, axis=1)
    won = (h[:, 1:] * below[:, :-1]).sum(1)
    lost = (a[:, 1:] * np.cumsum(h, axis=1)[:, :-1]).sum(1)
    few = sum(h[:, i] * a[:, j] for i in range(3) for j in range(3 - i))
    return np.column_stack([won, draw, lost, h.sum(1) * a.sum(1) - few])


@cache
def _grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = LOW + COARSE * np.arange(round((HIGH - LOW) / COARSE) + 1)
    home, away = np.repeat(at, len(at)), np.tile(at, len(at))
    return home, away, outcomes(home, away)


def _error(model: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Squared error of each model row against one target; a missing last entry does not count."""
    width = 3 if np.isnan(target[3]) else 4
    return ((model[:, :width] - target[:width]) ** 2).sum(axis=1)


def _one(target: np.ndarray) -> tuple[float, float, float]:
    home, away, model = _grid()
    error = _error(model, target)
    best = int(error.argmin())
    h, a, e = home[best], away[best], error[best]
    step = FINE * np.arange(-round(COARSE / FINE), round(COARSE / FINE) + 1)
    hs, as_ = (np.unique(np.clip(x + step, LOW, HIGH)) for x in (h, a))
    home, away = np.repeat(hs, len(as_)), np.tile(as_, len(hs))
    error = _error(outcomes(home, away), target)
    best = int(error.argmin())
    return (float(home[best]), float(away[best]), float(error[best])) if error[best] < e else (float(h), float(a), float(e))


def _fit(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for columns in batches:
        targets = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])
        known: dict[bytes, tuple] = {}
        rows = []
        for t in targets:
            name = t.tobytes()
            if name not in known:
                known[name] = (None, None, None) if np.isnan(t[:3]).any() else _one(t)
            rows.append(known[name])
        yield pd.DataFrame(rows, columns=["home", "away", "error"], dtype=float)


def goal_expectations(df: DataFrame, home: Column, draw: Column, away: Column, over: Column | None = None, name: str = "goals") -> DataFrame:
    """Add the struct ``name`` (home, away, error): the expectations whose scorelines fit the probabilities best.

    A coarse grid, then steps of a hundredth around its best cell; ties by the smaller
    home, then away expectation.  ``over`` is the probability of three goals or more, if
    there is one.  Null where an outcome's probability is missing.
    """
    columns = [c.cast("double") for c in (home, draw, away, F.lit(None) if over is None else over)]
    fitted = df.withColumn(name, F.pandas_udf(_fit, _FIT)(*columns))
    return fitted.withColumn(name, F.when(F.col(f"{name}.error").isNotNull(), F.col(name)))


def forecast(df: DataFrame, home: Column, away: Column, likely: int = 5) -> DataFrame:
    """Add what two goal expectations say of a match, by independent Poisson counts of at most ``MOST_GOALS``.

    ``home_win``, ``draw``, ``away_win``, ``over25``, ``home_clean_sheet``,
    ``away_clean_sheet``, ``both_to_score`` and ``scores``, the likeliest scorelines of up
    to six goals a side (home, away, p), of equal ones those with fewer goals first.
    """
    counts = F.sequence(F.lit(0), F.lit(MOST_GOALS))

    def shares(rate: Column) -> Column:
        return F.transform(counts, lambda k: F.pow(rate, k) * F.exp(-rate) / F.factorial(k))

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)

    def beats(mine: str, other: str) -> Column:
        """The chance of more goals than the other side."""
        return total(F.transform(F.col(mine), lambda p, k: p * total(F.slice(other, F.lit(1), k))))

    rows = df.withColumns({"_home": shares(home.cast("double")), "_away": shares(away.cast("double"))})
    few = [F.get("_home", F.lit(h)) * F.get("_away", F.lit(a)) for h in range(3) for a in range(3 - h)]
    scores = F.array(*(F.struct((-F.get("_home", F.lit(h)) * F.get("_away", F.lit(a))).alias("p"), F.lit(h + a).alias("n"), F.lit(h).alias("home"), F.lit(a).alias("away")) for h in range(7) for a in range(7)))
    best = F.transform(F.slice(F.sort_array(scores), 1, likely), lambda x: F.struct(x["home"].alias("home"), x["away"].alias("away"), (-x["p"]).alias("p")))
    none = {"home_clean_sheet": F.get("_away", F.lit(0)), "away_clean_sheet": F.get("_home", F.lit(0))}
    rows = rows.withColumns({
        "home_win": beats("_home", "_away"), "draw": total(F.zip_with("_home", "_away", lambda h, a: h * a)), "away_win": beats("_away", "_home"), **none,
        "over25": total(F.col("_home")) * total(F.col("_away")) - sum(few[1:], few[0]), "both_to_score": (1 - none["home_clean_sheet"]) * (1 - none["away_clean_sheet"]), "scores": best,
    })
    return rows.drop("_home", "_away")


def expected_goals(df: DataFrame, strengths: DataFrame, home: str, away: str, team: str, baseline: Column, advantage: Column) -> DataFrame:
    """Add ``home_goals`` and ``away_goals`` expected of a match from both sides' ``attack`` and ``defence``.

    A side without a record is average; the advantage of playing at home is split
    between both sides, so the total stays as it is.
    """
    out = df
    for side, c in (("_h", home), ("_a", away)):
        out = out.join(strengths.select(F.col(team).alias(c), F.col("attack").alias(f"{side}_attack"), F.col("defence").alias(f"{side}_defence")), c, "left")
    known = {c: F.coalesce(F.col(c), F.lit(1.0)) for c in ("_h_attack", "_h_defence", "_a_attack", "_a_defence")}
    tilt = F.sqrt(advantage)
    out = out.withColumns({"home_goals": baseline * known["_h_attack"] * known["_a_defence"] * tilt, "away_goals": baseline * known["_a_attack"] * known["_h_defence"] / tilt})
    return out.drop(*known)
