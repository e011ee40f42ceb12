"""Point-in-time features: what was known of a row, its club and its opponent before it.

Each side is one exchange: rows by who they are of, fixtures by club.  Frames end at
the row before, and what is read of the row itself is named by the caller as known
beforehand, so a feature cannot change with a later row.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rate:
    """``scale`` times the sum of ``value`` over that of ``per``, in the last ``rows`` rows."""

    name: str
    value: str
    per: str
    rows: int
    scale: float = 1.0


@dataclass(frozen=True)
class Recipe:
    """Which features :func:`build` makes, by the names of columns."""

    who: str
    at: str
    measures: tuple[str, ...]
    windows: tuple[int, ...] = (3, 6, 12)
    rates: tuple[Rate, ...] = ()
    shares: dict[str, tuple[str, int]] = field(default_factory=dict)
    steps: tuple[str, ...] = ()
    known: tuple[str, ...] = ()
    position: str | None = None
    positions: tuple[str, ...] = ()
    position_rows: int = 12
    least: int = 3


def _last(over: WindowSpec, n: int) -> WindowSpec:
    return over.rowsBetween(-n, -1)


def own_features(recipe: Recipe) -> dict[str, Column]:
    """Of the rows before, by who they are of.

    Means skip missing values.  A rate is missing where no value is present or the
    denominator is not positive.  A share is that of rows whose flag holds.  A step is
    the change of a known column since the row before.  ``position_changed`` compares
    with ``position_rows`` rows back, or with the first row.
    """
    over = Window.partitionBy(recipe.who).orderBy(recipe.at)
    out = {f"{m}_mean_{n}": F.avg(m).over(_last(over, n)) for m in recipe.measures for n in recipe.windows}
    for rate in recipe.rates:
        total, per = F.sum(rate.value).over(_last(over, rate.rows)), F.sum(rate.per).over(_last(over, rate.rows))
        out[rate.name] = F.when(per > 0, rate.scale * F.try_divide(total, per))
    for name, (flag, n) in recipe.shares.items():
        out[name] = F.avg(F.coalesce(F.col(flag).cast("double"), F.lit(0.0))).over(_last(over, n))
    out |= {f"{c}_change": F.col(c) - F.lag(c).over(over) for c in recipe.steps}
    if recipe.position:
        now, n = F.col(recipe.position), recipe.position_rows
        first = F.first(recipe.position).over(_last(over, n))
        out["position_changed"] = F.when(now.isNotNull() & first.isNotNull(), (now != first).cast("int"))
        out |= {f"is_{p}": F.coalesce(now == p, F.lit(False)).cast("int") for p in recipe.positions}
    out["appearances"] = F.row_number().over(over) - 1
    return out


def stability(shape: str, over: WindowSpec, n: int = 6) -> Column:
    """The share of the last ``n`` known shapes that equal the newest of them; missing below two."""
    seen = F.filter(F.collect_list(F.col(shape)).over(_last(over, n)), lambda s: s.isNotNull())  # n at most
    return F.when(F.size(seen) >= 2, F.size(F.filter(seen, lambda s: s == F.element_at(seen, -1))) / F.size(seen))


def club_features(fixtures: DataFrame, club: str, at: str, measures: Iterable[str], last: int = 6, days: float = 14.0, shape: str | None = None, manager: str | None = None) -> DataFrame:
    """One row a club and time: means of the last fixtures, rest, fixtures within ``days``, stability and the manager's record.

    ``fixtures`` has a row for each club and time at which it plays (``at`` is a number,
    measures may be missing for what is not played yet).  A manager's record is that of
    the fixtures since the manager last changed; the manager of a fixture is known before it.
    """
    measures = tuple(measures)
    over = Window.partitionBy(club).orderBy(at)
    out = {f"{m}_{last}": F.avg(m).over(_last(over, last)) for m in measures}
    out["rest"] = F.col(at) - F.lag(at).over(over)
    # the row itself is among the rows at its own time
    within = F.count(F.lit(1)).over(Window.partitionBy(club).orderBy(F.col(at).cast("double")).rangeBetween(-days, 0))
    out["recent"] = within - 1
    if shape:
        out["stability"] = stability(shape, over, last)
    if not manager:
        return fixtures.select(club, at, *(v.alias(k) for k, v in out.items()))
    changed = F.coalesce((~F.col(manager).eqNullSafe(F.lag(manager).over(over))).cast("int"), F.lit(1))
    rows = fixtures.select(club, at, manager, *measures, *(v.alias(k) for k, v in out.items()), changed.alias("_changed"))
    rows = rows.withColumn("_spell", F.sum("_changed").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    spell = Window.partitionBy(club, "_spell").orderBy(at)
    before = spell.rowsBetween(Window.unboundedPreceding, -1)
    known = F.col(manager).isNotNull()
    rows = rows.withColumns({
        "manager_time": F.when(known, F.col(at) - F.first(at).over(spell.rowsBetween(Window.unboundedPreceding, 0))), "manager_matches": F.when(known, F.count(F.lit(1)).over(before)),
        **{f"manager_{m}": F.when(known, F.avg(m).over(before)) for m in measures},
    })
    return rows.drop(manager, *measures, "_changed", "_spell")


def build(rows: DataFrame, recipe: Recipe, sides: dict[str, str] | None = None, clubs: DataFrame | None = None, club: str = "club", gaps: dict[str, str] | None = None) -> DataFrame:
    """The rows with enough history and all features of ``recipe``, those of ``clubs`` for each side among them.

    ``sides`` maps a prefix to the column of ``rows`` that names the club of that side;
    its features get the prefix.  ``gaps`` maps a name to a club feature: the first
    side's less the second's.  Rows of one who and time must not repeat.
    """
    out = rows.withColumns(own_features(recipe)).where(F.col("appearances") >= recipe.least)
    keep = [recipe.who, recipe.at, *(sides or {}).values(), *recipe.known, *own_features(recipe)]
    out = out.select(*dict.fromkeys(keep))
    for prefix, column in (sides or {}).items():
        named = clubs.select(F.col(club).alias(column), recipe.at, *(F.col(c).alias(f"{prefix}_{c}") for c in clubs.columns if c not in (club, recipe.at)))
        out = out.join(named, [column, recipe.at], "left")
    first, second = [*(sides or {}), None, None][:2]
    return out.withColumns({name: F.col(f"{first}_{c}") - F.col(f"{second}_{c}") for name, c in (gaps or {}).items()})
