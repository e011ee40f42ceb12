"""Totals, records and points of players, clubs and officials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the game's scoring rules, by position where they differ.
GOAL = {"GKP": 10, "DEF": 6, "MID": 5, "FWD": 4}
CLEAN_SHEET = {"GKP": 4, "DEF": 4, "MID": 1, "FWD": 0}
DEFENSIVE_ACTIONS = {"DEF": 10, "MID": 12, "FWD": 12}
ASSIST, PENALTY_SAVED, PENALTY_MISSED, OWN_GOAL, YELLOW, RED, DEFENSIVE = 3, 5, -2, -2, -1, -3, 2
FULL_MINUTES, SAVES_A_POINT, CONCEDED_A_POINT = 60, 3, 2
# Fixed values of the projection: what availability is worth, and a step of fixture difficulty away from 3.
AVAILABILITY = {"available": 1.0, "doubtful": 0.5, "not_in_squad": 0.1, "injured": 0.0, "suspended": 0.0, "unavailable": 0.0}
DIFFICULTY_STEP = 0.12


def projection(form: Column, seen: Column, season: Column, difficulty: Column, availability: Column, started: Column) -> dict[str, Column]:
    """Points a game expected of a player: ``base``, both multipliers, ``points`` and ``reasons``.

    ``form`` counts where ``seen`` matches of the window are there, else the ``season``'s
    points a game.  Easier fixtures than 3 lift and harder ones cut, between 0.6 and
    1.4 times (no fixture: once); ``started`` is the share of matches started, which
    counts for 0.6 to 1 once there are any.  An unknown availability is missing.
    """
    def held(c: Column, low: float, high: float) -> Column:
        return F.least(F.greatest(c, F.lit(low)), F.lit(high))

    played = F.coalesce(seen, F.lit(0)) > 0
    base = F.when(played, form).otherwise(season)
    fixture = F.when(difficulty.isNull(), 1.0).otherwise(held(1 + (3 - difficulty) * DIFFICULTY_STEP, 0.6, 1.4))
    weight = F.lit(None).cast("double")
    for name, w in AVAILABILITY.items():
        weight = F.when(availability == name, w).otherwise(weight)
    minutes = weight * F.when(played, held(0.6 + 0.4 * started, 0.6, 1.0)).otherwise(1.0)
    reasons = F.array_compact(F.array(
        F.when(played, F.format_string("%.1f points per game over the last %d gameweeks", base, seen.cast("int"))).otherwise(F.format_string("%.1f points per game, from last season", base)),
        F.when(difficulty.isNotNull(), F.format_string("fixture difficulty averages %.1f", difficulty)), F.when(weight < 1, F.concat(F.lit("listed as "), F.translate(availability, "_", " "))),
        F.when(played & (started < 1), F.format_string("started %d percent of those gameweeks", F.round(started * 100).cast("int"))),
    ))
    return {"base": base, "fixture_multiplier": fixture, "minutes_multiplier": minutes, "points": base * fixture * minutes, "reasons": reasons}


def _of(position: Column, values: dict[str, int], otherwise: int | None) -> Column:
    out = F.lit(otherwise)
    for name, value in values.items():
        out = F.when(position == name, value).otherwise(out)
    return out


def points(position: Column, stats: dict[str, Column]) -> dict[str, Column]:
    """The twelve parts of a match's points and their ``total``.

    ``stats`` has minutes, goals, assists, clean_sheet, conceded, saves, penalties_saved,
    penalties_missed, yellows, reds, own_goals, defensive and bonus.  A sheet counts as
    clean from 60 minutes on, a sending off absorbs the bookings of its match, and the
    award for defensive actions is given once, to those who played.
    """
    minutes, full = stats["minutes"], stats["minutes"] >= FULL_MINUTES
    back = position.isin("GKP", "DEF")
    threshold = _of(position, DEFENSIVE_ACTIONS, None)
    parts = {
        "appearance": F.when(minutes <= 0, 0).otherwise(F.when(full, 2).otherwise(1)),
        "goals": stats["goals"] * _of(position, GOAL, 0),
        "assists": stats["assists"] * ASSIST,
        "clean_sheet": F.when(stats["clean_sheet"] & full, _of(position, CLEAN_SHEET, 0)).otherwise(0),
        "saves": F.when(position == "GKP", F.floor(stats["saves"] / SAVES_A_POINT)).otherwise(0),
        "conceded": F.when(back, -F.floor(stats["conceded"] / CONCEDED_A_POINT)).otherwise(0),
        "penalties_saved": stats["penalties_saved"] * PENALTY_SAVED,
        "penalties_missed": stats["penalties_missed"] * PENALTY_MISSED,
        "cards": F.when(stats["reds"] > 0, RED).otherwise(stats["yellows"] * YELLOW),
        "own_goals": stats["own_goals"] * OWN_GOAL,
        "defensive": F.when((minutes > 0) & (F.coalesce(stats["defensive"], F.lit(0)) >= threshold), DEFENSIVE).otherwise(0),
        "bonus": stats["bonus"],
    }
    total = F.lit(0).cast("long")
    for part in parts.values():
        total = total + part
    return parts | {"total": total}


def totals(df: DataFrame, by: list[str], sums: list[str], contest: str, most: int = 100) -> DataFrame:
    """Sums in which a missing value counts as 0, the number of different contests and the first ``most`` of their names."""
    named = df.groupBy(*by, contest).agg(*(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in sums))
    return named.groupBy(*by).agg(
        *(F.sum(c).alias(c) for c in sums), F.count(contest).alias("contests"), F.slice(F.sort_array(F.collect_set(contest)), 1, most).alias("names")
    )


def value(points: Column, form: Column, price: Column, start: Column) -> dict[str, Column]:
    """Points and form per million of a price in tenths, and its change; nothing per million of a price that is not positive."""
    millions = price / 10
    return {
        "points_per_million": F.when(millions > 0, F.try_divide(points, millions)).otherwise(0.0),
        "form_per_million": F.when(millions > 0, F.try_divide(form, millions)).otherwise(0.0),
        "price_change": price - start,
    }


def officiated(matches: DataFrame, cards: DataFrame, referee: str, match: str, sides: tuple[str, str], club: str, most: int = 12) -> DataFrame:
    """For each referee the clubs met most often: ``matches``, how many of them have cards on record and ``cards``.

    ``cards`` has a row for each match on record and club with the number shown to it
    (0 too).  Of clubs met equally often the smaller ones come first; ``most`` is the length of the list.
    """
    met = matches.select(referee, match, F.explode(F.array(*sides)).alias(club))
    shown = cards.groupBy(match, club).agg(F.sum("cards").alias("_cards"))
    known = cards.select(match).distinct().withColumn("_known", F.lit(1))
    counts = met.join(known, match, "left").join(shown, [match, club], "left").groupBy(referee, club).agg(
        F.count(F.lit(1)).alias("matches"), F.count("_known").alias("measured"), F.sum(F.coalesce("_cards", F.lit(0))).alias("cards")
    )
    # a referee's clubs are few; the best are kept by a partial aggregate
    row = F.struct((-F.col("matches")).alias("_n"), F.col(club).alias("_c"), "matches", "measured", "cards")
    best = counts.groupBy(referee).agg(F.slice(F.sort_array(F.collect_list(row)), 1, most).alias("_all"))
    each = best.select(referee, F.explode("_all").alias("e"))
    return each.select(referee, F.col("e._c").alias(club), "e.matches", "e.measured", "e.cards")


def record(seasons: DataFrame, wanted: DataFrame, key: str, sums: list[str], wins: str, played: str) -> DataFrame:
    """Sums over the seasons of the wanted managers, and the share of matches won."""
    own = seasons.join(wanted.select(key).distinct(), key, "left_semi")
    return own.groupBy(key).agg(*(F.sum(c).alias(c) for c in sums)).withColumn("win_rate", F.try_divide(F.col(wins).cast("double"), F.col(played)))


def information_ratio(df: DataFrame, c: str, by: list[str], benchmark: str | None = None) -> DataFrame:
    """Mean over sample deviation of a value less its benchmark (a missing one is 0); missing if it is constant."""
    base = F.coalesce(F.col(benchmark), F.lit(0.0)) if benchmark else F.lit(0.0)
    excess = df.where(F.col(c).isNotNull()).withColumn("_e", F.col(c) - base)
    sd = F.stddev_samp("_e")
    return excess.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(sd > 0, F.avg("_e") / sd).alias("ratio"))


def latest_shape(starts: DataFrame, player: str, club: str, at: str, shape: str, role: str, last: int = 12) -> DataFrame:
    """For each player the shape of the newest start that has one, else the club's newest, and the commonest role of the last ``last`` starts.

    Of roles equally common the one seen last counts; rows of one player and time are ordered by shape.
    """
    newest = F.struct(at, shape)
    known = F.when(F.col(shape).isNotNull(), newest)
    own = starts.groupBy(player).agg(F.max(known)[shape].alias("_own"), F.max(F.struct(F.col(at), F.col(club)))[club].alias(club))
    clubs = starts.groupBy(club).agg(F.max(known)[shape].alias("_club"))
    recent = starts.groupBy(player).agg(F.slice(F.sort_array(F.collect_list(F.struct(F.col(at).alias("t"), F.col(role).alias("r"))), asc=False), 1, last).alias("_last"))
    each = recent.select(player, F.explode("_last").alias("e")).where("e.r IS NOT NULL")
    counts = each.groupBy(player, F.col("e.r").alias("r")).agg(F.count(F.lit(1)).alias("n"), F.max("e.t").alias("t"))
    roles = counts.groupBy(player).agg(F.max(F.struct("n", "t", "r"))["r"].alias("role"))
    found = own.join(clubs, club, "left").join(roles, player, "left")
    return found.select(player, F.coalesce("_own", "_club").alias("shape"), F.col("_own").isNotNull().alias("own"), "role")


def in_charge(staff: DataFrame, spells: DataFrame, club: str, folded: Column, name: str, at: Column) -> DataFrame:
    """For each club the staff row named by the spell that covers ``at``, else its first row.

    ``staff`` has ``club``, a name and a ``place`` in the feed; ``spells`` ``club``, the
    folded name ``name``, ``start`` and ``end`` (null: open).  Of several open spells the latest counts.
    """
    now = spells.where((F.col("start") <= at) & (F.col("end").isNull() | (F.col("end") > at)))
    current = now.groupBy(club).agg(F.max(F.struct("start", name))[name].alias("_name"))
    met = staff.withColumn("_folded", folded).join(current, club, "left")
    named = F.coalesce(F.col("_folded") == F.col("_name"), F.lit(False))
    best = met.groupBy(club).agg(F.min(F.struct((~named).alias("_other"), F.struct("place", *(c for c in staff.columns if c not in (club, "place"))).alias("row"))).alias("_best"))
    return best.select(club, "_best.row.*", (~F.col("_best._other")).alias("by_spell"))
