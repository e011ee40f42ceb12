"""Seasons of an archive under their permanent codes, with what could not be read counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A whole number in text such as '7' or '7.0'; anything else is missing."""
    return F.try_to_number(F.regexp_extract(F.trim(c), r"^(-?[0-9]{1,15})(?:\.0+)?$", 1), F.lit("S999999999999999")).cast("long")


def codes(players: DataFrame, season: str, element: str, code: str) -> DataFrame:
    """``season``, ``element`` and ``code`` of the rows that have both; of several codes of an element the greatest counts."""
    known = players.select(F.col(season).alias("season"), number(F.col(element).cast("string")).alias("element"), number(F.col(code).cast("string")).alias("code"))
    return known.where("element IS NOT NULL AND code > 0").groupBy("season", "element").agg(F.max("code").alias("code"))


def rekeyed(rows: DataFrame, known: DataFrame, season: str, element: str, week: str, measured: dict[str, int] | None = None) -> DataFrame:
    """The rows under the permanent ``code``, with ``season``, ``element`` and ``week`` as numbers (J6, S19).

    Rows whose element the season does not know, or without a week from 1 on, are left
    out (:func:`rejected` counts them).  ``measured`` names the first year in which a
    column was measured; in earlier seasons it is missing, whatever the file holds.
    """
    out = _keyed(rows, known, season, element, week).where("code IS NOT NULL AND _week >= 1")
    year = F.substring(F.col(season).cast("string"), 1, 4).cast("int")
    values = {c: F.when(year >= first, F.col(c)) for c, first in (measured or {}).items()}
    kept = [c for c in rows.columns if c not in (season, element, week)]
    return out.select("code", season, F.col("_element").alias(element), F.col("_week").alias(week), *(values.get(c, F.col(c)).alias(c) for c in kept))


def _keyed(rows: DataFrame, known: DataFrame, season: str, element: str, week: str) -> DataFrame:
    typed = rows.withColumns({"_element": number(F.col(element).cast("string")), "_week": number(F.col(week).cast("string"))})
    named = known.select(F.col("season").alias(season), F.col("element").alias("_element"), "code")
    return typed.join(named, [season, "_element"], "left")


def rejected(rows: DataFrame, known: DataFrame, season: str, element: str, week: str) -> DataFrame:
    """``season``, ``reason`` (element or week) and ``n`` of the rows that :func:`rekeyed` leaves out."""
    reason = F.when(F.col("code").isNull(), "element").when(F.coalesce(F.col("_week") < 1, F.lit(True)), "week")
    found = _keyed(rows, known, season, element, week).select(season, reason.alias("reason")).where("reason IS NOT NULL")
    return found.groupBy(season, "reason").agg(F.count(F.lit(1)).alias("n"))


def bridge(teams: DataFrame, players: DataFrame, season: str, team: str, code: str, name: str) -> DataFrame:
    """``season``, ``team``, ``code`` and ``name`` of every club (S20): of the team list where a season has one, else of its players.

    A club derived from players is called by its code; of several codes of a team the greatest counts.
    """
    def typed(df: DataFrame, called: Column) -> DataFrame:
        rows = df.select(F.col(season).alias("season"), number(F.col(team).cast("string")).alias("team"), number(F.col(code).cast("string")).alias("code"), called.alias("name"))
        return rows.where("team IS NOT NULL AND code IS NOT NULL AND name IS NOT NULL").groupBy("season", "team").agg(F.max(F.struct("code", "name")).alias("_m")).select("season", "team", "_m.*")

    listed = typed(teams, F.col(name))
    derived = typed(players, F.concat(F.lit("club "), number(F.col(code).cast("string")).cast("string")))
    return listed.union(derived.join(listed.select("season").distinct(), "season", "left_anti"))


def refreshed(stored: DataFrame, run: DataFrame, key: list[str], wanted: DataFrame) -> DataFrame:
    """Stored rows carried on but for the ``wanted`` keys, which the run replaces (S27): a wanted key that the run lacks is gone."""
    keys = wanted.select(*key).distinct()
    return stored.join(keys, key, "left_anti").unionByName(run.join(keys, key, "left_semi"))


def unmapped(candidates: DataFrame, mapped: DataFrame, key: str, names: Column, provider: DataFrame, provider_name: str, provider_id: str, born: tuple[str, str]) -> DataFrame:
    """New provider ids for the candidates not mapped yet (S26): ``key``, ``provider_id`` and ``confidence``.

    A folded name that one provider row alone has is a match: ``high`` if the birth dates
    agree, ``low`` if either is missing; dates that differ are no match.  Of a name that
    several rows have, the only one born on the candidate's date is a ``high`` match.
    """
    mine, theirs = born
    new = candidates.join(mapped.select(key).distinct(), key, "left_anti").select(key, names.alias("_name"), F.col(mine).alias("_born"))
    given = provider.where(F.col(provider_name).isNotNull()).select(F.col(provider_name).alias("_name"), F.col(provider_id).alias("provider_id"), F.col(theirs).alias("_date"))
    single = given.groupBy("_name").agg(F.count_distinct("provider_id").alias("_n"), F.min("provider_id").alias("_only"), F.min("_date").alias("_when"))
    dated = given.where("_date IS NOT NULL").groupBy("_name", F.col("_date").alias("_born")).agg(F.count_distinct("provider_id").alias("_m"), F.min("provider_id").alias("_same"))
    met = new.join(single, "_name").join(dated, ["_name", "_born"], "left")
    confidence = F.when(F.col("_m") == 1, "high").when((F.col("_n") == 1) & (F.col("_born").isNull() | F.col("_when").isNull()), "low")
    return met.select(key, F.when(F.col("_m") == 1, F.col("_same")).otherwise(F.col("_only")).alias("provider_id"), confidence.alias("confidence")).where("confidence IS NOT NULL")
