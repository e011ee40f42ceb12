"""Archive seasons, bridges and refreshed tables on small frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import domain as D
from tessera.sources import archive


def test_rows_under_permanent_codes(spark):
    players = spark.createDataFrame([("2020/21", "1", "100"), ("2020/21", "2.0", "200"), ("2021/22", "1", "200"), ("2021/22", "3", "0"), ("2021/22", None, "5")], "season string, id string, code string")
    rows = spark.createDataFrame([("2020/21", "1", "1", 9.0), ("2020/21", "2", "0", 1.0), ("2021/22", "1", "3", 2.0), ("2021/22", "3", "3", 2.0), ("2021/22", "zz", "3", 2.0), ("2021/22", "1", "", 2.0)], "season string, element string, GW string, xg double")
    known = archive.codes(players, "season", "id", "code")
    got = sorted(map(tuple, archive.rekeyed(rows, known, "season", "element", "GW", {"xg": 2021}).collect()))
    assert got == [(100, "2020/21", 1, 1, None), (200, "2021/22", 1, 3, 2.0)]
    assert sorted(map(tuple, archive.rejected(rows, known, "season", "element", "GW").collect())) == [("2020/21", "week", 1), ("2021/22", "element", 2), ("2021/22", "week", 1)]


def test_clubs_of_lists_else_of_players(spark):
    teams = spark.createDataFrame([("a", "1", "3", "Arsenal"), ("a", "2", None, "None")], "season string, team string, code string, name string")
    players = spark.createDataFrame([("a", "9", "9"), ("b", "1", "3"), ("b", "1", "3"), ("b", "2", "x")], "season string, team string, code string")
    assert sorted(map(tuple, archive.bridge(teams, players, "season", "team", "code", "name").collect())) == [("a", 1, 3, "Arsenal"), ("b", 1, 3, "club 3")]


def test_wanted_keys_are_replaced(spark):
    stored, run = (spark.createDataFrame(v, "k int, v string") for v in ([(1, "old"), (2, "old"), (3, "old")], [(2, "new"), (4, "new"), (9, "not asked")]))
    wanted = spark.createDataFrame([(2,), (3,), (4,)], "k int")
    assert sorted(map(tuple, archive.refreshed(stored, run, ["k"], wanted).collect())) == [(1, "old"), (2, "new"), (4, "new")]


def test_new_ids_by_name_and_birth(spark):
    people = spark.createDataFrame([(1, "Á One", "d1"), (2, "Two", None), (3, "Three", "d3"), (4, "Four", "d4"), (5, "Five", "d5"), (6, "Six", "d6")], "id int, name string, born string")
    given = spark.createDataFrame([("aone", 10, "d1"), ("two", 20, "d2"), ("three", 30, "other"), ("four", 40, "d4"), ("four", 41, "d0"), ("five", 50, "d5"), ("six", 60, None)], "n string, p int, b string")
    mapped = spark.createDataFrame([(5,)], "id int")
    names = D.fold_name(F.translate("name", "Á", "A"))
    got = archive.unmapped(people, mapped, "id", names, given, "n", "p", ("born", "b")).collect()
    assert sorted(map(tuple, got)) == [(1, 10, "high"), (2, 20, "low"), (4, 40, "high"), (6, 60, "low")]
