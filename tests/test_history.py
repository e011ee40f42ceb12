"""Features of a row do not change with later rows, and say what plain loops say."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.operators import history

RECIPE = history.Recipe(
    who="who", at="at", measures=("a", "b"), rates=(history.Rate("rate", "a", "b", 6, 90.0),), shares={"share": ("b", 6)},
    steps=("price",), known=("price",), position="pos", positions=("X", "Y"),
)


def rows_of(dice):
    return [
        (w, t, None if dice.random() < 0.2 else dice.uniform(0, 5), float(dice.randint(0, 1)), dice.choice("XY"), float(dice.randint(40, 60)), f"c{w % 3}", f"c{(w + t) % 3}")
        for w in range(6) for t in range(20)
    ]


def fixtures_of(dice):
    return [(f"c{c}", t, dice.choice([None, 0.0, 1.0, 3.0]), dice.choice(["442", "433"]), dice.choice(["m", "n"]) if t % 5 == 0 else f"k{t // 5}") for c in range(3) for t in range(20)]


def built(spark, rows, fixtures):
    r = spark.createDataFrame(rows, "who long, at long, a double, b double, pos string, price double, club string, opp string").repartition(3)
    f = spark.createDataFrame(fixtures, "club string, at long, points double, shape string, manager string").repartition(2)
    clubs = history.club_features(f, "club", "at", ["points"], days=4, shape="shape", manager="manager")
    return history.build(r, RECIPE, {"team": "club", "opponent": "opp"}, clubs, gaps={"gap": "points_6"})


def as_dict(df):
    return {(r["who"], r["at"]): r.asDict() for r in df.collect()}


def test_later_rows_change_nothing(spark):
    dice = random.Random(1)
    rows, fixtures = rows_of(dice), fixtures_of(dice)
    before = as_dict(built(spark, rows, fixtures))
    # all that is not known of the row itself changes from time 12 on
    rows = [(w, t, a, b, *rest) if t < 12 else (w, t, 99.0, 1 - b, rest[0], rest[1], *rest[2:]) for w, t, a, b, *rest in rows]
    fixtures = [(c, t, p, s, m) if t < 12 else (c, t, 7.0, "now", m) for c, t, p, s, m in fixtures]
    after = as_dict(built(spark, rows, fixtures))
    assert {k: v for k, v in before.items() if k[1] <= 12} == {k: v for k, v in after.items() if k[1] <= 12}
    assert any(before[k] != after[k] for k in before if k[1] > 12)


def test_against_plain_loops(spark):
    dice = random.Random(2)
    rows, fixtures = rows_of(dice), fixtures_of(dice)
    got = as_dict(built(spark, rows, fixtures))

    def mean(v):
        v = [x for x in v if x is not None]
        return round(sum(v) / len(v), 9) if v else None

    def near(x):
        return None if x is None else round(x, 9)

    assert len(got) == 6 * 17
    for (who, at), row in got.items():
        past = [x for x in rows if x[0] == who and x[1] < at]
        own = next(x for x in rows if x[:2] == (who, at))
        assert near(row["a_mean_12"]) == mean([x[2] for x in past[-12:]]) and row["appearances"] == len(past)
        total, per = [x[2] for x in past[-6:] if x[2] is not None], sum(x[3] for x in past[-6:])
        assert near(row["rate"]) == (round(90 * sum(total) / per, 9) if total and per > 0 else None)
        assert near(row["share"]) == round(per / len(past[-6:]), 9) and row["price_change"] == own[5] - past[-1][5]
        assert row["position_changed"] == int(own[4] != past[-12:][0][4]) and row["is_X"] == int(own[4] == "X")
        club = [x for x in fixtures if x[0] == own[6] and x[1] < at]
        other = [x for x in fixtures if x[0] == own[7] and x[1] < at]
        points, theirs = mean([x[2] for x in club[-6:]]), mean([x[2] for x in other[-6:]])
        assert near(row["team_points_6"]) == points and row["team_rest"] == 1 and row["team_recent"] == min(4, len(club))
        assert near(row["gap"]) == (None if points is None or theirs is None else near(row["team_points_6"] - row["opponent_points_6"]))
        shapes = [x[3] for x in club[-6:]]
        assert near(row["team_stability"]) == round(shapes.count(shapes[-1]) / len(shapes), 9)
        manager, spell = next(x[4] for x in fixtures if x[:2] == (own[6], at)), []
        while len(spell) < len(club) and club[-1 - len(spell)][4] == manager:
            spell.append(club[-1 - len(spell)])
        assert row["team_manager_matches"] == len(spell) and near(row["team_manager_points"]) == mean([x[2] for x in spell])


def test_one_exchange_for_each_key(spark):
    dice = random.Random(3)
    rows = spark.createDataFrame(rows_of(dice), "who long, at long, a double, b double, pos string, price double, club string, opp string").repartition(3)
    plan = rows.withColumns(history.own_features(RECIPE))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(who") == 1
    assert rows.withColumns(history.own_features(RECIPE)).agg(F.count("a_mean_3")).first()[0] > 0
