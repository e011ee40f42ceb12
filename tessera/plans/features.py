"""The point-in-time feature panel over the tables: suppliers as players, nations as clubs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import history, regression, validation
from tessera.plans.tables import PANEL, panel, query, r, table

RECIPE = history.Recipe(
    who="entity", at="period", measures=("revenue", "qty", "n"),
    rates=(history.Rate("revenue_rate_12", "revenue", "qty", 12), history.Rate("lines_per_90_6", "n", "qty", 6, 90.0)),
    shares={"busy_share_6": ("busy", 6)}, steps=("price",), known=("price",), position="position", positions=("GKP", "DEF", "MID", "FWD"),
)
CLUB = ("goals_for", "goals_against", "points")

_FORM = "ROWS BETWEEN {0} PRECEDING AND 1 PRECEDING"
_BY = "PARTITION BY entity ORDER BY period"
_MEANS = ", ".join(f"round(avg({m}) OVER ({_BY} {_FORM.format(n)}), 4) AS {m}_mean_{n}" for m in ("revenue", "qty", "n") for n in (3, 6, 12))
_CLUB_MEANS = ", ".join(f"avg({m}) OVER (PARTITION BY club ORDER BY period {_FORM.format(6)}) AS {m}_6" for m in CLUB)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").cast("long").alias("club"))
    rows = panel(spark, sf_dir).join(nations, "entity")
    position = F.element_at(F.array(*map(F.lit, ("GKP", "DEF", "MID", "FWD"))), (F.pmod(F.col("n"), F.lit(4)) + 1).cast("int"))
    return rows.withColumns({"opponent": F.pmod(F.col("club") + F.col("period"), F.lit(25)), "price": r(F.col("revenue") / F.col("qty"), 2), "busy": F.col("n") >= 3, "position": position})


def _fixtures(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("club", "period").agg(F.sum("revenue").alias("s"), F.sum("qty").alias("q"), F.sum("n").alias("m"))
    return sums.select("club", "period", (F.col("s") / 1e6).alias("goals_for"), (F.col("q") / 1e3).alias("goals_against"), (F.col("m") % 4).cast("double").alias("points"), (F.col("m") % 3).alias("shape"), F.floor(F.col("period") / 7).alias("manager"))


@query(
    "W15_W17_W18_feature_panel",
    f"""WITH {PANEL}, p AS (SELECT entity, period, revenue, qty, n, CAST(s_nationkey AS BIGINT) AS club, ((s_nationkey + period) % 25 + 25) % 25 AS opponent, round(revenue / qty, 2) AS price, n >= 3 AS busy, ['GKP', 'DEF', 'MID', 'FWD'][1 + n % 4] AS position FROM panel JOIN supplier ON s_suppkey = entity),
o AS (SELECT entity, period, club, opponent, price, {_MEANS}, CASE WHEN sum(qty) OVER ({_BY} {_FORM.format(12)}) > 0 THEN sum(revenue) OVER ({_BY} {_FORM.format(12)}) / sum(qty) OVER ({_BY} {_FORM.format(12)}) END AS revenue_rate_12,
 90 * sum(n) OVER ({_BY} {_FORM.format(6)}) / sum(qty) OVER ({_BY} {_FORM.format(6)}) AS lines_per_90_6, avg(CAST(busy AS DOUBLE)) OVER ({_BY} {_FORM.format(6)}) AS busy_share_6, price - lag(price) OVER ({_BY}) AS price_change,
 CAST(position <> first_value(position) OVER ({_BY} {_FORM.format(12)}) AS INTEGER) AS position_changed, CAST(position = 'GKP' AS INTEGER) AS is_gkp, CAST(position = 'FWD' AS INTEGER) AS is_fwd, row_number() OVER ({_BY}) - 1 AS appearances FROM p),
s AS (SELECT club, period, sum(revenue) / 1e6 AS goals_for, sum(qty) / 1e3 AS goals_against, CAST(sum(n) % 4 AS DOUBLE) AS points, sum(n) % 3 AS shape, CAST(floor(period / 7.0) AS BIGINT) AS manager FROM p GROUP BY club, period),
k AS (SELECT club, period, {_CLUB_MEANS}, period - lag(period) OVER w AS rest, count(*) OVER (PARTITION BY club ORDER BY period RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) - 1 AS recent, list(shape) OVER (PARTITION BY club ORDER BY period {_FORM.format(6)}) AS shapes,
 period - first_value(period) OVER (PARTITION BY club, manager ORDER BY period) AS manager_time, row_number() OVER (PARTITION BY club, manager ORDER BY period) - 1 AS manager_matches, avg(points) OVER (PARTITION BY club, manager ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS manager_points FROM s WINDOW w AS (PARTITION BY club ORDER BY period))
SELECT o.entity, o.period, {", ".join(f"{m}_mean_{n}" for m in ("revenue", "qty", "n") for n in (3, 6, 12))}, round(revenue_rate_12, 4) AS revenue_rate_12, round(lines_per_90_6, 6) AS lines_per_90_6, round(busy_share_6, 6) AS busy_share_6, round(price_change, 4) AS price_change, position_changed, is_gkp, is_fwd, o.appearances,
 round(t.goals_for_6, 6) AS team_goals_for_6, round(t.points_6, 6) AS team_points_6, t.rest AS team_rest, t.recent AS team_recent, CASE WHEN len(t.shapes) >= 2 THEN round(len(list_filter(t.shapes, lambda x: x = t.shapes[-1])) / len(t.shapes), 6) END AS team_stability, t.manager_time AS team_manager_time, t.manager_matches AS team_manager_matches, round(t.manager_points, 6) AS team_manager_points,
 round(q.goals_against_6, 6) AS opponent_goals_against_6, round(t.points_6 - q.points_6, 6) AS strength_gap
 FROM o LEFT JOIN k t ON t.club = o.club AND t.period = o.period LEFT JOIN k q ON q.club = o.opponent AND q.period = o.period WHERE o.appearances >= 3""",
)
def feature_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    clubs = history.club_features(_fixtures(rows), "club", "period", CLUB, days=4, shape="shape", manager="manager")
    built = history.build(rows, RECIPE, {"team": "club", "opponent": "opponent"}, clubs, gaps={"strength_gap": "points_6"})
    means = [r(f"{m}_mean_{n}", 4).alias(f"{m}_mean_{n}") for m in RECIPE.measures for n in RECIPE.windows]
    rounded = {"revenue_rate_12": 4, "lines_per_90_6": 6, "busy_share_6": 6, "price_change": 4, "team_goals_for_6": 6, "team_points_6": 6, "team_stability": 6, "team_manager_points": 6, "opponent_goals_against_6": 6, "strength_gap": 6}
    return built.select(
        "entity", "period", *means, *(r(c, p).alias(c) for c, p in rounded.items()), "position_changed", F.col("is_GKP").alias("is_gkp"), F.col("is_FWD").alias("is_fwd"), F.col("appearances").cast("long").alias("appearances"),
        "team_rest", "team_recent", "team_manager_time", "team_manager_matches",
    )


WEEKS = "entity, season, period % 12 AS week, s_nationkey AS club, CASE n % 4 WHEN 0 THEN 'GKP' WHEN 1 THEN 'DEF' ELSE 'MID' END AS position, CAST(qty AS BIGINT) % 95 AS minutes, n % 3 AS goals, n % 2 AS assists, CASE WHEN n % 5 > 2 THEN 1 ELSE 0 END AS clean_sheets, n % 4 AS conceded, n % 7 AS saves, n * 3 AS bps, CASE WHEN n % 6 = 0 THEN 1 ELSE 0 END AS yellows, CASE WHEN n % 9 = 0 THEN 1 ELSE 0 END AS reds, CASE WHEN n > 1 THEN CAST(qty AS BIGINT) END AS price"


@query(
    "L14_targets",
    f"""WITH {PANEL}, w AS (SELECT {WEEKS} FROM panel JOIN supplier ON s_suppkey = entity), v AS (SELECT *, lead(season) OVER a = season AND lead(week) OVER a = week + 1 AS follows, lead(price) OVER a AS later FROM w WINDOW a AS (PARTITION BY entity ORDER BY season, week)),
p AS (SELECT entity, season, week, 'minutes' AS component, CAST(minutes >= 60 AS DOUBLE) AS value FROM v UNION ALL SELECT entity, season, week, 'goal_rate', goals * 90.0 / minutes FROM v WHERE minutes >= 20 UNION ALL SELECT entity, season, week, 'assist_rate', assists * 90.0 / minutes FROM v WHERE minutes >= 20
 UNION ALL SELECT entity, season, week, 'save_rate', saves * 90.0 / minutes FROM v WHERE minutes >= 20 AND position = 'GKP' UNION ALL SELECT entity, season, week, 'bps_rate', bps * 90.0 / minutes FROM v WHERE minutes >= 20 UNION ALL SELECT entity, season, week, 'card_rate', CAST(yellows + reds > 0 AS DOUBLE) FROM v WHERE minutes >= 20
 UNION ALL SELECT entity, season, week, 'price_rise', CAST(later > price AS DOUBLE) FROM v WHERE follows AND later IS NOT NULL AND price IS NOT NULL UNION ALL SELECT min(entity), season, week, 'clean_sheet', arg_min(CAST(clean_sheets > 0 AS DOUBLE), entity) FROM v WHERE minutes >= 60 GROUP BY season, week, club
 UNION ALL SELECT min(entity), season, week, 'conceded_rate', arg_min(conceded * 90.0 / minutes, entity) FROM v WHERE minutes >= 20 GROUP BY season, week, club)
SELECT entity, season, week, component, round(value, 6) AS value FROM p""",
)
def component_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), "s_nationkey")
    weeks = panel(spark, sf_dir).join(nations, "entity").selectExpr(*(e.strip() for e in WEEKS.split(", ")))
    return validation.targets(weeks, "entity", "season", "week", "club", "position").withColumn("value", r("value"))


@query(
    "L10_splits",
    f"""WITH {PANEL}, c AS (SELECT season, count(*) AS n FROM panel GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY season) AS i, max(season) OVER () AS top FROM c)
SELECT k.season AS test, k.n AS test_rows, min(t.season) AS first, max(t.season) AS last, CAST(sum(t.n) AS BIGINT) AS train_rows, (SELECT n FROM k p WHERE p.i = k.i - 1) AS purged FROM k JOIN k t ON t.i BETWEEN k.i - 4 AND k.i - 2 WHERE k.season > k.top - 3 GROUP BY k.season, k.n, k.i""",
)
def rolling_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rolling splits of three seasons each, a season apart from what they are tested on."""
    found = validation.splits(panel(spark, sf_dir), "season", 3, embargo=1, window=3)
    return spark.createDataFrame([(s.test, s.test_rows, s.first, s.last, s.train_rows, s.purged) for s in found], "test long, test_rows long, first long, last long, train_rows long, purged long")


def _fitted(names: list[str], target: str):
    def fit(rows: DataFrame):
        model = regression.ols(rows, names, target)
        return lambda df: df.withColumn("prediction", model.fitted())

    return fit


@query("L11_learning_curve")
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir)
    split = validation.splits(rows, "season", 1, embargo=0)[0]
    found = validation.learning_curve(rows, "revenue", "season", ["period", "entity"], split, _fitted(["qty", "n"], "revenue"))
    return spark.createDataFrame([(f["train_rows"], f["train_rmse"], f["test_rmse"]) for f in found], "train_rows long, train_rmse double, test_rmse double")


@query("L11_permutation_null")
def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir).select("entity", "period", "season", "qty", "revenue")
    found = validation.permutation_null(rows, "revenue", "season", ["entity", "period"], validation.splits(rows, "season", 2, embargo=0), _fitted(["qty"], "revenue"), runs=3)
    return spark.createDataFrame([(found["observed"], found["null_mean"], found["null_sd"], found["p"])], "observed double, null_mean double, null_sd double, p double")
