"""Careers, points and records over the tables, in the roles of the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import domain as D
from tessera.operators import careers, frames, ordering, sets, stats
from tessera.plans.tables import MATCHES, PANEL, matches, panel, query, r, table

STATS = {
    "minutes": "l_quantity * 2 - 5", "goals": "l_linenumber % 3", "assists": "l_suppkey % 2", "clean_sheet": "l_partkey % 3 = 0", "conceded": "l_partkey % 5", "saves": "l_suppkey % 8", "penalties_saved": "l_partkey % 2",
    "penalties_missed": "l_orderkey % 2", "yellows": "l_linenumber % 2", "reds": "CASE WHEN l_orderkey % 11 = 0 THEN 1 ELSE 0 END", "own_goals": "l_suppkey % 2", "defensive": "CASE WHEN l_partkey % 7 > 0 THEN l_partkey % 17 END", "bonus": "l_linenumber % 4",
}
POSITION = "CASE l_orderkey % 4 WHEN 0 THEN 'GKP' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END"


@query(
    "N12_scoring",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, {POSITION} AS pos, {", ".join(f"{v} AS {k}" for k, v in STATS.items())} FROM lineitem),
p AS (SELECT *, CASE WHEN minutes <= 0 THEN 0 WHEN minutes >= 60 THEN 2 ELSE 1 END AS appearance, CASE WHEN clean_sheet AND minutes >= 60 THEN CASE pos WHEN 'MID' THEN 1 WHEN 'FWD' THEN 0 ELSE 4 END ELSE 0 END AS sheet,
 CASE WHEN reds > 0 THEN -3 ELSE -yellows END AS cards, CASE WHEN minutes > 0 AND coalesce(defensive, 0) >= CASE pos WHEN 'GKP' THEN NULL WHEN 'DEF' THEN 10 ELSE 12 END THEN 2 ELSE 0 END AS def FROM s)
SELECT l_orderkey, l_linenumber, CAST(cards AS BIGINT) AS cards, CAST(sheet AS BIGINT) AS clean_sheet, CAST(appearance + goals * CASE pos WHEN 'GKP' THEN 10 WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END + 3 * assists + sheet + CASE WHEN pos = 'GKP' THEN saves // 3 ELSE 0 END
 - CASE WHEN pos IN ('GKP', 'DEF') THEN conceded // 2 ELSE 0 END + 5 * penalties_saved - 2 * penalties_missed + cards - 2 * own_goals + def + bonus AS BIGINT) AS total FROM p""",
)
def scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = {k: F.expr(v) for k, v in STATS.items()}
    found = careers.points(F.expr(POSITION), stats)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(found[c].cast("long").alias(c) for c in ("cards", "clean_sheet", "total")))


@query(
    "A8_career_totals",
    f"""WITH {PANEL} SELECT entity, CAST(sum(coalesce(CASE WHEN n % 4 > 0 THEN n END, 0)) AS BIGINT) AS n, sum(qty) AS qty, count(DISTINCT season) AS contests, string_agg(DISTINCT CAST(season AS VARCHAR), ',' ORDER BY CAST(season AS VARCHAR)) AS names FROM panel GROUP BY 1""",
)
def career_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir).withColumns({"n": F.when(F.col("n") % 4 > 0, F.col("n")), "season": F.col("season").cast("string")})
    return careers.totals(rows, ["entity"], ["n", "qty"], "season").withColumn("names", F.array_join("names", ","))


@query(
    "A19_value_metrics",
    f"""WITH {PANEL}, t AS (SELECT entity, sum(n) AS points, avg(n) FILTER (period >= 30) AS form, CAST(max(qty) AS BIGINT) - 40 AS price, CAST(min(qty) AS BIGINT) AS start FROM panel GROUP BY 1)
SELECT entity, round(CASE WHEN price > 0 THEN points / (price / 10.0) ELSE 0 END, 6) AS points_per_million, round(CASE WHEN price > 0 THEN form / (price / 10.0) ELSE 0 END, 6) AS form_per_million, price - start AS price_change FROM t""",
)
def value_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = panel(spark, sf_dir).groupBy("entity").agg(F.sum("n").alias("points"), F.avg(F.when(F.col("period") >= 30, F.col("n"))).alias("form"), (F.max("qty").cast("long") - 40).alias("price"), F.min("qty").cast("long").alias("start"))
    found = careers.value(*(F.col(c) for c in ("points", "form", "price", "start")))
    return t.select("entity", r(found["points_per_million"]).alias("points_per_million"), r(found["form_per_million"]).alias("form_per_million"), found["price_change"].alias("price_change"))


@query(
    "A21_officiated_clubs",
    f"""WITH {MATCHES}, m AS (SELECT match % 40 AS referee, match, unnest([home, away]) AS club FROM matches), c AS (SELECT match, home AS club, home_goals AS cards FROM matches WHERE match % 3 > 0 UNION ALL SELECT match, away, away_goals FROM matches WHERE match % 3 > 0),
k AS (SELECT referee, club, count(*) AS matches, count(cards) AS measured, CAST(sum(coalesce(cards, 0)) AS BIGINT) AS cards FROM m LEFT JOIN c USING (match, club) GROUP BY 1, 2)
SELECT referee, club, matches, measured, cards FROM (SELECT *, row_number() OVER (PARTITION BY referee ORDER BY matches DESC, club) AS p FROM k) WHERE p <= 12""",
)
def officiated(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).withColumn("referee", F.col("match") % 40)
    measured = m.where("match % 3 > 0")
    cards = measured.select("match", F.col("home").alias("club"), F.col("home_goals").alias("cards")).union(measured.select("match", "away", "away_goals"))
    return careers.officiated(m, cards, "referee", "match", ("home", "away"), "club")


@query(
    "A22_manager_record",
    f"""WITH {PANEL}, s AS (SELECT entity, season, sum(n) AS played, count(*) FILTER (n >= 3) AS wins FROM panel GROUP BY 1, 2)
SELECT entity, CAST(sum(played) AS BIGINT) AS played, CAST(sum(wins) AS BIGINT) AS wins, round(CAST(sum(wins) AS DOUBLE) / sum(played), 6) AS win_rate FROM s WHERE entity IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1""",
)
def manager_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    seasons = panel(spark, sf_dir).groupBy("entity", "season").agg(F.sum("n").alias("played"), F.count_if(F.col("n") >= 3).alias("wins"))
    wanted = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("entity"))
    return careers.record(seasons, wanted, "entity", ["played", "wins"], "wins", "played").withColumn("win_rate", r("win_rate"))


@query("W11_information_ratio", f"WITH {PANEL} SELECT entity, count(*) AS n, round(avg(revenue - coalesce(CASE WHEN period % 2 = 0 THEN qty * 100 END, 0)) / stddev_samp(revenue - coalesce(CASE WHEN period % 2 = 0 THEN qty * 100 END, 0)), 6) AS ratio FROM panel GROUP BY 1")
def information_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir).withColumn("benchmark", F.when(F.col("period") % 2 == 0, F.col("qty") * 100))
    return careers.information_ratio(rows, "revenue", ["entity"], "benchmark").withColumn("ratio", r("ratio"))


@query(
    "J31_latest_shape",
    """WITH s AS (SELECT l_suppkey AS player, l_suppkey % 10 AS club, l_orderkey * 10 + l_linenumber AS at_, CASE WHEN l_partkey % 29 = 0 AND l_suppkey % 3 > 0 THEN 'shape' || l_partkey % 5 END AS shape, CASE WHEN l_partkey % 4 > 0 THEN 'role' || l_partkey % 4 END AS role FROM lineitem),
o AS (SELECT player, max(club) AS club, arg_max(shape, at_) FILTER (shape IS NOT NULL) AS own FROM s GROUP BY 1), c AS (SELECT club, arg_max(shape, at_) FILTER (shape IS NOT NULL) AS of_club FROM s GROUP BY 1),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY at_ DESC) AS k FROM s) WHERE k <= 12 AND role IS NOT NULL), g AS (SELECT player, role, count(*) AS n, max(at_) AS t FROM n GROUP BY 1, 2),
h AS (SELECT player, role FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY n DESC, t DESC) AS k FROM g) WHERE k = 1)
SELECT o.player, coalesce(own, of_club) AS shape, own IS NOT NULL AS own, role FROM o LEFT JOIN c USING (club) LEFT JOIN h USING (player)""",
)
def latest_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS player", "l_suppkey % 10 AS club", "l_orderkey * 10 + l_linenumber AS at", "CASE WHEN l_partkey % 29 = 0 AND l_suppkey % 3 > 0 THEN concat('shape', l_partkey % 5) END AS shape", "CASE WHEN l_partkey % 4 > 0 THEN concat('role', l_partkey % 4) END AS role"
    )
    return careers.latest_shape(starts, "player", "club", "at", "shape", "role")


@query(
    "J22_hourly_lookup",
    "WITH h AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS mean, count(*) AS n FROM events WHERE event_type = 'view' OR event_type = 'click' GROUP BY 1) SELECT event_id, n, round(mean, 6) AS mean FROM events LEFT JOIN h ON hour = date_trunc('hour', ts) WHERE event_type = 'error'",
)
def hourly_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds in the hour of each row, by an equi join on the truncated hour."""
    e = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    hours = e.where("event_type IN ('view', 'click')").groupBy("hour").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return e.where("event_type = 'error'").join(hours, "hour", "left").select("event_id", "n", r("mean").alias("mean"))


@query(
    "Q14_K0_quantile_fan",
    "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS {n}" for n, p in (("p5", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95))) + " FROM lineitem GROUP BY 1",
)
def quantile_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of groups of any size, from order statistics."""
    shares = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    found = ordering.quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", shares, ["l_returnflag"])
    return found.select("l_returnflag", *(r(c).alias(c) for c in shares))


@query(
    "K15_fits",
    """WITH m AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mean, var_samp(l_quantity) AS v, avg(l_tax * 10) AS mt, var_samp(l_tax * 10) AS vt FROM lineitem GROUP BY 1)
SELECT l_returnflag, n, round(sqrt(v), 6) AS sd, round(1 / mean, 9) AS decay, round(mean * mean / (v - mean), 6) AS size, round(mean / v, 9) AS chance, round(mt * (mt * (1 - mt) / vt - 1), 6) AS alpha, round((1 - mt) * (mt * (1 - mt) / vt - 1), 6) AS beta FROM m""",
)
def fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("share", F.col("l_tax") * 10)
    whole = stats.fits(lines, "l_quantity", ["l_returnflag"]).select("l_returnflag", "n", r("sd").alias("sd"), r("decay", 9).alias("decay"), r("size").alias("size"), r("chance", 9).alias("chance"))
    return whole.join(stats.fits(lines, "share", ["l_returnflag"]).select("l_returnflag", r("alpha").alias("alpha"), r("beta").alias("beta")), "l_returnflag")


@query(
    "K6_normal_plot",
    "WITH k AS (SELECT l_extendedprice AS value, row_number() OVER (ORDER BY l_extendedprice) AS i, count(*) OVER () AS c FROM lineitem) SELECT value, count(*) AS n, round((min(i) - 0.375) / (max(c) + 0.25), 9) AS low, round((max(i) - 0.375) / (max(c) + 0.25), 9) AS high FROM k GROUP BY 1",
)
def normal_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.normal_plot(table(spark, sf_dir, "lineitem"), "l_extendedprice").select("value", "n", r("low", 9).alias("low"), r("high", 9).alias("high"))


@query("U7_distinct_sets", "SELECT min(l_orderkey) AS l_orderkey, count(*) AS often FROM (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey % 7))) AS s FROM lineitem GROUP BY 1) GROUP BY s")
def distinct_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_suppkey") % 7).alias("members"))
    return sets.distinct_sets(orders, "members", "l_orderkey").select("l_orderkey", "often")


@query("T10_first_flagged", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def first_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frames.first_flagged(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "P", [F.col("o_orderdate"), F.col("o_orderkey")])
    return found.select("o_orderkey", "o_totalprice")


@query("T2_T3_player_list", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size BETWEEN 5 AND 30 AND contains(p_name, 'ring') ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 3")
def player_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = [F.col("p_size").between(5, 30), F.contains("p_name", F.lit("ring"))]
    return frames.listed(table(spark, sf_dir, "part"), filters, [F.desc("p_retailprice"), F.col("p_partkey")], 3, 20).select("p_partkey", "p_name", "p_retailprice")


@query(
    "J26_in_charge",
    """WITH st AS (SELECT s_nationkey AS club, s_name AS name, s_suppkey AS place FROM supplier), sp AS (SELECT s_nationkey AS club, regexp_replace(lower(replace(s_name, '#', '-')), '[^a-z0-9]', '', 'g') AS folded, s_suppkey % 50 AS start, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 50 + 20 END AS ends FROM supplier WHERE s_suppkey % 2 = 0 AND s_nationkey % 4 > 0),
c AS (SELECT club, arg_max(folded, (start, folded)) AS folded FROM sp WHERE start <= 30 AND (ends IS NULL OR ends > 30) GROUP BY 1), m AS (SELECT st.*, coalesce(regexp_replace(lower(name), '[^a-z0-9]', '', 'g') = folded, false) AS hit FROM st LEFT JOIN c USING (club))
SELECT club, name, hit AS by_spell FROM (SELECT *, row_number() OVER (PARTITION BY club ORDER BY hit DESC, place) AS k FROM m) WHERE k = 1""",
)
def in_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    staff = s.select(F.col("s_nationkey").alias("club"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("place"))
    own = s.where("s_suppkey % 2 = 0 AND s_nationkey % 4 > 0")
    spells = own.select(F.col("s_nationkey").alias("club"), D.fold_name(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("folded"), (F.col("s_suppkey") % 50).alias("start"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") % 50 + 20).alias("end"))
    return careers.in_charge(staff, spells, "club", D.fold_name(F.col("name")), "folded", F.lit(30)).select("club", "name", "by_spell")


@query(
    "N24_projection",
    f"""WITH {PANEL}, f AS (SELECT entity, avg(n) FILTER (k <= 6 AND period > 20) AS form, count(*) FILTER (k <= 6 AND period > 20) AS seen, sum(n) / 38.0 AS season, avg(CAST(n > 2 AS INTEGER)) FILTER (k <= 6 AND period > 20) AS started FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS k FROM panel) GROUP BY 1),
a AS (SELECT *, CASE WHEN entity % 5 = 0 THEN NULL ELSE 1 + entity % 9 / 2.0 END AS d, ['available', 'available', 'doubtful', 'not_in_squad', 'injured'][1 + entity % 5] AS av FROM f),
m AS (SELECT *, CASE WHEN seen > 0 THEN form ELSE season END AS base, CASE WHEN d IS NULL THEN 1 ELSE least(1.4, greatest(0.6, 1 + (3 - d) * 0.12)) END AS fix, CASE av WHEN 'available' THEN 1.0 WHEN 'doubtful' THEN 0.5 WHEN 'not_in_squad' THEN 0.1 ELSE 0.0 END * CASE WHEN seen > 0 THEN least(1, greatest(0.6, 0.6 + 0.4 * started)) ELSE 1 END AS mins FROM a)
SELECT entity, round(base, 6) AS base, round(fix, 6) AS fixture_multiplier, round(mins, 6) AS minutes_multiplier, round(base * fix * mins, 6) AS points, CASE WHEN av <> 'available' THEN 'listed as ' || replace(av, '_', ' ') END AS listed FROM m""",
)
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = Window.partitionBy("entity").orderBy(F.desc("period"))
    rows = panel(spark, sf_dir).withColumn("k", F.row_number().over(last))
    now = (F.col("k") <= 6) & (F.col("period") > 20)
    f = rows.groupBy("entity").agg(F.avg(F.when(now, F.col("n"))).alias("form"), F.count_if(now).alias("seen"), (F.sum("n") / 38.0).alias("season"), F.avg(F.when(now, (F.col("n") > 2).cast("int"))).alias("started"))
    difficulty = F.when(F.col("entity") % 5 != 0, 1 + F.col("entity") % 9 / 2.0)
    listed = F.element_at(F.array(*map(F.lit, ("available", "available", "doubtful", "not_in_squad", "injured"))), (1 + F.col("entity") % 5).cast("int"))
    found = careers.projection(*(F.col(c) for c in ("form", "seen", "season")), difficulty, listed, F.col("started"))
    reason = F.get(F.filter(found["reasons"], lambda x: x.startswith("listed")), F.lit(0))
    return f.select("entity", *(r(found[c]).alias(c) for c in ("base", "fixture_multiplier", "minutes_multiplier", "points")), reason.alias("listed"))
