"""Nested lookups, names, tolerances, fitted goals and nearest rows over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import domain as D
from tessera.operators import goals, linking, neighbours
from tessera.plans.relations import strength
from tessera.plans.tables import MATCHES, ORACLE_SQL, matches, query, r, seconds, table
from tessera.sources import archive


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the list of their lines."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))


@query(
    "J8_S21_nested_lookup",
    "SELECT l_orderkey, count(*) AS n, string_agg(coalesce(p_brand, '-'), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS brands FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) ON p_partkey = l_partkey GROUP BY 1",
)
def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").where("p_size <= 40")
    found = linking.nested_lookup(_sheets(spark, sf_dir), ["l_orderkey"], "lines", "l_partkey", parts, "p_partkey", "p_brand", "brand")
    named = F.transform("lines.brand", lambda b: F.coalesce(b, F.lit("-")))
    return found.select("l_orderkey", F.size("lines").cast("long").alias("n"), F.array_join(named, ",").alias("brands"))


@query(
    "J8_S21_rejects",
    """SELECT l_orderkey, place, l_partkey AS unknown FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS place FROM lineitem)
 WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)""",
)
def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").where("p_size <= 40")
    return linking.unresolved(_sheets(spark, sf_dir), ["l_orderkey"], "lines", "l_partkey", parts, "p_partkey")


@query(
    "J20_alias_resolver",
    """WITH f AS (SELECT p_partkey, p_brand, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS name FROM part), n AS (SELECT name, min(p_partkey) AS owner FROM f GROUP BY 1), a AS (SELECT lower(replace(p_brand, '#', '')) AS alias, min(name) AS name FROM f GROUP BY 1),
w AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN lower(replace(p_brand, '#', '')) ELSE left(name, CAST(3 + p_partkey % 9 AS INTEGER)) END AS wanted FROM f),
p AS (SELECT wanted, CASE WHEN count(DISTINCT owner) = 1 THEN min(owner) END AS owner FROM (SELECT DISTINCT wanted FROM w) JOIN n ON starts_with(n.name, wanted) AND length(wanted) >= 4 AND length(n.name) > length(wanted) GROUP BY 1)
SELECT p_partkey, wanted, coalesce(n.owner, m.owner, CASE WHEN n.name IS NULL AND a.alias IS NULL THEN p.owner END) AS owner FROM w LEFT JOIN n ON n.name = wanted LEFT JOIN a ON a.alias = wanted LEFT JOIN n m ON m.name = a.name LEFT JOIN p USING (wanted)""",
)
def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", D.fold_name(F.col("p_name")).alias("name"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("alias"))
    owners = parts.groupBy("name").agg(F.min("p_partkey").alias("owned_by"))
    called = parts.groupBy("alias").agg(F.min("name").alias("name"))
    wanted = F.when(F.col("p_partkey") % 5 == 0, F.col("alias")).otherwise(F.substring(F.col("name"), F.lit(1), (3 + F.col("p_partkey") % 9).cast("int")))
    return linking.resolved(parts.select("p_partkey", wanted.alias("wanted")), "wanted", owners, "name", "owned_by", called, "owner")


@query(
    "J17_quotes_near_matches",
    f"""WITH {MATCHES}, q AS (SELECT match AS quote, epoch(kickoff) + 3600.0 * (match % 97 - 48) AS quoted, home AS h, away AS a FROM matches WHERE match % 3 = 0), m AS (SELECT match, epoch(kickoff) AS kick, 'nation' || home AS mh, 'nation' || away AS ma FROM matches),
k AS (SELECT quote, quoted, 'nation' || CASE WHEN quote % 2 = 0 THEN left(CAST(h AS VARCHAR), 1) ELSE CAST(h AS VARCHAR) END AS qh, 'nation' || a AS qa FROM q)
SELECT quote, match FROM k JOIN m ON abs(quoted - kick) < 129600 AND (starts_with(qh, mh) OR starts_with(mh, qh)) AND (starts_with(qa, ma) OR starts_with(ma, qa))""",
)
def quotes_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).persist()  # both sides and their names read it

    def name(c):
        return F.concat(F.lit("nation"), c)

    home, short = F.col("home").cast("string"), F.col("match") % 2 == 0
    quotes = m.where("match % 3 = 0").select(F.col("match").alias("quote"), (seconds("kickoff") + 3600.0 * (F.col("match") % 97 - 48)).alias("at"), name(F.when(short, F.substring(home, 1, 1)).otherwise(home)).alias("qh"), name(F.col("away").cast("string")).alias("qa"))
    played = m.select("match", seconds("kickoff").alias("kick"), name(home).alias("mh"), name(F.col("away").cast("string")).alias("ma"))
    return linking.near_in_time_and_name(quotes, played, ("at", "kick"), [("qh", "mh"), ("qa", "ma")], 36 * 3600.0).select("quote", "match")


@query(
    "J30_kernel_pairs",
    """WITH s AS (SELECT l_orderkey, l_linenumber AS n, l_quantity / 50 AS x, l_discount * 10 AS y, l_linenumber % 2 AS side, greatest(0.16, 1.0 / (1 + l_linenumber)) AS reach FROM lineitem),
p AS (SELECT a.l_orderkey, a.n AS slot, b.n AS against, (1 - abs(a.x - (1 - b.x)) / b.reach) * (1 - abs(a.y - (1 - b.y)) / 0.55) AS w FROM s a JOIN s b USING (l_orderkey) WHERE a.side = 1 AND b.side = 0 AND abs(a.x - (1 - b.x)) <= b.reach AND abs(a.y - (1 - b.y)) <= 0.55),
t AS (SELECT *, w / sum(w) OVER (PARTITION BY l_orderkey, slot) AS v FROM p WHERE w > 0)
SELECT l_orderkey, slot, against, round(v / sum(v) OVER (PARTITION BY l_orderkey, slot), 6) AS weight FROM t WHERE v >= 0.03""",
)
def kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber AS n", "l_quantity / 50 AS x", "l_discount * 10 AS y", "l_linenumber % 2 AS side", "greatest(0.16D, 1.0D / (1 + l_linenumber)) AS reach")
    own = s.where("side = 1").select("l_orderkey", F.col("n").alias("slot"), "x", "y")
    other = s.where("side = 0").select("l_orderkey", F.col("n").alias("against"), (1 - F.col("x")).alias("u"), (1 - F.col("y")).alias("v"), "reach")
    pairs = linking.kernel_pairs(own, other, ["l_orderkey"], ["l_orderkey", "slot"], [("x", "u", "reach"), ("y", "v", 0.55)], [0.5, 0.55])
    return pairs.select("l_orderkey", "slot", "against", r("weight").alias("weight"))


@query("N16_goal_expectations")
def goal_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expectations that a part's three prices imply, where it has all three."""
    prices = table(spark, sf_dir, "part").selectExpr("p_partkey", "1 / (1 + p_size / 20.0D) AS h", "1 / 3.4D AS d", "CASE WHEN p_size % 7 > 0 THEN 1 / (1 + 30.0D / p_size) END AS a")
    book = F.col("h") + F.col("d") + F.col("a")
    fitted = goals.goal_expectations(prices, F.col("h") / book, F.col("d") / book, F.col("a") / book)
    return fitted.select("p_partkey", r("goals.home", 2).alias("home"), r("goals.away", 2).alias("away"), r("goals.error", 9).alias("error"))


@query(
    "L5_neighbours",
    """WITH s AS (SELECT stddev_samp(p_size) AS a, stddev_samp(p_retailprice) AS b FROM part), d AS (SELECT x.p_partkey AS key, y.p_partkey AS neighbour, sqrt(pow((x.p_size - y.p_size) / a, 2) + pow((x.p_retailprice - y.p_retailprice) / b, 2)) AS distance FROM part x JOIN part y ON x.p_partkey % 20 = 0 AND x.p_partkey <> y.p_partkey, s)
SELECT key, CAST(place AS INTEGER) AS place, round(distance, 9) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance, neighbour) AS place FROM d) WHERE place <= 10""",
)
def nearest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distances of every twentieth part's ten nearest."""
    parts = table(spark, sf_dir, "part")
    found = neighbours.neighbours(parts.where("p_partkey % 20 = 0"), parts, "p_partkey", ["p_size", "p_retailprice"], 10)
    return found.select("key", "place", r("distance", 9).alias("distance"))


@query(
    "N25_T6_forecast",
    f"""WITH {MATCHES}, st AS ({ORACLE_SQL["A18_strength"]}), m AS (SELECT (avg(home_goals) + avg(away_goals)) / 2 AS base, avg(home_goals) / avg(away_goals) AS adv FROM matches), f AS (SELECT DISTINCT home, away FROM matches),
e AS (SELECT f.home, f.away, base * h.attack * a.defence * sqrt(adv) AS x, base * a.attack * h.defence / sqrt(adv) AS y FROM f JOIN st h ON h.team = f.home JOIN st a ON a.team = f.away, m),
g AS (SELECT e.home, e.away, x, y, i.k AS hg, j.k AS ag, exp(-x) * pow(x, i.k) / factorial(CAST(i.k AS INTEGER)) * exp(-y) * pow(y, j.k) / factorial(CAST(j.k AS INTEGER)) AS p FROM e, (SELECT unnest(range(16)) AS k) i, (SELECT unnest(range(16)) AS k) j)
SELECT home, away, round(max(x), 6) AS home_goals, round(max(y), 6) AS away_goals, round(sum(p) FILTER (hg > ag), 6) AS home_win, round(sum(p) FILTER (hg = ag), 6) AS draw, round(sum(p) FILTER (hg < ag), 6) AS away_win, round(sum(p) FILTER (hg + ag > 2), 6) AS over25, round(exp(-max(y)), 6) AS home_clean_sheet,
 arg_max(hg || '-' || ag, p) FILTER (hg <= 6 AND ag <= 6) AS likeliest FROM g GROUP BY 1, 2""",
)
def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expectations and outcomes of every pairing that has been played, from both sides' strengths."""
    m = matches(spark, sf_dir)
    means = m.agg(F.avg("home_goals").alias("h"), F.avg("away_goals").alias("a"))  # one row
    pairs = m.select("home", "away").distinct().crossJoin(F.broadcast(means))
    known = goals.expected_goals(pairs, strength(spark, sf_dir), "home", "away", "team", (F.col("h") + F.col("a")) / 2, F.col("h") / F.col("a"))
    found = goals.forecast(known, F.col("home_goals"), F.col("away_goals"))
    names = ("home_goals", "away_goals", "home_win", "draw", "away_win", "over25", "home_clean_sheet")
    first = F.get("scores", F.lit(0))
    return found.select("home", "away", *(r(c).alias(c) for c in names), F.concat_ws("-", first["home"], first["away"]).alias("likeliest"))


ARCHIVE = "CAST(year(l_shipdate) AS VARCHAR) AS season, CASE WHEN l_partkey % 17 = 0 THEN 'x' ELSE CAST(l_partkey AS VARCHAR) || CASE WHEN l_partkey % 2 = 0 THEN '.0' ELSE '' END END AS element, CAST(l_linenumber % 4 AS VARCHAR) AS week, l_quantity AS minutes, l_extendedprice AS xg"
KNOWN = "CAST(1992 + p_partkey % 7 AS VARCHAR) AS season, CAST(p_partkey AS VARCHAR) AS id, CAST(p_partkey * 10 AS VARCHAR) AS code"
_KEYED = f"WITH a AS (SELECT {ARCHIVE} FROM lineitem), k AS (SELECT {KNOWN} FROM part), j AS (SELECT a.*, k.code FROM a LEFT JOIN k ON k.season = a.season AND k.id = replace(a.element, '.0', '') AND CAST(k.code AS BIGINT) > 0)"


def _archive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def text(sql: str) -> list[str]:
        return [e.strip().replace("VARCHAR", "STRING") for e in sql.split(", ")]

    rows = table(spark, sf_dir, "lineitem").selectExpr(*text(ARCHIVE))
    return rows, archive.codes(table(spark, sf_dir, "part").selectExpr(*text(KNOWN)), "season", "id", "code")


@query("J6_S19_archive_codes", f"{_KEYED} SELECT season, CAST(code AS BIGINT) AS code, CAST(week AS BIGINT) AS week, count(*) AS n, round(sum(minutes), 2) AS minutes, round(sum(CASE WHEN CAST(season AS INTEGER) >= 1996 THEN xg END), 2) AS xg FROM j WHERE code IS NOT NULL AND CAST(week AS BIGINT) >= 1 GROUP BY ALL")
def archive_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.rekeyed(*_archive(spark, sf_dir), "season", "element", "week", {"xg": 1996})
    return rows.groupBy("season", "code", "week").agg(F.count(F.lit(1)).alias("n"), r(F.sum("minutes"), 2).alias("minutes"), r(F.sum("xg"), 2).alias("xg"))


@query("J6_archive_rejects", f"{_KEYED} SELECT season, CASE WHEN code IS NULL THEN 'element' ELSE 'week' END AS reason, count(*) AS n FROM j WHERE code IS NULL OR CAST(week AS BIGINT) < 1 GROUP BY ALL")
def archive_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.rejected(*_archive(spark, sf_dir), "season", "element", "week")
