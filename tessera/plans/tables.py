"""The driver's tables in the roles of a sports panel, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
#: Orders that one task joins with their lines and sorts, however many there are.
ORDERS_A_TASK = 250_000
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each supplier and month: revenue, quantity and lines."""
    lines = table(spark, sf_dir, "lineitem")
    month = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("long")
    keyed = lines.select(
        F.col("l_suppkey").alias("entity"), month.alias("period"), F.year("l_shipdate").cast("long").alias("season"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"), F.col("l_quantity").alias("q"),
    )
    return keyed.groupBy("entity", "period", "season").agg(r(F.sum("v"), 4).alias("revenue"), F.sum("q").alias("qty"), F.count(F.lit(1)).alias("n"))


PANEL = """panel AS (SELECT l_suppkey AS entity, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS BIGINT) AS period,
 CAST(year(l_shipdate) AS BIGINT) AS season, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, sum(l_quantity) AS qty, count(*) AS n
 FROM lineitem GROUP BY 1, 2, 3)"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as matches: the customer's nation at home, the supplier's of its cheapest line away."""
    lines, customers = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_totalprice")
    parts = -(-orders.count() // ORDERS_A_TASK)  # counted from the files' footers
    dealt = parts > int(spark.conf.get("spark.sql.shuffle.partitions"))  # else the session's number does
    if dealt:
        lines, orders = lines.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey")
    lines = lines.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s_suppkey"), F.count(F.lit(1)).alias("lines"))
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    if dealt:
        joined, customers = joined.repartition(parts, "c_custkey"), customers.repartition(parts, "c_custkey")
    joined = joined.join(customers, "c_custkey")
    joined = joined.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    return joined.where("c_nationkey <> s_nationkey").select(
        F.col("o_orderkey").alias("match"), F.col("o_orderdate").alias("kickoff"), F.col("c_nationkey").alias("home"), F.col("s_nationkey").alias("away"),
        F.pmod(F.col("o_orderkey"), F.lit(5)).cast("int").alias("home_goals"), F.pmod(F.col("lines"), F.lit(4)).cast("int").alias("away_goals"),
    )


MATCHES = """cheapest AS (SELECT l_orderkey, min(l_suppkey) AS s_suppkey, count(*) AS lines FROM lineitem GROUP BY 1),
matches AS (SELECT o_orderkey AS match, o_orderdate AS kickoff, c_nationkey AS home, s_nationkey AS away,
 CAST(o_orderkey % 5 AS INTEGER) AS home_goals, CAST(lines % 4 AS INTEGER) AS away_goals FROM orders JOIN cheapest ON l_orderkey = o_orderkey
 JOIN customer ON c_custkey = o_custkey JOIN supplier USING (s_suppkey) WHERE c_nationkey <> s_nationkey)"""


def team_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each side of each match."""
    def side(team: str, scored: str, conceded: str, at_home: int) -> Column:
        return F.struct(F.col(team).alias("team"), F.col(scored).alias("scored"), F.col(conceded).alias("conceded"), F.lit(at_home).alias("at_home"))

    sides = F.array(side("home", "home_goals", "away_goals", 1), side("away", "away_goals", "home_goals", 0))
    return matches(spark, sf_dir).select("match", "kickoff", F.inline(sides))


TEAM_MATCHES = (
    MATCHES
    + """, team_matches AS (SELECT match, kickoff, home AS team, home_goals AS scored, away_goals AS conceded, 1 AS at_home FROM matches
 UNION ALL SELECT match, kickoff, away, away_goals, home_goals, 0 FROM matches)"""
)


def seconds(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000.0
