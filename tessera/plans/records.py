"""Records, tests of association, replayed rules and searches over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import domain as D
from tessera.operators import factors, ledger, stats, windows
from tessera.operators.ordering import running
from tessera.plans.tables import MATCHES, PANEL, TEAM_MATCHES, matches, panel, query, r, table, team_matches


@query(
    "Q8_replay",
    f"""WITH {PANEL}, s AS (SELECT entity, period, revenue, lag(revenue) OVER (PARTITION BY entity ORDER BY period) AS score FROM panel),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY score DESC, entity) AS p FROM s WHERE score IS NOT NULL) WHERE p <= 11),
g AS (SELECT period, sum(revenue) AS points, max(revenue) FILTER (p = 1) AS captain, count(*) AS held, lag(period) OVER (ORDER BY period) AS b FROM h GROUP BY 1),
k AS (SELECT h.period, count(*) AS stayed FROM h JOIN g USING (period) JOIN h o ON o.entity = h.entity AND o.period = g.b GROUP BY 1),
l AS (SELECT period, points, captain, CASE WHEN b IS NULL THEN 0 ELSE held - coalesce(stayed, 0) END AS changes FROM g LEFT JOIN k USING (period)),
n AS (SELECT *, greatest(changes - 1, 0) * 4.0 AS cost FROM l), t AS (SELECT *, sum(points + captain - cost) OVER (ORDER BY period) AS total FROM n)
SELECT period, round(points, 4) AS points, captain, changes, cost, round(points + captain - cost, 4) AS net, round(total, 4) AS total, round(total - max(total) OVER (ORDER BY period), 4) AS drawdown FROM t""",
)
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    p = p.withColumn("score", F.lag("revenue").over(Window.partitionBy("entity").orderBy("period")))
    led = ledger.replay(p, "entity", "period", "score", "revenue", 11, 4.0)
    return led.select("period", r("points", 4).alias("points"), "captain", "changes", F.col("cost").cast("decimal(21,1)").alias("cost"), *(r(c, 4).alias(c) for c in ("net", "total", "drawdown")))


@query(
    "N31_N32_violations",
    """WITH m AS (SELECT l_orderkey AS squad, l_returnflag AS pos, l_suppkey AS club, l_quantity AS price FROM lineitem),
w AS (SELECT squad, count(*) AS n, sum(price) AS cost, count(*) FILTER (pos = 'A') AS a, count(*) FILTER (pos = 'R') AS rr FROM m GROUP BY 1)
SELECT squad, 'size' AS issue, CAST(n AS VARCHAR) AS detail FROM w WHERE n <> 3 UNION ALL SELECT squad, 'budget', printf('%.2f', cost) FROM w WHERE cost > 100
 UNION ALL SELECT squad, 'quota', 'A' FROM w WHERE a <> 1 UNION ALL SELECT squad, 'quota', 'R' FROM w WHERE rr <> 2
 UNION ALL SELECT squad, 'club', CAST(club AS VARCHAR) FROM m GROUP BY squad, club HAVING count(*) > 1""",
)
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS squad", "l_returnflag AS pos", "l_suppkey AS club", "l_quantity AS price")
    return ledger.violations(m, "squad", {"A": 1, "R": 2}, "pos", "club", 1, "price", 100.0)


@query("W9_change_points")
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.change_points(panel(spark, sf_dir), "entity", "period", "revenue")


@query(
    "A10_record_by_type",
    """SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, round(CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / nullif(count(*) FILTER (event_type = 'purchase'), 0), 6) AS per_purchase FROM events GROUP BY 1""",
)
def record_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors, bought = (F.count_if(F.col("event_type") == k) for k in ("error", "purchase"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), errors.alias("errors"), r(F.try_divide(errors.cast("double"), bought)).alias("per_purchase"))


@query(
    "A14_threshold_rate",
    f"WITH {PANEL} SELECT entity, count(CASE WHEN n % 5 <> 0 THEN qty END) AS measured, round(avg(CAST(CASE WHEN n % 5 <> 0 THEN qty END >= 200 AS INTEGER)), 6) AS hit_rate FROM panel GROUP BY 1",
)
def threshold_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("n") % 5 != 0, F.col("qty"))
    return panel(spark, sf_dir).groupBy("entity").agg(F.count(c).alias("measured"), r(F.avg((c >= 200).cast("int"))).alias("hit_rate"))


@query(
    "A15_A17_fixture_weeks",
    f"""WITH {TEAM_MATCHES}, w AS (SELECT team, CAST(datediff('week', TIMESTAMP '1995-01-02', kickoff) AS INTEGER) AS week, conceded FROM team_matches), c AS (SELECT team, week, count(*) AS n, avg(conceded) AS d FROM w WHERE week BETWEEN 10 AND 17 GROUP BY 1, 2)
SELECT n_nationkey AS team, count(*) FILTER (c.n IS NULL) AS blanks, count(*) FILTER (c.n > 1) AS doubles, round(avg(d), 6) AS difficulty FROM nation CROSS JOIN (SELECT unnest(range(10, 18)) AS week) g LEFT JOIN c ON c.team = n_nationkey AND c.week = g.week GROUP BY 1""",
)
def fixture_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of a horizon without and with several matches, and their mean difficulty."""
    t = team_matches(spark, sf_dir)
    week = F.floor(F.datediff(F.col("kickoff"), F.lit("1995-01-02").cast("date")) / 7).cast("int")
    found = t.withColumn("week", week).where("week BETWEEN 10 AND 17").groupBy("team", "week").agg(F.count(F.lit(1)).alias("n"), F.avg("conceded").alias("d"))
    weeks = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team"), F.explode(F.sequence(F.lit(10), F.lit(17))).alias("week"))
    out = weeks.join(found, ["team", "week"], "left").groupBy("team").agg(F.count_if(F.col("n").isNull()).alias("blanks"), F.count_if(F.col("n") > 1).alias("doubles"), r(F.avg("d")).alias("difficulty"))
    return out.orderBy(F.col("difficulty").asc_nulls_last(), "team")


@query(
    "A20_N26_consensus",
    """WITH q AS (SELECT l_partkey AS match, l_suppkey AS book, 1 + avg(l_quantity) / 10 AS h, 1 + avg(l_tax + 0.1) * 20 AS a FROM lineitem GROUP BY 1, 2), p AS (SELECT match, (1 / h) / (1 / h + 1 / a) AS home, 1 / h + 1 / a - 1 AS margin FROM q)
SELECT match, count(*) AS books, round(avg(home), 6) AS home, round(min(margin), 6) AS low, round(max(margin), 6) AS high FROM p GROUP BY 1""",
)
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("match"), "l_suppkey").agg((1 + F.avg("l_quantity") / 10).alias("h"), (1 + F.avg(F.col("l_tax") + 0.1) * 20).alias("a"))
    h, a = D.implied(F.col("h")), D.implied(F.col("a"))
    p = q.select("match", (h / (h + a)).alias("home"), (h + a - 1).alias("margin"))
    return p.groupBy("match").agg(F.count(F.lit(1)).alias("books"), r(F.avg("home")).alias("home"), r(F.min("margin")).alias("low"), r(F.max("margin")).alias("high"))


@query(
    "A23_A24_heatmap",
    """WITH p AS (SELECT user_id % 8 AS player, least(11, CAST(floor((event_id * 7919 % 1009) / 1008.0 * 12) AS INTEGER)) AS x, least(7, CAST(floor((event_id * 104729 % 997) / 996.0 * 8) AS INTEGER)) AS y FROM events), c AS (SELECT player, x, y, count(*) AS n FROM p GROUP BY ALL)
SELECT player, x, y, coalesce(n, 0) AS n FROM (SELECT DISTINCT player FROM p) CROSS JOIN (SELECT unnest(range(12)) AS x) CROSS JOIN (SELECT unnest(range(8)) AS y) LEFT JOIN c USING (player, x, y)""",
)
def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts on a dense 12 by 8 grid for each player."""
    p = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).alias("player"), D.grid_cell(F.col("event_id") * 7919 % 1009, 1008.0, 12).alias("x"), D.grid_cell(F.col("event_id") * 104729 % 997, 996.0, 8).alias("y")
    )
    c = p.groupBy("player", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    grid = p.select("player").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return grid.join(c, ["player", "x", "y"], "left").fillna(0, ["n"])


@query(
    "J7_fixture_match",
    f"WITH {MATCHES}, f AS (SELECT home, away, CAST(month(kickoff) AS INTEGER) AS round, min(match) AS fixture FROM matches WHERE match % 2 = 0 GROUP BY ALL) SELECT m.match, f.fixture FROM matches m JOIN f ON f.home = m.home AND f.away = m.away AND f.round = coalesce(CAST(month(m.kickoff) AS INTEGER), 0)",
)
def fixture_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).withColumn("round", F.coalesce(F.month("kickoff"), F.lit(0)))
    f = m.where("match % 2 = 0").groupBy("home", "away", "round").agg(F.min("match").alias("fixture"))
    return m.join(f, ["home", "away", "round"]).select("match", "fixture")


@query(
    "J15_weekly_strength",
    f"""WITH {TEAM_MATCHES}, w AS (SELECT team, date_trunc('week', kickoff) AS week, count(*) AS n, sum(scored) AS s FROM team_matches GROUP BY 1, 2),
c AS (SELECT team, week, sum(n) OVER b AS n, sum(s) OVER b AS s FROM w WINDOW b AS (PARTITION BY team ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT match, m.team, CASE WHEN n >= 40 THEN round(s / n, 6) END AS rate FROM team_matches m JOIN c ON c.team = m.team AND c.week = date_trunc('week', kickoff)""",
)
def weekly_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring rate from the matches before a match's week, once there are forty."""
    t = team_matches(spark, sf_dir).withColumn("week", F.date_trunc("week", "kickoff"))
    w = t.groupBy("team", "week").agg(F.count(F.lit(1)).alias("n"), F.sum("scored").alias("s"))
    before = Window.partitionBy("team").orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
    c = w.select("team", "week", F.sum("n").over(before).alias("n"), F.sum("s").over(before).alias("s"))
    return t.join(c, ["team", "week"]).select("match", "team", r(F.when(F.col("n") >= 40, F.col("s") / F.col("n"))).alias("rate"))


@query(
    "K12_cross_correlation",
    f"WITH {PANEL}, l AS (SELECT revenue, qty, lead(qty) OVER w AS q1, lead(qty, 2) OVER w AS q2 FROM panel WINDOW w AS (PARTITION BY entity ORDER BY period)) SELECT 0 AS lead, round(corr(revenue, qty), 6) AS r FROM l UNION ALL SELECT 1, round(corr(revenue, q1), 6) FROM l UNION ALL SELECT 2, round(corr(revenue, q2), 6) FROM l",
)
def cross_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("entity").orderBy("period")
    led = panel(spark, sf_dir).select("revenue", *(F.lead("qty", k).over(w).alias(f"q{k}") for k in range(3)))
    sums = led.agg(*(stats.correlation(F.col("revenue"), F.col(f"q{k}")).alias(f"r{k}") for k in range(3)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("lead"), r(f"r{k}").alias("r")) for k in range(3)))).alias("e")).select("e.*")


@query(
    "K16_two_sample_distance",
    "WITH k AS (SELECT o_totalprice AS v, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders), c AS (SELECT v, sum(sum(y)) OVER (ORDER BY v) AS a, sum(sum(1 - y)) OVER (ORDER BY v) AS b FROM k GROUP BY v) SELECT round(max(abs(a / (SELECT sum(y) FROM k) - b / (SELECT sum(1 - y) FROM k))), 9) AS d FROM c",
)
def two_sample_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of two samples, over counts of distinct values."""
    k = table(spark, sf_dir, "orders").selectExpr("o_totalprice AS v", "CAST(o_orderstatus = 'F' AS INT) AS y")
    c = k.groupBy("v").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    total = c.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))  # one row
    c = running(c, "v", {"ua": "a", "ub": "b"}).crossJoin(F.broadcast(total))
    d = F.abs((F.col("ua") + F.col("a")) / F.col("na") - (F.col("ub") + F.col("b")) / F.col("nb"))
    return c.agg(r(F.max(d), 9).alias("d"))


@query(
    "K17_contingency",
    """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT a, b, coalesce(n, 0) AS n FROM (SELECT DISTINCT a FROM c) CROSS JOIN (SELECT DISTINCT b FROM c) LEFT JOIN c USING (a, b)),
e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e FROM g) SELECT round(sum((n - e) * (n - e) / e), 6) AS chi2, (SELECT (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) FROM c) AS df FROM e""",
)
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-square of two labels: sum n^2 / e less the total, over the cells that occur."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = c.agg(F.sum("n").alias("all"))  # one row
    by = lambda k: F.sum("n").over(Window.partitionBy(k))
    cells = c.crossJoin(F.broadcast(total)).select("a", "b", "n", (by("a") * by("b") / F.col("all")).alias("e"))
    chi2 = F.sum(F.col("n") * F.col("n") / F.col("e")) - F.sum("n")
    return cells.agg(r(chi2).alias("chi2"), ((F.count_distinct("a") - 1) * (F.count_distinct("b") - 1)).alias("df"))


@query(
    "K27_signed_rank",
    f"""WITH {PANEL}, d AS (SELECT revenue - lag(revenue) OVER (PARTITION BY entity ORDER BY period) AS d FROM panel), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0),
s AS (SELECT count(*) AS n, sum(r) FILTER (d > 0) AS w FROM k) SELECT n, round(w, 3) AS w, round((w - n * (n + 1) / 4.0) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24), 6) AS z FROM s""",
)
def signed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilcoxon's signed ranks from counts of distinct distances; zeros are dropped."""
    d = windows.difference(F.col("revenue"), Window.partitionBy("entity").orderBy("period"))
    rows = panel(spark, sf_dir).select(d.alias("d")).where("d <> 0")
    c = rows.groupBy(F.abs("d").alias("v")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("p"))
    c = running(c, "v", {"below": "t"}).withColumn("rank", F.col("below") + (F.col("t") + 1) / 2.0)
    s = c.agg(F.sum("t").alias("n"), F.sum(F.col("p") * F.col("rank")).alias("w"))
    n = F.col("n").cast("double")
    z = (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return s.select("n", r("w", 3).alias("w"), r(F.when(F.col("n") >= 6, z)).alias("z"))


@query(
    "L13_leakage",
    f"""WITH {PANEL}, k AS (SELECT rank() OVER (ORDER BY revenue) + (count(*) OVER (PARTITION BY revenue) - 1) / 2.0 AS t, rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2.0 AS q, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS n FROM panel)
SELECT 'qty' AS feature, round(corr(q, t), 6) AS r, abs(corr(q, t)) >= 0.9 AS flagged FROM k UNION ALL SELECT 'n', round(corr(n, t), 6), abs(corr(n, t)) >= 0.9 FROM k""",
)
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features whose rank correlation with the target is suspiciously high."""
    p, out = panel(spark, sf_dir).select("qty", "n", "revenue").persist(), None  # each rank reads it
    for c in ("qty", "n"):
        one = stats.spearman(p, c, "revenue").select(F.lit(c).alias("feature"), r("r").alias("r"), (F.abs("r") >= 0.9).alias("flagged"))
        out = one if out is None else out.union(one)
    return out


@query(
    "Q2_Q6_decay",
    "WITH " + PANEL + """, o AS (SELECT entity, period, qty, lead(revenue, 1) OVER w AS f1, lead(revenue, 2) OVER w AS f2 FROM panel WINDOW w AS (PARTITION BY entity ORDER BY period)),
h AS (SELECT 1 AS horizon, period, qty, f1 AS f FROM o WHERE f1 IS NOT NULL UNION ALL SELECT 2, period, qty, f2 FROM o WHERE f2 IS NOT NULL),
k AS (SELECT horizon, period, rank() OVER (PARTITION BY horizon, period ORDER BY qty) + (count(*) OVER (PARTITION BY horizon, period, qty) - 1) / 2.0 AS a, rank() OVER (PARTITION BY horizon, period ORDER BY f) + (count(*) OVER (PARTITION BY horizon, period, f) - 1) / 2.0 AS b FROM h),
i AS (SELECT horizon, period, corr(a, b) AS ic FROM k GROUP BY 1, 2 HAVING count(*) >= 10) SELECT horizon, count(*) AS periods, round(avg(ic), 6) AS mean_ic FROM i GROUP BY 1""",
)
def decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, w, out = panel(spark, sf_dir), Window.partitionBy("entity").orderBy("period"), None
    for h in (1, 2):
        obs = p.select(F.col("entity").alias("id"), "period", F.col("qty").alias("factor"), F.lead("revenue", h).over(w).alias("forward"))
        one = factors.information_coefficient(obs).select(F.lit(h).alias("horizon"), "periods", r("mean_ic").alias("mean_ic"))
        out = one if out is None else out.union(one)
    return out


@query(
    "T4_differentials",
    f"WITH {PANEL}, t AS (SELECT entity, round(sum(revenue), 4) AS projected, sum(n) / (SELECT sum(n) FROM panel) * 100 AS own FROM panel GROUP BY 1) SELECT entity, round(projected / greatest(own, 0.1), 4) AS edge FROM t ORDER BY projected / greatest(own, 0.1) DESC, entity LIMIT 20",
)
def differentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = panel(spark, sf_dir).groupBy("entity").agg(r(F.sum("revenue"), 4).alias("projected"), F.sum("n").alias("n"))
    total = t.agg(F.sum("n").alias("all"))  # one row
    own = F.col("n") / F.col("all") * 100
    ranked = t.crossJoin(F.broadcast(total)).select("entity", (F.col("projected") / F.greatest(own, F.lit(0.1))).alias("edge")).orderBy(F.desc("edge"), "entity").limit(20)
    return ranked.select("entity", r("edge", 4).alias("edge"))
