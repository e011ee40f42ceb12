"""Joins, set operations, domain rules and records of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import domain as D
from tessera.operators import frames, joins, sets
from tessera.plans.tables import MATCHES, PANEL, TEAM_MATCHES, matches, panel, query, r, seconds, table, team_matches
from tessera.sources.files import quotes_long


@query(
    "J1_J4_F12_dimensions",
    "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey",
)
def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, g = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    found = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(g, n["n_regionkey"] == g["r_regionkey"], "left")
    return found.select("s_suppkey", "n_name", "r_name")


@query(
    "J5_folded_name",
    "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON regexp_replace(lower(replace(c_name, 'Customer', 'S')), '[^a-z0-9]', '', 'g') = regexp_replace(lower(replace(s_name, 'Supplier', 's-')), '[^a-z0-9]', '', 'g')",
)
def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", D.fold_name(F.replace("c_name", F.lit("Customer"), F.lit("S"))).alias("k"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", D.fold_name(F.replace("s_name", F.lit("Supplier"), F.lit("s-"))).alias("k"))
    return c.join(s, "k").select("c_custkey", "s_suppkey")


@query("J21_J25_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("J24_U6_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(placed, "c_custkey", "left_anti")


def _errors_purchases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", seconds("ts").alias("at"), "value", "event_type")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "at")
    return left, e.where("event_type = 'purchase'").select("user_id", "at", F.col("event_id").alias("purchase"), "value")


@query(
    "J12_as_of",
    """SELECT e.event_id, p.event_id AS purchase, p.value FROM (SELECT * FROM events WHERE event_type = 'error') e
 LEFT JOIN LATERAL (SELECT event_id, value FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts < e.ts ORDER BY p.ts DESC, p.event_id DESC LIMIT 1) p ON true""",
)
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _errors_purchases(spark, sf_dir)
    return joins.latest_before(left, right, ["user_id"], "at", ["purchase", "value"], 7 * 86_400.0).select("event_id", "purchase", "value")


@query(
    "J18_nearest",
    """WITH g AS (SELECT e.event_id, p.event_id AS purchase, abs(epoch_us(p.ts) - epoch_us(e.ts)) AS gap FROM events e JOIN events p ON p.user_id = e.user_id AND e.event_type = 'error' AND p.event_type = 'purchase' AND abs(epoch_us(p.ts) - epoch_us(e.ts)) <= 86400000000),
k AS (SELECT *, count(*) OVER (PARTITION BY event_id, gap) AS n, row_number() OVER (PARTITION BY event_id ORDER BY gap) AS i FROM g)
SELECT e.event_id, CASE WHEN n = 1 THEN purchase END AS purchase_near FROM (SELECT event_id FROM events WHERE event_type = 'error') e LEFT JOIN (SELECT * FROM k WHERE i = 1) k USING (event_id)""",
)
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _errors_purchases(spark, sf_dir)
    return joins.nearest(left, right, ["user_id"], "at", ["purchase"], ["event_id"], 86_400.0).select("event_id", "purchase_near")


@query(
    "J10_J11_J16_covering",
    """WITH s AS (SELECT user_id, event_id AS spell, epoch_us(ts) / 1000000.0 AS f, lead(epoch_us(ts) / 1000000.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events WHERE event_type = 'signup'),
p AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0 AS x FROM events WHERE event_type = 'purchase')
SELECT event_id, spell FROM p LEFT JOIN s ON s.user_id = p.user_id AND x >= f AND (t IS NULL OR x < t)""",
)
def covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", seconds("ts").alias("at"))
    spells = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("spell"), F.col("at").alias("start"))
    spells = spells.withColumn("end", F.lead("start").over(Window.partitionBy("user_id").orderBy("start", "spell")))
    points = e.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    return joins.covering(points, spells, ["user_id"], "at", "start", "end", ["spell"], ["event_id"], 7 * 86_400.0).select("event_id", "spell")


@query(
    "J13_J14_recent",
    """SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS last5,
 count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 1209600 PRECEDING AND 1 PRECEDING) AS fortnight FROM events""",
)
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("sec", F.floor(seconds("ts")).cast("long"))
    last5 = F.avg("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, -1))
    return e.select("event_id", r(last5).alias("last5"), joins.count_before(e, ["user_id"], "sec", 14 * 86_400).alias("fortnight"))


@query(
    "J19_cascade",
    """WITH p AS (SELECT p_partkey, p_name, p_brand || p_type AS bt FROM part), w AS (SELECT p_partkey AS k, p_name AS n1, p_brand || p_type AS n2 FROM part WHERE p_partkey % 2 = 0),
a AS (SELECT n1, min(k) AS m FROM w GROUP BY 1 HAVING count(DISTINCT k) = 1), b AS (SELECT n2, min(k) AS m FROM w GROUP BY 1 HAVING count(DISTINCT k) = 1)
SELECT p_partkey, coalesce(a.m, b.m) AS matched FROM p LEFT JOIN a ON n1 = p_name LEFT JOIN b ON n2 = bt""",
)
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat("p_brand", "p_type").alias("bt"))
    known = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n1"), F.col("bt").alias("n2"))
    return joins.unambiguous(p, known, [("p_name", "n1"), ("bt", "n2")], "k", "matched").select("p_partkey", "matched")


PLACES = "(c_custkey * 7919 % 1201) / 100.0 + 45 AS lat, (c_custkey * 104729 % 3607) / 100.0 - 18 AS lon"


@query(
    "J23_N10_near_places",
    f"""WITH c AS (SELECT c_custkey, {PLACES} FROM customer), s AS (SELECT c_custkey AS ground, lat, lon FROM c WHERE c_custkey % 10 = 0),
p AS (SELECT c_custkey, ground, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2)))) AS m FROM c, s)
SELECT c_custkey, ground, round(m, 3) AS metres FROM p WHERE m <= 150000 AND c_custkey <> ground""",
)
def near_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", *PLACES.replace("100.0", "100.0D").split(", "))  # the SQL divides as doubles
    grounds = c.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("ground"), "lat", "lon")
    near = joins.near_places(c, grounds, "lat", "lon", 150_000.0, D.distance_metres).where("c_custkey <> ground")
    return near.select("c_custkey", "ground", (F.floor(F.col("metres") * 1000 + 0.5) / 1000).alias("metres"))  # as DuckDB rounds; F.round goes by decimals


@query(
    "J29_consecutive",
    f"WITH {PANEL}, l AS (SELECT entity, period, revenue, lead(revenue) OVER w AS n, lead(period) OVER w AS p FROM panel WINDOW w AS (PARTITION BY entity ORDER BY period)) SELECT entity, period, CASE WHEN p = period + 1 THEN round(n - revenue, 4) END AS change FROM l",
)
def consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("entity").orderBy("period")
    follows = F.lead("period").over(by) == F.col("period") + 1
    return panel(spark, sf_dir).select("entity", "period", r(F.when(follows, F.lead("revenue").over(by) - F.col("revenue")), 4).alias("change"))


@query(
    "J28_N15_scorelines",
    f"""WITH {MATCHES}, m AS (SELECT avg(home_goals) AS h, avg(away_goals) AS a FROM matches), g AS (SELECT unnest(range(16)) AS k)
SELECT x.k AS home, y.k AS away, round(exp(-h) * pow(h, x.k) / factorial(CAST(x.k AS INTEGER)) * exp(-a) * pow(a, y.k) / factorial(CAST(y.k AS INTEGER)), 9) AS p FROM m, g x, g y""",
)
def scorelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scoreline's probability under the mean goals of both sides."""
    rates = matches(spark, sf_dir).agg(F.avg("home_goals").alias("h"), F.avg("away_goals").alias("a"))
    upto = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long")))
    grid = rates.withColumn("home", upto).withColumn("away", upto)
    return grid.select("home", "away", r(D.poisson(F.col("home"), F.col("h")) * D.poisson(F.col("away"), F.col("a")), 9).alias("p"))


@query(
    "S22_N14_N40_odds",
    """WITH q AS (SELECT p_partkey, unnest(['H', 'D', 'A']) AS selection, unnest([1 + p_size / 20.0, 3.4, CASE WHEN p_size % 7 = 0 THEN 1.0 ELSE 1 + 30.0 / p_size END]) AS decimal FROM part),
p AS (SELECT p_partkey, selection, 1 / decimal AS i FROM q WHERE decimal > 1), s AS (SELECT p_partkey, sum(i) AS book, count(*) AS n FROM p GROUP BY 1)
SELECT p_partkey, round(book - 1, 6) AS margin, round(max(i / book) FILTER (selection = 'H' AND n = 3), 6) AS home, round(max(i / book) FILTER (selection = 'A' AND n = 3), 6) AS away FROM p JOIN s USING (p_partkey) GROUP BY p_partkey, book""",
)
def odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "part").selectExpr("p_partkey", "1 + p_size / 20.0D AS H", "3.4D AS D", "CASE WHEN p_size % 7 = 0 THEN 1.0D ELSE 1 + 30.0D / p_size END AS A")
    long = quotes_long(wide, ["p_partkey"], {c: ("book", "1x2", c) for c in "HDA"}).withColumn("i", D.implied(F.col("decimal")))
    book = F.sum("i")
    def share(s: str):
        return F.when(F.count(F.lit(1)) == 3, F.max(F.when(F.col("selection") == s, F.col("i"))) / book)

    return long.groupBy("p_partkey").agg(r(book - 1).alias("margin"), r(share("H")).alias("home"), r(share("A")).alias("away"))


@query(
    "N_domain_scalars",
    """SELECT o_orderkey, CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) || '/' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') ELSE (year(o_orderdate) - 1) || '/' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') END AS season,
 CASE WHEN x < 100 / 3.0 THEN 0 WHEN x < 200 / 3.0 THEN 1 ELSE 2 END AS third, least(4, CAST(floor(x / 20) AS INTEGER)) AS channel, least(11, CAST(floor(x / 100 * 12) AS INTEGER)) AS cell,
 CASE WHEN k > 50 THEN 50 + floor((k - 50) / 2) ELSE k END AS sells, k / 10.0 AS money FROM (SELECT o_orderkey, o_orderdate, CAST(o_orderkey % 101 AS DOUBLE) AS x, CAST(o_orderkey % 97 AS INTEGER) AS k FROM orders)""",
)
def domain_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderdate", "CAST(o_orderkey % 101 AS DOUBLE) AS x", "CAST(o_orderkey % 97 AS INT) AS k")
    x, k = F.col("x"), F.col("k")
    return o.select(
        "o_orderkey", D.season_of(F.col("o_orderdate")).alias("season"), D.third(x).alias("third"), D.channel(x).alias("channel"), D.grid_cell(x, 100, 12).alias("cell"),
        D.selling_price(F.lit(50), k).cast("double").alias("sells"), D.money(k).alias("money"),
    )


@query(
    "A9_head_to_head",
    f"WITH {MATCHES} SELECT least(home, away) AS first, greatest(home, away) AS second, count(*) AS played, count(*) FILTER (CASE WHEN home < away THEN home_goals - away_goals ELSE away_goals - home_goals END > 0) AS won, count(*) FILTER (home_goals = away_goals) AS drawn, CAST(sum(CASE WHEN home < away THEN home_goals ELSE away_goals END) AS BIGINT) AS scored FROM matches GROUP BY 1, 2",
)
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    ours = F.col("home") < F.col("away")
    scored, conceded = F.when(ours, F.col("home_goals")).otherwise(F.col("away_goals")), F.when(ours, F.col("away_goals")).otherwise(F.col("home_goals"))
    return m.groupBy(F.least("home", "away").alias("first"), F.greatest("home", "away").alias("second")).agg(
        F.count(F.lit(1)).alias("played"), F.count_if(scored > conceded).alias("won"), F.count_if(scored == conceded).alias("drawn"), F.sum(scored).alias("scored")
    )


@query(
    "A11_T9_league",
    f"WITH {TEAM_MATCHES} SELECT team, count(*) AS played, CAST(sum(CASE WHEN scored > conceded THEN 3 WHEN scored = conceded THEN 1 ELSE 0 END) AS BIGINT) AS points, CAST(sum(scored - conceded) AS BIGINT) AS difference FROM team_matches GROUP BY 1",
)
def league(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = team_matches(spark, sf_dir)
    points = F.when(F.col("scored") > F.col("conceded"), 3).when(F.col("scored") == F.col("conceded"), 1).otherwise(0)
    out = t.groupBy("team").agg(F.count(F.lit(1)).alias("played"), F.sum(points).alias("points"), F.sum(F.col("scored") - F.col("conceded")).alias("difference"))
    return out.orderBy(F.desc("points"), F.desc("difference"), "team")


@query(
    "A12_A13_form",
    f"""WITH {TEAM_MATCHES}, k AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY kickoff DESC, match DESC) AS i FROM team_matches)
SELECT team, string_agg(CASE WHEN scored > conceded THEN 'W' WHEN scored = conceded THEN 'D' ELSE 'L' END, '' ORDER BY i) AS form, round(avg(scored), 6) AS per_match FROM k WHERE i <= 5 GROUP BY 1""",
)
def form(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = frames.top_per_group(team_matches(spark, sf_dir), ["team"], [F.desc("kickoff"), F.desc("match")], 5)
    result = F.when(F.col("scored") > F.col("conceded"), "W").when(F.col("scored") == F.col("conceded"), "D").otherwise("L")
    five = F.array_sort(F.collect_list(F.struct("place", result.alias("r"))))
    return last.groupBy("team").agg(F.array_join(F.transform(five, lambda e: e["r"]), "").alias("form"), r(F.avg("scored")).alias("per_match"))


@query(
    "A6_season_archive",
    f"WITH {MATCHES} SELECT CAST(year(kickoff) AS INTEGER) AS season, count(*) AS played, round(avg(home_goals + away_goals), 6) AS goals, round(avg(CAST(home_goals > away_goals AS INTEGER)), 6) AS home_share, round(avg(CAST(home_goals = away_goals AS INTEGER)), 6) AS draw_share FROM matches GROUP BY 1",
)
def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    share = {"home_share": F.col("home_goals") > F.col("away_goals"), "draw_share": F.col("home_goals") == F.col("away_goals")}
    return m.groupBy(F.year("kickoff").alias("season")).agg(
        F.count(F.lit(1)).alias("played"), r(F.avg(F.col("home_goals") + F.col("away_goals"))).alias("goals"), *(r(F.avg(c.cast("int"))).alias(k) for k, c in share.items())
    )


@query(
    "A18_strength",
    f"""WITH {TEAM_MATCHES}, w AS (SELECT *, pow(0.5, (max(year(kickoff)) OVER () - year(kickoff)) / 1.5) AS w FROM team_matches), b AS (SELECT sum(w * scored) / sum(w) AS base FROM w),
t AS (SELECT team, count(*) AS n, sum(w * scored) / sum(w) AS s, sum(w * conceded) / sum(w) AS c FROM w GROUP BY 1)
SELECT team, round((least(n, 10) * s / base + greatest(10 - n, 0)) / 10, 6) AS attack, round((least(n, 10) * c / base + greatest(10 - n, 0)) / 10, 6) AS defence FROM t, b""",
)
def strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attack and defence against the base rate: older seasons weigh less, few matches shrink to one."""
    t = team_matches(spark, sf_dir).withColumn("year", F.year("kickoff"))
    latest = t.agg(F.max("year").alias("latest"))  # one row
    t = t.crossJoin(F.broadcast(latest)).withColumn("w", F.pow(F.lit(0.5), (F.col("latest") - F.col("year")) / 1.5))
    base = t.agg((F.sum(F.col("w") * F.col("scored")) / F.sum("w")).alias("base"))
    mean = {k: F.sum(F.col("w") * F.col(c)) / F.sum("w") for k, c in (("s", "scored"), ("c", "conceded"))}
    sides = t.groupBy("team").agg(F.count(F.lit(1)).alias("n"), *(v.alias(k) for k, v in mean.items())).crossJoin(F.broadcast(base))
    n = F.col("n")
    shrunk = {k: (F.least(n, F.lit(10)) * F.col(c) / F.col("base") + F.greatest(10 - n, F.lit(0))) / 10 for k, c in (("attack", "s"), ("defence", "c"))}
    return sides.select("team", *(r(v).alias(k) for k, v in shrunk.items()))


@query("U1_union", "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment AS segment")
    return sets.union(c, table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "s_name AS name"))


STORED = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0"
RUN = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0"


def _captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))
    return o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", changed)


@query("U2_upsert", f"WITH a AS ({STORED}), b AS ({RUN}) SELECT * FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) UNION ALL SELECT * FROM b")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.upsert(*_captures(spark, sf_dir), ["o_orderkey"])


@query(
    "U3_U4_difference",
    f"""WITH a AS ({STORED}), b AS ({RUN}) SELECT o_orderkey, 'removed' AS change, NULL AS field, NULL AS old, NULL AS new FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)
 UNION ALL SELECT o_orderkey, 'added', NULL, NULL, NULL FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)
 UNION ALL SELECT o_orderkey, 'changed', 'o_orderstatus', a.o_orderstatus, b.o_orderstatus FROM a JOIN b USING (o_orderkey) WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""",
)
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.difference(*_captures(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query(
    "U8_skyline",
    "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_retailprice <= p.p_retailprice AND q.p_size >= p.p_size AND (q.p_retailprice < p.p_retailprice OR q.p_size > p.p_size))",
)
def skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    # prices as whole cents: a range window needs a step
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    return sets.skyline(parts, "cents", "p_size", ["p_brand"]).select("p_partkey")


@query(
    "U5_kept_share",
    f"""WITH {PANEL}, h AS (SELECT entity, period FROM panel WHERE n >= 8), s AS (SELECT period, count(*) AS size FROM h GROUP BY 1), x AS (SELECT a.period, count(*) AS shared FROM h a JOIN h b ON a.entity = b.entity AND b.period = a.period + 1 GROUP BY 1)
SELECT s.period, s.size, n.size AS next_size, coalesce(shared, 0) AS shared, round(1 - coalesce(shared, 0) / n.size, 6) AS turnover FROM s JOIN s n ON n.period = s.period + 1 LEFT JOIN x ON x.period = s.period""",
)
def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.kept_share(panel(spark, sf_dir).where("n >= 8"), "entity", "period").withColumn("turnover", r("turnover"))
