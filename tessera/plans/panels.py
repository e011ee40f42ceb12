"""Formula functions, windows and frames over the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions import missing as M
from tessera.operators import frames, windows
from tessera.plans.tables import PANEL, panel, query, r, table

def by() -> WindowSpec:
    """A supplier's months in order."""
    return Window.partitionBy("entity").orderBy("period")


WINDOW = "WINDOW w AS (PARTITION BY entity ORDER BY period)"

FLAGSHIP = f"""WITH {PANEL}, derived AS (SELECT entity, period, revenue, qty,
 CASE WHEN row_number() OVER w >= 3 THEN avg(revenue) OVER (PARTITION BY entity ORDER BY period ROWS 2 PRECEDING) END AS form,
 revenue / nullif(lag(revenue) OVER w, 0) AS trend FROM panel {WINDOW})
SELECT entity, period, revenue, round(form, 6) AS form, round(trend, 6) AS trend FROM derived
 WHERE qty >= 10 AND coalesce(form > 0, true) AND coalesce(trend > 1, true) ORDER BY form DESC NULLS LAST, entity, period LIMIT 20"""


@query("flagship_form", FLAGSHIP)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' best three-month form while revenue rises."""
    rows = panel(spark, sf_dir).withColumns(
        {"form": windows.rolling(F.col("revenue"), by(), 3, "mean"), "trend": M.divide(F.col("revenue"), F.lag("revenue").over(by()))}
    )
    rising = M.both(M.truth(F.col("form") > 0), M.truth(F.col("trend") > 1))
    rows = rows.where((F.col("qty") >= 10) & M.holds(rising))
    best = rows.orderBy(F.col("form").desc_nulls_last(), "entity", "period").limit(20)
    return best.select("entity", "period", "revenue", r("form").alias("form"), r("trend").alias("trend"))


@query(
    "E1_E17_scalars",
    f"""WITH {PANEL}, x AS (SELECT entity, period, revenue AS a, CASE WHEN n % 3 <> 0 THEN qty END AS b, CAST(n % 4 AS DOUBLE) AS z FROM panel)
SELECT entity, period, round(a + b, 6) AS add, round(a - b, 6) AS sub, round(a * b, 4) AS mul, round(a / nullif(z, 0), 6) AS div, round(a % nullif(z, 0), 4) AS rem,
 round(pow(z, 2), 6) AS pow, CAST(a > b AS DOUBLE) AS gt, CAST(z == 1 AS DOUBLE) AS eq,
 CAST(coalesce(b <> 0, true) AND coalesce(z <> 0, true) AS DOUBLE) AS both, CAST(coalesce(b > 100, true) OR z <> 0 AS DOUBLE) AS either, CAST(z = 0 AS DOUBLE) AS neg,
 CASE WHEN b > 50 THEN a WHEN b <= 50 THEN z END AS chosen, round(CASE WHEN z > 0 THEN ln(z) END, 9) AS ln, round(CASE WHEN a > 0 THEN ln(a) / ln(10) END, 9) AS log,
 round(CASE WHEN z - 1 >= 0 THEN sqrt(z - 1) END, 9) AS sqrt, floor(-(z + 0.5) + 0.5) AS up, floor((a / 7) * 100 + 0.5) / 100 AS up2, least(a, b, z) AS low, greatest(a, b, z) AS high,
 least(greatest(z, 1), 2) AS clamped, coalesce(b, z) AS some, CAST(b IS NULL AS DOUBLE) AS missing, round(CASE WHEN z > 0 THEN a * 90 / z END, 4) AS per90,
 round(CASE WHEN z > 0 THEN a * 90 / z ELSE 0 END, 4) AS per90_zero, abs(-z) AS abs, sign(z - 2) AS sign FROM x""",
)
def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = panel(spark, sf_dir).select(
        "entity", "period", F.col("revenue").alias("a"), F.when(F.col("n") % 3 != 0, F.col("qty")).alias("b"), (F.col("n") % 4).cast("double").alias("z")
    )
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    return x.select(
        "entity", "period", r(a + b).alias("add"), r(a - b).alias("sub"), r(a * b, 4).alias("mul"), r(M.divide(a, z)).alias("div"), r(M.modulo(a, z), 4).alias("rem"),
        r(M.power(z, F.lit(2))).alias("pow"), M.truth(a > b).alias("gt"), M.truth(z == 1).alias("eq"), M.both(b, z).alias("both"),
        M.either(M.truth(b > 100), z).alias("either"), M.negate(z).alias("neg"), M.choose(M.truth(b > 50), a, z).alias("chosen"), r(M.ln(z), 9).alias("ln"),
        r(M.log(a), 9).alias("log"), r(M.sqrt(z - 1), 9).alias("sqrt"), M.round_up(-(z + 0.5)).alias("up"), M.round_up(a / 7, 2).alias("up2"),
        F.least(a, b, z).alias("low"), F.greatest(a, b, z).alias("high"), M.clamp(z, 1, 2).alias("clamped"), F.coalesce(b, z).alias("some"),
        M.truth(b.isNull()).alias("missing"), r(M.per90(a, z), 4).alias("per90"), r(M.per90(a, z, "zero"), 4).alias("per90_zero"), F.abs(-z).alias("abs"), F.signum(z - 2).alias("sign"),
    )


@query(
    "E18_E21_cross_section",
    f"""WITH {PANEL}, k AS (SELECT *, count(*) OVER p AS m, row_number() OVER (PARTITION BY period ORDER BY revenue, entity) AS place FROM panel WINDOW p AS (PARTITION BY period))
SELECT entity, period, round((revenue - avg(revenue) OVER p) / nullif(stddev_samp(revenue) OVER p, 0), 6) AS z, place,
 round(CASE WHEN m > 1 THEN (place - 1) / (m - 1) ELSE 0.5 END, 9) AS share, round(quantile_cont(revenue, 0.9) OVER p, 6) AS q90 FROM k WINDOW p AS (PARTITION BY period)""",
)
def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = Window.partitionBy("period"), F.col("revenue")
    return panel(spark, sf_dir).select(
        "entity", "period", r(windows.zscore(c, p)).alias("z"), windows.ordinal(c, ["period"], ["entity"]).cast("long").alias("place"),
        r(windows.share_rank(c, ["period"], ["entity"]), 9).alias("share"), r(F.percentile(c, F.lit(0.9)).over(p), 6).alias("q90"),
    )


@query(
    "E22_E25_W1_W6_windows",
    f"""WITH {PANEL}, x AS (SELECT entity, period, CASE WHEN n % 5 <> 0 THEN revenue END AS c FROM panel)
SELECT entity, period, lag(c) OVER w AS lag1, lead(c, 2) OVER w AS lead2, round(c - lag(c) OVER w, 6) AS diff,
 round(CASE WHEN row_number() OVER w >= 3 THEN avg(c) OVER f END, 6) AS mean3, round(CASE WHEN row_number() OVER w >= 3 THEN sum(c) OVER f END, 6) AS sum3,
 CASE WHEN row_number() OVER w >= 3 THEN max(c) OVER f END AS max3, round(CASE WHEN count(c) OVER f >= 2 THEN avg(c) OVER f END, 6) AS mean3_two,
 round(CASE WHEN count(c) OVER f >= 2 THEN stddev_samp(c) OVER f END, 3) AS sd3, round(sum(c) OVER (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING), 6) AS total,
 round(c - max(c) OVER (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING), 6) AS down,
 round(CASE WHEN count(c) OVER g = 2 THEN sum(c) OVER g END, 6) AS ahead_strict, round(CASE WHEN count(*) OVER g = 2 THEN coalesce(sum(c) OVER g, 0) END, 6) AS ahead_lenient
 FROM x WINDOW w AS (PARTITION BY entity ORDER BY period), f AS (PARTITION BY entity ORDER BY period ROWS 2 PRECEDING), g AS (PARTITION BY entity ORDER BY period ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)""",
)
def series_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    x = panel(spark, sf_dir).select("entity", "period", F.when(F.col("n") % 5 != 0, F.col("revenue")).alias("c"))
    return x.select(
        "entity", "period", F.lag(c).over(by()).alias("lag1"), F.lead(c, 2).over(by()).alias("lead2"), r(windows.difference(c, by()), 6).alias("diff"),
        *(r(windows.rolling(c, by(), 3, how), 6).alias(f"{how}3") for how in ("mean", "sum", "max")), r(windows.rolling(c, by(), 3, "mean", 2), 6).alias("mean3_two"),
        r(windows.rolling(c, by(), 3, "sd", 2), 3).alias("sd3"), r(windows.running_total(c, by()), 6).alias("total"), r(windows.drawdown(c, by()), 6).alias("down"),
        r(windows.forward_strict(c, by(), 2), 6).alias("ahead_strict"), r(windows.forward_lenient(c, by(), 2), 6).alias("ahead_lenient"),
    )


@query(
    "E24_ewma",
    f"""WITH RECURSIVE {PANEL}, x AS (SELECT entity, period, CASE WHEN n % 5 <> 0 THEN revenue END AS c, row_number() OVER (PARTITION BY entity ORDER BY period) AS i FROM panel),
e AS (SELECT entity, period, i, c AS s FROM x WHERE i = 1 UNION ALL
 SELECT x.entity, x.period, x.i, CASE WHEN x.c IS NULL THEN e.s WHEN e.s IS NULL THEN x.c ELSE e.s + (1 - exp(-ln(2.0) / 3)) * (x.c - e.s) END FROM e JOIN x ON x.entity = e.entity AND x.i = e.i + 1)
SELECT entity, period, round(s, 4) AS smooth FROM e""",
)
def ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = panel(spark, sf_dir).select("entity", "period", F.when(F.col("n") % 5 != 0, F.col("revenue")).alias("c"))
    return windows.smoothed(x, "c", "s", ["entity"], ["period"], 3.0).select("entity", "period", r("s", 4).alias("smooth"))


@query(
    "W7_half_life",
    f"""WITH {PANEL}, x AS (SELECT entity, revenue AS y, lag(revenue) OVER (PARTITION BY entity ORDER BY period) AS b FROM panel), s AS (SELECT entity, regr_slope(y, b) AS phi FROM x WHERE b IS NOT NULL GROUP BY 1)
SELECT entity, round(phi, 6) AS phi, CASE WHEN phi > 0 AND phi < 1 THEN round(-ln(2.0) / ln(phi), 5) END AS half_life FROM s""",
)
def half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.half_life(panel(spark, sf_dir), "revenue", ["entity"], ["period"])
    return found.select("entity", r("phi").alias("phi"), F.when(F.col("half_life") < float("inf"), r("half_life", 5)).alias("half_life"))


@query(
    "W8_seasonality",
    f"""WITH {PANEL}, x AS (SELECT entity, (row_number() OVER (PARTITION BY entity ORDER BY period) - 1) % 12 AS phase, revenue, avg(revenue) OVER (PARTITION BY entity) AS m FROM panel)
SELECT entity, CAST(phase AS INTEGER) AS phase, round(avg(revenue), 3) AS mean, round(avg(revenue) - any_value(m), 3) AS effect FROM x GROUP BY 1, 2""",
)
def seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.seasonality(panel(spark, sf_dir), "revenue", ["entity"], ["period"], 12)
    return found.select("entity", F.col("phase").cast("int"), r("mean", 3).alias("mean"), r("effect", 3).alias("effect"))


@query(
    "K11_K13_autocorrelation",
    f"""WITH {PANEL}, d AS (SELECT entity, period, revenue - avg(revenue) OVER (PARTITION BY entity) AS d FROM panel), l AS (SELECT entity, d, lag(d, 1) OVER w AS l1, lag(d, 2) OVER w AS l2 FROM d WINDOW w AS (PARTITION BY entity ORDER BY period))
SELECT entity, 1 AS lag, round(sum(d * l1) / sum(d * d), 6) AS acf, count(l1) AS pairs FROM l GROUP BY 1 UNION ALL SELECT entity, 2, round(sum(d * l2) / sum(d * d), 6), count(l2) FROM l GROUP BY 1""",
)
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.autocorrelation(panel(spark, sf_dir), "revenue", ["entity"], ["period"], 2).withColumn("acf", r("acf"))


@query(
    "W16_tied_awards",
    f"WITH {PANEL}, k AS (SELECT entity, period, n, rank() OVER (PARTITION BY period ORDER BY n DESC) AS k FROM panel) SELECT entity, period, CASE k WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS award FROM k",
)
def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("entity", "period", windows.tied_awards(F.col("n"), ["period"]).alias("award"))


@query(
    "W14_point_in_time",
    f"""WITH {PANEL} SELECT entity, period, round(avg(revenue) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS mean3, round(avg(revenue) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 6) AS mean6,
 lag(revenue) OVER w AS last, row_number() OVER w - 1 AS history, period - lag(period) OVER w AS gap FROM panel {WINDOW}""",
)
def point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each row that read earlier rows alone."""
    earlier = {k: F.avg("revenue").over(by().rowsBetween(-k, -1)) for k in (3, 6)}
    return panel(spark, sf_dir).select(
        "entity", "period", *(r(v, 6).alias(f"mean{k}") for k, v in earlier.items()), F.lag("revenue").over(by()).alias("last"),
        (F.row_number().over(by()) - 1).cast("long").alias("history"), (F.col("period") - F.lag("period").over(by())).alias("gap"),
    )


@query(
    "F10_A1_group",
    f"WITH {PANEL} SELECT season, round(avg(revenue), 6) AS mean, round(quantile_cont(revenue, 0.5), 6) AS median, round(sum(revenue), 4) AS total, round(quantile_cont(revenue, 0.9), 6) AS p90, round(stddev_samp(revenue), 4) AS sd, max(revenue) AS top, count(*) AS count FROM panel GROUP BY 1",
)
def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [("revenue", h, n) for h, n in (("mean", "mean"), ("median", "median"), ("sum", "total"), ("p90", "p90"), ("sd", "sd"), ("max", "top"))]
    g = frames.group(panel(spark, sf_dir), ["season"], wanted)
    return g.select("season", r("mean", 6).alias("mean"), r("median", 6).alias("median"), r("total", 4).alias("total"), r("p90", 6).alias("p90"), r("sd", 4).alias("sd"), "top", "count")


@query(
    "F13_A2_pivot",
    "SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS F, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS O FROM lineitem GROUP BY 1",
)
def pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frames.pivot(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", "mean", ["F", "O"])
    return p.select("l_returnflag", r("F").alias("F"), r("O").alias("O"))


@query("F7_F8_T1_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 10")
def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return frames.page(orders, [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")], 10, 50)


@query("F9_distinct", "SELECT DISTINCT event_type FROM events")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type")


@query("F14_summary", "SELECT count(value) AS count, count(*) - count(value) AS missing FROM events")
def summarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.summary(table(spark, sf_dir, "events"), "value")


@query(
    "F16_strided",
    "WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, CAST(ceil(count(*) OVER () / 1000) AS BIGINT) AS k FROM orders) SELECT o_orderkey FROM k WHERE i % k = 0",
)
def strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.strided(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1000)


@query(
    "T8_top_per_group",
    f"WITH {PANEL}, k AS (SELECT season, entity, period, revenue, row_number() OVER (PARTITION BY season ORDER BY revenue DESC, entity, period) AS place FROM panel) SELECT * FROM k WHERE place <= 3",
)
def best_of_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir).select("season", "entity", "period", "revenue")
    return frames.top_per_group(rows, ["season"], [F.desc("revenue"), F.col("entity"), F.col("period")], 3)


@query(
    "A3_A4_coverage",
    f"WITH {PANEL} SELECT season, period, count(*) AS rows, count(DISTINCT entity) AS entities, count(CASE WHEN n % 5 <> 0 THEN revenue END) AS measured FROM panel GROUP BY 1, 2",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = F.when(F.col("n") % 5 != 0, F.col("revenue"))
    return panel(spark, sf_dir).groupBy("season", "period").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("entity").alias("entities"), F.count(measured).alias("measured"))


@query(
    "A5_surface",
    f"""WITH {PANEL}, e AS (SELECT min(revenue) AS x0, max(revenue) AS x1, min(qty) AS y0, max(qty) AS y1 FROM panel),
b AS (SELECT least(7, CAST(floor((revenue - x0) / ((x1 - x0) / 8.0)) AS BIGINT)) AS x_bin, least(7, CAST(floor((qty - y0) / ((y1 - y0) / 8.0)) AS BIGINT)) AS y_bin, n FROM panel, e),
f AS (SELECT x_bin, y_bin, avg(n) AS value, count(*) AS count FROM b GROUP BY 1, 2)
SELECT x_bin, y_bin, round(value, 6) AS value, coalesce(count, 0) AS count FROM (SELECT unnest(range(8)) AS x_bin) CROSS JOIN (SELECT unnest(range(8)) AS y_bin) LEFT JOIN f USING (x_bin, y_bin)""",
)
def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.surface(panel(spark, sf_dir), "revenue", "qty", "n", 8).withColumn("value", r("value"))


@query(
    "A7_best_season",
    f"""WITH {PANEL}, s AS (SELECT entity, season, round(sum(revenue), 4) AS v FROM panel GROUP BY 1, 2)
SELECT entity, round(sum(v), 4) AS total, count(*) AS seasons, arg_max(season, struct_pack(v := v, s := -season)) AS best FROM s GROUP BY 1""",
)
def best_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = panel(spark, sf_dir).groupBy("entity", "season").agg(r(F.sum("revenue"), 4).alias("v"))
    return s.groupBy("entity").agg(r(F.sum("v"), 4).alias("total"), F.count(F.lit(1)).alias("seasons"), F.max_by("season", F.struct("v", -F.col("season"))).alias("best"))


@query(
    "A25_modal",
    "WITH c AS (SELECT user_id, event_type, count(*) AS n, max(ts) AS l FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, l DESC, event_type DESC) AS k FROM c) SELECT user_id, event_type, n FROM k WHERE k = 1",
)
def modal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.modal(table(spark, sf_dir, "events"), ["user_id"], "event_type", "ts")
