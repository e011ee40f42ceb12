"""Statistics, factor evaluation and models over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import factors, models, stats
from tessera.plans.tables import PANEL, panel, query, r, table


@query(
    "K1_describe",
    """SELECT l_returnflag, count(l_quantity) AS count, 0 AS missing, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS min, max(l_quantity) AS max,
 round(quantile_cont(l_quantity, 0.25), 6) AS q1, round(median(l_quantity), 6) AS median, round(quantile_cont(l_quantity, 0.95), 6) AS p95, round(skewness(l_quantity), 6) AS skewness, round(kurtosis(l_quantity), 6) AS kurtosis FROM lineitem GROUP BY 1""",
)
def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.describe(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])
    return d.select("l_returnflag", "count", "missing", *(r(c).alias(c) for c in ("mean", "sd", "min", "max", "q1", "median", "p95", "skewness", "kurtosis")))


@query(
    "K2_histogram",
    """WITH e AS (SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM orders),
b AS (SELECT *, least(500, greatest(1, CAST(ceil((hi - lo) / (2 * iqr / pow(n, 1.0 / 3))) AS BIGINT))) AS bins FROM e),
h AS (SELECT least(bins - 1, CAST(floor((o_totalprice - lo) / ((hi - lo) / bins)) AS BIGINT)) AS bin, count(*) AS n FROM orders, b GROUP BY 1)
SELECT g.bin, round(lo + g.bin * (hi - lo) / bins, 4) AS low, round(lo + (g.bin + 1) * (hi - lo) / bins, 4) AS high, coalesce(h.n, 0) AS n FROM (SELECT unnest(range(bins)) AS bin, lo, hi, bins FROM b) g LEFT JOIN h USING (bin)""",
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = stats.histogram(table(spark, sf_dir, "orders"), "o_totalprice")
    return h.select("bin", r("low", 4).alias("low"), r("high", 4).alias("high"), "n")


@query("K3_density")
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.density(table(spark, sf_dir, "orders"), "o_totalprice")


@query("K4_ecdf", "SELECT DISTINCT l_quantity AS value, round(cume_dist() OVER (ORDER BY l_quantity), 9) AS share FROM lineitem")
def ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ecdf(table(spark, sf_dir, "lineitem"), "l_quantity").withColumn("share", r("share", 9))


@query(
    "K5_box",
    """WITH q AS (SELECT o_orderpriority AS p, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT p AS o_orderpriority, round(q1, 4) AS q1, round(m, 4) AS median, round(q3, 4) AS q3, min(o_totalprice) FILTER (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low,
 max(o_totalprice) FILTER (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (NOT o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM orders JOIN q ON p = o_orderpriority GROUP BY 1, 2, 3, 4""",
)
def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stats.box(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])
    return b.select("o_orderpriority", *(r(c, 4).alias(c) for c in ("q1", "median", "q3")), "low", "high", "outliers")


@query("K7_pearson", f"WITH {PANEL} SELECT count(*) AS n, round(corr(revenue, qty), 9) AS r, round(corr(revenue, qty) * sqrt((count(*) - 2) / (1 - pow(corr(revenue, qty), 2))), 5) AS t FROM panel")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pearson(panel(spark, sf_dir), "revenue", "qty").select("n", r("r", 9).alias("r"), r("t", 5).alias("t"))


@query(
    "K8_spearman",
    f"""WITH {PANEL}, k AS (SELECT season, rank() OVER (PARTITION BY season ORDER BY revenue) + (count(*) OVER (PARTITION BY season, revenue) - 1) / 2.0 AS a, rank() OVER (PARTITION BY season ORDER BY qty) + (count(*) OVER (PARTITION BY season, qty) - 1) / 2.0 AS b FROM panel)
SELECT season, count(*) AS n, round(corr(a, b), 6) AS r FROM k GROUP BY 1""",
)
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(panel(spark, sf_dir), "revenue", "qty", ["season"]).select("season", "n", r("r").alias("r"))


MATRIX = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "K10_correlations",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {'1.0' if a == b else f'round(corr({a}, {b}), 6)'} AS r, {'0' if a == b else 'count(*)'} AS n{'' if a == b else ' FROM lineitem'}" for a in MATRIX for b in MATRIX),
)
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlation_matrix(table(spark, sf_dir, "lineitem"), list(MATRIX)).withColumn("r", r("r"))


@query("K20_regression", f"WITH {PANEL} SELECT season, count(*) AS n, round(regr_slope(revenue, qty), 5) AS slope, round(regr_intercept(revenue, qty), 3) AS intercept, round(regr_r2(revenue, qty), 6) AS r2 FROM panel GROUP BY 1")
def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stats.regression(panel(spark, sf_dir), "qty", "revenue", ["season"])
    return f.select("season", "n", r("slope", 5).alias("slope"), r("intercept", 3).alias("intercept"), r("r2").alias("r2"))


@query("K20_K21_least_squares")
def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stats.least_squares(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return spark.createDataFrame(list(zip(f["names"], f["beta"], f["se"], strict=True)), "term string, beta double, se double")


LABELLED = "(SELECT o_totalprice AS v, CAST(o_orderstatus = 'F' AS INTEGER) AS y, CAST(o_orderkey % 3 = 0 AS INTEGER) AS s FROM orders) x"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_totalprice AS v", "CAST(o_orderstatus = 'F' AS INT) AS y", "CAST(o_orderkey % 3 = 0 AS INT) AS s")


@query(
    "K25_welch",
    f"""WITH m AS (SELECT count(v) FILTER (y = 1) AS n1, count(v) FILTER (y = 0) AS n0, avg(v) FILTER (y = 1) AS m1, avg(v) FILTER (y = 0) AS m0, var_samp(v) FILTER (y = 1) AS v1, var_samp(v) FILTER (y = 0) AS v0 FROM {LABELLED})
SELECT n1 AS n_1, n0 AS n_0, round(m1 - m0, 4) AS difference, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t, round(pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)), 3) AS df FROM m""",
)
def welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.welch(_labelled(spark, sf_dir), "v", "y").select("n_1", "n_0", r("difference", 4).alias("difference"), r("t").alias("t"), r("df", 3).alias("df"))


@query(
    "K26_rank_sum",
    f"""WITH k AS (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM {LABELLED}), s AS (SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, sum(r) FILTER (y = 1) AS r1 FROM k)
SELECT n1 AS n_1, n0 AS n_0, round(least(r1 - n1 * (n1 + 1) / 2, CAST(n1 AS DOUBLE) * n0 - (r1 - n1 * (n1 + 1) / 2)), 3) AS u, round(2 * (r1 - n1 * (n1 + 1) / 2) / (CAST(n1 AS DOUBLE) * n0) - 1, 9) AS biserial FROM s""",
)
def rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rank_sum(_labelled(spark, sf_dir), "v", "y").select("n_1", "n_0", r("u", 3).alias("u"), r("biserial", 9).alias("biserial"))


@query(
    "K28_proportions",
    f"""WITH m AS (SELECT avg(s) FILTER (y = 1) AS p1, avg(s) FILTER (y = 0) AS p0, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, avg(s) AS p FROM {LABELLED})
SELECT round(p1, 9) AS p_1, round(p0, 9) AS p_0, round((p1 - p0) / sqrt(p * (1 - p) * (1.0 / n1 + 1.0 / n0)), 6) AS z FROM m""",
)
def proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.proportions(_labelled(spark, sf_dir), "s", "y").select(r("p_1", 9).alias("p_1"), r("p_0", 9).alias("p_0"), r("z").alias("z"))


@query(
    "K31_false_discovery",
    """WITH p AS (SELECT p_partkey, (p_partkey * 7919 % 100003) / 100003.0 AS p FROM part), k AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw FROM p)
SELECT p_partkey, round(least(1.0, min(raw) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM k""",
)
def false_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "(p_partkey * 7919 % 100003) / 100003.0D AS p")
    return stats.false_discovery(p, "p").select("p_partkey", r("q", 9).alias("q"))


@query(
    "L9_classification",
    """WITH x AS (SELECT (o_orderkey * 7919 % 10007) / 10007.0 AS p, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders), k AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM x)
SELECT count(*) AS n, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y))), 9) AS auc, round(avg(pow(p - y, 2)), 9) AS brier, round(avg(CAST(CAST(p >= 0.5 AS INTEGER) = y AS INTEGER)), 9) AS accuracy,
 round(CAST(count(*) FILTER (p >= 0.5 AND y = 1) AS DOUBLE) / count(*) FILTER (p >= 0.5), 9) AS precision FROM k""",
)
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").selectExpr("(o_orderkey * 7919 % 10007) / 10007.0D AS p", "CAST(o_orderstatus = 'F' AS INT) AS y")
    return stats.classification(x, "p", "y").select("n", *(r(c, 9).alias(c) for c in ("auc", "brier", "accuracy", "precision")))


OBS = f"{PANEL}, obs AS (SELECT entity AS id, period, qty AS factor, lead(revenue) OVER (PARTITION BY entity ORDER BY period) AS forward FROM panel)"


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ahead = F.lead("revenue").over(Window.partitionBy("entity").orderBy("period"))
    return panel(spark, sf_dir).select(F.col("entity").alias("id"), "period", F.col("qty").alias("factor"), ahead.alias("forward"))


@query(
    "Q1_information_coefficient",
    f"""WITH {OBS}, k AS (SELECT period, rank() OVER (PARTITION BY period ORDER BY factor) + (count(*) OVER (PARTITION BY period, factor) - 1) / 2.0 AS a, rank() OVER (PARTITION BY period ORDER BY forward) + (count(*) OVER (PARTITION BY period, forward) - 1) / 2.0 AS b FROM obs WHERE factor IS NOT NULL AND forward IS NOT NULL),
i AS (SELECT period, corr(a, b) AS ic FROM k GROUP BY 1 HAVING count(*) >= 10)
SELECT count(*) AS periods, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS sd_ic, round(avg(ic) / stddev_samp(ic), 6) AS ratio, round(CASE WHEN avg(ic) >= 0 THEN count(*) FILTER (ic > 0) ELSE count(*) FILTER (ic <= 0) END / count(*), 6) AS hit_rate FROM i""",
)
def information_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = factors.information_coefficient(_obs(spark, sf_dir))
    return found.select("periods", *(r(c).alias(c) for c in ("mean_ic", "sd_ic", "ratio", "hit_rate")))


@query(
    "Q3_quantile_means",
    f"""WITH {OBS}, c AS (SELECT *, count(*) OVER (PARTITION BY period) AS m FROM obs WHERE factor IS NOT NULL AND forward IS NOT NULL), k AS (SELECT forward, least(4, CAST(floor((row_number() OVER (PARTITION BY period ORDER BY factor, id) - 1) * 5 / count(*) OVER (PARTITION BY period)) AS INTEGER)) AS bucket FROM c WHERE m >= 10)
SELECT bucket, round(avg(forward), 4) AS mean_forward, count(*) AS n FROM k GROUP BY 1""",
)
def quantile_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.quantile_means(_obs(spark, sf_dir), 5).withColumn("mean_forward", r("mean_forward", 4))


@query(
    "Q3_spread",
    f"""WITH {OBS}, c AS (SELECT *, count(*) OVER (PARTITION BY period) AS m FROM obs WHERE factor IS NOT NULL AND forward IS NOT NULL),
k AS (SELECT period, forward, (row_number() OVER (PARTITION BY period ORDER BY factor, id) - 1) * 5 // m AS bucket FROM c WHERE m >= 10), d AS (SELECT period, avg(forward) FILTER (bucket = 4) - avg(forward) FILTER (bucket = 0) AS d FROM k GROUP BY 1)
SELECT count(d) AS periods, round(avg(d), 4) AS mean_spread, round(stddev_samp(d), 4) AS sd_spread, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t FROM d""",
)
def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = factors.spread(_obs(spark, sf_dir), 5)
    return found.select("periods", r("mean_spread", 4).alias("mean_spread"), r("sd_spread", 4).alias("sd_spread"), r("t").alias("t"))


@query(
    "Q4_turnover",
    f"""WITH {OBS}, k AS (SELECT id, period, row_number() OVER (PARTITION BY period ORDER BY factor DESC, id) AS p, count(*) OVER (PARTITION BY period) AS m FROM obs WHERE factor IS NOT NULL), h AS (SELECT DISTINCT id, period FROM k WHERE m >= 5 AND p <= greatest(1, m // 5)),
o AS (SELECT period, lag(period) OVER (ORDER BY period) AS before FROM (SELECT DISTINCT period FROM k)), c AS (SELECT h.id, h.period, o.before FROM h JOIN o USING (period) WHERE o.before IN (SELECT period FROM h))
SELECT c.period, count(b.id) AS shared, round(1 - count(b.id) / count(*), 6) AS turnover FROM c LEFT JOIN h b ON b.id = c.id AND b.period = c.before GROUP BY 1""",
)
def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.top_turnover(_obs(spark, sf_dir), 5).select("period", "shared", r("turnover").alias("turnover"))


@query(
    "Q5_Q7_normalised",
    f"""WITH {PANEL}, e AS (SELECT quantile_cont(revenue, 0.05) AS lo, quantile_cont(revenue, 0.95) AS hi FROM panel)
SELECT entity, period, round(least(greatest(revenue, lo), hi), 6) AS clipped, round((row_number() OVER (PARTITION BY period ORDER BY revenue, entity) - 0.5) / count(*) OVER (PARTITION BY period), 9) AS normal FROM panel, e""",
)
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumn("normal", factors.rank_normalised("revenue", ["period"], ["entity"]))
    return factors.winsorised(p, "revenue", 0.05).select("entity", "period", r("revenue").alias("clipped"), r("normal", 9).alias("normal"))


@query("L3_L10_L11_walk_forward")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of boosted trees refitted for each test season on what came before."""
    rows = models.lagged(panel(spark, sf_dir), ["entity"], ["period"], "revenue", (1, 2, 3))
    return models.walk_forward(rows, ["lag1", "lag2", "lag3"], "revenue", "season", folds=2, embargo=0)


@query("L7_clusters")
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.clusters(table(spark, sf_dir, "embeddings"), "embedding", 8).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("L8_components")
def principal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.components(table(spark, sf_dir, "lineitem"), list(MATRIX), 3)
