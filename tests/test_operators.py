"""Golden values and brute force for the panel operators."""

from __future__ import annotations

import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import domain as D
from tessera.functions import missing as M
from tessera.operators import factors, frames, joins, ledger, models, ordering, sets, stats, windows
from tessera.sources.files import kickoff, read_csv, write_csv
from tessera.sources.snapshots import NotFound, SnapshotLake, gameweek_of, slug
from tessera.streaming import events as S



@pytest.fixture(scope="module")
def rows(spark):
    data = [("a", "MID", 1, 12.0), ("a", "MID", 2, 2.0), ("a", "MID", 3, 9.0), ("b", "FWD", 1, None), ("b", "FWD", 2, 7.0), ("b", "FWD", 3, 13.0)]
    return spark.createDataFrame(data, "player string, position string, gameweek int, points double").cache()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_totals_by_player(rows):
    got = {r["player"]: r for r in frames.group(rows, ["player"], [("points", "sum", "total"), ("points", "mean", "mean")]).collect()}
    assert (got["a"]["total"], got["a"]["count"]) == (23.0, 3) and (got["b"]["mean"], got["b"]["count"]) == (10.0, 3)


def test_rolling_and_totals(rows):
    by = Window.partitionBy("player").orderBy("gameweek")
    got = rows.select("player", "gameweek", windows.rolling(F.col("points"), by, 2, "mean").alias("m"), windows.running_total(F.col("points"), by).alias("t")).collect()
    assert [r["m"] for r in sorted(got)] == [None, 7.0, 5.5, None, 7.0, 10.0]
    assert [r["t"] for r in sorted(got)] == [12.0, 14.0, 23.0, None, 7.0, 20.0]


def test_smoothing_carries_over_gaps(spark):
    series = [5.0, None, 8.0, None, None, 1.0, 2.0] * 40
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(series)], "k string, i int, v double")
    got = [r["s"] for r in windows.smoothed(df, "v", "s", ["k"], ["i"], 1.0).orderBy("i").collect()]
    state, want = None, []
    for v in series:
        state = state if v is None else v if state is None else state + 0.5 * (v - state)
        want.append(state)
    assert got == pytest.approx(want)


def test_missing_rules(spark):
    n, zero, two = F.lit(None).cast("double"), F.lit(0.0), F.lit(2.0)
    assert one(spark, M.both(n, two)) == 1 and one(spark, M.either(n, zero)) == 1 and one(spark, M.both(n, zero)) == 0
    assert one(spark, M.negate(n)) is None and one(spark, M.choose(n, two, zero)) is None
    assert one(spark, M.divide(two, zero)) is None and one(spark, M.modulo(F.lit(-7.0), F.lit(3.0))) == -1 and one(spark, M.modulo(two, zero)) is None
    assert one(spark, M.round_up(F.lit(-2.5))) == -2 and one(spark, M.round_up(F.lit(2.345), 2)) == pytest.approx(2.35)
    assert one(spark, M.sqrt(F.lit(-1.0))) is None and one(spark, M.ln(zero)) is None and one(spark, M.per90(F.lit(3.0), F.lit(10.0), "twenty")) is None
    got = M.clean(spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "v double")).collect()
    assert [r["v"] for r in got] == [None, None, 1.0]


def test_latest_before_and_nearest(spark):
    dice = random.Random(3)
    left = [(i, "k" if dice.random() < 0.5 else f"k{i % 5}", float(dice.randint(0, 60))) for i in range(150)]
    right = [("k" if dice.random() < 0.5 else f"k{i % 5}", float(dice.randint(0, 60)), i) for i in range(120)]
    a, b = spark.createDataFrame(left, "id int, k string, at double"), spark.createDataFrame(right, "k string, at double, v int")
    got = {r["id"]: r["v"] for r in joins.latest_before(a, b, ["k"], "at", ["v"], 7.0).collect()}
    near = {r["id"]: r["v_near"] for r in joins.nearest(a, b, ["k"], "at", ["v"], ["id"], 3.0).collect()}
    for i, k, at in left:
        earlier = [(t, v) for q, t, v in right if q == k and t < at]
        assert got[i] == (max(earlier)[1] if earlier else None)
        close = sorted((abs(t - at), v) for q, t, v in right if q == k and abs(t - at) <= 3)
        assert near[i] == (close[0][1] if close and sum(g == close[0][0] for g, _ in close) == 1 else None)


def test_covering_takes_the_shortest(spark):
    points = spark.createDataFrame([(1, "t", 5.0), (2, "t", 50.0), (3, "u", 5.0)], "id int, k string, at double")
    spells = spark.createDataFrame([("t", 0.0, 9.0, "long"), ("t", 4.0, 6.0, "short"), ("t", 40.0, None, "open")], "k string, f double, t double, who string")
    got = joins.covering(points, spells, ["k"], "at", "f", "t", ["who"], ["id"], 3.0)
    assert {r["id"]: r["who"] for r in got.collect()} == {1: "short", 2: "open", 3: None}


def test_places_and_odds(spark):
    assert one(spark, D.distance_metres(F.lit(51.5), F.lit(0.0), F.lit(51.5), F.lit(0.01))) == pytest.approx(692, rel=0.01)
    assert one(spark, D.poisson(F.lit(2), F.lit(1.5))) == pytest.approx(0.2510214)
    assert one(spark, D.selling_price(F.lit(50), F.lit(55))) == 52 and one(spark, D.selling_price(F.lit(50), F.lit(45))) == 45
    assert one(spark, D.season_of(F.lit("2024-07-01").cast("date"))) == "2024/25" and one(spark, D.season_of(F.lit("2000-01-01").cast("date"))) == "1999/00"
    assert one(spark, kickoff(F.lit("16/08/24"), F.lit(""))) == datetime(2024, 8, 16, 14, 0)


def test_difference_and_upsert(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "id int, v string")
    got = {tuple(r) for r in sets.difference(a, b, ["id"], ["v"]).collect()}
    assert got == {(1, "removed", None, None, None), (2, "changed", "v", "y", "z"), (4, "added", None, None, None)}
    assert {tuple(r) for r in sets.upsert(a, b, ["id"]).collect()} == {(1, "x"), (2, "z"), (3, None), (4, "w")}


def test_strided_is_in_key_order(spark):
    got = [r["id"] for r in frames.strided(spark.range(1000).repartition(7), "id", 90).orderBy("id").collect()]
    assert got == list(range(0, 1000, 12))


def test_validation_reports(rows):
    with pytest.raises(ValueError, match="points"):
        frames.validate(rows, {"points below 10": F.col("points") < 10})
    frames.validate(rows, {"week": F.col("gameweek") > 0})


def test_snapshots(spark, tmp_path):
    lake = SnapshotLake(spark, str(tmp_path / "lake"))
    schema = T.StructType().add("id", "long").add("name", "string")
    assert lake.read("players", schema, optional=True).count() == 0
    with pytest.raises(NotFound):
        lake.read("players", schema)
    first, second = datetime(2026, 8, 1), datetime(2026, 8, 2)
    lake.write(spark.createDataFrame([(1, "a")], schema), "2026/27", "players", first)
    lake.write(spark.createDataFrame([(1, "b"), (2, "c")], schema), "2026/27", "players", second, form="json")
    assert lake.read("players", schema).count() == 2 and lake.read("players", schema, at=first).first()["name"] == "a"
    assert [r["rows"] for r in lake.history("players").collect()] == [1, 2]
    with pytest.raises(ValueError):
        lake.read("players", schema, rules={"even": F.col("id") % 2 == 0})
    for week in (1, 2):
        lake.write(spark.createDataFrame([(week, "w")], schema), "2026/27", "weeks", first, partition=f"2026-27-gw{week}")
    got = lake.read_all("weeks", schema).withColumns(gameweek_of()).collect()
    assert {(r["id"], r["season"], r["gameweek"]) for r in got} == {(1, "2026-27", 1), (2, "2026-27", 2)}
    assert [r[0] for r in lake.datasets().collect()] == ["players", "weeks"] and slug("a/b c") == "a_b_c"


def test_csv_quirks(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,a\n1,"x, ""y""",9\n2\n')
    got = read_csv(spark, str(tmp_path / "x.csv"))
    assert got.columns == ["a", "b"] and [tuple(r) for r in got.collect()] == [("1", 'x, "y"'), ("2", "")]
    write_csv(got, str(tmp_path / "out"))
    assert read_csv(spark, str(tmp_path / "out")).collect() == got.collect()


def test_statistics_known_values(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1 + (0.1 if x % 2 else -0.1)) for x in range(1, 21)], "x double, y double")
    fit = stats.least_squares(df, ["x"], "y")
    assert fit["beta"][1] == pytest.approx(2, abs=0.01) and fit["r2"] > 0.999
    constant = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "a double, b double")
    assert stats.pearson(constant, "a", "b").first()["r"] is None
    assert one(spark, stats.standard_normal_cdf(F.lit(1.96))) == pytest.approx(0.975, abs=1e-4)
    x = stats.density(df, "x").toPandas()
    assert (x.density.sum() * (x.x[1] - x.x[0])) == pytest.approx(1, abs=0.02)


def test_features_read_the_past_alone(spark):
    rows = [("p", i, float(i * i % 17)) for i in range(30)]
    before = models.lagged(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], ["t"], "v", (1, 2)).where("t <= 15").select("t", "lag1", "lag2").collect()
    changed = [(k, t, v if t <= 15 else -1.0) for k, t, v in rows]
    after = models.lagged(spark.createDataFrame(changed, "k string, t int, v double"), ["k"], ["t"], "v", (1, 2)).where("t <= 15").select("t", "lag1", "lag2").collect()
    assert sorted(before) == sorted(after)


def test_streams(spark, tmp_path):
    schema = "id long, ts timestamp, kind string, v double"
    data = [(i, datetime(2026, 1, 1, 0, i % 50), "ab"[i % 2], 1.0) for i in range(100)]
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "in"))
    stream = S.read_events(spark, str(tmp_path / "in"), schema)
    q = S.windowed(stream, "ts", ["kind"], "v", "10 minutes", "5 minutes").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 100
    held, writes = {"df": spark.createDataFrame([(0, "old"), (999, "kept")], "id long, kind string")}, []

    def write(df):
        writes.append(1)
        held["df"] = spark.createDataFrame(df.collect(), df.schema)

    for run in ("one", "two"):
        S.keep_current(stream, lambda: held["df"], write, ["id"], ["kind"], str(tmp_path / run)).awaitTermination()
    assert held["df"].count() == 101 and len(writes) == 1 and held["df"].where("id = 999").first()["kind"] == "kept"


def test_ranks_and_running_sums_by_parts(spark):
    from tessera.operators.ordering import least_after, running, value_ranks

    dice = random.Random(8)
    rows = [(i, dice.choice([None, *map(float, range(12))]), dice.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, v double, w double").repartition(5)
    present = sorted(v for _, v, _ in rows if v is not None)
    for r in value_ranks(df, "v").collect():
        places = [i + 1 for i, v in enumerate(present) if v == r["value"]]
        assert (r["n"], r["rank"]) == (len(places), sum(places) / len(places))
    got = {r["id"]: r["s"] for r in running(df, "w", {"s": "w"}).collect()}
    assert got == pytest.approx({i: sum(x for _, _, x in rows if x < w) for i, _, w in rows})
    low = {r["id"]: r["m"] for r in least_after(df, "w", "id", "m").collect()}
    assert low == {i: min(j for j, _, x in rows if x >= w) for i, _, w in rows}
    assert running(df.limit(0), "w", {"s": "w"}).count() == 0


def test_factor_definitions(spark):
    """Golden values worked by hand from the definitions."""
    # ten ids, the factor falls where the result rises: every correlation is negative, so all hit
    rows = [(i, p, float(i), float(-i * p)) for p in (1, 2, 4) for i in range(10)]
    obs = spark.createDataFrame(rows, "id long, period int, factor double, forward double")
    got = factors.information_coefficient(obs).first()
    assert (got["periods"], got["mean_ic"], got["hit_rate"]) == (3, pytest.approx(-1), 1)
    # a period of nine rows holds fewer than twice five
    small = obs.union(spark.createDataFrame([(i, 7, float(i), 1e6) for i in range(9)], obs.schema))
    means = {r["bucket"]: (r["mean_forward"], r["n"]) for r in factors.quantile_means(small, 5).collect()}
    assert means == {b: (pytest.approx(-(2 * b + 0.5) * 7 / 3), 6) for b in range(5)}
    assert factors.quantile_means(small, 1).count() == 2
    # period 4 is compared with 2, the one before it; 5 has too few rows, so neither it nor 6 counts
    more = [(i, 5, 1.0, 0.0) for i in range(3)] + [(i, 6, float(-i), 0.0) for i in range(10)] + [(i, 8, float(-i), 0.0) for i in range(1, 11)]
    turned = {r["period"]: (r["shared"], r["turnover"]) for r in factors.top_turnover(obs.union(spark.createDataFrame(more, obs.schema)), 5).collect()}
    assert turned == {2: (2, 0), 4: (2, 0), 8: (1, 0.5)}


def test_rank_sum_gives_the_lesser_u(spark):
    rows = [(5.0, 1), (6.0, 1), (7.0, 1), (1.0, 0), (2.0, 0), (6.0, 0)]
    got = stats.rank_sum(spark.createDataFrame(rows, "v double, y int"), "v", "y").first()
    assert (got["u"], got["biserial"]) == (1.5, pytest.approx(2 * 7.5 / 9 - 1)) and got["z"] > 0


@pytest.mark.parametrize(("scores", "auc"), [([0.9, 0.8, 0.2, 0.1], 1.0), ([0.1, 0.2, 0.8, 0.9], 0.0), ([0.9, 0.2, 0.5, 0.1], 0.75), ([0.5, 0.5, 0.5, 0.5], 0.5)])
def test_auc_on_both_sides_of_a_half(spark, scores, auc):
    rows = spark.createDataFrame(list(zip(scores, [1, 1, 0, 0], strict=True)), "p double, y int")
    assert stats.classification(rows, "p", "y").first()["auc"] == pytest.approx(auc)


def test_covering_equals_all_pairs(spark):
    dice = random.Random(6)
    points = [(i, dice.choice("tu"), dice.uniform(0, 1000)) for i in range(200)]
    spells = []
    for i in range(80):
        start = dice.uniform(-50, 900)
        spells.append((dice.choice("tu"), start, None if i % 10 == 0 else start + dice.choice([1, 20, 300, 5000]), f"s{i:02}"))
    got = joins.covering(spark.createDataFrame(points, "id int, k string, at double"), spark.createDataFrame(spells, "k string, f double, t double, who string"), ["k"], "at", "f", "t", ["who"], ["id"], 7.0)
    last, want = max(p[2] for p in points), {}
    for i, k, at in points:
        met = [((t if t is not None else last + 1) - f, who) for key, f, t, who in spells if key == k and f <= at < (t if t is not None else last + 1)]
        want[i] = min(met)[1] if met else None
    assert {r["id"]: r["who"] for r in got.collect()} == want


def test_places_near_the_poles_and_the_date_line(spark):
    dice = random.Random(7)
    spots = [(89.5, 10.0), (89.6, -170.0), (-89.9, 0.0), (-89.9, 180.0), (0.0, 179.9), (0.0, -179.9), (60.0, 179.99), (60.0, -179.99), (None, 3.0)]
    spots += [(dice.uniform(-90, 90), dice.uniform(-180, 180)) for _ in range(150)]
    rows = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)], "a int, lat double, lon double")
    other = rows.withColumnRenamed("a", "b")
    got = {(r["a"], r["b"]) for r in joins.near_places(rows, other, "lat", "lon", 400_000.0, D.distance_metres).collect()}
    pairs = rows.crossJoin(other.withColumnsRenamed({"lat": "y", "lon": "x"})).where(D.distance_metres(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")) <= 400_000.0)
    assert got == {(r["a"], r["b"]) for r in pairs.collect()} and (4, 5) in got and (0, 1) in got


def test_places_of_one_partition_meet_in_several_tasks(spark):
    dice = random.Random(9)
    rows = spark.createDataFrame([(i, dice.uniform(45, 57), dice.uniform(-18, 18)) for i in range(300)], "a int, lat double, lon double").coalesce(1)
    other = rows.withColumnRenamed("a", "b")
    for metres in (20_000.0, 150_000.0, 7_000_000.0):
        got = joins.near_places(rows, other, "lat", "lon", metres, D.distance_metres).select("a", "b", "metres", F.spark_partition_id().alias("task")).collect()
        pairs = rows.crossJoin(other.withColumnsRenamed({"lat": "y", "lon": "x"})).withColumn("m", D.distance_metres(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")))
        assert sorted((r["a"], r["b"], r["metres"]) for r in got) == sorted((r["a"], r["b"], r["m"]) for r in pairs.where(F.col("m") <= metres).select("a", "b", "m").collect())
        assert metres > 1e6 or len({r["task"] for r in got}) > 4


def test_places_are_dealt_without_what_can_be_found_again(spark, capsys):
    rows = spark.range(50).selectExpr("id AS a", "id / 10.0D AS lat", "id / 20.0D AS lon")
    joins.near_places(rows, rows.withColumnRenamed("a", "b"), "lat", "lon", 150_000.0, D.distance_metres).explain("formatted")
    steps = [step for step in capsys.readouterr().out.split("\n\n") if step.startswith("(")]
    dealt = [re.findall(r"\w+(?=#)", step.split("\n")[1]) for step in steps if " Exchange\n" in step]
    assert sorted(dealt) == [[key, "lat", "lon", "_xc", "_yc", "_zc"] for key in "ab"]
    # a latitude's cosine is found once a row, not once a pair
    pairs = [step for step in steps if "ASIN(" in step]
    assert pairs and not any("COS(" in step for step in pairs)


def test_change_points_against_all_cuts(spark):
    dice = random.Random(8)
    series = {k: [dice.gauss(m, 1) for m in (0, 6, 2) for _ in range(n)] for k, n in (("a", 12), ("b", 5), ("c", 2))}
    df = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)], "k string, i long, v double")
    got = {(r["k"], r["place"]) for r in ledger.change_points(df, "k", "i", "v", most=2).collect()}

    def sse(v):
        return sum((x - sum(v) / len(v)) ** 2 for x in v)

    want = set()
    for k, v in series.items():
        parts = [(0, len(v))]
        for _ in range(2):
            found = max(((sse(v[a:b]) - sse(v[a:c]) - sse(v[c:b]), c, a, b) for a, b in parts for c in range(a + 4, b - 3)), default=None)
            if found and found[0] > 1e-12:
                want.add((k, found[1]))
                parts.remove(found[2:])
                parts += [(found[2], found[1]), (found[1], found[3])]
    assert got == want and len(want) > 3


def test_density_against_plain_sums(spark):
    dice = np.random.default_rng(9)
    v = dice.normal(10, 3, 300)
    got = sorted(map(tuple, stats.density(spark.createDataFrame([(float(x),) for x in v], "v double"), "v").collect()))
    q3, q1 = np.quantile(v, [0.75, 0.25])
    h = 0.9 * min(v.std(ddof=1), (q3 - q1) / 1.34) * len(v) ** -0.2
    for x, d in got:
        assert d == pytest.approx(np.exp(-0.5 * ((v - x) / h) ** 2).sum() / (len(v) * h * np.sqrt(2 * np.pi)), rel=1e-9)
    assert got[0][0] == pytest.approx(v.min() - 3 * h) and got[-1][0] == pytest.approx(v.max() + 3 * h)


def test_components_and_clusters(spark):
    dice = np.random.default_rng(10)
    m = dice.normal(0, 1, (300, 3))
    m[:, 2] += 2 * m[:, 0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in m], "a double, b double, c double")
    got = models.components(df, ["a", "b", "c"], 3).orderBy("component").collect()
    values, vectors = np.linalg.eigh(np.corrcoef(m.T))
    for i, r in enumerate(got):
        assert r["share"] == pytest.approx(values[-1 - i] / 3) and np.allclose(np.abs(r["loadings"]), np.abs(vectors[:, -1 - i]), atol=1e-6)
    spots = np.concatenate([dice.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 5), (0, 9))])
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(spots)] + [(999, None)], "i int, v array<double>")
    found = {r["i"]: r["cluster"] for r in models.clusters(rows, "v", 3).collect()}
    assert len(found) == 120 and all(len({found[i] for i in range(a, a + 40)}) == 1 for a in (0, 40, 80)) and len(set(found.values())) == 3


def test_walk_forward_reads_the_past_alone(spark):
    rows = [(float(i % 7), float(3 * (i % 7)), 1 + i // 50) for i in range(200)]
    got = models.walk_forward(spark.createDataFrame(rows, "x double, y double, p int"), ["x"], "y", "p", folds=2, embargo=0).orderBy("p").collect()
    assert [r["p"] for r in got] == [3, 4] and all(r["n"] == 50 and r["r2"] > 0.9 for r in got)
    # the last period is unlike the others, so a model that has not seen it is wrong there
    rows = [(x, 100 - y if p == 4 else y, p) for x, y, p in rows]
    got = models.walk_forward(spark.createDataFrame(rows, "x double, y double, p int"), ["x"], "y", "p", folds=1, embargo=0).collect()
    assert got[0]["r2"] < 0


def test_previous_and_greatest_by_parts(spark):
    dice = random.Random(11)
    rows = [(i * 3, dice.uniform(0, 9)) for i in dice.sample(range(400), 300)]
    df = spark.createDataFrame(rows, "t long, v double").repartition(4)
    rows.sort()
    before = {r["t"]: r["b"] for r in ordering.previous(df, "t", "b").collect()}
    assert before == {t: (rows[i - 1][0] if i else None) for i, (t, _) in enumerate(rows)}
    top = {r["t"]: r["m"] for r in ordering.greatest_upto(df, "t", "v", "m").collect()}
    assert top == {t: max(v for _, v in rows[: i + 1]) for i, (t, _) in enumerate(rows)}


def test_quantiles_by_ranges(spark):
    dice = random.Random(12)
    rows = [(k, None if i % 11 == 0 else float(dice.randint(0, 9)) if k == "b" else dice.gauss(0, 5)) for k, n in (("a", 500), ("b", 300), ("c", 1)) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    shares = {"lo": 0.0, "q": 0.25, "m": 0.5, "p": 0.93, "hi": 1.0}
    for by, groups in ((["k"], "abc"), ([], [None])):
        got = {r["k"] if by else None: r for r in ordering.quantiles(df, "v", shares, by).collect()}
        assert set(got) == set(groups)
        for g in groups:
            v = [x for k, x in rows if x is not None and g in (None, k)]
            for name, share in shares.items():
                assert got[g][name] == pytest.approx(np.quantile(v, share))


def test_points_of_a_match(spark):
    from tessera.operators import careers

    names = ["minutes", "goals", "assists", "clean_sheet", "conceded", "saves", "penalties_saved", "penalties_missed", "yellows", "reds", "own_goals", "defensive", "bonus"]
    rows = [("GKP", 90, 0, 0, True, 0, 7, 1, 0, 0, 0, 0, 30, 3), ("DEF", 59, 1, 1, True, 3, 5, 0, 1, 1, 1, 1, 10, 0), ("FWD", 0, 0, 0, False, 0, 0, 0, 0, 1, 0, 0, 12, 0), ("MID", 60, 2, 0, True, 4, 0, 0, 0, 1, 0, 0, None, 1)]
    df = spark.createDataFrame(rows, "pos string, " + ", ".join(f"{n} {'boolean' if n == 'clean_sheet' else 'int'}" for n in names))
    got = df.select(careers.points(F.col("pos"), {n: F.col(n) for n in names})["total"].alias("t")).collect()
    assert sorted(r["t"] for r in got) == sorted([2 + 4 + 2 + 5 + 3, 1 + 6 + 3 - 1 - 2 - 3 - 2 + 2, -1, 2 + 10 + 1 - 1 + 1])
