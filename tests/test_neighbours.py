"""Nearest rows against all distances."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import neighbours


def plain(wanted, searched, k, impute):
    m = np.array([[np.nan if v is None else v for v in r[1:]] for r in searched], float)
    mean, sd, mid = np.nanmean(m, 0), np.nanstd(m, 0, ddof=1), np.nanmedian(m, 0)
    sd[~(sd > 0)] = 1

    def scaled(rows):
        x = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], float)
        return ((np.where(np.isnan(x), mid, x) if impute else x) - mean) / sd

    a, b = scaled(wanted), scaled(searched)
    out = []
    for row, x in zip(wanted, a, strict=True):
        d = x - b
        n = (~np.isnan(d)).sum(1)
        dist = np.where(n > 0, np.sqrt(np.nansum(d * d, 1) * len(x) / np.maximum(n, 1)), np.inf)
        best = sorted((v, r[0]) for v, r in zip(dist, searched, strict=True) if r[0] != row[0] and np.isfinite(v))[:k]
        out += [(row[0], i, p, v) for p, (v, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("impute", [True, False])
@pytest.mark.parametrize("block_rows", [16, 4096])
def test_neighbours_equal_all_distances(spark, impute, block_rows):
    dice = np.random.default_rng(5)
    rows = [(i, float(dice.normal()), float(dice.integers(0, 4)), float(dice.exponential())) for i in range(301)]
    rows = [r if r[0] % 13 else (r[0], None, r[2], r[3]) for r in rows] + [(900, 0.5, 2.0, 1.0), (901, 0.5, 2.0, 1.0)]
    rows += [(902, None, None, None)] if not impute else []
    wanted = [r for r in rows if r[0] % 20 == 0]
    schema = "id long, a double, b double, c double"
    got = neighbours.neighbours(spark.createDataFrame(wanted, schema), spark.createDataFrame(rows, schema), "id", ["a", "b", "c"], 5, impute, block_rows=block_rows).collect()
    want = plain(wanted, rows, 5, impute)
    assert len(got) == len(want)
    found = {(r["key"], r["place"]): (r["neighbour"], r["distance"]) for r in got}
    for key, other, place, d in want:
        assert found[key, place][1] == pytest.approx(d, abs=1e-9)
        if not any(k == key and o != other and abs(x - d) < 1e-9 for k, o, _, x in want):
            assert found[key, place][0] == other


def test_predictions_and_similarity(spark):
    found = spark.createDataFrame([(1, 2, 1, 1.0), (1, 3, 2, 3.0), (4, 5, 1, 0.0)], "key long, neighbour long, place int, distance double")
    targets = spark.createDataFrame([(2, 10.0), (3, 20.0), (5, None)], "id long, t double")
    assert neighbours.predicted(found, targets, "id", "t").collect()[0]["prediction"] == pytest.approx(12.5)
    assert [round(r["similarity"], 6) for r in neighbours.similar(found, 2).orderBy("place").collect()] == [round(1 - 1 / 3.6, 6), round(1 - 3 / 3.6, 6)]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "id long, a double")
    some = spark.createDataFrame([(1, 2.0)], "id long, a double")
    assert neighbours.neighbours(empty, some, "id", ["a"], 3).collect() == [] and neighbours.neighbours(some, some, "id", ["a"], 3).collect() == []


def test_best_so_far_is_kept_by_distance_and_id():
    import numpy as np

    dice = np.random.default_rng(1)
    best, found = np.full((5, 3), np.inf), np.full((5, 3), np.iinfo(np.int64).max)
    seen = []
    for block in range(4):
        d = dice.integers(0, 4, (5, 40)).astype(float)
        d[dice.random(d.shape) < 0.2] = np.nan
        others = dice.permutation(40) + 100 * block
        best, found = neighbours._nearest(best, found, d, others)
        seen.append([[(x, i) for x, i in zip(row, others, strict=True) if x == x] for row in d])
    for line in range(5):
        assert list(zip(best[line], found[line], strict=True)) == sorted(sum((s[line] for s in seen), []))[:3]
