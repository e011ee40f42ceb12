"""Exact nearest rows over standardised features, block by block.

Rows that are searched are packed into blocks of like values, each with the box of its
features.  A block of wanted rows first meets the boxes nearest to it, until they hold
enough rows; the distances found there bound what a better row can have, and only
blocks whose box is not farther meet it afterwards.  A task holds one block of wanted
rows with its best rows so far, and one searched block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import part_of

#: Blocks at most; what is known of them (two boxes of features each) goes to every task.
MOST_BLOCKS = 20_000


def standardised(df: DataFrame, fitted_on: DataFrame, features: list[str], impute: bool = True, weights: dict[str, float] | None = None) -> DataFrame:
    """Add ``_v``: the features less their mean over their sample deviation (or 1), times a weight.

    Missing ones take the median with ``impute``, else they stay null.
    """
    sums = [F.avg(c).alias(f"m{i}") for i, c in enumerate(features)] + [F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(features)]
    known = fitted_on.agg(*sums).first()
    # approximate to one in 10,000 of the rows, as a filler need not be exact beyond that
    medians = fitted_on.approxQuantile(features, [0.5], 1e-4) if impute else [[]] * len(features)
    out = []
    for i, c in enumerate(features):
        value = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        value = F.coalesce(value, F.lit(medians[i][0] if medians[i] else None).cast("double"))
        out.append((value - (known[f"m{i}"] or 0.0)) / (known[f"s{i}"] or 1.0) * float((weights or {}).get(c, 1.0)))
    return df.withColumn("_v", F.array(*out))


def _blocks(rows: DataFrame, size: int) -> tuple[DataFrame, Column]:
    """``rows`` (key, _v) with a block number: cells of the first two features, split where they are full."""
    n = rows.count()
    size = max(size, -(-2 * n // MOST_BLOCKS))
    cells = max(1, min(64, int((n / size) ** 0.5)))
    flat = rows.withColumns({"_a": F.coalesce(F.get("_v", F.lit(0)), F.lit(0.0)), "_b": F.coalesce(F.get("_v", F.lit(1)), F.lit(0.0))})
    flat = flat.withColumn("_cell", part_of(flat, "_a", cells) * 64 + part_of(flat, "_b", cells))
    full = flat.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("_parts"))  # 64 * 64 cells at most
    dealt = flat.join(F.broadcast(full), "_cell")
    part = F.pmod(F.xxhash64("key"), F.col("_parts"))
    return dealt.select("key", "_v", (F.col("_cell") * (2 * MOST_BLOCKS) + part).cast("long").alias("block"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _packed(blocks: DataFrame, width: int) -> DataFrame:
    """One row a block: its keys, its matrix and its box (infinite where a row lacks the feature)."""

    def pack(rows: pa.Table) -> pa.Table:
        m = _matrix(rows.column("_v"), width)
        lacks = np.isnan(m).any(axis=0)
        low, high = np.where(lacks, -np.inf, m.min(axis=0)), np.where(lacks, np.inf, m.max(axis=0))
        keys = rows.column("key").to_pylist()
        columns = [rows.column("block")[:1].combine_chunks(), pa.array([keys], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary()), pa.array([low.tolist()]), pa.array([high.tolist()])]
        return pa.table(columns, ["block", "keys", "matrix", "low", "high"])

    return blocks.groupBy("block").applyInArrow(pack, "block long, keys array<long>, matrix binary, low array<double>, high array<double>")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances over the features that both rows have, scaled up to all of them; none: infinite."""
    if not np.isnan(a).any() and not np.isnan(b).any():
        total = (a[:, 0, None] - b[None, :, 0]) ** 2
        for j in range(1, a.shape[1]):
            total += (a[:, j, None] - b[None, :, j]) ** 2
        return np.sqrt(total * a.shape[1] / a.shape[1])
    total, count = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        known = ~np.isnan(d)
        total += np.where(known, d * d, 0)
        count += known
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(count > 0, np.sqrt(total * a.shape[1] / count), np.inf)


def _gap(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """The least distance between a box and each of several: scaling for missing features only adds to it."""
    apart = np.maximum(0, np.maximum(lows - high, low - highs))
    return np.sqrt((apart**2).sum(axis=1))


def _nearest(best: np.ndarray, found: np.ndarray, d: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k least of each row of ``best`` (ids ``found``) and ``d`` (ids ``others``, NaN for none), by distance and id.

    Only what the k-th so far lets through is sorted, ties of the last place included.
    """
    n, k = best.shape
    near = d <= best[:, -1:]
    many = near.sum(axis=1) > 4 * k
    if many.any():
        some = np.where(near[many], d[many], np.inf)
        near[many] &= some <= np.partition(some, k - 1, axis=1)[:, k - 1 : k]
    line, at = np.nonzero(near)
    line, dist, ids = np.append(np.repeat(np.arange(n), k), line), np.append(best.ravel(), d[line, at]), np.append(found.ravel(), others[at])
    order = np.lexsort((ids, dist, line))
    chosen = order[np.searchsorted(line[order], np.arange(n))[:, None] + np.arange(k)]
    return dist[chosen], ids[chosen]


def neighbours(wanted: DataFrame, searched: DataFrame, key: str, features: list[str], k: int = 10, impute: bool = True, weights: dict[str, float] | None = None, block_rows: int = 4096) -> DataFrame:
    """The ``k`` rows of ``searched`` nearest to each row of ``wanted``, itself (by ``key``) left out.

    Features are standardised by ``searched``.  Returns ``key``, ``neighbour``, ``place`` (from 1) and
    ``distance``; ties by the smaller key.  ``key`` is a whole number that names a row.
    """
    width = len(features)
    sides = [standardised(df, searched, features, impute, weights).select(F.col(key).cast("long").alias("key"), "_v").where("key IS NOT NULL") for df in (wanted, searched)]
    packs = [_packed(_blocks(side, rows), width).persist() for side, rows in zip(sides, (max(1, block_rows // 4), block_rows), strict=True)]
    mine, theirs = packs
    known = theirs.select("block", F.size("keys").alias("n"), "low", "high").collect()  # MOST_BLOCKS rows or so
    names = np.array([r["block"] for r in known], np.int64)
    sizes = np.array([r["n"] for r in known], np.int64)
    lows, highs = (np.array([r[c] for r in known]).reshape(-1, width) for c in ("low", "high"))

    def plan(batches: Iterator[pa.RecordBatch], bounded: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [])
            for row in batch.to_pylist():
                gaps = _gap(np.array(row["low"]), np.array(row["high"]), lows, highs)
                order = np.argsort(gaps, kind="stable")
                first = order[: 1 + int(np.searchsorted(np.cumsum(sizes[order]), k + 1))]
                chosen = np.setdiff1d(np.flatnonzero(gaps <= row["bound"] * (1 + 1e-9)), first) if bounded else first
                out[0].extend([row["block"]] * len(chosen))
                out[1].extend(names[chosen].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["block", "other"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = own = best = found = None
        for batch in batches:
            for row in batch.to_pylist():
                if keys is None:
                    keys, own = np.array(row["keys"]), np.frombuffer(row["matrix"]).reshape(-1, width)
                    best, found = np.full((len(keys), k), np.inf), np.full((len(keys), k), np.iinfo(np.int64).max)
                others, m = np.array(row["other_keys"]), np.frombuffer(row["other_matrix"]).reshape(-1, width)
                d = _distances(own, m)
                if np.isin(keys, others).any():
                    d[keys[:, None] == others[None, :]] = np.nan
                best, found = _nearest(best, found, d, others)
        place, line = np.meshgrid(np.arange(1, k + 1), np.arange(len(keys)))
        real = (np.isfinite(best) & (found < np.iinfo(np.int64).max)).ravel()
        columns = [keys[line.ravel()[real]], found.ravel()[real], place.ravel()[real].astype(np.int32), best.ravel()[real]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "neighbour", "place", "distance"])

    met = theirs.select(F.col("block").alias("other"), F.col("keys").alias("other_keys"), F.col("matrix").alias("other_matrix"))

    def passed(boxes: DataFrame, bounded: bool) -> DataFrame:
        pairs = boxes.mapInArrow(lambda batches: plan(batches, bounded), "block long, other long")
        both = pairs.join(met, "other").join(mine.select("block", "keys", "matrix"), "block").select("block", "keys", "matrix", "other_keys", "other_matrix")
        return both.groupBy("block").applyInArrow(search, "key long, neighbour long, place int, distance double")

    near = passed(mine.select("block", "low", "high", F.lit(0.0).alias("bound")), False).persist()
    reach = near.groupBy("key").agg(F.max(F.when(F.col("place") == k, F.col("distance"))).alias("d"))
    owner = mine.select("block", F.explode("keys").alias("key")).join(reach, "key", "left")
    bound = owner.groupBy("block").agg(F.max(F.coalesce("d", F.lit(float("inf")))).alias("bound"))
    far = passed(mine.select("block", "low", "high").join(bound, "block"), True)
    both = near.union(far).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))).alias("all"))  # 2 k at most
    each = both.select("key", F.posexplode(F.slice("all", 1, k)).alias("_i", "e"))
    return each.select("key", F.col("e.neighbour").alias("neighbour"), (F.col("_i") + 1).alias("place"), F.col("e.distance").alias("distance"))


def predicted(found: DataFrame, targets: DataFrame, key: str, target: str, weighted: bool = True) -> DataFrame:
    """``key`` and ``prediction``: the neighbours' targets, weighted by inverse distance."""
    joined = found.join(targets.select(F.col(key).alias("neighbour"), F.col(target).cast("double").alias("_t")).where("_t IS NOT NULL"), "neighbour")
    weight = 1 / (F.col("distance") + 1e-9) if weighted else F.lit(1.0)
    return joined.groupBy("key").agg(F.try_divide(F.sum(weight * F.col("_t")), F.sum(weight)).alias("prediction"))


def similar(found: DataFrame, k: int) -> DataFrame:
    """Add ``similarity``: 1 less the distance over 1.2 of the farthest neighbour's; rows at distance 0 are left out."""
    apart = found.where("distance > 0")
    farthest = apart.groupBy("key").agg(F.max("distance").alias("_far"))
    out = apart.join(farthest, "key").where(F.col("place") <= k)
    return out.withColumn("similarity", F.greatest(F.lit(0.0), 1 - F.col("distance") / (F.col("_far") * 1.2))).drop("_far")
