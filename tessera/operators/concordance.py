"""Kendall's tau-b by counting inversions, without a join of pairs.

Sorted by (x, y), a pair is discordant if its y stand in reverse.  x and y are cut into
ranges; pairs in different ranges of both are counted on a grid of sums, pairs within
a range of x in the task of that range, and pairs of different x ranges within a range
of y in the task of that one.  A value that many rows share is a range of its own, in
which nothing can be reversed, so a task holds the rows of a narrow range alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import cuts_upto
from .stats import standard_normal_cdf

_WIDE = "decimal(38,0)"


def inversions(y: np.ndarray, w: np.ndarray) -> int:
    """Sum of w[i] * w[j] over i < j with y[i] > y[j], bit by bit of the ranks of y."""
    rank = np.unique(y, return_inverse=True)[1]
    order, total = np.arange(len(y)), 0
    if w.sum() > 1 << 31:  # products would pass 64 bits
        w = w.astype(object)
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        one = (rank[order] >> bit & 1).astype(bool)
        above = np.where(one, w[order], 0)
        before = np.cumsum(above) - above
        first = np.flatnonzero(np.diff(rank[order] >> (bit + 1), prepend=-1))
        base = np.repeat(before[first], np.diff(np.append(first, len(order))))
        total += int(((before - base) * w[order])[~one].sum())
        order = order[np.argsort(rank[order] >> bit, kind="stable")]
    return total


def _ranges(df: DataFrame, c: str, parts: int) -> Column:
    """Ranges of a column: even numbers lie between two cuts, odd ones hold a cut's value alone."""
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted(set(df.approxQuantile(c, shares, 0.5 / parts))) if shares else []
    if not cuts:
        return F.lit(0)
    upto = cuts_upto(cuts, F.col(c))
    met = F.coalesce(F.get(F.array(*map(F.lit, cuts)), upto - 1) == F.col(c), F.lit(False))
    return 2 * upto - met.cast("int")


def _total(amounts: Iterator[int]) -> pa.Table:
    return pa.table({"d": pa.array([Decimal(sum(amounts))], pa.decimal128(38, 0))})


def _within(rows: pa.Table) -> tuple[np.ndarray, ...]:
    x, y, n, u = (rows.column(c).to_numpy() for c in ("x", "y", "n", "u"))
    order = np.lexsort((y, x))
    return y[order], n[order], u[order]


def _inside(rows: pa.Table) -> pa.Table:
    y, n, _ = _within(rows)
    return _total([inversions(y, n)])


def _across(rows: pa.Table) -> pa.Table:
    """Inversions of one range of y less those within one range of x."""
    y, n, u = _within(rows)
    starts = np.append(np.flatnonzero(np.diff(u, prepend=-1)), len(u))
    return _total([inversions(y, n), *(-inversions(y[a:b], n[a:b]) for a, b in zip(starts, starts[1:], strict=False))])


def _grid(cells: pa.Table) -> pa.Table:
    """Pairs of cells of which one has the lesser x and the greater y."""
    u, v, n = (cells.column(c).to_numpy() for c in ("u", "v", "n"))
    (us, row), (vs, column) = np.unique(u, return_inverse=True), np.unique(v, return_inverse=True)
    held = np.zeros((len(us), len(vs)), object)
    held[row, column] = n
    above = held[:, ::-1].cumsum(axis=1)[:, ::-1]  # of this x, y of this range and up
    met = np.zeros_like(held)
    met[1:, :-1] = above.cumsum(axis=0)[:-1, 1:]
    return _total([int((met * held).sum())])


def kendall(df: DataFrame, x: str, y: str, parts: int | None = None) -> DataFrame:
    """``n``, ``concordant``, ``discordant``, ``tied_x``, ``tied_y`` (tied in that alone), ``tau``, ``z`` and ``p``.

    Exact over all complete rows; tau is missing below three rows and of a constant, z
    and p are the normal approximation without ties.  ``parts`` are the cuts of each
    side, by default four a shuffle partition; the grid has at most (2 parts)^2 cells.
    """
    parts = min(512, parts or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    counts = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumns({"u": _ranges(rows, "x", parts), "v": _ranges(rows, "y", parts)})
    parted = [
        counts.groupBy("u", "v").agg(F.sum("n").alias("n")).groupBy().applyInArrow(_grid, f"d {_WIDE}"),  # cells bounded by parts
        counts.where("u % 2 = 0").groupBy("u").applyInArrow(_inside, f"d {_WIDE}"),
        counts.where("v % 2 = 0").groupBy("v").applyInArrow(_across, f"d {_WIDE}"),
    ]
    discordant = parted[0].union(parted[1]).union(parted[2]).agg(F.coalesce(F.sum("d"), F.lit(0)).cast(_WIDE).alias("discordant"))

    def ties(*by: str) -> Column:
        n = F.col("n").cast("decimal(19,0)")
        same = counts.groupBy(*by).agg(F.sum("n").alias("n")) if by else counts.agg(F.sum("n").alias("n"))
        return same.agg(F.coalesce(F.sum((n * (n - 1)).cast(_WIDE) / 2), F.lit(0)).cast(_WIDE).alias("_".join(["t", *by])))

    one = discordant.crossJoin(F.broadcast(ties("x"))).crossJoin(F.broadcast(ties("y"))).crossJoin(F.broadcast(ties("x", "y"))).crossJoin(F.broadcast(ties()))  # a row each
    one = one.crossJoin(F.broadcast(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))))
    concordant = F.col("t") - F.col("t_x") - F.col("t_y") + F.col("t_x_y") - F.col("discordant")
    out = one.select("n", concordant.cast(_WIDE).alias("concordant"), "discordant", (F.col("t_x") - F.col("t_x_y")).cast(_WIDE).alias("tied_x"), (F.col("t_y") - F.col("t_x_y")).cast(_WIDE).alias("tied_y"))
    c, d, n = F.col("concordant").cast("double"), F.col("discordant").cast("double"), F.col("n").cast("double")
    scale = F.sqrt((c + d + F.col("tied_x").cast("double")) * (c + d + F.col("tied_y").cast("double")))
    out = out.withColumn("tau", F.when((F.col("n") >= 3) & (scale > 0), (c - d) / F.when(scale > 0, scale)))
    out = out.withColumn("z", F.col("tau") / F.sqrt(2 * (2 * n + 5) / F.nullif(9 * n * (n - 1), F.lit(0.0))))
    return out.withColumn("p", 2 * (1 - standard_normal_cdf(F.abs("z"))))
