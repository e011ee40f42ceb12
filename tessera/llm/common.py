"""Shared pieces: checkpoints, text splitting, bounded blocks and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separators of every word-based operator.
SPACE = " \t\n\x0b\x0c\r"
#: What this Python worker keeps from one task to the next.
_KEPT: dict[str, object] = {}


def kept(use: str, make: Callable[[], object]) -> object:
    """What ``make`` gave the first task of ``use`` in this Python worker.

    A worker serves one stage after the other, so what another use keeps goes first.
    """
    if use not in _KEPT:
        forget()
        _KEPT[use] = make()
    return _KEPT[use]


def forget() -> None:
    """Drop what earlier tasks keep in this Python worker, and give free memory back."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``; only where that is unset in a local session,
    as in tests, a folder of this machine is made and registered.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`shared_dir`."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, computed once."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table below :func:`shared_dir`, computed once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that no result still to be computed reads."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Array of the runs of characters other than ASCII white space (null: none)."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACE[1:], " " * len(SPACE[1:]))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def unlike(names: list[str]) -> str:
    """A name that is none of ``names``."""
    return "_" * (1 + max(map(len, names), default=0))


def in_blocks(df: DataFrame, bucket: str, row_id: str, block: int) -> DataFrame:
    """Deal the rows of every bucket into pairs of bounded blocks.

    A bucket of at most ``block`` rows stays whole as the pair (0, 0).  A larger
    one is split by a hash of ``row_id`` into g parts, and every row goes to the
    g pairs (i, j), i <= j, that name its part, so any two rows of the bucket
    meet in some pair and no task holds more than about two parts.  Buckets of
    one row are left out: they hold no pair.  Adds ``part``, ``bi`` and ``bj``.
    """
    sizes = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    parts = F.ceil(F.col("_size") / F.lit(block)).cast("int")
    met = (
        df.join(sizes, bucket)
        .withColumn("_g", parts)
        .withColumn("part", F.pmod(F.xxhash64(F.lit("part"), F.col(row_id)), F.col("_g")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    )
    return met.withColumns(
        {"bi": F.least("part", "_other"), "bj": F.greatest("part", "_other")}
    ).drop("_size", "_g", "_other")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (two long columns ``u`` and ``v``).

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the
    edge set no longer changes; then every node but the smallest of its component
    has one edge, to that smallest node.  Returns ``node``, ``component`` for the
    nodes other than the smallest.  Empty input gives no rows; loops and repeated
    or null edges are ignored.  Minima are partial aggregates and joins are by
    key, so a node with very many edges is split like any skewed key.
    """
    edges = edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
    edges, before = materialise(edges), None
    while True:
        now = edges.agg(
            F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")
        ).first()
        if now["n"] == 0 or now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        edges = materialise(small)


def map_runs(df: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str, rows: int = 100_000) -> DataFrame:
    """Apply ``fn`` to buffers of whole runs, the rows of equal ``keys``.

    Rows are dealt and sorted by ``keys``; a buffer holds ``rows`` rows or one run
    at least, so the caller bounds the run.  ``fn`` gets the buffer and the start
    of each run in it, and returns a batch of ``schema`` or None.
    """
    width = len(keys)

    def buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()

        def starts(table: pa.Table) -> np.ndarray:
            new = np.zeros(table.num_rows, bool)
            new[:1] = True
            for k in range(width):
                column = table.column(k).to_numpy()
                new[1:] |= column[1:] != column[:-1]
            return np.flatnonzero(new)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= rows:
                table = pa.Table.from_batches(held).combine_chunks()
                begun = starts(table)
                # the last run may go on in the next batch
                if begun[-1] and (out := fn(table.slice(0, begun[-1]), begun[:-1])) is not None:
                    yield out
                held = table.slice(begun[-1]).to_batches()
                size = table.num_rows - begun[-1]
        if size:
            table = pa.Table.from_batches(held).combine_chunks()
            if (out := fn(table, starts(table))) is not None:
                yield out

    rest = [c for c in df.columns if c not in keys]
    dealt = df.select(*keys, *rest).repartition(partitions(df.sparkSession), *keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(buffers, schema)


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every k the pairs (k, j) with lo[k] <= j < hi[k], as two flat arrays."""
    n = np.maximum(hi - lo, 0)
    k = np.repeat(np.arange(len(lo)), n)
    return k, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def slabs(costs: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices whose costs sum to ``most`` at most, one item at least."""
    total, at = np.cumsum(costs), 0
    while at < len(costs):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
        yield slice(at, to)
        at = to


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of ``a[i]`` and ``b[i]``; a label is the least member known."""
    while True:
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            return labels
        la, lb = la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (up := labels[labels]).tobytes() != labels.tobytes():
            labels = up
        a, b = a[differ], b[differ]
