"""Structured Streaming over event files: windows with a watermark, and upserts of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.sets import difference, upsert


def read_events(spark: SparkSession, folder: str, schema: str, pattern: str = "*") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def windowed(events: DataFrame, at: str, by: list[str], value: str, length: str, late: str) -> DataFrame:
    """Count and sum of ``value`` in tumbling windows; what is later than ``late`` is dropped."""
    grouped = events.withWatermark(at, late).groupBy(F.window(at, length).alias("w"), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, at: str, by: list[str], gap: str, late: str) -> DataFrame:
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def keep_current(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: list[str], fields: list[str], checkpoint: str) -> StreamingQuery:
    """Upsert every micro-batch into a stored table; an unchanged batch writes nothing.

    ``key`` names one row of a batch; of several the one with the greatest ``fields`` counts.
    """

    def merge(batch: DataFrame, _: int) -> None:
        one = batch.groupBy(*key).agg(F.max(F.struct(*fields)).alias("_f")).select(*key, "_f.*")
        stored = read()
        changes = difference(stored.join(one.select(*key), key, "left_semi"), one, key, fields)
        if not changes.isEmpty():
            write(upsert(stored, one.select(*stored.columns), key))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
