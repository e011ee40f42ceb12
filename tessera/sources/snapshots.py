"""An append-only lake of dated snapshots: Parquet or JSON folders and a manifest.

``root/season/dataset/partition/<stamp>`` holds one capture; every write appends one
row to the manifest, itself a Parquet table, after the data is committed, so a reader
never sees a half-written capture.  Paths are Hadoop paths: any store Spark knows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tessera.operators.frames import validate
from tessera.operators.sets import union

MANIFEST = "version int, season string, dataset string, partition string, captured_at timestamp, rows long, format string, file string"
WHOLE = "_all"


class NotFound(LookupError):
    """No snapshot has the wanted name and time."""


def slug(name: str) -> str:
    """A name as a folder: unsafe characters become underscores."""
    return re.sub(r"[^A-Za-z0-9._=-]", "_", name) or WHOLE


def stamp(at: datetime) -> str:
    """ISO time with hyphens, which sorts as the times do."""
    return re.sub(r"[:.]", "-", at.isoformat(timespec="milliseconds"))


@dataclass
class SnapshotLake:
    spark: SparkSession
    root: str

    def manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/_manifest")
        except AnalysisException:
            return self.spark.createDataFrame([], MANIFEST)

    def write(self, df: DataFrame, season: str, dataset: str, captured_at: datetime, partition: str | None = None, form: str = "parquet") -> str:
        """Write a capture and record it."""
        if form not in ("parquet", "json"):
            raise ValueError(f"unknown format {form}")
        part = slug(partition) if partition else WHOLE
        path = f"{self.root}/{slug(season)}/{slug(dataset)}/{part}/{stamp(captured_at)}"
        df.write.mode("errorifexists").format(form).save(path)
        rows = self.spark.read.schema(df.schema).format(form).load(path).count()
        entry = [(1, season, dataset, part, captured_at, rows, form, path)]
        self.spark.createDataFrame(entry, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest")
        return path

    def history(self, dataset: str, partition: str | None = None) -> DataFrame:
        """All captures, oldest first."""
        rows = self.manifest().where((F.col("dataset") == dataset) & (F.col("partition") == (slug(partition) if partition else WHOLE)))
        return rows.orderBy("captured_at")

    def datasets(self) -> DataFrame:
        return self.manifest().select("dataset").distinct().orderBy("dataset")

    def partitions(self, dataset: str) -> DataFrame:
        return self.manifest().where(F.col("dataset") == dataset).select("partition").distinct().orderBy("partition")

    def latest(self, dataset: str) -> DataFrame:
        """The newest manifest row of every partition."""
        rows = self.manifest().where(F.col("dataset") == dataset)
        newest = rows.groupBy("partition").agg(F.max_by(F.struct("captured_at", "format", "file", "season", "rows"), "captured_at").alias("m"))
        return newest.select("partition", "m.*")

    def read(
        self, dataset: str, schema: T.StructType, partition: str | None = None, at: datetime | None = None, optional: bool = False,
        rules: Mapping | None = None,
    ) -> DataFrame:
        """The latest capture of one partition, or the one captured exactly ``at``.

        ``rules`` (name -> condition) must hold for every row.  A missing capture raises
        NotFound, or with ``optional`` reads as no rows.
        """
        rows = self.history(dataset, partition)
        rows = rows.where(F.col("captured_at") == at) if at else rows
        found = rows.orderBy(F.desc("captured_at")).limit(1).collect()
        if not found:
            if optional:
                return self.spark.createDataFrame([], schema)
            raise NotFound(f"{dataset}/{partition or WHOLE}" + (f" at {at}" if at else ""))
        df = self._load(found[0]["format"], [found[0]["file"]], schema)
        if rules:
            validate(df, dict(rules))
        return df

    def read_all(self, dataset: str, schema: T.StructType) -> DataFrame:
        """The latest captures of all partitions, with ``partition`` from the path."""
        found = self.latest(dataset).collect()  # a manifest row a partition
        frames = [self._load(f, [r["file"] for r in found if r["format"] == f], schema) for f in sorted({r["format"] for r in found})]
        if not frames:
            return self.spark.createDataFrame([], T.StructType(schema.fields).add("partition", "string"))
        from_path = F.element_at(F.split(F.input_file_name(), "/"), -3)
        return union(*(f.withColumn("partition", from_path) for f in frames))

    def _load(self, form: str, paths: list[str], schema: T.StructType) -> DataFrame:
        reader = self.spark.read.schema(schema)
        return reader.option("mode", "FAILFAST").json(paths) if form == "json" else reader.parquet(*paths)


def gameweek_of(partition: str = "partition") -> dict:
    """``season`` and ``gameweek`` from names such as 2025-26-gw3 or gw3."""
    c = F.col(partition)
    season = F.nullif(F.regexp_extract(c, r"^(\d{4}-\d{2})-gw\d+$", 1), F.lit(""))
    week = F.nullif(F.regexp_extract(c, r"gw(\d+)$", 1), F.lit(""))
    return {"season": season, "gameweek": week.cast("int")}
