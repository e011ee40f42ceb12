"""CSV and wide-table readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """RFC 4180 text: all columns strings, of equal headers the first, short rows filled with ''."""
    raw = spark.read.csv(path, header=False, quote='"', escape='"', multiLine=True, nullValue="\0")
    head = raw.first()
    names = list(head) if head else []
    first: dict[str, str] = {}
    for n, c in zip(names, raw.columns, strict=False):
        if n is not None:
            first.setdefault(n, c)
    body = spark.read.csv(path, header=True, schema=raw.schema, quote='"', escape='"', multiLine=True, nullValue="\0", enforceSchema=True)
    return body.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for n, c in first.items()))


def write_csv(df: DataFrame, path: str, most: int | None = None) -> None:
    """Header and rows; a missing value is empty."""
    (df if most is None else df.limit(most)).write.csv(path, header=True, quote='"', escape='"', nullValue="")


def quotes_long(df: DataFrame, keys: list[str], columns: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Wide bookmaker columns as rows: ``columns`` maps one to (bookmaker, market, selection).

    A price of 1 or less is absent.
    """
    each = F.array(*(F.struct(F.lit(b).alias("bookmaker"), F.lit(m).alias("market"), F.lit(s).alias("selection"), F.col(c).cast("double").alias("decimal")) for c, (b, m, s) in columns.items()))
    return df.select(*keys, F.explode(each).alias("e")).select(*keys, "e.*").where("decimal > 1")


def kickoff(day: Column, time: Column) -> Column:
    """UTC time of a day-first date (two- or four-digit year) and a London time, 15:00 if none."""
    text = F.concat(day, F.lit(" "), F.coalesce(F.nullif(time, F.lit("")), F.lit("15:00")))
    wall = F.coalesce(F.try_to_timestamp(text, F.lit("dd/MM/yyyy HH:mm")), F.try_to_timestamp(text, F.lit("dd/MM/yy HH:mm")))
    return F.to_utc_timestamp(wall, "Europe/London")
