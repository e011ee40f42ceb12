"""Exact duplicates by Grace hashing.

Records are dealt by a hash of their text to spill files, a bucketed table in the
shared folder.  A bucket whose distinct texts fit an open-addressing table is read by
one task, which compares complete texts; one that does not fit is dealt again from
its files with another hash, and so on.  Each level's files are deleted once the next
ones or the verdicts are written.

Copies of a hot text are dealt to several buckets by a salt.  Each of these hands on
one record with the number of its copies and the largest id; these records are the
input of the next round, in which the text is hot no more, or less so.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, new_path, stored

#: Bytes of distinct texts that a table may hold, and buckets that one level may have.
TABLE_BYTES, FAN = 16 << 20, 50_000
#: Bytes that a record takes besides its text.
RECORD_BYTES = 64
#: A text is hot if its copies take more than this part of a table and this share of
#: all bytes, so hot texts are fewer than the share's inverse.
HOT_PART, HOT_SHARE = 32, 1e-6

_OUT = "child long, id long, best boolean, ref long, keep long, n long, sha string, salted boolean, text string"
_FIELDS = ("child", "id", "best", "ref", "keep", "n", "sha", "salted", "text")
_KINDS = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())


class TextTable:
    """Open addressing with linear probing; a text is found by its hash and then compared whole."""

    def __init__(self) -> None:
        self.slots, self.mask = [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.texts: list[str] = []

    def _free(self, code: int) -> int:
        at = (code >> 20) & self.mask  # the low bits are alike within a bucket
        while self.slots[at] >= 0:
            at = (at + 1) & self.mask
        return at

    def number(self, code: int, text: str) -> int:
        """The number of a text, from 0 in order of arrival."""
        at = (code >> 20) & self.mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == code and self.texts[k] == text:
                return k
            at = (at + 1) & self.mask
        self.slots[at] = k = len(self.texts)
        self.hashes.append(code)
        self.texts.append(text)
        if 2 * k > self.mask:
            self.mask = 2 * self.mask + 1
            self.slots = [-1] * (self.mask + 1)
            for i, h in enumerate(self.hashes):
                self.slots[self._free(h)] = i
        return k


def _judge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts on the records of one bucket: bucket, code, salted, child, id, n, text."""
    table, rows, totals, best = TextTable(), [], [], []
    first = key[0].as_py() << 32
    for batch in batches:
        codes, salted, children, ids, counts, texts = (batch.column(c).to_pylist() for c in ("code", "salted", "child", "id", "n", "text"))
        for i, text in enumerate(texts):
            k = table.number(codes[i], text)
            if k == len(totals):
                totals.append(0)
                best.append(len(rows))
            elif ids[i] is not None and (rows[best[k]][2] is None or ids[i] > rows[best[k]][2]):
                best[k] = len(rows)
            totals[k] += counts[i]
            rows.append((k, children[i], ids[i], salted[i]))
    shas = [hashlib.sha256(t.encode()).hexdigest() for t in table.texts]
    for at in range(0, len(rows), 20_000):
        columns = [[] for _ in _FIELDS]
        for number, (k, child, row_id, hot) in enumerate(rows[at : at + 20_000], at):
            wins = best[k] == number
            values = (child, row_id, wins, first + k, rows[best[k]][2], totals[k], shas[k], hot, table.texts[k] if hot and wins else None)
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], list(_FIELDS))


def _spill(records: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """The records as a table bucketed by ``bucket``, below the shared folder, and its name."""
    spark, name = records.sparkSession, f"spill_{uuid.uuid4().hex}"
    dealt = records.repartition(buckets, "bucket").write.bucketBy(buckets, "bucket")
    dealt.option("path", new_path(spark, "spill")).format("parquet").saveAsTable(name)
    return spark.table(name), name


def _drop(spilled: DataFrame, name: str) -> None:
    discard(spilled)
    spilled.sparkSession.sql(f"DROP TABLE {name}")


def _fan(total: int, table_bytes: int, most: int) -> int:
    return max(1, min(most, -(-2 * total // table_bytes)))


def _coded(records: DataFrame, level: int) -> DataFrame:
    """A hash of the text, another one at every level."""
    return records.withColumn("code", F.xxhash64(F.lit(level), F.col("text")))


def _partitioned(left: DataFrame, total: int, level: int, table_bytes: int) -> tuple[DataFrame, int]:
    """Verdicts on coded records, spilled level by level until each bucket fits, and the next level."""
    fan = _fan(total, table_bytes, FAN)
    left, parts, base, out, before = left.withColumn("above", F.lit(0)), 1, 0, None, None
    while True:
        within = F.pmod(F.xxhash64(F.lit(level), F.col("code"), F.col("salt")), F.lit(fan))
        bucket = F.lit(base) + F.col("above") * fan + within
        spilled = _spill(left.select(bucket.alias("bucket"), "code", "salt", "salted", "child", "id", "n", "text", F.octet_length("text").alias("bytes")), parts * fan)
        if before:
            _drop(*before)
        before, base, level = spilled, base + parts * fan, level + 1
        texts = spilled[0].groupBy("bucket", "code").agg(F.max("bytes").alias("bytes"))
        needs = texts.groupBy("bucket").agg(F.sum(F.col("bytes") + RECORD_BYTES).alias("bytes"), F.count(F.lit(1)).alias("texts"))
        # at most one row a bucket, so at most FAN
        over = needs.where((F.col("bytes") > table_bytes) & (F.col("texts") > 1))
        over = stored(over.withColumn("above", F.row_number().over(Window.orderBy("bucket")) - 1), "over")
        parts, worst = over.agg(F.count(F.lit(1)), F.max("bytes")).first()
        names = F.broadcast(over.select("bucket", "above"))
        fit = spilled[0].join(names, "bucket", "left_anti") if parts else spilled[0]
        judged = stored(fit.drop("bytes").groupBy("bucket").applyInArrow(_judge, _OUT), "judged")
        out = judged if out is None else out.union(judged)
        if not parts:
            _drop(*spilled)
            return out, level
        left = _coded(spilled[0].drop("bytes").join(names, "bucket"), level)
        fan = max(2, _fan(worst, table_bytes, FAN // parts))


def _salted(records: DataFrame, level: int, table_bytes: int) -> tuple[DataFrame, int]:
    """Records (child, id, n, text) with code and salt, and their bytes."""
    coded = _coded(records, level)
    size = F.octet_length("text").cast("long") + RECORD_BYTES
    sizes = stored(coded.groupBy("code").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows")), "sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    share = max(table_bytes // HOT_PART, int(HOT_SHARE * total), 1)
    salts = F.least(F.ceil(F.col("bytes") / share), F.ceil(F.col("rows") / 2)).cast("long")
    # each of these has over HOT_SHARE of all bytes, so they are fewer than its inverse
    hot = F.broadcast(sizes.where((F.col("bytes") > share) & (F.col("rows") > 3)).select("code", salts.alias("salts")))
    salt = F.pmod(F.xxhash64("id", F.spark_partition_id()), F.coalesce("salts", F.lit(1)))
    return coded.join(hot, "code", "left").select("child", "id", "n", "text", "code", salt.alias("salt"), F.col("salts").isNotNull().alias("salted")), total


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Groups of equal texts, one row for each row of ``docs``.

    Texts are equal when identical; null counts as empty.  Of equal texts the row with
    the largest id stays; null ids are smaller than all others, and of rows that share
    the largest id one stays.  Returns the id (``doc_id``), ``keep_id``, ``group_size``,
    ``kept`` and ``text_sha256``.  Other columns are ignored; an empty table gives none.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    records = docs.select(F.lit(None).cast("long").alias("child"), F.col(id_col).cast("long").alias("id"), F.lit(1).cast("long").alias("n"), text.alias("text"))
    rounds, level = [], 0
    while True:
        salted, total = _salted(records, level, table_bytes)
        judged, level = _partitioned(salted, total, level, table_bytes)
        rounds.append(judged)
        records = judged.where("salted AND best").select(F.col("ref").alias("child"), F.col("keep").alias("id"), "n", "text")
        if records.isEmpty():
            break
    verdict = None
    for judged in reversed(rounds):
        names = ["child", "id", "best", "keep", "n", "sha"]
        final = judged.where("NOT salted").select(*names)
        if verdict is not None:
            above = verdict.select(F.col("child").alias("ref"), F.col("best").alias("_best"), "keep", "n", "sha")
            parts = judged.where("salted").select("child", "id", "best", "ref").join(above, "ref")
            final = final.union(parts.select("child", "id", (F.col("best") & F.col("_best")).alias("best"), "keep", "n", "sha"))
        verdict = final
    return verdict.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), F.col("best").alias("kept"), F.col("sha").alias("text_sha256"))
