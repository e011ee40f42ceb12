"""Token-id output: one dictionary-compressed frame for each document.

A token dataset is a folder with two Parquet tables that any file system Spark
knows can hold:

* ``dictionary``: one row with the shared zstandard dictionary, its SHA-256, the
  bytes of an id (2 or 4) and the id that ends every document;
* ``segments``: rows of about a megabyte with ``payload`` (the frames of
  consecutive documents, in ascending id order) and their offset index:
  ``doc_ids``, ``starts`` (ids before each document within the shard),
  ``n_tokens`` and ``offsets`` (of each frame in the payload, with the end last).

One document is read by its segment's index columns and one slice of the payload;
``dict_hash`` in every segment says which dictionary its frames need.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions
from .encoding import ChunkEncoder

#: Documents and bytes of each from which the dictionary is trained, and its size.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 600, 16_384, 65_536
SEGMENT_BYTES = 1_000_000

_SEGMENT = (
    "shard int, segment int, dict_hash string, doc_ids array<long>, starts array<long>,"
    " n_tokens array<long>, offsets array<int>, payload binary"
)
_DIGEST = "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def _texts(batches: Iterator[pa.RecordBatch], encoder: ChunkEncoder, end: bytes) -> Iterator[tuple[int | None, bytes]]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        yield from ((i, b + end) for i, b in zip(ids, encoder.encode(batch.column(1)), strict=True))


def _packed(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _unpacked(raw: bytes, width: int) -> bytes:
    return raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def _train(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; of too few samples, their own bytes serve as one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _codec(dictionary: bytes) -> dict:
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if len(dictionary) >= 8 else {}


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, level: int = 3,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode every whole text and write a token dataset to ``path``.

    Documents lie in ascending ``id_col`` order (nulls first; equal ids in order
    of their texts, identical rows each once more).  A null or empty text has the
    end id alone.  Other columns are ignored.  An empty table makes a dataset
    without segments.  The dictionary is trained on the documents with the
    smallest id hashes, ``SAMPLE_DOCS`` of them at most; what is stored and read
    back does not depend on it.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = int(end_id).to_bytes(4, "little")
    width = 2 if ChunkEncoder.of(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4

    chosen = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    chosen = [r[0] for r in chosen.collect()]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids in _texts(batches, ChunkEncoder.of(tokenizer), end):
            yield pa.RecordBatch.from_pydict({"raw": [_packed(ids, width)[:SAMPLE_BYTES]]})

    taken = docs.where(F.col("doc_id").isin(chosen)).mapInArrow(sample, "raw binary").limit(2 * SAMPLE_DOCS)
    dictionary = _train([bytes(r[0]) for r in taken.collect()]) if chosen else b""
    digest = hashlib.sha256(dictionary).hexdigest()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=level, **_codec(dictionary)).compress
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        names = ("doc_ids", "starts", "n_tokens", "offsets")
        index, payload = {k: [] for k in names}, bytearray()
        kind = {"doc_ids": pa.int64(), "starts": pa.int64(), "n_tokens": pa.int64(), "offsets": pa.int32()}

        def segment() -> pa.RecordBatch:
            index["offsets"].append(len(payload))
            columns = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([digest])]
            columns += [pa.array([index[k]], pa.list_(kind[k])) for k in names] + [pa.array([bytes(payload)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "segment", "dict_hash", *names, "payload"])

        for doc_id, ids in _texts(batches, ChunkEncoder.of(tokenizer), end):
            for k, v in zip(names, (doc_id, before, len(ids) // 4, len(payload)), strict=True):
                index[k].append(v)
            payload += compress(_packed(ids, width))
            before += len(ids) // 4
            if len(payload) >= SEGMENT_BYTES:
                yield segment()
                index, payload, number = {k: [] for k in names}, bytearray(), number + 1
        if index["doc_ids"]:
            yield segment()

    ordered = docs.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(segments, _SEGMENT).write.parquet(f"{path}/segments")
    head = [(digest, bytearray(dictionary), width, end_id)]
    spark.createDataFrame(head, "dict_hash string, dictionary binary, width int, end_id long").coalesce(1).write.parquet(
        f"{path}/dictionary"
    )


def _header(spark: SparkSession, path: str) -> tuple[str, bytes, int]:
    head = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(head["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != head["dict_hash"]:
        raise ValueError(f"the dictionary in {path} does not have the hash it names")
    return head["dict_hash"], dictionary, head["width"]


def _decoder(digest: str, dictionary: bytes, width: int) -> Callable[[str, bytes], bytes]:
    import zstandard

    decompress = zstandard.ZstdDecompressor(**_codec(dictionary)).decompress

    def decode(of: str, frame: bytes) -> bytes:
        if of != digest:
            raise ValueError(f"a segment needs dictionary {of}, the dataset has {digest}")
        return _unpacked(decompress(frame), width)

    return decode


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a token dataset, from its decoded frames: ``doc_id``,
    ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``."""
    header = _header(spark, path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _decoder(*header)
        for batch in batches:
            for row in range(batch.num_rows):
                shard, _, of, doc_ids, starts, n_tokens, offsets, payload = (c[row].as_py() for c in batch.columns)
                crcs = []
                for a, b, n in zip(offsets, offsets[1:], n_tokens, strict=False):
                    ids = decode(of, payload[a:b])
                    if len(ids) != 4 * n:
                        raise ValueError(f"a frame of shard {shard} has {len(ids) // 4} ids; its index says {n}")
                    crcs.append(zlib.crc32(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(crcs), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(crcs, pa.int64())],
                    ["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    segments = spark.read.parquet(f"{path}/segments").select([c.split()[0] for c in _SEGMENT.split(", ")])
    total = segments.groupBy("shard").agg(F.sum(F.expr("aggregate(n_tokens, 0L, (a, n) -> a + n)")).alias("ids"))
    # one row a shard: their number is that of the tasks that wrote
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select("shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))
    return segments.mapInArrow(decoded, _DIGEST).join(base, "shard").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this id, from one slice of a payload each."""
    decode = _decoder(*_header(spark, path))
    at = F.expr("transform(filter(sequence(0, size(doc_ids) - 1), i -> doc_ids[i] <=> doc_id), i -> struct(offsets[i] + 1 AS a, offsets[i + 1] - offsets[i] AS n))")
    hits = spark.read.parquet(f"{path}/segments").withColumn("doc_id", F.lit(doc_id).cast("long"))
    hits = hits.withColumn("at", F.explode(at)).select("dict_hash", F.expr("substring(payload, at.a, at.n)").alias("frame"))
    return [np.frombuffer(decode(r["dict_hash"], bytes(r["frame"])), "<u4").tolist() for r in hits.collect()]
