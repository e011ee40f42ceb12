"""Text quality by nearest-neighbour votes in a latent-semantic space.

A text is its counts of hashed byte trigrams, of four-grams of character kinds and of
distances between equal words, damped, weighted by inverse document frequency and projected on the leading singular
vectors of a bounded labelled sample.  The sample's vectors are broadcast (their
number and width are parameters), and every document's cosine with all of them is one
block of a matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that are learned, hash buckets of each kind of gram,
#: latent dimensions, neighbours that vote and the power of the cosine that weights them.
PER_CLASS, BUCKETS, DIMENSIONS, NEIGHBOURS, POWER = 2000, 2048, 64, 15, 4
#: Buckets of the distance to the last equal word (powers of two, then none), and their weight.
DISTANCES, REPEAT_WEIGHT = 16, 10.0
_BLOCK_ROWS, _BLOCK_BYTES = 256, 4_000_000


def _kinds() -> np.ndarray:
    """Kind of each byte: letters by case, digits, bytes beyond ASCII; marks are their own."""
    kind = np.arange(256, dtype=np.uint32)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 1, 2, 3, 4
    return kind


_KINDS = _kinds()
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MIX = np.random.default_rng(0).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_distances(raw: np.ndarray) -> np.ndarray:
    """How many words have their last equal one 1, 2-3, 4-7, ... words before, or none."""
    inside = np.flatnonzero(~_SPACES[raw])
    out = np.zeros(DISTANCES, np.float32)
    if not len(inside):
        return out
    first = np.flatnonzero(np.diff(inside, prepend=-2) > 1)
    size = np.diff(np.append(first, len(inside)))
    place = np.arange(len(inside)) - np.repeat(first, size)
    mixed = (raw[inside].astype(np.uint64) + np.uint64(1)) * _MIX[place % 64] * (place // 64 + 1).astype(np.uint64)
    names = np.add.reduceat(mixed, first)
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    back = (order[1:] - order[:-1])[same]
    at = np.minimum(np.log2(back).astype(np.int64), DISTANCES - 2)
    out += np.bincount(at, minlength=DISTANCES)
    out[DISTANCES - 1] = len(names) - len(back)
    return out


def width(buckets: int = BUCKETS) -> int:
    return 2 * buckets + DISTANCES


def gram_counts(texts: list[str | None], buckets: int = BUCKETS) -> np.ndarray:
    """log(1 + count) of the hashed grams and word distances of every whole text."""
    out = np.zeros((len(texts), width(buckets)), np.float32)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for i, text in enumerate(texts):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        b, k = raw.astype(np.uint32), _KINDS[raw]
        if len(b) > 2:
            three = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(0x9E3779B1) >> shift
            out[i, :buckets] = np.bincount(three, minlength=buckets)
        if len(b) > 3:
            four = (k[:-3] | k[1:-2] << np.uint32(8) | k[2:-1] << np.uint32(16) | k[3:] << np.uint32(24)) * np.uint32(0x85EBCA77) >> shift
            out[i, buckets : 2 * buckets] = np.bincount(four, minlength=buckets)
        out[i, 2 * buckets :] = word_distances(raw)
    np.log1p(out, out=out)
    out[:, 2 * buckets :] *= REPEAT_WEIGHT
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


@dataclass
class Neighbours:
    """Latent vectors of labelled texts, and what projects others among them."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float
    neighbours: int = NEIGHBOURS

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, population: dict[int, int], dimensions: int = DIMENSIONS, seed: int = 2) -> Neighbours:
        """From gram counts and 0/1 labels; ``population`` counts all labelled rows of each class."""
        total = sum(population.values())
        prior = population.get(1, 0) / total if total else 0.5
        seen = (counts > 0).sum(axis=0)
        idf = np.log((1 + len(counts)) / (1 + seen)).astype(np.float32)
        rows = _unit(counts * idf)
        # subspace iteration for the leading right singular vectors
        dice = np.random.default_rng(seed)
        basis = dice.standard_normal((rows.shape[1], min(dimensions, rows.shape[1]))).astype(np.float32)
        for _ in range(6):
            basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
        weights = np.ones(len(labels), np.float32)
        for label, n in population.items():
            own = labels == label
            weights[own] = n / max(1, own.sum())
        return cls(idf, basis.astype(np.float32), _unit(rows @ basis), labels.astype(np.float32), weights, prior)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the votes of the nearest labelled texts."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        # in double precision and rounded, as sums of another block order may differ in the last digit
        near = (_unit(_unit(counts * self.idf).astype(np.float64) @ self.basis) @ self.vectors.T.astype(np.float64)).round(9)
        k = min(self.neighbours, near.shape[1])
        top = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k :]
        votes = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** POWER * self.weights[top]
        total = votes.sum(axis=1)
        share = (votes * self.labels[top]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.where(total > 0, share, self.prior)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Neighbours:
    """Learn from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``label`` 0/1).

    At most ``per_class`` rows of each label, those with the smallest id hashes, are
    read; null ids and labels are left out, an id with several labels has the greatest,
    one with several texts the least.
    """
    labels = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("label"))
    population = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    chosen = None
    for label in sorted(population):
        some = labels.where(F.col("label") == label).orderBy(F.xxhash64(F.lit("fit"), "doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.union(some)
    if chosen is None:
        return Neighbours.fit(np.zeros((0, width()), np.float32), np.zeros(0, np.float32), population)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK_ROWS):
                part = batch.slice(at, _BLOCK_ROWS)
                rows = gram_counts(part.column("text").to_pylist()).astype(np.float16)
                packed = pa.array([r.tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), packed], ["doc_id", "label", "grams"])

    # at most two times per_class rows: of the texts of one id the least
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = sample.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = sample.mapInArrow(counted, "doc_id long, label int, grams binary").toArrow().sort_by("doc_id")
    flat = b"".join(found.column("grams").to_pylist())
    grams = np.frombuffer(flat, np.float16).reshape(-1, width()).astype(np.float32)
    return Neighbours.fit(grams, found.column("label").to_numpy(), population)


def score(docs: DataFrame, model: Neighbours) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: likelier good) of every row, from its whole text.

    A null or empty text, and one too short for a gram, gets the share of label 1
    among all that was learned from (0.5 where that is nothing).  Equal texts score
    alike; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held, size = [np.zeros(0)], [], 0
            for t in batch.column(1):
                held.append(t.as_py())
                size += len(held[-1] or "")
                if len(held) >= _BLOCK_ROWS or size > _BLOCK_BYTES:
                    out.append(shared.value.score(gram_counts(held)))
                    held, size = [], 0
            if held:
                out.append(shared.value.score(gram_counts(held)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(np.concatenate(out), 0, 1), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, "doc_id long, score double")
