"""Packing token sequences by a configuration linear program over lengths.

The histogram of piece lengths, whose size is bounded by the capacity, is all that
the driver sees.  The lengths are grouped linearly into classes of about equally many
pieces, each as long as its longest; the shortest lengths, a small share of the
tokens, stay out.  A covering program chooses how often to use each configuration (a
multiset of classes that fits one sequence): weights that fall exponentially as a
class is covered price the classes, and a knapsack recursion finds for each class the
best configuration that holds it, until the cover is within ``GAP`` of the dual bound.
The fractional numbers are rounded to whole ones along their running sum, and each
sequence of a configuration is filled with real pieces of its classes, the last one
the longest that fits.  Best fit then places what is left, mostly the shortest pieces,
in the gaps.  Spark numbers the pieces of each length and looks up the slot of every
number.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions
from .encoding import ChunkEncoder

#: Classes at most, sizes that the knapsack tells apart at most, and the share of the
#: tokens, in the shortest pieces, that best fit places.
CLASSES, SIZES, SMALL = 100, 1024, 0.005
#: Fall of the weights by coverage, coverage that a round adds at most, how far from the
#: best a configuration may be to be used, the gap to the dual bound that ends the
#: rounds, and their greatest number.
FALL, STEP, NEAR, GAP, ROUNDS = 5.0, 0.05, 0.005, 0.05, 400

Group = tuple[int, list[tuple[int, int]]]


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every whole text, append ``end_id`` and cut what exceeds ``capacity``.

    Returns ``doc_id``, ``piece`` (from 0), ``start`` (ids of its document before
    it), ``length`` and ``ids_crc32`` (of little-endian unsigned 32-bit ids).  A
    null or empty text is one piece of one id.
    """
    end, step = int(end_id).to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _knapsack(size: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room the greatest total price, and the item to take first (-1 for none).

    ``size`` ascends.  Of equally good items the largest is taken.
    """
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(size, np.arange(capacity + 1), side="right").tolist()
    for room in range(1, capacity + 1):
        n = fitting[room]
        best[room] = best[room - 1]
        if n:
            sums = best[room - size[:n]] + price[:n]
            take = n - 1 - int(sums[::-1].argmax())
            if sums[take] > best[room]:
                best[room], pick[room] = sums[take], take
    return best, pick


def _taken(pick: list[int], size: list[int], room: int, first: int | None = None) -> list[int]:
    """How often each item is taken in ``room``, item ``first`` once at least."""
    chosen = [0] * len(size)
    if first is not None:
        chosen[first], room = 1, room - size[first]
    while room > 0:
        if pick[room] >= 0:
            chosen[pick[room]] += 1
            room -= size[pick[room]]
        else:
            room -= 1
    return chosen


def best_configuration(price: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths of greatest total price that fits.

    ``price[l]`` is the price of length l; -inf where the length does not occur.
    """
    size = np.flatnonzero(price > -np.inf)
    _, pick = _knapsack(size, price[size], capacity)
    taken = _taken(pick.tolist(), size.tolist(), capacity)
    return {int(n): k for n, k in zip(size, taken, strict=True) if k}


def cover(size: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The covering program by multiplicative weights.

    ``demand`` items of each ``size`` (ascending) are to be covered.  Returns the
    configurations (times of each size), how often to use each, fractional and so that
    every demand is met, and a lower bound of that number of any cover.
    """
    demand, sizes = demand.astype(float), size.tolist()
    covered, used, bound = np.zeros(len(size)), defaultdict(float), 0.0
    for _ in range(ROUNDS):
        # at first an item is worth its size, the dual solution if every sequence were full
        weight = demand * size * np.exp(-FALL * (covered - covered.mean()))
        price = weight / demand
        best, pick = _knapsack(size, price, capacity)
        bound = max(bound, weight.sum() / best[capacity])
        good = np.flatnonzero(price + best[capacity - size] >= (1 - NEAR) * best[capacity])
        pick = pick.tolist()
        found = np.unique([_taken(pick, sizes, capacity, k) for k in good.tolist()], axis=0)
        together = found.sum(axis=0)
        for one in found:
            held = one > 0
            times = STEP * (demand[held] / together[held]).min()
            used[tuple(one.tolist())] += times
            covered += times * one / demand
        if covered.min() > 0 and sum(used.values()) / covered.min() <= (1 + GAP) * bound:
            break
    else:
        # a class that no round came to is covered by sequences of its own
        for k in np.flatnonzero(covered < covered.max() / 2).tolist():
            alone = [0] * len(sizes)
            alone[k] = capacity // sizes[k]
            used[tuple(alone)] += (covered.max() - covered[k]) * demand[k] / alone[k]
            covered[k] = covered.max()
    return np.array(list(used)), np.array(list(used.values())) / covered.min(), float(bound)


def classes(counts: np.ndarray) -> np.ndarray:
    """The longest length of each class, ascending; classes hold about equally many pieces."""
    lengths = np.flatnonzero(counts)
    if len(lengths) <= CLASSES:
        return lengths
    upto = np.cumsum(counts[lengths])
    of = (upto - 1) * CLASSES // upto[-1]
    return lengths[np.append(np.flatnonzero(np.diff(of)), len(lengths) - 1)]


def program(counts: np.ndarray, capacity: int) -> tuple[list[Group], np.ndarray]:
    """Groups of sequences by the rounded program, and the histogram that they leave."""
    tokens = np.cumsum(counts * np.arange(capacity + 1))
    large = np.where(tokens > SMALL * tokens[-1], counts, 0)
    left, groups = counts.tolist(), []
    if not tokens[-1]:
        return groups, counts
    top = classes(large)
    demand = np.add.reduceat(large, np.concatenate(([0], top[:-1] + 1)))
    # sizes in grains, rounded up; a piece always fits alone
    grain = -(-capacity // SIZES)
    size = np.minimum(-(-top // grain), capacity // grain)
    merged = np.unique(size)
    if len(merged) < len(size):  # classes that the grain does not tell apart
        top = top[np.searchsorted(size, merged, side="right") - 1]
        demand, size = np.add.reduceat(demand, np.searchsorted(size, merged)), merged
    found, times, _ = cover(size, demand, capacity // grain)
    # as many sequences as the tokens fill; rounded along the running sum, longest classes first
    times = times / times.sum() * int(large @ np.arange(capacity + 1)) / capacity
    order = np.lexsort(found.T)[::-1]
    whole = np.diff(np.floor(np.cumsum(np.concatenate(([0.5], times[order])))).astype(np.int64))
    have = np.flatnonzero(large).tolist()

    def longest(most: int, held: dict[int, int]) -> int:
        """The longest length up to ``most`` with a piece to spare, 0 for none."""
        at = bisect_right(have, most) - 1
        while at >= 0 and held[have[at]] >= left[have[at]]:
            at -= 1
        return have[at] if at >= 0 else 0

    for one, n in zip(found[order].tolist(), whole.tolist(), strict=True):
        slots = [int(top[k]) for k in range(len(one) - 1, -1, -1) for _ in range(one[k])]
        while n and have:
            held, room = defaultdict(int), capacity
            for most in [*slots[:-1], capacity]:
                if length := longest(min(most, room), held):
                    held[length] += 1
                    room -= length
            while length := longest(room, held):
                held[length] += 1
                room -= length
            held = {k: t for k, t in held.items() if t}
            many = min(n, *(left[k] // t for k, t in held.items()))
            groups.append((many, sorted(held.items(), reverse=True)))
            n -= many
            for k, t in held.items():
                left[k] -= many * t
                if not left[k]:
                    have.pop(bisect_left(have, k))
    return groups, np.array(left)


def best_fit(left: np.ndarray, capacity: int, opened: Iterable[Group] = ()) -> list[Group]:
    """Best fit decreasing over a histogram, into the gaps of ``opened`` sequences first.

    Returns groups of sequences with equal contents, those of ``opened`` included.
    """
    gaps: dict[int, list[Group]] = defaultdict(list)
    open_gaps: list[int] = []

    def put(gap: int, group: Group) -> None:
        if not gaps[gap]:
            insort(open_gaps, gap)
        gaps[gap].append(group)

    for many, held in opened:
        put(capacity - sum(n * t for n, t in held), (many, held))
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = bisect_left(open_gaps, length)
            if at < len(open_gaps):
                gap = open_gaps[at]
                many, held = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(at)
            else:
                gap, many, held = capacity, -(-n // (capacity // length)), []
            fit = gap // length
            full = min(many, n // fit)
            if full:
                put(gap - fit * length, (full, [*held, (length, fit)]))
                n -= full * fit
                many -= full
            if many and n and n < fit:
                put(gap - n * length, (1, [*held, (length, n)]))
                n, many = 0, many - 1
            if many and held:
                put(gap, (many, held))
    return [g for groups in gaps.values() for g in groups]


def solve(histogram: dict[int, int], capacity: int) -> list[Group]:
    """Groups (how many sequences, [(length, times), ...]) that hold every piece once."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    groups, left = program(counts, capacity)
    return best_fit(left, capacity, groups)


def _slots(groups: list[Group]) -> pd.DataFrame:
    """For each length the slots of its pieces, by consecutive numbers."""
    rows, taken, sequence = [], defaultdict(int), 0
    for many, held in groups:
        offset = 0
        for length, times in held:
            first = taken[length]
            taken[length] += many * times
            rows.append((length, first, taken[length], times, sequence, offset))
            offset += length * times
        sequence += many
    return pd.DataFrame(rows, columns=["length", "first", "last", "times", "sequence", "base"], dtype="int64")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``capacity`` ids.

    ``pieces`` has the columns of :func:`token_pieces`; they are read several times, so
    pass a table or a checkpoint.  Pieces lie gapless from offset 0; equal rows are
    packed each, and so are rows with null ids.  Other columns stay, columns with the
    names of the added ones are replaced.  An empty table gives no rows.
    """
    spark = pieces.sparkSession
    rows = pieces.groupBy("length").count().collect()  # one row for each length up to the capacity
    groups = solve({r["length"]: r["count"] for r in rows}, capacity)
    slots = _slots(groups)
    slots = spark.createDataFrame(slots, "length long, first long, last long, times long, sequence long, base long")
    # pieces of one length are numbered within salted parts, so a common length is no single task's
    key = ["doc_id", "piece", "ids_crc32"]
    salt = F.pmod(F.xxhash64(*key), F.lit(max(64, 4 * partitions(spark)))).cast("int")
    salted = pieces.select(F.struct("*").alias("row"), "length", *key, salt.alias("salt"))
    part = Window.partitionBy("length", "salt")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    numbered = salted.withColumn("at", F.row_number().over(part.orderBy(*key)) - 1)
    numbered = numbered.join(sizes, ["length", "salt"]).withColumn("at", F.col("at") + F.col("earlier"))
    # a few slots for each length up to the capacity, whatever the corpus
    inside = (numbered["length"] == slots["length"]) & (F.col("at") >= F.col("first")) & (F.col("at") < F.col("last"))
    return numbered.join(F.broadcast(slots), inside).select(
        *(F.col("row").getField(c).alias(c) for c in pieces.columns if c not in ("sequence_id", "offset")),
        (F.col("sequence") + F.expr("(at - first) div times")).alias("sequence_id"),
        (F.col("base") + F.pmod(F.col("at") - F.col("first"), F.col("times")) * numbered["length"]).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Encode, cut and pack whole documents; see :func:`token_pieces` and :func:`pack`."""
    return pack(materialise(token_pieces(docs, tokenizer, capacity, end_id)), capacity)
