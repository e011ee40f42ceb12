"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints that differ in at most ``radius`` bits agree on one of the masked
bit patterns that the pigeonhole principle names; a pattern is the root of a
subtree and the key by which Spark deals fingerprints to tasks.  Inside a task the
codes of each root are sorted by Gray rank and grouped into two more levels of
nodes; a node factors out the bits on which all codes below it agree.  A search
adds up the differences from level to level, over the bits that a level adds, and
drops a whole group once they exceed the radius.  (After the HA-index of Tang et
al., EDBT 2015.)
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, in_blocks, map_runs, materialise, slabs, spread, unite

#: Codes below a node of the two inner levels, and codes of a root in one block.
GROUP, SUPER, BLOCK = 16, 256, 20_000
_FRONTIER = 2_000_000


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the runs of ``shingle`` words of a text, in order and with repeats.

    A-Z are lower-cased, words are runs of other than ASCII white space; a text of
    fewer than ``shingle`` words has itself as its shingle, one of none has none.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    span = min(shingle, len(words))
    return np.array([xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(starts, starts[span:], strict=False)], "<u8")


def folded(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of hashes: bits set in over half of them; of none 0."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.uint32) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint of a text, from all its :func:`shingle_hashes`."""
    return folded(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], ["doc_id", "fp"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(hashed, "doc_id long, fp long")


def masks(radius: int, codes: int) -> list[int]:
    """Masks such that two codes within ``radius`` agree on one, as signed longs.

    ``b`` blocks of bits leave b - radius untouched ones.  The least b above the
    radius is taken for which a pattern holds about ``GROUP`` x ``SUPER`` of evenly
    spread codes; every choice finds the same pairs.
    """
    blocks = radius + 1
    while blocks < 16 and codes >> (64 * (blocks - radius) // blocks) > GROUP * SUPER:
        blocks += 1
    edge = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    chosen = (sum(c) for c in combinations(part, blocks - radius))
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _nodes(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared bits of the codes from each of ``at`` to the next: values and masks."""
    every, some = np.bitwise_and.reduceat(codes, at), np.bitwise_or.reduceat(codes, at)
    return every, ~(every ^ some)


def near_pairs(codes: np.ndarray, runs: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a < b) of positions in the same run within ``radius`` bits.

    ``codes`` are sorted by run and Gray rank; ``runs`` are the runs' starts.
    """
    size = np.diff(np.append(runs, len(codes)))
    inside = np.arange(len(codes)) - np.repeat(runs, size)
    super_at, group_at = np.flatnonzero(inside % SUPER == 0), np.flatnonzero(inside % GROUP == 0)
    (sv, sm), (gv, gm) = _nodes(codes, super_at), _nodes(codes, group_at)
    group_super = np.searchsorted(super_at, group_at, side="right") - 1
    residual = gm & ~sm[group_super]  # bits that a group adds to its parent's
    super_groups = np.append(np.searchsorted(group_at, super_at), len(group_at))
    ends = np.append(group_at, len(codes))
    own = np.searchsorted(super_at, np.arange(len(codes)), side="right") - 1
    last = np.repeat(np.searchsorted(super_at, runs + size), size)
    for slab in slabs((last - own) * SUPER, _FRONTIER * 8):
        base = slab.start
        q, s = spread(own[slab], last[slab])
        d = np.bitwise_count((codes[base + q] ^ sv[s]) & sm[s])
        near = d <= radius
        q, s, d = q[near], s[near], d[near]
        for part in slabs(super_groups[s + 1] - super_groups[s], _FRONTIER // GROUP):
            k, g = spread(super_groups[s[part]], super_groups[s[part] + 1])
            kq = q[part][k]
            kd = d[part][k] + np.bitwise_count((codes[base + kq] ^ gv[g]) & residual[g])
            near = (kd <= radius) & (ends[g + 1] - 1 > base + kq)
            kq, g = kq[near], g[near]
            k, leaf = spread(ends[g], ends[g + 1])
            a = base + kq[k]
            near = (leaf > a) & (np.bitwise_count(codes[a] ^ codes[leaf]) <= radius)
            yield a[near], leaf[near]


def links(codes: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Links that join what lies within ``radius`` bits, from distinct codes.

    ``codes``: ``fp`` and ``rep``, a long that names it.  Of the pairs that meet in
    a block, one spanning star for each class is returned (``u``, ``v``), so their
    closure is that of all pairs and no group is expanded into its pairs.
    """
    bound = codes.count()
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(radius, bound))]
    rooted = codes.withColumn("root", F.explode(F.array(*keys)))

    def star(table: pa.Table, runs: np.ndarray) -> pa.RecordBatch:
        reps, fp, part = (table.column(c).to_numpy() for c in ("rep", "fp", "part"))
        code = fp.view(np.uint64)
        run = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(fp))))
        order = np.lexsort((gray_rank(code), run))
        code, part = code[order], part[order]
        apart = (table.column("bi").to_numpy() != table.column("bj").to_numpy())[order]
        label = np.arange(len(code))
        for a, b in near_pairs(code, runs, radius):
            met = ~apart[a] | (part[a] != part[b])
            label = unite(label, a[met], b[met])
        linked = label != np.arange(len(code))
        reps = reps[order]
        return pa.RecordBatch.from_arrays([pa.array(reps[linked]), pa.array(reps[label[linked]])], ["u", "v"])

    return map_runs(in_blocks(rooted, "root", "fp", block), ["root", "bi", "bj"], star, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Two documents are linked when their fingerprints differ in at most ``radius``
    bits; the component is the smallest id that links reach.  Null and empty texts
    have fingerprint zero and are linked like any other.  Equal rows are one
    document met twice and stay two rows.  A null id names no document: the row
    keeps its fingerprint, takes part in no link and has a null component.  Other
    columns are ignored; an empty table gives no rows.
    """
    hashed = materialise(fingerprints(docs, shingle, id_col, text_col))
    codes = materialise(hashed.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(codes, radius))
    root = codes.join(found, codes["rep"] == found["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return hashed.join(root, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
