"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosines.

A table hashes a normalised vector v to the cells floor((a_i . v + b_i) / width)
of its Gaussian projections a_i (Datar et al. 2004).  Two unit vectors of cosine c
lie sqrt(2 - 2c) apart, so near ones share a cell vector in some table, and every
pair that does is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, in_blocks, map_runs, materialise, slabs, spread, unite

#: At cosine 0.98 a table has a pair together with chance 0.36 and all twenty miss
#: it with chance 1e-4; unrelated unit vectors meet in a table with chance 2e-4.
TABLES, PROJECTIONS, WIDTH, SEED = 20, 12, 2.0, 20
#: Vectors of a bucket in one block, and numbers in a matrix of products.
BLOCK, _PRODUCTS = 4_000, 2_000_000


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # no square under- or overflows
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _lengths(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def bucket_keys(rows: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """One 32-bit key for each row and table; cells that share one are one bucket."""
    dice = np.random.default_rng([seed, rows.shape[1]])
    a = dice.standard_normal((rows.shape[1], tables * projections))
    cells = np.floor((_unit(rows) @ a + dice.uniform(0, width, tables * projections)) / width).astype(np.int64)
    odd = dice.integers(0, 1 << 63, (tables, projections), dtype=np.int64) * 2 + 1
    keys = (cells.reshape(-1, tables, projections) * odd).sum(axis=2) + dice.integers(0, 1 << 63, tables, dtype=np.int64)
    return (keys >> 32).astype(np.int32)


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH,
    seed: int = SEED, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Rows are compared only when their labels and dimensions are equal; a row with a
    null label or id, or a vector that is null, empty, zero or holds null or
    non-finite components, links with nothing.  ``n_links`` counts the other rows
    linked directly, ``component_id`` is the smallest id that links reach and
    ``kept`` says that it is the row's own (true for a null id).  Equal vectors are
    compared as one and counted in full; equal rows are two vectors under one id.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("string").alias("label")
    )
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: x != 0)
    )
    # 128 bits of content name a vector; the second hash starts from the first one's seed and a salt
    content = {"c1": F.xxhash64("label", "embedding"), "c2": F.xxhash64(F.lit("tessera"), F.col("embedding"), F.col("label"))}
    rows = rows.withColumns({k: F.when(F.coalesce(usable, F.lit(False)), v) for k, v in content.items()})
    groups = rows.where("c1 is not null").groupBy("c1", "c2", "label", "embedding").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")
    )

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = _lengths(batch.column("embedding"))
            for size in np.unique(sizes):
                part = pa.Table.from_batches([batch.filter(pa.array(sizes == size))]).combine_chunks()
                for sub in part.to_batches():
                    keys = bucket_keys(_matrix(sub.column("embedding"), int(size)), tables, projections, width, seed)
                    flat = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * tables, pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([*sub.columns, flat], [*sub.schema.names, "keys"])

    kind = next(t for c, t in vectors.dtypes if c == vector_col)
    reps = materialise(groups.mapInArrow(keyed, f"c1 long, c2 long, label string, embedding {kind}, rep long, copies long, keys array<int>"))
    placed = reps.select("label", "rep", F.size("embedding").alias("wide"), F.posexplode("keys").alias("table", "key"))
    placed = placed.select(F.xxhash64("table", "key", "label", "wide").alias("bucket"), "rep", "table")

    def compare(table: pa.Table, runs: np.ndarray) -> pa.RecordBatch | None:
        size = np.diff(np.append(runs, table.num_rows))
        chunk = {c: table.column(c).combine_chunks() for c in table.column_names}
        rep, copies, at, part = (chunk[c].to_numpy() for c in ("rep", "copies", "table", "part"))
        apart = chunk["bi"].to_numpy() != chunk["bj"].to_numpy()
        keys = _matrix(chunk["keys"], tables)
        label = chunk["label"].dictionary_encode().indices.to_numpy()
        wide = _lengths(chunk["embedding"])
        flat = chunk["embedding"].flatten().to_numpy(zero_copy_only=False)
        offset = np.concatenate(([0], np.cumsum(wide)))
        unit = np.zeros((table.num_rows, wide.max()))
        for w in np.unique(wide):
            own = np.flatnonzero(wide == w)
            unit[own, :w] = _unit(flat[offset[own][:, None] + np.arange(w)])
        found, star = np.zeros(table.num_rows, np.int64), np.arange(table.num_rows)
        end = np.repeat(runs + size, size)
        here = np.arange(table.num_rows)

        def take(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal star
            ok = (label[a] == label[b]) & (wide[a] == wide[b]) & (~apart[a] | (part[a] != part[b]))
            a, b = a[ok], b[ok]
            star = unite(star, a, b)
            # a pair that meets in several tables counts in the first of them
            first = np.argmax(keys[a] == keys[b], axis=1) == at[a]
            np.add.at(found, a[first], copies[b[first]])
            np.add.at(found, b[first], copies[a[first]])

        small = np.repeat(size <= 64, size)
        for slab in slabs(np.where(small, end - here, 1), _PRODUCTS // 16):
            k, b = spread(here[slab] + 1, np.where(small[slab], end[slab], 0))
            a = slab.start + k
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            take(a[near], b[near])
        for r in np.flatnonzero(size > 64):
            lo, hi = runs[r], runs[r] + size[r]
            step = max(1, _PRODUCTS // int(size[r]))
            for i in range(lo, hi, step):
                j = min(hi, i + step)
                a, b = np.nonzero(unit[i:j] @ unit[i:hi].T >= threshold)
                for piece in slabs(np.ones(len(a), np.int64), _PRODUCTS // 4):
                    pa_, pb_ = a[piece], b[piece]
                    later = pb_ > pa_
                    take(i + pa_[later], i + pb_[later])
        some = (found > 0) | (star != here)
        return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[star[some]]), pa.array(found[some])], ["u", "v", "found"])

    # rows of ids find out who shares a bucket; only those that do get their vectors, in one exchange
    dealt = in_blocks(placed, "bucket", "rep", block).join(reps.select("rep", "copies", "label", "embedding", "keys"), "rep")
    met = map_runs(dealt, ["bucket", "bi", "bj"], compare, "u long, v long, found long", 50_000)
    met = materialise(met)
    near = met.groupBy("u").agg(F.sum("found").alias("near"))
    joined = components(met.select("u", "v"))
    result = (
        reps.select("c1", "c2", "rep", "copies")
        .join(near, F.col("rep") == near["u"], "left")
        .join(joined, F.col("rep") == joined["node"], "left")
        .select("c1", "c2", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("root"))
    )
    component = F.coalesce("root", "vec_id")
    return rows.join(result, ["c1", "c2"], "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
