"""Near copies: the SimHash index, then exact Jaccard similarity of word shingles.

Candidates come from the Gray-order index of :mod:`simhash`, over the fingerprints of
the sets of shingles.  Fingerprints of sets at the threshold differ in more bits than
any index of 64 can search, so what is beyond its radius also meets in bands of
minimum hashes: two sets of similarity s share one of ``BANDS`` bands of ``ROWS``
minima with chance 1 - (1 - s^ROWS)^BANDS, so a pair at 0.8 is missed with chance
1.3e-7 and a closer one more rarely.  A candidate of either kind is linked only if the
similarity of its sets, counted exactly, reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, forget, in_blocks, map_runs, stored
from .simhash import folded, shingle_hashes
from .simhash import links as index_links

SHINGLE, THRESHOLD = 5, 0.8
#: Bits in which fingerprints that the index joins differ at most.
RADIUS = 4
BANDS, ROWS = 40, 5
#: Sets of one band in one block.
BLOCK = 1000
_ODD = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SLAB = 4096


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``shingle`` words, as :mod:`simhash` has them."""
    return np.unique(shingle_hashes(text, shingle))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed long for each band; none for an empty set."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return []
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _SLAB):
        np.minimum(least, (_ODD[:, None] * hashes[None, at : at + _SLAB]).min(axis=1), out=least)
    keys = [xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _signed(data: bytes) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(data, 7)
    return h - (1 << 64) if h >> 63 else h


def _similar(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= threshold * (len(x) + len(y) - both) - 1e-9


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id``, ``print`` (a hash of the text), ``code`` (a hash that names the set), ``n`` (its size), ``fp`` (its fingerprint) and ``bands``."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            sets = [shingles(t.as_py(), shingle) for t in batch.column(2)]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([_signed(s.tobytes()) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([folded(s) for s in sets], np.uint64).view(np.int64)),
                pa.array([bands(s) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "code", "n", "fp", "bands"])

    return docs.mapInArrow(signed, "doc_id long, print long, code long, n long, fp long, bands array<long>")


def indexed(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs of sets (``hub``, ``code``) that join all whose fingerprints the index finds within ``radius`` bits.

    ``codes``: ``code`` and ``fp``.  Sets of one fingerprint are joined with the least of them.
    """
    least = stored(codes.groupBy("fp").agg(F.min("code").alias("rep")), "prints")
    apart = index_links(least, radius).select(F.col("v").alias("hub"), F.col("u").alias("code"))
    same = codes.join(least, "fp").where("code <> rep").select(F.col("rep").alias("hub"), "code")
    return stored(apart.union(same).distinct(), "indexed")


def _confirmed(shared: DataFrame, hubs: DataFrame, found: DataFrame, texts: DataFrame, shingle: int, threshold: float, block: int) -> DataFrame:
    """Links between the pairs ``found`` by the index, and between sets and the hub of each of their bands, the set that most others meet.

    Those of the index alone have a ``near`` of 0.  A hub with over ``block`` sets to
    compare is sent to several tasks.
    """
    small, large = F.least("n", "hub.n"), F.greatest("n", "hub.n")
    met = shared.join(hubs, "band").where((F.col("code") != F.col("hub.code")) & (small >= threshold * large - 1e-9))
    named = met.select(F.col("hub.code").alias("hub"), "code", F.col("hub.rep").alias("u"), F.col("rep").alias("v"), F.col("hub.near").alias("near"))
    pairs = stored(named.distinct().unionByName(found), "pairs")
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("parts"))
    dealt = pairs.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("code"), F.col("parts"))).drop("parts")
    heads = dealt.select("hub", "part").distinct().withColumn("code", F.col("hub")).withColumns({c: F.lit(0).cast("long") for c in ("u", "v", "near")})
    rows = dealt.unionByName(heads).join(texts.select("code", "text"), "code")

    def linked(table: pa.Table, runs: np.ndarray) -> pa.RecordBatch:
        hub, code, text = table.column("hub").to_numpy(), table.column("code").to_numpy(), table.column("text")
        close = np.zeros(len(code), bool)
        for lo, hi in zip(runs, np.append(runs[1:], len(code)), strict=True):
            head = lo + int(np.flatnonzero(code[lo:hi] == hub[lo])[0])
            held = shingles(text[head].as_py(), shingle)
            for i in range(lo, hi):
                close[i] = i != head and _similar(held, shingles(text[i].as_py(), shingle), threshold)
        kept = table.select(["hub", "code", "u", "v", "near"]).filter(pa.array(close))
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in kept.columns], kept.column_names)

    return stored(map_runs(rows, ["hub", "part"], linked, "hub long, code long, u long, v long, near long", block), "near")


def _apart(shared: DataFrame, hubs: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of the bands that hold more than one ``label``, a set that links lead to.

    The hub of a band was compared with all others there, so it is left out.
    """
    label = links.where("near > 0").groupBy("code").agg(F.max_by("hub", F.struct("near", "hub")).alias("label"))
    label = stored(label, "labels")
    # a hub's own hub comes after it in the order, so this goes up
    for _ in range(2):
        up = label.select(F.col("code").alias("label"), F.col("label").alias("up"))
        label = label.join(up, "label", "left").select("code", F.coalesce("up", "label").alias("label"))
    others = shared.join(hubs.select("band", F.col("hub.code").alias("head")), "band").where("code <> head")
    rows = others.select("band", "code", "n", "rep").join(label, "code", "left").withColumn("label", F.coalesce("label", "code"))
    mixed = rows.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return stored(rows.join(mixed.select("band"), "band"), "apart")


def _in_bands(rows: DataFrame, texts: DataFrame, shingle: int, threshold: float, block: int) -> DataFrame:
    """Links between sets of one band that differ in ``label``, one for each two labels met.

    Bands over ``block`` sets are dealt as pairs of blocks; a task compares the sets that
    it holds and joins them as it goes, so no list of pairs is made.  Sets that share
    several bands are compared in the first.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            held = pa.array([shingles(t.as_py(), shingle).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), held, batch.column(2)], ["code", "held", "bands"])

    def linked(table: pa.Table, runs: np.ndarray) -> pa.RecordBatch:
        band, n, rep, label, part = (table.column(c).to_numpy() for c in ("band", "n", "rep", "label", "part"))
        label, apart = label.copy(), table.column("bi").to_numpy() != table.column("bj").to_numpy()
        held = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("held")]
        places = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(n), BANDS)
        found = []
        for lo, hi in zip(runs, np.append(runs[1:], len(n)), strict=True):
            here = int(np.flatnonzero(places[lo] == band[lo])[0])
            for i in range(lo, hi):
                near = (label[i:hi] != label[i]) & (~apart[i] | (part[i:hi] != part[i]))
                near &= np.minimum(n[i:hi], n[i]) >= threshold * np.maximum(n[i:hi], n[i]) - 1e-9
                at = i + np.flatnonzero(near)
                for j in at[(places[at] == places[i]).argmax(axis=1) == here].tolist():
                    if label[i] != label[j] and _similar(held[i], held[j], threshold):
                        found.append((rep[i], rep[j]))
                        run = label[lo:hi]
                        run[run == label[j]] = label[i]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    sets = texts.join(rows.select("code").distinct(), "code", "left_semi").select("code", "text", "bands").mapInArrow(made, "code long, held binary, bands array<long>")
    dealt = in_blocks(rows, "band", "code", block).join(sets, "code")
    return map_runs(dealt, ["band", "bi", "bj"], linked, "u long, v long", block)


def near_copies(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, block: int = BLOCK, radius: int = RADIUS) -> DataFrame:
    """``doc_id`` and ``component_id`` of every row.

    Documents are linked when the Jaccard similarity of their shingle sets is
    ``threshold`` or more; the component is the smallest id that links reach.  Texts
    without a word are copies of each other.  A null id takes part in no link and has
    a null component.  Rows of one id are linked, whatever their texts.  Pairs of the
    SimHash index within ``radius`` bits, and sets and the hub of each of their bands,
    are compared first; those of a band that hubs have not joined are all compared with
    each other.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = read.select("doc_id", F.xxhash64("text").alias("print"), "text")
    signed = stored(_signatures(read, shingle), "signatures")
    named = signed.where("doc_id is not null")
    # equal sets are one: its bands and size are any row's
    first = F.min(F.struct("doc_id", "print")).alias("first")
    codes = named.groupBy("code").agg(first, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    codes = stored(codes.select("code", "n", "fp", "bands", F.col("first.doc_id").alias("rep"), F.col("first.print").alias("print")), "sets")
    banded = codes.select(F.explode("bands").alias("band"), "code", "n", "rep")
    several = banded.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    near = F.sum("m").over(Window.partitionBy("code")).alias("near")
    shared = stored(banded.join(several, "band").select("band", "code", "n", "rep", near), "bands")
    pairs = indexed(codes.select("code", "fp"), radius)
    for c, name in (("hub", "u"), ("code", "v")):
        pairs = pairs.join(codes.select(F.col("code").alias(c), F.col("n").alias(f"n_{name}"), F.col("rep").alias(name)), c)
    sized = F.least("n_u", "n_v") >= threshold * F.greatest("n_u", "n_v") - 1e-9
    pairs = stored(pairs.where(sized).select("hub", "code", "u", "v", F.lit(0).cast("long").alias("near")), "candidates")
    # all steps read these texts, so they are taken out of the others once
    wanted = shared.select("code").union(pairs.select("code")).union(pairs.select("hub")).distinct()
    met = codes.drop("fp").join(wanted, "code", "left_semi").withColumnRenamed("rep", "doc_id")
    texts = read.join(met, ["doc_id", "print"]).dropDuplicates(["doc_id", "print", "code"])
    texts = stored(texts.select("code", "text", "bands"), "texts")
    hub = F.max_by(F.struct("code", "n", "rep", "near"), F.struct("near", "code")).alias("hub")
    hubs = stored(shared.groupBy("band").agg(hub), "hubs")
    links = _confirmed(shared, hubs, pairs, texts, shingle, threshold, block)
    rest = stored(_in_bands(_apart(shared, hubs, links), texts, shingle, threshold, block), "links")
    found = components(links.select("u", "v").union(rest))
    root = codes.select("code", "rep").join(found, F.col("rep") == F.col("node"), "left")
    root = root.select("code", F.coalesce("component", "rep").alias("component_id"))
    return signed.select("doc_id", "code").join(root, "code", "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )
