"""Trie of the prefixes that conversations share, built depth by depth.

Equal conversations are one class with a weight; a level of the trie groups the
classes that are still together by (parent node, next turn) and names each group by
its smallest conversation id.  A class that is alone in its group goes on as a chain,
whose nodes follow from its turns without another level, so the number of levels is
the longest prefix that two *different* conversations share.  Leaves and savings are
rolled up by joins of one level with the next, from the deepest.

Every conversation is numbered over sorted ranges of turns, so one that holds a third
of all rows is spread over tasks; groups are partial aggregates, and what goes back to
their members is a join by key, which AQE splits where it is skewed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, partitions, stored

#: Conversation ids that are joined into one string: those that differ in these low bits alone.
ID_BITS = 16
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``t`` (place from 1), ``digest``, ``bytes`` and ``cum`` (bytes so far) of each turn.

    Turns of a conversation are ordered by ``turn``, null first; equal numbers by the
    digest of role and text.  Null roles and texts are empty; rows without a
    conversation id belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.octet_length(text).cast("long").alias("bytes"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "digest"]
    dealt = turns.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("range", F.spark_partition_id())
    dealt = stored(dealt, "turns")  # from here on a turn keeps its range
    inside = Window.partitionBy("conv_id", "range").orderBy(F.asc_nulls_first("turn"), "digest").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    before = before.select("conv_id", "range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("n", "b")))
    own = dealt.withColumns({"_n": F.count(F.lit(1)).over(inside), "_b": F.sum("bytes").over(inside)})
    own = own.join(before, ["conv_id", "range"]).select("conv_id", (F.col("_n") + F.col("n")).alias("t"), "digest", "bytes", (F.col("_b") + F.col("b")).alias("cum"))
    own = stored(own, "numbered")
    discard(dealt)
    return own


def rebuild(rows: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share heads: the first h turns of conversation c - c % ``group``,
    then c's own turns after its first h, where h = crc32(c) % ``most``.

    Returns the turns (``conv_id``, ``d`` from 1, ``digest``, ``bytes``, ``cum``) and the
    conversations (``conv_id``, ``len``, ``total`` bytes), turnless ones among them.
    """
    own = numbered(rows)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    ends = own.groupBy("conv_id").agg(F.max("t").alias("n"), F.max("cum").alias("all"), *(F.coalesce(F.max(F.when(F.col("t") <= i, F.col("cum"))), F.lit(0)).alias(f"c{i}") for i in range(1, most)))
    ends = ends.withColumn("heads", F.array(F.lit(0), *(f"c{i}" for i in range(1, most)))).select("conv_id", "n", "all", "heads")
    bases = ends.where(F.pmod("conv_id", F.lit(group)) == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("heads").alias("base_heads"))
    plans = ends.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(group))).withColumn("h", h).join(bases, "base", "left")
    shared = F.least("h", F.coalesce("base_n", F.lit(0)))
    shift = F.coalesce(F.get("base_heads", F.col("h").cast("int")), F.lit(0)) - F.get("heads", F.col("h").cast("int"))
    plans = plans.withColumn("k", shared).select(
        "conv_id", "base", "h", "k", shift.alias("shift"), (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"), (F.col("all") + shift).alias("total")
    )
    plans = stored(plans, "plans")
    heads = own.where((F.pmod("conv_id", F.lit(group)) == 0) & (F.col("t") < most)).withColumnRenamed("conv_id", "base")
    first = plans.where("k > 0").join(heads, "base").where("t <= h").select("conv_id", F.col("t").alias("d"), "digest", "bytes", "cum")
    rest = own.join(plans.select("conv_id", "h", "k", "shift"), "conv_id").where("t > h")
    rest = rest.select("conv_id", (F.col("t") - F.col("h") + F.col("k")).alias("d"), "digest", "bytes", (F.col("cum") + F.col("shift")).alias("cum"))
    turns, conversations = stored(first.union(rest), "rebuilt"), plans.select("conv_id", "len", "total")
    discard(own)
    return turns, conversations


def classes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conv_id`` with the smallest id (``rep``) of the conversations of the same turns.

    Sequences are told apart by their length and the sums of two 60-bit parts of the
    SHA-256 of (place, turn): sums need neither an order nor a whole conversation in one task.
    """
    mark = F.sha2(F.concat(F.col("d").cast("string").cast("binary"), F.lit(b":"), F.col("digest")), 256)
    parts = [F.conv(F.substring(mark, a, 15), 16, 10).cast("decimal(38,0)") for a in (1, 16)]
    signs = turns.groupBy("conv_id").agg(*(F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)))
    rows = conversations.join(signs, "conv_id", "left").na.fill(0, ["s0", "s1"])
    reps = rows.groupBy("len", "s0", "s1").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("w"), F.min("total").alias("total"))
    return rows.drop("total").join(reps, ["len", "s0", "s1"]).select("conv_id", "rep", "w", "len", "total")


def ends(members: DataFrame) -> DataFrame:
    """SHA-256 (``ends_sha256``) of each class's ids, ascending and joined by commas.

    Ids are joined within bounded ranges by Spark; a task then feeds the pieces of a
    class to the hash one after another, so it holds one piece at a time.
    """
    together = members.groupBy("rep", F.shiftright("conv_id", ID_BITS).alias("range"))
    joined = together.agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            reps, out = batch.column(0).to_pylist(), []
            for rep, ids in zip(reps, batch.column(2), strict=True):
                if rep != last:
                    if state:
                        out.append((last, state.hexdigest()))
                    last, state = rep, hashlib.sha256(ids.as_py().encode())
                else:
                    state.update(b"," + ids.as_py().encode())
            yield _ends(out)
        if state:
            yield _ends([(last, state.hexdigest())])

    dealt = joined.select("rep", "range", "ids").repartition("rep").sortWithinPartitions("rep", "range")
    return dealt.mapInArrow(hashed, "rep long, ends_sha256 string")


def _ends(out: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([s for _, s in out], pa.string())], ["rep", "ends_sha256"])


def build(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Every node of the trie of ``turns`` (``conv_id``, ``d`` = 1.., ``digest``, ``bytes``,
    ``cum``) over ``conversations`` (``conv_id``, ``len``, ``total``), one row a conversation.

    A node is named by its smallest member and its depth: ``conv_id``, ``depth``,
    ``parent_conv_id`` (root: null), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (over its subtree, (members - 1) times the bytes of the last turn)
    and ``ends_sha256`` (of the ids that end there).  No conversations: no rows.
    """
    members = stored(classes(turns, conversations), "classes")
    reps = stored(members.where("conv_id = rep").select("rep", "w", "len", "total"), "reps")
    own = turns.withColumnRenamed("conv_id", "rep").join(reps, "rep")
    own = stored(own.select("rep", "d", "digest", "bytes", "cum", "w", "len", "total").sortWithinPartitions("d"), "steps")
    top = reps.agg(F.min("rep").alias("conv_id"), F.sum("w").alias("n_convs"), F.count(F.lit(1)).alias("n")).where("n > 0")
    top = stored(top.select("conv_id", "n_convs", "n"), "root")

    # down: at each depth the classes still together, by parent node and next turn
    node = F.broadcast(top.select(F.col("conv_id").alias("node")))  # one row
    levels, live, together = [], [], reps.select("rep").crossJoin(node)
    ended = [reps.where("len = 0").select("rep").crossJoin(node).select("node", F.lit(0).alias("depth"), "rep")]
    while True:
        d = len(levels) + 1
        steps = stored(together.join(own.where(F.col("d") == d), "rep"), "live")
        found = steps.groupBy("node", "digest").agg(
            F.min("rep").alias("conv_id"), F.sum("w").alias("n_convs"), F.count(F.lit(1)).alias("n"),
            *(F.min(c).alias(c) for c in ("bytes", "cum", "total")),
        )
        found = stored(found, "level")
        levels.append(found)
        live.append(steps)
        if found.where("n > 1").isEmpty():
            break
        shared = found.where("n > 1").select("node", "digest", F.col("conv_id").alias("child"))
        together = steps.join(shared, ["node", "digest"]).select("rep", F.col("child").alias("node"), "len")
        ended.append(together.where(F.col("len") == d).select("node", F.lit(d).alias("depth"), "rep"))
        together = together.where(F.col("len") > d).select("rep", "node")

    # up: sums of the children, then the node's own
    nodes, sums = [], None
    for d in range(len(levels), -1, -1):
        if d:
            here = levels[d - 1].select("conv_id", F.col("node").alias("parent_conv_id"), "n_convs", "n", "bytes", "cum", "total")
        else:
            here = top.select("conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n", *(F.lit(0).cast("long").alias(c) for c in ("bytes", "cum", "total")))
        if sums is None:
            here = here.withColumns({"n_children": F.lit(0).cast("long"), "leaves": F.lit(0).cast("long"), "below": F.lit(0).cast("long")})
        else:
            here = here.join(sums, "conv_id", "left")
        alone = F.col("n") == 1
        if not d:  # the root of a single class has that class's chain below it
            alone = F.lit(False)
        saved = (F.col("n_convs") - 1) * F.when(alone, F.col("total") - F.col("cum") + F.col("bytes")).otherwise(F.col("bytes"))
        here = here.withColumns({
            "n_children": F.coalesce("n_children", F.lit(0)), "n_leaves": F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)), "saved_tokens": saved + F.coalesce("below", F.lit(0)),
        })
        here = stored(here.select("conv_id", "parent_conv_id", "n_convs", "n", "n_children", "n_leaves", "saved_tokens"), "rolled")
        nodes.append(here.where("n > 1" if d else "true").select("conv_id", F.lit(d).cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"))
        sums = here.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))

    # chains: a class from the depth at which it is alone
    starts = None
    for d, found in enumerate(levels, 1):
        one = found.where("n = 1").select(F.col("conv_id").alias("rep"), F.lit(d).alias("start"), F.col("node").alias("above"))
        starts = one if starts is None else starts.union(one)
    chain = own.join(starts, "rep").where("d >= start").select(
        F.col("rep").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.when(F.col("d") == F.col("start"), F.col("above")).otherwise(F.col("rep")).alias("parent_conv_id"),
        F.col("w").alias("n_convs"), (F.col("d") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("w") - 1) * (F.col("total") - F.col("cum") + F.col("bytes"))).alias("saved_tokens"),
    )

    at = starts.join(reps, "rep").select(F.col("rep").alias("node"), F.col("len").alias("depth"), "rep")
    for one in ended:
        at = at.union(one)
    at = at.join(ends(members), "rep").select(F.col("node").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "ends_sha256")
    at = stored(at, "ends")
    discard(members, *live)
    every = chain
    for one in nodes:
        every = every.union(one)
    out = every.join(at, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return out.select(*names)
