"""Deleting later copies of repeated line runs, by a suffix array over line ids.

Every document is a sequence of the ids of its lines that hold a word; a line that
occurs once ends it, as no repeated run goes on there.  Prefix doubling ranks the
suffixes: the ranks of 2^k lines from a place and from 2^k lines further on are a pair,
the distinct pairs are sorted by ranges, and their order is the rank of 2^(k+1) lines.
When 2^k reaches the most lines that ``min_words`` words can take, that order is the
suffix array, of distinct suffixes.  Neighbours in it give the longest common prefixes,
and the places between two prefixes shorter than n lines are an LCP interval: all
suffixes that share n lines.  Of each interval the earliest member stays, later ones
lose their n lines.

A run of ``min_words`` words or more is the union of its shortest parts that reach
``min_words``, counted from each of its lines on and up to each of its lines, so the
intervals at those lengths delete every maximal repeated run whole.  Only distinct
pairs are sorted, so copies, however many, are one row there; places get their ranks by
joins, whose hot keys are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored

#: A repeated run counts from this many words on.
MIN_WORDS = 12
_WORD = r"[^\\x20\\x09-\\x0D]+"

#: The lines that hold a word, with their place and number of words.
_SEQUENCE = f"filter(transform(split(text, '\\n'), (l, i) -> struct(i AS at, regexp_count(l, '{_WORD}') AS w, l AS line)), s -> s.w > 0)"
_PLACE = ["doc_id", "body", "run"]


def line_table(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``body``, number ``i`` among the lines with a word, line number ``at``,
    words ``w`` and the name ``p``, ``q`` (128 bits of hash) of every such line."""
    rows = docs.selectExpr("doc_id", "body", f"posexplode({_SEQUENCE}) AS (i, s)")
    return rows.selectExpr("doc_id", "body", "i", "s.at AS at", "s.w AS w", "xxhash64(s.line) AS p", "xxhash64('line', s.line) AS q")


def ranked(pairs: DataFrame) -> DataFrame:
    """Add ``rank``, from 1 on and in the order of the distinct pairs ``p``, ``q``."""
    dealt = pairs.repartitionByRange(partitions(pairs.sparkSession), "p", "q").sortWithinPartitions("p", "q")
    # ascends with the range and the place in it
    return dealt.withColumn("rank", F.monotonically_increasing_id() + 1)


def repeated_lines(lines: DataFrame, min_words: int) -> DataFrame:
    """The lines that occur again, with their ``rank``, in runs of ``min_words`` words or more."""
    again = lines.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("p", "q")
    # a row that occurs twice, id and text, is one sequence
    kept = lines.join(ranked(again), ["p", "q"]).drop("p", "q").repartition("doc_id", "body").dropDuplicates(["doc_id", "body", "i"])
    order = Window.partitionBy("doc_id", "body").orderBy("i")
    kept = kept.withColumn("run", F.col("i") - F.row_number().over(order))
    return kept.withColumn("total", F.sum("w").over(Window.partitionBy(*_PLACE))).where(F.col("total") >= min_words).drop("total")


def suffix_ranks(kept: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Places with their last pair, and the suffix array: the distinct pairs with ``rank``
    and ``ahead``, the ranks of the ``min_words`` lines from there (fewer where a run ends).

    Places have besides ``ats`` and ``ws``, the line numbers and words of those lines.
    """
    order = Window.partitionBy(*_PLACE).orderBy("i")
    places = kept.withColumn("line", F.col("rank"))
    levels = max(1, (min_words - 1).bit_length())
    for k in range(levels):
        last = k == levels - 1
        # nothing is left of a suffix at the end of its run: rank 0
        places = places.withColumns({"p": F.col("rank"), "q": F.coalesce(F.lead("rank", 1 << k).over(order), F.lit(0).cast("long"))}).drop("rank")
        if last:
            here = order.rowsBetween(0, min_words - 1)
            places = places.withColumns({a: F.collect_list(c).over(here) for a, c in (("ahead", "line"), ("ats", "at"), ("ws", "w"))})
        places = stored(places, "places")
        pairs = places.groupBy("p", "q").agg(*([F.first("ahead").alias("ahead")] if last else [F.count(F.lit(1)).alias("n")]))
        if not last:
            places = places.join(ranked(pairs.drop("n")), ["p", "q"])
    return places.drop("ahead"), stored(ranked(pairs), "suffixes")


def common_prefixes(suffixes: DataFrame) -> DataFrame:
    """Add ``lcp``, the lines (of those in ``ahead``) shared with the suffix before, and ``part``."""
    parts = suffixes.withColumn("part", F.shiftright(F.col("rank") - 1, 33))
    # one row for each range that was sorted
    before = parts.groupBy("part").agg(F.max_by("ahead", "rank").alias("last"))
    before = before.select("part", F.lag("last").over(Window.orderBy("part")).alias("last"))
    lag = F.lag("ahead").over(Window.partitionBy("part").orderBy("rank"))
    rows = parts.withColumn("previous", lag).join(F.broadcast(before), "part")
    differ = F.array_position(F.zip_with("ahead", F.coalesce("previous", "last", F.array().cast("array<bigint>")), lambda x, y: x.eqNullSafe(y)), False)
    return rows.withColumn("lcp", F.when(differ > 0, differ - 1).otherwise(F.size("ahead"))).drop("previous", "last")


def intervals(suffixes: DataFrame, depth: int) -> DataFrame:
    """Add ``starts``: for n = 1 .. ``depth`` the rank that begins the LCP interval of n lines."""
    rows = common_prefixes(suffixes)

    def begun(n: int) -> Column:
        return F.max(F.when(F.col("lcp") < n, F.col("rank")))

    names = [f"s{n}" for n in range(1, depth + 1)]
    sums = rows.groupBy("part").agg(*(begun(n).alias(c) for n, c in enumerate(names, 1)))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("part", F.array(*(F.max(c).over(earlier) for c in names)).alias("carried"))
    upto = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.array(*(begun(n).over(upto) for n in range(1, depth + 1))))
    starts = F.zip_with("within", "carried", lambda x, y: F.coalesce(x, y))
    return rows.join(F.broadcast(carried), "part").withColumn("starts", starts).drop("within", "carried")


def later_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs of ``min_words`` words, from a line on or up to it, that equal an
    earlier one, in order of (``doc_id``, line): ``doc_id``, ``body``, ``first`` and ``last`` line."""
    lines = stored(line_table(docs), "lines")
    places, suffixes = suffix_ranks(repeated_lines(lines, min_words), min_words)
    known = intervals(suffixes, min_words).select("p", "q", "starts")
    # lengths at which the words reach the least number and would not without the first or the last line
    upto = "aggregate(slice(ws, 1, n), 0L, (s, w) -> s + w)"
    lengths = f"filter(sequence(1, size(ws)), n -> {upto} >= {min_words} AND ({upto} - ws[0] < {min_words} OR {upto} - ws[n - 1] < {min_words}))"
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("at").cast("decimal(11,0)")
    named = places.withColumn("n", F.explode(F.expr(lengths))).join(known, ["p", "q"])
    named = named.select("doc_id", "body", "n", F.expr("starts[n - 1]").alias("start"), F.col("at").alias("first"), F.expr("ats[n - 1]").alias("last"), place.cast("decimal(38,0)").alias("place"))
    named = stored(named, "runs")
    shared = named.groupBy("n", "start").agg(F.min("place").alias("earliest"), F.count(F.lit(1)).alias("members")).where("members > 1")
    return named.join(shared, ["n", "start"]).where("place > earliest").select("doc_id", "body", "first", "last")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text_col``.

    A run is any sequence of consecutive lines (blank lines apart, which always stay)
    of ``min_words`` words or more that occurs earlier, in this document or in one
    with a smaller id; lines are compared exactly as they stand.  All other columns
    stay; added are ``n_lines`` and ``n_deleted`` (columns so named are replaced).
    Nulls and empty texts stay as they are and have no line.  Rows with equal ids
    count as one document: they take no lines from each other at the same place.  A
    row with a null id is left whole.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("body"),
    )
    source = packed.select("doc_id", "body", F.col("_row").getField(text_col).cast("string").alias("text"))
    source = source.where("text IS NOT NULL AND doc_id IS NOT NULL")
    cuts = later_runs(source, min_words).groupBy("doc_id", "body").agg(F.collect_set(F.struct("first", "last")).alias("cuts"))
    joined = packed.join(cuts, ["doc_id", "body"], "left")
    joined = joined.select("_row", "cuts", F.split(F.col("_row").getField(text_col).cast("string"), "\n").alias("lines"))
    inside = "flatten(transform(cuts, c -> sequence(c.first, c.last)))"
    blank = f"filter(transform(lines, (l, i) -> IF(l RLIKE '{_WORD}', NULL, i)), i -> i IS NOT NULL)"
    joined = joined.select("_row", "lines", F.expr(f"IF(cuts IS NULL, NULL, array_except({inside}, {blank}))").alias("gone"))
    left = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\\n')")
    body = F.col("_row").getField(text_col)
    text = F.when(F.col("gone").isNull(), body).otherwise(left)
    return joined.select(
        *(text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in kept),
        F.when(body.isNull() | (body == ""), 0).otherwise(F.size("lines")).alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_deleted"),
    )
