"""Mixing sources to target weights by iterative proportional fitting.

Token weights are added up in cells of source, language and topic, and the cells are
raked: scaled in turn to each target marginal until all hold.  No cell can give more
tokens than it has, so a scale is solved for with that bound: cells that are full keep
their own weight, and the others make up for them within the same marginal.  A cell's
sampling probability is what is taken of it over what it has; a document is kept by a
hash of its id, so the draw repeats exactly.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, words

MARGINS = ("source", "lang", "topic")
#: Share of the tokens to keep, power of the shares that are the default targets, and how
#: far from its own share to all that the budget could take of it a default target may go.
FRACTION, POWER, ROOM = 0.5, 0.5, 0.5
#: Sweeps between checkpoints, the error that ends them, and the share of an error that
#: must be left after a checkpoint for the targets to count as out of reach.
SWEEPS, TOLERANCE, STALLED = 5, 1e-7, 0.98
#: The budget that is tried next where the targets are out of reach.
SHRINK = 0.8
#: Cells that one task rakes and that are broadcast; more are dealt out and shuffled.
FEW_CELLS = 50_000


def topic_of(text: Column) -> Column:
    """A coarse topic by the form of a text; the first that fits."""
    text = F.coalesce(text, F.lit(""))
    spread = F.length(text) - F.length(F.replace(text, F.lit(" | "), F.lit("")))
    marks = F.length(text) - F.length(F.translate(text, "#*$%&", ""))
    return (
        F.when(F.length(text) < 200, "brief")
        .when(spread * 10 > F.length(text), "table")
        .when(marks * 10 > F.length(text), "markup")
        .when(text.rlike("[A-Za-z0-9._]@[A-Za-z0-9]"), "contact")
        .when(F.length(text) > 4000, "long")
        .otherwise("prose")
    )


def annotate(docs: DataFrame, text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """Add ``topic`` (by :func:`topic_of`, a text's form, unless a column is given) and
    ``n_tokens`` (words) to every row; columns so named are replaced."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.withColumns({"topic": topic_of(text) if topic is None else topic, "n_tokens": F.size(words(text)).cast("long")})


def _key(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def _keys() -> dict[str, Column]:
    return {f"k_{m}": _key(m) for m in MARGINS}


def _scale(by: list[str], order: list[str], weight: str, most: str, total: Column) -> Column:
    """The factor of ``weight`` within ``by`` for which the least of weight and ``most`` add up to ``total``.

    If the rows that are full first, in order of most over weight, are held at ``most``,
    the rest needs (total - theirs) / rest; the factor is the greatest of these.
    """
    within = Window.partitionBy(*by)
    ranked = within.orderBy(F.try_divide(F.col(most), F.col(weight)).asc_nulls_last(), *order)
    before = F.coalesce(F.sum(most).over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(weight).over(ranked.rowsBetween(0, Window.unboundedFollowing))
    return F.try_divide(total - before, rest)


def _sweep(cells: DataFrame) -> DataFrame:
    keys = [f"k_{m}" for m in MARGINS]
    for k, m in zip(keys, MARGINS, strict=True):
        cells = cells.withColumn("_scale", _scale([k], keys, "raked", "most", F.col(f"t_{m}")))
        factor = F.greatest(F.lit(0.0), F.coalesce(F.max("_scale").over(Window.partitionBy(k)), F.lit(1.0)))
        cells = cells.withColumn("raked", F.col("raked") * factor)
    return cells.drop("_scale")


def calibrate(
    annotated: DataFrame, targets: Mapping[str, Mapping[str | None, float]] | None = None, fraction: float = FRACTION, power: float = POWER
) -> DataFrame:
    """``k_source``, ``k_lang``, ``k_topic`` and ``probability`` of every cell, with its share
    ``base`` of the tokens and the targets ``t_source``, ``t_lang`` and ``t_topic``.

    ``targets`` may give weights for the values of a margin (a value without one gets
    0).  A margin that it leaves out has its shares of the tokens to the ``power``,
    normed, but asks of a value with few tokens for no more than ``ROOM`` allows.
    Expected tokens are ``fraction`` of all, or less if given targets ask for more of a
    value than it has; the budget then shrinks until the targets are met.  Where no
    budget meets them (cells that they need are empty) a warning names the greatest error,
    and :func:`expected` tells that of every margin.
    """
    spark = annotated.sparkSession
    cells = annotated.groupBy(*(k.alias(n) for n, k in _keys().items())).agg(F.sum("n_tokens").cast("double").alias("base"))
    cells = materialise(cells.where("base > 0"))
    size = cells.agg(F.count(F.lit(1)).alias("n"), F.sum("base").alias("tokens")).first()
    # of few cells one task holds all, and no window needs an exchange
    one = (lambda df: df.coalesce(1)) if size["n"] <= FEW_CELLS else (lambda df: df)
    cells = one(cells).withColumn("base", F.col("base") / F.lit(size["tokens"] or 1.0))
    margins = {m: one(cells.groupBy(f"k_{m}").agg(F.sum("base").alias("has"))) for m in MARGINS}  # a row a value
    for m in (m for m in MARGINS if targets and m in targets):
        norm = sum(targets[m].values()) or 1.0
        rows = [("" if k is None else f"={k}", float(v) / norm) for k, v in targets[m].items()]
        given = F.broadcast(spark.createDataFrame(rows, f"k_{m} string, t_{m} double"))
        margins[m] = margins[m].join(given, f"k_{m}", "left").fillna(0.0, [f"t_{m}"])
        # the budget has no more of a value than there is
        least = margins[m].where(f"t_{m} > 0").agg(F.min(F.col("has") / F.col(f"t_{m}"))).first()[0]
        fraction = fraction if least is None else min(fraction, least)
    for m, values in margins.items():
        if f"t_{m}" not in values.columns:
            values = values.withColumns({"most": F.col("has") * (1 + ROOM * (1 / fraction - 1)), "want": F.pow("has", F.lit(power))})
            values = values.withColumn("_scale", _scale([], [f"k_{m}"], "want", "most", F.lit(1.0)))
            values = values.withColumn(f"t_{m}", F.least("most", F.col("want") * F.max("_scale").over(Window.partitionBy())))
        cells = one(cells.join(values.select(f"k_{m}", f"t_{m}"), f"k_{m}"))
    cells = materialise(cells.withColumns({"raked": F.col("base"), "most": F.col("base") / fraction}))
    before = None
    while True:
        raked = one(cells)
        for _ in range(SWEEPS):
            raked = _sweep(raked)
        taken = F.least("raked", "most")
        off = [F.abs(F.sum(taken).over(Window.partitionBy(f"k_{m}")) - F.col(f"t_{m}")) for m in MARGINS]
        cells = materialise(raked.withColumn("off", F.greatest(*off)))
        worst, full = cells.agg(F.max("off"), F.count_if(F.col("raked") > F.col("most"))).first()
        if worst is None or worst <= TOLERANCE:
            break
        if before is not None and worst > STALLED * before:
            if not full:
                warnings.warn(f"the targets are not met: a margin is off by {worst:.3g} of all that is kept", stacklevel=2)
                break
            fraction, before = SHRINK * fraction, None
            cells = materialise(cells.withColumns({"raked": F.col("base"), "most": F.col("base") / fraction}))
            continue
        before = worst
    probability = F.least(F.lit(1.0), F.col("raked") / F.col("most"))
    return cells.select(*(f"k_{m}" for m in MARGINS), probability.alias("probability"), "base", *(f"t_{m}" for m in MARGINS))


def expected(cells: DataFrame) -> DataFrame:
    """``margin``, ``value``, its ``target`` and ``share`` of the tokens that a sample by ``cells`` is expected to keep."""
    total = cells.agg(F.sum(F.col("probability") * F.col("base")).alias("total"))  # one row
    weighed = cells.crossJoin(F.broadcast(total))
    margins = [
        weighed.groupBy(F.lit(m).alias("margin"), F.col(f"k_{m}").alias("value")).agg(F.max(f"t_{m}").alias("target"), F.sum(F.col("probability") * F.col("base") / F.col("total")).alias("share"))
        for m in MARGINS
    ]
    return margins[0].union(margins[1]).union(margins[2])


def draw(id_col: str = "doc_id") -> Column:
    """A uniform number in [0, 1) fixed by the id."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def sample(annotated: DataFrame, cells: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add ``probability`` and ``kept`` to every annotated row.

    Rows without tokens (null and empty texts) weigh nothing: they have probability 1
    and are kept.  Null sources, languages and topics are values of their own; rows
    with equal ids are kept or dropped together; columns named ``probability`` and
    ``kept`` are replaced, all others stay; an empty table gives no rows.
    """
    cells = materialise(cells)
    small = cells.count() <= FEW_CELLS
    keys = _keys()
    carried = [c for c in annotated.columns if c not in ("probability", "kept")]
    rows = annotated.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), *(k.alias(n) for n, k in keys.items()), "n_tokens", draw(id_col).alias("draw"))
    found = rows.join(F.broadcast(cells) if small else cells, list(keys), "left")
    probability = F.when(F.col("n_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(1.0)
    return found.select(*(F.col("row").getField(c).alias(c) for c in carried), probability.alias("probability"), (F.col("draw") < probability).alias("kept"))
