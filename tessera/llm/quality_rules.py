"""Quality rules whose cut-offs are quantiles of each language and source.

A sketch is a DDSketch (Masson et al. 2019) laid out as rows: (language, source,
measure, bucket, n), where a bucket holds values within two per thousand of it.
Sketches of any parts merge by adding ``n``, so they are made by partial
aggregation, and give the same cut-offs however the rows are dealt.  A language's
sketch is merged with the corpus's, and a group's with its language's, at the weight
of ``PRIOR`` documents, so small groups lean on what surrounds them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialise, unlike, words

#: Relative accuracy of a sketch, and documents that the wider sketch counts for.
ACCURACY, PRIOR = 0.002, 100
#: A document fails beyond a quartile of its group by more than FENCE quartile distances,
#: or by FENCE times what the measure can't tell apart where that is more.
FENCE = 4.0
SYMBOLS = "#*$%&|<>"
#: Measures of their numerator and denominator, limited above.  A share is not told from
#: others within so many counts in a document of its group's lower quartile of size.
SHARES = {
    "symbol_share": ("n_symbols", "word_chars", 8),
    "repeat_share": ("n_repeat_words", "n_words", 8),
    "dup_line_share": ("n_dup_lines", "n_words", 2),
}
#: Mean word length is limited on both sides; its deviation over n words is this / sqrt(n).
WORD_DEVIATION = 2.5
#: What :func:`text_counts` adds.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
_SYMBOL_LINE = "[^\\x20\\x09-\\x0D]"


def text_counts(docs: DataFrame, window: int = 8, text_col: str = "text") -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and
    ``n_repeat_words`` of every whole text (null: none of each).

    Hashes of word windows are built by doubling, so ``window`` is a power of two;
    only a text with an equal pair of hashes sorts them to find which words repeat.
    Arrays are columns that several expressions read, so Catalyst keeps them apart.
    """
    steps = int(math.log2(window))
    if window != 1 << steps:
        raise ValueError("window must be a power of two")
    text = F.coalesce(F.col(f"_row.`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    filled = F.filter(F.split(text, "\n"), lambda x: x.rlike(_SYMBOL_LINE))
    rows = rows.select(
        "_row", words(text).alias("w"), F.length(F.translate(text, SPACE, "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"), filled.alias("filled"),
    )
    carried = ["_row", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    rows = rows.select(
        "_row", F.size("w").alias("n_words"), "word_chars", "n_symbols",
        (F.size("filled") - F.size(F.array_distinct("filled"))).alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    for k in range(steps):
        ahead = F.slice("h", F.lit((1 << k) + 1), F.greatest(F.size("h"), F.lit(0)))
        rows = rows.select(*carried, F.zip_with("h", ahead, lambda x, y: F.xxhash64(x, y)).alias("h"))
    rows = rows.select(*carried, F.slice("h", F.lit(1), F.greatest(F.col("n_words") - (window - 1), F.lit(0))).alias("h"))
    place = "sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))"
    pairs = f"zip_with({place}, slice({place}, 2, size(h)), (x, y) -> IF(x.h = y.h, array(x.i, y.i), array()))"
    starts = f"sort_array(array_distinct(flatten({pairs})))"
    covered = f"aggregate(zip_with({starts}, slice({starts}, 2, size(h)), (x, y) -> least({window}, y - x)), 0, (s, x) -> s + x)"
    repeat = F.expr(f"IF(size(array_distinct(h)) = size(h), 0, {covered})")
    counts = {c: F.col(c) for c in carried[1:]} | {"n_repeat_words": repeat}
    return rows.select(
        *(F.col("_row").getField(c).alias(c) for c in docs.columns if c not in counts),
        *(v.cast("long").alias(c) for c, v in counts.items()),
    )


def _share(up: str, down: str) -> Column:
    return F.when(F.col(down) > 0, F.col(up) / F.col(down))


def _measures() -> dict[str, Column]:
    """Every measure that is sketched; sizes are those of documents that have any."""
    sizes = {c: F.when(F.col(c) > 0, F.col(c).cast("double")) for c in ("n_words", "word_chars")}
    return {m: _share(up, down) for m, (up, down, _) in SHARES.items()} | {"word_length": _share("word_chars", "n_words")} | sizes


def _bucket(value: Column) -> Column:
    """The sketch bucket of a value; null for zero."""
    return F.when(value > 0, F.ceil(F.ln(value) / F.lit(math.log(_GAMMA))).cast("int"))


def sketch(rows: DataFrame, by: list[str]) -> DataFrame:
    """Quantile sketch rows of every measure and group."""
    each = F.array(*(F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in _measures().items()))
    spread = rows.select(*by, F.explode(each).alias("m")).where("m.value IS NOT NULL")
    return spread.groupBy(*by, F.col("m.measure").alias("measure"), _bucket(F.col("m.value")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Add up sketches over the groups ``by``."""
    return sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def lean(sketches: DataFrame, by: list[str], wider: DataFrame, on: list[str], weight: float = PRIOR) -> DataFrame:
    """Merge every group's sketch with the ``wider`` one of the groups ``on``, as ``weight`` documents."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*on, "measure"))
    prior = wider.select(*on, "measure", "bucket", (share * weight).alias("n"))
    groups = sketches.select(*by, "measure").distinct()
    added = groups.join(prior, [*on, "measure"]).select(*by, "measure", "bucket", "n")
    return merge(sketches.select(*by, "measure", "bucket", F.col("n").cast("double").alias("n")).union(added), by)


def quartiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """``q1`` and ``q3`` of every group and measure, within ``ACCURACY``."""
    of = Window.partitionBy(*by, "measure")
    upto = of.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    value = F.coalesce(F.pow(F.lit(_GAMMA), F.col("bucket")) * (2 / (_GAMMA + 1)), F.lit(0.0))
    ranked = sketches.select(*by, "measure", value.alias("value"), F.sum("n").over(upto).alias("upto"), F.sum("n").over(of).alias("all"))
    # rounded, so that sums in another order give the same bucket
    at = {k: F.min(F.when(F.round("upto", 6) >= F.round(F.col("all") * q, 6), F.col("value"))) for k, q in (("q1", 0.25), ("q3", 0.75))}
    return ranked.groupBy(*by, "measure").agg(*(v.alias(k) for k, v in at.items()))


def cutoffs(rows: DataFrame, lang: str = "g_lang", source: str = "g_source") -> DataFrame:
    """For every language and source ``limits``: ``hi_<share>``, and the quartiles ``q1``, ``q3`` of word lengths."""
    by = [lang, source]
    own = sketch(rows, by)
    of_lang = merge(own, [lang])
    found = quartiles(lean(own, by, lean(of_lang, [lang], merge(of_lang, []), []), [lang]), by)

    def at(measure: str, q: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col(q)))

    limits = []
    for m, (_, down, counts) in SHARES.items():
        apart = F.greatest(at(m, "q3") - at(m, "q1"), counts / at(down, "q1"))
        limits.append((at(m, "q3") + FENCE * apart).alias(f"hi_{m}"))
    limits += [at("word_length", q).alias(q) for q in ("q1", "q3")]
    return found.groupBy(*by).agg(F.struct(*limits).alias("limits"))


def judge(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the counts of :func:`text_counts`, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 20 words, or over 30 per cent of the words in repeated
    eight-word windows.  ``kept``: not that, and every measure within its group's
    cut-offs.  Null languages and sources are groups of their own; a null or empty
    text has no words and fails; equal rows are judged alike; columns with the names
    of results are replaced, all others stay; an empty table gives no rows.
    """
    groups = {"g_lang": lang_col, "g_source": source_col}
    carried = [c for c in docs.columns if c not in (text_col, *COUNTS, "base_failed", "kept")]
    keyed = docs.select(
        F.struct(F.lit(0).alias(unlike(carried)), *(F.col(f"`{c}`") for c in carried)).alias("row"), F.col(f"`{text_col}`").alias("text"),
        *(F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")).alias(g) for g, c in groups.items()),
    )
    counted = materialise(text_counts(keyed, 8).drop("text"))
    judged = counted.join(cutoffs(counted), list(groups), "left")
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    within = F.lit(True)
    for m, (up, down, _) in SHARES.items():
        within &= F.coalesce(_share(up, down) <= F.col(f"limits.hi_{m}"), F.lit(True))
    q1, q3, length = F.col("limits.q1"), F.col("limits.q3"), _share("word_chars", "n_words")
    apart = FENCE * F.greatest(q3 - q1, WORD_DEVIATION / F.sqrt(F.greatest(F.col("n_words"), F.lit(1))))
    within &= F.coalesce((length <= q3 + apart) & (length >= q1 - apart), F.lit(True))
    return judged.select(
        *(F.col("row").getField(c).alias(c) for c in carried), *COUNTS, base_failed.alias("base_failed"), (~base_failed & within).alias("kept")
    )
