"""Licence scans: Dice coefficients of word bigrams against licence templates.

The segments of a text are its lines, its paragraphs and itself, and, in what those
that match leave, the runs of consecutive lines and sentences; comment marks are no
words.  Two sets of sizes a and b have a Dice coefficient of t at least only if the smaller is t / (2 - t) of
the larger, so a segment meets only the templates in that range.  A match must also
hold so many of a template's bigrams that it can't miss all of any subset that is
larger than the rest; a text without a word of those subsets is passed over.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: A word that stands for a matching segment, so that no run goes on behind it.
_SPENT = "\nǁ\n"
#: Ends of lines and sentences.
_UNIT = r"\n|(?<=[.!?])[\x20\x09-\x0D]+|(?<=[.!?][)\"'”’])[\x20\x09-\x0D]+"

#: Notices and first paragraphs of public licences.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-notice": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def bigram_set(text: str) -> list[str]:
    """Distinct bigrams of the lower-cased words (runs of letters and digits), as the columns have them."""
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def _words(segment: Column) -> Column:
    spaced = F.regexp_replace(F.lower(segment), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(spaced, " "), lambda x: x != "")


def _pairs(segment: Column) -> Column:
    w = _words(segment)
    # zip_with pads the shorter list, so the last pair is null and goes
    pairs = F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(pairs, lambda p: p.isNotNull())


def _bigrams(segment: Column) -> Column:
    return F.array_distinct(_pairs(segment))


def needed_words(templates: Mapping[str, list[str]], threshold: float) -> list[str]:
    """Words of which every match holds one.

    A match misses at most the share 1 - t / (2 - t) of a template's bigrams, so it
    holds one of any more than that; those with the longest words are taken.
    """
    words = set()
    for grams in templates.values():
        spare = math.floor((1 - threshold / (2 - threshold)) * len(grams) + 1e-9) + 1
        best = sorted(grams, key=lambda g: (-max(map(len, g.split())), g))[:spare]
        words |= {max(g.split(), key=len) for g in best}
    return sorted(words)


def _any_word(words: list[str]) -> str:
    by_letter = defaultdict(list)
    for w in words:
        by_letter[w[0]].append(re.escape(w[1:]))
    branches = "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in sorted(by_letter.items()))
    return rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{branches})(?![\p{{L}}\p{{N}}])"


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``license``, ``score`` and ``n_matches`` of every row.

    ``license`` is the template with the greatest Dice coefficient to a segment of the
    text (of equal ones the last by name) if that is ``threshold`` or more, else null
    with a null score; ``n_matches`` counts pairs of line, paragraph or text and template
    that reach it, and the templates that a run of lines and sentences reaches in what those leave.
    Null, empty and one-word texts match nothing; equal rows are judged alike; other
    columns are ignored; an empty table gives no rows.
    """
    grams = {k: bigram_set(v) for k, v in templates.items()}
    grams = {k: v for k, v in grams.items() if v}
    if not grams or not 0 < threshold <= 1:
        raise ValueError("templates of two words and a threshold in (0, 1] are needed")
    ratio = threshold / (2 - threshold)
    sizes = [len(v) for v in grams.values()]
    # a little room, as the coefficient itself decides
    least, most = min(sizes) * ratio - 1e-6, max(sizes) / ratio + 1e-6
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.when(text.rlike(_any_word(needed_words(grams, threshold))), text).alias("text"))
    lines = F.split("text", "\n")
    paragraphs = F.split("text", r"\n[\x20\x09-\x0D]*\n")
    segments = F.array_union(F.array_union(lines, paragraphs), F.array("text"))
    none = F.array().cast("array<string>")
    found = F.coalesce(F.when(F.col("text").isNotNull(), segments), none)
    rows = rows.select("doc_id", "text", found.alias("segments"))
    sets = F.transform("segments", lambda x: F.struct(x.alias("segment"), _bigrams(x).alias("grams")))
    rows = rows.select("doc_id", "text", F.filter(sets, lambda b: (F.size(b["grams"]) >= least) & (F.size(b["grams"]) <= most)).alias("sets"))
    known = F.array(*(F.struct(F.lit(k).alias("name"), F.array(*map(F.lit, v)).alias("grams"), F.lit(len(v)).alias("n")) for k, v in grams.items()))

    def compare(b: Column) -> Column:
        near = F.filter(known, lambda t: (F.size(b) >= t["n"] * ratio - 1e-6) & (F.size(b) * ratio <= t["n"] + 1e-6))
        return F.transform(near, lambda t: F.struct((2.0 * F.size(F.array_intersect(b, t["grams"])) / (F.size(b) + t["n"])).alias("score"), t["name"].alias("name")))

    def holds(t: Column) -> Column:
        return F.size(F.array_intersect(F.col("hits")["gram"], t["grams"])) >= t["n"] * ratio - 1e-6

    def placed(t: Column) -> Column:
        """A template with the first and last words of the lines and sentences that its bigrams touch."""
        mine = F.filter("hits", lambda h: F.array_contains(t["grams"], h["gram"]))
        first = F.array_distinct(F.flatten(F.transform(mine, lambda h: F.array(h["a"]["lo"], h["b"]["lo"]))))
        last = F.array_distinct(F.flatten(F.transform(mine, lambda h: F.array(h["a"]["hi"], h["b"]["hi"]))))
        return F.struct(t["name"].alias("name"), t["grams"].alias("grams"), t["n"].alias("n"), first.alias("first"), last.alias("last"))

    def widest(t: Column) -> Column:
        """The best score of a run of those lines and sentences whose size is within the bounds."""
        most = F.floor(t["n"] / ratio + 1e-6).cast("int")

        def score(a: Column, z: Column) -> Column:
            held = F.slice("run", a + 1, z - a)
            return 2.0 * F.size(F.array_intersect(held, t["grams"])) / (F.size(F.array_distinct(held)) + t["n"])

        def begun(a: Column, i: Column) -> Column:
            ends = F.filter(F.slice(t["last"], i + 1, most + 1), lambda z: (z - a <= most) & (z - a >= t["n"] * ratio - 1e-6))
            return F.array_max(F.transform(ends, lambda z: score(a, z)))

        return F.struct(F.array_max(F.transform(t["first"], begun)).alias("score"), t["name"].alias("name"))

    judged = F.transform("sets", lambda b: F.struct(b["segment"].alias("segment"), F.filter(compare(b["grams"]), lambda m: m["score"] >= threshold).alias("found")))
    rows = rows.select("doc_id", "text", judged.alias("judged"))
    # the text, then paragraphs, then lines
    spent = F.reverse(F.filter("judged", lambda j: F.size(j["found"]) > 0))["segment"]
    rest = F.aggregate(spent, F.col("text"), lambda whole, x: F.replace(whole, x, F.lit(_SPENT)))
    rows = rows.select("doc_id", F.flatten(F.col("judged")["found"]).alias("matches"), rest.alias("rest"))
    every = sorted({g for v in grams.values() for g in v})
    enough = F.size(F.array_intersect(_pairs(F.col("rest")), F.array(*map(F.lit, every)))) >= least
    units = F.split(F.when(enough, F.col("rest")), _UNIT)
    rows = rows.select("doc_id", "matches", F.coalesce(F.transform(units, _words), F.array().cast("array<array<string>>")).alias("units"))
    tagged = F.flatten(F.transform("units", lambda u: F.transform(u, lambda x, i: F.struct(x.alias("word"), i.alias("i"), F.size(u).alias("m")))))
    rows = rows.select("doc_id", "matches", tagged.alias("tagged"))
    spots = F.transform("tagged", lambda x, k: F.struct(x["word"].alias("word"), (k - x["i"]).alias("lo"), (k - x["i"] + x["m"] - 1).alias("hi")))
    rows = rows.select("doc_id", "matches", spots.alias("spots"))
    pairs = F.zip_with("spots", F.slice("spots", F.lit(2), F.size("spots")), lambda a, b: F.struct(F.concat(a["word"], F.lit(" "), b["word"]).alias("gram"), a.alias("a"), b.alias("b")))
    rows = rows.select("doc_id", "matches", F.filter(pairs, lambda x: x["gram"].isNotNull()).alias("pairs"))
    rows = rows.select("doc_id", "matches", F.col("pairs")["gram"].alias("run"), F.filter("pairs", lambda x: x["gram"].isin(every)).alias("hits"))
    rows = rows.select("doc_id", "matches", "run", F.transform(F.filter(known, holds), placed).alias("likely"))
    within = F.filter(F.transform("likely", widest), lambda m: m["score"] >= threshold)
    rows = rows.select("doc_id", F.concat("matches", within).alias("matches"))
    best = F.array_max("matches")
    return rows.select("doc_id", best["name"].alias("license"), best["score"].alias("score"), F.size("matches").alias("n_matches"))
