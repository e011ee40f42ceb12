"""Small documents with awkward cases, and helpers shared by the tests."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(dice: random.Random, n: int, lang: str = "en") -> str:
    parts = {"en": ["the", "th", "ing", "er", "and", "wh"], "de": ["sch", "ung", "die", "ein", "ü", "keit"], "fr": ["eau", "que", "le", "ou", "é", "ment"]}[lang]
    return " ".join("".join(dice.choices(parts, k=dice.randint(1, 4))) for _ in range(n))


def make(n: int = 60, seed: int = 1) -> list[tuple]:
    """Documents in three languages with copies, repeated lines, nulls, empties, ties and long texts."""
    dice = random.Random(seed)
    passage = sentence(dice, 60) + ".\n" + sentence(dice, 9) + "."
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        text = "\n".join(sentence(dice, dice.randint(3, 40), lang) + "." for _ in range(dice.randint(1, 6)))
        if i % 7 == 0:
            text += "\n" + passage
        if i % 10 == 9:
            text = rows[i // 2][1]
        rows.append((i, text, lang, f"s{i % 4 if i % 2 else 0}"))
    rows += [
        (n, None, "en", "s0"), (n + 1, "", "en", None), (n + 2, " \t\n \n", None, "s1"), (n + 3, "12 34 !!", "de", "s1"), (n + 4, "ümlaut", None, None),
        (n + 5, "\n".join(["again and again it goes on"] * 50), "en", "s2"), (n + 6, sentence(dice, 6000), "en", "s0"), (n + 6, "same id, other text", "en", "s0"),
        (n + 7, "x" * 5000, "en", "s3"), (n + 8, rows[3][1], "en", "s0"), (None, "no id at all but some words here", "en", "s0"), (n + 9, "a b\tc\r\nd  e <|endoftext|>", "fr", "s1"),
    ]
    return [(*r, len(r[1] or "")) for r in rows] + [(n + 8, rows[3][1], "en", "s0", len(rows[3][1]))]


def frame(spark, rows=None):
    return spark.createDataFrame(make() if rows is None else rows, SCHEMA).repartition(3)


def components(ids: list[int], pairs) -> dict[int, int]:
    """Smallest id reachable from each, by repeated merging."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
