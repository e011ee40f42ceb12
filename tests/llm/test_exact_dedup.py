"""Grace deduplication against a plain dictionary."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from tessera.llm import exact_dedup

from .docs import frame, make


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, sha = max(known, default=None), hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, sha))
            first = first and i != keep
    return sorted(out, key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in exact_dedup.duplicates(df, **options).collect()), key=repr)


@pytest.mark.parametrize("table_bytes", [exact_dedup.TABLE_BYTES, 30_000, 2_000])
def test_groups_equal_a_dictionary(spark, table_bytes):
    rows = make(200)
    assert found(frame(spark, rows), table_bytes=table_bytes) == plain(rows)


def test_levels_of_files_where_the_fan_is_small(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FAN", 3)
    rows = make(120)
    assert found(frame(spark, rows), table_bytes=20_000) == plain(rows)


def test_hot_texts_meet_over_several_rounds(spark):
    dice = random.Random(2)
    rows = [(i, "hot text " * 40 if i % 3 else f"text {dice.randint(0, 300)}", None, None, 0) for i in range(3000)]
    rows += [(None, "hot text " * 40, None, None, 0), (2999, "hot text " * 40, None, None, 0)] * 2
    assert found(frame(spark, rows), table_bytes=8_000) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    assert found(frame(spark, [])) == []
    from pyspark.sql import functions as F

    names = ["child", "id", "n", "code", "salt", "salted", "bucket", "above", "best", "ref", "keep", "sha", "_", "bytes"]
    rows = make(40)
    assert found(frame(spark, rows).withColumns({c: F.lit("x") for c in names})) == plain(rows)


def test_texts_of_one_hash_are_told_apart():
    table = exact_dedup.TextTable()
    texts = [f"t{i}" for i in range(3000)]
    assert [table.number(7, t) for t in texts] == list(range(3000)) and [table.number(7, t) for t in texts[:50]] == list(range(50))
