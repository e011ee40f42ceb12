"""The pipeline's stages on small tables, each held against brute force."""

from __future__ import annotations

import corpus_pipeline as P
import pytest

from .docs import WORD, components, frame, make
from .test_duplicates import slow_lines
from .test_resemblance import similar, slow_set


@pytest.fixture
def sf_dir(spark, tmp_path):
    frame(spark, [r for r in make(120) if r[0] not in (126, 128)]).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_stages(spark, sf_dir):
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    results = {}
    for name, stage in P.STAGES:
        out = stage(spark, before, sf_dir)
        if name != "pack":
            assert out.columns == before.columns
        results[name] = out.collect()
        before = spark.createDataFrame(results[name], out.schema)
    rows = [r for r in make(120) if r[0] not in (126, 128)]
    with_letters = {r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    named = results["language_id"]
    # the row without an id has words of none of the three languages; it may be unsure
    assert {r["doc_id"] for r in named} | {None} == with_letters
    unnamed = {r["doc_id"] for r in named} & {None}
    cut = slow_lines([(r["doc_id"], r["text"]) for r in named if r["doc_id"] is not None], 12)
    want = {i: t for i, t in cut.items() if WORD.search(t) or not WORD.search(next(r["text"] for r in named if r["doc_id"] == i))}
    lines = {r["doc_id"]: r for r in results["line_dedup"]}
    assert {i: r["text"] for i, r in lines.items() if i is not None} == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values())
    sets = {i: slow_set(r["text"]) for i, r in lines.items() if i is not None}
    root = components(list(sets), [(i, j) for i in sets for j in sets if i < j and similar(sets[i], sets[j])])
    near = {r["doc_id"] for r in results["near_dedup"]}
    assert near == {i for i in root if root[i] == i} | unnamed
    mixed = {r["doc_id"] for r in results["mix_sources"]}
    assert mixed < near and len(mixed) > 0.2 * len(near)
    assert {r["doc_id"] for r in results["pack"]} == mixed


def test_run_and_empty_table(spark, sf_dir, tmp_path):
    assert P.run(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0
