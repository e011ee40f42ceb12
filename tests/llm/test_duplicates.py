"""SimHash, embeddings, line runs and components against brute force."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from xxhash import xxh64

from tessera.llm import line_dedup, simhash, vector_dedup
from tessera.llm.common import components as spark_components

from .docs import SCHEMA, WORD, components, frame, make


def slow_fingerprint(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_against_all_pairs(spark):
    rows = make()
    got = {}
    for r in simhash.near_duplicates(frame(spark, rows).selectExpr("*", "1 AS fp", "2 AS component_id")).collect():
        got.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    prints = [(r[0], slow_fingerprint(r[1])) for r in rows]
    named = [p for p in prints if p[0] is not None]
    linked = [(a, b) for a, x in named for b, y in named if a < b and (x ^ y).bit_count() <= 4]
    root = components([i for i, _ in named], linked)
    want = {}
    for i, x in prints:
        want.setdefault(i, []).append(f"{x:016x}")
    assert {k: sorted(f for f, _ in v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    twice = {i for i, n in ((i, sum(j == i for j, _ in prints)) for i, _ in prints) if n > 1}
    for i, v in got.items():
        if i is not None and i not in twice:
            assert v[0][1] == root[i]
    assert got[None][0][1] is None
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("radius,block", [(4, 20_000), (4, 40), (2, 40)])
def test_links_lose_no_pair(spark, radius, block):
    dice = np.random.default_rng(radius)
    codes = dice.integers(0, 1 << 63, 150, dtype=np.uint64)
    ball = [int(codes[0]) ^ sum(1 << int(b) for b in dice.choice(64, int(dice.integers(0, 4)), replace=False)) for _ in range(200)]
    every = sorted({*map(int, codes), *ball})
    rows = [(c - (1 << 64) if c >> 63 else c, i) for i, c in enumerate(every)]
    edges = simhash.links(spark.createDataFrame(rows, "fp long, rep long"), radius, block)
    want = components(list(range(len(every))), [(i, j) for i, x in enumerate(every) for j in range(i) if (x ^ every[j]).bit_count() <= radius])
    got = {i: i for i in range(len(every))} | {r["node"]: r["component"] for r in spark_components(edges).collect()}
    assert got == want


@pytest.mark.parametrize("codes", [1, 10**6, 10**9, 10**12])
def test_masks_keep_the_pigeonhole(codes):
    dice = np.random.default_rng(1)
    masks = [m % (1 << 64) for m in simhash.masks(4, codes)]
    for _ in range(200):
        differ = sum(1 << int(b) for b in dice.choice(64, 4, replace=False))
        assert any(differ & m == 0 for m in masks)


def test_gray_rank_inverts_the_code():
    n = np.arange(5000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, 501 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in spark_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(101, 141)} | {501 + i: 500 for i in range(50)}
    assert spark_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("block", [4000, 30])
def test_vectors_against_all_pairs(spark, block):
    dice = np.random.default_rng(5)
    centre = dice.standard_normal((12, 16))
    v = np.concatenate([c + dice.standard_normal((12, 16)) * 0.04 * np.linalg.norm(c) for c in centre]).astype(np.float32)
    rows = [(i, v[i].tolist(), i % 2) for i in range(len(v))]
    rows += [(1000 + i, v[0].tolist(), 0) for i in range(40)] + [(2000, (v[3] * 5).tolist(), 1), (2001, v[0].tolist(), None), (2002, None, 0), (2003, [], 0), (2004, [0.0] * 16, 0)]
    rows += [(2005, [float("nan")] * 16, 0), (2006, [None] * 16, 0), (2007, v[0].tolist()[:8], 0), (2008, [1e30] * 16, 1), (2009, [2e30] * 16, 1), (2010, [1e-30] * 16, 1), (None, v[0].tolist(), 0)]
    got = {r["vec_id"]: r for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3), block=block).collect()}

    def unit(x):
        if not x or any(c is None or not np.isfinite(c) for c in x) or not any(x):
            return None
        a = np.array(x, np.float32).astype(float)
        return a / np.linalg.norm(a)

    good = [(i, unit(x), lab) for i, x, lab in rows if i is not None and lab is not None and unit(x) is not None]
    pairs = [(i, j) for a, (i, x, k) in enumerate(good) for j, y, m in good[:a] if k == m and len(x) == len(y) and x @ y >= 0.98]
    links = defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    root = components([r[0] for r in rows if r[0] is not None], pairs)
    assert len(pairs) > 300
    for i, r in got.items():
        if i is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (links[i], root[i], root[i] == i), i
    assert vector_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pairs_near_the_threshold_are_found(spark):
    dice = np.random.default_rng(11)
    a = dice.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off = dice.standard_normal(a.shape)
    off -= (off * a).sum(axis=1, keepdims=True) * a
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cos = dice.uniform(0.9801, 0.985, (len(a), 1))
    b = cos * a + np.sqrt(1 - cos * cos) * off
    rows = [(2 * i + j, v.tolist(), i % 3) for i, pair in enumerate(zip(a, b, strict=True)) for j, v in enumerate(pair)]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()
    found = sum(r["n_links"] == 1 and r["component_id"] == r["vec_id"] - 1 for r in got if r["vec_id"] % 2)
    assert found >= 0.999 * len(a)


def slow_lines(rows, least):
    """Text of each (id, text) after deleting later copies of runs of ``least`` words."""
    runs, lines = defaultdict(list), {}
    for i, text in rows:
        seq = [(k, x, len(WORD.findall(x))) for k, x in enumerate(text.split("\n"))]
        seq = lines[i] = [s for s in seq if s[2]]
        for a in range(len(seq)):
            for b in range(a + 1, len(seq) + 1):
                if sum(s[2] for s in seq[a:b]) >= least:
                    runs[tuple(s[1] for s in seq[a:b])].append((i, a, b))
    gone = defaultdict(set)
    for places in runs.values():
        first = min(p[:2] for p in places)
        for i, a, b in places:
            if (i, a) > first:
                gone[i] |= {s[0] for s in lines[i][a:b]}
    return {i: "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[i]) for i, text in rows}


@pytest.mark.parametrize("least", [1, 5, 12, 50])
def test_line_runs_against_all_runs(spark, least):
    rows = [r for r in make(40) if r[0] is not None and r[0] not in (46, 48)]
    docs = frame(spark, rows).selectExpr("*", "5 AS n_lines", "7 AS body", "8 AS lines")
    got = line_dedup.dedup_lines(docs, least).collect()
    want = slow_lines([(r[0], r[1]) for r in rows if r[1] is not None], least)
    assert {r["doc_id"]: r["text"] for r in got} == {r[0]: want.get(r[0]) for r in rows}
    assert all(r["body"] == 7 and r["lines"] == 8 for r in got)
    assert any(r["n_deleted"] for r in got) and sum(r["n_lines"] for r in got) == sum(len(r[1].split("\n")) for r in rows if r[1])


def test_line_runs_of_awkward_rows(spark):
    rows = [(None, "one two three\nfour", "en", "s", 1), (1, "one two three\nfour", "en", "s", 1), (1, "one two three\nfour", "en", "s", 1), (2, None, "en", "s", 1), (3, "", "en", "s", 1)]
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in line_dedup.dedup_lines(frame(spark, rows), 2).collect())
    assert got == sorted((str(r[0]), str(r[1])) for r in rows)
    run = "one two three\nfour five\n\nsix\nseven eight nine ten"
    rows = [(4, run, "en", "s", 1)] * 3 + [(5, "first\n" + run + "\nlast", "en", "s", 1), (4, run + "\nother", "en", "s", 1)]
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(frame(spark, rows), 4).collect())
    assert got == [(4, run)] * 3 + [(4, run + "\nother"), (5, "first\n\nlast")]
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("least", [3, 12])
def test_suffix_array_and_common_prefixes(spark, least):
    dice = np.random.default_rng(least)
    texts = {i: [f"line {dice.integers(0, 3)}" for _ in range(int(dice.integers(1, 40)))] for i in range(40)}
    texts[7][3:5] = ["only once", "and once more"]
    rows = [(i, "\n".join(x), "en", "s", 1) for i, x in texts.items()]
    lines = line_dedup.line_table(frame(spark, rows).selectExpr("doc_id", "1L AS body", "text"))
    kept = line_dedup.repeated_lines(lines, least).cache()
    places, suffixes = line_dedup.suffix_ranks(kept, least)
    deep = 1 << (least - 1).bit_length()
    rank = {(r["doc_id"], r["i"]): r["rank"] for r in kept.collect()}

    def suffix(doc, i, n):
        out = []
        while len(out) < n and (doc, i + len(out)) in rank:
            out.append(rank[doc, i + len(out)])
        return out

    found = common = {r["rank"]: r for r in line_dedup.intervals(suffixes, least).collect()}
    at = {(r["p"], r["q"]): r["rank"] for r in found.values()}
    want = {(r["doc_id"], r["i"]): suffix(r["doc_id"], r["i"], deep) for r in places.collect()}
    got = {(r["doc_id"], r["i"]): at[r["p"], r["q"]] for r in places.collect()}
    assert len(want) > 300 and (7, 3) not in want and (7, 4) not in want
    # equal ranks for equal suffixes, and one order of both
    assert len(set(got.values())) == len({tuple(s) for s in want.values()}) == len(found)
    order = sorted(want, key=lambda k: want[k])
    assert [got[k] for k in order] == sorted(got.values())
    content = {got[k]: want[k][:least] for k in want}
    ranks, starts = sorted(found), {n: None for n in range(1, least + 1)}
    for before, r in zip([None, *ranks], ranks, strict=False):
        assert found[r]["ahead"] == content[r]
        shared = next((n for n, (x, y) in enumerate(zip(content[r], content.get(before, []), strict=False)) if x != y), min(len(content[r]), len(content.get(before, []))))
        assert common[r]["lcp"] == shared
        for n in range(1, least + 1):
            if shared < n:
                starts[n] = r
        assert found[r]["starts"] == [starts[n] for n in range(1, least + 1)]
