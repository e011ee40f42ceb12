"""Near copies against brute-force Jaccard similarity, and the pipeline's stage that uses them."""

from __future__ import annotations

import random

import corpus_pipeline as P

from tessera.llm import resemblance

from .docs import SCHEMA, components, frame


def slow_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or bool(a and b) and 10 * len(a & b) >= 8 * len(a | b)


def edited(n: int = 60, seed: int = 3) -> list[tuple]:
    """Texts of 5 to 400 words with none to six words changed, cut off or put in."""
    dice = random.Random(seed)
    word = lambda: "".join(dice.choices("abcdefghij", k=6))
    rows = []
    for k in range(n):
        base = [word() for _ in range(dice.choice([5, 20, 60, 150, 400]))]
        for v in range(4):
            w = list(base)
            for _ in range(v * 2):
                at = dice.randrange(len(w))
                w[at : at + dice.randint(0, 1)] = [word()] if dice.random() < 0.7 else []
                w = w or [word()]
            rows.append((4 * k + v, " ".join(w), "en", "s", 1))
    dice.shuffle(rows)
    return rows + [(2000, "", "en", "s", 1), (2001, None, "en", "s", 1), (2002, " One two", "en", "s", 1), (2003, "one  TWO", "en", "s", 1), (3, rows[5][1], "en", "s", 1)]


def test_stage_keeps_one_of_each_group_of_similar_texts(spark, monkeypatch):
    rows = edited()
    sets = [(r[0], slow_set(r[1])) for r in rows]
    linked = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if a != b and similar(x, y)]
    root = components(sorted({r[0] for r in rows}), linked)
    assert sum(similar(x, y) and x != y for i, (_, x) in enumerate(sets) for _, y in sets[:i]) > 80
    docs = spark.createDataFrame([*rows, (None, rows[0][1], "en", "s", 1)], SCHEMA)
    got = {r["doc_id"] for r in P.near_dedup(spark, docs, "").collect()}
    assert got == {i for i in root if root[i] == i} | {None}
    grouped = {r["doc_id"]: r["component_id"] for r in resemblance.near_copies(docs, block=3).collect()}
    assert all(grouped[i] == root[i] for i in root if i != 3) and grouped[None] is None
    assert P.near_dedup(spark, frame(spark, []), "").count() == 0


def test_sets_that_differ_from_the_first_of_their_band_still_meet(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(w[k : k + 40]), "en", "s", 1) for k in range(0, 20, 3)]
    got = {r["component_id"] for r in resemblance.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0}


def test_near_copies_come_through_the_simhash_index(spark):
    rows = edited(20)
    sets = {k: resemblance.shingles(r[1]) for k, r in enumerate(rows)}
    prints = {k: resemblance.folded(s) for k, s in sets.items()}
    signed = lambda fp: fp - (1 << 64) if fp >> 63 else fp
    codes = spark.createDataFrame([(k, signed(fp)) for k, fp in prints.items()], "code long, fp long")
    pairs = [(r["hub"], r["code"]) for r in resemblance.indexed(codes, 6).collect()]
    within = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 6]
    assert components(list(prints), pairs) == components(list(prints), within)
    assert any(prints[a] != prints[b] for a, b in within)


def test_what_the_index_finds_is_confirmed_and_linked_without_a_band(spark, monkeypatch):
    near = [(1, " ".join(f"w{i}" for i in range(300)), "en", "s", 1), (2, " ".join(f"w{i}" for i in range(302)), "en", "s", 1)]
    far = [(3, " ".join(f"v{i}" for i in range(300)), "en", "s", 1)]
    whole = resemblance._signatures
    # bands that no two sets share, and one fingerprint for all
    none = lambda docs, shingle: whole(docs, shingle).selectExpr("doc_id", "print", "code", "n", "0L AS fp", f"transform(sequence(1, {resemblance.BANDS}), i -> xxhash64(code, i)) AS bands")
    monkeypatch.setattr(resemblance, "_signatures", none)
    got = {r["doc_id"]: r["component_id"] for r in resemblance.near_copies(spark.createDataFrame(near + far, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
