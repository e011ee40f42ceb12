"""The trie against plain dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, d int, rep string"


def plain(rows):
    """Nodes by the definition, over lists in memory."""
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append((t is not None, t or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(node))
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        leaves = sum(not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below) for m in below)
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def built(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = prefix_trie.build(*prefix_trie.rebuild(df)).collect()
    return sorted((tuple(r) for r in got), key=lambda r: (r[1], r[0]))


def awkward():
    """Copies, shared heads, long and turnless conversations, nulls, ties and repeated rows."""
    dice = random.Random(5)
    rows = []
    for c in range(70):
        if c % 11 == 3:
            continue
        turns = [("user" if t % 2 == 0 else "assistant", dice.choice(["hi", "yes", "no", "ünd so", "", "a longer turn of some words"])) for t in range(dice.randint(1, 12))]
        if c % 4 == 2:
            turns = [("user", "hi"), ("assistant", "yes")] * 6
        rows += [(c, t, *x, 1, "x") for t, x in enumerate(turns)]
    rows += [(100, t, "user", "chain " * (t % 3), 1, None) for t in range(60)]
    rows += [(101, None, "user", "no number", 1, None), (101, 3, None, None, 1, None), (101, 3, "user", "tie", 1, None), (101, 3, "user", "tie", 1, None)]
    rows += [(None, 0, "user", "of none", 1, None), (102, None, None, None, 1, None), (103, -4, "user", "x" * 50_000, 1, None), (2_000_000_000, 0, "user", "hi", 1, None)]
    return rows


def test_nodes_equal_plain_dictionaries(spark):
    rows = awkward()
    assert built(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[(7, 0, "user", "alone", 1, None)], [(5, t, "user", str(t), 1, None) for t in range(4)], [(c, 0, "user", "same", 1, None) for c in range(9)]])
def test_few_conversations(spark, rows):
    assert built(spark, rows) == plain(rows)


def test_no_conversations(spark):
    assert built(spark, []) == [] and built(spark, [(None, 1, "user", "x", 1, None)]) == []


def test_ids_of_one_class_in_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BITS", 2)
    rows = [(c, 0, "user", "same", 1, None) for c in range(0, 400, 5)]
    assert built(spark, rows) == plain(rows)
