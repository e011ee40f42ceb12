"""Alignment against the two libraries and plain counters."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import alignment

from .docs import frame, make

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
PARTS = ["a", "B", "The", " ", "\n", "  ", "\t", "\r", "'s", "'t", "\u00e9", "e\u0301", "\u4e2d", "\u6587\u5b57", "1.5", ".", ",", "###", "<|endoftext|>", "<s>", "<0x41>", "\u2581", "\u00a0", "\u3000", "\u2028", "\U0001f600", "\x00", "\ufb01", "don't", "\u200b", "word, ", "\x0b", "\x1c", "   x", "{\r\n", "\n\n  "]


def byte_level() -> dict[str, int]:
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}


def plain(texts):
    """Per text (groups, links as (a, b)) by the definition, from whole texts."""
    a_tok, b_tok, byte = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_level()
    a_tok.encode_special_tokens = True
    out = []
    for text in texts:
        ends, ids, spelled = [], [], []
        if text:
            found = a_tok.encode(" " + text, add_special_tokens=False)
            parts = [[bytes(byte[c] for c in t) for t in found.tokens]]
            b_ids = b_tok.encode(text)
            parts.append([bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("\u2581", " ").encode() for i in b_ids])
            ids, spelled = [found.ids, b_ids], [b"".join(p) for p in parts]
            ends = [list(accumulate(map(len, p))) for p in parts]
        if not text or spelled != [(" " + text).encode()] * 2:
            out.append(None)
            continue
        common = sorted(set(ends[0]) & set(ends[1]))
        links = [(x, y) for x, e in zip(ids[0], ends[0], strict=True) if e in set(common) for y in [ids[1][ends[1].index(e)]]]
        groups, before = [], 0
        for at in common:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids[k], ends[k], strict=True) if before < e <= at) for k in (0, 1)))
            before = at
        out.append((len(ids[0]), len(ids[1]), groups, links))
    return out


def expected(rows):
    found = plain([r[1] for r in rows])
    count = Counter(p for f in found if f for p in f[3])
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for r, f in zip(rows, found, strict=True):
        if f is None:
            out.append((r[0], 0, 0, 0, 0, 0, 0, ""))
        else:
            links = f[3]
            out.append((r[0], f[0], f[1], len(f[2]), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(f[2]).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df, **options):
    return sorted((tuple(r) for r in alignment.align(df, A, B, **options).collect()), key=repr)


def short():
    """The shared documents without the longest, and texts of odd parts."""
    dice = random.Random(4)
    rows = [r for r in make(50) if len(r[1] or "") < 6000]
    odd = ["".join(dice.choices(PARTS, k=dice.randint(1, 9))) for _ in range(150)]
    return rows + [(1000 + i, t, None, None, 0) for i, t in enumerate(odd)]


def test_equal_to_plain_counts(spark, monkeypatch):
    rows = short()
    want = expected(rows)
    names = ["batch", "pos", "stripe", "part", "links", "_", "cells"]
    assert got(frame(spark, rows).withColumns({c: F.lit("x") for c in names})) == want
    assert sum(r[4] > 0 for r in want) > 100 and sum(r[4] == 0 for r in want) > 20


def test_small_batches_and_parts_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PART_BATCHES", 1)
    rows = short()[:60]
    assert got(frame(spark, rows), stripes=7) == expected(rows)


def test_empty_table(spark):
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [(1, None, None, None, 0), (2, "", None, None, 0)])) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_chunks_align_as_the_whole(monkeypatch):
    dice = random.Random(8)
    texts = ["".join(dice.choices(PARTS, k=dice.randint(1, 14))) for _ in range(3000)]
    texts += [" ".join(dice.choices(PARTS, k=dice.randint(1, 9))) for _ in range(3000)]
    want = plain(texts)
    for memo, together in ((0, 7), (1000, 50_000)):
        monkeypatch.setattr(alignment, "MEMO_ENTRIES", memo)
        monkeypatch.setattr(alignment, "CHUNKS_AT_ONCE", together)
        aligner = alignment.Aligner(A, B)
        aligner.align(texts[2000:4000])
        found, links, per = aligner.align(texts)
        assert [f if f[0] else None for f in found] == [(w[0], w[1], hashlib.sha256(";".join(w[2]).encode()).hexdigest()) if w else None for w in want]
        assert links.tolist() == [[y, x] for w in want if w for x, y in w[3]] and per.tolist() == [len(w[3]) if w else 0 for w in want]


@pytest.mark.parametrize("text", ["x" * 50_000, "word " * 30_000])
def test_long_texts(text):
    found, _, per = alignment.Aligner(A, B).align([text])
    assert found[0][0] > 1000 and per[0] > 1000
