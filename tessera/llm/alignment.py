"""Which tokens of two tokenizers end together, and how often over all documents.

A batch of documents is encoded with both tokenizers; its links (token pairs whose
byte ranges end together) are counted per document and packed by stripes of B ids, a
B id's stripe being its remainder, so that frequent ids, which have small numbers, lie
in different stripes.  The count matrix (B ids of a stripe x A ids) is a dense block:
blocks of parts of the links are added up, and row maxima tell the best links of each
B id.  Scores are looked up where the links of that stripe are, and come back to a
batch as one packed row a stripe.  No task holds more than one block, the packed links
of one part of a stripe, or one batch of documents.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Stripes of B ids; a block has (B ids / STRIPES) x (A ids) counts.
STRIPES = 256
#: Documents and bytes of text that are encoded and packed together, and batches in one part of a stripe.
BATCH_DOCS, BATCH_BYTES, PART_BATCHES = 4096, 2 << 20, 2048
#: Cells of a block that one row carries.
ROW_CELLS = 1 << 20
#: Chunks that a worker remembers, and how many of a text are spelled at once.
MEMO_ENTRIES, CHUNKS_AT_ONCE = 400_000, 10_000

#: Unicode's white space and the controls that a library might take for it.
_SPACE = "\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_ENCODED = "batch long, pos int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, links binary"
_CELLS = "stripe int, cells binary, counts binary, best binary"
_SUMS = "batch long, pos binary, n_best binary, count_sum binary"
_SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones
    stand for themselves, the others in order for the characters from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ends(n: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(n)))


def _taken(pool: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` at ``starts``, each of its length ``n``, one after another."""
    ends = np.cumsum(n)
    return pool[np.repeat(starts - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class _Pool:
    """Runs of numbers in one array that grows, named by their number."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.data, self.ends = np.zeros(0, self.kind), np.zeros(1, np.int64)

    def add(self, data: np.ndarray, n: np.ndarray) -> None:
        self.data, self.ends = np.concatenate([self.data, data]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])

    def cut(self, runs: int) -> None:
        """Keep the first ``runs`` runs."""
        self.ends = self.ends[: runs + 1].copy()
        self.data = self.data[: self.ends[-1]].copy()

    def take(self, runs: np.ndarray) -> np.ndarray:
        return _taken(self.data, self.ends[runs], self.ends[runs + 1] - self.ends[runs])


class Aligner:
    """Both tokenizers, and a memo of aligned chunks: one for each Python worker.

    A text is cut where white space follows another character.  Pre-tokens of A do not
    cross such a place.  B's pieces do not either if the white space is a space, as no
    piece has a space behind another character (checked below), or a character that no
    longer piece holds; before other white space a text is not cut.  What a chunk needs
    is kept in pools: numbers of tokens, links, and its groups as text, each group
    closed by a semicolon.  B spells a text as it spells its chunks, so a text is
    spelled in full if all its chunks are.
    """

    _made: dict[tuple[str, str], Aligner] = {}

    def __init__(self, a: str, b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, byte = Tokenizer.from_file(a), _byte_of()
        self.a.encode_special_tokens = True
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes)]
        # how an id is written in the midst of a group and at the end of its side
        written = [f"{i}{end}".encode() for side, close in ((self.a_bytes, "|"), (self.b_bytes, ";")) for i in range(len(side)) for end in (",", close)]
        self.written = _Pool("u1")
        self.written.add(np.frombuffer(b"".join(written), "u1"), np.array([len(w) for w in written]))
        held = {c for p in pieces if len(p) > 1 for c in p}
        spaces = re.findall(f"[{_SPACE}]", "".join(map(chr, range(0x3001))))
        if any("\u2581" in p.lstrip("\u2581") for p in pieces):
            raise ValueError("the model has pieces across spaces")
        whole = "".join(c for c in spaces if c != " " and (c in held or "\x1c" <= c <= "\x1f"))  # not cut before these
        self.chunk = re.compile(f"[{_SPACE}]*[^{_SPACE}]+(?:[{whole}][{_SPACE}]*[^{_SPACE}]*)*|[{_SPACE}]+")
        self.memo: dict[str, int] = {}
        self.tokens, self.links, self.groups = _Pool("i8"), _Pool("u4"), _Pool("u1")

    @classmethod
    def of(cls, a: str, b: str) -> Aligner:
        """The aligner of this Python worker."""
        if (a, b) not in cls._made:
            cls._made[a, b] = cls(a, b)
        return cls._made[a, b]

    def _b_ids(self, texts: list[str]) -> list[list[int]]:
        """B's ids of texts in their place; a space that opens one is the one that B adds."""
        found, alone = self.b.encode([t.removeprefix(" ") for t in texts], num_threads=1), [self.b.piece_to_id("\u2581")]
        return [alone if t == " " else ids if t[0] == " " else ids[1:] for t, ids in zip(texts, found, strict=True)]

    def _together(self, chunks: list[str], raw: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]] | None:
        """Ids of each side and how many each chunk has, from the chunks as one text; None if it can't be cut into them."""
        if any(c[-1].isspace() for c in chunks):
            return None
        text, whole, upto = "".join(chunks), b"".join(raw), np.cumsum([len(r) for r in raw])
        found = [np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64), np.array(self._b_ids([text])[0], np.int64)]
        per = []
        for ids, names, size in zip(found, (self.a_bytes, self.b_bytes), self.sizes, strict=True):
            ends = np.cumsum(size[ids])
            if b"".join(map(names.__getitem__, ids.tolist())) != whole or not np.isin(upto, ends).all():
                return None
            per.append(np.bincount(np.searchsorted(upto, ends), minlength=len(chunks)))
        return found, per

    def _apart(self, chunks: list[str], raw: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The same chunk by chunk; one whose bytes its tokens do not spell has none."""
        sides = [x.ids for x in self.a.encode_batch_fast(chunks, add_special_tokens=False)], self._b_ids(chunks)
        for k, (a, b, r) in enumerate(zip(*sides, raw, strict=True)):
            if b"".join([self.a_bytes[i] for i in a]) != r or b"".join([self.b_bytes[i] for i in b]) != r:
                sides[0][k], sides[1][k] = [], []
        per = [np.array([len(ids) for ids in side], np.int64) for side in sides]
        return [np.fromiter(chain.from_iterable(side), np.int64, n.sum()) for side, n in zip(sides, per, strict=True)], per

    def _learn(self, chunks: list[str]) -> None:
        """Append chunks to the pools."""
        raw = [c.encode() for c in chunks]
        ids, per = self._together(chunks, raw) or self._apart(chunks, raw)
        ends = [np.cumsum(size[i]) for size, i in zip(self.sizes, ids, strict=True)]
        # a token closes a group if one of the other side ends where it ends
        closes = []
        for mine, other in (ends, ends[::-1]):
            at = np.minimum(np.searchsorted(other, mine), max(len(other) - 1, 0))
            closes.append(other[at] == mine if len(mine) else np.zeros(0, bool))
        of = [np.repeat(np.arange(len(chunks)), n) for n in per]
        self.tokens.add(np.column_stack(per).ravel(), np.full(len(chunks), 2))
        links = np.column_stack([ids[1][closes[1]], ids[0][closes[0]]]).astype("u4")
        self.links.add(links.ravel(), 2 * np.bincount(of[0][closes[0]], minlength=len(chunks)))
        group = [np.cumsum(c) - c for c in closes]
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        written = np.concatenate([2 * ids[0] + closes[0], 2 * (len(self.a_bytes) + ids[1]) + closes[1]])[order]
        n = self.written.ends[written + 1] - self.written.ends[written]
        self.groups.add(self.written.take(written), np.bincount(np.concatenate(of)[order], weights=n, minlength=len(chunks)).astype(np.int64))

    def align(self, texts: list[str | None]) -> tuple[list[tuple[int, int, str]], np.ndarray, np.ndarray]:
        """Per text the numbers of tokens and the digest of its groups; all links (b, a), and how many each text has."""
        cut = [self.chunk.findall(" " + t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        known = list(map(self.memo.get, flat))
        lacking = list(dict.fromkeys(c for c, k in zip(flat, known, strict=True) if k is None))
        for at in range(0, len(lacking), CHUNKS_AT_ONCE):
            some = lacking[at : at + CHUNKS_AT_ONCE]
            self.memo.update(zip(some, range(len(self.memo), len(self.memo) + len(some)), strict=True))
            self._learn(some)
        runs = np.fromiter(map(self.memo.__getitem__, flat), np.int64, len(flat)) if lacking else np.array(known, np.int64)
        counts = self.tokens.data.reshape(-1, 2)[runs]
        bounds = _ends(np.array([len(c) for c in cut], np.int64))
        out, linked = [], []
        for i in range(len(texts)):
            lo, hi = bounds[i], bounds[i + 1]
            if lo == hi or not counts[lo:hi, 0].all():
                out.append((0, 0, ""))
                linked.append(np.zeros(0, np.int64))
                continue
            digest = hashlib.sha256()
            for at in range(lo, hi, CHUNKS_AT_ONCE):
                groups = self.groups.take(runs[at : min(hi, at + CHUNKS_AT_ONCE)])
                digest.update(groups[:-1] if at + CHUNKS_AT_ONCE >= hi else groups)
            out.append((*counts[lo:hi].sum(axis=0).tolist(), digest.hexdigest()))
            linked.append(runs[lo:hi])
        per = np.array([int((self.links.ends[r + 1] - self.links.ends[r]).sum()) // 2 for r in linked], np.int64)
        links = self.links.take(np.concatenate(linked)) if linked else np.zeros(0, "u4")
        if len(self.memo) > MEMO_ENTRIES:
            for c in lacking[len(lacking) - (len(self.memo) - MEMO_ENTRIES) :]:
                del self.memo[c]
            for pool in (self.tokens, self.links, self.groups):
                pool.cut(len(self.memo))
        return out, links.reshape(-1, 2), per


def _squeezed(array: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(array.tobytes(), 1)


def _loose(raw: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(raw), kind)


def _rows(schema: str, columns: dict[str, list]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    n = max(map(len, columns.values()), default=0)
    return pa.RecordBatch.from_arrays([pa.array(columns.get(name, [None] * n), kinds[kind]) for name, kind in fields], [name for name, _ in fields])


def _encoded(docs: DataFrame, a: str, b: str, stripes: int) -> DataFrame:
    """A row for each document, and one with packed links for each batch and stripe."""

    def batch_of(ids: list[int | None], texts: list[str | None], number: int) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(a, b)
        found, links, per = aligner.align(texts)
        groups = per.tolist()  # a link closes a group
        yield _rows(_ENCODED, {
            "batch": [number] * len(ids), "pos": list(range(len(ids))), "doc_id": ids, "n_a": [f[0] for f in found], "n_b": [f[1] for f in found],
            "n_groups": groups, "n_links": groups, "groups_sha256": [f[2] for f in found],
        })
        width, n_a = -(-len(aligner.b_bytes) // stripes), len(aligner.a_bytes)
        stripe, row = links[:, 0] % stripes, links[:, 0].astype(np.int64) // stripes
        doc = np.repeat(np.arange(len(ids)), per)
        key, n = np.unique(((stripe.astype(np.int64) * len(ids) + doc) * width + row) * n_a + links[:, 1], return_counts=True)
        upper, cell = np.divmod(key, width * n_a)
        of, doc = np.divmod(upper, max(len(ids), 1))
        cuts = np.searchsorted(of, np.arange(stripes + 1))
        out = {"batch": [], "stripe": [], "links": []}
        for s in range(stripes):
            lo, hi = cuts[s], cuts[s + 1]
            if lo < hi:
                packed = np.concatenate([doc[lo:hi].astype("<u4"), cell[lo:hi].astype("<u4"), n[lo:hi].astype("<u4")])
                for name, value in zip(out, (number, s, _squeezed(packed)), strict=True):
                    out[name].append(value)
        yield _rows(_ENCODED, out)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(ids):
                to, size = at, 0
                while to < len(ids) and to - at < BATCH_DOCS and (to == at or size + len(texts[to] or "") <= BATCH_BYTES):
                    size += len(texts[to] or "")
                    to += 1
                yield from batch_of(ids[at:to], texts[at:to], number)
                number, at = number + 1, to

    return docs.mapInArrow(encode, _ENCODED)


def align(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", stripes: int = STRIPES) -> DataFrame:
    """Alignment of each document under a byte-level BPE file ``a`` and a sentencepiece model ``b``.

    A encodes a space and the text, B the text, before which it adds a space; special
    tokens in a text are plain text.  Returns per row the id (``doc_id``), ``n_a``,
    ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is as frequent as any
    of its B id over all documents), ``count_sum`` (over links, the links of all
    documents with that pair) and ``groups_sha256`` (of ``a1,a2|b1;a3|b2,b3``).  Null and
    empty texts, and those whose tokens do not spell the space and the text, have zeros
    and an empty digest.  Rows with equal ids stay apart; other columns are ignored.
    """
    aligner = Aligner.of(a, b)
    n_a, width = len(aligner.a_bytes), -(-len(aligner.b_bytes) // stripes)
    rows = stored(_encoded(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), a, b, stripes), "aligned")
    batches = rows.where("pos = 0").count()
    parts = max(1, -(-batches // PART_BATCHES))
    links = rows.where("stripe IS NOT NULL").select("batch", "stripe", F.pmod(F.xxhash64("batch"), F.lit(parts)).cast("int").alias("part"), "links")

    def cells(stripe: int, block: np.ndarray, best: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(block)
        for at in range(0, len(used), ROW_CELLS):
            some = used[at : at + ROW_CELLS]
            top = _squeezed(best[some]) if best is not None else b""
            yield _rows(_CELLS, {"stripe": [stripe], "cells": [_squeezed(some.astype("<u4"))], "counts": [_squeezed(block[some])], "best": [top]})

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = np.zeros(width * n_a, "<i8")
        for batch in batches:
            for packed in batch.column("links"):
                _, cell, n = _loose(packed.as_py(), "<u4").reshape(3, -1)
                np.add.at(block, cell, n)
        yield from cells(key[0].as_py(), block, None)

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = np.zeros(width * n_a, "<i8")
        for batch in batches:
            for cell, n in zip(batch.column("cells"), batch.column("counts"), strict=True):
                np.add.at(block, _loose(cell.as_py(), "<u4"), _loose(n.as_py(), "<i8"))
        matrix = block.reshape(width, n_a)
        yield from cells(key[0].as_py(), block, (matrix == matrix.max(axis=1, keepdims=True)).ravel())

    def score(links: pa.Table, counts: pa.Table) -> pa.Table:
        block, top = np.zeros(width * n_a, "<i8"), np.zeros(width * n_a, bool)
        for cell, n, best in zip(*(counts.column(c) for c in ("cells", "counts", "best")), strict=True):
            cell = _loose(cell.as_py(), "<u4")
            block[cell], top[cell] = _loose(n.as_py(), "<i8"), _loose(best.as_py(), "?")
        out = {"batch": links.column("batch").to_pylist(), "pos": [], "n_best": [], "count_sum": []}
        for packed in links.column("links"):
            doc, cell, n = _loose(packed.as_py(), "<u4").reshape(3, -1)
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            out["pos"].append(_squeezed(doc[first]))
            out["n_best"].append(_squeezed(np.add.reduceat(n * top[cell], first).astype("<u4")))
            out["count_sum"].append(_squeezed(np.add.reduceat(n * block[cell], first).astype("<i8")))
        return pa.Table.from_batches([_rows(_SUMS, out)])

    def total(docs: pa.Table, sums: pa.Table) -> pa.Table:
        docs = docs.sort_by("pos")
        best, summed = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
        for pos, n, c in zip(*(sums.column(x) for x in ("pos", "n_best", "count_sum")), strict=True):
            pos = _loose(pos.as_py(), "<u4")
            best[pos] += _loose(n.as_py(), "<u4")
            summed[pos] += _loose(c.as_py(), "<i8")
        return docs.append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(summed)).select([f.split()[0] for f in _SCORED.split(", ")])

    blocks = links.select("stripe", "part", "links").groupBy("stripe", "part").applyInArrow(count, _CELLS)
    counts = stored(blocks.groupBy("stripe").applyInArrow(add, _CELLS), "counts")
    spread = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sums = links.groupBy("stripe", "part").cogroup(spread.groupBy("stripe", "part")).applyInArrow(score, _SUMS)
    sums = stored(sums, "sums")
    discard(counts)
    docs = rows.where("stripe IS NULL").select("batch", "pos", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return docs.groupBy("batch").cogroup(sums.groupBy("batch")).applyInArrow(total, _SCORED)
