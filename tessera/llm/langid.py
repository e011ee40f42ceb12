"""Language identification by unigrams summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary.  The
likelihood of a word is the sum, over all ways to cut it into pieces, of the
products of their probabilities; a forward pass adds it up without listing them.
The probabilities are fitted by expectation maximisation over the same sums.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, forget, partitions, stored, unlike

#: Documents of each language (about) that are fitted, in so many rounds, and the letters
#: beyond which a run of letters is fitted in parts.
TRAIN_DOCS, ROUNDS, FIT_LETTERS = 400, 4, 64
#: Probability of a character that no piece covers, weight of unseen pieces, and the
#: words that a worker remembers.
UNKNOWN, SMOOTH, MEMO_ENTRIES = 1e-8, 0.05, 250_000
#: Characters of texts, and of padded words, that a worker scores at once.
BATCH_CHARS, WORD_CHARS = 250_000, 80_000
_BITS = 20
_LETTERS = re.compile(r"[^\W\d_]+")
#: What a piece of a word can look like.
_PIECE = re.compile(r"▁?[^\W\d_]*")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, each with the mark that opens a word."""
    return ["▁" + w for w in _LETTERS.findall((text or "").lower())]


class Pieces:
    """The vocabulary, found by hash."""

    def __init__(self, pieces: Iterable[str]) -> None:
        lowered = dict.fromkeys(p.lower() for p in pieces)
        self.pieces = [p for p in lowered if p and _PIECE.fullmatch(p)]
        self.longest = max(map(len, self.pieces), default=1)
        hashes = [self._hash(p) for p in self.pieces]
        # codes that share a slot go on to the next table
        self.tables: list[tuple[np.ndarray, int]] = []
        self.hashes = np.array(hashes, np.uint64)
        left = np.arange(len(hashes))
        while len(left):
            shift = 64 - _BITS - 5 * len(self.tables)
            slot = (self.hashes[left] >> np.uint64(shift)) & np.uint64((1 << _BITS) - 1)
            table = np.full(1 << _BITS, -1, np.int32)
            table[slot[::-1]] = left[::-1]
            self.tables.append((table, shift))
            left = left[table[slot] != left]

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = ((h + ord(c) + 1) * int(_BASE)) % (1 << 64)
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 for none."""
        found = np.full(hashes.shape, -1, np.int32)
        for table, shift in self.tables:
            at = table[((hashes >> np.uint64(shift)) & np.uint64((1 << _BITS) - 1)).astype(np.int64)]
            found = np.where((at >= 0) & (self.hashes[at] == hashes), at, found)
        return found

    def lattice(self, words: list[str], wide: int) -> list[np.ndarray]:
        """For each piece length m, the piece that starts at every place of every word."""
        flat = np.frombuffer("".join(w.ljust(wide, "\0") for w in words).encode("utf-32-le"), "<u4")
        codes = flat.reshape(len(words), wide).astype(np.uint64) + np.uint64(1)
        hashes, out = np.zeros_like(codes), []
        for m in range(1, min(self.longest, wide) + 1):
            hashes = (hashes[:, : wide - m + 1] + codes[:, m - 1 :]) * _BASE
            out.append(self.find(hashes))
        return out


class Unigrams:
    """Piece probabilities of each language, and sums over segmentations."""

    def __init__(self, pieces: Pieces, langs: list[str]) -> None:
        self.pieces, self.langs = pieces, langs
        n = len(pieces.pieces)
        self.p = np.full((n + 1, len(langs)), 1.0 / max(n, 1))  # last row: no piece
        self.p[n] = 0

    def forward(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of every word in every language."""
        out = np.empty((len(words), len(self.langs)))
        for some, wide in _by_width(words):
            group = [words[i] for i in some]
            alpha, scale, _ = self._alpha(group, wide)
            size = np.array([len(w) for w in group])
            rows = np.arange(len(group))
            out[some] = np.log(alpha[size, rows]) + scale[size, rows]
        return out

    def _alpha(self, words: list[str], wide: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        lattice = self.pieces.lattice(words, wide)
        alpha = np.zeros((wide + 1, len(words), len(self.langs)))
        scale = np.zeros_like(alpha)
        alpha[0] = 1
        for t in range(1, wide + 1):
            for m in range(1, min(t, len(lattice)) + 1):
                alpha[t] += alpha[t - m] * self.p[lattice[m - 1][:, t - m]]
            alpha[t] += alpha[t - 1] * UNKNOWN
            scale[t] = scale[t - 1]
            if t % 16 == 0:  # keep the last sums within range
                by, since = alpha[t].copy(), max(0, t - self.pieces.longest)
                alpha[since : t + 1] /= by
                scale[since : t + 1] += np.log(by)
        return alpha, scale, lattice

    def expected(self, lang: int, counted: dict[str, int]) -> np.ndarray:
        """How often each piece is expected in counted words of a language, over all their segmentations."""
        one = Unigrams.__new__(Unigrams)
        one.pieces, one.langs, one.p = self.pieces, [""], self.p[:, lang : lang + 1]
        words, out = list(counted), np.zeros(len(self.p))
        for some, wide in _by_width(words):
            group = [words[i] for i in some]
            out += one._expected(group, np.array([counted[w] for w in group], float), wide)
        return out

    def maximise(self, expected: np.ndarray) -> None:
        """Take over the probabilities that expected counts (pieces x languages) give, smoothed."""
        n = len(self.pieces.pieces)
        expected[n] = 0
        total = expected.sum(axis=0, keepdims=True)
        shared = expected.sum(axis=1, keepdims=True) / max(total.sum(), 1e-300)
        smooth = (1 - SMOOTH) * expected / np.maximum(total, 1e-300) + SMOOTH * (0.5 * shared + 0.5 / max(n, 1)) * 1e-2
        smooth[n] = 0
        self.p = smooth / np.maximum(smooth.sum(axis=0, keepdims=True), 1e-300)

    def _expected(self, words: list[str], weight: np.ndarray, wide: int) -> np.ndarray:
        alpha, scale, lattice = self._alpha(words, wide)
        size, rows = np.array([len(w) for w in words]), np.arange(len(words))
        a, before, p = alpha[:, :, 0], scale[:, :, 0], self.p[:, 0]
        beta = np.zeros((wide + 1, len(words)))
        after = np.zeros_like(beta)
        beta[size, rows] = 1
        for t in range(wide - 1, -1, -1):
            for m in range(1, min(wide - t, len(lattice)) + 1):
                beta[t] += p[lattice[m - 1][:, t]] * beta[t + m]
            beta[t] += UNKNOWN * beta[t + 1]
            after[t] = after[t + 1]
            if t % 16 == 0:
                by = np.where(beta[t] > 0, beta[t], 1.0)  # zero beyond the word
                beta[t : t + self.pieces.longest + 1] /= by
                after[t : t + self.pieces.longest + 1] += np.log(by)
        expected = np.zeros(len(p))
        for m in range(1, len(lattice) + 1):
            for t in range(wide - m + 1):
                ids = lattice[m - 1][:, t]
                scaled = np.exp(np.minimum(before[t] + after[t + m] - after[0], 700.0))
                share = a[t] * p[ids] * beta[t + m] / beta[0] * scaled
                expected += np.bincount(ids % len(p), weights=share * weight, minlength=len(p))
        return expected


def _by_width(words: list[str]) -> Iterator[tuple[np.ndarray, int]]:
    """Words of similar length together, so that little is padded."""
    size = np.array([len(w) for w in words], np.int64)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        room = max(1, WORD_CHARS // int(size[order[at]] + 4))
        to = min(at + room, int(np.searchsorted(size[order], size[order[at]] + 2, side="right")))
        some = order[at:to]
        yield some, int(size[some].max())
        at = to


class Scorer:
    """Scores texts, remembering the likelihoods of words."""

    def __init__(self, model: Unigrams) -> None:
        self.model, self.memo = model, {}
        self.logs = np.zeros((0, len(model.langs)))

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, split = self.model.langs, [split_words(t) for t in texts]
        known = len(self.memo)
        new = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in self.memo]
        self.memo.update(zip(new, range(known, known + len(new)), strict=True))
        if new:
            self.logs = np.concatenate((self.logs, self.model.forward(new)))
        labels, scores = [], np.zeros(len(texts))
        for i, words in enumerate(split):
            if not langs or not any(c.isalpha() for w in words for c in w):
                labels.append("und")
                continue
            total = self.logs[list(map(self.memo.__getitem__, words))].sum(axis=0)
            odds = np.exp(total - total.max())
            best = int(total.argmax())
            labels.append(langs[best])
            scores[i] = odds[best] / odds.sum()
        if len(self.memo) > MEMO_ENTRIES:
            for w in list(self.memo)[max(known, MEMO_ENTRIES) :]:
                del self.memo[w]
            self.logs = self.logs[: len(self.memo)].copy()
        return labels, scores


def _parts(word: str) -> list[str]:
    return [word[i : i + FIT_LETTERS] for i in range(0, len(word), FIT_LETTERS)]


def fit(rows: DataFrame, pieces: Iterable[str], train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> Unigrams:
    """A model from ``doc_id``, ``text`` and ``lang``; null texts and languages are left out.

    All words of about ``train_docs`` documents of each language, those with the smallest
    id hashes, are fitted; a run of more than ``FIT_LETTERS`` letters in parts of so many.  Each
    round sums expected counts over the distinct words in tasks; the driver holds the
    probabilities alone, a number for each piece and language.
    """
    spark = rows.sparkSession
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    model = Unigrams(Pieces(pieces), langs)
    if not langs:
        return model
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(train_docs / n)) for k, n in sizes.items()))[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = Counter((lang, part) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in split_words(t) for part in _parts(w))
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())],
                ["lang", "word", "n"],
            )

    words = chosen.select("lang", "text").mapInArrow(counted, "lang string, word string, n long")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stored(words, "words")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            now, sums = shared.value, {}
            for batch in batches:
                counts: dict[str, dict[str, int]] = {}
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    counts.setdefault(lang, {})[word] = n
                for lang, some in counts.items():
                    sums[lang] = sums.get(lang, 0) + now.expected(now.langs.index(lang), some)
            for lang, got in sums.items():
                used = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array([now.langs.index(lang)] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(got[used])], ["lang", "piece", "n"])

        dealt = words.repartition(partitions(spark), "word")
        found = dealt.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        sums = np.zeros_like(model.p)
        sums[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
        model.maximise(sums)
        shared.unpersist()
    discard(words)
    return model


def identify(docs: DataFrame, model: Unigrams, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row, from its whole text alone.

    ``und`` with score 0 where the text is null, has no letter, or nothing was
    learned; else the likeliest language and its share of the likelihoods.  Columns
    so named are replaced; equal rows score alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(0).field(at) if inside else batch.column(1)
            lo, held, chars = 0, [], 0
            for to, t in enumerate(texts, 1):
                held.append(t.as_py())
                chars += len(held[-1] or "")
                if chars > BATCH_CHARS or to == len(texts):
                    labels, scores = scorer.score(held)
                    columns = [batch.column(0).slice(lo, to - lo), pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "lang_pred", "score"])
                    lo, held, chars = to, [], 0
            pa.default_memory_pool().release_unused()

    row = F.struct(F.lit(0).alias(unlike(others)), *(F.col(f"`{c}`") for c in others))
    # a text that the row holds anyway is not sent twice
    inside = text_col in others and docs.schema[text_col].dataType == T.StringType()
    at = 1 + others.index(text_col) if inside else 0
    read = docs.select(row.alias("row"), *([] if inside else [F.col(f"`{text_col}`").cast("string").alias("text")]))
    kinds = T.StructType([read.schema["row"]]).add("lang_pred", "string").add("score", "double")
    return read.mapInArrow(scored, kinds).select(*(F.col("row").getField(c).alias(c) for c in others), "lang_pred", "score")
