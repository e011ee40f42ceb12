"""Token store and packing against the tokenizers library itself."""

from __future__ import annotations

import gc
import random
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import langid, packing, token_store
from tessera.llm.common import new_path
from tessera.llm.encoding import ChunkEncoder

from .docs import SCHEMA, frame, make

ODD = ["a  b", " a\tb\n\n c ", "\nx y's don't\n", "é  b", "<|endoftext|> x", "don't 's", "x\n y", "x \n", "", None, "the, The. don. 'll.", "Σας. ὈΣ, x", "a\x00b c", "é ́x"]


def ids(tokenizer: Tokenizer, text: str | None, end: int) -> np.ndarray:
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def plain(name: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(name))


def encoded(name: str, texts: list[str | None]) -> list[bytes]:
    return list(ChunkEncoder(public_tokenizers.path(name)).encode(pa.array(texts, pa.string())))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_encode_as_the_whole(name, monkeypatch):
    texts = [r[1] for r in make()] + ODD
    t = plain(name)
    want = [ids(t, x, 0)[:-1].tobytes() for x in texts]
    assert encoded(name, texts) == want
    monkeypatch.setattr("tessera.llm.encoding.MEMO_ENTRIES", 20)
    monkeypatch.setattr("tessera.llm.encoding.BATCH_BYTES", 300)
    assert encoded(name, texts) == want


#: Parts of texts at whose borders pre-tokens may change.
PARTS = ["a", "B", "The", " ", "\n", "  ", "\t", "'s", "'t", "'", "é", "e\u0301", "İ", "Σ", "ΑΣ", "ß", "中", "文字", "٣", "1", "23", "1.5", ".", ",", "###", "|", "_", "<|endoftext|>", "<|", "<|startoftext|>", "\u00a0", "\u3000", "😀", "\u0301", "\r", "\x00", "ﬁ", "Ⅷ", "don't", "\u200b", "ǅ", "K", "Å", "word, ", "ünd ", "слово. ", "й"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_texts_encode_as_by_the_library(name):
    dice = random.Random(3)
    texts = ["".join(dice.choices(PARTS, k=dice.randint(0, 12))) for _ in range(10_000)]
    texts += [" ".join(dice.choices(PARTS, k=dice.randint(0, 9))) for _ in range(10_000)]
    want = plain(name).encode_batch_fast(texts, add_special_tokens=False)
    assert encoded(name, texts) == [np.array(w.ids, "<u4").tobytes() for w in want]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_space_at_the_end_is_encoded(name):
    texts = ["abc ", " ", "a b ", "x\ny ", " a", "a\n"]
    t = plain(name)
    assert encoded(name, texts) == [ids(t, x, 0)[:-1].tobytes() for x in texts]


def test_token_store_round_trip(spark):
    rows = make()
    docs = frame(spark, rows).selectExpr("*", "1 AS start", "2 AS shard")
    path = new_path(spark, "tokens")
    token_store.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(map(tuple, token_store.token_digests(spark, path).collect()), key=lambda r: (r[1], r[0] or -1))
    t, start, want = plain("byte_bpe_50k.json"), 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        x = ids(t, r[1], 0)
        want.append((r[0], start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert got == want
    assert token_store.read_document(spark, path, 3) == [ids(t, rows[3][1], 0).tolist()]
    assert token_store.read_document(spark, path, 10**9) == []


def test_token_store_of_nothing(spark):
    path = new_path(spark, "tokens")
    token_store.write_tokens(frame(spark, []), path, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_store.token_digests(spark, path).count() == 0


def test_pieces_are_packed_gapless(spark):
    rows = make()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 256, 1).toPandas()
    t = plain("word_bpe_49k.json")
    want = []
    for r in rows:
        x = ids(t, r[1], 1)
        want += [(r[0], i, a, len(x[a : a + 256]), zlib.crc32(x[a : a + 256].tobytes())) for i, a in enumerate(range(0, len(x), 256))]
    key = lambda r: (-1 if r[0] is None or r[0] != r[0] else int(r[0]), *map(int, r[1:]))
    assert sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(map(key, want))
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 256
    least = -(-got.length.sum() // 256)
    assert got.sequence_id.nunique() <= least + 1
    assert packing.pack_documents(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"), 256, 1).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_length_once(seed):
    dice = np.random.default_rng(seed)
    have = {int(n): int(dice.integers(1, 500 if seed % 2 else 3)) for n in dice.choice(np.arange(1, 65), 30, replace=False)}
    held: dict[int, int] = {}
    for many, contents in packing.solve(have, 64):
        assert many > 0 and sum(n * k for n, k in contents) <= 64
        for n, k in contents:
            held[n] = held.get(n, 0) + many * k
    assert held == have


def test_knapsack_finds_the_best_configuration():
    dice = np.random.default_rng(3)
    price = np.full(21, -np.inf)
    price[[3, 5, 7, 11]] = dice.uniform(1, 4, 4)
    best = packing.best_configuration(price, 20)

    def brute(room: int) -> float:
        return max([0.0, *(price[n] + brute(room - n) for n in (3, 5, 7, 11) if n <= room)])

    assert sum(price[n] * k for n, k in best.items()) == pytest.approx(brute(20)) and sum(n * k for n, k in best.items()) <= 20


def test_the_cover_is_near_its_bound():
    dice = np.random.default_rng(4)
    size = np.unique(dice.integers(3, 300, 60))
    demand = dice.integers(1, 200, len(size))
    found, times, bound = packing.cover(size, demand, 512)
    assert (found @ size <= 512).all() and (times >= 0).all()
    assert (times @ found >= demand * (1 - 1e-9)).all()
    assert demand @ size / 512 <= bound + 1e-9 <= times.sum() <= (1 + packing.GAP) * bound
    # the bound is that of an exact solution where there is one: pairs of 6 and 4, 5 twice
    found, times, bound = packing.cover(np.array([4, 5, 6]), np.array([70, 20, 70]), 10)
    assert bound == pytest.approx(80) and 80 <= times.sum() <= 80 * (1 + packing.GAP)


@pytest.mark.parametrize("seed", range(3))
def test_most_pieces_are_placed_by_the_program(seed):
    dice = np.random.default_rng(seed)
    lengths = np.minimum(dice.lognormal(6, 1.1, 8000).astype(int) + 1, 4096)
    counts = np.bincount(lengths, minlength=4097)
    groups, left = packing.program(counts, 4096)
    assert (left >= 0).all() and left.sum() < 0.15 * counts.sum() and left @ np.arange(4097) < 0.03 * lengths.sum()
    assert all(sum(n * k for n, k in held) <= 4096 for _, held in groups)
    least = -(-int(lengths.sum()) // 4096)
    assert sum(many for many, _ in packing.solve(dict(enumerate(counts.tolist())), 4096)) <= least + 1 + least // 1000


@pytest.mark.parametrize(("seed", "most"), [(1, 2200), (2, 2740)])
def test_the_program_beats_best_fit_where_lengths_are_few(seed, most):
    dice = np.random.default_rng(seed)
    have = {int(n): int(dice.integers(1, 1000)) for n in dice.choice(np.arange(200, 500), 12, replace=False)}
    counts = np.zeros(1001, np.int64)
    for n, k in have.items():
        counts[n] = k
    plain = sum(many for many, _ in packing.best_fit(counts, 1000))
    assert sum(many for many, _ in packing.solve(have, 1000)) <= most < plain


def test_a_worker_drops_the_encoder_when_it_turns_to_languages(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, None)], "doc_id long, text string")
    path, calls, plain = public_tokenizers.path("word_bpe_49k.json"), [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda read, fn, kinds: calls.append((read, fn)) or plain(read, fn, kinds))
    langid.identify(docs, langid.Unigrams(langid.Pieces(["▁the", "▁cat"]), ["en", "de"]))
    ((read, fn),) = calls
    encoder = weakref.ref(ChunkEncoder.of(path))
    assert ChunkEncoder.of(path) is encoder()  # kept for the tasks of one use
    rows = [r for b in fn(iter(read.toArrow().to_batches())) for r in b.to_pylist()]
    gc.collect()
    assert sorted(r["row"]["doc_id"] for r in rows) == [1, 2]
    assert encoder() is None
