"""Quality, language, mixing and licences."""

from __future__ import annotations

import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import langid, licenses, mixing, quality_knn, quality_rules

from .docs import WORD, frame, make, sentence


def slow_counts(text, n=8):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    covered = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules_against_brute_force(spark):
    rows = make(200)
    got = quality_rules.judge(frame(spark, rows).selectExpr("*", "1 AS kept", "'x' AS h", "2 AS n_words", "3 AS _")).collect()
    counted = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got)
    assert counted == Counter((r[0], *slow_counts(r[1])) for r in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(frame(spark, [])).count() == 0


def test_rules_drop_what_stands_out(spark):
    import random

    dice = random.Random(4)
    rows = [(i, sentence(dice, 80), "en", "s", 1) for i in range(400)]
    rows += [(1000 + i, " ".join(w + "***" for w in sentence(dice, 80).split()), "en", "s", 1) for i in range(20)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert not any(kept[1000 + i] for i in range(20)) and sum(kept[i] for i in range(400)) > 390


def test_limits_differ_with_the_spread_of_a_group(spark):
    dice = np.random.default_rng(7)
    rows = [(int(1000 * x), g) for g, spread in (("narrow", 0.1), ("wide", 0.8)) for x in dice.normal(5, spread, 3000)]
    rows += [(5000, "few")] * 5
    df = spark.createDataFrame(rows, "word_chars long, g_source string").selectExpr("*", "'=en' AS g_lang", "1000L AS n_words", "0L AS n_symbols", "0L AS n_repeat_words", "0L AS n_dup_lines")
    got = {r["g_source"]: r["limits"] for r in quality_rules.cutoffs(df).collect()}
    apart = {g: x["q3"] - x["q1"] for g, x in got.items()}
    assert 0.1 < apart["narrow"] < 0.25 and 0.9 < apart["wide"] < 1.3
    # a few documents say little, so their group leans on its language
    assert 0 < apart["few"] < apart["wide"]
    alone = quality_rules.quartiles(quality_rules.sketch(df, ["g_source"]).where("measure = 'word_length'"), ["g_source"])
    assert {r["g_source"]: r["q3"] - r["q1"] for r in alone.collect()}["few"] == 0


def test_rules_keep_columns_that_clash(spark):
    docs = frame(spark, make(30)).selectExpr("*", "1 AS hi_word_length", "2 AS lo_x", "3 AS g_lang", "4 AS g_source", "5 AS row", "6 AS limits", "7 AS q1", "8 AS measure")
    got = quality_rules.judge(docs)
    assert set(got.columns) == {*docs.columns, *quality_rules.COUNTS, "base_failed", "kept"} - {"text"}
    assert {(r["hi_word_length"], r["g_lang"], r["row"], r["limits"], r["measure"]) for r in got.collect()} == {(1, 3, 5, 6, 8)}


def test_sketches_merge_and_are_close(spark):
    dice = np.random.default_rng(2)
    rows = [(str(i % 3), int(a), int(b)) for i, (a, b) in enumerate(dice.integers(1, 1000, (3000, 2)))]
    df = spark.createDataFrame(rows, "g string, word_chars long, n_words long").selectExpr("*", "0L AS n_symbols", "0L AS n_repeat_words", "0L AS n_dup_lines")
    whole = quality_rules.sketch(df, [])
    parts = quality_rules.merge(quality_rules.sketch(df, ["g"]), [])
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in parts.collect()}
    q = {r["measure"]: r for r in quality_rules.quartiles(whole, []).collect()}["word_length"]
    exact = np.quantile([a / b for _, a, b in rows], [0.25, 0.75], method="lower")
    assert q["q1"] == pytest.approx(exact[0], rel=0.02) and q["q3"] == pytest.approx(exact[1], rel=0.02)


def test_forward_pass_sums_all_segmentations():
    pieces = langid.Pieces(["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "bab"])
    model = langid.Unigrams(pieces, ["x", "y"])
    model.p[:-1] = np.random.default_rng(0).uniform(0.01, 0.2, (len(pieces.pieces), 2))
    at = {p: i for i, p in enumerate(pieces.pieces)}

    def brute(word: str, lang: int) -> float:
        if not word:
            return 1.0
        total = langid.UNKNOWN * brute(word[1:], lang)
        return total + sum(model.p[at[word[:m]], lang] * brute(word[m:], lang) for m in range(1, len(word) + 1) if word[:m] in at)

    words = ["▁ab", "▁abab", "▁zab", "▁", "▁babba", "▁" + "ab" * 40]
    got = model.forward(words)
    for i, w in enumerate(words[:-1]):
        assert got[i] == pytest.approx([np.log(brute(w, k)) for k in (0, 1)])
    memo = [[1.0], [1.0]]  # the long word by plain dynamic programming in logs
    w = words[-1]
    for k in (0, 1):
        sums = [1.0]
        for t in range(1, len(w) + 1):
            sums.append(sums[t - 1] * langid.UNKNOWN + sum(sums[t - m] * model.p[at[w[t - m : t]], k] for m in range(1, min(t, 12) + 1) if w[t - m : t] in at))
        memo[k] = sums
    assert got[-1] == pytest.approx([np.log(memo[k][-1]) for k in (0, 1)])


def long_words():
    pieces = langid.Pieces(["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "bab", "abba"])
    model = langid.Unigrams(pieces, ["x", "y"])
    model.p[:-1] = np.random.default_rng(5).uniform(0.01, 0.2, (len(pieces.pieces), 2))
    dice = np.random.default_rng(6)
    return model, ["▁" + "".join(dice.choice(list("aabbz"), n)) for n in [*range(13, 19), *range(29, 35), 200]]


def log_sums(model, word, lang):
    """Logs of the sums over segmentations of every start of the word."""
    at = {p: i for i, p in enumerate(model.pieces.pieces)}
    sums = [0.0]
    for t in range(1, len(word) + 1):
        terms = [sums[t - 1] + np.log(langid.UNKNOWN)]
        terms += [sums[t - m] + np.log(model.p[at[word[t - m : t]], lang]) for m in range(1, min(t, 12) + 1) if word[t - m : t] in at]
        sums.append(np.logaddexp.reduce(terms))
    return sums


def test_long_words_score_alike_alone_and_together():
    model, words = long_words()
    want = [[log_sums(model, w, k)[-1] for k in (0, 1)] for w in words]
    assert model.forward(words) == pytest.approx(np.array(want), rel=1e-9)
    for w, x in zip(words, want, strict=True):
        assert model.forward([w])[0] == pytest.approx(x, rel=1e-9)


def test_long_words_are_fitted():
    model, words = long_words()
    one = langid.Unigrams(model.pieces, ["x"])
    one.p = model.p[:, :1]
    for group in (words[:6], words[6:12], words[12:], words[2:4], words[8:11]):
        want = np.zeros(len(one.p))
        for w in group:
            left = log_sums(one, w, 0)
            for t in range(len(w)):
                for i, piece in enumerate(one.pieces.pieces):
                    if w.startswith(piece, t):
                        # the sums after a place are those of what follows it
                        rest = log_sums(one, w[t + len(piece) :], 0)[-1]
                        want[i] += 3 * np.exp(left[t] + np.log(one.p[i, 0]) + rest - left[-1])
        got = one._expected(group, np.full(len(group), 3.0), max(map(len, group)))
        assert got[:-1] == pytest.approx(want[:-1], rel=1e-6, abs=1e-12)
    before = one.p.copy()
    one.maximise(one.expected(0, {"▁" + "ab" * 9: 5})[:, None])
    i = one.pieces.pieces.index("ab")
    assert one.p[i, 0] / one.p[one.pieces.pieces.index("abba"), 0] > 100 * before[i, 0] / before[one.pieces.pieces.index("abba"), 0]


def test_languages_are_told_apart(spark):
    from tessera.llm.queries import vocabulary

    rows = make(240)
    docs = frame(spark, rows)
    model = langid.fit(docs.where("doc_id % 4 <> 2"), vocabulary())
    assert model.langs == ["de", "en", "fr"] and np.allclose(model.p.sum(axis=0), 1)
    # the same rounds in one place
    plain, counts = langid.Unigrams(langid.Pieces(vocabulary()), model.langs), {k: Counter() for k in model.langs}
    for i, text, lang, *_ in rows:
        if text and lang and (i or 0) % 4 != 2 and i is not None:
            counts[lang].update(p for w in langid.split_words(text) for p in langid._parts(w))
    for _ in range(langid.ROUNDS):
        plain.maximise(np.column_stack([plain.expected(k, counts[lang]) for k, lang in enumerate(model.langs)]))
    assert np.allclose(plain.p, model.p, rtol=1e-6, atol=1e-15)
    got = langid.identify(docs.selectExpr("*", "'z' AS score", "'y' AS _text", "'x' AS row", "3 AS _"), model).collect()
    assert {(r["_text"], r["row"]) for r in got} == {("y", "x")}
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 240 and r["doc_id"] % 4 == 2 and r["doc_id"] % 10 != 9]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert langid.identify(docs.limit(0), model).count() == 0
    # a run of a million letters in what is fitted
    long = frame(spark, [(1, "x" * 1_000_000, "en", None, 0), (2, "some words here", "en", None, 0), (3, "einige wörter hier", "de", None, 0)])
    assert np.allclose(langid.fit(long, vocabulary()).p.sum(axis=0), 1)
    nothing = langid.fit(docs.limit(0), vocabulary())
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_neighbours_learn_quality(spark):
    import random

    dice = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        text = sentence(dice, 60)
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split()), "en", "s", 1))
        labels.append((i, int(good)))
    rows += [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, "ab", "en", "s", 1), (None, "some text", "en", "s", 1)]
    labels += [(5, None), (None, 1), (7777, 0), (8, 0), (8, 1)]
    docs = frame(spark, rows).union(frame(spark, [(1, "another text under an id", "en", "s", 1)] * 3)).selectExpr("CAST(doc_id AS INT) AS doc_id", "text")
    lab = spark.createDataFrame(labels, "doc_id long, label int")
    model = quality_knn.fit(docs, lab.where("doc_id % 5 <> 0"))
    scored = quality_knn.score(docs, model).collect()
    got = {r["doc_id"]: r["score"] for r in scored}
    assert len(got) == len(rows) and len(scored) == len(rows) + 3 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.3) == (i % 4 != 0) for i in range(0, 300, 5))
    assert got[900] == got[901] == got[902] == pytest.approx(model.prior)
    none = quality_knn.fit(docs, lab.limit(0))
    assert {r["score"] for r in quality_knn.score(docs, none).collect()} == {0.5}
    assert quality_knn.score(docs.limit(0), model).count() == 0


def test_votes_are_exact_cosines():
    dice = np.random.default_rng(1)
    counts = dice.poisson(0.3, (80, quality_knn.width())).astype(np.float32)
    labels = dice.integers(0, 2, 80).astype(np.float32)
    m = quality_knn.Neighbours.fit(counts, labels, {0: int((labels == 0).sum()), 1: int(labels.sum())})
    x = dice.poisson(0.3, (5, quality_knn.width())).astype(np.float32)
    got = m.score(x)
    for row, s in zip(x, got, strict=True):
        z = row * m.idf
        z = (z / np.linalg.norm(z)) @ m.basis
        cos = m.vectors @ (z / np.linalg.norm(z))
        top = np.argsort(-cos)[: m.neighbours]
        v = np.maximum(cos[top], 0) ** quality_knn.POWER * m.weights[top]
        assert s == pytest.approx((v * labels[top]).sum() / v.sum(), rel=1e-3)


def fitted(total, most, weight):
    """The factor at which the least of bound and weight add up to a total, by halving."""
    low, high = 0.0, 1e9
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(u, mid * w) for u, w in zip(most, weight, strict=True)) < total else (low, mid)
    return high


def slow_mix(rows, fraction, power):
    """Raked probabilities of cells and the targets of the margins, by plain loops."""
    base = defaultdict(float)
    for cell, n in rows:
        base[cell] += n
    total = sum(base.values())
    base = {c: v / total for c, v in base.items() if v > 0}
    targets = []
    for m in range(3):
        t = defaultdict(float)
        for c, v in base.items():
            t[c[m]] += v
        room = {k: v * (1 + mixing.ROOM * (1 / fraction - 1)) for k, v in t.items()}
        scale = fitted(1, room.values(), [v**power for v in t.values()])
        targets.append({k: min(room[k], scale * v**power) for k, v in t.items()})
    w, most = dict(base), {c: v / fraction for c, v in base.items()}
    for _ in range(60):
        for m in range(3):
            for value, t in targets[m].items():
                mine = [c for c in w if c[m] == value]
                scale = fitted(t, [most[c] for c in mine], [w[c] for c in mine])
                w |= {c: w[c] * scale for c in mine}
    return {c: min(1, w[c] / most[c]) for c in w}, targets


@pytest.mark.parametrize("fraction", [0.1, 0.5, 1.0])
def test_mixing_against_plain_raking(spark, fraction):
    annotated = mixing.annotate(frame(spark, make(400)).selectExpr("*", "1 AS kept")).cache()
    cells = mixing.calibrate(annotated, fraction=fraction)
    got = mixing.sample(annotated, cells).collect()
    want, _ = slow_mix([((r["source"], r["lang"], r["topic"]), r["n_tokens"]) for r in got], fraction, mixing.POWER)
    for r in got:
        assert r["n_tokens"] == len(WORD.findall(r["text"] or ""))
        if r["n_tokens"]:
            assert r["probability"] == pytest.approx(want[r["source"], r["lang"], r["topic"]], abs=2e-3)
        else:
            assert r["kept"]
    tokens = sum(r["n_tokens"] for r in got)
    assert sum(r["n_tokens"] * r["probability"] for r in got) == pytest.approx(fraction * tokens, rel=1e-3)
    assert all(abs(r["share"] - r["target"]) < 1e-6 for r in mixing.expected(cells).collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_mixing_meets_its_targets_on_the_tables(spark):
    annotated = mixing.annotate(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    cells = mixing.calibrate(annotated)
    rows = mixing.expected(cells).collect()
    assert len(rows) > 20 and max(abs(r["share"] - r["target"]) for r in rows) < 1e-6
    assert cells.selectExpr("sum(probability * base)").first()[0] == pytest.approx(mixing.FRACTION, rel=1e-6)


def test_mixing_shrinks_a_budget_that_targets_exceed(spark):
    rows = [(i, "w " * 50, "en" if i % 10 else "de", f"s{i // 10 % 2}", 1) for i in range(400)]
    annotated = mixing.annotate(frame(spark, rows))
    cells = mixing.calibrate(annotated, {"lang": {"en": 1, "de": 1}, "source": {"s0": 1, "s1": 3}}, 0.9)
    share = {(r["margin"], r["value"]): r["share"] for r in mixing.expected(cells).collect()}
    # "de" is a tenth of the tokens, so a fifth of them at most meets the targets
    assert share["lang", "=de"] == pytest.approx(0.5, abs=1e-6) and share["source", "=s1"] == pytest.approx(0.75, abs=1e-6)
    assert 0.1 < cells.selectExpr("sum(probability * base)").first()[0] <= 0.2 + 1e-9


def test_mixing_to_given_targets(spark):
    rows = [(i, "w " * 50, "en" if i % 3 else "de", f"s{i % 4}", 1) for i in range(400)]
    annotated = mixing.annotate(frame(spark, rows))
    got = mixing.sample(annotated, mixing.calibrate(annotated, {"lang": {"en": 1, "de": 1}, "source": {"s0": 1, "s1": 1}}, 0.2)).collect()
    share = defaultdict(float)
    for r in got:
        share[r["lang"]] += r["probability"]
        share[r["source"]] += r["probability"]
    assert share["en"] == pytest.approx(share["de"], rel=1e-6) and share["s0"] == pytest.approx(share["s1"], rel=1e-6) and share["s2"] == share["s3"] == 0
    empty = mixing.annotate(frame(spark, []))
    assert mixing.sample(empty, mixing.calibrate(empty)).count() == 0


def test_mixing_warns_of_targets_beyond_reach_and_keeps_columns(spark):
    rows = [(i, "w " * 50, "en" if i % 4 else "de", f"s{i % 4}", 1) for i in range(200)]  # "de" is in s0 alone
    annotated = mixing.annotate(frame(spark, rows).selectExpr("*", "7 AS k_source", "8 AS row", "9 AS draw"))
    with pytest.warns(UserWarning, match="off by"):
        cells = mixing.calibrate(annotated, {"lang": {"en": 1, "de": 3}, "source": {"s0": 1, "s1": 1, "s2": 1, "s3": 1}}, 0.2)
    got = mixing.sample(annotated, cells).collect()
    assert {(r["k_source"], r["row"], r["draw"]) for r in got} == {(7, 8, 9)} and len(got) == 200


@pytest.mark.parametrize("few", [50_000, 0])
def test_mixing_by_few_and_by_many_cells(spark, few, monkeypatch):
    monkeypatch.setattr(mixing, "FEW_CELLS", few)
    annotated = mixing.annotate(frame(spark, make(200))).cache()
    got = {(r["k_source"], r["k_lang"], r["k_topic"]): r["probability"] for r in mixing.calibrate(annotated).collect()}
    want, _ = slow_mix([((r["source"], r["lang"], r["topic"]), r["n_tokens"]) for r in annotated.collect()], mixing.FRACTION, mixing.POWER)
    name = lambda x: "" if x is None else f"={x}"
    assert {tuple(map(name, k)): pytest.approx(v, abs=2e-3) for k, v in want.items()} == got


def slow_scan(text):
    if text is None:
        return None, None, 0
    segments = {*text.split("\n"), *re.split(r"\n[\x20\x09-\x0D]*\n", text), text}
    found = []
    sets = {frozenset(b) for b in (licenses.bigram_set(s) for s in segments)}
    for s in segments:
        b = set(licenses.bigram_set(s))
        for k, t in licenses.TEMPLATES.items():
            g = set(licenses.bigram_set(t))
            if b and 2 * len(b & g) / (len(b) + len(g)) >= licenses.THRESHOLD:
                found.append((2 * len(b & g) / (len(b) + len(g)), k))
    assert sets is not None
    return (*max(found)[::-1], len(found)) if found else (None, None, 0)


def test_licences_against_all_pairs(spark):
    rows = make(30)
    t = list(licenses.TEMPLATES.items())
    for i, (_, text) in enumerate(t):
        w = text.split()
        rows.append((500 + i, "intro words\n" + text.upper() + "\n\nmore", "en", "s", 1))
        rows.append((600 + i, " ".join(w[: max(2, int(len(w) * 0.8))]), "en", "s", 1))
        rows.append((700 + i, "\n".join(" ".join(w[j : j + 6]) for j in range(0, len(w), 6)) + "\n\nother paragraph", "en", "s", 1))
        rows.append((800 + i, " ".join(w[::2]), "en", "s", 1))
    got = {(r["doc_id"], r["license"], None if r["score"] is None else round(r["score"], 9), r["n_matches"]) for r in licenses.scan(frame(spark, rows).selectExpr("*", "1 AS sets")).collect()}
    want = set()
    for r in rows:
        name, score, n = slow_scan(r[1])
        want.add((r[0], name, None if score is None else round(score, 9), n))
    assert got == want and sum(n > 0 for *_, n in got) > 30
    assert licenses.scan(frame(spark, [])).count() == 0


def best_run(text):
    """Best score of every template over all runs of lines and sentences, by brute force."""
    units = [u for u in (re.findall(r"[^\W_]+", u.lower()) for u in re.split(r"\n|(?<=[.!?]) ", text)) if u]
    best = []
    for k, t in licenses.TEMPLATES.items():
        g = set(licenses.bigram_set(t))
        for a in range(len(units)):
            for z in range(a, len(units)):
                w = [x for u in units[a : z + 1] for x in u]
                held = {f"{x} {y}" for x, y in zip(w, w[1:], strict=False)}
                best.append((2 * len(held & g) / (len(held) + len(g)), k))
    return max(best, default=(0, None))


def test_wrapped_commented_and_mid_line_notices(spark):
    t = licenses.TEMPLATES
    wrap = lambda text, mark: "\n".join(mark + " ".join(text.split()[i : i + 9]) for i in range(0, len(text.split()), 9))
    rest = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    texts = [
        "/*\n * Copyright (c) 2020 Some One\n *\n" + wrap(t["MIT"], " * ") + "\n *\n" + wrap(rest + " " + rest, " * ") + "\n */\nint main() { return 0; }",
        "# tool: does a thing\n#\n" + wrap(t["GPL-3.0"], "# ") + "\n#\n" + wrap("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "# ") + "\nimport os",
        "We thank all readers of the first edition. " + t["CC-BY-4.0"] + " Figures of other people keep their own terms.",
        "words before the notice and more of them. Released under the MIT License. and after " * 3,
        "Licensed under CC BY 4.0.\n\n" + "// start of a file that goes on\n" + wrap(t["GPL-3.0"], "// ") + "\n// and so on for many more words than the notice itself has, " * 5,
        "no notice here, only a license of the public kind under the general terms of this work, and so on " * 3,
    ]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, [(i, x, "en", "s", 1) for i, x in enumerate(texts)])).collect()}
    assert [got[i]["license"] for i in range(6)] == ["MIT", "GPL-3.0", "CC-BY-4.0", "MIT-notice", "GPL-3.0", None]
    # besides the line of its own, the wrapped notice counts
    assert got[0]["n_matches"] == got[3]["n_matches"] == 1 and got[4]["n_matches"] > 1 and got[5]["n_matches"] == 0
    for i in range(5):
        assert (got[i]["score"], got[i]["license"]) == (pytest.approx(best_run(texts[i])[0]), best_run(texts[i])[1])
