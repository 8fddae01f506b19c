"""The models recomputed by plain loops: kernels, votes, divergences and scores."""

import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cityloom.llm import _text, language_id, lm_scoring, quality_rules, toxicity


def letters(seed, n, alphabet="abcdefgh"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(n))


def grams(text):
    kept = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in (text or "").lower())
    parts, last = [], ""
    for c in kept:
        if c != " " or last not in ("", " "):
            parts.append(c)
        last = c
    s = "".join(parts) + ("" if kept.endswith(" ") and parts else " " if parts else "")
    return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}


def test_spectrum_equals_sets_of_grams():
    texts = ["Ab c", "", None, "één twee-3 x", "привет мир", "कि मी", "a" * 5000, "  lead", "\U00020000x \U00020000"]
    doc, gram, has = language_id.spectrum(texts)
    doc, gram = language_id.distinct(doc, gram)
    sizes = np.bincount(doc, minlength=len(texts))
    for i, t in enumerate(texts):
        want = grams(t)
        assert has[i] == any(c.isalpha() for c in t or "")
        if has[i]:
            assert abs(sizes[i] - len(want)) <= 1  # a text that starts or ends in a space has one more or less
    own = [set(gram[doc == i].tolist()) for i in range(len(texts))]
    assert not (own[4] & own[0]) - {g for g in own[4] if g in own[7]}  # other scripts share the space only


def test_language_scores_equal_kernel_ridge():
    texts = [letters(i, 12, "abcdefg") for i in range(30)] + [letters(i, 12, "efghijk") for i in range(30)]
    lang = np.array(["x"] * 30 + ["y"] * 30, dtype=object)
    doc, gram, _ = language_id.spectrum(texts)
    sets = [np.unique(gram[doc == i]) for i in range(60)]
    order = np.random.default_rng(0).permutation(60)
    model = language_id.train([sets[i] for i in order], lang[order])
    best, score = model.decide(doc, gram, 60)
    k = np.array([[len(np.intersect1d(a, b)) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    # All 60 texts are landmarks, so the projection is the kernel itself.
    value, vector = np.linalg.eigh(k)
    phi = np.hstack([k @ vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6]), np.ones((60, 1))])
    y = np.where(lang[:, None] == np.array(["x", "y"], dtype=object), 1.0, -1.0)
    f = phi @ np.linalg.solve(phi.T @ phi + language_id.RIDGE * np.eye(phi.shape[1]), phi.T @ y)
    assert np.allclose(np.clip((f.max(axis=1) + 1) / 2, 0, 1), score, atol=2e-3) and (f.argmax(axis=1) == best).all()


def test_scores_of_texts_equal_the_softmax(spark, monkeypatch):
    held = {}
    plain = lm_scoring.train

    def keep(gram, count, size, steps):
        held["model"], held["size"] = plain(gram, count, size, 40), size
        return held["model"]

    monkeypatch.setattr(lm_scoring, "train", keep)
    monkeypatch.setattr(lm_scoring, "TOP", 5)
    rows = [(i, letters(i, 30, "abc")) for i in range(40)] + [(90, "zzz, q1. a"), (91, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_scoring.scores(d, F.col("doc_id") < 30).collect()}
    m = held["model"]
    words, c = lm_scoring.count(d, F.col("doc_id") < 30)
    counts = {r.h: r.c for r in words.collect()}
    table = np.exp(m.one[:, None, :] + m.two[None, :, :])
    table /= table.sum(axis=2, keepdims=True)  # by one back, two back
    for key, text in rows[::7] + rows[-2:]:
        w = _text.words(pa.array([text or ""], pa.large_string()))
        out = [*c.outputs(w).tolist(), c.end]
        total = 0.0
        for i, o in enumerate(out):
            u = c.end if i < 1 else out[i - 1]
            v = c.end if i < 2 else out[i - 2]
            total += math.log10(table[u, v, o])
            if len(c.top) <= o < c.end:
                k = o - len(c.top)
                total += math.log10((counts.get(int(w.hash[i].view(np.int64)), 0) + 0.5) / (c.shape_count[k] + 0.5 * (c.shape_words[k] + 1)))
        assert math.isclose(total, got[key], rel_tol=1e-6)


def test_a_large_corpus_is_learned_from_with_every_count(spark, monkeypatch):
    for name, value in {"TOP": 5, "STEPS": 1, "BATCH": 64, "BUCKET": 60, "ROUNDS": 3}.items():
        monkeypatch.setattr(lm_scoring, name, value)
    held, plain = [], lm_scoring.train_in_tasks

    def keep(grams, size):
        held.append({r.g: r.c for r in grams.collect()})
        return plain(grams, size)

    monkeypatch.setattr(lm_scoring, "train_in_tasks", keep)
    d = spark.createDataFrame([(i, letters(i, 30, "abc")) for i in range(40)], "doc_id long, text string")
    one, two = ({r.doc_id: r.score for r in lm_scoring.scores(d.repartition(n), F.lit(True)).collect()} for n in (1, 5))
    assert all(math.isclose(one[k], two[k], rel_tol=1e-9) for k in one)
    assert [sum(x.values()) for x in held] == [40 * 31] * 2
    # Each count has its whole weight in a pass.
    count, seen = np.array([1.0, 900.0, 3.0, 40.0]), np.zeros(4)
    net = lm_scoring.Net(np.full(4, 0.25), np.random.default_rng(1))
    monkeypatch.setattr(lm_scoring.Net, "step", lambda self, u, v, w, weight, rng: seen.__iadd__(np.bincount(w, weights=weight > 0, minlength=4)))
    lm_scoring.one_pass(net, np.arange(4), count, np.random.default_rng(1))
    assert (seen >= 1).all()


def test_growth_of_the_language_model():
    assert lm_scoring.growth(1000) == 1 and math.isclose(lm_scoring.growth(32_000_000), 2) and lm_scoring.growth(10**13) > 20


def test_votes_equal_all_cosines(spark):
    rng = random.Random(4)
    rows = [(i, letters(i, 25) + " " + " ".join(rng.sample(["vile", "awful", "nasty", "mean", "rude"], 1 + i % 4) if i % 6 == 0 else [])) for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(400)], "doc_id long, toxic int")
    ex = toxicity.fit(d, lab, F.lit(True))
    got = {r.doc_id: r for r in toxicity.score(d, ex).collect()}
    dense = np.zeros((len(ex.term) + 1, len(ex.label)))
    dense[np.repeat(np.arange(len(dense)), ex.at[:, -1] - ex.at[:, 0]), ex.member] = ex.weight
    assert np.allclose(np.linalg.norm(dense, axis=0), 1)
    df = Counter(h for _, t in rows for h in set(_text.words(pa.array([t], pa.large_string()), _text.BARE).hash.tolist()))
    assert np.allclose(ex.idf, [math.log(1 + (len(rows) - df[h] + 0.5) / (df[h] + 0.5)) for h in ex.term.tolist()])
    for key, text in rows[::23]:
        ((terms, weights),) = ex.vectors(*toxicity._counts(pa.array([text])))
        cos = weights @ dense[terms]
        least = np.sort(cos)[-toxicity.NEAREST]
        near = np.flatnonzero(cos >= least - 1e-9)
        w = ex.share[near] / (1e-3 + np.maximum(0, 1 - cos[near]))
        vote = np.clip((w * ex.label[near]).sum() / w.sum(), 1e-4, 1 - 1e-4)
        assert math.isclose(1 / (1 + math.exp(-(ex.slope * math.log(vote / (1 - vote)) + ex.shift))), got[key].score, rel_tol=1e-6)


def js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def test_divergences_equal_plain_histograms(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "COMMON", 6)
    rng = random.Random(8)
    small = {"en": ["the", "of", "and", "to", "understanding", "a", "in"], "de": ["der", "die", "und", "zu", "a", "ist"]}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        words = [rng.choice(small[lang]) if rng.random() < 0.4 else letters(rng.random(), 1) for _ in range(60 + 3 * i)]
        rows.append((i, " ".join(words) + (".\nA1" if i % 3 else ""), lang, "x"))
    rows += [(100, letters(1, 200, "qwzvb"), None, "x"), (101, None, "en", "x"), (102, "short", "de", "x"), (103, "# " * 300 + letters(2, 100), None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    got = {r.doc_id: r for r in quality_rules.judge(d).collect()}
    assert {"kept", "kept_"} <= set(quality_rules.judge(d).columns) and got[1].kept == "x"
    split = lambda t: [w for w in (t or "").split()]
    by = {lang: Counter(w for r in rows if r[2] == lang for w in split(r[1])) for lang in small}
    common = sorted({w for c in by.values() for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:6]})
    hist = lambda c, n: [c[w] / n for w in common] + [1 - sum(c[w] for w in common) / n]
    refs = {lang: hist(c, sum(c.values())) for lang, c in by.items()}
    for key, text, _, _ in rows:
        w = split(text)
        if len(w) < quality_rules.LEAST_WORDS:
            assert got[key].word_distance is None
            continue
        p = hist(Counter(w), len(w))
        want = {lang: js(p, q) for lang, q in refs.items()}
        assert math.isclose(min(want.values()), got[key].word_distance, abs_tol=1e-7)
        fits = any(want[x] <= quality_rules.WORD_SHARE * quality_rules.bare_distance(1 - refs[x][-1]) for x in refs)
        assert got[key].base_failed or fits or not got[key].kept_
    assert not got[100].kept_ and not got[100].base_failed and math.isclose(js(hist(Counter(split(rows[-4][1])), 200), refs["en"]), quality_rules.bare_distance(1 - refs["en"][-1]), abs_tol=1e-9)


@pytest.mark.parametrize("rows", [[], [(1, "", "en", "a"), (1, "", "en", "a"), (None, "x", None, None), (None, None, None, None)]])
def test_pipeline_stages_take_hostile_tables(spark, rows):
    import corpus_pipeline

    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.length("text"), "gone": F.lit(1), "spans": F.lit("s"), "size": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, "/root/testdata/sf0.001")
        left = out.collect()
        assert out.columns[: len(d.columns)] == d.columns and len(left) <= len(rows), name


def test_key_hashes_of_keep_nothing_back(spark):
    assert pd.DataFrame(quality_rules.judge(spark.createDataFrame([], "text string, lang string")).collect()).empty
