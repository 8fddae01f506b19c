"""Each operator on a small hostile table, against brute force where SQL can't say it."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from cityloom.llm import _text, decontamination, language_id, lm_scoring, mixing, ngram_jaccard_join, quality_rules, registry, substring_dedup, toxicity, url_filter, warc

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


BASE = prose(1, 120)
NEAR = BASE.replace(BASE.split()[60], "zzzz", 1)
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, NEAR, "en", "b"), (4, None, "de", None), (5, "", None, "b"), (6, " \n\t", "de", ""), (7, "one two", "de", "c"), (7, "one two", "de", "c"),
    (None, prose(2, 90), None, "c"), (8, prose(3, 30) + " " + " ".join(BASE.split()[20:85]) + " " + prose(4, 30), "en", "a"), (9, prose(5, 60_000), "en", "a"), (10, "x" * 5000, "de", "b"), (11, "é ü ß   ñ 123", "de", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names the operators use inside
    return spark.createDataFrame([(*r, 1, "h", 2.0, "key") for r in ROWS], SCHEMA + ", copies int, h string, score double, key string")


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.limit(0)


def test_words_and_shingles():
    t = ["A b\x0bc", "", "D  e f g ", "x" * 200 + " y", "B c", None]
    w = _text.words(pa.array([x or "" for x in t], pa.large_string()))
    assert w.counts.tolist() == [len(words(x)) for x in t]
    assert w.hash[1] == w.hash[len(words(t[0])) + 6]  # b and B
    long = _text.words(pa.array(["a" * 64 + "b" * 64, "b" * 64 + "a" * 64], pa.large_string()))
    assert long.hash[0] != long.hash[1]
    h, first = _text.shingles(w, 3)
    assert np.diff(first).tolist() == [1, 0, 2, 1, 1, 0]


def test_mixing(spark, docs, none):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(ROWS) and (got.taken <= 2 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    for _, g in got.groupby(got.source.fillna("\0null")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(g["size"].max() * 2, 1)
    assert got.groupby(got.source.fillna("\0null")).target.first().sum() == pytest.approx(1.5 * got["size"].sum())
    key = ["doc_id", "size", "copies"]
    again = mixing.mix(docs.repartition(3)).toPandas()
    assert sorted(map(repr, got[key].values.tolist())) == sorted(map(repr, again[key].values.tolist()))
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixture(docs)
    assert mixed.columns == [*docs.columns, "copies_"] and mixed.where("copies_ < 1").count() == 0


def test_mixing_keeps_expectations(spark):
    many = spark.createDataFrame([(i, "w " * (1 + i % 7), "en", "s%d" % (i % 2)) for i in range(2500)], SCHEMA)
    got = mixing.mix(many).toPandas()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
        ratio = g.target.iloc[0] / g.source_size.iloc[0]
        assert set(g.copies) <= {math.floor(ratio), math.floor(ratio) + 1}


def test_language_id(spark, none):
    text = {"en": "the quick brown fox and the lazy dog of this house", "de": "der schnelle fuchs und die müde katze in dem haus"}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(text[k].split()) for _ in range(20)), k, "s") for i, k in enumerate(["en", "de"] * 60)]
    d = spark.createDataFrame([*rows, (900, None, "en", "s"), (901, "12 ½ !!", "en", "s"), (902, "the fox", None, "s")], SCHEMA)
    from pyspark.sql import functions as F

    model = language_id.fit(d, F.col("doc_id") % 5 != 0)
    got = language_id.predict(d, model).toPandas().set_index("doc_id")
    assert (got.lang_pred[:120] == [r[2] for r in rows]).mean() > 0.95
    assert got.lang_pred[[900, 901]].tolist() == ["und", "und"] and got.lang_pred[902] == "en" and got.score.between(0, 1).all()
    assert language_id.fit(none, F.lit(True)) is None and language_id.predict(none, None).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://c/\r\nX: y", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (5, "u", "é" * 50_000), (None, "v", "other"), (5, "u", "é" * 50_000), (6, "e", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, f"{tmp_path}/w")
    got = warc.assemble(warc.read(spark, f"{tmp_path}/w")).toPandas()
    assert len(got) == len(rows)
    by = got.set_index("page_id")
    assert by.record_type[1] == "revisit" and by.refers_to[1] == 2 and by.record_type[2] == "response"
    assert by.record_type[3] == "revisit" and by.refers_to[3] == 6 and (by.record_type[5] == "response").all()
    assert by.capture[4]["payload"] == rows[3][2].encode() and by.payload_bytes[4] == len(rows[3][2])
    assert all(c["checked"] is not False for c in got.capture)
    warc.write(pages.limit(0), f"{tmp_path}/n")
    assert warc.assemble(warc.read(spark, f"{tmp_path}/n")).count() == 0


def test_lm_base_scores(spark, docs, none):
    from pyspark.sql import functions as F

    learn = F.col("doc_id") % 2 == 1
    got = lm_scoring.scores(docs, learn).toPandas()
    count = Counter()
    for i, t, *_ in ROWS:
        if i is not None and i % 2 == 1:
            count.update([*words(t), "\0end"])
    n, v = sum(count.values()), len(count)
    want = sorted((len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), "\0end"]), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), "\0end"]), 4)) for _, t, *_ in ROWS)
    assert sorted(zip(got.n_tokens, got.n_known, got.train_tokens, got.base_score.round(4), strict=True)) == want
    assert np.isfinite(got.score).all() and (got.score < 0).all()
    assert lm_scoring.scores(none, learn).count() == 0


def test_lm_is_a_distribution():
    rng = np.random.default_rng(0)
    g = np.unique(rng.integers(0, 8**3, 200))
    m = lm_scoring.train(g, np.ones(len(g)), 8)
    two, one, out = np.meshgrid(*[np.arange(8)] * 3, indexing="ij")
    p = np.exp(m.log_prob(out.ravel(), one.ravel(), two.ravel())).reshape(8, 8, 8)
    assert np.allclose(p.sum(axis=2), 1)


def test_url_cascade_is_exact(spark):
    rows = [(i, f"https://h{i % 700}.Example{'.net' if i % 3 else '.org'}/{'es' if i % 35 == 0 else 'en'}/{i}?q#f") for i in range(3000)]
    rows += [(9000, None), (9001, "no scheme"), (9002, "http://"), (9003, "https://www.example.com/en/x"), (9004, "https://a.example.com/en/"), (9005, "http://example.com")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = url_filter.hosts_with_blocked_pages(pages)
    a = url_filter.judge(pages, listed).toPandas().set_index("page_id").sort_index()
    b = url_filter.judge(pages, listed, most_bits=1024).toPandas().set_index("page_id").sort_index()
    assert a.verdict.tolist() == b.verdict.tolist() and a.listed.tolist() == b.listed.tolist() and 0 < a.listed.sum() < len(a)
    assert a.verdict[[9000, 9003, 9004]].tolist() == ["allow", "allow", "block"] and a.rule[9003] == "www.example.com/en/" and pd.isna(a.rule[9005])
    assert url_filter.judge(pages.limit(0), listed.limit(0)).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(BASE.upper().split()[30:60])), (2, prose(77, 30)), (3, "one two"), (4, None), (5, " ".join(NEAR.split()[55:70]))], "item_id long, text string")
    got = {tuple(r) for r in decontamination.search(docs, items).select("doc_id", "item_id").collect()}
    shingle = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    sets = [(i["item_id"], shingle(words(i["text"]))) for i in items.collect()]
    want = {(r[0], i) for r in ROWS for own in [shingle(words(r[1]))] for i, s in sets if s and 5 * len(s & own) >= 4 * len(s)}
    assert got == want and got
    assert decontamination.search(none, items).count() == 0 and decontamination.search(docs, items.limit(0)).count() == 0
    assert decontamination.clean(docs, items).columns == docs.columns


def test_toxicity(spark, none):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        rows.append((i, prose(i, 40) + (" " + " ".join(rng.sample(["vile", "awful", "nasty", "mean"], 3)) if bad else ""), "en", "s"))
        labels.append((i, 1, int(bad)))
    d = spark.createDataFrame([*rows, (900, None, "en", "s"), (901, "vile nasty awful", "en", "s"), (None, "vile nasty mean", "en", "s")], SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    from cityloom.llm._common import fold_is
    from pyspark.sql import functions as F

    ex = toxicity.fit(d, lab, ~fold_is(F.col("doc_id"), 0))
    got = toxicity.score(d, ex).toPandas()
    held = got[got.doc_id.isin([i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0])]
    assert (held.predicted == (held.doc_id % 8 == 0)).mean() > 0.97
    assert got.predicted[got.doc_id == 900].item() == 0 and got.predicted[got.doc_id == 901].item() == 1 and got.predicted[got.doc_id.isna()].item() == 1
    who, cos = ex.nearest(np.array([0, len(ex.term)]), np.array([0.8, 0.6]))
    dense = np.zeros((len(ex.term) + 1, len(ex.label)))
    dense[np.repeat(np.arange(len(dense)), ex.at[:, -1] - ex.at[:, 0]), ex.member] = ex.weight
    every = np.array([0.8, 0.6]) @ dense[[0, len(ex.term)]]
    assert np.allclose(np.sort(cos)[::-1][: toxicity.NEAREST], np.sort(every)[::-1][: toxicity.NEAREST], atol=1e-6)
    kept = toxicity.accepted(d, lab)
    assert kept.columns == d.columns and kept.where("doc_id = 901 or doc_id is null").count() == 0
    assert toxicity.accepted(none, lab).count() == 0


def test_substring_dedup(spark, docs, none):
    got = substring_dedup.repeats(docs).toPandas()
    spans = {(r.doc_id, r.kept_in) for r in got.itertuples()}
    assert {(2, 1), (3, 1), (8, 1)} <= spans and set(got.doc_id) == {2, 3, 8}
    row = got[got.doc_id == 8].iloc[0]
    assert row.first_word == 30 and row.end_word == 95 and row.kept_first_word == 20
    out = {r.doc_id: r.text for r in substring_dedup.trim(docs).collect()}
    assert 2 not in out and out[8].split() == ROWS[9][1].split()[:30] + ROWS[9][1].split()[95:] and out[1] == BASE and out[9] == ROWS[10][1]
    assert substring_dedup.repeats(none).count() == 0 and substring_dedup.trim(none).count() == 0


def test_compact_windows_by_brute_force():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 300, dtype=np.uint64)
    first = np.array([0, 130, 130, 175, 300])
    got = {tuple(map(int, x)) for x in zip(*substring_dedup.compact_windows(h, first, 46), strict=True)}
    want = set()
    for d in range(4):
        for c in range(first[d], first[d + 1]):
            left = right = c
            while left > first[d] and h[left - 1] > h[c]:
                left -= 1
            while right < first[d + 1] - 1 and h[right + 1] > h[c]:
                right += 1
            if right - left + 1 >= 46:
                want.add((d, left, c, right))
    assert got == want


def test_ngram_join(spark, docs, none):
    more = [(100 + i, " ".join((BASE.split()[: 110 - i] + prose(50 + i, i).split())), "en", "s") for i in range(12)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([r[:2] for r in more], "doc_id long, text string"))
    got = ngram_jaccard_join.link(d).toPandas()
    rows = [(r[0], r[1]) for r in [*ROWS, *more]]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set()) for w in (words(t) for _, t in rows)]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    want = sorted(repr((i, len(s), least[c])) for (i, _), s, c in zip(rows, sets, comp, strict=True))
    none_ = lambda v: None if pd.isna(v) else int(v)
    assert sorted(repr((none_(r.doc_id), r.n_shingles, none_(r.component_id))) for r in got.itertuples()) == want
    assert ngram_jaccard_join.link(none).count() == 0
    kept = ngram_jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and {1, 8, 9} <= {r.doc_id for r in kept.collect()} and kept.where("doc_id in (2, 3)").count() == 0


def test_blocks_are_searched_across(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard_join, "BLOCK_DOCS", 3)
    d = spark.createDataFrame([(i, " ".join(BASE.split()[: 120 - i])) for i in range(10)], "doc_id long, text string")
    assert ngram_jaccard_join.link(d).select("component_id").distinct().count() == 1


def test_quality_rules(spark, docs, none):
    repeated = "a b c d " * 40
    d = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(50, repeated, "en"), (51, "same line\nsame line\n\n#x$ y\nsame line", None)], "doc_id long, text string, lang string"))
    got, all_ = quality_rules.judge(d).toPandas(), d.collect()
    for r in got.itertuples():
        t = next(x.text for x in all_ if x.doc_id == r.doc_id or (pd.isna(r.doc_id) and x.doc_id is None)) or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.judge(none).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    plain = lambda d: sorted(repr([None if pd.isna(v) else v if isinstance(v, str) else round(float(v), 6) for v in r]) for r in d[sorted(d.columns)].itertuples(index=False, name=None))
    assert plain(registry.QUERIES[name](spark, SF).toPandas()) == plain(con.sql(registry.ORACLE_SQL[name]).df())


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "copies"} and 0 < out.count() <= 200
