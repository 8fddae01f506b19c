"""The n-gram Jaccard join against all pairs, with families of near copies and shared passages."""

import random

import numpy as np
import pytest

from cityloom.llm import _graph, _text, ngram_jaccard_join


def families(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    common = [word() for _ in range(60)]
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([4, 9, 15, 30, 80, 200, 400]))]
        if rng.random() < 0.5:  # a passage that many texts hold
            base[len(base) // 2 : len(base) // 2] = common
        for _ in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(int(len(text) * rng.choice([0, 0.005, 0.01, 0.02, 0.05]))):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return [(None if i % 11 == 0 else i // 2 if i % 7 == 0 else i, t) for i, t in enumerate(rows)]


def by_pairs(rows, size, percent):
    sets = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()) for w in (t.split() for _, t in rows)]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if comp[i] != comp[j] and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=-1) for c in set(comp)}
    return sorted((-1 if rows[i][0] is None else rows[i][0], len(sets[i]), least[comp[i]]) for i in range(len(rows)))


@pytest.mark.parametrize(("size", "percent", "long"), [(3, 90, 1), (5, 80, 64)])
def test_join_equals_all_pairs(spark, monkeypatch, size, percent, long):
    monkeypatch.setattr(ngram_jaccard_join, "LONG", long)
    monkeypatch.setattr(ngram_jaccard_join, "BLOCK_DOCS", 5)
    rows = families(size + long)
    got = ngram_jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size=size, percent=percent).collect()
    none = lambda v: -1 if v is None else v
    assert sorted((none(r.doc_id), r.n_shingles, none(r.component_id)) for r in got) == by_pairs(rows, size, percent)


def test_linked_sets_share_the_keys_that_they_must():
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        low, most, all_parts = ngram_jaccard_join.size_classes(percent)
        for n in (10, 23, 60, 300, 2000):
            cls = int(np.searchsorted(low, n, side="right")) - 1
            k, parts = most[cls], all_parts[cls]
            a = np.unique(_text.mix(rng.integers(0, 2**63, n, dtype=np.uint64)))
            drop = int(k) // 2
            b = np.unique(np.concatenate([a[drop:], _text.mix(rng.integers(0, 2**63, int(k) - drop, dtype=np.uint64))]))
            h, first = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            who, skip, key = ngram_jaccard_join.keys(h, first, np.array([cls, cls]), np.array([k, k]), np.array([parts, parts]))
            assert len(set(key[who == 0]) & set(key[who == 1])) > max(0, skip.max()) or k == 0


def test_null_keys_cost_no_pairs(spark):
    word = lambda i, j: f"w{i}x{j}"
    rows = [(None, " ".join(word(i // 2, j) for j in range(40)) + (" tail" if i % 2 else "")) for i in range(1000)]
    got = ngram_jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 1000 and {r.component_id for r in got} == {None} and {r.n_shingles for r in got} == {38, 39}


def test_helper_columns_may_be_there_already(spark):
    d = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y")], "doc_id long, text string, gone string")
    assert [(r.doc_id, r.gone) for r in ngram_jaccard_join.keep_one(d).collect()] == [(1, "x")]


def test_a_shared_passage_brings_no_sets_together(spark, monkeypatch):
    searched = []
    search = ngram_jaccard_join._search

    def counted(docs, roles, size, percent):
        searched.append(roles.count())
        return search(docs, roles, size, percent)

    monkeypatch.setattr(ngram_jaccard_join, "_search", counted)
    word = lambda i, j: f"w{i}x{j}"
    common = [word("c", j) for j in range(60)]
    rows = [(i, " ".join([*common, *(word(i, j) for j in range(240))])) for i in range(40)]
    got = ngram_jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string"), size=5, percent=80).collect()
    assert sorted(r.component_id for r in got) == list(range(40)) and sum(searched) == 0


def test_few_edges_take_few_tasks_however_many_partitions(spark):
    sc = spark.sparkContext
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc.setJobGroup("few-edges", "components")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(100) if i % 10 != 9], "a long, b long")
        got = _graph.components(edges)
        assert {(r.node, r.component) for r in got.collect()} == {(i, i // 10 * 10) for i in range(100)}
        stages = {k for j in sc.statusTracker().getJobIdsForGroup("few-edges") for k in sc.statusTracker().getJobInfo(j).stageIds}
        assert sum(sc.statusTracker().getStageInfo(k).numCompletedTasks for k in stages if sc.statusTracker().getStageInfo(k)) < 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("shape", ["random", "chain", "stars", "none"])
def test_components_in_one_task_and_in_steps_agree(spark, monkeypatch, shape):
    rng = random.Random(shape)
    label = lambda i: hash((i, 5)) if i % 3 else -hash((i, 7))
    pairs = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(170)],
        "chain": [(i, i + 1) for i in range(200)],
        "stars": [(500 + i % 5, i) for i in range(60)] + [(i, i) for i in range(3)],
        "none": [(4, 4)],
    }[shape]
    edges = spark.createDataFrame([(label(a), label(b)) for a, b in pairs] * 2, "a long, b long")
    whole = sorted(map(tuple, _graph.components(edges).collect()))
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(label(a), set()).add(label(b)), near.setdefault(label(b), set()).add(label(a))
    least = {}
    for x in sorted(near):
        todo = [] if x in least else [x]
        while todo:
            y = todo.pop()
            if y not in least:
                least[y] = x
                todo += near[y]
    assert whole == sorted(least.items())
    if shape != "chain":  # many steps
        monkeypatch.setattr(_graph, "MOST_EDGES", 0)
        assert sorted(map(tuple, _graph.components(edges).collect())) == whole
