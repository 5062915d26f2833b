import re
from collections import Counter

import numpy as np

from shelfmark.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, cover, seen, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if n[x] > 1:
            cover.update(range(i, i + 8))
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_counts(spark, messy, texts, nothing):
    labels = spark.createDataFrame([(4, 1), (None, 0), (99, None)], "doc_id long, quality int")
    trees = Q.fit_quality(messy, labels)
    got = Q.judge_quality(messy, trees).collect()
    want = [brute(t or "") for _, t, _ in texts]
    assert sorted(tuple(r[1:6]) for r in got) == sorted(want)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed)
    assert Q.judge_quality(nothing, trees).count() == 0


def test_monotonic_constraints():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 2))
    y = ((x[:, 0] < 0.5) ^ (rng.random(2000) < 0.2)).astype(float)
    y[(x[:, 0] > 0.7) & (x[:, 0] < 0.8)] = 1
    signs = np.array([-1, 0])
    t = Q.fit_trees(x, y, signs)
    line = np.stack([np.linspace(0, 1, 500), np.full(500, 0.3)], axis=1)
    assert (np.diff(t.score(line)) <= 1e-12).all()
    free = Q.fit_trees(x, y, np.array([0, 0])).score(line)
    assert (np.diff(free) > 1e-6).any()
    assert ((t.score(x) > 0) == (y == 1)).mean() > 0.7


def test_flat_scores_equal_walks():
    rng = np.random.default_rng(4)
    x = rng.random((300, 3))
    t = Q.fit_trees(x, (x[:, 0] + x[:, 1] > 1).astype(float), np.zeros(3, int), n_trees=7)
    for row, got in zip(x[:50], t.score(x[:50]), strict=True):
        total = t.bias
        for node in t.roots:
            while t.left[node] != node:
                node = t.left[node] if row[t.feature[node]] <= t.threshold[node] else t.right[node]
            total += t.value[node]
        assert abs(total - got) < 1e-9


def test_learns_from_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = Q.judge_quality(docs, Q.fit_quality(docs, labels)).join(labels, "doc_id").toPandas()
    open_ = got[~got.base_failed]
    assert open_[open_.quality == 1].kept.mean() > 0.99 and open_[open_.quality == 0].kept.mean() < 0.4
