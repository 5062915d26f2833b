import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import same

from shelfmark.llm import queries
from shelfmark.llm.substring_dedup import _least, remove_repeats


def brute(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def check(df, texts, window):
    got = sorted(tuple(r) for r in remove_repeats(df, window).select("n_words", "n_removed", "kept_sha256").collect())
    assert got == brute(texts, window)


def test_edge_cases(messy, texts, nothing):
    check(messy, [t for _, t, _ in texts], 35)
    assert remove_repeats(nothing).count() == 0


@pytest.mark.parametrize(("seed", "vocabulary", "window"), [(0, 1, 35), (1, 2, 12), (2, 3, 35), (3, 40, 35), (4, 5, 2), (5, 400, 7)])
def test_random_texts(spark, seed, vocabulary, window):
    rng = random.Random(seed)
    texts, passages = [], [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, 90))] for _ in range(6)]
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(60))] for _ in range(rng.randrange(6))]
        if rng.random() < 0.2:
            parts.append([f"w{rng.randrange(vocabulary)}"] * rng.randrange(100))
        texts.append(" ".join(x for p in parts for x in p))
    check(spark.createDataFrame([(i // 2 if seed == 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string"), texts, window)


def test_range_minimum():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 5, 200)
    lo = rng.integers(0, 199, 500)
    hi = np.minimum(lo + 1 + rng.integers(0, 35, 500), 200)
    assert (_least(v, lo, hi) == [a + np.argmin(v[a:b]) for a, b in zip(lo, hi, strict=True)]).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    from shelfmark.llm import substring_dedup

    d = f"/root/testdata/{sf}"
    same(queries.op6_substring_dedup(spark, d), substring_dedup.ORACLE, d)
