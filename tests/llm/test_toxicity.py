import zlib

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.llm import toxicity as T


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = T.fit_toxicity(docs, labels)
    return model, T.score_toxicity(docs, model).toPandas(), labels.toPandas()


def test_held_out_accuracy(scored):
    _, got, labels = scored
    assert len(got) == got.doc_id.nunique()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.7)).all() and got.score.between(0, 1).all()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.toxic).mean() > 0.96
    # The labels of a few junk documents here say nothing of their words.
    assert both[both.toxic == 1].predicted.mean() > 0.8 and both[both.toxic == 0].predicted.mean() < 0.02


def test_edge_cases(scored, messy, texts, nothing):
    model, _, _ = scored
    out = T.score_toxicity(messy, model).collect()
    assert len(out) == len(texts) and all(0 <= r.score <= 1 for r in out)
    for r in out:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 1)
    assert len({r.score for r in out if r.doc_id in (1, 2, 3)}) == 1
    assert T.score_toxicity(nothing, model).count() == 0 and T.drop_toxic(messy, model).columns == messy.columns
    assert T.drop_toxic(messy, None).count() == len(texts) and T.score_toxicity(messy, None).first().score == 0


def test_no_labels(spark, messy):
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    assert T.fit_toxicity(messy, labels) is None and T.fit_toxicity(messy, labels.limit(0)) is None


def test_pools_match_a_plain_convolution():
    rng = np.random.default_rng(0)
    n = len(T.SLOTS) * T.FILTERS
    m = T.Model(rng.normal(size=(1 << T.WORD_BITS, n)).astype(np.float32), rng.normal(size=(1 << T.PREFIX_BITS, n)).astype(np.float32), rng.normal(size=(3, T.FILTERS)).astype(np.float32), np.ones(24), 0.0, np.zeros(5))
    t = T.read_words(pa.array(["one two three four", "", "five", None, "six seven"]))
    got = m.pools(t)
    for d in range(5):
        lo, hi = t.first[d], t.first[d + 1]
        for k, width in enumerate(T.WIDTHS):
            rows = []
            for i in range(lo, hi):
                s = m.bias[k].copy()
                for j in range(width):
                    if i + j < hi:
                        at = T.SLOTS.index((width, j)) * T.FILTERS
                        s += m.words[t.word[i + j], at : at + T.FILTERS] + m.prefixes[t.prefix[i + j], at : at + T.FILTERS]
                rows.append(s)
            want = np.max(rows, axis=0) if rows else np.zeros(T.FILTERS)
            assert np.allclose(got[d, k * T.FILTERS : (k + 1) * T.FILTERS], want, atol=1e-4)


def test_scores_ignore_everything_but_the_text(scored):
    model, _, _ = scored
    a = model.score(pa.array(["some loser text", "x"]))
    assert a[0] == model.score(pa.array(["some loser text"]))[0]
    assert model.thresholds.shape == (5,) and T.best_cut(np.array([0.0, 1.0, 2.0]), np.array([0, 0, 1])) == 1.5
