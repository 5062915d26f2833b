"""The pipeline's near-copy stage against Jaccard similarity by brute force, and planted near copies."""

import random

import pytest

import corpus_pipeline as P
from shelfmark.llm import near_copies


def sets(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def components(texts, share=0.8):
    s, parent = [sets(t) for t in texts], list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both >= share * (len(s[i]) + len(s[j]) - both) - 1e-9:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(s))]


def families(rng, n, most):
    """Texts with copies in which up to most words are replaced, and texts that share a passage and no more."""
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(10**6))
    passage, out = [word() for _ in range(60)], ["", " ", "one two", "One  two", "one two three"]
    for _ in range(n):
        base = [word() for _ in range(100)]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(most + 1)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
        out.append(" ".join([word() for _ in range(30)] + passage))
    return out


@pytest.mark.parametrize("crowd", [1, 48])
def test_groups_are_those_of_all_pairs(spark, crowd):
    texts = families(random.Random(4), 25, 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.part for r in near_copies.near_copy_groups(df, crowd=crowd).collect()}
    want = components(texts)
    first = lambda of: [next(j for j in range(len(texts)) if of[j] == of[i]) for i in range(len(texts))]
    assert first(got) == first(want)


def test_stage_drops_planted_near_copies(spark):
    rng = random.Random(6)
    docs = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(20)]
    near = [" ".join(w if i not in (50, 120) else "changed" for i, w in enumerate(d.split())) for d in docs]
    df = spark.createDataFrame(list(enumerate(docs + near)), "doc_id long, text string")
    assert sorted(r.doc_id for r in P.near_duplicates(spark, df, "").collect()) == list(range(20))


def test_a_common_passage_makes_no_pairs_of_all(spark):
    """Texts that share half of their words land under common keys; their rarest shingles keep them apart, and copies among them are still found."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**7)}"
    passage = [word() for _ in range(60)]
    texts = [" ".join(passage + [word() for _ in range(40)]) for _ in range(300)]
    twins = [" ".join([*t.split()[:-1], "end"]) for t in texts[:20]]
    df = spark.createDataFrame(list(enumerate(texts + twins)), "doc_id long, text string")
    got = {r.doc_id: r.part for r in near_copies.near_copy_groups(df, crowd=10).collect()}
    assert len(set(got.values())) == 300 and all(got[300 + i] == got[i] for i in range(20))


def test_sketches_agree_as_sets_do(spark):
    """The share of equal lanes is the similarity within five deviations, and no lane is miscounted."""
    import numpy as np

    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    texts = [base, *[np.concatenate([base[: 1000 - k], rng.integers(0, 1 << 63, k, dtype=np.uint64)]) for k in (0, 50, 111, 300, 1000)]]
    at = np.cumsum([0] + [len(t) for t in texts])[:-1]
    made = near_copies.sketches(np.concatenate(texts), at)
    df = spark.createDataFrame([(i, made[0].tolist(), m.tolist()) for i, m in enumerate(made)], "i int, a array<long>, b array<long>")
    got = {r.i: r.d for r in df.select("i", near_copies.differing("a", "b").alias("d")).collect()}
    lanes = made.view(np.uint8).reshape(len(texts), -1, 8)[:, :, :7].reshape(len(texts), -1)
    assert got == {i: int((lanes[i] != lanes[0]).sum()) for i in range(len(texts))}
    for i, k in enumerate((0, 0, 50, 111, 300, 1000)):
        j = (1000 - k) / (1000 + k)
        j = j + (1 - j) / 128
        assert abs(near_copies.LANES - got[i] - near_copies.LANES * j) <= 5 * (near_copies.LANES * j * (1 - j)) ** 0.5 + 1e-9
    assert got[1] == 0


def test_bits_differ_as_the_angle_says(spark):
    """SimHash of two sets at 0.8 differs in 0.15 of its bits, also for small sets; blocks and guard are parts of it."""
    import numpy as np

    rng = np.random.default_rng(5)
    for a, b, both in ((4, 5, 4), (90, 90, 80)):
        pool = rng.integers(0, 1 << 63, (200, a + b - both), dtype=np.uint64)
        left, right = pool[:, :a], np.concatenate([pool[:, :both], pool[:, a:]], axis=1)
        bits = [near_copies.simhash_bits(x.ravel(), np.arange(200) * x.shape[1], 400) for x in (left, right)]
        assert abs((bits[0] != bits[1]).mean() - near_copies.bit_differs(0.8)) < 0.012


def test_candidates_come_from_simhash_blocks(spark):
    """Near copies share blocks, their guards agree, and they come out of the join; other texts don't."""
    from pyspark.sql import functions as F

    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(150)) for _ in range(60)]
    near = [" ".join(w if i not in (40, 90) else "changed" for i, w in enumerate(t.split())) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    made = near_copies.with_blocks(df, 5, *near_copies.blocks_for(120, 0.8)).withColumn("crowded", F.lit(False))
    of = {r.node: r.doc_id for r in made.collect()}
    pairs = near_copies.block_pairs(made, 0.8).distinct().collect()
    assert {frozenset((of[r.u], of[r.v])) for r in pairs} == {frozenset((i, 60 + i)) for i in range(60)}


def test_a_family_below_the_similarity_makes_few_pairs(spark):
    """150 copies of one text at about 0.6 to each other are mostly crowded: few pairs of crowded texts come out of joins, and their twins are still found."""
    from pyspark.sql import functions as F

    rng = random.Random(14)
    word = lambda: f"w{rng.randrange(10**7)}"
    base = [word() for _ in range(400)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for i in rng.sample(range(80), 14):
            copy[5 * i] = word()
        texts.append(" ".join(copy))
    twins = [" ".join([*t.split()[:-1], "end"]) for t in texts[:10]]
    df = spark.createDataFrame(list(enumerate(texts + twins)), "doc_id long, text string")
    got = {r.doc_id: r.part for r in near_copies.near_copy_groups(df).collect()}
    want = components(texts + twins)
    first = lambda of: [next(j for j in range(160) if of[j] == of[i]) for i in range(160)]
    assert first(got) == first(want) and len(set(got.values())) == 150
    n, (bits, blocks) = 160, near_copies.blocks_for(160, 0.8)
    own = near_copies.with_blocks(df, 5, bits, blocks)
    many = near_copies.crowds(own, n, bits, blocks, 48)
    assert many.count() > 80
    crowded = own.withColumns({"crowded": F.lit(True), "part": F.col("node")})
    assert near_copies.block_pairs(crowded, 0.8).count() == 0
    sets = near_copies.shingle_sets(df, own, 5, sketch=True)
    assert 10 <= near_copies.crowded_pairs(crowded, sets, 0.8).count() <= 500
