import re
from collections import defaultdict

import pytest
from oracle import same

from shelfmark.llm import mixing, queries


def targets(sizes, weights, most=3):
    """Water filling by rounds: hand out by weight, stop who is above, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_targets_and_copies(spark, messy, texts, nothing):
    out = mixing.mix_sources(messy).collect()
    assert len(out) == len(texts)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in texts:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes, (5, 2, 1))
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    assert sorted(r.size for r in out) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in texts)
    again = mixing.mix_sources(messy.repartition(3)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mix_sources(nothing).count() == 0


def test_taken_comes_near_target(spark):
    rows = [(i, "w " * (1 + i * 7919 % 300), f"s{i % 7}" if i % 3 else "hot") for i in range(3000)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(9, 4, 2, 1)).toPandas()
    g = out.groupby("source").agg(t=("target", "first"), k=("taken", "sum"))
    assert ((g.k - g.t).abs() <= 0.002 * g.t).all()
    assert abs(out["size"].sum() - g.t.sum()) < 1e-6 * g.t.sum()


def test_preferences_change_inclusion(spark):
    rows = [(i, "w " * 10, "a" if i < 2000 else "b", 4 if i % 2 else 1) for i in range(3000)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, `li.king` long"), weights=(1, 2), prefer="li.king").toPandas()
    part = out[out.source == "a"]
    liked, other = part[part.doc_id % 2 == 1].copies.mean(), part[part.doc_id % 2 == 0].copies.mean()
    assert liked > other + 0.2 and abs(part.taken.sum() - part.target.iloc[0]) <= 10


def test_inclusion_frequencies_match_the_probabilities(spark):
    """Over seeds, documents of each size are taken as often as their inclusion says, and longer ones more often."""
    rows = [(i, "w " * (4, 36, 144)[i % 3], "a" if i < 1500 else "b") for i in range(2400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    met = []
    for seed in range(5):
        out = mixing.mix_sources(df, weights=(1, 3), seed=f"s{seed}").where("source = 'a'").toPandas()
        met.append(out.assign(more=out.copies - out.copies.min()).groupby("size").agg(said=("inclusion", "first"), seen=("more", "mean")))
        assert abs(out.taken.sum() - out.target.iloc[0]) <= 4
    said = met[0].said
    seen = sum(m.seen for m in met) / len(met)
    assert said.is_monotonic_increasing and said.iloc[-1] > 2 * said.iloc[0]
    assert ((seen - said).abs() < 0.06).all(), (seen, said)


def test_long_texts_are_certain_and_the_rest_is_scaled(spark):
    """A tenth of the texts is long and would have probabilities over 1: they are taken first, the others get what is left."""
    rows = [(i, "w " * (400 if i % 10 == 0 else 4 + i % 2), "a" if i < 6000 else "b") for i in range(6000 + 5700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    met = []
    for seed in range(6):
        out = mixing.mix_sources(df, weights=(19, 20), seed=f"s{seed}").where("source = 'a'").toPandas()
        rest = out.target.iloc[0] - out.copies.min() * out.source_size.iloc[0]
        assert abs((out.inclusion * out["size"]).sum() - rest) < 1e-6 * rest
        assert abs(out.taken.sum() - out.target.iloc[0]) <= 2.5
        met.append(out.assign(more=out.copies - out.copies.min()).groupby("size").agg(said=("inclusion", "first"), seen=("more", "mean")))
    seen = sum(m.seen for m in met) / len(met)
    assert met[0].said[400] == 1 and all(m.seen[400] == 1 for m in met) and 0.1 < met[0].said[4] < 0.9
    assert ((seen - met[0].said).abs() < 0.03).all(), (seen, met[0].said)


def test_no_document_that_fits_is_left(spark):
    rows = [(i, "w " * (1 + i * i % 97), f"s{i % 5}") for i in range(2000)]
    for seed in ("x", "y"):
        out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), seed=seed).toPandas()
        for _, g in out.groupby("source"):
            gap = g.target.iloc[0] - g.taken.sum()
            left = g[(g.copies == g.copies.min()) & (g.copies < g.copies.max())]["size"]
            assert left.empty or gap < left.min()


def test_a_long_document_at_the_edge_leaves_no_gap(spark):
    rows = [(i, "w " * (30_000 if i == 5 else 20), "a" if i < 4000 else "b") for i in range(9000)]
    for seed in ("x", "y", "z"):
        out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 2), seed=seed, edge=50).toPandas()
        g = out.groupby("source").agg(t=("target", "first"), k=("taken", "sum"))
        assert ((g.k - g.t).abs() <= 20).all()


def test_narrow_edges_give_the_same_mix(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    get = lambda e: sorted(map(tuple, mixing.mix_sources(df, edge=e).select("doc_id", "taken").collect()))
    assert get(1) == get(4096)


def test_very_many_sources_are_not_sorted_in_one_task(spark):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 400:03d}") for i in range(2000)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    sizes = {f"s{k:03d}": sum(1 + i % 50 for i in range(k, 2000, 400)) for k in range(400)}
    want = targets(sizes, (5, 2, 1))
    for r in out.select("source", "target").distinct().collect():
        assert abs(r.target - want[r.source]) < 1e-6 * want[r.source]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    same(queries.op5_mixing(spark, d), mixing.ORACLE, d)
