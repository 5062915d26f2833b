import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import simhash


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids, most=2):
    n = len(fps)
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                parent[find(i)] = find(j)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            r = find(i)
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(find(i)) for i in range(n)]


def test_edge_cases(messy, texts, nothing):
    got = simhash.simhash_groups(messy).collect()
    ids = [i for i, _, _ in texts]
    fps = [fingerprint(t) for _, t, _ in texts]
    want = list(zip(ids, (f"{f:016x}" for f in fps), components(fps, ids), strict=True))
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert simhash.simhash_groups(nothing).count() == 0


@pytest.mark.parametrize("crowd", [1, 48, 10**6])
def test_links_near_random_fingerprints(spark, crowd):
    rng = random.Random(7)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.randrange(12)):
            x = base
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
            base = rng.choice([base, x])
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    got = dict(simhash.connected_components(simhash.fingerprint_links(nodes, 2, 5, crowd)).collect())
    assert [got.get(i, i) for i in range(len(fps))] == components(fps, list(range(len(fps))))


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1300)]
    edges = spark.createDataFrame([*path, *star, (5, 5), (7, 6), (7, 6), (-4, 1200)], "u long, v long")
    got = dict(simhash.connected_components(edges).collect())
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == -4 for i in range(1000, 1300)) and len(got) == 201 + 300 + 1
    assert simhash.connected_components(edges.limit(0)).count() == 0


def test_keep_one(spark, messy, texts):
    out = simhash.keep_one_of_each(messy)
    assert out.columns == messy.columns
    assert out.count() == simhash.simhash_groups(messy).select("part").distinct().count()
    kept = {(r.doc_id, r.text) for r in out.collect()}
    assert {(7, "word"), (7, "other words here")} <= kept and len(kept) == out.count()
    nameless = spark.createDataFrame([(None, "first text of all"), (None, "second text, another one"), (None, "first text of all")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.keep_one_of_each(nameless).collect()) == ["first text of all", "second text, another one"]
    copies = spark.createDataFrame([(3, "same text here", "c"), (2, "same text here", "c"), (2, "same text here", "c"), (9, "quite another text", "c")], "doc_id long, text string, fingerprint string")
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(copies).collect()) == [2, 9]
    assert simhash.keep_one_of_each(messy.limit(0)).count() == 0


def test_block_keys_meet_for_any_two_bits(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    meet = F.lit(False)
    for (_, _, ka), (_, _, kb) in zip(simhash.block_keys(F.col("a"), 5, 2), simhash.block_keys(F.col("b"), 5, 2), strict=True):
        meet = meet | (ka == kb)
    assert df.where(~meet).count() == 0


def test_a_hub_is_split_among_tasks(spark):
    """The rewiring's join sees a skewed node as such: its minima come from a stage of their own."""
    from shelfmark.llm import components

    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        hub = spark.range(1, 300_000, numPartitions=6).selectExpr("id as u", "0L as v").union(spark.range(400_000, 403_000).selectExpr("id + 1 as u", "id as v"))
        star = components._star(hub, True)
        out = star.collect()
        assert "skew=true" in star._jdf.queryExecution().executedPlan().toString()
        assert sum(r.v == 0 for r in out) == 299_999
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_components_of_paths_stars_and_rings(spark):
    import random

    from shelfmark.llm.components import connected_components

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(700 + i, 700 + (i + 1) % 30) for i in range(30)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)] + [(5, 5)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges for _ in range(2)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    named = {x for a, b in edges for x in (a, b) if a != b}
    assert got == {x: find(x) for x in named}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
