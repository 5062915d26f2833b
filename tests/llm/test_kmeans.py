import hashlib

import numpy as np
import pytest
from oracle import same

from shelfmark.llm import kmeans, queries

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k, rounds):
    """Lloyd's rounds in whole numbers, every distance made."""
    kept = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows]
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v.tolist()) for i, v in kept)[:k]
    c = [v for _, v in first]
    x = np.array([v for _, v in kept])
    for at in range(rounds + 1):
        d = ((x[:, None] - np.array(c)[None]) ** 2).sum(2)
        cluster = d.argmin(1)  # the first of equals
        if at < rounds:
            c = [[int(t) // n for t in x[cluster == j].sum(0)] if (n := int((cluster == j).sum())) else c[j] for j in range(len(c))]
    gap = d[np.arange(len(x)), cluster]
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return sorted((str(i), int(j), int(g), int(gap[cluster == j].sum()), int(gap.sum()), sha[j]) for (i, _), j, g in zip(kept, cluster, gap))


def got(df, **params):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in kmeans.clusters(df, **params).collect())


@pytest.mark.parametrize("grid", [3, 1000])
def test_equals_brute_force_with_many_ties(spark, grid):
    """On a grid of three values most distances tie."""
    rng = np.random.default_rng(grid)
    rows = [(i, (rng.integers(-grid, grid + 1, 5) / 64).tolist()) for i in range(900)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (None, rows[9][1])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(df, dims=5) == brute(rows, 16, 3)
    assert got(df, dims=5, k=40, rounds=6) == brute(rows, 40, 6)


def test_bounds_skip_distances_and_lose_none():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (12, 8))
    x = centres[rng.integers(0, 12, 5000)] + rng.integers(-60, 60, (5000, 8))
    c = centres + rng.integers(-80, 80, (12, 8))
    cluster, upper, lower, made = kmeans.assign(x, c, np.zeros(5000, np.int64), np.full(5000, np.inf), np.zeros((5000, 12)))
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (cluster == d.argmin(1)).all() and made < 5000 * 12
    exact = np.sqrt(d.astype(np.float64))
    assert (upper >= exact[np.arange(5000), cluster]).all() and (lower <= exact).all()
    moved = c + rng.integers(-3, 3, c.shape)
    shift = kmeans._up(np.sqrt(kmeans.gaps(moved, c).astype(np.float64)))
    again, upper, lower, made = kmeans.assign(x, moved, cluster, kmeans._up(upper + shift[cluster]), kmeans._down(lower - shift))
    assert (again == ((x[:, None] - moved[None]) ** 2).sum(2).argmin(1)).all() and made < 5000


def test_rows_that_dont_count_and_small_tables(spark):
    rows = [(1, [0.5, 1.0]), (2, [3.0, -1.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [1.0, float("nan")]), (7, [float("-inf"), 0.0]), (8, []), (9, [1e12, 0.0])]
    df = spark.createDataFrame([(*r, "c", "c", "c") for r in rows], SCHEMA + ", x string, cluster string, upper string")
    assert got(df, dims=2) == brute(rows[:2], 16, 3)
    assert got(df.limit(0)) == [] and got(df.where("vec_id = 3")) == []


def test_equal_vectors_leave_clusters_empty(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(50)] + [(50, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df, dims=3) == brute(rows, 16, 3)


def test_sums_beyond_a_long_are_null(spark):
    big = (2.0**27 - 1) / 64
    rows = [(i, [big if (i + d) % 2 else -big for d in range(64)]) for i in range(40)]
    out = kmeans.clusters(spark.createDataFrame(rows, SCHEMA), k=1, rounds=1).toPandas()
    assert out.distance.min() > 1 << 59 and out.inertia.isna().all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    same(queries.op12_centroid_clusters(spark, d), kmeans.ORACLE, d)
