"""Centroid clustering with Elkan's bounds, exact in whole numbers.

Every vector carries its cluster, an upper bound on the distance to its centroid and a lower bound on the distance to each of
the k centroids; the table with them is written once a round, so a lost executor costs a retry. In a round a centroid j is skipped for
a vector if the upper bound is less than the lower bound of j, or than half the distance between j and the vector's centroid. After the
centroids move, bounds give way by the distance moved.

Bounds are doubles, rounded against themselves (upper ones up, lower ones down), and pruning is strict: a centroid that is skipped is
surely farther, so ties are decided by exact squared distances of whole numbers, the smaller number first. Sums, means (floor) and the
final distances are exact. Sums of the clusters are made in each task before the shuffle, so a hot cluster or vector is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, map_arrow
from .vectors import exact_sum, fixed_point, list_array, matrix, parts

#: Entries under this size have squared distances that a long holds, in up to 64 dimensions.
LIMIT = 2.0**27
STATE = "vec_id long, x array<long>, cluster int, upper double, lower array<double>"


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(x, -np.inf), -np.inf), 0.0)


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a and b (whole numbers), pair by pair."""
    d = a - b
    return (d * d).sum(-1)


def assign(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower) of the rows of x after one assignment to the nearest centroid, and how many distances that took."""
    k, n = len(centroids), len(x)
    half = _down(np.sqrt(gaps(centroids[:, None], centroids[None]).astype(np.float64))) / 2
    np.fill_diagonal(half, np.inf)
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    best = np.full(n, -1, np.int64)  # exact squared distance to the own centroid, once known
    made = 0
    # A row stays as it is if even its nearest other centroid is surely farther.
    open_ = np.flatnonzero(~(upper < half[cluster].min(1)))
    for j in range(k):
        may = lambda r: (cluster[r] != j) & ~(upper[r] < lower[r, j]) & ~(upper[r] < half[cluster[r], j])  # noqa: E731, B023
        rows = open_[may(open_)]
        new = rows[best[rows] < 0]
        if len(new):
            best[new] = gaps(x[new], centroids[cluster[new]])
            upper[new] = _up(np.sqrt(best[new].astype(np.float64)))
            lower[new, cluster[new]] = _down(np.sqrt(best[new].astype(np.float64)))
            made += len(new)
            rows = rows[may(rows)]
        if not len(rows):
            continue
        d = gaps(x[rows], centroids[j])
        made += len(rows)
        lower[rows, j] = _down(np.sqrt(d.astype(np.float64)))
        nearer = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
        moved = rows[nearer]
        cluster[moved], best[moved] = j, d[nearer]
        upper[moved] = _up(np.sqrt(d[nearer].astype(np.float64)))
    return cluster, upper, lower, made


def _assigned(state: DataFrame, centroids: list[list[int]], moved: list[float] | None, dims: int) -> DataFrame:
    """state after one assignment; moved: how far each centroid went since the last one, rounded up (None: there was none)."""
    at, shift, k = np.array(centroids, np.int64), None if moved is None else np.array(moved), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            x = matrix(part.column(1), dims)
            if shift is None:
                cluster, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros((len(x), k))
            else:
                cluster = part.column(2).to_numpy().astype(np.int64)
                upper = _up(part.column(3).to_numpy() + shift[cluster])
                lower = _down(part.column(4).flatten().to_numpy().reshape(-1, k) - shift)
            cluster, upper, lower, _ = assign(x, at, cluster, upper, lower)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper), list_array(lower)], schema=pa.schema([("vec_id", pa.int64()), ("x", part.column(1).type), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.list_(pa.float64()))]))

    return map_arrow(state, run, STATE)


def _means(state: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """floor(sum / count) of each cluster, component by component; an empty cluster's centroid stays."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for part in parts(batches):
            x, cluster = matrix(part.column(0), dims), part.column(1).to_numpy()
            for j in np.unique(cluster):
                own = x[cluster == j]
                count[j] += len(own)
                total[j] += own.sum(0)
            if int(count.sum()) > 1 << 30:  # long before a long runs over
                yield from rows(count, total)
                count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        yield from rows(count, total)

    def rows(count: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        j = np.flatnonzero(count)
        if len(j):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(j, dims)), pa.array(np.tile(np.arange(dims), len(j))), pa.array(np.repeat(count[j], dims)), pa.array(total[j].ravel())], names=["cluster", "at", "n", "total"])

    made = map_arrow(state.select("x", "cluster"), run, "cluster long, at long, n long, total long")
    out = [list(c) for c in centroids]
    for r in made.groupBy("cluster", "at").agg(F.sum("n").alias("n"), exact_sum("total").alias("total")).collect():
        out[r.cluster][r.at] = int(r.total) // r.n
    return out


def first_centroids(rows: DataFrame, k: int, seed: str = "1") -> list[list[int]]:
    """The k rows with the least sha256 of seed:vec_id, in that order; rows of one id follow each other by their vectors."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.x) for r in rows.select("x", order.alias("h")).orderBy("h", "x").limit(k).collect()]


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, column: str = "embedding", seed: str = "1") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance: a table in the shared folder; the final centroids).

    Kept are vectors of dims components, none null, non-finite or of 2**27 / 64 and more in size (squared distances are longs). Fewer kept vectors
    than k give as many centroids as there are; none give no rows. Repeated rows and null ids (hashed as nothing) are rows like any other.
    """
    base = cut(fixed_point(vectors, column, LIMIT, dims=dims), "vectors")
    centroids = first_centroids(base, k, seed)
    if not centroids:
        return base.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    state, moved = base.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(0.0).alias("upper"), F.array(F.lit(0.0)).alias("lower")), None
    last = base
    for _ in range(rounds):
        state = cut(_assigned(state, centroids, moved, dims), "bounds")
        drop(last)
        last, new = state, _means(state, centroids, dims)
        moved = _up(np.sqrt(gaps(np.array(new, np.int64), np.array(centroids, np.int64)).astype(np.float64))).tolist()
        centroids = new
    at = np.array(centroids, np.int64)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            cluster = part.column(2).to_numpy()
            d = gaps(matrix(part.column(1), dims), at[cluster])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(d)], names=["vec_id", "cluster", "distance"])

    out = cut(map_arrow(_assigned(state, centroids, moved, dims).select("vec_id", "x", "cluster"), exact, "vec_id long, cluster int, distance long"), "clusters")
    drop(last)
    return out, centroids


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, column: str = "embedding", seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; sums that no long holds are null (see cluster_vectors)."""
    rows, centroids = cluster_vectors(vectors, k, rounds, dims, column, seed)
    sums = {r.cluster: int(r.total) for r in rows.groupBy("cluster").agg(exact_sum("distance").alias("total")).collect()}  # k rows
    long = lambda v: v if v < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))
    own = of([long(sums.get(j, 0)) for j in range(len(centroids))], "bigint")
    return rows.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(long(sum(sums.values()))).cast("long").alias("inertia"), of(sha, "string").alias("centroid_sha256"))


def _oracle(rounds: int) -> str:
    """The rounds unrolled: long tables of (vector, dimension, entry), distances by sums, the nearest by (distance, number)."""
    sql = """
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, [floor(64 * e::DOUBLE)::BIGINT FOR e IN embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(e)]) = 64),
entry AS (SELECT r, unnest(x) AS v, unnest(range(64)) AS d FROM kept),
start AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x FROM kept ORDER BY sha256('1:' || vec_id), x LIMIT 16),
c0 AS (SELECT c, unnest(x) AS v, unnest(range(64)) AS d FROM start)"""
    for i in range(rounds + 1):
        sql += f""",
g{i} AS (SELECT r, c, sum((e.v - c.v) * (e.v - c.v))::BIGINT AS gap FROM entry e JOIN c{i} c USING (d) GROUP BY r, c),
a{i} AS (SELECT r, min(struct_pack(gap := gap, c := c)) AS m FROM g{i} GROUP BY r)"""
        if i < rounds:
            sql += f""",
m{i} AS (SELECT m.c AS c, d, sum(v)::BIGINT AS total, count(*) AS n FROM a{i} JOIN entry USING (r) GROUP BY 1, 2),
c{i + 1} AS (SELECT c.c, c.d, CASE WHEN n IS NULL THEN c.v ELSE (total - ((total % n) + n) % n) // n END AS v FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c AND m.d = c.d)"""
    return (
        sql
        + f""",
named AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY d)) AS sha FROM c{rounds} GROUP BY c)
SELECT vec_id, m.c::INT AS cluster, m.gap AS distance, (sum(m.gap) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.gap) OVER ())::BIGINT AS inertia, sha AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN named ON named.c = m.c
"""
    )


ORACLE = _oracle(3)
