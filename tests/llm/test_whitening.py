import numpy as np
import pytest

from shelfmark.llm import whitening
from shelfmark.llm.whitening import fit_whitening, lobpcg, orthonormal, whiten, whitened_components

SCHEMA = "vec_id long, embedding array<double>"


def brute(vectors, k):
    """(n, deviations, eigenvalues, unit eigenvectors, whitened, trace) from the whole matrix at once."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(1), e, u, c @ u / np.sqrt(e), np.trace(v)


def random_vectors(rows, dims, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(rows, dims)) @ np.diag(np.linspace(0.2, 3, dims)) + rng.normal(size=dims) * 50


@pytest.mark.parametrize(("dims", "k"), [(64, 32), (5, 32), (150, 6)])
def test_components_are_the_eigenvectors(spark, dims, k):
    """Blocks that span all dimensions, fewer dimensions than components, and blocks far smaller than the dimensions."""
    vectors = random_vectors(700, dims)
    n, deviation, e, u, white, trace = brute(vectors, min(k, dims))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA).repartition(5)
    out = whitened_components(df, components=k).toPandas().sort_values(["vec_id", "component"])
    assert len(out) == 700 * min(k, dims) and (out.n == n).all()
    assert out.deviation.iloc[:: min(k, dims)].tolist() == deviation.tolist()
    assert out.identity_error.nunique() == 1 and out.identity_error.iloc[0] < 1e-9
    got = out.whitened.to_numpy().reshape(700, -1)
    signs = np.sign((got * white).sum(0))
    assert np.abs(got * signs - white).max() < 1e-6
    assert np.allclose(out.explained.iloc[: min(k, dims)], e / trace, rtol=1e-10)


def test_residuals_are_certified_and_take_rounds():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(200, 200)))
    v = q * np.linspace(1, 0.001, 200) @ q.T
    products = []
    e, x, norms, rounds = lobpcg(lambda b: products.append(b.shape[1]) or v @ b, 200, 10)
    assert np.allclose(e, np.linspace(1, 0.001, 200)[:10], rtol=1e-12) and (norms <= 2e-12).all() and rounds > 3
    assert np.abs(x.T @ x - np.eye(10)).max() < 1e-12 and max(products) <= 36
    with pytest.raises(RuntimeError):
        lobpcg(lambda b: v @ b, 200, 10, max_rounds=1)


def test_orthonormal_drops_what_adds_nothing():
    x, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(6, 2)))
    q = orthonormal(x, np.concatenate([x, np.zeros((6, 1)), np.eye(6)[:, :1], np.eye(6)[:, :1] * 7], axis=1))
    assert q.shape == (6, 3) and np.abs(q.T @ q - np.eye(3)).max() < 1e-12


def test_rows_that_dont_count_and_odd_tables(spark):
    good = [[float(i % 7), float(i % 3), i / 64] for i in range(60)]
    rows = [(i, v) for i, v in enumerate(good)]
    rows += [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 1.0, 2.0]), (104, []), (105, [1.0, 2.0]), (106, [1e300, 1.0, 1.0]), (None, good[3]), (5, good[5])]
    clash = SCHEMA + ", x string, at string, n string, v string, whitened string"
    df = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], clash)
    out = whitened_components(df).toPandas()
    n, deviation, e, _, white, _ = brute([*good, good[3], good[5]], 3)
    assert set(out.n) == {62} and len(out) == 62 * 3 and out.vec_id.isna().sum() == 3
    assert sorted(out[out.component == 1].deviation) == sorted(deviation.tolist())
    assert np.allclose(sorted(abs(out.whitened)), sorted(abs(white).ravel()), atol=1e-9)
    assert whitened_components(df.limit(0)).count() == 0
    assert whitened_components(df.where("vec_id = 100")).count() == 0


def test_flat_directions_have_no_component(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], SCHEMA)
    assert whitened_components(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], SCHEMA)
    out = whitened_components(line).toPandas()
    assert out.component.unique().tolist() == [1] and abs(out.explained.iloc[0] - 1) < 1e-12


def test_sums_and_deviations_are_exact_at_any_size(spark):
    rows = [(i, [2.0**45 + i, float(-i)]) for i in range(40)]
    table, model = fit_whitening(spark.createDataFrame(rows, SCHEMA))
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    assert list(model.sums) == sums
    want = {i: sum((40 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in whiten(table, model).collect()} == want
    step = whitening.centring(10**12, (10**18 + 7,), 10**9)(np.array([[10**9]]))
    assert int(step[0, 0]) == 10**12 * 10**9 - (10**18 + 7)
