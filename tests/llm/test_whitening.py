import numpy as np
import pytest

from spindrift.llm import bidiagonal, whitening

SCHEMA = "vec_id long, embedding array<float>, whitened string, component string"


def orthogonal(rng, n):
    return np.linalg.qr(rng.normal(size=(n, n)))[0]


def matrices():
    rng = np.random.default_rng(3)
    q, p = orthogonal(rng, 40), orthogonal(rng, 40)
    wilkinson = np.diag(np.abs(np.arange(-10.0, 11)) + 12) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    return {
        "tall": rng.normal(size=(300, 40)),
        "wide": rng.normal(size=(3, 40)),
        "low rank": rng.normal(size=(300, 4)) @ rng.normal(size=(4, 40)),
        "equal": np.eye(12),
        "zero": np.zeros((3, 5)),
        "one": np.array([[2.0]]),
        "repeated": np.diag([3.0, 3, 3, 1, 1, 0, 0]),
        "cluster": (q * np.r_[5 + 1e-12 * np.arange(15), np.linspace(1, 2, 25)]) @ p,
        "graded": (q * 10.0 ** -np.linspace(0, 12, 40)) @ p,
        "pairs": np.linalg.cholesky(wilkinson).T,
    }


@pytest.mark.parametrize("name", list(matrices()))
def test_singular_values_and_vectors(name):
    r = matrices()[name]
    squares, v = bidiagonal.singular(r)
    known = np.linalg.svd(r, compute_uv=False)
    known = np.pad(known, (0, r.shape[1] - len(known)))
    top = max(known[0], 1e-300)
    assert np.abs(np.sqrt(squares) - known).max() <= 1e-13 * top
    assert np.abs(v.T @ v - np.eye(r.shape[1])).max() < 1e-11
    assert np.abs(r.T @ (r @ v) - v * squares).max() <= 1e-12 * top**2
    assert (np.diff(squares) <= 0).all()


def test_qd_values_are_relatively_accurate():
    # a bidiagonal matrix with entries over twenty orders of magnitude defines all its singular values accurately
    a, b = 10.0 ** -np.arange(0, 20, 2.0), 10.0 ** -np.arange(1, 19, 2.0)
    found = np.sort(bidiagonal.block_values((a * a).tolist(), (b * b).tolist()))[::-1]
    from fractions import Fraction

    # det(B'B) is the product of the squared diagonal, and trace(B'B) their sum with the squared upper diagonal, in exact numbers
    assert abs(float(np.prod([Fraction(x) for x in found]) / np.prod([Fraction(x) ** 2 for x in a])) - 1) < 1e-13
    assert abs(found.sum() / ((a * a).sum() + (b * b).sum()) - 1) < 1e-14


def expected(x, k):
    """Eigenvectors of the covariance by another library."""
    c = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    return c, values[::-1][:k], vectors[:, ::-1][:, :k], values.sum()


def by_component(rows):
    out = {}
    for r in rows:
        out.setdefault(r.component, {})[r.vec_id] = r
    return out


def test_against_eigenvectors(spark):
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(700, 6)) * [3, 1, 2, 0.5, 4, 1.5] @ orthogonal(rng, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist(), "x", "y") for i, r in enumerate(v)], SCHEMA).repartition(5)
    found = by_component(whitening.whitened(df, components=4).collect())
    x = np.floor(64 * v.astype(float)) + 1_000_000
    c, values, vectors, total = expected(x, 4)
    exact = [int(s) for s in (((len(x) * x.astype(np.int64) - x.sum(axis=0).astype(np.int64)).astype(object)) ** 2).sum(axis=1)]
    assert sorted(found) == [1, 2, 3, 4]
    for k, rows in found.items():
        w = np.array([rows[i].whitened for i in range(len(v))])
        other = c @ vectors[:, k - 1] / np.sqrt(values[k - 1])
        assert min(np.abs(w - other).max(), np.abs(w + other).max()) < 1e-9
        assert abs(rows[0].explained / (values[k - 1] / total) - 1) < 1e-10
        assert rows[0].identity_error < 1e-10 and rows[0].n == 700
        assert [int(rows[i].deviation) for i in range(len(v))] == exact


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (2, [3.0, -1.0]), (None, [0.5, 0.25])]
    bad = [(4, None), (5, []), (6, [1.0, None]), (7, [nan, 1.0]), (8, [1.0, inf]), (9, [1.0, 2.0, 3.0]), (10, [1.0])]
    df = spark.createDataFrame([(i, v, None, "c") for i, v in good + bad], SCHEMA)
    rows = whitening.whitened(df).collect()
    assert sorted((str(r.vec_id), r.component) for r in rows) == sorted((str(i), k) for i, _ in good for k in (1, 2))
    assert {r.n for r in rows} == {4} and {r.identity_error < 1e-12 for r in rows} == {True}
    assert whitening.whitened(df.where("vec_id > 3 and vec_id < 9")).count() == 0
    assert whitening.whitened(df.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_components_without_variance(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 2.0, float(i % 3)], "", "") for i in range(30)], SCHEMA)
    found = by_component(whitening.whitened(df).collect())
    assert abs(found[1][0].explained - 1) < 1e-12 and found[1][0].identity_error < 1e-12
    assert all(r.whitened == 0 and r.explained == 0 for k in (2, 3) for r in found[k].values())
    same = whitening.whitened(df.where("vec_id = 0").union(df.where("vec_id = 0"))).collect()
    assert len(same) == 6 and all(r.whitened == 0 and r.deviation == 0 and r.identity_error == 0 for r in same)


def test_entries_that_64_bits_do_not_hold(spark):
    v = [[2.0**44, 1.0], [-(2.0**44), 0.0], [5.0, 3.0]]
    rows = whitening.whitened(spark.createDataFrame([(i, x, "", "") for i, x in enumerate(v)], SCHEMA), components=1).collect()
    x = [[int(64 * c // 1) + 1_000_000 for c in r] for r in v]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {r.vec_id: int(r.deviation) for r in rows} == {i: sum((3 * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for i, r in enumerate(x)}


def test_triangles_meet_in_a_tree(spark):
    rng = np.random.default_rng(5)
    parts = [rng.normal(size=(int(n), 3)) for n in rng.integers(1, 5, 40)]
    df = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(parts)], "part int, r binary")
    r, whole = whitening.joined_triangles(df, 3), np.concatenate(parts)
    assert r.shape == (3, 3) and np.allclose(r.T @ r, whole.T @ whole)
