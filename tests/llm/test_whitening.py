import numpy as np
import pytest
from cohortflow.llm.common import table
from cohortflow.llm.whitening import leading_pairs, leading_values, sturm_count, tridiagonal, whiten
from pyspark.sql import types as T

from .conftest import SF

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType())])


def vectors(spark, rows, parts=3):
    rows = [(i, v, 7, 7) for i, v in rows]  # columns with clashing names are ignored
    return spark.createDataFrame(rows, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)


def brute(x, k=8):
    """From the whole numbers alone, by another solver."""
    n, s = len(x), x.sum(axis=0)
    dev = [sum(int(v) ** 2 for v in n * r.astype(object) - s) for r in x]
    c = (n * x - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return dev, e, c @ v / np.sqrt(e), e / np.trace(c.T @ c / n)


def symmetric(d, seed, values=None):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    return q @ np.diag(values if values is not None else np.random.default_rng(seed).exponential(size=d)) @ q.T


@pytest.mark.parametrize("d", [1, 2, 3, 5, 40, 130])
def test_eigenpairs_of_dense_matrices(d):
    a = symmetric(d, d) * 1e7
    a = (a + a.T) / 2
    e, v = leading_pairs(a, 8)
    want = np.linalg.eigvalsh(a)[::-1][:8]
    assert len(e) == min(8, d) and np.allclose(e, want, rtol=1e-12)
    assert np.allclose(v @ v.T, np.eye(len(e)), atol=1e-11)
    assert np.abs(a @ v.T - v.T * e).max() < 1e-12 * np.abs(a).max() * d


def test_clusters_and_equal_eigenvalues_give_orthogonal_vectors():
    for values in ([3, 3, 3, 3, 1, 1, 1, 0, 0, 0], [1 + 1e-13 * i for i in range(10)], [5, 5 - 1e-5, 5 - 2e-5, 2, 2, 1, 1, 1, 1, 1]):
        a = symmetric(10, 3, np.array(values, float))
        e, v = leading_pairs((a + a.T) / 2, 8)
        assert np.allclose(e, sorted(values)[::-1][:8], atol=1e-13)
        assert np.allclose(v @ v.T, np.eye(8), atol=1e-12)
        assert np.abs(a @ v.T - v.T * e).max() < 1e-13
    for a in (np.eye(6), np.zeros((4, 4)), np.diag([1.0, 2, 3, 4])):
        e, v = leading_pairs(a, 4)
        assert np.allclose(v @ v.T, np.eye(4)) and np.allclose(a @ v.T, v.T * e)


def test_householder_and_sturm_counts():
    a = symmetric(30, 9)
    a = (a + a.T) / 2
    d, e, _ = tridiagonal(a)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    real = np.linalg.eigvalsh(a)
    assert np.allclose(np.linalg.eigvalsh(t), real)
    at = np.linspace(real[0] - 1, real[-1] + 1, 50)
    assert np.array_equal(sturm_count(d, e, at), [(real < x).sum() for x in at])
    assert np.allclose(leading_values(d, e, 30), real[::-1], atol=1e-13)


def test_whole_table_against_another_solver(spark):
    df = table(spark, SF.replace("sf0.001", "sf0.1"), "embeddings")
    rows = sorted(df.select("vec_id", "embedding").collect())
    x = np.floor(1024 * np.array([r.embedding for r in rows], np.float64)).astype(np.int64) + 100000
    dev, e, z, share = brute(x)
    got = {(r.vec_id, r.component): r for r in whiten(df).collect()}
    assert len(got) == 8 * len(rows)
    for k in range(8):
        mine = np.array([got[r.vec_id, k + 1].whitened for r in rows])
        sign = np.sign(mine @ z[:, k])
        assert np.abs(mine - sign * z[:, k]).max() < 1e-8
    for at, r in enumerate(rows):
        g = got[r.vec_id, 3]
        assert g.n == len(rows) and g.deviation == dev[at] and abs(g.explained / share[2] - 1) < 1e-10
    assert len({r.identity_error for r in got.values()}) == 1 and 0 <= got[rows[0].vec_id, 1].identity_error < 1e-9


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 5)).astype(np.float32).astype(float)
    good = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (3, x[3].tolist())]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
           (104, []), (105, [1.0, 2.0]), (106, [3e38] * 5)]
    got = whiten(vectors(spark, good + bad, 7), components=8).collect()
    whole = np.floor(1024 * np.concatenate([x, x[:1], x[3:4]])).astype(np.int64) + 100000
    dev, e, z, share = brute(whole, 5)
    assert len(got) == 42 * 5 and {r.n for r in got} == {42} and {r.component for r in got} == {1, 2, 3, 4, 5}
    assert sum(r.vec_id is None for r in got) == 5 and sum(r.vec_id == 3 for r in got) == 10
    for r in got:
        at = 0 if r.vec_id is None else r.vec_id
        assert r.deviation == dev[at] and abs(abs(r.whitened) - abs(z[at, r.component - 1])) < 1e-8
        assert abs(r.explained - share[r.component - 1]) < 1e-10


def test_no_variance_and_empty(spark):
    same = whiten(vectors(spark, [(i, [1.0, 2.0, 3.0]) for i in range(5)])).collect()
    assert len(same) == 15 and all((r.whitened, r.explained, r.identity_error, r.deviation, r.n) == (None, None, None, 0, 5) for r in same)
    line = whiten(vectors(spark, [(i, [float(i), 2.0 * i]) for i in range(4)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and line[0].identity_error < 1e-12
    assert whiten(vectors(spark, [])).collect() == [] and whiten(vectors(spark, [(1, None)])).columns[0] == "vec_id"


def test_deviation_beyond_a_long(spark):
    far = [(0, [0.0]), (1, [0.0]), (2, [4e12])]
    got = {r.vec_id: r for r in whiten(vectors(spark, far)).collect()}
    x = [100000, 100000, int(np.float32(4e12)) * 1024 + 100000]
    s = sum(x)
    want = [(3 * v - s) ** 2 for v in x]
    assert [got[i].deviation for i in range(3)] == [w if w < 1 << 63 else None for w in want] and want[2] >= 1 << 63
