import numpy as np
import pytest
from cohortflow.llm.ann import BITS, PARTS, Index, learn, nearest
from cohortflow.llm.common import table
from pyspark.sql import types as T

from .conftest import SF

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType())])


def brute(ids, x, queries, k=20):
    out = {}
    for q in queries:
        s = (x * x[ids == q][0]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), s[i]) for i in order]
    return out


def got_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("block", [300, 8192])
def test_recall_on_embeddings(spark, block):
    vectors = table(spark, SF.replace("sf0.001", "sf0.1"), "embeddings")
    rows = sorted(vectors.select("vec_id", "embedding").collect())
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want = brute(ids, x, [int(i) for i in ids if i % 20 == 0])
    got = got_of(nearest(vectors, vectors.filter("vec_id % 20 = 0"), block=block))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.95
    score = {q: (x * x[ids == q][0]).sum(axis=1) for q in got}
    for q, near in got.items():
        assert all(abs(s - score[q][ids == v][0]) < 1e-12 for v, s in near)
        assert near == sorted(near, key=lambda a: (-a[1], a[0]))


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (3000, PARTS), dtype=np.uint8)
    index = Index(codes)
    for radius in (0, 7, 8, 20, 25, BITS):
        for q in codes[:5] ^ rng.integers(0, 4, (5, PARTS), dtype=np.uint8):
            want = np.flatnonzero(np.bitwise_count(codes ^ q).sum(axis=1) <= radius)
            assert np.array_equal(index.probe(q, radius), want)


def test_rotation_beats_plain_signs():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 64)) * np.linspace(3, 0.1, 64)
    codes = learn(x, np.linalg.norm(x, axis=1).max(), 20, 0.9)
    assert codes.matrix.shape == (65, BITS) and 0 < codes.radius < BITS // 2


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [0.0, 2.0], 1), (40, None, 1), (60, [0.0, 0.0], 1), (80, [nan, 1.0], 1), (100, [inf, 1.0], 1),
            (120, [None, 1.0], 1), (140, [], 1), (160, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (7, [1.0, 0.0], 2), (7, [1.0, 0.0], 2),
            (5, [1.0, 0.0], None), (9, [-3.0, 0.5], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "vector")
    got = got_of(nearest(df, df.filter("vec_id % 20 = 0")))
    assert got == {0: [(5, 1.0), (7, 1.0), (20, 0.0), (9, -3.0)], 20: [(9, 1.0), (0, 0.0), (5, 0.0), (7, 0.0)]}
    many = spark.createDataFrame([(i, [0.6, 0.8], 0) for i in range(500)] + [(1000, [0.8, 0.6], 0)], SCHEMA)
    got = got_of(nearest(many, many.filter("vec_id % 20 = 0"), block=64))
    assert [v for v, _ in got[40]] == list(range(20)) and [v for v, _ in got[0]] == list(range(1, 21)) and [v for v, _ in got[1000]] == list(range(20))
    none = spark.createDataFrame([], SCHEMA)
    assert nearest(none, none).collect() == [] and nearest(df.filter("vec_id = 0"), df.filter("vec_id = 0")).collect() == []
