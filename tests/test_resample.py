import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortflow.operators import resample as RS
from cohortflow.operators.neighbours import knn_join


def frame(spark, keys, x, label=None):
    rows = [(k, 0 if label is None else label[i], *map(float, v)) for i, (k, v) in enumerate(zip(keys, x, strict=True))]
    kind = "string" if keys and isinstance(keys[0], str) else "long"
    cols = [f"x{i}" for i in range(len(x[0]) if len(x) else 2)]
    return spark.createDataFrame(rows, f"key {kind}, label int, " + ", ".join(f"{c} double" for c in cols)).repartition(5), cols


def brute(ask, base, k):
    out = {}
    for q, v in ask:
        d = sorted((sum((a - b) * (a - b) for a, b in zip(v, w, strict=True)), o) for o, w in base if o != q)
        out[q] = [o for _, o in d[:k]]
    return out


def got_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.key, r.rank)):
        out.setdefault(r.key, []).append(r.neighbour)
        assert r.rank == len(out[r.key])
    return out


@pytest.mark.parametrize("block,pivots", [(20_000, 128), (7, 5), (3, 1), (50, 40)])
def test_neighbours_equal_brute_force(spark, block, pivots):
    rng = np.random.default_rng(block)
    x = np.concatenate([rng.standard_normal((150, 3)), rng.integers(0, 3, (120, 3)), np.zeros((40, 3)), 1e6 + rng.random((5, 3)), -np.zeros((2, 3))])
    keys = rng.permutation(len(x) * 2)[:len(x)].tolist()
    df, cols = frame(spark, keys, x)
    rows = list(zip(keys, x.tolist(), strict=True))
    assert got_of(knn_join(df, df, "key", cols, 4, pivots, block)) == brute(rows, rows, 4)
    ask = df.filter("key % 3 = 0")
    rest = df.filter("key % 5 > 0")
    want = brute([r for r in rows if r[0] % 3 == 0], [r for r in rows if r[0] % 5], 2)
    assert got_of(knn_join(ask, rest, "key", cols, 2, pivots, block)) == want


def test_neighbours_of_text_keys_and_few_rows(spark):
    df, cols = frame(spark, ["b", "a", "é", "z"], [[0, 0], [0, 0], [0, 0], [3, 4]])
    out = {(r.key, r.rank): (r.neighbour, r.distance) for r in knn_join(df, df, "key", cols, 5).collect()}
    assert out["z", 1] == ("a", 5.0) and out["a", 1] == ("b", 0.0) and out["b", 1] == ("a", 0.0) and out["é", 2] == ("b", 0.0)
    assert len(out) == 12
    none = df.limit(0)
    assert knn_join(df, none, "key", cols, 3).collect() == [] and knn_join(none, df, "key", cols, 3).collect() == []


def test_neighbours_refuse_missing_entries(spark):
    for bad in (float("nan"), float("inf")):
        df, cols = frame(spark, [1, 2], [[0, 0], [1, bad]])
        with pytest.raises(PySparkException, match="impute"):
            knn_join(df, df, "key", cols, 1).collect()


def test_a_vector_that_half_of_the_rows_share(spark):
    x = np.concatenate([np.zeros((3000, 2)), np.random.default_rng(1).standard_normal((3000, 2))])
    df, cols = frame(spark, list(range(len(x))), x)
    got = got_of(knn_join(df, df, "key", cols, 3, 16, 500))
    assert got[7] == [0, 1, 2] and got[0] == [1, 2, 3] and len(got) == 6000
    rows = list(zip(range(len(x)), x.tolist(), strict=True))
    assert {q: got[q] for q in range(5900, 5920)} == brute(rows[5900:5920], rows, 3)


def test_ordinal(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"), "id").repartition(6)
    got = sorted((r.ordinal, r.v) for r in RS.ordinal(df, F.desc("v"), "id").collect())
    assert [o for o, _ in got] == list(range(1, 1001)) and [v for _, v in got] == sorted((v for _, v in got), reverse=True)


def classes(df):
    return {r.label: (r.n, r.made) for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("copy") > 0).alias("made")).collect()}


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((37, 2)) + 1, rng.standard_normal((160, 2))])
    return *frame(spark, list(range(197)), x, [1] * 37 + [0] * 160), x


def test_smote_points_lie_between_minority_neighbours(sample):
    df, cols, x = sample
    out = RS.smote(df, "key", "label", cols, k=3, block=10, pivots=4).cache()
    assert classes(out) == {0: (160, 0), 1: (160, 123)}
    near = brute(list(enumerate(x[:37].tolist())), list(enumerate(x[:37].tolist())), 3)
    per, used = {}, set()
    for r in out.filter("copy > 0").collect():
        a, b, p = x[r.key], x[r.neighbour], np.array([r.x0, r.x1])
        assert r.neighbour in near[r.key]
        t = (p - a) @ (b - a) / ((b - a) @ (b - a))
        assert -1e-9 <= t < 1 and np.allclose(p, a + t * (b - a))
        per[r.key] = per.get(r.key, 0) + 1
        used.add(near[r.key].index(r.neighbour))
    assert set(per.values()) == {3, 4} and sum(per.values()) == 123 and used == {0, 1, 2}
    again = RS.smote(df.repartition(2), "key", "label", cols, k=3)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    out.unpersist()


def test_smote_of_small_and_missing_classes(spark):
    df, cols = frame(spark, [1, 2, 3, 4], [[0, 0], [1, 1], [2, 2], [3, 3]], [1, 0, 0, 0])
    made = RS.smote(df, "key", "label", cols).filter("copy > 0").collect()
    assert [(r.key, r.neighbour, r.x0) for r in made] == [(1, None, 0.0)] * 2
    for label in ([0] * 4, [1] * 4):
        only, _ = frame(spark, [1, 2, 3, 4], [[0, 0], [1, 1], [2, 2], [3, 3]], label)
        assert RS.smote(only, "key", "label", cols).count() == 4 and RS.adasyn(only, "key", "label", cols).count() == 4
        assert RS.smote_tomek(only, "key", "label", cols).count() == 4
    none = df.withColumn("label", F.when(F.col("key") > 3, None).otherwise(F.col("label")))
    assert classes(RS.smote(none, "key", "label", cols)) == {1: (2, 1), 0: (2, 0), None: (1, 0)}


def test_adasyn_quotas(sample):
    df, cols, x = sample
    got = {r.key: (r.hard, r.quota) for r in RS.adasyn_quotas(df, "key", "label", cols, k=5, block=20, pivots=6).collect()}
    rows = list(enumerate(x.tolist()))
    hard = {q: sum(n >= 37 for n in near) for q, near in brute(rows[:37], rows, 5).items()}
    whole = sum(hard.values())
    quota = {q: 123 * h // whole for q, h in hard.items()}
    for q in sorted(hard, key=lambda q: (-(123 * hard[q] % whole), q))[:123 - sum(quota.values())]:
        quota[q] += 1
    assert got == {q: (hard[q], quota[q]) for q in hard} and sum(quota.values()) == 123
    assert classes(RS.adasyn(df, "key", "label", cols)) == {0: (160, 0), 1: (160, 123)}
    apart, _ = frame(df.sparkSession, list(range(9)), [[0, i] for i in range(4)] + [[99, i] for i in range(5)], [1] * 4 + [0] * 5)
    assert RS.adasyn(apart, "key", "label", cols, k=3).count() == 9


def test_tomek_links_and_removal(sample):
    df, cols, x = sample
    rows = list(enumerate(x.tolist()))
    nn = {q: n[0] for q, n in brute(rows, rows, 1).items()}
    want = {(a, b) for a, b in nn.items() if nn[b] == a and (a < 37) != (b < 37)}
    assert {(r.key, r.neighbour) for r in RS.tomek_links(df, "key", "label", cols, block=30, pivots=5).collect()} == want and want
    full = {f"{r.key}#{r.copy:06}": (r.label, (r.x0, r.x1)) for r in RS.smote(df, "key", "label", cols).collect()}
    rows = [(k, list(v)) for k, (_, v) in full.items()]
    nn = {q: n[0] for q, n in brute(rows, rows, 1).items()}
    left = {a for a, b in nn.items() if not (nn[b] == a and full[a][0] != full[b][0])}
    assert {r.row_key for r in RS.smote_tomek(df, "key", "label", cols).collect()} == left


def test_comparison_and_folds(sample):
    df, cols, _ = sample
    got = {(r.method, r.label): (r.n, r.synthetic, r.pct) for r in RS.compare_resamplers(df, "key", "label", cols).collect()}
    assert got["none", 1] == (37, 0, round(3700 / 197, 4)) and got["smote", 1] == (160, 123, 50.0) and got["adasyn", 1] == (160, 123, 50.0)
    assert got["smote_tomek", 1][0] < 160
    folds = df.withColumn("fold", (F.col("key") % 3).cast("int"))
    out = RS.resample_folds(folds, "key", "label", cols, "fold", k=2)
    assert out.filter("key % 3 = fold OR neighbour % 3 = fold").count() == 0
    for f in range(3):
        n = [sum(1 for i in range(197) if i % 3 != f and (i < 37) == (c == 1)) for c in (0, 1)]
        assert classes(out.filter(F.col("fold") == f)) == {0: (n[0], 0), 1: (n[0], n[0] - n[1])}
