import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortflow.functions.quantiles import approx_quantiles, exact_quantiles
from cohortflow.operators import profile as P

ROWS = [(1, "a", 10.0, 0), (1, "b", None, 1), (2, "a", 30.0, 0), (3, "c", 40.0, 1), (3, "a", 50.0, 1),
        (3, "a", 50.0, 1)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "k long, cat string, x double, y int")


def pdf():
    return pd.DataFrame(ROWS, columns=["k", "cat", "x", "y"])


def test_missing_report(df):
    r = {x["column_name"]: x for x in P.missing_report(df).collect()}
    assert r["x"]["n_missing"] == 1 and r["x"]["pct_missing"] == pytest.approx(100 / 6, abs=1e-4)
    assert r["k"]["n_missing"] == 0
    assert [x["column_name"] for x in P.missing_report(df, only_missing=True).collect()] == ["x"]


def test_group_size_summary(df):
    r = P.group_size_summary(df, "k", 1).collect()[0]
    assert (r["n_groups"], r["max_size"], r["n_above"]) == (3, 3, 2)
    assert r["mean_size"] == pytest.approx(2.0) and r["pct_above"] == pytest.approx(66.6667, abs=1e-4)


def test_frequency_ties_and_share(df):
    out = [(r["cat"], r["n"], r["pct"]) for r in P.frequency(df, "cat").collect()]
    assert out == [("a", 4, pytest.approx(66.6667, abs=1e-4)), ("b", 1, pytest.approx(16.6667, abs=1e-4)),
                   ("c", 1, pytest.approx(16.6667, abs=1e-4))]
    assert [r["cat"] for r in P.frequency(df, "cat", top=2).collect()] == ["a", "b"]


def test_describe_matches_pandas(df):
    d = {(r["column_name"], r["statistic"]): r["value"] for r in P.describe(df, ["x"]).collect()}
    ref = pdf()["x"].describe()
    for stat in ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]:
        assert d[("x", stat)] == pytest.approx(ref[stat], abs=1e-6), stat


def test_two_group_compare(df):
    r = P.two_group_compare(df, "y", ["x"]).collect()[0]
    p = pdf()
    a, b = p[p.y == 0].x.mean(), p[p.y == 1].x.mean()
    assert r["mean_a"] == pytest.approx(a) and r["mean_b"] == pytest.approx(b)
    assert r["pct_difference"] == pytest.approx((b - a) / a * 100, abs=1e-3)


def test_duplicates_and_orphans(spark, df):
    r = P.duplicate_count(df, ["k", "cat", "x"]).collect()[0]
    assert (r["n_rows"], r["n_distinct"], r["n_duplicates"]) == (6, 5, 1)
    parent = spark.createDataFrame([(1,), (2,)], "k long")
    assert P.orphan_count(df, parent, "k", "k").collect()[0][0] == 3


def test_histogram_matches_numpy(spark):
    vals = np.random.default_rng(7).normal(size=500)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = {r["bin"]: r["n"] for r in P.histogram(df, "x", 20).collect()}
    counts, _ = np.histogram(vals, bins=20)
    assert [got.get(i, 0) for i in range(20)] == counts.tolist()


def test_calendar_best_first_seen(spark):
    import datetime as dt
    ev = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 6)),
                                (3, dt.datetime(2023, 12, 31))], "id long, ts timestamp_ntz")
    cal = {(r["part"], r["value"]): r["n"] for r in P.calendar_breakdown(ev, "ts").collect()}
    assert cal[("year", 2024)] == 2 and cal[("weekday", 0)] == 1 and cal[("weekday", 5)] == 1
    g = spark.createDataFrame([(5, 3), (2, 3), (9, 1)], "k long, n long")
    assert P.best_by(g, "k", "n").collect()[0]["k"] == 2  # tie -> smallest key
    fs = {r["v"]: r["first_position"] for r in P.first_seen(
        spark.createDataFrame([(3, "x"), (1, "y"), (2, "x")], "pos long, v string"), "v", "pos").collect()}
    assert fs == {"x": 2, "y": 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles_with_heavy_ties(spark, seed):
    rng = np.random.default_rng(seed)
    vals = np.concatenate([np.full(700, 3.0), rng.normal(size=1300)])  # one value holds a third
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.8, 0.99, 1.0]
    got = exact_quantiles(df, "x", probs, bins=16, final_rows=50)
    assert np.allclose(got, np.percentile(vals, [p * 100 for p in probs]), atol=1e-12)
    approx = approx_quantiles(df, "x", [0.5])
    assert abs(approx[0] - np.median(vals)) < 0.1


def test_exact_quantiles_over_any_range(spark):
    """300 decades, both signs, infinities and ties, several columns in the same passes."""
    import numpy as np
    from cohortflow.functions.quantiles import exact_quantiles, exact_quantiles_of
    rng = np.random.default_rng(9)
    wide = 10.0 ** rng.uniform(-150, 150, 20_000)
    both = np.concatenate([-wide[:9000], np.zeros(500), wide[9000:19000], [np.inf, -np.inf, 5e-324, -5e-324], rng.normal(size=496)])
    ties = rng.integers(0, 4, 20_000).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(wide, both, ties)], "a double, b double, c double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.505, 0.99, 1.0]
    got = exact_quantiles_of(df, {c: probs for c in "abc"}, bins=64, final_rows=20)
    for c, x in zip("abc", (wide, both, ties)):
        x = np.sort(x)
        for p, g in zip(probs, got[c]):
            pos = (len(x) - 1) * p
            lo, hi = x[int(pos)], x[min(int(pos) + 1, len(x) - 1)]
            with np.errstate(invalid="ignore"):
                want = lo if lo == hi else lo + (pos - int(pos)) * (hi - lo)
            assert g == pytest.approx(want, rel=1e-12) or (np.isinf(want) and g == want) or np.isnan(want)
    assert exact_quantiles(df.filter("a < 0"), "a", [0.5]) == [None]


@pytest.mark.parametrize("largest", [True, False])
def test_best_by_ties(spark, largest):
    from cohortflow.operators.profile import best_by
    for keys in (("a", "b", "c"), (1, 2, 3)):
        df = spark.createDataFrame([(keys[1], 5.0), (keys[0], 5.0), (keys[2], None)], ["k", "m"])
        assert tuple(best_by(df, "k", "m", largest).first()) == (keys[0], 5.0)


def test_stratified_split_and_folds_are_exact(spark):
    from cohortflow.operators.prep import stratified_folds, stratified_split
    rows = [(i, 1 if i % 11 == 0 else (None if i % 97 == 0 else 0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, y int")
    n = {r["y"]: r["n"] for r in df.groupBy("y").agg(F.count("*").alias("n")).collect()}
    got = {(r["y"], r["split"]): r["n"] for r in stratified_split(df, "k", "y", 0.2).groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    assert {y: got[y, "test"] for y in n} == {y: int(c * 0.2 + 0.5) for y, c in n.items()}
    folds = stratified_folds(df, "k", "y", 5).groupBy("y", "fold").agg(F.count("*").alias("n")).collect()
    assert len(folds) == 5 * len(n) and all(abs(r["n"] - n[r["y"]] / 5) < 1 for r in folds)
    assert stratified_split(df.filter("k < 0"), "k", "y").count() == 0
