"""Steps that decide how the heavy queries grow: each test fails if the step goes back to its former cost."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortflow.functions.arrow import packed, unpacked
from cohortflow.operators import neighbours as NB
from cohortflow.operators.children import ItemRule, aggregate_children, measured_spec
from cohortflow.plans import q_models


def test_a_block_is_searched_by_leaves(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((3000, 2)), rng.integers(0, 3, (600, 2))])
    keys = rng.permutation(len(x))
    block, looked = NB.Block(pa.array(keys), x, 6), []
    plain = block.distances
    monkeypatch.setattr(block, "distances", lambda q, leaf: looked.append(len(q) * block.place.shape[1]) or plain(q, leaf))
    limit = np.where(np.arange(len(x)) % 3, np.inf, 0.01)
    who, at, dist = block.nearest(x, limit, 6)
    d = NB.squared(x, x)
    for i in range(len(x)):
        want = [j for j in np.lexsort((keys, d[i]))[:6] if d[i, j] <= limit[i]]
        assert at[who == i].tolist() == want and dist[who == i].tolist() == d[i, want].tolist()
    assert sum(looked) < len(x) ** 2 / 5


def test_first_and_last_leave_the_hash_aggregate_alone(spark):
    rows = [(1, "a", 1, 5.0), (1, "a", 3, None), (1, "a", 2, 7.0), (1, None, 9, 1.0), (2, "a", None, 4.0), (2, "a", 1, 6.0),
            (2, "b", 1, 8.0), (3, "c", 1, 1.0), (None, "a", 1, 2.0), (None, "a", 2, 3.0)]
    df = spark.createDataFrame(rows, "k int, item string, t int, v double").repartition(3)
    spec = measured_spec("item", "v", ["t"], [ItemRule("a", "a", "high", 1.0, 6.0), ItemRule("b", "b", "low", 1.0, 2.0)])
    out = aggregate_children(df, "k", [spec])
    got = {r.k: (r.total, r.a_first, r.a_last, r.b_first, r.has_a, r.has_b) for r in out.withColumnRenamed("total_measurements", "total").collect()}
    assert got == {1: (4, 5.0, None, None, 1, 0), 2: (3, 4.0, 6.0, 8.0, 1, 1), 3: (1, None, None, None, 0, 0), None: (2, 2.0, 3.0, None, 1, 0)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan and plan.count("Exchange hashpartitioning") + plan.count("Exchange REPARTITION") <= 1


def test_medians_are_looked_for_in_columns_with_gaps_only(spark, monkeypatch):
    asked = []
    plain = q_models.fit_fill_values
    monkeypatch.setattr(q_models, "fit_fill_values", lambda df, policy, *a: asked.append(set(policy)) or plain(df, policy, *a))
    rows = [(i, i % 2, float(i), None if i == 3 else float(i), i, float("nan") if i == 9 else 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "o_orderkey long, label int, full double, train_gap double, whole int, test_gap double")
    cols = ["full", "train_gap", "whole", "test_gap"]
    train, test = q_models.matrices(df.filter("o_orderkey < 8"), df.filter("o_orderkey >= 8"), cols, {c: "median" for c in cols})
    assert asked == [{"train_gap", "test_gap"}]
    got = {r.o_orderkey: r.features.toArray() for r in train.unionByName(test).collect()}
    x = np.array([[i, 4.0 if i == 3 else i, i, 1.0] for i in range(10)], float)
    sd = x[:8].std(axis=0)
    want = (x - x[:8].mean(axis=0)) / np.where(sd > 0, sd, 1)
    assert all(np.allclose(got[i], want[i]) for i in range(10))


def test_packed_rows_come_back(spark):
    x = np.arange(12.0).reshape(6, 2)
    assert (unpacked(packed(x).slice(2, 3), np.float64, 2) == x[2:5]).all()
    codes = np.arange(9, dtype=np.uint8).reshape(3, 3)
    assert (unpacked(packed(codes), np.uint8, 3) == codes).all() and unpacked(packed(codes).slice(3), np.uint8, 3).shape == (0, 3)
