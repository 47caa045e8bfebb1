import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from cohortflow.operators.history import history_features
from cohortflow.operators.label import readmission_label
from cohortflow.operators.prep import class_weights, hash_folds, hash_split
from cohortflow.plans.bindings import orders_events
from cohortflow.plans.clinical import clinical_feature_table
from cohortflow.sources.schemas import CLINICAL

from .conftest import SF
from .fixtures import EVENT_ROWS


def _clinical_tables(spark):
    pts = [(1, "M", dt.datetime(1940, 1, 1), None, None, None, 0),
           (2, "F", dt.datetime(1950, 6, 1), None, None, None, 0)]
    adm = []
    for ent, i, s, e in EVENT_ROWS:
        adm.append((i, ent, s, e, None, "EMERGENCY" if i % 2 else "ELECTIVE", "x", "y", "Medicare",
                    None, None, None, None, None, None, None, 0, 1))
    dx = [(1, 1, 1, "42821"), (1, 1, 2, "25000"), (1, 3, 1, "5849")]
    icu = [(1, 1, 100, "CCU", "CCU", 1, 1, None, None, 2.5)]
    labs = [(1, 1, 1, 50912, dt.datetime(2010, 1, 2), 1.2, 1.2, "mg/dL", None)]
    rx = [(1, 1, 1, None, None, None, "MAIN", "Lisinopril", None, None, None, None, None, None,
           None, None, None, None, None)]
    data = {"patients": pts, "admissions": adm, "diagnoses_icd": dx, "icustays": icu,
            "labevents": labs, "prescriptions": rx}
    return {k: spark.createDataFrame(v, CLINICAL[k]) for k, v in data.items()}


def test_clinical_feature_table(spark):
    out = clinical_feature_table(_clinical_tables(spark)).orderBy("HADM_ID").collect()
    assert [r["HADM_ID"] for r in out] == [1, 2, 3, 4]  # last admissions dropped
    r1 = out[0]
    assert r1["label"] == 1 and r1["total_diagnoses"] == 2 and r1["hf_diagnoses_count"] == 1
    assert r1["has_icu"] == 1 and r1["icu_sum"] == 2.5 and r1["creatinine_last"] == 1.2
    assert r1["has_ace_inhibitor"] == 1 and r1["gender_male"] == 1
    r4 = out[3]
    assert r4["prior_count"] == 3 and r4["prior_icu_stays"] == 1 and r4["total_prior_diagnoses"] == 3
    assert r4["had_prior_readmission"] == 1 and r4["frequent_flag"] == 1


def test_label_rows_equal_events_minus_entities(spark):
    ev = orders_events(spark, SF)
    n_ev, n_ent = ev.count(), ev.select("o_custkey").distinct().count()
    lb = readmission_label(ev, "o_custkey", "o_orderkey", "o_orderdate", "o_enddate")
    assert lb.count() == n_ev - n_ent


def test_history_equals_theta_self_join(spark):
    ev = orders_events(spark, SF)
    h = history_features(ev, "o_custkey", "o_orderkey", "o_orderdate", "o_enddate", bucket_days=3)
    a, b = ev.alias("a"), ev.alias("b")
    theta = (a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey"))
                    & (F.col("b.o_orderdate") < F.col("a.o_orderdate")), "left")
              .groupBy(F.col("a.o_orderkey").alias("o_orderkey"))
              .agg(F.count(F.col("b.o_orderkey")).alias("n")))
    diff = h.join(theta, "o_orderkey").filter(F.col("prior_count") != F.col("n")).count()
    assert diff == 0


def test_history_invariant_to_bucket_width(spark):
    ev = orders_events(spark, SF)
    cols = ["o_orderkey", "prior_count", "days_since_last", "had_prior_readmission", "rate_per_year"]
    a = history_features(ev, "o_custkey", "o_orderkey", "o_orderdate", "o_enddate", bucket_days=1).select(cols)
    b = history_features(ev, "o_custkey", "o_orderkey", "o_orderdate", "o_enddate", bucket_days=1e6).select(cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_history_unchanged_under_dst_session_zone(spark):
    ev = orders_events(spark, SF)
    base = history_features(ev, "o_custkey", "o_orderkey", "o_orderdate", "o_enddate").select(
        "o_orderkey", "days_since_last", "rate_per_year").collect()
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        other = history_features(ev, "o_custkey", "o_orderkey", "o_orderdate", "o_enddate").select(
            "o_orderkey", "days_since_last", "rate_per_year").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert sorted(base) == sorted(other)


def test_class_weights_sum_to_n(spark):
    lab = spark.read.parquet(os.path.join(SF, "labels.parquet"))
    w = class_weights(lab, "quality").collect()
    assert sum(r["n"] * r["weight"] for r in w) == pytest.approx(lab.count())


def test_split_and_folds(spark):
    o = spark.read.parquet(os.path.join(SF, "orders.parquet"))
    s = hash_split(o, "o_orderkey", 0.2).groupBy("split").count().collect()
    frac = {r["split"]: r["count"] for r in s}
    assert abs(frac["test"] / o.count() - 0.2) < 0.05
    f = hash_folds(o, "o_orderkey", 5)
    assert f.select("fold").distinct().count() == 5
    assert f.count() == o.count() and f.filter(F.col("fold").isNull()).count() == 0


def test_split_fraction_per_stratum(spark):
    lab = readmission_label(orders_events(spark, SF), "o_custkey", "o_orderkey", "o_orderdate", "o_enddate")
    s = hash_split(lab, "o_orderkey", 0.2).groupBy("label").agg(
        F.avg((F.col("split") == "test").cast("double")).alias("frac")).collect()
    for r in s:
        assert abs(r["frac"] - 0.2) < 0.08, r


def test_feature_sets_of_the_clinical_table(spark):
    from cohortflow.plans.clinical import FEATURE_SETS, clinical_feature_table, feature_set
    features = clinical_feature_table(_clinical_tables(spark))
    assert {k: len(set(v)) for k, v in FEATURE_SETS.items()} == {"simple": 8, "base": 45, "expanded": 65, "network": 40}
    n = features.count()
    for name, cols in FEATURE_SETS.items():
        got = feature_set(features, name)
        assert got.columns == ["HADM_ID", "label", *cols] and got.count() == n
    r = feature_set(features, "network").orderBy("HADM_ID").first()
    assert 0 <= r["days_since_norm"] <= 1 and 0 <= r["total_diagnoses_norm"] <= 1 and r["sodium_abnormal"] >= 0
