import datetime as dt

import pytest

from cohortflow.plans.clinical import (diagnosis_features, lab_features, medication_features)


def test_lab_fixture(spark):
    # creatinine 1.2 then 1.8; sodium 135.0 once; no BUN
    rows = [(1, 10, 50912, dt.datetime(2010, 1, 1, 8), 1.2), (2, 10, 50912, dt.datetime(2010, 1, 2, 8), 1.8),
            (3, 10, 50983, dt.datetime(2010, 1, 1, 9), 135.0)]
    df = spark.createDataFrame(rows, "ROW_ID long, HADM_ID long, ITEMID int, CHARTTIME timestamp_ntz, VALUENUM double")
    feats, fill = lab_features(df)
    r = feats.collect()[0]
    assert r["creatinine_first"] == 1.2 and r["creatinine_last"] == 1.8
    assert r["creatinine_mean"] == pytest.approx(1.5)
    assert r["creatinine_std"] == pytest.approx(0.424264, abs=1e-6)
    assert r["creatinine_trend"] == pytest.approx(0.6)
    assert r["creatinine_elevated"] == 1 and r["creatinine_severe"] == 0
    assert r["sodium_low"] == 0 and r["sodium_std"] == 0.0
    assert r["bun_last"] is None and r["has_bun"] == 0 and r["bun_elevated"] == 0
    assert r["bun_creat_ratio"] is None
    assert r["total_labs"] == 3


def test_drug_fixture(spark):
    drugs = ["Lisinopril", "Losartan", "Metoprolol", "Furosemide", "Furosemide"]
    df = spark.createDataFrame([(7, d) for d in drugs], "HADM_ID long, DRUG string")
    r = medication_features(df)[0].collect()[0]
    assert r["total_medications"] == 5 and r["unique_medications"] == 4
    assert r["hf_medication_count"] == 4 and r["guideline_score"] == 3
    assert r["optimal_therapy"] == 1 and r["suboptimal_therapy"] == 0 and r["polypharmacy"] == 0


def test_code_fixture(spark):
    codes = ["42821", "25000", "25002", "5849"]
    df = spark.createDataFrame([(3, c) for c in codes], "HADM_ID long, ICD9_CODE string")
    r = diagnosis_features(df)[0].collect()[0]
    assert r["total_diagnoses"] == 4 and r["hf_diagnoses_count"] == 1
    assert r["has_diabetes"] == 1 and r["has_kidney_disease"] == 1
    assert r["comorbidity_count"] == 2
    assert r["has_systolic_hf"] == 1 and r["has_acute_hf"] == 1 and r["has_chronic_hf"] == 0
    assert r["complexity_score"] == 7
    assert r["diabetes_kidney_combo"] == 1 and r["hf_kidney_combo"] == 1


def test_missing_child_rows_are_filled(spark):
    from cohortflow.operators.children import attach
    ev = spark.createDataFrame([(1,), (2,)], "HADM_ID long")
    df = spark.createDataFrame([(1, "Lisinopril")], "HADM_ID long, DRUG string")
    feats, fill = medication_features(df)
    out = {r["HADM_ID"]: r for r in attach(ev, feats, "HADM_ID", fill=fill).collect()}
    assert out[2]["total_medications"] == 0 and out[2]["suboptimal_therapy"] == 1
    assert out[2]["guideline_score"] == 0
