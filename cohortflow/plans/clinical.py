"""Clinical binding: the six-table layout (patients, admissions,
diagnoses_icd, icustays, labevents, prescriptions) composed into the
readmission feature table with the generic operators.

Usage::

    tables = read_clinical(spark, "/data/clinical", fmt="csv")
    features = clinical_feature_table(tables)
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import abnormality, cut, cyclical, equals_flag, in_flag, scaled_cap, threshold_flag
from ..functions.fixed import AGE_EDGES, AGE_LABELS, LOS_EDGES, LOS_LABELS
from ..functions.time import elapsed_days, years_between
from ..operators.children import (ItemRule, aggregate_children, attach, coded_spec, drug_spec,
                                  measured_spec, subset_spec)
from ..operators.history import history_features
from ..operators.score import additive_score, risk_tier
from ..session import cut_lineage

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's lists for the same results).
# ICD-9 codes are compared as strings.
HF_CODES = ["39891", "40201", "40211", "40291", "40401", "40403", "40411", "40413",
            "40491", "40493", "4280", "4281", "42820", "42821", "42822", "42823",
            "42830", "42831", "42832", "42833", "42840", "42841", "42842", "42843", "4289"]
COMORBIDITY_GROUPS = {
    "diabetes": ["25000", "25001", "25002"],
    "hypertension": ["4019", "40190", "40191"],
    "kidney_disease": ["5849", "5859"],
    "cardiac_comorbidity": ["42731", "42732", "41401", "41071"],
    "respiratory_disease": ["49390", "49391"],
}
HF_SUBTYPES = {
    "systolic_hf": ["42820", "42821", "42822", "42823"],
    "diastolic_hf": ["42830", "42831", "42832", "42833"],
    "combined_hf": ["42840", "42841", "42842", "42843"],
    "acute_hf": ["4281", "42821", "42831", "42841"],
    "chronic_hf": ["42822", "42832", "42842"],
}
LAB_ITEMS = {50912: "creatinine", 50983: "sodium", 51006: "bun", 51222: "hemoglobin",
             50862: "albumin"}
LAB_RULES = [  # (item, direction, mild, severe)
    (50912, "high", 1.5, 3.0), (50983, "low", 135.0, 130.0), (51006, "high", 20.0, 50.0),
    (51222, "low", 10.0, 8.0), (50862, "low", 3.5, 2.5)]
MEDICATION_CLASSES = {
    "ace_inhibitor": ["Lisinopril", "Enalapril"],
    "beta_blocker": ["Metoprolol", "Carvedilol"],
    "diuretic": ["Furosemide", "Hydrochlorothiazide"],
    "arb": ["Losartan"],
    "aldosterone_antagonist": ["Spironolactone"],
    "digoxin": ["Digoxin"],
    "anticoagulant": ["Warfarin"],
    "potassium": ["Potassium Chloride"],
}
# ---------------------------------------------------------------------------


def lab_rules():
    return [ItemRule(LAB_ITEMS[i], i, d, a, b) for i, d, a, b in LAB_RULES]


def diagnosis_features(diagnoses: DataFrame) -> DataFrame:
    spec = coded_spec("ICD9_CODE", HF_CODES, COMORBIDITY_GROUPS, HF_SUBTYPES,
                      total="total_diagnoses", primary="hf_diagnoses_count",
                      group_count="comorbidity_count", complexity="complexity_score",
                      products={"diabetes_kidney_combo": ("diabetes", "kidney_disease"),
                                "hf_kidney_combo": ("primary", "kidney_disease")})
    return aggregate_children(diagnoses, "HADM_ID", [spec]), spec.fill


def icu_features(icustays: DataFrame) -> DataFrame:
    spec = subset_spec("LOS", prefix="icu")
    return aggregate_children(icustays, "HADM_ID", [spec]), spec.fill


def lab_features(labevents: DataFrame) -> DataFrame:
    spec = measured_spec("ITEMID", "VALUENUM", ["CHARTTIME", "ROW_ID"], lab_rules(),
                         total="total_labs", ratio=("bun_creat_ratio", "bun", "creatinine", 0.1))
    return aggregate_children(labevents, "HADM_ID", [spec]), spec.fill


def medication_features(prescriptions: DataFrame) -> DataFrame:
    spec = drug_spec("DRUG", MEDICATION_CLASSES,
                     guideline=(["ace_inhibitor", "arb"], "beta_blocker", "diuretic"),
                     total="total_medications", unique="unique_medications",
                     class_count="hf_medication_count")
    return aggregate_children(prescriptions, "HADM_ID", [spec]), spec.fill


def clinical_feature_table(tables: Mapping[str, DataFrame], horizon_days: int = 30,
                           bucket_days: float | None = None,
                           rows_per_bucket: int | None = 50_000) -> DataFrame:
    """Label (drop each patient's last admission), demographics, diagnosis,
    ICU, lab, medication and history features, rule score and tier: one row
    per non-last admission."""
    adm = tables["admissions"]
    pts = tables["patients"].select("SUBJECT_ID", "GENDER", "DOB")
    ev = adm.select("HADM_ID", "SUBJECT_ID", "ADMITTIME", "DISCHTIME", "ADMISSION_TYPE", "INSURANCE")
    fills = {}
    for fn, name in ((diagnosis_features, "diagnoses_icd"), (icu_features, "icustays"),
                     (lab_features, "labevents"), (medication_features, "prescriptions")):
        feats, fill = fn(tables[name])
        fills.update(fill)
        ev = attach(ev, feats, "HADM_ID")
    ev = ev.fillna(fills)
    ev = ev.withColumn("emergency_admission", equals_flag("ADMISSION_TYPE", "EMERGENCY"))
    ev = ev.withColumn("_dx_rows", F.coalesce(F.col("total_diagnoses"), F.lit(0)))
    # every child table is aggregated once; the history scan reads six narrow columns
    ev = cut_lineage(ev, "clinical-events")
    sums = {"prior_icu_stays": "has_icu", "prior_emergency_admissions": "emergency_admission",
            "total_prior_diagnoses": "_dx_rows"}
    narrow = ev.select("SUBJECT_ID", "HADM_ID", "ADMITTIME", "DISCHTIME", *sums.values())
    h = history_features(narrow, "SUBJECT_ID", "HADM_ID", "ADMITTIME", "DISCHTIME", prior_sums=sums,
                         label_horizon=horizon_days, keep_last=False, bucket_days=bucket_days,
                         rows_per_bucket=rows_per_bucket)
    h = ev.join(h.select("HADM_ID", *[c for c in h.columns if c not in narrow.columns]), "HADM_ID")
    h = h.join(pts, "SUBJECT_ID", "left")
    age = years_between("DOB", "ADMITTIME")
    los = elapsed_days("ADMITTIME", "DISCHTIME")
    msin, mcos = cyclical(F.month("ADMITTIME"), 12)
    wsin, wcos = cyclical(F.weekday("ADMITTIME"), 7)
    out = h.select(
        "*", age.alias("age_at_admission"), cut(age, AGE_EDGES, AGE_LABELS).alias("age_group"),
        equals_flag("GENDER", "M").alias("gender_male"), los.alias("los_days"),
        cut(los, LOS_EDGES, LOS_LABELS).alias("los_category"),
        equals_flag("INSURANCE", "Medicare").alias("medicare"),
        equals_flag("INSURANCE", "Private").alias("private_insurance"),
        (age * age).alias("age_squared"), threshold_flag(age, ">=", 85).alias("age_very_old"),
        threshold_flag(age, "<", 65).alias("age_young_hf"), F.log1p(los).alias("los_log"),
        threshold_flag(los, "<=", 2).alias("los_very_short"),
        threshold_flag(los, ">=", 14).alias("los_very_long"),
        F.month("ADMITTIME").alias("admit_month"), F.weekday("ADMITTIME").alias("admit_weekday"),
        threshold_flag(F.weekday("ADMITTIME"), ">=", 5).alias("admit_weekend"),
        in_flag(F.month("ADMITTIME"), [12, 1, 2]).alias("winter_admission"),
        msin.alias("month_sin"), mcos.alias("month_cos"),
        wsin.alias("weekday_sin"), wcos.alias("weekday_cos"), (age * los).alias("age_los_interaction"))
    score = additive_score({"age_at_admission": [(75, 2), (65, 1)], "los_days": [(7, 2), (3, 1)],
                            "prior_count": [(2, 3), (0, 1)]},
                           counts=["comorbidity_count"], flags={"emergency_admission": 1})
    out = out.withColumn("risk_score", score).withColumn("risk_category", risk_tier("risk_score"))
    return out.drop("_dx_rows", "GENDER", "DOB")


# The column sets that models are trained on.
_COMORBIDITIES = ["has_diabetes", "has_hypertension", "has_kidney_disease", "has_cardiac_comorbidity", "has_respiratory_disease"]
_LAST = ["creatinine_last", "sodium_last", "bun_last", "hemoglobin_last", "albumin_last"]
_THERAPY = ["has_ace_inhibitor", "has_beta_blocker", "has_diuretic", "has_arb"]
FEATURE_SETS = {
    "simple": ["age_at_admission", "gender_male", "los_days", "emergency_admission", "medicare",
               "age_squared", "los_log", "age_los_interaction"],
    "base": ["age_at_admission", "gender_male", "los_days", "emergency_admission", "medicare", "private_insurance",
             "total_diagnoses", "hf_diagnoses_count", "comorbidity_count", *_COMORBIDITIES,
             "has_systolic_hf", "has_diastolic_hf", "has_combined_hf", "has_icu", "icu_sum", "icu_count",
             "total_labs", *_LAST, "creatinine_elevated", "sodium_low", "bun_elevated", "hemoglobin_low", "albumin_low",
             "total_medications", "hf_medication_count", "guideline_score", *_THERAPY, "optimal_therapy",
             "prior_count", "days_since_last", "prior_icu_stays", "prior_emergency_admissions", "avg_prior_los",
             "had_prior_readmission"],
    "expanded": ["age_at_admission", "age_squared", "age_very_old", "age_young_hf", "gender_male", "los_days", "los_log",
                 "los_very_short", "los_very_long", "emergency_admission", "medicare", "admit_weekend", "winter_admission",
                 "total_diagnoses", "hf_diagnoses_count", "comorbidity_count", "complexity_score", *_COMORBIDITIES,
                 "has_systolic_hf", "has_diastolic_hf", "has_combined_hf", "has_acute_hf", "has_chronic_hf",
                 "diabetes_kidney_combo", "hf_kidney_combo", "has_icu", "icu_sum", "icu_sum_log", "icu_max",
                 "total_labs", *_LAST, "bun_creat_ratio", "creatinine_elevated", "creatinine_severe", "sodium_low",
                 "sodium_very_low", "bun_elevated", "bun_severe", "hemoglobin_low", "hemoglobin_very_low", "albumin_low",
                 "albumin_very_low", "total_medications", "hf_medication_count", "guideline_score", *_THERAPY,
                 "optimal_therapy", "suboptimal_therapy", "polypharmacy", "prior_count", "days_since_last",
                 "had_prior_readmission", "frequent_flag", "rate_per_year"],
    "network": ["age_norm", "gender_male", "los_log", "emergency_admission", "medicare", "month_sin", "month_cos",
                "weekday_sin", "weekday_cos", "admit_weekend", "total_diagnoses_norm", "hf_diagnoses_norm",
                "comorbidity_norm", "complexity_norm", *_COMORBIDITIES, "has_icu", "icu_los_norm", "has_creatinine",
                "has_sodium", "has_bun", "has_hemoglobin", "has_albumin", "creatinine_abnormal", "sodium_abnormal",
                "bun_abnormal", "hemoglobin_abnormal", "albumin_abnormal", "total_meds_norm", "gdmt_norm", *_THERAPY,
                "prior_norm", "days_since_norm", "had_prior_readmission"],
}
# Fixed values: (output, input, divisor, cap) and (output, input, reference, scale, direction, cap).
NETWORK_NORMS = [("age_norm", "age_at_admission", 100.0, None), ("total_diagnoses_norm", "total_diagnoses", 10.0, 1.0),
                 ("hf_diagnoses_norm", "hf_diagnoses_count", 5.0, 1.0), ("comorbidity_norm", "comorbidity_count", 5.0, None),
                 ("complexity_norm", "complexity_score", 20.0, 1.0), ("icu_los_norm", "icu_sum", 10.0, 1.0),
                 ("total_meds_norm", "total_medications", 15.0, 1.0), ("gdmt_norm", "guideline_score", 3.0, None),
                 ("prior_norm", "prior_count", 5.0, 1.0)]
NETWORK_ABNORMAL = [("creatinine_abnormal", "creatinine_last", 1.0, 2.0, "above", 1.0),
                    ("sodium_abnormal", "sodium_last", 135.0, 10.0, "below", None),
                    ("bun_abnormal", "bun_last", 20.0, 30.0, "above", 1.0),
                    ("hemoglobin_abnormal", "hemoglobin_last", 10.0, 5.0, "below", None),
                    ("albumin_abnormal", "albumin_last", 3.5, 2.0, "below", None)]


def network_inputs(features: DataFrame) -> DataFrame:
    """The clinical feature table with the scaled and capped columns of the ``network`` set; a missing
    measurement is not abnormal, and no history counts as a year."""
    days = F.least(F.coalesce(F.col("days_since_last"), F.lit(365.0)) / 365.0, F.lit(1.0))
    return features.select(
        "*", days.alias("days_since_norm"), *[scaled_cap(c, div, cap).alias(out) for out, c, div, cap in NETWORK_NORMS],
        *[F.coalesce(abnormality(c, ref, sc, d, cap), F.lit(0.0)).alias(out) for out, c, ref, sc, d, cap in NETWORK_ABNORMAL])


def feature_set(features: DataFrame, name: str, key: str = "HADM_ID", label: str = "label") -> DataFrame:
    """``(key, label, columns of the set)`` of a clinical feature table."""
    wide = network_inputs(features) if name == "network" else features
    return wide.select(key, label, *FEATURE_SETS[name])
