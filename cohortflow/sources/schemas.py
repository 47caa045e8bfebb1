"""Declared schemas of the six clinical tables (types are declared, never
inferred: codes stay strings so zero padding survives, all-NULL id columns
keep their integer type)."""

from pyspark.sql import types as T

L, I, D, S, TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()


def _st(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


PATIENTS = _st(("SUBJECT_ID", L, False), ("GENDER", S, False), ("DOB", TS, False),
               ("DOD", TS, True), ("DOD_HOSP", TS, True), ("DOD_SSN", TS, True),
               ("EXPIRE_FLAG", I, False))

ADMISSIONS = _st(("HADM_ID", L, False), ("SUBJECT_ID", L, False),
                 ("ADMITTIME", TS, False), ("DISCHTIME", TS, False), ("DEATHTIME", TS, True),
                 ("ADMISSION_TYPE", S, False), ("ADMISSION_LOCATION", S, False),
                 ("DISCHARGE_LOCATION", S, False), ("INSURANCE", S, False),
                 ("LANGUAGE", S, True), ("RELIGION", S, True), ("MARITAL_STATUS", S, True),
                 ("ETHNICITY", S, True), ("EDREGTIME", TS, True), ("EDOUTTIME", TS, True),
                 ("DIAGNOSIS", S, True), ("HOSPITAL_EXPIRE_FLAG", I, False),
                 ("HAS_CHARTEVENTS_DATA", I, False))

DIAGNOSES_ICD = _st(("SUBJECT_ID", L, False), ("HADM_ID", L, False), ("SEQ_NUM", I, False),
                    ("ICD9_CODE", S, False))

ICUSTAYS = _st(("SUBJECT_ID", L, False), ("HADM_ID", L, False), ("ICUSTAY_ID", L, False),
               ("FIRST_CAREUNIT", S, True), ("LAST_CAREUNIT", S, True),
               ("FIRST_WARDID", I, True), ("LAST_WARDID", I, True),
               ("INTIME", TS, True), ("OUTTIME", TS, True), ("LOS", D, True))

LABEVENTS = _st(("ROW_ID", L, False), ("SUBJECT_ID", L, False), ("HADM_ID", L, False),
                ("ITEMID", I, False), ("CHARTTIME", TS, True), ("VALUE", D, True),
                ("VALUENUM", D, True), ("VALUEUOM", S, True), ("FLAG", S, True))

PRESCRIPTIONS = _st(("ROW_ID", L, False), ("SUBJECT_ID", L, False), ("HADM_ID", L, False),
                    ("ICUSTAY_ID", L, True), ("STARTDATE", TS, True), ("ENDDATE", TS, True),
                    ("DRUG_TYPE", S, True), ("DRUG", S, True), ("DRUG_NAME_POE", S, True),
                    ("DRUG_NAME_GENERIC", S, True), ("FORMULARY_DRUG_CD", S, True),
                    ("GSN", S, True), ("NDC", S, True), ("PROD_STRENGTH", S, True),
                    ("DOSE_VAL_RX", S, True), ("DOSE_UNIT_RX", S, True),
                    ("FORM_VAL_DISP", S, True), ("FORM_UNIT_DISP", S, True), ("ROUTE", S, True))

CLINICAL = {
    "patients": PATIENTS,
    "admissions": ADMISSIONS,
    "diagnoses_icd": DIAGNOSES_ICD,
    "icustays": ICUSTAYS,
    "labevents": LABEVENTS,
    "prescriptions": PRESCRIPTIONS,
}
