"""Explicit schemas of the input tables (fixed values)."""

from __future__ import annotations

from pyspark.sql import types as T

_LONG, _INT, _TEXT, _NUM, _TS, _DATE = (
    T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampNTZType(), T.DateType(),
)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# Hour-level site: relative path -> columns read.
HOUR_SITE = {
    "hosp/admissions": _schema(
        subject_id=_LONG, hadm_id=_LONG, admittime=_TS, dischtime=_TS, deathtime=_TS, hospital_expire_flag=_INT, race=_TEXT
    ),
    "hosp/patients": _schema(subject_id=_LONG, gender=_TEXT, anchor_age=_INT, dod=_DATE),
    "hosp/prescriptions": _schema(
        subject_id=_LONG, hadm_id=_LONG, starttime=_TS, stoptime=_TS, drug=_TEXT, route=_TEXT, dose_val_rx=_TEXT, dose_unit_rx=_TEXT
    ),
    "hosp/microbiologyevents": _schema(
        subject_id=_LONG, hadm_id=_LONG, chartdate=_TS, charttime=_TS, storedate=_TS, storetime=_TS,
        org_name=_TEXT, spec_type_desc=_TEXT, test_name=_TEXT,
    ),
    "hosp/diagnoses_icd": _schema(subject_id=_LONG, hadm_id=_LONG, icd_code=_TEXT, icd_version=_INT),
    "hosp/d_icd_diagnoses": _schema(icd_code=_TEXT, icd_version=_INT, long_title=_TEXT),
    "hosp/procedures_icd": _schema(subject_id=_LONG, hadm_id=_LONG, chartdate=_DATE, icd_code=_TEXT, icd_version=_INT),
    "hosp/d_icd_procedures": _schema(icd_code=_TEXT, icd_version=_INT, long_title=_TEXT),
    "hosp/labevents": _schema(subject_id=_LONG, hadm_id=_LONG, itemid=_LONG, charttime=_TS, valuenum=_NUM),
    "hosp/d_labitems": _schema(itemid=_LONG, label=_TEXT, fluid=_TEXT, category=_TEXT),
    "icu/icustays": _schema(
        subject_id=_LONG, hadm_id=_LONG, stay_id=_LONG, first_careunit=_TEXT, last_careunit=_TEXT, intime=_TS, outtime=_TS
    ),
    "icu/chartevents": _schema(subject_id=_LONG, hadm_id=_LONG, stay_id=_LONG, charttime=_TS, itemid=_LONG, valuenum=_NUM),
    "icu/d_items": _schema(itemid=_LONG, label=_TEXT, unitname=_TEXT),
    "icu/inputevents": _schema(
        subject_id=_LONG, hadm_id=_LONG, stay_id=_LONG, starttime=_TS, endtime=_TS, itemid=_LONG, amount=_TEXT, amountuom=_TEXT,
        ordercategoryname=_TEXT, statusdescription=_TEXT,
    ),
    "icu/outputevents": _schema(subject_id=_LONG, hadm_id=_LONG, stay_id=_LONG, charttime=_TS, itemid=_LONG, value=_TEXT),
}

# Date-level site: table -> required columns with their accepted names, first present wins.
DATE_SITE = {
    "encounter": {"patid": ["PATID"], "encounterid": ["ENCOUNTERID", "ENCOUNTER_ID"], "admit_date": ["ADMIT_DATE"], "discharge_date": ["DISCHARGE_DATE"]},
    "prescribing": {
        "patid": ["PATID"], "encounterid": ["ENCOUNTERID", "ENCOUNTER_ID"], "order_date": ["RX_ORDER_DATE"], "order_time": ["RX_ORDER_TIME"],
        "start_date": ["RX_START_DATE", "START_DATE"], "end_date": ["RX_END_DATE", "END_DATE"], "name": ["RAW_RX_MED_NAME"],
        "code": ["RXNORM_CUI"], "route": ["RX_ROUTE"],
    },
    "med_admin": {
        "patid": ["PATID"], "encounterid": ["ENCOUNTERID", "ENCOUNTER_ID"], "start_date": ["MEDADMIN_START_DATE", "START_DATE"],
        "start_time": ["MEDADMIN_START_TIME", "START_TIME"], "stop_date": ["MEDADMIN_STOP_DATE", "STOP_DATE"],
        "stop_time": ["MEDADMIN_STOP_TIME", "STOP_TIME"], "name": ["RAW_MEDADMIN_MED_NAME", "MEDADMIN_MED_NAME", "MEDICATION_NAME"],
        "code": ["MEDADMIN_CODE", "RXNORM_CUI"], "route": ["MEDADMIN_ROUTE", "ROUTE"],
    },
    "demographic": {"patid": ["PATID"], "birth_date": ["BIRTH_DATE"], "sex": ["SEX"], "race": ["RACE"]},
    "diagnosis": {"patid": ["PATID"], "encounterid": ["ENCOUNTERID", "ENCOUNTER_ID"], "dx": ["DX", "DIAGNOSIS_CODE"]},
    "lab": {
        "patid": ["PATID"], "encounterid": ["ENCOUNTERID", "ENCOUNTER_ID"], "code": ["LAB_LOINC"], "value": ["RESULT_NUM"],
        "date": ["SPECIMEN_DATE"], "time": ["SPECIMEN_TIME"],
    },
    "obs": {
        "patid": ["PATID"], "encounterid": ["ENCOUNTERID", "ENCOUNTER_ID"], "code": ["OBSCLIN_CODE"], "value": ["OBSCLIN_RESULT_NUM", "RESULT_NUM"],
        "unit": ["OBSCLIN_RESULT_UNIT", "RESULT_UNIT"], "date": ["OBSCLIN_START_DATE", "OBSCLIN_DATE"], "time": ["OBSCLIN_START_TIME", "OBSCLIN_TIME"],
    },
    "vital": {
        "patid": ["PATID"], "encounterid": ["ENCOUNTERID", "ENCOUNTER_ID"], "systolic": ["SYSTOLIC"], "diastolic": ["DIASTOLIC"],
        "date": ["MEASURE_DATE", "VITAL_DATE"], "time": ["MEASURE_TIME", "VITAL_TIME"],
    },
    "death": {"patid": ["PATID"], "death_date": ["DEATH_DATE"]},
}
OPTIONAL = {"order_time", "start_date", "end_date", "route", "start_time", "stop_date", "stop_time", "time", "unit", "code"}
