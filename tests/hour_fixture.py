"""Small random tables in the hour-level layout, as plain rows."""

import random
from datetime import datetime, timedelta

from tideline.sources.schemas import HOUR_SITE

T0 = datetime(2150, 1, 1)
LAB_ITEMS = {1: "Lactate", 2: "Creatinine", 3: "White Blood Cells", 4: "Platelet Count", 5: "Bilirubin, Total", 6: "Sodium"}
ITEMS = {
    20: "Heart Rate", 21: "Respiratory Rate", 22: "O2 saturation pulseoxymetry", 23: "Arterial Blood Pressure mean", 24: "Temperature Fahrenheit",
    25: "Temperature Celsius", 26: "Inspired O2 Fraction", 27: "GCS - Eye Opening", 28: "GCS - Verbal Response", 29: "GCS - Motor Response",
    30: "Daily Weight", 31: "Height", 32: "Norepinephrine", 33: "Foley", 34: "Propofol", 35: "GCS Total", 36: "FiO2 set",
}
DRUGS = [
    ("Vancomycin", "IV"), ("Cefepime", "IV"), ("Meropenem", "IV"), ("Ceftriaxone", "IV"), ("Vancomycin", "PO"), ("Metronidazole", "PO"),
    ("Hydrocortisone", "IV"), ("PredniSONE", "PO"), ("Aspirin", "PO"), ("Cefepime  ", "IV"),
]


def make(n=160, seed=4):
    rng = random.Random(seed)
    t = {k.split("/")[1]: [] for k in HOUR_SITE}
    t["d_labitems"] = [(i, n_, "Blood", "Chemistry") for i, n_ in LAB_ITEMS.items()]
    t["d_items"] = [(i, n_, None) for i, n_ in ITEMS.items()]
    t["d_icd_diagnoses"] = [("I50", 10, "Heart failure, unspecified"), ("N18", 10, "Chronic kidney disease"), ("J10", 10, "Influenza")]
    t["d_icd_procedures"] = [("5A1", 10, "Respiratory ventilation, 24-96 hours"), ("0X", 10, "Biopsy")]
    h = lambda base, x: base + timedelta(hours=x)
    for i in range(n):
        sub, hadm, stay = 1000 + i // 2, 5000 + i, 9000 + i
        admit = T0 + timedelta(days=10 * i)
        unit = h(admit, rng.randrange(0, 12))
        stayed = rng.choice([60, 130, 150, 240, 500, 900])
        dies = rng.random() < 0.3
        dead = h(unit, rng.choice([90, 130, 200, 400, 900])) if dies else None
        t["admissions"].append((sub, hadm, admit, h(unit, stayed), dead, int(dies), rng.choice(["WHITE", "BLACK", None])))
        if i % 2 == 0:
            t["patients"].append((sub, rng.choice("MF"), rng.choice([17, 40, 65, 80]), None))
        t["icustays"].append((sub, hadm, stay, rng.choice(["Medical Intensive Care Unit", "Neuro Surgical"]), "x", unit, h(unit, rng.choice([100, 110, 300]))))
        for _ in range(rng.randrange(1, 7)):
            drug, route = rng.choice(DRUGS)
            s = h(unit, rng.choice([-7, -6, 0, 3, 24, 30, 47, 71, 80, 120, 300]))
            e = rng.choice([None, h(s, 24), h(s, 72), h(s, 120), h(s, -1), h(s, 200)])
            t["prescriptions"].append((sub, hadm, s, e, drug, route, "1", "g"))
        # Most entities get an early broad course so that the cohort is not empty.
        if rng.random() < 0.9:
            s = h(unit, rng.choice([0, 2, 20]))
            t["prescriptions"].append((sub, hadm, s, h(s, rng.choice([60, 72, 73, 90, 96, 120])), "Piperacillin-Tazobactam", "IV", "1", "g"))
        for _ in range(rng.randrange(1, 4)):
            s = h(unit, rng.choice([-30, -5, 2, 20, 70, 100]))
            spec, test = rng.choice([("BLOOD CULTURE", "Blood Culture, Routine"), ("URINE", "URINE CULTURE"), ("Swab", "MRSA SCREEN"), ("SPUTUM", "GRAM STAIN")])
            t["microbiologyevents"].append((sub, hadm, None, s, None, rng.choice([None, h(s, 20), h(s, 90)]), rng.choice([None, None, None, "E COLI"]), spec, test))
        for _ in range(3):
            t["diagnoses_icd"].append((sub, hadm, rng.choice(["I50", "N18", "J10"]), 10))
        if rng.random() < 0.4:
            t["procedures_icd"].append((sub, hadm, None, rng.choice(["5A1", "0X"]), 10))
        for _ in range(25):
            t["labevents"].append((sub, hadm, rng.choice(list(LAB_ITEMS)), h(unit, rng.randrange(-5, 110)), rng.choice([None, 0.05, 0.9, 1.7, 4.0, 20.0, 130.0, 300.0])))
        for _ in range(60):
            t["chartevents"].append((sub, hadm, stay, h(unit, rng.randrange(-2, 110)), rng.choice(list(ITEMS)), rng.choice([0.4, 3.0, 36.5, 39.0, 50.0, 69.0, 99.0, 101.0, 180.0, 400.0])))
        for hour in (5, 55, 70):
            at = h(unit, hour)
            for item, hi in ((27, 4), (28, 5), (29, 6)):
                if rng.random() < 0.9:
                    t["chartevents"].append((sub, hadm, stay, at, item, float(rng.randrange(1, hi + 1))))
        if rng.random() < 0.5:
            s = h(unit, rng.choice([1, 10, 40, 60, 70, 75]))
            t["inputevents"].append((sub, hadm, stay, s, rng.choice([None, h(s, 5), h(s, 30)]), rng.choice([32, 34]), "1", "mg", "x", "y"))
        for _ in range(10):
            t["outputevents"].append((sub, hadm, stay, h(unit, rng.randrange(0, 100)), rng.choice([33, 34]), rng.choice(["100", "250.5", "-1", "abc", "20000"])))
    return t


def frames(spark, rows):
    return {k.split("/")[1]: spark.createDataFrame(rows[k.split("/")[1]], s) for k, s in HOUR_SITE.items()}
