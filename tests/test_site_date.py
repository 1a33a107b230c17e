"""The date-level and mapped studies against plain-Python readings."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import numpy as np
import pytest

from tideline.plans import site_date as sd
from tideline.plans import site_mapped as sm

D0 = date(2020, 1, 1)
DAY = timedelta(days=1)
H = lambda x: timedelta(hours=x)


def make(n=260, seed=9):
    rng = random.Random(seed)
    t = defaultdict(list)
    for i in range(n):
        p, e, adm = f"p{i // 2}", f"e{i}", D0 + timedelta(days=3 * i)
        t["encounter"] += [(p, e, str(adm), rng.choice([None, str(adm + timedelta(days=rng.choice([3, 4, 5, 9, 30])))]))] * rng.choice([1, 2])
        if i % 2 == 0:
            t["demographic"].append((p, str(date(1950, 1, 1) + timedelta(days=rng.randrange(9000))), rng.choice(["M", "F"]), rng.choice(["05", "03"])))
            if rng.random() < 0.4:
                t["death"].append((p, str(adm + timedelta(days=rng.choice([2, 4, 5, 20, 60])))))
        for _ in range(rng.randrange(1, 6)):
            od = adm + timedelta(days=rng.choice([0, 0, 1, 3, 4, 12, 14]))
            tm = rng.choice([None, "10:30", "23:59:59", "36000"])
            start = rng.choice([None, od])
            end = rng.choice([None, od + timedelta(days=rng.choice([0, 2, 3, 6, 20]))])
            name, code, route = rng.choice([("Vancomycin inj", "1", "IV"), ("Cefepime", "2", "UN"), ("Vancomycin tablet", "1", ""), ("Ceftriaxone", "7", "IV"), ("mystery", "5", ""), ("cefepime", "9", "IV"), ("Cefepime", "2", "oral")])
            t["prescribing"].append((p, e, str(od), tm, str(start) if start else None, str(end) if end else None, name, code, route))
        for _ in range(2):
            s = adm + timedelta(days=rng.choice([0, 1, 3, 4]))
            t["med_admin"].append((p, e, str(s), rng.choice([None, str(s + DAY)]), rng.choice(["Norepinephrine", "racepinephrine neb", "Cefepime"]), "2", "IV"))
        t["diagnosis"] += [(p, e, rng.choice(["I50.9", "i50.9", "N18.3", "250.00", "Z00"]))]
        for _ in range(12):
            d = adm + timedelta(days=rng.randrange(0, 4))
            t["lab"].append((p, e, rng.choice(["2524-7", "2160-0", "777-3", "1975-2", "x"]), rng.choice(["1.5", "bad", "12", "300", "0.01"]), str(d), rng.choice([str(rng.randrange(0, 86400)), "08:15", None])))
            t["obs"].append((p, e, rng.choice(["8867-4", "59408-5", "8310-5"]), str(rng.choice([37.5, 99.0, 101.0])), rng.choice(["F", "C", None]), str(d), str(rng.randrange(0, 86400))))
        t["vital"].append((p, e, "120", rng.choice(["60", "400"]), str(adm), "40000"))
    return t


COLS = {
    "encounter": "PATID string, ENCOUNTERID string, ADMIT_DATE string, DISCHARGE_DATE string",
    "demographic": "PATID string, BIRTH_DATE string, SEX string, RACE string",
    "death": "PATID string, DEATH_DATE string",
    "prescribing": "PATID string, ENCOUNTERID string, RX_ORDER_DATE string, RX_ORDER_TIME string, RX_START_DATE string, RX_END_DATE string, RAW_RX_MED_NAME string, RXNORM_CUI string, RX_ROUTE string",
    "med_admin": "PATID string, ENCOUNTERID string, MEDADMIN_START_DATE string, MEDADMIN_STOP_DATE string, RAW_MEDADMIN_MED_NAME string, MEDADMIN_CODE string, MEDADMIN_ROUTE string",
    "diagnosis": "PATID string, ENCOUNTERID string, DX string",
    "lab": "PATID string, ENCOUNTERID string, LAB_LOINC string, RESULT_NUM string, SPECIMEN_DATE string, SPECIMEN_TIME string",
    "obs": "PATID string, ENCOUNTERID string, OBSCLIN_CODE string, OBSCLIN_RESULT_NUM string, OBSCLIN_RESULT_UNIT string, OBSCLIN_START_DATE string, OBSCLIN_START_TIME string",
    "vital": "PATID string, ENCOUNTERID string, SYSTOLIC string, DIASTOLIC string, MEASURE_DATE string, MEASURE_TIME string",
}


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def raw(spark, rows):
    return {k: spark.createDataFrame(rows[k], s) for k, s in COLS.items()}


def clock(d, t, numeric_first=False):
    if t is None:
        return None
    if ":" in t:
        parts = [int(x) for x in t.split(":")]
        return datetime.combine(date.fromisoformat(d), datetime.min.time()) + timedelta(hours=parts[0], minutes=parts[1], seconds=parts[2] if len(parts) > 2 else 0)
    return datetime.combine(date.fromisoformat(d), datetime.min.time()) + timedelta(seconds=int(t))


def phenotype(name, code, route):
    n = name.lower()
    bad = "tablet" in n or route.upper().strip() == "ORAL"
    return (code in ("1", "5") or "vancomycin" in n or "cefepime" in n) and code != "9" and not bad, "ceftriaxone" in n and not bad


def brute(rows, strict=True):
    rx, labs, vaso = defaultdict(list), defaultdict(list), defaultdict(list)
    for p, e, od, tm, s, en, n, c, r in rows["prescribing"]:
        start = date.fromisoformat(s or od)
        rx[e].append((clock(od, tm), start, date.fromisoformat(en) if en else start, *phenotype(n, c, r)))
    for p, e, code, v, d, tm in rows["lab"]:
        try:
            labs[e].append((code, float(v), clock(d, tm, True)))
        except ValueError:
            pass
    for p, e, s, en, n, c, r in rows["med_admin"]:
        if n == "Norepinephrine":
            a = datetime.combine(date.fromisoformat(s), datetime.min.time())
            vaso[e].append((a, datetime.combine(date.fromisoformat(en), datetime.min.time()) + timedelta(seconds=86399) if en else a + H(1)))
    deaths = {p: date.fromisoformat(d) for p, d in rows["death"]}
    out = {}
    for p, e, adm, dis in set(rows["encounter"]):
        a0 = datetime.combine(date.fromisoformat(adm), datetime.min.time())
        starts = [t for t, *_, b, o in rx[e] if b and t is not None and a0 <= t < a0 + H(24)]
        if not starts:
            continue
        anchor = min(starts)
        mark, dec = (anchor + H(96)).date(), (anchor + H(72)).date()
        ok = lambda d: d is None or (d > mark if strict else d >= mark)
        disd, dead = date.fromisoformat(dis) if dis else None, deaths.get(p)
        if not (ok(disd) and ok(dead)):
            continue
        f = {"A": int(not any(b and s <= mark and en >= dec for _, s, en, b, o in rx[e]))}
        days = {d for d in range(30) for _, s, en, b, o in rx[e] if (b or o) and s <= mark + d * DAY <= en}
        f["days"] = len(days)
        f["run"] = int(any({s, s + 1, s + 2} <= days for s in range(7, 28)))
        f["death"] = int(dead is not None and mark <= dead <= mark + 30 * DAY)
        stay = min(30.0, max(0.0, (disd - mark).days)) if disd else 0.0
        f["hfd"] = 0.0 if f["death"] else 30.0 - stay
        plate = [v for c, v, t in labs[e] if c == "777-3" and 1 <= v <= 2000 and t is not None and anchor <= t < anchor + H(24)]
        f["plate"] = min(plate) if plate else None
        lact = [(t, v) for c, v, t in labs[e] if c == "2524-7" and 0.1 <= v <= 30 and t is not None and anchor + H(48) <= t < anchor + H(72)]
        f["lact"] = max(lact)[1] if lact else None
        f["vaso"] = int(any(s < anchor + H(24) and en > anchor for s, en in vaso[e]))
        out[e] = f
    return out


CFG = dict(include_codes=("1", "5"), exclude_codes=("9",), reps=3)


def test_date_site_matches_plain_reading(spark, raw, rows):
    for landmark in ("strict", "lenient"):
        want = brute(rows, landmark == "strict")
        cohort = sd.build_cohort(raw, sd.DateConfig(landmark=landmark, **CFG))
        got = cohort.toPandas().set_index("encounterid")
        assert set(got.index) == set(want) and len(want) > 30 and got.index.is_unique
        for e, f in want.items():
            r = got.loc[e]
            assert (r.A, r.antibiotic_days_30d, r.late_recurrent_or_persistent_abx_course_30d, r.death_30d) == (f["A"], f["days"], f["run"], f["death"]), e
            assert r.hospital_free_days_30d == f["hfd"] and r.vasopressor_any_0_24h == f["vaso"]
            for col, key in (("platelet_0_24h", "plate"), ("lactate_48_72h", "lact")):
                assert (np.isnan(r[col]) and f[key] is None) or r[col] == f[key]
    assert not [c for c in [*sd.BINARY, *sd.CONTINUOUS] if c not in got.columns]
    admin = sd.build_cohort(raw, sd.DateConfig(exposure="admin", **CFG))
    strict = set(brute(rows))
    assert {r["encounterid"] for r in admin.select("encounterid").collect()} == strict


def test_date_site_results(spark, raw):
    cfg = sd.DateConfig(**CFG)
    out = sd.results(sd.build_cohort(raw, cfg), cfg, binary=["sex_male", "comorb"], continuous=["age", "lactate_0_24h"])
    eff = out["effects"].toPandas()
    assert eff.analysis.nunique() == 5 and set(eff.outcome) == set(sd.OUTCOMES)
    assert out["bootstrap"].select("rep").distinct().count() == 3
    for k in ("missing_by_arm", "balance", "score_distribution", "weight_summary", "outcome_summary", "intervals"):
        assert out[k].count() > 0, k


CONFIG = {
    "icu": {"patid": "PT", "encounterid": "ENC", "start_datetime": "IN_DT", "end_datetime": "OUT_DT"},
    "medications": {
        "prescribing_columns": {"patid": "PATID", "encounterid": "ENCOUNTERID", "code": "CUI", "raw_name": "NAME", "route": "ROUTE", "start_date": "SD", "start_time": "ST", "end_date": "ED"},
        "med_admin_columns": {"patid": "PATID", "encounterid": "ENCOUNTERID", "code": "CODE", "raw_name": "NAME", "raw_route": "RT", "start_date": "SD", "start_time": "ST", "stop_date": "ED", "stop_time": "ET"},
    },
    "microbiology": {"source": "local", "local_columns": {"patid": "PATID", "encounterid": "ENCOUNTERID", "specimen_datetime": "SDT", "result_datetime": "RDT", "specimen": "SPEC", "test_name": "TEST", "organism": "ORG"}},
    "vasopressors": {"name_patterns": ["norepinephrine", "dopamine"]},
}


def test_mapped_site(spark):
    adm = "2020-01-01"
    enc = [(f"p{i}", f"e{i}", adm, "2020-01-20" if i != 3 else "2020-01-03", "IP" if i != 4 else "AV") for i in range(8)]
    dem = [(f"p{i}", "1960-01-01" if i != 5 else "2010-01-01", "M", "05") for i in range(8)]
    icu = [(f"p{i}", f"e{i}", "2020-01-01 06:00:00", "2020-01-09 00:00:00") for i in range(8)]
    rx = [(f"p{i}", f"e{i}", "x", "Vancomycin", "IV", adm, 800, "2020-01-05") for i in range(8)]
    # e1 stops before the window (narrowed by ceftriaxone), e2 stops with nothing left.
    rx[1] = ("p1", "e1", "x", "Vancomycin", "IV", adm, 800, "2020-01-04")
    rx[2] = ("p2", "e2", "x", "Vancomycin", "IV", adm, 800, "2020-01-04")
    rx.append(("p1", "e1", "x", "Ceftriaxone", "IV", "2020-01-04", 1200, "2020-01-06"))
    admin = [("p6", "e6", "1", "Norepinephrine drip", "IV", "2020-01-04", "05:00", "2020-01-04", "07:00"), ("p0", "e0", "1", "Vancomycin", "IV", adm, "09:00", "2020-01-06", "09:00")]
    micro = [(f"p{i}", f"e{i}", "2020-01-01 09:00:00", "2020-01-02 09:00:00" if i == 7 else "2020-01-08 09:00:00", "blood", "culture", "E COLI" if i in (0, 7) else "") for i in range(8)]
    death = [("p0", "2020-01-15")]
    make_ = spark.createDataFrame
    tables = {
        "encounter": make_(enc, "PATID string, ENCOUNTERID string, ADMIT_DATE string, DISCHARGE_DATE string, ENC_TYPE string"),
        "demographic": make_(dem, "PATID string, BIRTH_DATE string, SEX string, RACE string"),
        "icu_stays": make_(icu, "PT string, ENC string, IN_DT string, OUT_DT string"),
        "prescribing": make_(rx, "PATID string, ENCOUNTERID string, CUI string, NAME string, ROUTE string, SD string, ST int, ED string"),
        "med_admin": make_(admin, "PATID string, ENCOUNTERID string, CODE string, NAME string, RT string, SD string, ST string, ED string, ET string"),
        "micro": make_(micro, "PATID string, ENCOUNTERID string, SDT string, RDT string, SPEC string, TEST string, ORG string"),
        "death": make_(death, "PATID string, DEATH_DATE string"),
    }
    out = sm.run(tables, CONFIG)
    got = {r["encounterid"]: (r["A"], r["deescalation_type"]) for r in out["cohort"].collect()}
    # e3 left early, e4 outpatient, e5 minor, e6 vasopressor, e7 positive in time
    assert got == {
        "e0": (0, "continued_broad"), "e1": (1, "narrowed_or_non_broad_only"), "e2": (1, "stopped_all_observed_systemic_antibiotics"),
    }
    assert [r["n"] for r in out["flow"].orderBy("stage").collect()] == [6, 5, 4, 3, 3, 2, 1]
    assert {(r["A_order"], r["A_admin"]): r["n"] for r in out["order_vs_administration"].collect()} == {(0, 0): 1, (1, None): 2}
    assert {r["A"]: (r["n"], r["events"]) for r in out["crude_mortality"].collect()} == {0: (1, 1.0), 1: (2, 0.0)}
    with pytest.raises(ValueError):
        sm.without_vasopressors(out["cohort"], out["cohort"], "")
