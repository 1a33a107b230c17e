from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tideline.functions import lexicon as lx
from tideline.operators import micro as mi
from tideline.operators import phenotype as ph

T0 = datetime(2024, 1, 1)


def test_iv_broad_rule(spark):
    rows = [
        ("vancomycin", "iv", True, True), ("vancomycin", "po", False, False), ("meropenem", "intravenous push", True, True),
        ("cefepime ophth drops", "iv", False, False), ("ceftriaxone", "iv", False, True), ("ceftriaxone", "im", False, False),
        (None, None, False, False), ("cefepime", " IV ", True, True), ("piperacillin", "inhal neb", False, False), ("cefazolin", "po", False, True),
        # the enteral test is unanchored: "iv drip tubing" contains "tub"+"ng"
        ("vancomycin", "iv bag tubing", False, False),
    ]
    df = spark.createDataFrame(rows, "drug_lower string, route_lower string, b boolean, a boolean")
    got = df.select("b", "a", ph.broad_systemic("drug_lower", "route_lower").alias("gb"), ph.any_systemic("drug_lower", "route_lower").alias("ga")).collect()
    assert [(r["gb"], r["ga"]) for r in got] == [(r["b"], r["a"]) for r in got]


def test_code_map_name_order_and_non_iv(spark):
    rows = [
        ("11124", "whatever", None), (None, "Zosyn 4.5 g", "IV"), ("313570", "vancomycin", "IV"), ("x", "vancomycin oral capsule", None),
        ("x", "cefepime", "ORAL"), ("x", "ceftriaxone", "IV"), ("x", "ceftazidime-avibactam", "IV"), ("x", None, None),
    ]
    got = ph.classify_drugs(spark.createDataFrame(rows, "code string, name string, route string"), "code", "name", "route").collect()
    assert [r["broad_drug_group"] for r in got] == [
        "vancomycin", "piperacillin_tazobactam", None, None, None, None, "ceftazidime", None,
    ]
    assert [r["is_systemic_antibiotic"] for r in got] == [1, 1, 0, 0, 0, 1, 1, 0]


def test_site_b_exclusion_wins(spark):
    rows = [("vancomycin", "1", "IV"), ("vancomycin", "9", "IV"), ("aspirin", "1", ""), ("vancomycin tablet", "1", ""), ("cefepime", "2", "oral")]
    df = spark.createDataFrame(rows, "n string, c string, r string")
    got = [r[0] for r in df.select(ph.coded_broad("n", "c", "r", ["1", "9"], ["9"])).collect()]
    assert got == [True, False, True, False, False]


def test_result_classes(spark):
    df = spark.createDataFrame([("POSITIVE", "no growth"), (None, "growth of e. coli"), ("Detected", ""), (None, "pending")], "q string, r string")
    got = [r[0] for r in df.select(ph.direct_result("q", "r")).collect()]
    assert got == ["direct_negative", "direct_positive", "direct_positive", "direct_unresolved"]
    text = [r[0] for r in df.select(ph.result_text_class("r")).collect()]
    assert text == ["explicit_negative_no_growth", "explicit_growth_or_organism_language", "missing_or_blank", "other_text_pattern"]


def test_one_item_many_concepts(spark):
    df = spark.createDataFrame([(1, "Daily Weight height"), (2, "Heart Rate"), (3, None)], "itemid int, label string")
    got = {(r["itemid"], r["concept"]) for r in ph.concept_items(df, "itemid", "label", {**lx.BODY_PATTERNS, **lx.VITAL_PATTERNS}).collect()}
    assert got == {(1, "weight_kg"), (1, "height_cm"), (2, "heart_rate")}


def test_two_clock_rule(spark):
    """Positive before the decision excludes; positive known later keeps eligibility."""
    cohort = spark.createDataFrame(
        [(i, T0, T0 + timedelta(hours=72)) for i in (1, 2, 3, 4)], "hadm_id int, first_broad_time timestamp_ntz, decision_time timestamp_ntz"
    )
    h = lambda x: T0 + timedelta(hours=x)
    rows = [
        (1, h(1), h(60), "E. coli", "blood", "blood culture"), (2, h(1), h(80), "E. coli", "blood", "blood culture"),
        (3, h(-24), h(20), "", "urine", "urine culture"), (4, h(1), h(20), "MRSA", "nares", "mrsa screen"), (3, h(-25), h(1), "E. coli", "urine", "urine culture"),
    ]
    micro = spark.createDataFrame(
        rows, "hadm_id int, specimen_time timestamp_ntz, result_available_time timestamp_ntz, org_name string, spec_type_desc_lower string, test_name_lower string"
    )
    flags = mi.eligibility_flags(mi.classify(micro), cohort, "hadm_id")
    pick = lambda c: {r["hadm_id"] for r in flags.where(F.col(c) == 1).collect()}
    assert pick("is_eligible") == {2, 3}
    assert pick("is_positive_by_decision") == {1}
    assert pick("is_positive_eventually") == {1, 2}
    assert pick("is_eventually_negative") == {3}
    sizes = {r["metric"]: r["n_entities"] for r in mi.set_sizes(flags).collect()}
    assert sizes["sampled"] == 3 and sizes["strict_eligible"] == 2


def test_micro_category_precedence(spark):
    rows = [("blood", "blood culture pcr screen"), ("blood", "blood culture pcr"), ("blood", "blood culture"), ("blood", "chemistry")]
    df = spark.createDataFrame([(s, t, "", T0) for s, t in rows], "spec_type_desc_lower string, test_name_lower string, org_name string, result_available_time timestamp_ntz")
    assert [r["strict_culture_exclusion_reason"] for r in mi.classify(df).collect()] == [
        "screen_or_surveillance", "non_culture_diagnostic_test", "not_excluded_from_strict_culture", "test_name_not_culture",
    ]


def test_culture_groups_of_positivity_and_linkage(spark):
    from tideline.functions import lexicon as lx
    from tideline.operators import phenotype as ph

    names = {
        "Sputum Culture": ("other_culture", "respiratory"), "Fungal fluid culture": ("other_fluid", "fungal"), "AFB stool culture": ("stool", "afb_mycobacterial"),
        "Blood culture": ("blood", "blood"), "Culture": ("other_culture", "other_culture"),
    }
    df = spark.createDataFrame([(n,) for n in names], "name string")
    rows = df.select("name", ph.culture_group("name").alias("a"), ph.culture_group("name", lx.LINKAGE_CULTURE_GROUPS).alias("b")).collect()
    assert {r["name"]: (r["a"], r["b"]) for r in rows} == names
