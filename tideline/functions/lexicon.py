"""Word lists, patterns, code maps and covariate lists that define the results."""

# ---- medication phenotype, hour-level site (unanchored regular expressions) ----
BROAD_PATTERN = (
    r"vancomycin|piperacillin|tazobactam|zosyn|cefepime|ceftazidime|meropenem|"
    r"imipenem|aztreonam|linezolid|daptomycin|ceftolozane|avibactam"
)
NON_BROAD_PATTERN = (
    r"ceftriaxone|cefazolin|ampicillin|amoxicillin|doxycycline|azithromycin|"
    r"metronidazole|clindamycin|cephalexin|ciprofloxacin|levofloxacin|gentamicin|tobramycin"
)
NON_SYSTEMIC_TEXT = (
    r"oral liquid|enema|ophth|ophthalmic|otic|cream|ointment|topical|lock|irrigation|"
    r"inhal|intrathecal|intravitreal|desensitization|graded challenge|pharmacy to dose"
)
NON_SYSTEMIC_ROUTE = (
    r"rectal|enema|topical|ophth|otic|inhal|lock|irrigation|intravitreal|intrathecal|^it$|^ip$|^im$"
)
ORAL_ENTERAL_ROUTE = r"po|oral|enteral|ng|og|tube"
ORAL_EXCEPTION_DRUG = "vancomycin"
ANTI_MRSA_PATTERN = r"vancomycin|linezolid|daptomycin"
ANTIPSEUDOMONAL_PATTERN = (
    r"piperacillin|tazobactam|zosyn|cefepime|ceftazidime|meropenem|imipenem|"
    r"aztreonam|ceftolozane|avibactam"
)
CARBAPENEM_PATTERN = r"meropenem|imipenem"
ANAEROBIC_PATTERN = r"piperacillin|tazobactam|zosyn|meropenem|imipenem|metronidazole|clindamycin"
STEROID_PATTERN = r"hydrocortisone|methylprednisolone|prednisone|prednisolone|dexamethasone"
STEROID_BAD_ROUTE = r"topical|ophth|otic|inhal"
VASOPRESSOR_LABEL_PATTERN = r"norepinephrine|phenylephrine|vasopressin|epinephrine|dopamine"

# ---- medication phenotype, date-level site ----
SITE_B_BROAD_PATTERN = (
    r"vancomycin|vancocin|piperacillin|tazobactam|zosyn|cefepime|ceftazidime|fortaz|"
    r"meropenem|merrem|imipenem|primaxin|aztreonam|azactam|linezolid|zyvox|"
    r"daptomycin|cubicin|ceftolozane|zerbaxa|avibactam|avycaz"
)
SITE_B_NON_SYSTEMIC_PATTERN = r"cayston|inhal|nebul|tablet|capsule|oral solution|oral suspension|by mouth|\bpo\b"
SITE_B_BAD_ROUTES = ("ORAL", "RESPIRATORY_TRACT", "INHALATION")
SITE_B_VASOPRESSOR_TERMS = ("norepinephrine", "levophed", "phenylephrine", "vasopressin", "epinephrine", "dopamine")
SITE_B_VASOPRESSOR_EXCLUDE = ("racepinephrine", "nasal", "ophthalm", "lidocaine", "topical")

# ---- drug groups: code map, ordered name substrings, non-IV tests ----
CODE_TO_GROUP = {
    "11124": "vancomycin", "202368": "vancomycin", "239209": "vancomycin",
    "74170": "piperacillin_tazobactam", "8339": "piperacillin_tazobactam", "203134": "piperacillin_tazobactam",
    "20481": "cefepime", "2191": "ceftazidime", "203421": "ceftazidime",
    "29561": "meropenem", "83175": "meropenem", "5690": "imipenem_cilastatin", "33533": "imipenem_cilastatin",
    "1272": "aztreonam", "202561": "aztreonam", "190376": "linezolid", "261710": "linezolid",
    "22299": "daptomycin", "404965": "daptomycin", "1597616": "ceftolozane_tazobactam", "1603841": "ceftazidime_avibactam",
}
GROUP_NAMES = {
    "vancomycin": ("vancomycin", "vancocin"),
    "piperacillin_tazobactam": ("piperacillin", "zosyn", "tazobactam"),
    "cefepime": ("cefepime", "maxipime"),
    "ceftazidime": ("ceftazidime", "fortaz", "tazicef"),
    "meropenem": ("meropenem", "merrem"),
    "imipenem_cilastatin": ("imipenem", "primaxin"),
    "aztreonam": ("aztreonam", "azactam"),
    "linezolid": ("linezolid", "zyvox"),
    "daptomycin": ("daptomycin", "cubicin"),
    "ceftolozane_tazobactam": ("ceftolozane", "zerbaxa"),
    "ceftazidime_avibactam": ("avibactam", "avycaz"),
}
NON_IV_NAMES = (
    "oral", "capsule", "tablet", "suspension", "powder for oral", "enema", "ophthalmic", "topical",
    "inhalation", "nebulizer", "cream", "ointment", "drops",
)
NON_IV_CODES = ("313570", "313571", "2000134")
NON_IV_ROUTES = (
    "ORAL", "TOPICAL", "OPHTHALMIC", "RECTAL", "NASAL", "OTIC", "SUBLINGUAL", "BUCCAL", "TRANSDERMAL",
    "OROMUCOSAL", "VAGINAL", "INTRAVESICAL", "INTRAUTERINE", "RESPIRATORY_TRACT", "INTRATHECAL",
    "INTRADERMAL", "INTRAOCULAR", "INTRAVITREAL", "INTRA_ARTICULAR",
)
NON_BROAD_NAMES = (
    "ceftriaxone", "cefazolin", "ampicillin", "amoxicillin", "doxycycline", "azithromycin",
    "metronidazole", "clindamycin", "cephalexin", "ciprofloxacin", "levofloxacin", "gentamicin", "tobramycin",
)
FORMULATION_WORDS = {
    "inhaled": ("inhal", "nebul", "cayston"),
    "oral": ("oral", "capsule", "tablet", "by mouth", "oral solution"),
    "injectable_or_iv": ("inject", "intravenous", " vial", "infusion", "premix", "piggyback"),
}
FORMULATION_ROUTES = {
    "inhaled": ("RESPIRATORY_TRACT", "INHALATION"),
    "oral": ("ORAL",),
    "injectable_or_iv": ("INTRAVENOUS",),
}

# ---- microbiology ----
SCREEN_PATTERN = (
    r"screen|surveillance|mrsa|vre|rectal|nares|nasal|stool ova|parasite|"
    r"viral culture|covid|sars|influenza|respiratory viral|rsv|staph aureus swab|"
    r"legionella urinary antigen|strep pneumo antigen|clostridioides|c difficile|c\. difficile|toxin|antigen"
)
SITE_MAPPED_SCREEN_PATTERN = r"screen|surveillance|mrsa|vre|rectal|nares|nasal|stool ova|parasite|viral screen"
NON_CULTURE_TEST_PATTERN = (
    r"pcr|polymerase|antigen|antibody|serolog|immunolog|igm|igg|ifa|eia|elisa|"
    r"gram stain|smear|acid fast smear|afb smear|koh|potassium hydroxide|"
    r"rapid|screen|panel|probe|assay|toxin|immunofluorescent|immunofluorescence|dfa|"
    r"pneumocystis|direct fluorescent|molecular"
)
CULTURE_TEST_NAME_PATTERN = (
    r"culture|cultures|blood/fungal culture|blood/afb culture|"
    r"fluid culture|urine culture|blood culture|respiratory culture|wound culture|"
    r"fungal culture|anaerobic culture|acid fast culture|legionella culture|"
    r"campylobacter culture|fecal culture|catheter tip culture|tissue culture|"
    r"aerobic culture|bronchial culture|sputum culture|csf culture"
)
CLINICAL_SPECIMEN_PATTERN = (
    r"blood|urine|sputum|tracheal|bronch|lavage|respiratory|wound|abscess|fluid|"
    r"pleural|peritoneal|csf|cerebrospinal|tissue|catheter|bile|synovial|sterile"
)
FLORA_PATTERN = r"normal flora|mixed bacterial flora|skin flora|mixed flora"
CULTURE_SITES = {
    "blood_culture_pre72": "blood",
    "respiratory_culture_pre72": "sputum|respiratory|bronch|lavage|tracheal",
    "urine_culture_pre72": "urine",
    "sterile_fluid_culture_pre72": "csf|cerebrospinal|pleural|peritoneal|synovial|fluid|tissue|wound",
}
NEGATIVE_QUALIFIERS = ("NEGATIVE", "NOT DETECTED", "NO GROWTH")
NEGATIVE_TEXT = r"(^|\b)(no growth|negative|not detected)(\b|$)"
POSITIVE_QUALIFIERS = ("POSITIVE", "PRESUMPTIVE POSITIVE", "DETECTED", "PRESENT")
POSITIVE_TEXT = r"(^|\b)(positive|detected|growth of|isolated)(\b|$)"
RESULT_TEXT_CLASSES = {
    "explicit_negative_no_growth": r"no growth|no organisms? isolated|negative|not detected|none isolated",
    "mixed_or_normal_flora": (
        r"mixed (urogenital|skin|respiratory|oral|flora)|normal (respiratory|oral|skin|urogenital) flora|commensal flora"
    ),
    "contamination_language": r"contaminant|contamination",
    "explicit_growth_or_organism_language": r"positive|growth|isolated|isolate|organism",
    "susceptibility_language": r"susceptib|resistan|\bmic\b",
    "numeric_or_symbolic": r"^[0-9.+<> =-]+$",
}
CULTURE_GROUPS = {
    "blood": "blood culture",
    "urine": "urine culture",
    "respiratory": "respir",
    "wound": "wound",
    "tissue": "tissue",
    "csf": "csf",
    "other_fluid": "fluid",
    "stool": "stool",
    "fungal": "fung",
    "afb_mycobacterial": "afb|mycobacter",
}
LINKAGE_CULTURE_GROUPS = {
    "blood": "blood culture",
    "urine": "urine culture",
    "respiratory": "respir|sputum",
    "wound": "wound",
    "tissue": "tissue",
    "csf": "csf",
    "fungal": "fung",
    "afb_mycobacterial": "afb|mycobact",
    "stool": "stool",
    "other_fluid": "fluid",
}
SUSCEPTIBILITY_WORDS = ("susceptib", "sensitivity", "minimum inhibitory", " mic ")
ORGANISM_WORDS = ("organism", "isolate", "identification")
SIBLING_CLASSES = {
    "susceptibility_or_mic": ("susceptib", "sensitivity", "minimum inhibitory", " mic "),
    "organism_or_identification": ("organism", "isolate", "identification"),
    "gram_stain": ("gram stain", "gramstain", "gram "),
    "other_culture_component": ("culture",),
    "other_microbiology_named": ("micro", "bacter", "yeast", "fung", "afb", "mycobacter"),
}

# ---- diagnoses, procedures, care units ----
CHRONIC_TITLES = (
    r"diabetes|chronic kidney|renal failure|heart failure|copd|chronic obstructive|liver disease|cirrhosis|malignan|cancer"
)
HEART_FAILURE_TITLES = "heart failure"
KIDNEY_TITLES = "chronic kidney|renal failure"
VENTILATION_TITLES = "mechanical ventilation|respiratory ventilation|intubation"
CARE_UNITS = {
    "micu": "medical",
    "sicu": "surgical",
    "cardiac_icu": "coronary|cardiac|cardiovascular",
    "neuro_icu": "neuro",
}
ICD_PREFIXES = {
    "heart_failure": r"^(I50|428)",
    "chronic_kidney": r"^(N18|585)",
    "diabetes": r"^(E1[0-4]|250)",
    "copd": r"^(J44|491|492|496)",
    "chronic_liver": r"^(K70|K72|K74|571)",
    "malignancy": r"^(C[0-9]{2}|14[0-9]|15[0-9]|16[0-9]|17[0-9]|18[0-9]|19[0-9]|20[0-8])",
}

# ---- item dictionaries ----
LAB_LABELS = {
    "lactate": "lactate",
    "creatinine": "creatinine",
    "white blood cells": "wbc",
    "platelet count": "platelet",
    "bilirubin, total": "bilirubin",
}
VITAL_PATTERNS = {
    "heart_rate": r"^heart rate$",
    "resp_rate": r"respiratory rate",
    "spo2": r"o2 saturation|spo2|oxygen saturation",
    "map": r"blood pressure mean|arterial blood pressure mean|non invasive blood pressure mean",
    "temperature": r"temperature",
    "gcs_total": r"gcs.*total|glasgow coma scale.*total",
    "fio2": r"fraction inspired oxygen|fio2",
}
BODY_PATTERNS = {"weight_kg": r"admission weight|daily weight|weight", "height_cm": r"height"}
URINE_LABEL_PATTERN = r"urine|foley|void|urinary"
TRUE_TEMPERATURE_LABELS = (
    "temperature fahrenheit", "temperature celsius", "blood temperature cco (c)", "cerebral temperature (c)",
)
TRUE_FIO2_LABELS = ("inspired o2 fraction", "fraction inspired oxygen")
GCS_COMPONENT_LABELS = {"gcs - eye opening": "eye", "gcs - verbal response": "verbal", "gcs - motor response": "motor"}
GCS_COMPONENT_RANGES = {"eye": (1, 4), "verbal": (1, 5), "motor": (1, 6)}
SITE_B_LABS = {
    "lactate": (("2524-7", "32693-4", "19239-3"), 0.1, 30.0, "last"),
    "creatinine": (("2160-0", "38483-4"), 0.1, 30.0, "last"),
    "wbc": (("6690-2",), 0.1, 200.0, "last"),
    "platelet": (("777-3",), 1.0, 2000.0, "min"),
    "bilirubin_total": (("1975-2",), 0.01, 80.0, "max"),
}
SITE_B_VITALS = {
    "heart_rate": ("8867-4", 20.0, 250.0, "max"),
    "resp_rate": ("9279-1", 1.0, 90.0, "max"),
    "spo2": ("59408-5", 20.0, 100.0, "min"),
    "temperature": ("8310-5", 25.0, 45.0, "max"),
}

# ---- covariate lists ----
CONTINUOUS_VARS = (
    "age", "hours_admit_to_icu", "bmi_pre72",
    "vasopressor_hours_pre72",
    "lactate_last_pre72", "lactate_change_pre72",
    "creatinine_last_pre72", "creatinine_change_pre72",
    "white_blood_cells_last_pre72", "white_blood_cells_change_pre72",
    "hr_max_pre72", "rr_max_pre72", "spo2_min_pre72", "map_min_pre72", "temp_max_pre72",
    "severity_pre72",
    "lactate_early_last_0_24h", "lactate_late_last_48_72h", "lactate_change_early_to_late",
    "wbc_early_last_0_24h", "wbc_late_last_48_72h", "wbc_change_early_to_late",
    "creatinine_early_last_0_24h", "creatinine_late_last_48_72h", "creatinine_change_early_to_late",
    "platelet_late_worst_48_72h", "platelet_change_early_to_late",
    "bilirubin_late_worst_48_72h", "bilirubin_change_early_to_late",
    "heart_rate_48_72h", "resp_rate_48_72h", "spo2_48_72h", "map_48_72h", "temperature_48_72h",
    "gcs_total_48_72h", "fio2_48_72h",
    "urine_output_ml_48_72h", "urine_output_change_pre72",
    "sofa_like_0_24h", "sofa_like_48_72h", "sofa_like_change_pre72",
    "systemic_abx_hours_pre72", "systemic_abx_agents_pre72",
    "broad_abx_hours_pre72", "broad_abx_agents_pre72",
    "micro_records_pre72", "clinical_micro_records_pre72", "strict_culture_records_pre72", "distinct_specimen_types_pre72",
)
BINARY_VARS = (
    "sex_male", "race_white", "comorb", "heart_failure", "chronic_kidney", "vent_proc",
    "micu", "sicu", "cardiac_icu", "neuro_icu",
    "vasopressor_any_pre72",
    "lactate_missing_pre72", "creatinine_missing_pre72", "white_blood_cells_missing_pre72",
    "hr_max_pre72_missing", "rr_max_pre72_missing", "spo2_min_pre72_missing", "map_min_pre72_missing", "temp_max_pre72_missing",
    "lactate_rising_pre72", "wbc_rising_pre72", "creatinine_rising_pre72", "platelet_falling_pre72", "bilirubin_rising_pre72",
    "fever_last12h_pre72", "map_improved_pre72", "spo2_improved_pre72", "temp_improved_pre72", "rr_improved_pre72",
    "vasopressor_any_0_24h", "vasopressor_any_48_72h", "vasopressor_stopped_before_72h",
    "low_urine_output_48_72h", "sofa_like_improved_pre72",
    "anti_mrsa_pre72", "antipseudomonal_pre72", "carbapenem_pre72", "anaerobic_coverage_pre72",
    "repeat_micro_48_72h", "blood_culture_pre72", "respiratory_culture_pre72", "urine_culture_pre72", "sterile_fluid_culture_pre72",
    "steroid_any_pre72", "hydrocortisone_any_pre72",
)
NOT_IN_SCORE_MODEL = ("clinical_micro_records_pre72", "white_blood_cells_missing_pre72", "gcs_total_48_72h", "fio2_48_72h")
SCORE_VARS = tuple(v for v in CONTINUOUS_VARS + BINARY_VARS if v not in NOT_IN_SCORE_MODEL)
BASE_VARS = (
    "age", "sex_male", "race_white", "comorb", "heart_failure", "chronic_kidney", "hours_admit_to_icu",
    "micu", "sicu", "cardiac_icu", "neuro_icu",
)
SEVERITY_VARS = (
    "vent_proc", "vasopressor_any_pre72", "vasopressor_hours_pre72", "lactate_last_pre72",
    "creatinine_last_pre72", "white_blood_cells_last_pre72", "severity_pre72",
)
NEAR_DECISION_VARS = (
    "lactate_late_last_48_72h", "wbc_late_last_48_72h", "creatinine_late_last_48_72h",
    "platelet_late_worst_48_72h", "bilirubin_late_worst_48_72h",
    "heart_rate_48_72h", "resp_rate_48_72h", "spo2_48_72h", "map_48_72h", "temperature_48_72h",
    "urine_output_ml_48_72h", "sofa_like_48_72h",
)
PROGRESSIVE_MODELS = {
    "M1 demographics/comorbidity only": BASE_VARS,
    "M2 + baseline severity/labs": BASE_VARS + SEVERITY_VARS,
    "M3 + near-decision clinical status": BASE_VARS + SEVERITY_VARS + NEAR_DECISION_VARS,
    "M4 + improvement trajectories and intensity": SCORE_VARS,
}
QUADRATIC_VARS = ("temperature_48_72h", "broad_abx_hours_pre72", "systemic_abx_hours_pre72")

# ---- treatment subtypes ----
CONTINUED = "continued_broad"
NARROWED = "narrowed_or_non_broad_only"
STOPPED = "stopped_all_observed_systemic_antibiotics"
