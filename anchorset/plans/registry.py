"""Fixed values of the clinical pipeline: text patterns, limits, units.

These equal what the published study definition uses; they are data, not logic.
"""

from __future__ import annotations

from ..functions.patterns import like, similar

# --- fixed values: index treatment, age limit, baseline limit, look-back --------
INDEX_TREATMENT = similar("%intra%balloon%pump%|%intraaortic%")
INDEX_REMOVAL = like("%removal%")
CAPPED_AGE = 91.4
MIN_AGE = 18
MIN_BASELINE = 100
LOOKBACK_MINUTES = 4320
APACHE_VERSION = "IV"

# --- fixed values: status texts ---------------------------------------------------
ALIVE = like("%alive%")
EXPIRED = like("%expired%")
FEMALE = like("%female%")
MALE = like("%male%")
OTHER_ETHNICITY = like("%other%")
REFERENCE_ETHNICITY = "caucasian"

# --- fixed values: laboratory names -----------------------------------------------
LABS = {
    "platelet": like("%platelet%"),
    "hgb": like("hgb"),
    "creatinine": like("creatinine"),
    "total_cholesterol": like("total cholesterol"),
    "triglycerides": like("triglycerides"),
    "hdl": like("hdl"),
    "ldl": like("ldl"),
    "glucose": like("glucose"),
    "hct": like("hct"),
    "rbc": like("rbc"),
    "temperature": like("temperature"),
    "bnp": like("bnp"),
    "troponin_i": like("troponin%i%"),
    "troponin_t": like("troponin%t%"),
    "ckmb": like("cpk%mb"),
    "pt": like("pt"),
    "ptinr": like("pt%inr"),
    "ptt": like("ptt"),
    "wbc": like("wbc x 1000"),
    "crp": like("crp"),
    "crphs": like("crp-hs"),
}

# Output column -> (laboratory, last value at the index | extreme after it).
LAB_COLUMNS = {
    "last_plt": ("platelet", "last_value"),
    "min_plt": ("platelet", "min_value"),
    "last_hgb": ("hgb", "last_value"),
    "min_hgb": ("hgb", "min_value"),
    "last_cr": ("creatinine", "last_value"),
    "max_cr": ("creatinine", "max_value"),
    "last_crphs": ("crphs", "last_value"),
    "max_crphs": ("crphs", "max_value"),
    "last_crp": ("crp", "last_value"),
    "max_crp": ("crp", "max_value"),
    "last_wbc": ("wbc", "last_value"),
    "max_wbc": ("wbc", "max_value"),
    "last_ptt": ("ptt", "last_value"),
    "max_ptt": ("ptt", "max_value"),
    "last_ptinr": ("ptinr", "last_value"),
    "max_ptinr": ("ptinr", "max_value"),
    "last_pt": ("pt", "last_value"),
    "max_pt": ("pt", "max_value"),
    "last_ckmb": ("ckmb", "last_value"),
    "max_ckmb": ("ckmb", "max_value"),
    "last_troponint": ("troponin_t", "last_value"),
    "max_troponint": ("troponin_t", "max_value"),
    "last_troponini": ("troponin_i", "last_value"),
    "max_troponini": ("troponin_i", "max_value"),
    "last_bnp": ("bnp", "last_value"),
    "maxbnp": ("bnp", "max_value"),
    "last_temp": ("temperature", "last_value"),
    "max_temp": ("temperature", "max_value"),
    "last_rbc": ("rbc", "last_value"),
    "minrbc": ("rbc", "min_value"),
    "last_hct": ("hct", "last_value"),
    "minhct": ("hct", "min_value"),
    "last_glu": ("glucose", "last_value"),
    "hdl": ("hdl", "last_value"),
    "ldl": ("ldl", "last_value"),
    "triglycerides": ("triglycerides", "last_value"),
    "total_cholesterol": ("total_cholesterol", "last_value"),
}

# --- fixed values: treatments at or after the index -------------------------------
ONSETS = {
    "rbc_time": like("%packed red blood cells%"),
    "plt_time": like("%platelet concentrate%"),
    "vent_time": similar(
        "%mechanical ventilation%|%cpap/peep therapy%",
        none_of=("%mask%", "%non-invasive ventilation%", "%surgery%"),
    ),
    "diaysis_time": similar("%dialysis%"),
}
NEW_ONSETS = ("vent_time", "diaysis_time")
ONSET_FLAGS = {
    "rbc_trans": "rbc_time",
    "plt_trans": "plt_time",
    "vent": "vent_time",
    "renal_diaysis": "diaysis_time",
}

# --- fixed values: history flags by source table -----------------------------------
PAST_HISTORY = {
    "prior_hypertension": like("%hypertension%"),
    "prior_diabete": like("%diabetes%"),
    "prior_renalfail": similar("%renal failure%|%renal insufficiency%"),
    "prior_angina": similar("%angina%"),
    "prior_mi": similar("%myocardial infarction%"),
    "prior_pci": similar("%procedural coronary intervention%"),
    "prior_cabg": similar("%coronary artery bypass%"),
    "prior_chf": similar("%congestive heart failure%"),
    "prior_valve": similar("%valve disease%"),
    "prior_hearttrans": similar("%heart transplant%"),
    "prior_stroketia": similar("%tia\\(s%|%stroke%"),
    "prior_pad": similar("%peripheral vascular disease%"),
    "prior_bleed": similar("%bleeding%"),
    "prior_thrombosis": similar("%venous thrombosis%|%pulmonary embolism%"),
}

# Diagnosis flags: rule and side of the index (None: any time of the stay).
DIAGNOSES = {
    "prior_hypertension": (similar("%(vascular|ventricular) disorders\\|hypertension%"), None),
    "prior_diabete": (similar("%diabetes mellitus%"), None),
    "prior_hypercholest": (similar("%hyperlipidemia%"), None),
    "excluding_diagnosis": (
        similar("%(heparin induced thrombocytopenia|heparin-induced)%"),
        None,
    ),
    "admind_cabg": (like("%cabg%", none_of=("%no previous cabg%",)), "before"),
    "admind_ptca": (like("%ptca%"), "before"),
    "admind_mi": (
        similar(
            "%(acute myocardial infarction|due to myocardial infarction)%"
            "|%acute coronary syndrome\\|(anterior wall|inferior wall|posterior wall)%"
        ),
        "before",
    ),
    "admind_angina": (
        similar(
            "%(unstable angina|chest pain \\/ ashd\\|chest pain"
            "|acute cardiac problems\\|chest pain)%"
        ),
        "before",
    ),
    "admind_cardshock": (similar("%cardiogenic shock%"), "before"),
    "trombo_outcome": (
        similar(
            "%(dvt|lower extremity arterial thromboembolism|pulmonary embolism|ischemic stroke)%"
        ),
        "from",
    ),
    "witness_bleed": (
        similar(
            "%(hemorrhage|gi bleeding|hypovolemic shock\\|hemorrhagic"
            "|acute blood loss anemia|hematuria|ongoing hemorr)%"
        ),
        "from",
    ),
    "hemo_stroke": (similar("%hemorrhagic stroke%"), "from"),
}

ADMISSION = {
    "admind_cabg": like("%CABG%", lower=False),
    "admind_ptca": like("%PTCA%", lower=False),
    "admind_mi": similar("%(infarction, acute myocardial|acute mi|mi admitted)%"),
    "admind_angina": similar("%(angina|chest pain)%"),
}

# --- fixed values: drug flags by source table ---------------------------------------
TREATMENT_DRUGS = {
    "aspirin_use": similar("%aspirin%"),
    "g23i_use": similar("%glycoprotein IIB\\/IIIA inhibitor%", lower=False),
    "aggrinhib_use": similar("%aggregation inhibitors%"),
    "lmwh_use": similar("%low molecular weight heparin%"),
    "fondapar_use": similar("%factor xa inhibitor%"),
    "throminhib_use": similar("%thrombin inhibitor%"),
    "warfar_use": similar("%coumadin%"),
    "thrombo_use": similar("%thrombolytic%"),
    "heparin_use": similar("%conventional heparin therapy%"),
}
MEDICATION_DRUGS = {
    "aspirin_use": similar("%aspirin%"),
    "g23i_use": similar("%(tirofiban|abciximab|eptifibatide)%"),
    "aggrinhib_use": similar("%clopidogrel%"),
    "lmwh_use": similar("%enoxaparin%"),
    "fondapar_use": similar("%fondaparinux%"),
    "throminhib_use": similar("%(argatroban|bivalirudin|angiomax)%"),
    "warfar_use": similar("%(coumadin|warfarin)%"),
    "thrombo_use": similar("%(tenecteplase)%"),
}
INFUSION_DRUGS = {
    "g23i_use": similar("%(tirofiban|abciximab|eptifibatide)%"),
    "throminhib_use": similar("%(argatroban|bivalirudin|angiomax)%"),
    "heparin_use": similar("%heparin%"),
}

# Order of the flag columns in the history and study tables.
HISTORY_FLAGS = (
    "prior_hypertension",
    "prior_diabete",
    "prior_renalfail",
    "prior_angina",
    "prior_mi",
    "prior_pci",
    "prior_cabg",
    "prior_chf",
    "prior_valve",
    "prior_hearttrans",
    "prior_stroketia",
    "prior_pad",
    "prior_bleed",
    "prior_thrombosis",
    "prior_hypercholest",
    "trombo_outcome",
    "admind_cabg",
    "admind_ptca",
    "admind_mi",
    "admind_angina",
    "admind_cardshock",
    "aspirin_use",
    "g23i_use",
    "aggrinhib_use",
    "lmwh_use",
    "fondapar_use",
    "throminhib_use",
    "warfar_use",
    "thrombo_use",
    "heparin_use",
)

# --- fixed values: band edges ---------------------------------------------------------
DROP_EDGES = (0.25, 0.5, 0.75)
DROP_EDGES_CAPPED = (0.25, 0.5, 0.75, 1.0)
DROP_EDGE_2 = (0.5,)
NADIR_EDGES = (50, 100, 150)
NADIR_LABELS = (4, 3, 2, 1)
RISE_LIMIT = 0.5
PRESSURE_WEIGHTS = (1 / 3, 0.0)  # as published; the usual weights are 1/3 and 2/3
GLUCOSE_DIVISOR = 18

# --- fixed values: tables and the columns read ------------------------------------------
TABLES = {
    "patient": (
        "uniquepid",
        "patienthealthsystemstayid",
        "patientunitstayid",
        "unitvisitnumber",
        "hospitalid",
        "unittype",
        "apacheadmissiondx",
        "hospitaladmitoffset",
        "hospitaldischargeoffset",
        "unitdischargeoffset",
        "hospitaladmityear",
        "unitadmityear",
        "age",
        "hospitaldischargestatus",
        "unitdischargestatus",
        "gender",
        "ethnicity",
        "admissionheight",
        "admissionweight",
        "dischargeweight",
    ),
    "hospital": ("hospitalid", "region"),
    "apachepatientresult": ("patientunitstayid", "apacheversion", "apachescore", "actualhospitallos"),
    "treatment": (
        "patientunitstayid",
        "treatmentid",
        "treatmentyear",
        "treatmentoffset",
        "treatmentstring",
        "activeupondischarge",
    ),
    "lab": ("patientunitstayid", "labname", "labresult", "labresultoffset"),
    "vitalperiodic": ("patientunitstayid", "observationoffset", "systemicsystolic", "systemicdiastolic"),
    "vitalaperiodic": (
        "patientunitstayid",
        "observationoffset",
        "noninvasivesystolic",
        "noninvasivediastolic",
    ),
    "diagnosis": ("patientunitstayid", "diagnosisstring", "diagnosisoffset"),
    "pasthistory": ("patientunitstayid", "pasthistorypath"),
    "admissiondx": ("patientunitstayid", "admitdxpath"),
    "medication": ("patientunitstayid", "drugname"),
    "infusiondrug": ("patientunitstayid", "drugname"),
}
