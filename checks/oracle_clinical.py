"""Checking SQL for the clinical result tables, one small query per column.

Ranked subqueries and ``IN`` lists on purpose: the Spark plans aggregate each
source once. Regular expressions are written out by hand, so that they check the
pattern translation as well.
"""

from __future__ import annotations

import re

from anchorset.plans.bindings import STATEMENTS, in_dialect

from .oracle_events import _bands, _grade, _top, rounded

_MINUTES = "(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) // 60000000)"
_DIALECT = {
    "<text>": "varchar",
    "<minutes>": f"cast({_MINUTES} AS integer)",
    "<hours>": f"cast({_MINUTES} // 60 AS integer)",
    "<customer twice>": "(SELECT *, unnest([0, 1]) AS j FROM customer) AS c",
    "<events four times>": "(SELECT *, unnest([0, 1, 2, 3]) AS j FROM events) AS e",
    **{f"<{t}>": t for t in ("customer", "nation", "region", "events", "orders", "lineitem")},
}

_STEPS: dict[str, str] = {n: in_dialect(s, _DIALECT) for n, s in STATEMENTS.items()}

_STEPS["detail"] = """
    SELECT uniquepid, patienthealthsystemstayid, p.patientunitstayid, unitvisitnumber, p.hospitalid, h.region,
      unittype, apacheadmissiondx, hospitaladmitoffset, hospitaldischargeoffset, 0 AS unitadmitoffset,
      unitdischargeoffset, a.apachescore AS apache_iv, hospitaladmityear, unitadmityear, age,
      CASE WHEN contains(lower(hospitaldischargestatus), 'alive') THEN 0
           WHEN contains(lower(hospitaldischargestatus), 'expired') THEN 1 END AS hosp_mort,
      CASE WHEN contains(lower(unitdischargestatus), 'alive') THEN 0
           WHEN contains(lower(hospitaldischargestatus), 'expired') THEN 1 END AS unit_mort,
      CASE WHEN contains(lower(gender), 'female') THEN 0
           WHEN contains(lower(gender), 'male') THEN 1 END AS gender,
      ethnicity, admissionheight, admissionweight, dischargeweight, cast(unitdischargeoffset // 60 AS bigint) AS icu_los_hours
    FROM patient p LEFT JOIN hospital h ON h.hospitalid = p.hospitalid
    LEFT JOIN (SELECT * FROM apachepatientresult WHERE apacheversion = 'IV') a
      ON a.patientunitstayid = p.patientunitstayid"""

_STEPS["treated"] = f"""
    SELECT uniquepid, patienthealthsystemstayid AS hadmid, d.patientunitstayid AS icustay_id,
      cast(CASE WHEN age LIKE '%>%' THEN '91.4' ELSE age END AS double) AS age, gender, unittype AS icutype,
      apache_iv, admissionweight, admissionheight, dischargeweight, icu_los_hours, treatmentid, treatmentyear,
      treatmentoffset, {rounded("treatmentoffset / 60", 2)} AS treatmentoffset_hour, treatmentstring,
      activeupondischarge AS active, cast(rn AS integer) AS first_icu, unit_mort, hosp_mort,
      hospitaldischargeoffset, unitdischargeoffset, hospitaladmitoffset, ethnicity
    FROM (SELECT *, row_number() OVER (PARTITION BY uniquepid, patienthealthsystemstayid
            ORDER BY unitvisitnumber, patientunitstayid) AS rn FROM detail WHERE true) d
    JOIN treatment t ON t.patientunitstayid = d.patientunitstayid
    WHERE regexp_matches(lower(treatmentstring), '(?s)^(.*intra.*balloon.*pump.*|.*intraaortic.*)$')
      AND rn = 1 AND age <> ''
      AND cast(CASE WHEN age LIKE '%>%' THEN '91.4' WHEN age = '' THEN NULL ELSE age END AS double) >= 18"""

_STEPS["chosen"] = """
    SELECT * FROM treated WHERE icustay_id NOT IN
      (SELECT icustay_id FROM treated WHERE contains(lower(treatmentstring), 'removal'))"""

_STEPS["first_treatment"] = f"""
    SELECT f.*, admissionweight AS weight, admissionheight AS height, los.actualhospitallos AS hosp_los
    FROM ({_top("*", "chosen", "icustay_id", "treatmentoffset, treatmentid")}) f
    LEFT JOIN (SELECT DISTINCT patientunitstayid, actualhospitallos FROM apachepatientresult) los
      ON los.patientunitstayid = f.icustay_id"""

_STEPS["readings"] = """
    SELECT icustay_id, treatmentoffset, lower(labname) AS name, labresult, labresultoffset
    FROM lab JOIN first_treatment ON icustay_id = patientunitstayid WHERE labresult IS NOT NULL"""


def _last(cond: str, out: str) -> str:
    return _top(
        f"icustay_id, labresult AS {out}",
        f"(SELECT * FROM readings WHERE {cond} AND labresultoffset <= treatmentoffset) r",
        "icustay_id",
        "labresultoffset DESC, labresult DESC",
    )


def _extreme(cond: str, out: str, way: str) -> str:
    return _top(
        f"icustay_id, labresult AS {out}, labresultoffset",
        f"(SELECT * FROM readings WHERE {cond} AND labresultoffset >= treatmentoffset) r",
        "icustay_id",
        f"labresult {way}, labresultoffset",
    )


_STEPS["with_plt"] = f"""
    SELECT f.*, last_plt, min_plt, {rounded("(last_plt - min_plt) / last_plt", 4)} AS plt_dpc
    FROM first_treatment f
    JOIN ({_last("contains(name, 'platelet')", "last_plt")}) l ON l.icustay_id = f.icustay_id AND last_plt >= 100
    JOIN ({_extreme("contains(name, 'platelet')", "min_plt", "ASC")}) m ON m.icustay_id = f.icustay_id"""

# Output column -> (condition on the lower-case name, last | ASC | DESC).
_LABS = {
    "last_hgb0": ("name = 'hgb'", "last"),
    "min_hgb0": ("name = 'hgb'", "ASC"),
    "last_cr": ("name = 'creatinine'", "last"),
    "max_cr0": ("name = 'creatinine'", "DESC"),
    "last_crphs": ("name = 'crp-hs'", "last"),
    "max_crphs": ("name = 'crp-hs'", "DESC"),
    "last_crp": ("name = 'crp'", "last"),
    "max_crp": ("name = 'crp'", "DESC"),
    "last_wbc": ("name = 'wbc x 1000'", "last"),
    "max_wbc": ("name = 'wbc x 1000'", "DESC"),
    "last_ptt": ("name = 'ptt'", "last"),
    "max_ptt": ("name = 'ptt'", "DESC"),
    "last_ptinr": ("name LIKE 'pt%inr'", "last"),
    "max_ptinr": ("name LIKE 'pt%inr'", "DESC"),
    "last_pt": ("name = 'pt'", "last"),
    "max_pt": ("name = 'pt'", "DESC"),
    "last_ckmb": ("name LIKE 'cpk%mb'", "last"),
    "max_ckmb": ("name LIKE 'cpk%mb'", "DESC"),
    "last_troponint": ("name LIKE 'troponin%t%'", "last"),
    "max_troponint": ("name LIKE 'troponin%t%'", "DESC"),
    "last_troponini": ("name LIKE 'troponin%i%'", "last"),
    "max_troponini": ("name LIKE 'troponin%i%'", "DESC"),
    "last_bnp": ("name = 'bnp'", "last"),
    "maxbnp": ("name = 'bnp'", "DESC"),
    "last_temp": ("name = 'temperature'", "last"),
    "max_temp": ("name = 'temperature'", "DESC"),
    "last_rbc": ("name = 'rbc'", "last"),
    "minrbc": ("name = 'rbc'", "ASC"),
    "last_hct": ("name = 'hct'", "last"),
    "minhct": ("name = 'hct'", "ASC"),
    "last_glu": ("name = 'glucose'", "last"),
    "hdl": ("name = 'hdl'", "last"),
    "ldl": ("name = 'ldl'", "last"),
    "triglycerides": ("name = 'triglycerides'", "last"),
    "total_cholesterol": ("name = 'total cholesterol'", "last"),
}

_VENT = """(contains(lower(treatmentstring), 'mechanical ventilation') OR contains(lower(treatmentstring), 'cpap/peep therapy'))
    AND NOT contains(lower(treatmentstring), 'mask') AND NOT contains(lower(treatmentstring), 'non-invasive ventilation')
    AND NOT contains(lower(treatmentstring), 'surgery')"""
_ONSETS = {
    "rbc": ("contains(lower(treatmentstring), 'packed red blood cells')", False),
    "plt": ("contains(lower(treatmentstring), 'platelet concentrate')", False),
    "vent": (_VENT, True),
    "diaysis": ("contains(lower(treatmentstring), 'dialysis')", True),
}


def _events_at(cond: str, side: str) -> str:
    return (
        "SELECT t.patientunitstayid AS icustay_id, t.treatmentoffset AS moment FROM treatment t JOIN with_plt w"
        f" ON w.icustay_id = t.patientunitstayid WHERE {cond.replace('treatmentstring', 't.treatmentstring')}"
        f" AND t.treatmentoffset {side} w.treatmentoffset"
    )


for _name, (_cond, _new) in _ONSETS.items():
    _STEPS[f"on_{_name}"] = _events_at(_cond, ">=") + (
        f" AND t.patientunitstayid NOT IN (SELECT icustay_id FROM ({_events_at(_cond, '<')}) b)" if _new else ""
    )

for _name, _cols in {
    "sbp": ("systemicsystolic", "noninvasivesystolic"),
    "dbp": ("systemicdiastolic", "noninvasivediastolic"),
}.items():
    _STEPS[f"all_{_name}"] = (
        f"SELECT patientunitstayid AS icustay_id, observationoffset AS moment, {_cols[0]} AS v FROM vitalperiodic"
        f" UNION SELECT patientunitstayid, observationoffset, {_cols[1]} FROM vitalaperiodic"
    )
    _STEPS[f"get_{_name}"] = _top(
        "icustay_id, v",
        f"(SELECT s.* FROM all_{_name} s JOIN with_plt w ON w.icustay_id = s.icustay_id"
        " WHERE v IS NOT NULL AND moment <= treatmentoffset) r",
        "icustay_id",
        "moment DESC, v DESC",
    )


def _diagnosed(regex: str, side: str | None = None, refuse: str = "") -> str:
    """Stays with a matching diagnosis, optionally on one side of the index."""
    bound = f" AND diagnosisoffset {side} treatmentoffset" if side else ""
    veto = f" AND NOT contains(lower(diagnosisstring), '{refuse}')" if refuse else ""
    return (
        "SELECT patientunitstayid FROM diagnosis JOIN first_treatment ON icustay_id = patientunitstayid"
        f" WHERE regexp_matches(lower(diagnosisstring), '{regex}'){veto}{bound}"
    )


_STEPS["lab_wide"] = (
    "SELECT w.*, "
    + ", ".join(_LABS)
    + " FROM with_plt w"
    + "".join(
        f" LEFT JOIN ({_last(cond, out) if kind == 'last' else _extreme(cond, out, kind)}) j{i}"
        f" ON j{i}.icustay_id = w.icustay_id"
        for i, (out, (cond, kind)) in enumerate(_LABS.items())
    )
)
_STEPS["paired"] = f"""
    SELECT *, CASE WHEN min_hgb0 IS NOT NULL THEN last_hgb0 END AS last_hgb,
      CASE WHEN last_hgb0 IS NOT NULL THEN min_hgb0 END AS min_hgb,
      {rounded("last_hgb0 - min_hgb0", 4)} AS hgb_drop,
      CASE WHEN last_cr IS NOT NULL THEN max_cr0 END AS max_cr,
      {rounded("(max_cr0 - last_cr) / nullif(last_cr, 0)", 4)} AS cr_rise,
      (SELECT min(moment) FROM on_rbc o WHERE o.icustay_id = lab_wide.icustay_id) AS rbc_time,
      (SELECT min(moment) FROM on_plt o WHERE o.icustay_id = lab_wide.icustay_id) AS plt_time,
      (SELECT min(moment) FROM on_vent o WHERE o.icustay_id = lab_wide.icustay_id) AS vent_time,
      (SELECT min(moment) FROM on_diaysis o WHERE o.icustay_id = lab_wide.icustay_id) AS diaysis_time,
      CASE WHEN icustay_id IN (SELECT icustay_id FROM on_rbc) THEN 1 ELSE 0 END AS rbc_trans,
      CASE WHEN icustay_id IN (SELECT icustay_id FROM on_plt) THEN 1 ELSE 0 END AS plt_trans,
      CASE WHEN icustay_id IN (SELECT icustay_id FROM on_vent) THEN 1 ELSE 0 END AS vent,
      CASE WHEN icustay_id IN (SELECT icustay_id FROM on_diaysis) THEN 1 ELSE 0 END AS renal_diaysis,
      CASE WHEN icustay_id IN ({_diagnosed("hemorrhagic stroke", ">=")}) THEN 1 ELSE 0 END AS hemo_stroke,
      CASE WHEN icustay_id IN ({_diagnosed(
          "hemorrhage|gi bleeding|hypovolemic shock\\|hemorrhagic|acute blood loss anemia|hematuria|ongoing hemorr",
          ">=")}) THEN 1 ELSE 0 END AS witness_bleed
    FROM lab_wide"""
_STEPS["covar"] = f"""
    SELECT p.*, s.v AS sbp, d.v AS last_dbp, {_grade("hgb_drop", "hemo_stroke")} AS timibleed,
      CASE WHEN cr_rise < 0.5 THEN 0 WHEN cr_rise >= 0.5 THEN 1 END AS arf,
      CASE WHEN rbc_trans = 1 OR plt_trans = 1 THEN 1 ELSE 0 END AS transfusion_ind,
      CASE WHEN rbc_trans = 1 AND plt_trans = 1 THEN least(rbc_time, plt_time)
           WHEN rbc_trans = 1 THEN rbc_time WHEN plt_trans = 1 THEN plt_time END AS transfusion_time
    FROM paired p LEFT JOIN get_sbp s ON s.icustay_id = p.icustay_id LEFT JOIN get_dbp d ON d.icustay_id = p.icustay_id"""


def _in(table: str, text: str, regex: str, fold: bool = True) -> str:
    col = f"lower({text})" if fold else text
    return f"SELECT patientunitstayid FROM {table} WHERE regexp_matches({col}, '{regex}')"


def _past(regex: str) -> str:
    return _in("pasthistory", "pasthistorypath", regex)


def _admit(regex: str, fold: bool = True) -> str:
    return _in("admissiondx", "admitdxpath", regex, fold)


def _treat(regex: str, fold: bool = True) -> str:
    return _in("treatment", "treatmentstring", regex, fold)


def _med(regex: str) -> str:
    return _in("medication", "drugname", regex)


def _inf(regex: str) -> str:
    return _in("infusiondrug", "drugname", regex)


_G23, _THR = "tirofiban|abciximab|eptifibatide", "argatroban|bivalirudin|angiomax"
_FLAGS = {
    "prior_hypertension": [_past("hypertension"), _diagnosed("(vascular|ventricular) disorders\\|hypertension")],
    "prior_diabete": [_past("diabetes"), _diagnosed("diabetes mellitus")],
    "prior_renalfail": [_past("renal failure|renal insufficiency")],
    "prior_angina": [_past("angina")],
    "prior_mi": [_past("myocardial infarction")],
    "prior_pci": [_past("procedural coronary intervention")],
    "prior_cabg": [_past("coronary artery bypass")],
    "prior_chf": [_past("congestive heart failure")],
    "prior_valve": [_past("valve disease")],
    "prior_hearttrans": [_past("heart transplant")],
    "prior_stroketia": [_past("tia\\(s"), _past("stroke")],
    "prior_pad": [_past("peripheral vascular disease")],
    "prior_bleed": [_past("bleeding")],
    "prior_thrombosis": [_past("venous thrombosis|pulmonary embolism")],
    "prior_hypercholest": [_diagnosed("hyperlipidemia")],
    "trombo_outcome": [
        _diagnosed("dvt|lower extremity arterial thromboembolism|pulmonary embolism|ischemic stroke", ">=")
    ],
    "admind_cabg": [_admit("CABG", False), _diagnosed("cabg", "<", "no previous cabg")],
    "admind_ptca": [_admit("PTCA", False), _diagnosed("ptca", "<")],
    "admind_mi": [
        _admit("infarction, acute myocardial|acute mi|mi admitted"),
        _diagnosed(
            "acute myocardial infarction|due to myocardial infarction"
            "|acute coronary syndrome\\|(anterior wall|inferior wall|posterior wall)",
            "<",
        ),
    ],
    "admind_angina": [
        _admit("angina|chest pain"),
        _diagnosed(
            "unstable angina|chest pain / ashd\\|chest pain|acute cardiac problems\\|chest pain", "<"
        ),
    ],
    "admind_cardshock": [_diagnosed("cardiogenic shock", "<")],
    "aspirin_use": [_treat("aspirin"), _med("aspirin")],
    "g23i_use": [_treat("glycoprotein IIB/IIIA inhibitor", False), _med(_G23), _inf(_G23)],
    "aggrinhib_use": [_treat("aggregation inhibitors"), _med("clopidogrel")],
    "lmwh_use": [_treat("low molecular weight heparin"), _med("enoxaparin")],
    "fondapar_use": [_treat("factor xa inhibitor"), _med("fondaparinux")],
    "throminhib_use": [_treat("thrombin inhibitor"), _med(_THR), _inf(_THR)],
    "warfar_use": [_treat("coumadin"), _med("coumadin|warfarin")],
    "thrombo_use": [_treat("thrombolytic"), _med("tenecteplase")],
    "heparin_use": [_treat("conventional heparin therapy"), _inf("heparin")],
}

_STEPS["hist"] = (
    "SELECT c.* REPLACE (coalesce(cast(hosp_los AS double),"
    " cast((hospitaldischargeoffset - hospitaladmitoffset) // 60 AS double)) AS hosp_los), "
    + _bands("plt_dpc", [0.25, 0.5, 0.75], "left", [1, 2, 3, 4], 0)
    + " AS group_plt, "
    + _bands("plt_dpc", [0.5], "left", [1, 2], 0)
    + " AS group2_plt, CASE WHEN min_plt > 150 THEN 1 WHEN min_plt > 100 THEN 2 WHEN min_plt > 50 THEN 3"
    " WHEN min_plt <= 50 THEN 4 ELSE 0 END AS nadir, "
    + rounded("weight / nullif(pow(height / 100, 2), 0)", 2)
    + " AS bmi, "
    + ", ".join(
        f"CASE WHEN icustay_id IN ({' UNION '.join(parts)}) THEN 1 ELSE 0 END AS {name}"
        for name, parts in _FLAGS.items()
    )
    + " FROM covar c WHERE icustay_id NOT IN ("
    + _diagnosed("heparin induced thrombocytopenia|heparin-induced")
    + ")"
)

_STEPS["nadir_row"] = f"""
    SELECT icustay_id, nadir_hgb, labresultoffset AS min_hgb_time FROM ({_extreme("name = 'hgb'", "nadir_hgb", "ASC")}) n
    WHERE icustay_id IN (SELECT icustay_id FROM hist)"""
_STEPS["earlier"] = """
    SELECT r.icustay_id, labresult, labresultoffset, min_hgb_time FROM readings r JOIN nadir_row n
      ON n.icustay_id = r.icustay_id WHERE name = 'hgb' AND labresultoffset < min_hgb_time"""
_STEPS["lookback"] = f"""
    SELECT n.icustay_id, nadir_hgb, w.labresult AS max_hgb72, a.labresult AS max_hgb,
      a.labresult - nadir_hgb AS hgb_delta, w.labresult - nadir_hgb AS hgb_delta72, n.min_hgb_time,
      w.labresultoffset AS max_hgb71_time, a.labresultoffset AS max_hgb_time
    FROM nadir_row n
    LEFT JOIN ({_top("icustay_id, labresult, labresultoffset",
                     "(SELECT * FROM earlier WHERE labresultoffset >= min_hgb_time - 4320) e",
                     "icustay_id", "labresult DESC, labresultoffset")}) w ON w.icustay_id = n.icustay_id
    LEFT JOIN ({_top("icustay_id, labresult, labresultoffset", "earlier", "icustay_id",
                     "labresult DESC, labresultoffset")}) a ON a.icustay_id = n.icustay_id"""
_STEPS["ratio_rows"] = f"""
    SELECT h.icustay_id, plt_dpc,
      CASE WHEN plt_dpc <= 0.25 THEN 1 WHEN plt_dpc <= 0.5 THEN 2 WHEN plt_dpc <= 0.75 THEN 3
           WHEN plt_dpc <= 1.0 THEN 4 END AS dpc_group,
      {rounded("labresult / last_plt", 3)} AS plt_ratio, cast(labresultoffset // 60 AS double) AS labresultoffseth,
      {rounded("(labresultoffset // 60) / 24", 5)} AS labresultoffset_day,
      cast(ceil((labresultoffset // 60) / 24) AS bigint) AS day_offset
    FROM hist h JOIN readings r ON r.icustay_id = h.icustay_id
    WHERE contains(name, 'platelet') AND labresultoffset >= h.treatmentoffset"""

_BASIC = "age, gender, weight, height, icu_los_hours, icutype, unit_mort, hosp_mort, hosp_los"
_LAB_OUT = ", ".join(n for n in _LABS if not n.endswith("0") and n != "last_cr")
_COVAR = f"""last_plt, min_plt, plt_dpc, last_hgb, min_hgb, hgb_drop, {_LAB_OUT}, sbp, last_dbp, timibleed,
    last_cr, max_cr, cr_rise, arf, rbc_trans, rbc_time, plt_trans, plt_time, vent, vent_time, renal_diaysis,
    diaysis_time, transfusion_ind, transfusion_time"""
_FLAG_LIST = ", ".join(_FLAGS)


def _query(body: str) -> str:
    """The body with the steps it needs, directly or through other steps."""
    needed, text = set(), body
    for name, sql in reversed(_STEPS.items()):
        if re.search(rf"\b{name}\b", text):
            needed.add(name)
            text += " " + sql
    steps = ", ".join(f"{n} AS MATERIALIZED ({sql})" for n, sql in _STEPS.items() if n in needed)
    inner = body.lstrip()
    return f"WITH {steps}, {inner[5:]}" if inner.startswith("WITH ") else f"WITH {steps} {body}"


_BODIES = {
    "subject_detail": "SELECT * FROM detail",
    "cohort": "SELECT * EXCLUDE (hospitaladmitoffset, ethnicity) FROM chosen",
    "cohort_stays": "SELECT DISTINCT icustay_id FROM chosen",
    "index_baseline": f"SELECT icustay_id, {_BASIC}, treatmentoffset, last_plt, min_plt, plt_dpc AS dpc FROM with_plt",
    "covariates": f"SELECT icustay_id, {_BASIC}, treatmentoffset, {_COVAR} FROM covar",
    "history": f"""SELECT icustay_id, {_BASIC}, apache_iv, treatmentoffset, {_COVAR}, group_plt, group2_plt,
        nadir, bmi, {_FLAG_LIST} FROM hist""",
    "nadir_lookback": "SELECT * FROM lookback",
    "study_table": f"""
        SELECT h.icustay_id, age, {rounded("age / 10", 3)} AS age_10, gender, apache_iv,
          {rounded("apache_iv // 10", 3)} AS apache_iv_10, icu_los_hours, icutype, unit_mort, hosp_mort, hosp_los,
          CASE WHEN contains(lower(ethnicity), 'other') OR ethnicity = '' THEN 'other' ELSE ethnicity END AS ethnicity,
          CASE WHEN lower(ethnicity) = 'caucasian' THEN 1 ELSE 0 END AS ethnicity_group,
          hospitaladmitoffset AS delta_admi, treatmentoffset, last_plt, {rounded("last_plt / 10", 3)} AS last_plt_10,
          min_plt, {rounded("min_plt / 10", 3)} AS min_plt_10, plt_dpc, plt_dpc * 10 AS plt_dpc10, last_hgb,
          min_hgb AS ori_minhgb, hgb_drop AS ori_hgbdrop, hgb_delta72,
          CASE WHEN witness_bleed = 1 AND hgb_delta72 > 3 THEN 1 WHEN hemo_stroke = 1 THEN 1
               WHEN hgb_delta72 > 5 THEN 1 WHEN rbc_trans = 1 THEN 1 ELSE 0 END AS major_bleed,
          last_wbc, max_wbc, last_ptinr, max_ptinr, last_pt, max_pt, last_glu,
          {rounded("last_glu / 18", 3)} AS last_glu_18, sbp, last_dbp,
          {rounded("sbp * (1.0::double / 3) + last_dbp * 0", 4)} AS map_bp, last_cr, max_cr, cr_rise, arf,
          rbc_trans, plt_trans, vent, renal_diaysis, transfusion_ind, group2_plt AS group_plt, nadir, bmi,
          {_FLAG_LIST}
        FROM hist h LEFT JOIN lookback l ON l.icustay_id = h.icustay_id""",
    "platelet_ratios": "SELECT * FROM ratio_rows",
    "daily_coverage": """SELECT day_offset, count(*) AS subjects
        FROM (SELECT DISTINCT icustay_id, day_offset FROM ratio_rows) d GROUP BY day_offset""",
    "attrition": """
        SELECT 1 AS step, 'stays' AS stage, count(DISTINCT patientunitstayid) AS subjects FROM patient
        UNION ALL SELECT 2, 'cohort', count(DISTINCT icustay_id) FROM chosen
        UNION ALL SELECT 3, 'platelet_reading', count(DISTINCT icustay_id) FROM readings
          WHERE contains(name, 'platelet')
        UNION ALL SELECT 4, 'platelet_before_index', count(DISTINCT icustay_id) FROM readings
          WHERE contains(name, 'platelet') AND labresultoffset <= treatmentoffset
        UNION ALL SELECT 5, 'baseline', count(DISTINCT icustay_id) FROM with_plt
        UNION ALL SELECT 6, 'excluded_diagnosis', count(DISTINCT icustay_id) FROM with_plt
          WHERE icustay_id NOT IN (SELECT icustay_id FROM hist)
        UNION ALL SELECT 7, 'history', count(DISTINCT icustay_id) FROM hist
        UNION ALL SELECT 8, 'hgb_nadir', count(DISTINCT icustay_id) FROM lookback
        UNION ALL SELECT 9, 'hgb_before_nadir', count(DISTINCT icustay_id) FROM lookback WHERE max_hgb IS NOT NULL
        UNION ALL SELECT 10, 'hgb_before_nadir_72h', count(DISTINCT icustay_id) FROM lookback
          WHERE max_hgb72 IS NOT NULL""",
    "cohort_intent": """
        WITH v AS (SELECT icustay_id, count(DISTINCT treatmentstring) AS n,
                          bool_or(contains(lower(treatmentstring), 'removal')) AS removed
                   FROM treated GROUP BY icustay_id)
        SELECT * EXCLUDE (hospitaladmitoffset, ethnicity) FROM treated
        WHERE icustay_id IN (SELECT icustay_id FROM v WHERE n = 2 OR (n = 1 AND NOT removed))""",
}

ORACLES = {f"clinical_{name}": _query(body) for name, body in _BODIES.items()}
# The same table from bucketed stages.
ORACLES["clinical_covariates_bucketed"] = ORACLES["clinical_covariates"]
