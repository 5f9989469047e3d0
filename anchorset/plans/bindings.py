"""Clinical tables derived from the order and event tables.

The order and event tables hold no clinical data. These statements give every
row a clinical role, so that the whole clinical pipeline runs over whole tables:
customers become unit stays, events become treatments, readings and diagnoses,
orders become history entries and line items become drugs. The text of a
statement is the same for Spark SQL and for the checking engine; the few places
where the dialects differ are the ``<…>`` marks.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.tables import FrameSource, TableSource

TREATMENT_TEXTS = (
    "cardiovascular|ventricular dysfunction|intraaortic balloon pump",
    "cardiovascular|shock|Intra-aortic Balloon Pump",
    "cardiovascular|shock|intraaortic balloon counterpulsation",
    "cardiovascular|cardiac surgery|intra-aortic balloon pump",
    "cardiovascular|shock|intraaortic balloon pump|removal",
    "hematology|blood product administration|packed red blood cells",
    "hematology|platelet disorders|platelet concentrate",
    "pulmonary|ventilation and oxygenation|mechanical ventilation",
    "pulmonary|ventilation and oxygenation|mechanical ventilation|face mask",
    "pulmonary|ventilation and oxygenation|CPAP/PEEP therapy",
    "pulmonary|ventilation and oxygenation|non-invasive ventilation|mechanical ventilation",
    "renal|dialysis|hemodialysis",
    "cardiovascular|myocardial ischemia|aspirin",
    "cardiovascular|myocardial ischemia|glycoprotein IIB/IIIA inhibitor",
    "cardiovascular|myocardial ischemia|glycoprotein iib/iiia inhibitor",
    "hematology|anticoagulant|low molecular weight heparin",
    "hematology|anticoagulant|conventional heparin therapy",
    "cardiovascular|myocardial ischemia|aggregation inhibitors",
    "hematology|anticoagulant|factor Xa inhibitor",
    "hematology|anticoagulant|direct thrombin inhibitor",
    "hematology|anticoagulant|coumadin",
    "cardiovascular|myocardial ischemia|thrombolytics",
    "surgery|consultation|mechanical ventilation",
)
LAB_NAMES = (
    "platelets x 1000",
    "Hgb",
    "creatinine",
    "total cholesterol",
    "triglycerides",
    "HDL",
    "LDL",
    "glucose",
    "Hct",
    "RBC",
    "Temperature",
    "BNP",
    "troponin - I",
    "troponin - T",
    "CPK-MB",
    "PT",
    "PT - INR",
    "PTT",
    "WBC x 1000",
    "CRP",
    "CRP-hs",
    "platelets x 1000",
    "Hgb",
    "sodium",
)
DIAGNOSIS_TEXTS = (
    "cardiovascular|vascular disorders|hypertension",
    "endocrine|glucose metabolism|diabetes mellitus",
    "cardiovascular|vascular disorders|hyperlipidemia",
    "hematology|platelet disorders|thrombocytopenia|heparin-induced",
    "cardiovascular|cardiac surgery|s/p CABG < 7 days",
    "cardiovascular|history|no previous CABG",
    "cardiovascular|chest pain / ASHD|s/p PTCA",
    "cardiovascular|chest pain / ASHD|acute coronary syndrome|anterior wall",
    "cardiovascular|shock|due to myocardial infarction",
    "cardiovascular|chest pain / ASHD|chest pain",
    "cardiovascular|acute cardiac problems|chest pain",
    "cardiovascular|shock / hypotension|cardiogenic shock",
    "pulmonary|disorders of vasculature|pulmonary embolism",
    "cardiovascular|vascular disorders|DVT",
    "gastrointestinal|GI bleeding / PUD|GI bleeding",
    "cardiovascular|hypovolemic shock|hemorrhagic",
    "neurologic|disorders of vasculature|hemorrhagic stroke",
    "renal|disorder of urinary tract|hematuria",
    "neurologic|disorders of vasculature|ischemic stroke",
)
HISTORY_TEXTS = (
    "notes/Progress Notes/Past History/Hypertension Requiring Treatment",
    "notes/Progress Notes/Past History/insulin dependent diabetes",
    "notes/Progress Notes/Past History/Renal/renal failure - not currently dialyzed",
    "notes/Progress Notes/Past History/Renal/renal insufficiency - creatinine 1-2",
    "notes/Progress Notes/Past History/Angina/angina",
    "notes/Progress Notes/Past History/Myocardial Infarction/MI - remote",
    "notes/Progress Notes/Past History/Procedural Coronary Intervention",
    "notes/Progress Notes/Past History/Coronary Artery Bypass/within 6 months",
    "notes/Progress Notes/Past History/Congestive Heart Failure/CHF",
    "notes/Progress Notes/Past History/Valve disease/aortic stenosis",
    "notes/Progress Notes/Past History/heart transplant",
    "notes/Progress Notes/Past History/TIA(s)/multiple",
    "notes/Progress Notes/Past History/Strokes/stroke - within 5 years",
    "notes/Progress Notes/Past History/peripheral vascular disease",
    "notes/Progress Notes/Past History/bleeding/GI bleeding",
    "notes/Progress Notes/Past History/Venous Thrombosis/DVT",
    "notes/Progress Notes/Past History/Pulmonary Embolism",
)
ADMISSION_TEXTS = (
    "admission diagnosis|Operative|Cardiovascular|CABG alone",
    "admission diagnosis|Operative|Cardiovascular|cabg alone",
    "admission diagnosis|Non-operative|Cardiovascular|PTCA",
    "admission diagnosis|Non-operative|Infarction, acute myocardial (MI)",
    "admission diagnosis|Non-operative|MI admitted > 24hrs after onset",
    "admission diagnosis|Non-operative|Angina, unstable",
    "admission diagnosis|Non-operative|Chest pain, unknown origin",
)
DRUG_TEXTS = (
    "ASPIRIN 81 MG TAB",
    "tirofiban 5 mg/100 ml",
    "Eptifibatide drip",
    "clopidogrel 75 mg",
    "enoxaparin 40 mg syringe",
    "Fondaparinux 2.5 mg",
    "bivalirudin 250 mg",
    "Coumadin 5 mg",
    "warfarin 2 mg",
    "tenecteplase 50 mg",
    "Heparin 25,000 unit drip",
    "argatroban 250 mg",
)


def _texts(name: str, texts: tuple[str, ...]) -> str:
    rows = ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts))
    return f"(VALUES {rows}) AS {name}(id, text)"


STATEMENTS = {
    "patient": """
        SELECT concat('P', cast(cast(floor(c_custkey * 3 / 8) AS bigint) AS <text>)) AS uniquepid,
               cast(floor(c_custkey * 3 / 4) AS bigint) AS patienthealthsystemstayid,
               c_custkey AS patientunitstayid,
               cast((c_custkey * 7) % 3 + 1 AS int) AS unitvisitnumber,
               c_nationkey AS hospitalid,
               c_mktsegment AS unittype,
               lower(c_mktsegment) AS apacheadmissiondx,
               cast(-((c_custkey * 37) % 5000) AS int) AS hospitaladmitoffset,
               cast(20000 + (c_custkey * 53) % 30000 AS int) AS hospitaldischargeoffset,
               cast(1000 + (c_custkey * 91) % 20000 AS int) AS unitdischargeoffset,
               2014 AS hospitaladmityear,
               2014 AS unitadmityear,
               CASE WHEN c_custkey % 11 = 0 THEN '> 89' WHEN c_custkey % 17 = 3 THEN ''
                    WHEN c_custkey % 19 = 5 THEN NULL
                    ELSE cast(8 + (c_custkey * 13) % 82 AS <text>) END AS age,
               CASE WHEN c_custkey % 5 = 0 THEN 'Expired' WHEN c_custkey % 23 = 1 THEN ''
                    ELSE 'Alive' END AS hospitaldischargestatus,
               CASE WHEN c_custkey % 10 = 0 THEN 'Expired' WHEN c_custkey % 29 = 2 THEN ''
                    ELSE 'Alive' END AS unitdischargestatus,
               CASE WHEN c_custkey % 31 = 1 THEN 'Unknown' WHEN c_custkey % 2 = 0 THEN 'Female'
                    ELSE 'Male' END AS gender,
               CASE c_custkey % 4 WHEN 0 THEN 'Caucasian' WHEN 1 THEN 'African American'
                    WHEN 2 THEN 'Other/Unknown' ELSE '' END AS ethnicity,
               CASE WHEN c_custkey % 37 = 0 THEN 0.0 WHEN c_custkey % 41 = 1 THEN NULL
                    ELSE cast(150 + c_custkey % 50 AS double) END AS admissionheight,
               cast(50 + c_custkey % 60 AS double) + 0.5 AS admissionweight,
               cast(49 + c_custkey % 60 AS double) AS dischargeweight
        FROM <customer>""",
    "hospital": """
        SELECT n_nationkey AS hospitalid, r_name AS region
        FROM <nation> LEFT JOIN <region> ON n_regionkey = r_regionkey""",
    "apachepatientresult": """
        SELECT c_custkey AS patientunitstayid,
               CASE WHEN j = 0 THEN 'IV' ELSE 'IVa' END AS apacheversion,
               cast((c_custkey * 7) % 150 + 3 * j AS int) AS apachescore,
               CASE WHEN c_custkey % 9 = 4 THEN NULL
                    ELSE cast(c_custkey % 40 AS double) / 4.0 END AS actualhospitallos
        FROM <customer twice>""",
    "treatment": f"""
        SELECT user_id AS patientunitstayid, event_id AS treatmentid, 2014 AS treatmentyear,
               <minutes> AS treatmentoffset,
               coalesce(t.text, 'general|nursing care') AS treatmentstring,
               CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END AS activeupondischarge
        FROM <events> LEFT JOIN {_texts("t", TREATMENT_TEXTS)}
          ON t.id = CASE WHEN event_id % 83 = 4 AND event_id % 3 > 0 THEN -1 ELSE event_id % 83 END""",
    "lab": f"""
        SELECT user_id AS patientunitstayid,
               t.text AS labname,
               CASE WHEN (event_id + j) % 53 = 0 THEN NULL
                    WHEN (event_id + 7 * j) % {len(LAB_NAMES)} IN (1, 22) THEN 6.0 + value / 8.0 + j / 4.0
                    ELSE 90.0 + value * 4.0 + j END AS labresult,
               <minutes> AS labresultoffset
        FROM <events four times> JOIN {_texts("t", LAB_NAMES)}
          ON t.id = (event_id + 7 * j) % {len(LAB_NAMES)}""",
    "vitalperiodic": """
        SELECT user_id AS patientunitstayid, <hours> * 60 AS observationoffset,
               CASE WHEN event_id % 13 = 0 THEN NULL ELSE 80.0 + value END AS systemicsystolic,
               CASE WHEN event_id % 7 = 0 THEN NULL ELSE 40.0 + value / 2.0 END AS systemicdiastolic
        FROM <events> WHERE event_type IN ('click', 'view', 'purchase')""",
    "vitalaperiodic": """
        SELECT user_id AS patientunitstayid, <hours> * 60 AS observationoffset,
               85.0 + value AS noninvasivesystolic,
               CASE WHEN event_id % 5 = 0 THEN NULL ELSE 45.0 + value / 2.0 END AS noninvasivediastolic
        FROM <events> WHERE event_type IN ('error', 'signup')""",
    "diagnosis": f"""
        SELECT user_id AS patientunitstayid,
               coalesce(t.text, 'general|observation') AS diagnosisstring,
               <minutes> AS diagnosisoffset
        FROM <events> LEFT JOIN {_texts("t", DIAGNOSIS_TEXTS)} ON t.id = (event_id * 5) % 307""",
    "pasthistory": f"""
        SELECT o_custkey AS patientunitstayid,
               coalesce(t.text, 'notes/Progress Notes/Past History/none') AS pasthistorypath
        FROM <orders> LEFT JOIN {_texts("t", HISTORY_TEXTS)} ON t.id = o_orderkey % 61""",
    "admissiondx": f"""
        SELECT o_custkey AS patientunitstayid,
               coalesce(t.text, 'admission diagnosis|other') AS admitdxpath
        FROM <orders> LEFT JOIN {_texts("t", ADMISSION_TEXTS)} ON t.id = (o_orderkey * 3) % 59""",
    "medication": f"""
        SELECT l_partkey AS patientunitstayid,
               coalesce(t.text, 'acetaminophen 325 mg') AS drugname
        FROM <lineitem> LEFT JOIN {_texts("t", DRUG_TEXTS)} ON t.id = l_orderkey % 263""",
    "infusiondrug": f"""
        SELECT l_suppkey AS patientunitstayid,
               coalesce(t.text, 'normal saline') AS drugname
        FROM <lineitem> LEFT JOIN {_texts("t", DRUG_TEXTS)} ON t.id = l_orderkey % 1511""",
}

_INPUTS = ("customer", "nation", "region", "events", "orders", "lineitem")
_SPARK_MINUTES = "timestampdiff(MINUTE, timestamp_ntz'2024-01-01 00:00:00', ts)"
SPARK_DIALECT = {
    "<text>": "string",
    "<minutes>": f"cast({_SPARK_MINUTES} AS int)",
    "<hours>": f"cast({_SPARK_MINUTES} div 60 AS int)",
    "<customer twice>": "(SELECT *, explode(sequence(0, 1)) AS j FROM {customer}) AS c",
    "<events four times>": "(SELECT *, explode(sequence(0, 3)) AS j FROM {events}) AS e",
    **{f"<{t}>": f"{{{t}}}" for t in _INPUTS},
}


def in_dialect(statement: str, dialect: dict[str, str]) -> str:
    for mark, text in dialect.items():
        statement = statement.replace(mark, text)
    return statement


class ClinicalTables(FrameSource):
    """The twelve clinical tables over the Parquet files of ``sf_dir``; each is
    built when a plan first reads it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__({})
        self.spark, self.base, self.inputs = spark, TableSource(spark, path=sf_dir), {}

    def table(self, name, columns=None):
        if name not in self.frames:
            text = in_dialect(STATEMENTS[name], SPARK_DIALECT)
            used = [n for n in _INPUTS if "{" + n + "}" in text]
            for n in used:
                if n not in self.inputs:
                    self.inputs[n] = self.base.table(n)
            self.frames[name] = self.spark.sql(text, **{n: self.inputs[n] for n in used})
        return super().table(name, columns)


def clinical_source(spark: SparkSession, sf_dir: str) -> ClinicalTables:
    return ClinicalTables(spark, sf_dir)
