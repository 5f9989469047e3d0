"""The clinical pipeline on hand-made tables with the column types of the real
ones, checked against results worked out by hand."""

from decimal import Decimal

import pytest

from anchorset.plans import clinical
from anchorset.sources.stages import StageStore
from anchorset.sources.tables import FrameSource, TableSource

SCHEMAS = {
    "patient": "uniquepid string, patienthealthsystemstayid long, patientunitstayid long, unitvisitnumber int,"
    " hospitalid int, unittype string, apacheadmissiondx string, hospitaladmitoffset int,"
    " hospitaldischargeoffset int, unitdischargeoffset int, hospitaladmityear int, unitadmityear int, age string,"
    " hospitaldischargestatus string, unitdischargestatus string, gender string, ethnicity string,"
    " admissionheight decimal(10,2), admissionweight decimal(10,2), dischargeweight decimal(10,2)",
    "hospital": "hospitalid int, region string",
    "apachepatientresult": "patientunitstayid long, apacheversion string, apachescore int, actualhospitallos double",
    "treatment": "patientunitstayid long, treatmentid long, treatmentyear int, treatmentoffset int,"
    " treatmentstring string, activeupondischarge string",
    "lab": "patientunitstayid long, labname string, labresult decimal(11,4), labresultoffset int,"
    " labmeasurenamesystem string, labmeasurenameinterface string",
    "vitalperiodic": "patientunitstayid long, observationoffset int, systemicsystolic double, systemicdiastolic double",
    "vitalaperiodic": "patientunitstayid long, observationoffset int, noninvasivesystolic double,"
    " noninvasivediastolic double",
    "diagnosis": "patientunitstayid long, diagnosisstring string, diagnosisoffset int",
    "pasthistory": "patientunitstayid long, pasthistorypath string",
    "admissiondx": "patientunitstayid long, admitdxpath string",
    "medication": "patientunitstayid long, drugname string",
    "infusiondrug": "patientunitstayid long, drugname string",
}
PUMP = "cardiovascular|shock|intraaortic balloon pump"


def _patient(stay, pid, visit=1, age="60", unit="Alive", hosp="Alive", gender="Male", ethnicity="Caucasian", height=200, hadm=None):
    d = Decimal
    return (
        pid, hadm or stay * 10, stay, visit, 7, "CCU", "dx", -120, 3000, 1439, 2014, 2014, age, hosp, unit, gender,
        ethnicity, None if height is None else d(height), d(80), d(79),
    )


def _lab(stay, name, value, off):
    return (stay, name, None if value is None else Decimal(str(value)), off, "u", "u")


@pytest.fixture(scope="module")
def data():
    patients = [
        _patient(1, "a"),
        _patient(2, "b", age="> 89", unit="Expired", hosp="Expired", gender="Female", ethnicity="Other/Unknown", height=0),
        _patient(3, "c", age="17"),  # too young
        _patient(4, "d", age=""),  # unknown age
        _patient(5, "e", hadm=50),  # first stay without the treatment
        _patient(6, "e", visit=2, hadm=50),  # treatment in the second stay only
        _patient(7, "f"),  # removal only
        _patient(8, "g"),  # insertion and removal
        _patient(9, "h"),  # baseline below the limit
        _patient(10, "i"),  # excluding diagnosis
        _patient(11, "j", ethnicity="", height=None),
        _patient(12, "k"),  # no platelet reading after the index
    ]
    treatments = [
        (s, s * 100, 2014, 1000, PUMP, "True") for s in (1, 2, 3, 4, 6, 9, 10, 11, 12)
    ] + [
        (1, 99, 2014, 2000, "x|Intra-Aortic Balloon Pump", "True"),  # later second treatment
        (7, 700, 2014, 1000, PUMP + "|removal", "True"),
        (8, 800, 2014, 1000, PUMP, "True"),
        (8, 801, 2014, 1500, PUMP + "|removal", "True"),
        (1, 101, 2014, 1000, "hematology|packed red blood cells", "True"),  # at the index
        (1, 102, 2014, 900, "hematology|platelet concentrate", "True"),  # before only
        (1, 103, 2014, 1200, "pulmonary|mechanical ventilation", "True"),
        (1, 104, 2014, 1300, "renal|dialysis", "True"),
        (2, 201, 2014, 999, "pulmonary|mechanical ventilation", "True"),  # before and after
        (2, 202, 2014, 1200, "pulmonary|mechanical ventilation", "True"),
        (2, 203, 2014, 1100, "hematology|platelet concentrate", "True"),
        (11, 1101, 2014, 1100, "pulmonary|mechanical ventilation|face mask", "True"),
        (11, 1102, 2014, 10, "x|aspirin", "True"),  # drug flags have no time bound
        (11, 1103, 2014, 10, "x|glycoprotein iib/iiia inhibitor", "True"),  # wrong case
        (1, 105, 2014, 10, "x|glycoprotein IIB/IIIA inhibitor", "True"),
    ]
    labs = []
    for s in (1, 2, 10, 11):
        labs += [
            _lab(s, "platelets x 1000", 200, 900),
            _lab(s, "platelets x 1000", 50, 1100),
            _lab(s, "platelets x 1000", 150, 2500),
        ]
    labs += [
        _lab(1, "platelets x 1000", None, 950),
        _lab(9, "platelets x 1000", 99.9, 900),
        _lab(9, "platelets x 1000", 50, 1100),
        _lab(12, "platelets x 1000", 200, 900),
        # nadir 6.5 at 6000; 12 is 4320 minutes earlier, 13 one minute before that
        _lab(1, "Hgb", 13, 1679), _lab(1, "Hgb", 12, 1680), _lab(1, "Hgb", 6.5, 6000), _lab(1, "Hgb", 14, 6001),
        _lab(1, "Hgb", 9.5, 1000),
        _lab(1, "creatinine", 2, 800), _lab(1, "creatinine", 3, 1000), _lab(1, "creatinine", 4.5, 1600),
        _lab(2, "creatinine", 2, 800),  # baseline without a later value
        _lab(11, "creatinine", 2, 1100),  # later value without a baseline
        _lab(2, "Hgb", 10, 900),
        _lab(1, "PT - INR", 1.5, 10), _lab(1, "PT", 15, 10), _lab(1, "troponin - I", 3, 1500), _lab(1, "glucose", 180, 1),
    ]
    return {
        "patient": patients,
        "hospital": [(7, "Midwest")],
        "apachepatientresult": [(1, "IV", 67, 5.5), (1, "IVa", 70, 5.5), (2, "IVa", 50, None), (11, "IV", 9, 2.0)],
        "treatment": treatments,
        "lab": labs,
        "vitalperiodic": [(1, 1000, 120.0, 60.0), (1, 1001, 200.0, 100.0), (2, 500, 90.0, None)],
        "vitalaperiodic": [(1, 1000, 118.0, 62.0), (1, 10, 80.0, 40.0), (11, 1500, 99.0, 50.0)],
        "diagnosis": [
            (1, "x|acute coronary syndrome|anterior wall", 500),
            (1, "x|due to hematuria", 1000),
            (1, "s/p cabg", 1000),  # not strictly before
            (2, "neurologic|hemorrhagic stroke", 1200),
            (2, "x|no previous cabg", 10),
            (2, "cardiovascular|vascular disorders|hypertension", 9999),  # history has no time bound
            (10, "hematology|heparin-induced", 5),
            (11, "dvt", 999),  # before the index: no outcome
        ],
        "pasthistory": [(1, "x/TIA(s)/y"), (1, "x/Diabetes"), (2, None)],
        "admissiondx": [(1, "cabg alone"), (2, "CABG alone"), (11, "Infarction, acute myocardial (MI)")],
        "medication": [(1, "ASPIRIN 81"), (2, "Clopidogrel 75")],
        "infusiondrug": [(2, "Heparin drip"), (1, None)],
    }


@pytest.fixture(scope="module", params=["broadcast", "shuffle"])
def study(request, spark, data, tmp_path_factory):
    """The study with and without broadcast joins."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    if request.param == "shuffle":
        spark.conf.set(name, "-1")
    folder = tmp_path_factory.mktemp("tables")
    for table, rows in data.items():
        spark.createDataFrame(rows, SCHEMAS[table]).write.parquet(f"{folder}/{table}.parquet")
    store = StageStore(spark, str(tmp_path_factory.mktemp("stages")))
    yield clinical.ClinicalStudy(TableSource(spark, path=str(folder)), store)
    spark.conf.set(name, before)


def by_stay(df):
    return {r["icustay_id"]: r.asDict() for r in df.collect()}


def test_subjects(study):
    got = {r["patientunitstayid"]: r for r in study.table("subject_detail").collect()}
    assert len(got) == 12
    one, two = got[1], got[2]
    assert (one["region"], one["apache_iv"], one["icu_los_hours"], one["gender"]) == ("Midwest", 67, 23, 1)
    assert (one["hosp_mort"], one["unit_mort"], two["hosp_mort"], two["unit_mort"]) == (0, 0, 1, 1)
    assert (two["gender"], two["apache_iv"]) == (0, None)


def test_cohort(study):
    stays = sorted(r["icustay_id"] for r in study.table("cohort_stays").collect())
    assert stays == [1, 2, 9, 10, 11, 12]
    rows = [r for r in study.table("cohort").collect() if r["icustay_id"] == 1]
    assert sorted((r["treatmentid"], r["treatmentoffset_hour"]) for r in rows) == [(99, 33.33), (100, 16.67)]
    assert by_stay(study.table("cohort"))[2]["age"] == 91.4


def test_cohort_by_intent(study, spark, tmp_path):
    store = StageStore(spark, str(tmp_path))
    other = clinical.ClinicalStudy(study.source, store, "intent").table("cohort_stays")
    assert sorted(r[0] for r in other.collect()) == [1, 2, 8, 9, 10, 11, 12]
    with pytest.raises(ValueError):
        clinical.ClinicalStudy(study.source, store, "other")


def test_baseline(study):
    got = by_stay(study.table("index_baseline"))
    assert sorted(got) == [1, 2, 10, 11]
    assert (got[1]["treatmentoffset"], got[1]["last_plt"], got[1]["min_plt"], got[1]["dpc"]) == (1000, 200, 50, 0.75)
    assert (got[1]["hosp_los"], got[2]["hosp_los"]) == (5.5, None)


def test_covariates(study):
    got = by_stay(study.table("covariates"))
    one, two, eleven = got[1], got[2], got[11]
    assert (one["last_hgb"], one["min_hgb"], one["hgb_drop"], one["timibleed"]) == (Decimal("9.5"), Decimal("6.5"), 3.0, None)
    assert (one["last_cr"], one["max_cr"], one["cr_rise"], one["arf"]) == (3, Decimal("4.5"), 0.5, 1)
    assert (one["last_ptinr"], one["max_ptinr"], one["last_pt"]) == (Decimal("1.5"), None, 15)
    assert (one["last_troponini"], one["max_troponini"], one["max_troponint"]) == (None, 3, None)
    assert (one["sbp"], one["last_dbp"]) == (120.0, 62.0)
    assert (one["rbc_trans"], one["rbc_time"], one["plt_trans"], one["plt_time"]) == (1, 1000, 0, None)
    assert (one["vent"], one["vent_time"], one["renal_diaysis"], one["diaysis_time"]) == (1, 1200, 1, 1300)
    assert (one["transfusion_ind"], one["transfusion_time"]) == (1, 1000)
    # Baseline creatinine stays without a later value; one haemoglobin is no pair.
    assert (two["last_cr"], two["max_cr"], two["arf"]) == (2, None, None)
    assert (two["last_hgb"], two["hgb_drop"], two["timibleed"]) == (None, None, 3)
    assert (two["vent"], two["vent_time"], two["transfusion_time"]) == (0, None, 1100)
    assert (two["sbp"], two["last_dbp"]) == (90.0, None)
    assert (eleven["last_cr"], eleven["max_cr"], eleven["vent"], eleven["sbp"]) == (None, None, 0, None)


def test_history(study):
    got = by_stay(study.table("history"))
    assert sorted(got) == [1, 2, 11]
    one, two, eleven = got[1], got[2], got[11]
    assert (one["group_plt"], one["group2_plt"], one["nadir"], one["bmi"]) == (4, 2, 4, 20.0)
    assert (two["bmi"], eleven["bmi"]) == (None, None)
    assert (one["hosp_los"], two["hosp_los"], eleven["hosp_los"]) == (5.5, 52.0, 2.0)
    assert [one[c] for c in ("prior_stroketia", "prior_diabete", "prior_hypertension")] == [1, 1, 0]
    assert two["prior_hypertension"] == 1
    assert [r["admind_cabg"] for r in (one, two, eleven)] == [0, 1, 0]
    assert [r["admind_mi"] for r in (one, two, eleven)] == [1, 0, 1]
    assert [r["trombo_outcome"] for r in (one, two, eleven)] == [0, 0, 0]
    assert [r["aspirin_use"] for r in (one, two, eleven)] == [1, 0, 1]
    assert [r["g23i_use"] for r in (one, two, eleven)] == [1, 0, 0]
    assert [r["aggrinhib_use"] for r in (one, two, eleven)] == [0, 1, 0]
    assert [r["heparin_use"] for r in (one, two, eleven)] == [0, 1, 0]


def test_lookback(study):
    got = by_stay(study.table("nadir_lookback"))
    assert sorted(got) == [1]
    row = got[1]
    assert (row["nadir_hgb"], row["min_hgb_time"]) == (Decimal("6.5"), 6000)
    assert (row["max_hgb72"], row["max_hgb71_time"], row["hgb_delta72"]) == (12, 1680, Decimal("5.5"))
    assert (row["max_hgb"], row["max_hgb_time"], row["hgb_delta"]) == (13, 1679, Decimal("6.5"))


def test_study_table(study):
    got = by_stay(study.table("study_table"))
    one, two, eleven = got[1], got[2], got[11]
    assert (one["age_10"], one["apache_iv_10"], one["last_plt_10"], one["min_plt_10"]) == (6.0, 6.0, 20.0, 5.0)
    assert (one["plt_dpc10"], one["last_glu_18"], one["map_bp"]) == (7.5, 10.0, 40.0)
    assert (two["map_bp"], two["apache_iv_10"], two["age_10"]) == (None, None, 9.14)
    assert [r["ethnicity"] for r in (one, two, eleven)] == ["Caucasian", "other", "other"]
    assert [r["ethnicity_group"] for r in (one, two, eleven)] == [1, 0, 0]
    assert [r["major_bleed"] for r in (one, two, eleven)] == [1, 1, 0]
    assert (one["group_plt"], one["delta_admi"], two["ori_hgbdrop"]) == (2, -120, None)


def test_ratios_and_coverage(study):
    rows = study.table("platelet_ratios").collect()
    one = sorted((r["labresultoffseth"], r["plt_ratio"], r["day_offset"]) for r in rows if r["icustay_id"] == 1)
    assert one == [(18.0, 0.25, 1), (41.0, 0.75, 2)]
    assert {r["dpc_group"] for r in rows} == {3}
    got = [tuple(r) for r in study.table("daily_coverage").collect()]
    assert got == [(1, 3), (2, 3)]


def test_attrition_shrinks(study):
    got = [tuple(r) for r in study.table("attrition").orderBy("step").collect()]
    # Stay 9 starts below the limit, 12 has no later reading, 10 is excluded, and
    # only stay 1 has haemoglobin readings after the index.
    assert got == [
        (1, "stays", 12),
        (2, "cohort", 6),
        (3, "platelet_reading", 6),
        (4, "platelet_before_index", 6),
        (5, "baseline", 4),
        (6, "excluded_diagnosis", 1),
        (7, "history", 3),
        (8, "hgb_nadir", 1),
        (9, "hgb_before_nadir", 1),
        (10, "hgb_before_nadir_72h", 1),
    ]


def test_results_survive_a_second_write(spark, data, tmp_path):
    frames = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in data.items()}
    for _ in range(2):
        study = clinical.ClinicalStudy(FrameSource(frames), StageStore(spark, str(tmp_path / "stages")))
        study.write(str(tmp_path / "out"), names=["study_table"])
    assert spark.read.parquet(str(tmp_path / "out" / "study_table")).count() == 3


def test_catalog_tables_in_and_out(spark, data, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS icu_in LOCATION '{tmp_path}/in'")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS icu_out LOCATION '{tmp_path}/out'")
    try:
        for name, rows in data.items():
            spark.createDataFrame(rows, SCHEMAS[name]).write.saveAsTable(f"icu_in.{name}")
        study = clinical.ClinicalStudy(TableSource(spark, schema="icu_in"), StageStore(spark, f"{tmp_path}/stages"))
        for _ in range(2):
            study.write(schema="icu_out", names=["cohort_stays"])
        assert spark.table("icu_out.cohort_stays").count() == 6
        with pytest.raises(ValueError):
            study.write()
        with pytest.raises(ValueError):
            TableSource(spark)
    finally:
        spark.sql("DROP DATABASE icu_in CASCADE")
        spark.sql("DROP DATABASE icu_out CASCADE")


def test_all_results_by_name(spark, data, tmp_path):
    frames = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in data.items()}
    tables = clinical.run_pipeline(FrameSource(frames), StageStore(spark, str(tmp_path)))
    assert list(tables) == list(clinical.RESULTS)
    assert len(tables["covariates"].columns) == 65


class _Conf(dict):
    def get(self, name, default=None):
        return super().get(name, default)


def test_stage_folder_of_a_session():
    class Session:
        conf = _Conf({"spark.checkpoint.dir": "/shared/ckpt/", "spark.master": "yarn"})

    one, two = StageStore.for_session(Session()), StageStore.for_session(Session())
    assert one.folder.startswith("/shared/ckpt/stages-") and one.folder != two.folder
    Session.conf = _Conf({"spark.master": "yarn"})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        StageStore.for_session(Session())
    Session.conf = _Conf({"spark.master": "local[2]"})
    assert StageStore.for_session(Session()).folder


def test_a_local_path_is_refused_on_a_cluster():
    class Session:
        conf = _Conf({"spark.checkpoint.dir": "file:///tmp/x", "spark.master": "spark://a:7077"})

    with pytest.raises(ValueError, match="local path"):
        StageStore.for_session(Session())
    Session.conf["spark.anchorset.sharedFiles"] = "true"
    assert StageStore.for_session(Session(), "run7").folder == "file:///tmp/x/stages-run7"
    Session.conf = _Conf({"spark.checkpoint.dir": "file:///tmp/x", "spark.master": "local-cluster[2,1,1024]"})
    assert StageStore.for_session(Session()).folder.startswith("file:///tmp/x/stages-")


def test_a_named_run_goes_on_where_it_stopped(spark, tmp_path):
    first = StageStore(spark, f"{tmp_path}/run", resume=True)
    assert first.border("a", spark.range(3)).count() == 3
    again = StageStore(spark, f"{tmp_path}/run", resume=True)
    assert again.border("a", spark.range(9)).count() == 3  # completed, so read
    (tmp_path / "run" / "a" / "_SUCCESS").unlink()
    assert again.border("a", spark.range(9)).count() == 9  # broken off, so written anew
    again.remove()
    assert not (tmp_path / "run").exists()


def test_parameters_of_the_study(spark, data, tmp_path):
    frames = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in data.items()}
    source = FrameSource(frames)
    plain = clinical.ClinicalStudy(source, StageStore(spark, f"{tmp_path}/a"))
    other = clinical.ClinicalStudy(
        source, StageStore(spark, f"{tmp_path}/b"), day_origin="index", los_divisor=1440, pressure_weights=(1 / 3, 2 / 3)
    )
    days = [
        sorted((r["icustay_id"], r["labresultoffseth"]) for r in s.table("platelet_ratios").collect())
        for s in (plain, other)
    ]
    # Readings at minutes 1100 and 2500, index at 1000.
    assert days[0][:2] == [(1, 18.0), (1, 41.0)] and days[1][:2] == [(1, 1.0), (1, 25.0)]
    bp = [{r["icustay_id"]: r["map_bp"] for r in s.table("study_table").collect()} for s in (plain, other)]
    assert bp[0][1] != bp[1][1]
    with pytest.raises(ValueError):
        clinical.ClinicalStudy(source, StageStore(spark, f"{tmp_path}/c"), day_origin="birth")


def test_integer_pressures_divide_as_integers(spark):
    from anchorset.functions.scores import weighted_pressure

    df = spark.createDataFrame([(s, 70) for s in (120, 119, -119, 100, None)], "s int, d int")
    got = [r[0] for r in df.select(weighted_pressure("s", "d", 1 / 3, 0.0, whole=True)).collect()]
    assert got == [40.0, 39.0, -39.0, 33.0, None]
    assert df.select(weighted_pressure("s", "d", 1 / 3, 0.0)).first()[0] == 40.0


def test_features_with_several_rows_are_refused(spark):
    from pyspark.sql import functions as F

    from anchorset.operators.features import assemble

    cohort = spark.createDataFrame([(1,), (2,)], "k int")
    good = spark.createDataFrame([(1, "a"), (None, "x"), (None, "y")], "k int, v string")
    assert sorted(map(tuple, assemble(cohort, "k", [good]).collect()), key=str) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="several feature rows"):
        assemble(cohort, "k", [good.withColumn("k", F.lit(1))]).collect()


def test_a_missing_column_is_named(spark, data, tmp_path):
    frames = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in data.items()}
    frames["lab"] = frames["lab"].drop("labresult")
    study = clinical.ClinicalStudy(FrameSource(frames), StageStore(spark, str(tmp_path)))
    with pytest.raises(ValueError, match="lab lacks column.*labresult"):
        study.table("index_baseline")
