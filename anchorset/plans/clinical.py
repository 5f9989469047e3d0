"""The clinical study: from twelve base tables to one wide row per stay.

In one build of all results every base table is scanned once, apart from two: the
treatment table is read for the index and then once for all that follows it, the
laboratory table once for all measures and again for readings whose bounds are
known only after the nadir or the baseline.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.numeric import is_integral, quotient_by_type, round_to, whole_quotient
from ..functions.patterns import any_of, fold_rules
from ..operators import cohort as co
from ..operators import flags as fl
from ..operators import timeline as tl
from ..operators.features import assemble, change, keep_pair
from ..operators.joins import attach_index, on_side, subject_join
from ..sources.stages import StageStore
from . import registry as reg

STAY = "icustay_id"
INDEX_TS = "treatmentoffset"

# Columns of the index table handed on to every later stage.
_BASIC = (
    "age",
    "gender",
    "weight",
    "height",
    "icu_los_hours",
    "icutype",
    "unit_mort",
    "hosp_mort",
    "hosp_los",
)


def _read(source, name: str) -> DataFrame:
    """A base table with the columns the study reads, keyed by ``icustay_id``."""
    df = source.table(name, reg.TABLES[name])
    if "patientunitstayid" in df.columns and name not in ("patient", "apachepatientresult"):
        df = df.withColumnRenamed("patientunitstayid", STAY)
    return df


def subject_detail(source) -> DataFrame:
    """One row per unit stay: demographics, outcome codes, length of stay, and
    ``hosp_los`` for the index table.

    The severity table holds a row per score version; it is reduced to one row
    per stay first, with the score of version IV and a length of stay from
    version IV where that has one."""
    patient = _read(source, "patient")
    region = co.one_per_key(_read(source, "hospital"), "hospitalid", region=F.max("region"))
    version_iv = F.col("apacheversion") == reg.APACHE_VERSION
    score = co.one_per_key(
        _read(source, "apachepatientresult"),
        "patientunitstayid",
        apache_iv=F.max(F.when(version_iv, F.col("apachescore"))),
        hosp_los=F.coalesce(
            F.max(F.when(version_iv, F.col("actualhospitallos"))), F.max("actualhospitallos")
        ),
    )
    derived = {
        "unitadmitoffset": F.lit(0),
        "hosp_mort": scores.recode(
            "hospitaldischargestatus", [(reg.ALIVE, 0), (reg.EXPIRED, 1)]
        ),
        # Alive is read from the unit status, expired from the hospital status.
        "unit_mort": scores.recode_pair(
            [
                ("unitdischargestatus", reg.ALIVE, 0),
                ("hospitaldischargestatus", reg.EXPIRED, 1),
            ]
        ),
        # "male" is part of "female", so the order of the cases matters.
        "gender": scores.recode("gender", [(reg.FEMALE, 0), (reg.MALE, 1)]),
        "icu_los_hours": whole_quotient("unitdischargeoffset", 60),
    }
    out = co.subject_detail(
        patient, [(region, "hospitalid")], derived, [(score, "patientunitstayid")]
    )
    return out.select(
        "uniquepid",
        "patienthealthsystemstayid",
        "patientunitstayid",
        "unitvisitnumber",
        "hospitalid",
        "region",
        "unittype",
        "apacheadmissiondx",
        "hospitaladmitoffset",
        "hospitaldischargeoffset",
        "unitadmitoffset",
        "unitdischargeoffset",
        "apache_iv",
        "hospitaladmityear",
        "unitadmityear",
        "age",
        "hosp_mort",
        "unit_mort",
        "gender",
        "ethnicity",
        "admissionheight",
        "admissionweight",
        "dischargeweight",
        "icu_los_hours",
        "hosp_los",
    )


def treated_stays(source, subjects: DataFrame) -> DataFrame:
    """Index treatments of adults in the first unit stay of a hospital stay."""
    stays = subjects.withColumnRenamed("patientunitstayid", STAY)
    first = co.first_per(
        stays,
        ["uniquepid", "patienthealthsystemstayid"],
        ["unitvisitnumber", STAY],
    )
    adults = first.select(
        "uniquepid",
        F.col("patienthealthsystemstayid").alias("hadmid"),
        STAY,
        scores.numeric_age("age", reg.CAPPED_AGE).cast("double").alias("age"),
        "gender",
        F.col("unittype").alias("icutype"),
        "apache_iv",
        "admissionweight",
        "admissionheight",
        "dischargeweight",
        "icu_los_hours",
        "unit_mort",
        "hosp_mort",
        "hospitaladmitoffset",
        "hospitaldischargeoffset",
        "unitdischargeoffset",
        "ethnicity",
        "hosp_los",
    )
    treatments = _read(source, "treatment").withColumnRenamed("activeupondischarge", "active")
    treated = co.select_cohort(
        treatments, adults, STAY, "treatmentstring", reg.INDEX_TREATMENT, "age", reg.MIN_AGE
    )
    return treated.withColumn("treatmentoffset_hour", round_to(F.col(INDEX_TS) / 60, 2))


def intended_cohort(treated: DataFrame) -> DataFrame:
    """Treated stays by the stated intent of the removal rule: stays with two
    text variants, and stays with one that is no removal."""
    removed = reg.INDEX_REMOVAL.matches("treatmentstring")
    found = co.variants_and_removal(treated, STAY, "treatmentstring", removed)
    listed = found.filter("n_variants = 2 or (n_variants = 1 and not removed)").select(STAY)
    return subject_join(treated, listed, STAY, "left_semi")


def cohort_view(treated: DataFrame, index: DataFrame) -> DataFrame:
    """All index treatments of the stays in the index table."""
    kept = subject_join(treated, index.select(STAY), STAY, "left_semi")
    return kept.withColumn("first_icu", F.lit(1)).select(
        "uniquepid",
        "hadmid",
        STAY,
        "age",
        "gender",
        "icutype",
        "apache_iv",
        "admissionweight",
        "admissionheight",
        "dischargeweight",
        "icu_los_hours",
        "treatmentid",
        "treatmentyear",
        INDEX_TS,
        "treatmentoffset_hour",
        "treatmentstring",
        "active",
        "first_icu",
        "unit_mort",
        "hosp_mort",
        "hospitaldischargeoffset",
        "unitdischargeoffset",
    )


def index_table(treated: DataFrame, skip_removed: bool) -> DataFrame:
    """First index treatment of each stay, with the stay's attributes.

    ``skip_removed`` leaves out stays with any removal text.
    """
    named = treated.select(
        STAY,
        "age",
        "gender",
        F.col("admissionweight").alias("weight"),
        F.col("admissionheight").alias("height"),
        "icu_los_hours",
        "icutype",
        "unit_mort",
        "hosp_mort",
        "apache_iv",
        "ethnicity",
        "hospitaladmitoffset",
        "hospitaldischargeoffset",
        "hosp_los",
        INDEX_TS,
        "treatmentid",
        "treatmentstring",
    )
    carry = [c for c in named.columns if c not in (STAY, INDEX_TS, "treatmentid", "treatmentstring")]
    removed = reg.INDEX_REMOVAL.matches("treatmentstring") if skip_removed else None
    return tl.index_event(named, STAY, INDEX_TS, "treatmentid", carry, removed)


def lab_rows(source, measure: str) -> DataFrame:
    """Readings of one measure."""
    return co.match_rule(_read(source, "lab"), "labname", reg.LABS[measure])


def lab_profile(source, index: DataFrame) -> DataFrame:
    """Baseline, lowest and highest value of all laboratory measures."""
    return tl.measure_profile(
        _read(source, "lab"),
        index,
        STAY,
        "labresultoffset",
        "labresult",
        INDEX_TS,
        "labresult",
        "labname",
        reg.LABS,
    )


def diagnosis_flags(source, index: DataFrame) -> DataFrame:
    """All diagnosis flags of the stays with any, from one scan."""
    rows = fl.timed_flag_rows(
        _read(source, "diagnosis"),
        index,
        STAY,
        "diagnosisoffset",
        INDEX_TS,
        "diagnosisstring",
        reg.DIAGNOSES,
    )
    return fl.pivot_flags([rows], STAY, list(reg.DIAGNOSES))


_OTHER_RULES = {
    "pasthistory": ("pasthistorypath", reg.PAST_HISTORY),
    "admissiondx": ("admitdxpath", reg.ADMISSION),
    "medication": ("drugname", reg.MEDICATION_DRUGS),
    "infusiondrug": ("drugname", reg.INFUSION_DRUGS),
}


def other_flags(source, index: DataFrame) -> DataFrame:
    """All flags without a time bound from four tables: one scan of each, and
    one aggregate for all of them."""
    rows = [
        fl.flag_rows(_read(source, name), STAY, text, rules, index)
        for name, (text, rules) in _OTHER_RULES.items()
    ]
    names = dict.fromkeys(n for _, rules in _OTHER_RULES.values() for n in rules)
    return fl.pivot_flags(rows, STAY, list(names))


def combined_flags(wide: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """The stays with all flags: 1 where any table has it, else 0."""
    held: dict[str, list] = {}
    for i, table in enumerate(tables):
        names = [c for c in table.columns if c != STAY and c in _FLAGS]
        wide = assemble(wide, STAY, [table.select(STAY, *[F.col(n).alias(f"_{i}_{n}") for n in names])], True)
        for n in names:
            held.setdefault(n, []).append(f"_{i}_{n}")
    known = {n: [F.coalesce(F.col(c), F.lit(0)) for c in cols] for n, cols in held.items()}
    wide = wide.withColumns({n: F.greatest(*c) if len(c) > 1 else c[0] for n, c in known.items()})
    return wide.drop(*[c for cols in held.values() for c in cols])


_FLAGS = (*reg.HISTORY_FLAGS, "witness_bleed", "hemo_stroke")


def index_baseline(index: DataFrame, profile: DataFrame) -> DataFrame:
    """Stays with a platelet baseline of at least the limit and a later nadir."""
    pair = tl.pivot_profile(
        profile, STAY, {n: reg.LAB_COLUMNS[n] for n in ("last_plt", "min_plt")}
    )
    pair = co.baseline_at_least(pair, "last_plt", reg.MIN_BASELINE)
    pair = pair.filter(F.col("min_plt").isNotNull())
    return index.join(pair, STAY).withColumn("dpc", change("last_plt", "min_plt", "relative_drop"))


def baseline_view(baseline: DataFrame) -> DataFrame:
    return baseline.select(STAY, *_BASIC, INDEX_TS, "last_plt", "min_plt", "dpc")


def pressures(source, index: DataFrame) -> DataFrame:
    """Last systolic and diastolic pressure at or before the index, from the
    periodic and the aperiodic table in one pass each."""
    stay, at = F.col(STAY), F.col("observationoffset")
    periodic = _read(source, "vitalperiodic").select(
        stay, at, F.col("systemicsystolic").alias("sbp"), F.col("systemicdiastolic").alias("dbp")
    )
    aperiodic = _read(source, "vitalaperiodic").select(
        stay, at, F.col("noninvasivesystolic").alias("sbp"), F.col("noninvasivediastolic").alias("dbp")
    )
    both = periodic.unionByName(aperiodic)
    both = both.filter(any_of([F.col("sbp").isNotNull(), F.col("dbp").isNotNull()]))
    seen = attach_index(both, index, STAY, INDEX_TS)
    seen = seen.filter(on_side("observationoffset", INDEX_TS, "until"))

    def last(name: str):
        order = F.when(F.col(name).isNotNull(), F.struct("observationoffset", name))
        return F.max_by(name, order)

    return seen.groupBy(STAY).agg(last("sbp").alias("sbp"), last("dbp").alias("last_dbp"))


def later_treatments(source, index: DataFrame) -> DataFrame:
    """From one scan of the treatments: first transfusion, ventilation and
    dialysis at or after the index, and drug flags at any time."""
    treatment = _read(source, "treatment").select(
        STAY, F.col(INDEX_TS).alias("event_offset"), "treatmentstring"
    )
    rows, hits = fold_rules(treatment, "treatmentstring", {**reg.ONSETS, **reg.TREATMENT_DRUGS})
    onsets, drugs = ({n: hits[n] for n in rules} for rules in (reg.ONSETS, reg.TREATMENT_DRUGS))
    return tl.onset_times(rows, index, STAY, "event_offset", INDEX_TS, onsets, reg.NEW_ONSETS, drugs)


def population(baseline: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Stays with a baseline and without the excluding diagnosis, with what the
    look-back and the ratio series need of them."""
    excluded = diagnoses.filter(F.col("excluding_diagnosis") == 1)
    return co.exclude(baseline, excluded, STAY, unique=True).select(
        STAY, INDEX_TS, "last_plt", F.col("dpc").alias("plt_dpc")
    )


def covariates(
    baseline: DataFrame, profile: DataFrame, treatments: DataFrame, vitals: DataFrame, diagnoses: DataFrame
) -> DataFrame:
    """About sixty covariates around the index, one row per stay."""
    columns = {n: s for n, s in reg.LAB_COLUMNS.items() if n not in ("last_plt", "min_plt")}
    stroke = diagnoses.select(STAY, F.col("hemo_stroke").alias("_stroke"))
    onsets = treatments.select(STAY, *reg.ONSETS)
    wide = assemble(
        baseline.withColumnRenamed("dpc", "plt_dpc"),
        STAY,
        [tl.pivot_profile(profile, STAY, columns), onsets, vitals, stroke],
        unique=True,
    )
    # A haemoglobin pair needs both values, a creatinine pair only its baseline.
    wide = keep_pair(wide, "last_hgb", "min_hgb", "both")
    wide = keep_pair(wide, "last_cr", "max_cr", "base")
    wide = wide.withColumns(
        {
            "hgb_drop": change("last_hgb", "min_hgb", "absolute_drop"),
            "cr_rise": change("last_cr", "max_cr", "relative_rise"),
            **{
                flag: F.col(time).isNotNull().cast("int")
                for flag, time in reg.ONSET_FLAGS.items()
            },
        }
    )
    return wide.withColumns(
        {
            "timibleed": scores.bleed_grade("hgb_drop", "_stroke"),
            "arf": scores.threshold_flag("cr_rise", reg.RISE_LIMIT),
            "transfusion_ind": scores.any_flag("rbc_trans", "plt_trans"),
            "transfusion_time": scores.earliest_time(
                ("rbc_trans", "rbc_time"), ("plt_trans", "plt_time")
            ),
        }
    ).drop("_stroke")


_COVARIATES = (
    "last_plt",
    "min_plt",
    "plt_dpc",
    "last_hgb",
    "min_hgb",
    "hgb_drop",
    *[n for n in reg.LAB_COLUMNS if n not in (
        "last_plt", "min_plt", "last_hgb", "min_hgb", "last_cr", "max_cr", "total_cholesterol"
    )],
    "sbp",
    "last_dbp",
    "total_cholesterol",
    "timibleed",
    "last_cr",
    "max_cr",
    "cr_rise",
    "arf",
    "rbc_trans",
    "rbc_time",
    "plt_trans",
    "plt_time",
    "vent",
    "vent_time",
    "renal_diaysis",
    "diaysis_time",
    "transfusion_ind",
    "transfusion_time",
)


def covariates_view(wide: DataFrame) -> DataFrame:
    return wide.select(STAY, *_BASIC, INDEX_TS, *_COVARIATES)


def history(
    wide: DataFrame, kept: DataFrame, flags: list[DataFrame], los_divisor: int = 60
) -> DataFrame:
    """Covariates plus bands, body mass index and thirty history, admission and
    drug flags, of the stays kept. ``los_divisor`` turns minutes into the unit
    of a length of stay that the severity table lacks."""
    kept = combined_flags(wide.join(kept.select(STAY), STAY, "left_semi"), flags)
    stay_minutes = F.col("hospitaldischargeoffset") - F.col("hospitaladmitoffset")
    return (
        kept.withColumn("_stay_minutes", stay_minutes)
        .withColumns(
            {
                # Minutes over 60 by default, while the column itself comes in
                # the unit of the severity table; kept as published.
                "hosp_los": F.coalesce(
                    F.col("hosp_los").cast("double"),
                    whole_quotient("_stay_minutes", los_divisor).cast("double"),
                ),
                "group_plt": scores.bands("plt_dpc", reg.DROP_EDGES, "left", default=0),
                "group2_plt": scores.bands("plt_dpc", reg.DROP_EDGE_2, "left", default=0),
                "nadir": scores.bands(
                    "min_plt", reg.NADIR_EDGES, "right", reg.NADIR_LABELS, default=0
                ),
                "bmi": scores.body_mass_index("weight", "height"),
            }
        )
        .drop("_stay_minutes")
    )


def history_view(hist: DataFrame) -> DataFrame:
    basic = ["age", "gender", "apache_iv", *_BASIC[2:]]
    bands = ["group_plt", "group2_plt", "nadir", "bmi"]
    return hist.select(STAY, *basic, INDEX_TS, *_COVARIATES, *bands, *reg.HISTORY_FLAGS)


def nadir_lookback(source, kept: DataFrame, profile: DataFrame) -> DataFrame:
    """Haemoglobin nadir after the index and the highest values before it."""
    nadir = (
        profile.filter((F.col("measure") == "hgb") & F.col("min_value").isNotNull())
        .select(STAY, F.col("min_value").alias("nadir_hgb"), F.col("min_ts").alias("min_hgb_time"))
        .join(kept.select(STAY), STAY, "left_semi")
    )
    readings = lab_rows(source, "hgb")
    prior = tl.prior_window_extreme(
        readings, nadir, STAY, "labresultoffset", "labresult", "min_hgb_time", reg.LOOKBACK_MINUTES
    )
    return nadir.join(prior, STAY, "left").select(
        STAY,
        "nadir_hgb",
        F.col("max_window").alias("max_hgb72"),
        F.col("max_prior").alias("max_hgb"),
        (F.col("max_prior") - F.col("nadir_hgb")).alias("hgb_delta"),
        (F.col("max_window") - F.col("nadir_hgb")).alias("hgb_delta72"),
        "min_hgb_time",
        F.col("max_window_ts").alias("max_hgb71_time"),
        F.col("max_prior_ts").alias("max_hgb_time"),
    )


def study_table(
    hist: DataFrame, lookback: DataFrame, pressure_weights: tuple[float, float] = reg.PRESSURE_WEIGHTS
) -> DataFrame:
    """The final wide table, one row per stay. The mean pressure follows the
    type of its columns, as a division by a whole number does: shares of integer
    pressures are cut to whole numbers."""
    wide = hist.join(lookback, STAY, "left")
    ethnicity = F.col("ethnicity")
    other = reg.OTHER_ETHNICITY.matches("ethnicity") | (ethnicity == "")
    wide = wide.withColumn("ethnicity", F.when(other, F.lit("other")).otherwise(ethnicity))
    wide = wide.withColumns(
        {
            "age_10": scores.scaled("age", 10),
            "apache_iv_10": round_to(quotient_by_type(wide, "apache_iv", 10), 3),
            "ethnicity_group": (F.lower("ethnicity") == reg.REFERENCE_ETHNICITY).cast("int"),
            "last_plt_10": scores.scaled("last_plt", 10),
            "min_plt_10": scores.scaled("min_plt", 10),
            "plt_dpc10": F.col("plt_dpc") * 10,
            "last_glu_18": scores.scaled("last_glu", reg.GLUCOSE_DIVISOR),
            "major_bleed": scores.severe_event(
                "hgb_delta72", "witness_bleed", "hemo_stroke", "rbc_trans"
            ),
            "map_bp": scores.weighted_pressure(
                "sbp", "last_dbp", *pressure_weights, whole=is_integral(wide, "sbp")
            ),
        }
    ).withColumn("ethnicity_group", F.coalesce("ethnicity_group", F.lit(0)))
    return wide.select(
        STAY,
        "age",
        "age_10",
        "gender",
        "apache_iv",
        "apache_iv_10",
        "icu_los_hours",
        "icutype",
        "unit_mort",
        "hosp_mort",
        "hosp_los",
        "ethnicity",
        "ethnicity_group",
        F.col("hospitaladmitoffset").alias("delta_admi"),
        INDEX_TS,
        "last_plt",
        "last_plt_10",
        "min_plt",
        "min_plt_10",
        "plt_dpc",
        "plt_dpc10",
        "last_hgb",
        F.col("min_hgb").alias("ori_minhgb"),
        F.col("hgb_drop").alias("ori_hgbdrop"),
        "hgb_delta72",
        "major_bleed",
        "last_wbc",
        "max_wbc",
        "last_ptinr",
        "max_ptinr",
        "last_pt",
        "max_pt",
        "last_glu",
        "last_glu_18",
        "sbp",
        "last_dbp",
        "map_bp",
        "last_cr",
        "max_cr",
        "cr_rise",
        "arf",
        "rbc_trans",
        "plt_trans",
        "vent",
        "renal_diaysis",
        "transfusion_ind",
        F.col("group2_plt").alias("group_plt"),
        "nadir",
        "bmi",
        *reg.HISTORY_FLAGS,
    )


def platelet_ratios(source, kept: DataFrame, day_origin: str = "admission") -> DataFrame:
    """Every platelet reading from the index on, over its baseline, with hours
    and days counted from unit admission or from the index."""
    series = tl.ratio_series(
        lab_rows(source, "platelet").select(STAY, "labresultoffset", "labresult"),
        kept,
        STAY,
        "labresultoffset",
        "labresult",
        INDEX_TS,
        "last_plt",
        ["plt_dpc"],
    )
    if day_origin == "index":
        series = series.withColumn("labresultoffset", F.col("labresultoffset") - F.col(INDEX_TS))
    hours = whole_quotient("labresultoffset", 60)
    return series.select(
        STAY,
        "plt_dpc",
        scores.bands("plt_dpc", reg.DROP_EDGES_CAPPED, "right", open_top=False).alias("dpc_group"),
        round_to(F.col("labresult").cast("double") / F.col("last_plt").cast("double"), 3).alias("plt_ratio"),
        hours.cast("double").alias("labresultoffseth"),
        round_to(hours / 24, 5).alias("labresultoffset_day"),
        F.ceil(hours / 24).alias("day_offset"),
    )


FEATURES = {
    "lab_profile": lab_profile,
    "treatments": later_treatments,
    "pressures": pressures,
    "diagnoses": diagnosis_flags,
    "other_flags": other_flags,
}


class ClinicalStudy:
    """The stages in dependency order. A stage is built when it is first asked
    for, and only with the stages it needs. Stages that several others read are
    stage borders of the store.

    ``removal`` decides on stays with a removal text among their index
    treatments. ``literal`` drops every such stay, which is what the published
    definition computes; ``intent`` follows its comments (``intended_cohort``).
    ``day_origin`` counts the days of the ratio series from unit ``admission``
    or from the ``index``; ``los_divisor`` and ``pressure_weights`` are described
    at ``history`` and ``study_table``. Defaults are as published. With
    ``buckets``, the baseline and the features are stored in as many buckets by
    stay, so that the wide tables are put together without a shuffle where they
    are too large to be broadcast.
    """

    def __init__(
        self,
        source,
        store: StageStore,
        removal: str = "literal",
        day_origin: str = "admission",
        los_divisor: int = 60,
        pressure_weights: tuple[float, float] = reg.PRESSURE_WEIGHTS,
        buckets: int = 0,
    ):
        if removal not in ("literal", "intent"):
            raise ValueError("removal must be 'literal' or 'intent'")
        if day_origin not in ("admission", "index"):
            raise ValueError("day_origin must be 'admission' or 'index'")
        self.source, self.store, self.removal = source, store, removal
        self.day_origin, self.los_divisor, self.pressure_weights = day_origin, los_divisor, pressure_weights
        self.buckets = buckets
        self._features: dict[str, DataFrame] = {}

    @cached_property
    def subjects(self) -> DataFrame:
        return self.store.border("subjects", subject_detail(self.source))

    @cached_property
    def treated(self) -> DataFrame:
        return self.store.border("treated", treated_stays(self.source, self.subjects))

    @cached_property
    def index(self) -> DataFrame:
        treated = self.treated if self.removal == "literal" else intended_cohort(self.treated)
        return self.store.border("index", index_table(treated, self.removal == "literal"), removal=self.removal)

    def features(self, *names: str) -> list[DataFrame]:
        """Feature tables keyed by the stay; those not built yet are written
        together."""
        missing = [n for n in names if n not in self._features]
        if missing:
            index = self.index
            plans = {n: FEATURES[n](self.source, index) for n in missing}
            self._features.update(self.store.borders(plans, STAY, self.buckets))
        return [self._features[n] for n in names]

    @property
    def profile(self) -> DataFrame:
        return self.features("lab_profile")[0]

    @property
    def diagnoses(self) -> DataFrame:
        return self.features("diagnoses")[0]

    @cached_property
    def baseline(self) -> DataFrame:
        baseline = index_baseline(self.index, self.profile)
        if self.buckets:
            return self.store.bucketed("baseline", baseline, STAY, self.buckets)
        return self.store.border("baseline", baseline)

    @cached_property
    def population(self) -> DataFrame:
        self.features("lab_profile", "diagnoses")
        return self.store.border("population", population(self.baseline, self.diagnoses))

    @cached_property
    def wide(self) -> DataFrame:
        tables = self.features(*FEATURES)[:-1]
        return covariates(self.baseline, *tables)

    @cached_property
    def hist(self) -> DataFrame:
        tables = self.features(*FEATURES)
        flags = [tables[list(FEATURES).index(n)] for n in ("diagnoses", "other_flags", "treatments")]
        wide = history(self.wide, self.population, flags, self.los_divisor)
        return self.store.border("history", wide, los_divisor=self.los_divisor)

    @cached_property
    def lookback(self) -> DataFrame:
        return self.store.border("lookback", nadir_lookback(self.source, self.population, self.profile))

    @cached_property
    def ratios(self) -> DataFrame:
        series = platelet_ratios(self.source, self.population, self.day_origin)
        return self.store.border("ratios", series, day_origin=self.day_origin)

    def table(self, name: str) -> DataFrame:
        """A result table by name; see ``RESULTS``."""
        return RESULTS[name](self)

    def write(self, folder: str | None = None, schema: str | None = None, names=None) -> None:
        """Write result tables, overwriting earlier ones: as Parquet below a
        folder, or as tables of a catalog schema."""
        if (folder is None) == (schema is None):
            raise ValueError("give either folder or schema")
        for name in names or RESULTS:
            writer = self.table(name).write.mode("overwrite")
            if folder is not None:
                writer.parquet(f"{folder.rstrip('/')}/{name}")
            else:
                writer.saveAsTable(f"{schema}.{name}")


def attrition_stages(study: ClinicalStudy) -> dict[str, DataFrame]:
    """The stays left, or set apart, at each step that has a published count."""
    platelets = study.profile.filter(F.col("measure") == "platelet")
    excluded = study.diagnoses.filter(F.col("excluding_diagnosis") == 1)
    lookback = study.lookback
    return {
        "stays": study.subjects.withColumnRenamed("patientunitstayid", STAY),
        "cohort": study.index,
        "platelet_reading": platelets,
        "platelet_before_index": platelets.filter(F.col("last_value").isNotNull()),
        "baseline": study.baseline,
        "excluded_diagnosis": study.baseline.join(excluded.select(STAY), STAY, "left_semi"),
        "history": study.population,
        "hgb_nadir": lookback,
        "hgb_before_nadir": lookback.filter(F.col("max_hgb").isNotNull()),
        "hgb_before_nadir_72h": lookback.filter(F.col("max_hgb72").isNotNull()),
    }


RESULTS = {
    "subject_detail": lambda s: s.subjects.drop("hosp_los"),
    "cohort": lambda s: cohort_view(s.treated, s.index),
    "cohort_stays": lambda s: s.index.select(STAY),
    "index_baseline": lambda s: baseline_view(s.baseline),
    "covariates": lambda s: covariates_view(s.wide),
    "history": lambda s: history_view(s.hist),
    "nadir_lookback": lambda s: s.lookback,
    "study_table": lambda s: study_table(s.hist, s.lookback, s.pressure_weights),
    "platelet_ratios": lambda s: s.ratios,
    "daily_coverage": lambda s: tl.daily_coverage(s.ratios, STAY, "day_offset"),
    "attrition": lambda s: co.attrition(attrition_stages(s), STAY),
}


def run_pipeline(source, store: StageStore, removal: str = "literal") -> dict[str, DataFrame]:
    """All result tables of the study by name."""
    study = ClinicalStudy(source, store, removal)
    return {name: study.table(name) for name in RESULTS}
