"""Tables of the source that keeps timestamps and separates visits from stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitewise.functions.scalar import age_years, days_between, flag, hour_ceil_59, hours_between, micros
from sitewise.operators import timeseries as T
from sitewise.operators.cohort import capped_days, code_flags, excluded, first_limited
from sitewise.operators.joins import interval_join
from sitewise.operators.ranking import is_first
from sitewise.operators.timeseries import Measure
from sitewise.plans.vocabulary import (
    CODE_STATUS_IGNORED,
    CODE_STATUS_ITEMS,
    EXCLUSIONS,
    HEART_RATE_ITEMS,
    TIMESTAMP_CODE_WORDS,
    TIMESTAMP_ETHNICITY,
)
from sitewise.session import durable

KEY = "icustay_id"
VISIT = "hadm_id"
HOUR_MICROS = 3_600_000_000

_STAY_TABLES = {"heartrate": "heartrate", "sysbp": "sysbp", "diasbp": "diasbp", "meanbp": "meanbp", "resprate": "resprate", "tempc": "tempc", "spo2": "spo2"}
_GAS = {"bg_pao2": "po2", "bg_paco2": "pco2", "bg_pao2fio2ratio": "pao2fio2ratio", "bg_ph": "ph", "bg_baseexcess": "baseexcess", "bg_totalco2": "totalco2", "calcium": "calcium"}
_LAB = {"albumin": "albumin", "bands": "bands", "bilirubin": "bilirubin", "bun": "bun", "creatinine": "creatinine", "inr": "inr", "platelet": "platelet", "wbc": "wbc"}
_LAB_THEN_GAS = ("bicarbonate", "hematocrit", "hemoglobin", "lactate", "potassium", "sodium")
MEASURES = (
    *(Measure(name, (("vital", c),)) for name, c in _STAY_TABLES.items()),
    Measure("glucose", (("lab", "glucose"), ("bg", "glucose"), ("vital", "glucose"))),
    Measure("gcs", (("gcs", "gcs"),), "ceil_avg"),
    *(Measure(name, (("bg", c),)) for name, c in _GAS.items()),
    *(Measure(name, (("lab", c),)) for name, c in _LAB.items()),
    *(Measure(name, (("lab", name), ("bg", name))) for name in _LAB_THEN_GAS),
    Measure("urineoutput", (("uo", "urineoutput"),), "sum"),
)


def signal_times(chartevents: DataFrame, icustays: DataFrame) -> DataFrame:
    """First and last heart rate within 12 hours of the recorded stay, rounded to the hour."""
    beats = chartevents.filter(F.col("itemid").isin(*HEART_RATE_ITEMS)).select(KEY, "charttime")
    span = icustays.select(
        KEY,
        (F.col("intime") - F.expr("INTERVAL 12 HOURS")).alias("_from"),
        (F.col("outtime") + F.expr("INTERVAL 12 HOURS")).alias("_to"),
    )
    # stays last days: most touch one chunk of a month and are not repeated
    near = interval_join(beats, span, [KEY], "charttime", "_from", "_to", chunk=32 * 24 * HOUR_MICROS)
    return near.groupBy(KEY).agg(
        hour_ceil_59(F.min("charttime")).alias("first_hour"), hour_ceil_59(F.max("charttime")).alias("last_hour")
    )


def cohort(icustays: DataFrame, admissions: DataFrame, patients: DataFrame, chartevents: DataFrame, kept_only: bool = False) -> DataFrame:
    """Stays with signal-based start and end, outcomes and exclusion flags; the site is the record system.

    With ``kept_only`` only the stays that no flag excludes: later stays of a person and those without recorded times, most of all,
    are left out before the joins.
    """
    ranked = is_first(icustays, ["subject_id"], ["intime"], KEY, "first_stay")
    if kept_only:
        ranked = ranked.filter("first_stay = 1 and intime is not null and outtime is not null")
    joined = (
        ranked.join(admissions, VISIT)
        .join(patients.select("subject_id", "dob", "gender"), "subject_id")
        .join(signal_times(chartevents, ranked if kept_only else icustays), KEY, "inner" if kept_only else "left")
        .withColumn("years", age_years(F.col("admittime").cast("date"), F.col("dob").cast("date")))
    )
    unusable = (
        (F.col("has_chartevents_data") == 0)
        | F.col("intime").isNull()
        | F.col("outtime").isNull()
        | F.col("first_hour").isNull()
        | F.col("last_hour").isNull()
    )
    text = F.lower("diagnosis")
    donor = (text.contains("organ donor") | text.contains("donor account")) & F.col("deathtime").isNotNull()
    short = hours_between("last_hour", "first_hour") <= 4
    stays = joined.select(
        "subject_id",
        VISIT,
        KEY,
        flag(F.col("dbsource") == "metavision").alias("hospitalid"),
        F.col("first_hour").alias("intime"),
        F.col("last_hour").alias("outtime"),
        F.col("years").alias("age"),
        "gender",
        "ethnicity",
        "hospital_expire_flag",
        F.col("los").alias("icu_los"),
        days_between("dischtime", "admittime").alias("hosp_los"),
        F.ceil(hours_between("deathtime", "first_hour")).alias("deathtime_hours"),
        flag(F.col("years") <= 16).alias("exclusion_non_adult"),
        flag(unusable).alias("exclusion_bad_data"),
        flag(donor).alias("exclusion_organ_donor"),
        flag((F.col("first_stay") != 1) | short).alias("exclusion_by_apache"),
    ).withColumn("excluded", excluded(EXCLUSIONS))
    return stays.filter("excluded = 0") if kept_only else stays


def code_status(icustays: DataFrame, chartevents: DataFrame) -> DataFrame:
    """Code-status flags per (stay, time) from rows not marked as errors; one empty row for other stays."""
    items = chartevents.filter(
        F.col("itemid").isin(*CODE_STATUS_ITEMS)
        & F.col("value").isNotNull()
        & (F.col("value") != CODE_STATUS_IGNORED)
        & ~F.col("error").eqNullSafe(F.lit(1))
    )
    flags = code_flags(items, [KEY, "charttime"], "value", TIMESTAMP_CODE_WORDS, unknown_is_null=False)
    return icustays.select(KEY).join(flags, KEY, "left")


def surgical(icustays: DataFrame, services: DataFrame) -> DataFrame:
    """1 where a service that began before the end of the first day is surgical.

    Only the first surgical service of a visit can decide that: one row per visit is joined.
    """
    name = F.col("curr_service")
    surgery = services.filter(F.lower(name).contains("surg") | (name == "ORTHO"))
    first = surgery.groupBy(VISIT).agg(F.min("transfertime").alias("_first"))
    early = F.col("_first") < F.col("intime") + F.expr("INTERVAL 1 DAY")
    return icustays.join(first, VISIT, "left").select(KEY, flag(early).alias("surgical"))


def static_features(
    stays: DataFrame,
    icustays: DataFrame,
    admissions: DataFrame,
    patients: DataFrame,
    codes: DataFrame,
    services: DataFrame,
    ventdurations: DataFrame,
) -> DataFrame:
    """Outcomes, time limits and demographics per stay."""
    censor = first_limited(codes, KEY, "charttime", ("cmo", "dnr", "dni", "dncpr"), "censortime")
    vent = capped_days(ventdurations, KEY, "duration_hours", 30, "vent")
    visits = admissions.select(VISIT, "deathtime", "admission_type", F.col("ethnicity").alias("group"))
    people = patients.select("subject_id", "dob", F.col("gender").alias("sex"))
    joined = (
        stays.join(icustays.select(KEY), KEY, "left_semi")
        .join(visits, VISIT)
        .join(people, "subject_id")
        .join(censor, KEY, "left")
        .join(surgical(icustays, services), KEY, "left")
        .join(vent, KEY, "left")
    )
    years = age_years(F.col("intime").cast("date"), F.col("dob").cast("date"))
    elective = (F.col("admission_type") == "ELECTIVE") & (F.col("surgical") == 1)
    return joined.select(
        KEY,
        F.lit(0).alias("hospitalid"),
        F.ceil(hours_between("outtime", "intime")).alias("dischtime_hours"),
        F.ceil(hours_between("deathtime", "intime")).alias("deathtime_hours"),
        F.when(F.col("deathtime").isNull(), 0).otherwise(1).alias("death"),
        F.coalesce("vent", F.lit(0)).alias("ventdays"),
        F.ceil(hours_between("censortime", "intime")).alias("censortime_hours"),
        flag(F.col("sex") == "F").alias("is_female"),
        F.least(years, F.lit(90.0)).alias("age"),
        *[flag(F.col("group").isin(*words)).alias(name) for name, words in TIMESTAMP_ETHNICITY.items()],
        flag(elective).alias("electivesurgery"),
    )


def hour_spans(stays: DataFrame, unit: int = HOUR_MICROS, windows: DataFrame | None = None, look_back: int = 0) -> DataFrame:
    """Hours of the stays kept as one row per stay, with the visit of each; with windows only their hours."""
    kept = stays.filter("excluded = 0").withColumns({"_t0": micros("intime"), "_t1": micros("outtime")})
    if windows is None:
        return T.hour_spans(kept, KEY, "_t0", "_t1", unit, keep=[VISIT])
    kept = kept.join(windows.select(KEY, "windowtime_hours"), KEY)
    return T.hour_spans(kept, KEY, "_t0", "_t1", unit, keep=[VISIT], window="windowtime_hours", look_back=look_back)


def hours(stays: DataFrame, unit: int = HOUR_MICROS, windows: DataFrame | None = None, look_back: int = 0) -> DataFrame:
    """Hour grid of the stays kept, with the visit of each stay; with windows only their hours."""
    return T.hours_of(hour_spans(stays, unit, windows, look_back), KEY, [VISIT])


def given_hours(stays: DataFrame, icustay_hours: DataFrame, unit: int = HOUR_MICROS) -> DataFrame:
    """Grid from an existing table of hours (stay, hr, endtime on the whole hour)."""
    slot = T.slot_of(micros("endtime"), unit)
    return stays.filter("excluded = 0").select(KEY, VISIT).join(icustay_hours.select(KEY, "hr", slot.alias("slot")), KEY)


def hourly(
    grid: DataFrame,
    vital: DataFrame,
    gcs: DataFrame,
    uo: DataFrame,
    bg: DataFrame,
    lab: DataFrame,
    unit: int = HOUR_MICROS,
    sum_mode: str = "faithful",
    spans: DataFrame | None = None,
) -> DataFrame:
    """Hourly data table; blood gas and laboratory rows belong to visits and serve all their stays."""
    slot = T.slot_of(micros("charttime"), unit).alias("slot")
    sources = {"vital": vital, "gcs": gcs, "uo": uo, "bg": bg, "lab": lab}
    tables = {n: t.select("*", slot) for n, t in sources.items()}
    return T.hourly_features(grid, tables, MEASURES, KEY, VISIT, ("bg", "lab"), sum_mode, spans)


def stay_hours(
    stays: DataFrame, vital: DataFrame, gcs: DataFrame, uo: DataFrame, bg: DataFrame, lab: DataFrame,
    unit: int = HOUR_MICROS, windows: DataFrame | None = None, look_back: int = 0, sum_mode: str = "faithful",
) -> DataFrame:
    """Hourly data table from the stays; their hours are written once, for the grid and for cutting the measurements."""
    spans = durable(hour_spans(stays, unit, windows, look_back), "spans")
    return hourly(T.hours_of(spans, KEY, [VISIT]), vital, gcs, uo, bg, lab, unit, sum_mode, spans)
