"""Tables of the source that counts minutes from unit admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitewise.functions.scalar import ceil_div, flag, parse_number
from sitewise.operators import timeseries as T
from sitewise.operators.cohort import code_flags, excluded, first_limited
from sitewise.operators.ranking import is_first
from sitewise.operators.summary import group_means
from sitewise.operators.timeseries import Measure, anchors
from sitewise.plans.vocabulary import EXCLUSIONS, OFFSET_CODE_WORDS, OFFSET_ETHNICITY
from sitewise.session import durable

KEY = "patientunitstayid"
MINUTES = 60
SEVERITY_VERSION = "IVa"

_ONE_TABLE = {
    "vital": {
        "heartrate": "heartrate", "sysbp": "sysbp", "diasbp": "diasbp", "meanbp": "meanbp",
        "resprate": "respiratoryrate", "tempc": "temperature", "spo2": "o2saturation",
    },
    "bg": {
        "bg_pao2": "pao2", "bg_paco2": "paco2", "bg_pao2fio2ratio": "pao2fio2", "bg_ph": "ph",
        "bg_baseexcess": "baseexcess",
    },
    "lab": {
        "glucose": "glucose", "albumin": "albumin", "bands": "bands", "bicarbonate": "hco3", "bilirubin": "bilirubin",
        "bun": "bun", "calcium": "calcium", "creatinine": "creatinine", "hematocrit": "hematocrit",
        "hemoglobin": "hemoglobin", "inr": "inr", "lactate": "lactate", "platelet": "platelets",
        "potassium": "potassium", "sodium": "sodium", "wbc": "wbc",
    },
}
MEASURES = tuple(
    Measure(name, ((table, column),)) for table, names in _ONE_TABLE.items() for name, column in names.items()
) + (Measure("gcs", (("vital", "gcs"),), "ceil_avg"), Measure("urineoutput", (("uo", "urineoutput"),), "sum"))


def severity_rows(severity: DataFrame) -> DataFrame:
    """Scores of the one score version in use."""
    return severity.filter(F.col("apacheversion") == SEVERITY_VERSION)


def cohort(patient: DataFrame, vital: DataFrame, severity: DataFrame) -> DataFrame:
    """Stays in intensive care with signal anchors, lengths of stay, death time and exclusion flags."""
    icu = patient.filter(F.lower("unittype").contains("icu")).withColumn("age", parse_number("age"))
    order = ["hospitaladmityear", "hospitaldischargeyear", "age", "patienthealthsystemstayid", "hospitaladmitoffset"]
    ranked = is_first(icu, ["uniquepid"], order, KEY, "first_stay")
    seen = anchors(vital, KEY, "chartoffset", F.col("heartrate").isNotNull(), "admitoffset", "dischoffset")
    scores = severity_rows(severity).select(KEY, F.col("predictedhospitalmortality").alias("risk"))
    stays = ranked.join(seen, KEY, "left").join(scores, KEY, "left")

    unit_death = F.col("unitdischargestatus") == "Expired"
    any_death = (F.col("hospitaldischargestatus") == "Expired") | unit_death
    in_unit = F.col("dischoffset") - F.col("admitoffset")
    in_hospital = F.col("hospitaldischargeoffset") - F.col("admitoffset")
    by_score = (
        F.when(F.col("first_stay") != 1, 1)
        .when(F.col("risk") == "", None)
        .when(F.col("risk").try_cast("double") > 0, 0)
        .otherwise(1)
    )
    no_status = F.coalesce("hospitaldischargestatus", "unitdischargestatus").isNull()
    return stays.select(
        KEY,
        "hospitalid",
        "admitoffset",
        "dischoffset",
        F.when(F.coalesce(any_death, unit_death), 1).otherwise(0).alias("hospital_expire_flag"),
        (in_unit / 60.0 / 24.0).alias("icu_los"),
        (in_hospital / 60.0 / 24.0).alias("hosp_los"),
        F.when(unit_death, in_unit / 60.0).when(any_death, in_hospital / 60.0).alias("deathtime_hours"),
        flag(F.col("age") < 16).alias("exclusion_non_adult"),
        flag(F.col("admitoffset").isNull() | no_status).alias("exclusion_bad_data"),
        F.lit(0).alias("exclusion_organ_donor"),
        by_score.alias("exclusion_by_apache"),
    ).withColumn("excluded", excluded(EXCLUSIONS))


def hour_spans(stays: DataFrame, windows: DataFrame | None = None, look_back: int = 0) -> DataFrame:
    """Hours of the stays kept as one row per stay, with windows only theirs; slots count hours of the offset clock."""
    kept = stays.filter("excluded = 0")
    if windows is None:
        return T.hour_spans(kept, KEY, "admitoffset", "dischoffset", MINUTES)
    kept = kept.join(windows.select(KEY, "windowtime_hours"), KEY)
    return T.hour_spans(kept, KEY, "admitoffset", "dischoffset", MINUTES, window="windowtime_hours", look_back=look_back)


def hours(stays: DataFrame, windows: DataFrame | None = None, look_back: int = 0) -> DataFrame:
    """Hour grid of the stays kept, with windows only their hours."""
    return T.hours_of(hour_spans(stays, windows, look_back), KEY)


def hourly(
    grid: DataFrame, vital: DataFrame, uo: DataFrame, bg: DataFrame, lab: DataFrame, sum_mode: str = "faithful", spans: DataFrame | None = None
) -> DataFrame:
    """Hourly data table of the grid's hours."""
    slot = T.slot_of("chartoffset", MINUTES).alias("slot")
    vital = vital.withColumns({
        "sysbp": F.coalesce("ibp_systolic", "nibp_systolic"),
        "diasbp": F.coalesce("ibp_diastolic", "nibp_diastolic"),
        "meanbp": F.coalesce("map", "ibp_mean", "nibp_mean"),
    })
    bg = bg.withColumn("pao2fio2", F.try_divide("pao2", "fio2"))
    tables = {"vital": vital, "uo": uo, "bg": bg, "lab": lab}
    return T.hourly_features(grid, {n: t.select("*", slot) for n, t in tables.items()}, MEASURES, KEY, sum_mode=sum_mode, spans=spans)


def stay_hours(
    stays: DataFrame, vital: DataFrame, uo: DataFrame, bg: DataFrame, lab: DataFrame,
    windows: DataFrame | None = None, look_back: int = 0, sum_mode: str = "faithful",
) -> DataFrame:
    """Hourly data table from the stays; their hours are written once, for the grid and for cutting the measurements."""
    spans = durable(hour_spans(stays, windows, look_back), "spans")
    return hourly(T.hours_of(spans, KEY), vital, uo, bg, lab, sum_mode, spans)


def code_status(stays: DataFrame, careplan: DataFrame) -> DataFrame:
    """Code-status flags per (stay, time); stays without any item keep one row without a time."""
    items = careplan.filter((F.col("cplgroup") == "Care Limitation") & F.col("cplitemvalue").isNotNull())
    timed = items.withColumnRenamed("cplitemoffset", "chartoffset")
    flags = code_flags(timed, [KEY, "chartoffset"], "cplitemvalue", OFFSET_CODE_WORDS, unknown_is_null=True)
    return stays.select(KEY).join(flags, KEY, "left")


def static_features(stays: DataFrame, patient: DataFrame, codes: DataFrame, severity: DataFrame, predictors: DataFrame) -> DataFrame:
    """Outcomes, time limits and demographics per stay."""
    censor = first_limited(codes, KEY, "chartoffset", ("cmo", "dnr"), "censoroffset")
    vent = severity_rows(severity).select(KEY, F.col("actualventdays").try_cast("int").alias("vent"))
    people = patient.select(KEY, "gender", F.col("age").alias("age_text"), "ethnicity")
    surgery = predictors.select(KEY, F.col("electivesurgery").alias("elective"))
    joined = (
        stays.join(people, KEY).join(censor, KEY, "left").join(vent, KEY, "left").join(surgery, KEY, "left")
    )
    races = {name: flag(F.col("ethnicity") == word) for name, word in OFFSET_ETHNICITY.items()}
    return joined.select(
        KEY,
        "hospitalid",
        ceil_div(F.col("dischoffset") - F.col("admitoffset"), MINUTES).alias("dischtime_hours"),
        "deathtime_hours",
        F.col("hospital_expire_flag").alias("death"),
        F.coalesce("vent", F.lit(0)).alias("ventdays"),
        ceil_div(F.col("censoroffset") - F.col("admitoffset"), MINUTES).alias("censortime_hours"),
        flag(F.col("gender") == "Female").alias("is_female"),
        F.when(F.col("age_text") == "> 89", 90.0).otherwise(parse_number("age_text", "double")).alias("age"),
        *[c.alias(name) for name, c in races.items()],
        flag(~F.col("ethnicity").isin(*OFFSET_ETHNICITY.values())).alias("race_other"),
        F.coalesce("elective", F.lit(0)).alias("electivesurgery"),
    )


def severity_table(stays: DataFrame, patient: DataFrame, severity: DataFrame) -> DataFrame:
    """Score and predicted mortality of the stays kept."""
    scores = severity_rows(severity).select(KEY, "apachescore", "predictedhospitalmortality")
    kept = stays.filter("excluded = 0").select(KEY)
    return patient.select(KEY, "hospitalid").join(kept, KEY).join(scores, KEY, "left")


def site_table(hospital: DataFrame, stays: DataFrame, static: DataFrame, severity: DataFrame) -> DataFrame:
    """Size, mortality and patient mix per hospital."""
    means = ["age", "race_black", "race_hispanic", "race_asian", "electivesurgery", "is_female", "apachescore"]
    kept = stays.filter("excluded = 0").select(KEY, "hospitalid", "hospital_expire_flag")
    rows = kept.join(static.select(KEY, *means[:-1]), KEY).join(severity_rows(severity).select(KEY, "apachescore"), KEY, "left")
    sums = group_means(rows, ["hospitalid"], "hospital_expire_flag", means, "num_pat", "frac_mortality")
    return hospital.select("hospitalid", "numbedscategory", "teachingstatus", "region").join(sums, "hospitalid")
