"""Rules that are easy to lose, on hand-made rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitewise.functions import scalar as S
from sitewise.operators import cohort, features, summary, timeseries
from sitewise.plans import offset_source, timestamp_source


def one(df):
    return df.collect()[0]


def test_flags_skip_null(spark):
    df = spark.createDataFrame([(1, None, 0), (2, None, None), (3, 1, None)], "id int, exclusion_a int, exclusion_b int")
    rows = {r.id: r.e for r in df.select("id", cohort.excluded(["exclusion_a", "exclusion_b"]).alias("e")).collect()}
    assert rows == {1: 0, 2: None, 3: 1}
    assert sorted(r.id for r in cohort.drop_excluded(df).collect()) == [1, 2]


def test_attrition_counts(spark):
    df = spark.createDataFrame(
        [(1, 0, 4), (1, 1, 4), (0, 0, None), (0, None, 4)], "exclusion_a int, exclusion_b int, windowtime_hours int"
    )
    counts = {r.label: (r.n, r.pct) for r in cohort.attrition_report(df).collect()}
    assert counts["flagged exclusion_a"] == (2, 50.0)
    assert counts["flagged exclusion_b"] == (1, 25.0)
    assert counts["flagged at all"] == (2, 50.0)
    assert counts["without a window"] == (1, 25.0)
    assert counts["kept"] == (1, 25.0)


def test_age_text(spark):
    df = spark.createDataFrame([("",), ("> 89",), ("42",), ("x",), (None,)], "age string")
    assert [r[0] for r in df.select(S.parse_number("age")).collect()] == [None, 89, 42, None, None]


def test_missing_limit_counts_as_limit(spark):
    df = spark.createDataFrame([(None,), (100,), (7,)], "x int")
    assert [r[0] for r in df.select(F.least("x", F.lit(90))).collect()] == [90, 90, 7]
    vent = spark.createDataFrame([(1, None), (2, 50.0), (2, 1.0), (3, 9999.0)], "id int, h double")
    assert {r.id: r.d for r in cohort.capped_days(vent, "id", "h", 30, "d").collect()} == {1: 30, 2: 3, 3: 30}


def test_hour_ceil_keeps_first_half_minute(spark):
    times = [datetime(2020, 1, 1, 10, 0, 30), datetime(2020, 1, 1, 10, 1, 0), datetime(2020, 1, 1, 10, 0, 0)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    assert [r[0].hour for r in df.select(S.hour_ceil_59("t")).collect()] == [10, 11, 10]


@pytest.mark.parametrize("value, unit, expected", [(61, 60, 2), (60, 60, 1), (1, 60, 1), (0, 60, 0), (-1, 60, 0), (-60, 60, -1), (-61, 60, -1)])
def test_ceil_div(spark, value, unit, expected):
    assert one(spark.range(1).select(S.ceil_div(F.lit(value), unit)))[0] == expected


def test_metric_on_outer_edge_keeps_default(spark):
    df = spark.createDataFrame([(0.5,), (0.7,), (0.9,), (1.0,)], "auc double")
    ranges = [("low", 0.0, 0.7), ("medium", 0.7, 0.9), ("high", 0.9, 1.0)]
    assert [r[0] for r in df.select(S.metric_bucket("auc", ranges, "low")).collect()] == ["low", "medium", "high", "low"]


def test_last_match_wins(spark):
    df = spark.range(1)
    assert one(df.select(S.last_match("a", [(F.lit(True), "b"), (F.lit(True), "c"), (F.lit(False), "d")])))[0] == "c"


def window_frame(spark):
    rows = [
        # id, hr, vital, lab, urine
        (1, 0, None, 1.0, None), (1, 5, 10.0, None, None), (1, 6, None, 3.0, None), (1, 8, 30.0, None, None), (1, 9, 99.0, 99.0, 9.0),
        (2, 1, 5.0, 5.0, 5.0),
        (3, 7, None, None, 2.0), (3, 8, None, None, 3.0),
    ]
    hourly = spark.createDataFrame(rows, "id int, hr bigint, v double, lab double, uo double")
    windows = spark.createDataFrame([(1, 8), (2, 8), (3, 8)], "id int, windowtime_hours int")
    plan = features.FeaturePlan(first=("v", "lab"), last=("v", "lab"), low=("v",), high=("v",), total=("uo",), extended=("lab",))
    out = features.window_features(hourly, windows, "id", 4, 4, plan)
    return {r.id: r for r in out.collect()}


def test_window_ends_are_inclusive_and_early_covers_all(spark):
    r = window_frame(spark)[1]
    assert (r.v_first, r.v_last, r.v_min, r.v_max) == (10.0, 30.0, 10.0, 30.0)
    assert (r.lab_first_early, r.lab_last_early) == (1.0, 3.0)


def test_sum_is_zero_with_rows_and_null_without(spark):
    rows = window_frame(spark)
    assert rows[1].uo_sum == 0.0  # rows in the window, all values missing
    assert rows[2].uo_sum is None  # only early rows
    assert rows[3].uo_sum == 5.0
    assert rows[2].v_first is None and rows[2].lab_first_early == 5.0


def test_plan_names(spark):
    plan = features.FeaturePlan()
    assert (len(plan.first), len(plan.low), len(plan.extended)) == (29, 8, 21)
    assert "gcs" in plan.low and "gcs" in plan.high and "gcs" in plan.first and "gcs" in plan.last


def test_random_window_is_long_enough_and_fits(spark):
    stays = spark.range(500).withColumn("l", (F.col("id") % 40).cast("double")).withColumn("none", F.lit(None).cast("double"))
    rows = timeseries.random_window(stays, "id", ["l", "none"], 3).collect()
    assert rows and all(4 <= r.windowtime_hours <= r.l for r in rows)
    assert {r.id for r in rows} == {i for i in range(500) if i % 40 >= 4}


def test_offset_cohort_rules(spark):
    columns = """patientunitstayid bigint, patienthealthsystemstayid bigint, uniquepid string, hospitalid int, hospitaladmitoffset int,
      hospitaldischargeoffset int, unitdischargeoffset int, hospitaldischargestatus string, unitdischargestatus string,
      hospitaladmityear int, hospitaldischargeyear int, age string, gender string, ethnicity string, unittype string"""
    base = dict(hospitalid=1, hospitaladmitoffset=0, hospitaldischargeoffset=6000, unitdischargeoffset=1, hospitaldischargestatus="Alive",
                unitdischargestatus="Alive", hospitaladmityear=2014, hospitaldischargeyear=2014, age="50", gender="Male", ethnicity="Caucasian", unittype="MICU")
    people = [
        dict(base, patientunitstayid=1, uniquepid="a", hospitaladmityear=2015),  # second stay of a
        dict(base, patientunitstayid=2, uniquepid="a"),  # risk text empty
        dict(base, patientunitstayid=3, uniquepid="b", age="15", unitdischargestatus="Expired"),  # no severity row
        dict(base, patientunitstayid=4, uniquepid="c", hospitaldischargestatus="Expired"),  # risk <= 0
        dict(base, patientunitstayid=5, uniquepid="d", unittype="Step-Down"),  # not intensive care
        dict(base, patientunitstayid=6, uniquepid="e", hospitaldischargestatus=None, unitdischargestatus=None),  # no signal
    ]
    names = [c.split()[0] for c in columns.replace("\n", " ").split(",")]
    rows = [tuple({"patienthealthsystemstayid": p["patientunitstayid"], **p}[n] for n in names) for p in people]
    patient = spark.createDataFrame(rows, columns)
    vital = spark.createDataFrame([(i, t, 80.0) for i in range(1, 6) for t in (30, 630)] + [(6, 1, None)], "patientunitstayid bigint, chartoffset int, heartrate double")
    severity = spark.createDataFrame(
        [(1, "IVa", "0.2"), (2, "IVa", ""), (2, "IV", "0.4"), (4, "IVa", "-1"), (6, "IVa", "0.1")],
        "patientunitstayid bigint, apacheversion string, predictedhospitalmortality string",
    )
    out = {r.patientunitstayid: r for r in offset_source.cohort(patient, vital, severity).collect()}
    assert set(out) == {1, 2, 3, 4, 6}
    assert {i: r.exclusion_by_apache for i, r in out.items()} == {1: 1, 2: None, 3: 1, 4: 1, 6: 0}
    assert out[2].excluded == 0  # unknown flag keeps the stay
    assert out[3].exclusion_non_adult == 1 and out[3].deathtime_hours == 10.0  # unit death: last signal
    assert out[4].deathtime_hours == pytest.approx((6000 - 30) / 60)  # hospital death: discharge
    assert out[6].exclusion_bad_data == 1 and out[1].icu_los == pytest.approx(600 / 1440)


def test_race_other_differs_between_sources(spark):
    stays = spark.createDataFrame([(1, 1, 0, 60, None, 0), (2, 1, 0, 60, None, 0)], "patientunitstayid bigint, hospitalid int, admitoffset int, dischoffset int, deathtime_hours double, hospital_expire_flag int")
    patient = spark.createDataFrame([(1, "Female", "> 89", "Caucasian"), (2, "Male", "", None)], "patientunitstayid bigint, gender string, age string, ethnicity string")
    codes = spark.createDataFrame([(1, 30, 1, 0)], "patientunitstayid bigint, chartoffset int, dnr int, cmo int")
    none = spark.createDataFrame([], "patientunitstayid bigint, apacheversion string, actualventdays string")
    surgery = spark.createDataFrame([], "patientunitstayid bigint, electivesurgery int")
    out = {r.patientunitstayid: r for r in offset_source.static_features(stays, patient, codes, none, surgery).collect()}
    assert (out[1].race_other, out[2].race_other) == (1, 0)
    assert (out[1].age, out[2].age) == (90.0, None)
    assert (out[1].censortime_hours, out[2].censortime_hours) == (1, None)


def test_visit_rows_serve_all_stays(spark):
    stays = spark.createDataFrame([(10, 1, 0, datetime(2020, 1, 1, 1), datetime(2020, 1, 1, 3)), (11, 1, 0, datetime(2020, 1, 1, 2), datetime(2020, 1, 1, 4))],
                                  "icustay_id int, hadm_id int, excluded int, intime timestamp_ntz, outtime timestamp_ntz")
    grid = timestamp_source.hours(stays)
    at = datetime(2020, 1, 1, 2, 30)
    empty = lambda cols: spark.createDataFrame([], "icustay_id int, charttime timestamp_ntz, " + cols)
    vital = empty("heartrate double, sysbp double, diasbp double, meanbp double, resprate double, tempc double, spo2 double, glucose double")
    gas = ", ".join(f"{c} double" for c in "po2 pco2 pao2fio2ratio ph baseexcess totalco2 glucose bicarbonate calcium hematocrit hemoglobin lactate potassium sodium".split())
    lab = ", ".join(f"{c} double" for c in "glucose albumin bands bicarbonate bilirubin bun creatinine hematocrit hemoglobin inr lactate platelet potassium sodium wbc".split())
    bg = spark.createDataFrame([(1, at, *[5.0] * 14)], "hadm_id int, charttime timestamp_ntz, " + gas)
    labs = spark.createDataFrame([], "hadm_id int, charttime timestamp_ntz, " + lab)
    hourly = timestamp_source.hourly(grid, vital, empty("gcs double"), empty("urineoutput double"), bg, labs)
    seen = {(r.icustay_id, r.hr) for r in hourly.filter("bg_ph is not null").collect()}
    assert seen == {(10, 2), (11, 1)}
    assert hourly.count() == grid.count() == 2 * (24 + 1 + 2)


def test_histogram_closes_last_bin_only(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (2.5,), (-1.0,)], "x double")
    assert [r.n for r in summary.histogram(df, "x", [0.0, 1.0, 2.0]).orderBy("bin").collect()] == [1, 3]


def test_reference_level_is_the_most_frequent(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "id int, c string")
    out = summary.drop_reference_dummies(df, "c")
    assert sorted(out.columns) == ["c_b", "c_null", "id"]
    assert {r.id: (r.c_b, r.c_null) for r in out.collect()} == {1: (0, 0), 2: (0, 0), 3: (0, 1), 4: (1, 0)}
