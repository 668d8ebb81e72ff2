"""Hour grids, hourly tables, windows, window features and design matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions.scalar import micros, r6
from sitewise.operators.features import FeaturePlan, in_window_rows, window_features
from sitewise.operators.timeseries import slot_of, spread_over_stays, up_to_window
from sitewise.plans import matrices, offset_source, timestamp_source
from sitewise.plans.vocabulary import LIMITS, STATIC_INPUTS
from sitewise.queries.registry import query
from sitewise.queries.sqltext import UNIFORM
from sitewise.queries.stays import (
    COHORT_OFFSET_SQL,
    COHORT_TIMESTAMP_SQL,
    OFFSET_FRAMES,
    STATIC_FRAMES,
    STATIC_OFFSET_SQL,
    STATIC_TIMESTAMP_SQL,
    TIMESTAMP_FRAMES,
    doubles,
    offset_cohort,
    offset_static,
    sql_doubles,
    timestamp_cohort,
    timestamp_static,
)
from sitewise.session import durable

DAY_MICROS = 24 * timestamp_source.HOUR_MICROS
T_FRAMES = "t_vital t_gcs t_uo t_bg t_lab"


def rounded(df, *keep):
    """All columns but the keys as doubles with six digits."""
    return doubles(df, *[c for c in df.columns if c not in keep])


# --- literal SQL: grid and joins on the hour


def grid_sql(stays: str, unit: str) -> str:
    seconds = {"hour": 3600, "day": 86400}[unit]
    return f"""grid as (
      select icustay_id, hadm_id, hr, intime + to_{unit}s(hr::int) as endtime from (
        select icustay_id, hadm_id, intime, unnest(generate_series(-24, ceil(epoch(outtime - intime) / {seconds})::bigint)) as hr
        from {stays} where excluded = 0))"""


def measures_sql(measures) -> str:
    parts = []
    for m in measures:
        value = "coalesce(" + ", ".join(f"{t}.{c}" for t, c in m.sources) + ")"
        call = {"avg": f"avg({value})", "ceil_avg": f"ceil(avg({value}))", "sum": f"sum({value})"}[m.how]
        parts.append(f"{call} as {m.name}")
    return ", ".join(parts)


def hourly_sql(unit: str, measures=timestamp_source.MEASURES, source: str = "t") -> str:
    joins = " ".join(
        f"left join {source}_{n} {n} on grid.{k} = {n}.{k} and grid.endtime - interval 1 {unit} < {n}.charttime and grid.endtime >= {n}.charttime"
        for n, k in (("vital", "icustay_id"), ("gcs", "icustay_id"), ("uo", "icustay_id"), ("bg", "hadm_id"), ("lab", "hadm_id"))
    )
    return f"hourly as (select grid.icustay_id, grid.hr, {measures_sql(measures)} from grid {joins} group by 1, 2)"


OFFSET_GRID_SQL = """grid as (
  select patientunitstayid, hr, ceil(admitoffset / 60.0::double) * 60 + hr * 60 as endoffset from (
    select patientunitstayid, admitoffset, unnest(generate_series(-24, ceil((dischoffset - admitoffset) / 60.0::double)::bigint)) as hr
    from cohort where excluded = 0))"""


def offset_hourly_sql() -> str:
    derived = {
        "sysbp": "coalesce(vital.ibp_systolic, vital.nibp_systolic)",
        "diasbp": "coalesce(vital.ibp_diastolic, vital.nibp_diastolic)",
        "meanbp": "coalesce(vital.map, vital.ibp_mean, vital.nibp_mean)",
        "pao2fio2": "case when bg.fio2 <> 0 then bg.pao2 / bg.fio2 end",
    }
    text = measures_sql(offset_source.MEASURES)
    for name, expression in derived.items():
        for table in ("vital", "bg"):
            text = text.replace(f"coalesce({table}.{name})", expression)
    joins = " ".join(
        f"left join pivoted_{n} {n} on grid.patientunitstayid = {n}.patientunitstayid and grid.endoffset - 60 < {n}.chartoffset and grid.endoffset >= {n}.chartoffset"
        for n in ("vital", "uo", "bg", "lab")
    )
    return f"hourly as (select grid.patientunitstayid, grid.hr, {text} from grid {joins} group by 1, 2)"


def features_sql(key: str, width: int, extra: int, plan: FeaturePlan = FeaturePlan(), windows: str = "windows") -> str:
    """Features of the hours [T - width - extra, T]; variables with the longer look-back use all of them."""
    parts = []
    for names, suffix, pattern in (
        (plan.first, "first", "arg_min({v}, hr) filter ({v} is not null{w})"),
        (plan.last, "last", "arg_max({v}, hr) filter ({v} is not null{w})"),
        (plan.low, "min", "min({v}) filter ({v} is not null{w})"),
        (plan.high, "max", "max({v}) filter ({v} is not null{w})"),
    ):
        for v in names:
            early = v in plan.extended
            inside = "" if early else f" and hr >= t - {width}"
            parts.append(pattern.format(v=v, w=inside) + f" as {v}_{suffix}" + ("_early" if early else ""))
    for v in plan.total:
        parts.append(f"case when count(*) filter (hr >= t - {width}) > 0 then coalesce(sum({v}) filter (hr >= t - {width}), 0) end as {v}_sum")
    return f"""features as (select {key}, {", ".join(parts)} from hourly join (select {key}, windowtime_hours as t from {windows}) using ({key})
      where hr between t - {width + extra} and t group by 1)"""


# --- grids and hourly tables


@query(
    "hour_grid",
    f"with {grid_sql('t_stay', 'hour')} select icustay_id, hr::bigint as hr, epoch_us(endtime) as end_us from grid",
    "t_stay",
)
def hour_grid(fr):
    """Hours -24 .. end of each stay with the end time of each hour."""
    grid = timestamp_source.hours(fr.t_stay)
    return grid.select("icustay_id", "hr", (F.col("slot") * timestamp_source.HOUR_MICROS).alias("end_us"))


def t_events(fr):
    return fr.t_vital, fr.t_gcs, fr.t_uo, fr.t_bg, fr.t_lab


@query("hourly_features", f"with {grid_sql('t_stay_day', 'day')}, {hourly_sql('day')} select icustay_id, hr::bigint as hr, {sql_doubles(*[m.name for m in timestamp_source.MEASURES])} from hourly", "t_stay_day " + T_FRAMES)
def hourly_features(fr):
    """Averages and sums of five event tables per (stay, interval); day-wide intervals hold several rows."""
    return rounded(timestamp_source.stay_hours(fr.t_stay_day, *t_events(fr), unit=DAY_MICROS), "icustay_id", "hr")


@query(
    "hourly_given_grid",
    f"""with {grid_sql('t_stay', 'hour')}, {hourly_sql('hour')} select icustay_id, hr::bigint as hr, {sql_doubles(*[m.name for m in timestamp_source.MEASURES])}
        from hourly""",
    "t_stay " + T_FRAMES,
)
def hourly_given_grid(fr):
    """The same on the hours of an existing table (stay, hour, end of the hour)."""
    end = F.timestamp_micros(F.col("slot") * timestamp_source.HOUR_MICROS).alias("endtime")
    given = durable(timestamp_source.hours(fr.t_stay).select("icustay_id", "hr", end), "hours")
    return rounded(timestamp_source.hourly(timestamp_source.given_hours(fr.t_stay, given), *t_events(fr)), "icustay_id", "hr")


OFFSET_NAMES = [m.name for m in offset_source.MEASURES]


@query(
    "hourly_grid_join",
    f"""with {COHORT_OFFSET_SQL}, {OFFSET_GRID_SQL}, {offset_hourly_sql()}
        select hr::bigint as hr, count(*) as n_rows, {", ".join(f"count({m}) as n_{m}, round(sum({m}), 4) as {m}" for m in OFFSET_NAMES)} from hourly group by 1""",
    OFFSET_FRAMES + " pivoted_uo pivoted_bg pivoted_lab",
)
def hourly_grid_join(fr):
    """Four event tables on the hour grid of the offset clock, summed per hour."""
    hourly = offset_hourly(fr, offset_cohort(fr))
    sums = [a for m in OFFSET_NAMES for a in (F.count(m).alias(f"n_{m}"), F.round(F.sum(m), 4).alias(m))]
    return hourly.groupBy("hr").agg(F.count(F.lit(1)).alias("n_rows"), *sums)


@query(
    "hourly_offset",
    f"""with {COHORT_OFFSET_SQL}, {OFFSET_GRID_SQL}, {offset_hourly_sql()} select patientunitstayid, hr::bigint as hr, {sql_doubles(*OFFSET_NAMES)} from hourly""",
    OFFSET_FRAMES + " pivoted_uo pivoted_bg pivoted_lab",
)
def hourly_offset(fr):
    """Hourly table of the offset source: a row per (stay, hour)."""
    hourly = offset_hourly(fr, offset_cohort(fr))
    return rounded(hourly.select("patientunitstayid", F.col("hr").cast("bigint").alias("hr"), *OFFSET_NAMES), "patientunitstayid", "hr")


@query(
    "join_mixed_grain",
    f"""with {grid_sql('t_stay', 'hour')} select g.icustay_id, g.hr::bigint as hr, count(*) as n, count(b.potassium) as n_potassium
        from grid g join t_bg b on g.hadm_id = b.hadm_id and g.endtime - interval 1 hour < b.charttime and g.endtime >= b.charttime group by 1, 2""",
    "t_stay t_bg",
)
def join_mixed_grain(fr):
    """Rows kept per visit serve the hours of every stay of the visit."""
    spans = timestamp_source.hour_spans(fr.t_stay)
    gas = fr.t_bg.select("hadm_id", "potassium", slot_of(micros("charttime"), timestamp_source.HOUR_MICROS).alias("slot"))
    counts = gas.groupBy("hadm_id", "slot").agg(F.count(F.lit(1)).alias("n"), F.count("potassium").alias("n_potassium"))
    return spread_over_stays(counts, spans, "hadm_id").select("icustay_id", "hr", "n", "n_potassium")


# --- windows


def event_windows(stays):
    """Window end of each event stay."""
    return stays.filter("excluded = 0").select("icustay_id", (F.lit(100) + F.col("icustay_id") % 400).alias("windowtime_hours"))


WINDOWS_SQL = "windows as (select icustay_id, 100 + icustay_id % 400 as windowtime_hours from t_stay where excluded = 0)"
WIDTH, EXTRA = 48, 72


@query(
    "join_upto_window",
    f"with {grid_sql('t_stay', 'hour')}, {WINDOWS_SQL} select icustay_id, count(*) as n_hours, max(hr)::bigint as last_hr from grid join windows using (icustay_id) where hr <= windowtime_hours group by 1",
    "t_stay",
)
def join_upto_window(fr):
    grid = up_to_window(timestamp_source.hours(fr.t_stay), event_windows(fr.t_stay), "icustay_id")
    return grid.groupBy("icustay_id").agg(F.count(F.lit(1)).alias("n_hours"), F.max("hr").alias("last_hr"))


@query(
    "window_select",
    f"""with {grid_sql('t_stay', 'hour')}, {WINDOWS_SQL} select icustay_id, hr::bigint as hr, (windowtime_hours - hr > 8)::int as early
        from grid join windows using (icustay_id) where hr between windowtime_hours - 32 and windowtime_hours""",
    "t_stay",
)
def window_select(fr):
    """Hours of the window, both ends included, and of the look-back before it."""
    grid = timestamp_source.hours(fr.t_stay).hint("merge")  # many rows from few spans: not to be broadcast
    rows = in_window_rows(grid.select("icustay_id", "hr"), event_windows(fr.t_stay), "icustay_id", 8, 24)
    return rows.select("icustay_id", "hr", F.col("early").cast("int").alias("early"))


def _window_query(name: str, plan: FeaturePlan):
    sql = f"""with {grid_sql('t_stay', 'hour')}, {hourly_sql('hour')}, {WINDOWS_SQL}, {features_sql('icustay_id', WIDTH, EXTRA, plan)}
        select icustay_id, round(columns(* exclude (icustay_id))::double, 6) from features"""

    @query(name, sql, "t_stay " + T_FRAMES)
    def run(fr):
        stays = durable(fr.t_stay, "stays")
        windows = event_windows(stays)
        hourly = timestamp_source.stay_hours(stays, *t_events(fr), windows=windows, look_back=WIDTH + EXTRA)
        features = window_features(hourly, windows, "icustay_id", WIDTH, EXTRA, plan)
        return rounded(features, "icustay_id")


NOTHING = {"first": (), "last": (), "low": (), "high": (), "total": ()}
SOME = ("heartrate", "gcs", "glucose", "bg_ph", "sodium")
_window_query("first_last_in_window", FeaturePlan(**{**NOTHING, "first": SOME, "last": SOME}))
_window_query("minmax_in_window", FeaturePlan(**{**NOTHING, "low": SOME, "high": SOME}))
_window_query("sum_in_window", FeaturePlan(**{**NOTHING, "total": ("urineoutput",)}))
_window_query("design_matrix", FeaturePlan())


# --- window ends and matrices of the offset source


@query(
    "fixed_window",
    f"""with {COHORT_OFFSET_SQL}, {STATIC_OFFSET_SQL} select patientunitstayid, {sql_doubles(*LIMITS)}, 24 as windowtime_hours
        from cohort join static using (patientunitstayid) where excluded = 0
          and least({", ".join("static." + x for x in LIMITS)}) >= 24""".replace("round(deathtime_hours", "round(static.deathtime_hours"),
    STATIC_FRAMES,
)
def fixed_window(fr):
    """First-day window of the stays that last 24 hours."""
    stays = offset_cohort(fr)
    return doubles(matrices.day_one_windows(stays, offset_static(fr, stays), "patientunitstayid"), *LIMITS)


RANDOM_SQL = f"""limits as (
    select c.patientunitstayid, {", ".join("s." + x for x in LIMITS)}, least({", ".join("s." + x for x in LIMITS)}) as l,
      {UNIFORM('c.patientunitstayid', 7)} as random_fraction
    from cohort c join static s using (patientunitstayid) where c.excluded = 0),
  windows as (
    select * exclude (l), greatest(floor(random_fraction * (l - 2)), 4)::int as windowtime_hours from limits
    where greatest(floor(random_fraction * (l - 2)), 4) <= l)"""


@query(
    "random_window",
    f"""with {COHORT_OFFSET_SQL}, {STATIC_OFFSET_SQL}, {RANDOM_SQL} select * replace ({sql_doubles(*LIMITS)}, round(random_fraction, 9) as random_fraction)
        from windows""",
    STATIC_FRAMES,
)
def random_window(fr):
    """Reproducible random window end, at least four hours, inside all limits."""
    stays = offset_cohort(fr)
    windows = matrices.random_windows(stays, offset_static(fr, stays), "patientunitstayid", 7)
    return doubles(windows, *LIMITS).withColumn("random_fraction", F.round("random_fraction", 9))


def offset_hourly(fr, stays, windows=None, look_back: int = 0):
    return offset_source.stay_hours(stays, fr.pivoted_vital, fr.pivoted_uo, fr.pivoted_bg, fr.pivoted_lab, windows, look_back)


def finished(fr):
    """Cohort and static table, written once: the steps of a matrix read them several times."""
    stays = durable(offset_cohort(fr), "cohort")
    return stays, durable(offset_static(fr, stays), "static")


MATRIX_FRAMES = STATIC_FRAMES + " pivoted_uo pivoted_bg pivoted_lab"
DAY_WINDOWS_SQL = f"""windows as (select patientunitstayid, 24 as windowtime_hours from cohort join static s using (patientunitstayid)
    where excluded = 0 and least({", ".join("s." + x for x in LIMITS)}) >= 24)"""


def assembled_sql(features: str = "features") -> str:
    inputs = ", ".join(f"round(s.{c}::double, 6) as {c}" for c in STATIC_INPUTS)
    return f"""select c.patientunitstayid, c.hospitalid, s.death, round(c.hosp_los, 6) as hosp_los, s.ventdays, {inputs}, round(columns(f.* exclude (patientunitstayid))::double, 6)
      from cohort c join {features} f using (patientunitstayid) join static s using (patientunitstayid)"""


def tidy_matrix(df):
    return rounded(df, "patientunitstayid", "hospitalid", "death", "ventdays")


@query(
    "random_window_matrix",
    f"with {COHORT_OFFSET_SQL}, {STATIC_OFFSET_SQL}, {RANDOM_SQL}, {OFFSET_GRID_SQL}, {offset_hourly_sql()}, {features_sql('patientunitstayid', 4, 24)} {assembled_sql()}",
    MATRIX_FRAMES,
)
def random_window_matrix(fr):
    """Source tables to design matrix with random window ends, four-hour windows."""
    stays, static = finished(fr)
    windows = matrices.random_windows(stays, static, "patientunitstayid", 7)
    hourly = offset_hourly(fr, stays, windows, 4 + 24)
    return tidy_matrix(matrices.design_matrix(stays, windows, hourly, static, "patientunitstayid", 4))


@query(
    "fixed_window_matrix",
    f"with {COHORT_OFFSET_SQL}, {STATIC_OFFSET_SQL}, {DAY_WINDOWS_SQL}, {OFFSET_GRID_SQL}, {offset_hourly_sql()}, {features_sql('patientunitstayid', 24, 24)} {assembled_sql()}",
    MATRIX_FRAMES,
)
def fixed_window_matrix(fr):
    """Source tables to design matrix of the first day."""
    stays, static = finished(fr)
    windows = matrices.day_one_windows(stays, static, "patientunitstayid")
    hourly = offset_hourly(fr, stays, windows, 24 + 24)
    return tidy_matrix(matrices.design_matrix(stays, windows, hourly, static, "patientunitstayid", 24))


TIMESTAMP_LIMITS = ", ".join("s." + x for x in LIMITS)
DAY_WINDOWS_TIMESTAMP_SQL = f"""windows as (select icustay_id, 24 as windowtime_hours from cohort join static s using (icustay_id)
    where excluded = 0 and least({TIMESTAMP_LIMITS}) >= 24)"""
RANDOM_TIMESTAMP_SQL = f"""limits as (select c.icustay_id, least({TIMESTAMP_LIMITS}) as l, {UNIFORM('c.icustay_id', 7)} as random_fraction
    from cohort c join static s using (icustay_id) where c.excluded = 0),
  windows as (select icustay_id, greatest(floor(random_fraction * (l - 2)), 4)::int as windowtime_hours from limits
    where greatest(floor(random_fraction * (l - 2)), 4) <= l)"""
TIMESTAMP_MATRIX_FRAMES = TIMESTAMP_FRAMES + " services ventdurations"
TIMESTAMP_EVENTS = " s_vital s_gcs s_uo s_bg s_lab"


def timestamp_assembled_sql(features: str = "features") -> str:
    inputs = ", ".join(f"round(s.{c}::double, 6) as {c}" for c in STATIC_INPUTS)
    return f"""select c.icustay_id, c.hospitalid, s.death, round(c.hosp_los, 6) as hosp_los, s.ventdays, {inputs},
        round(columns(f.* exclude (icustay_id))::double, 6)
      from cohort c join {features} f using (icustay_id) join static s using (icustay_id)"""


def timestamp_matrix_sql(windows: str, width: int) -> str:
    return f"""with {COHORT_TIMESTAMP_SQL}, {STATIC_TIMESTAMP_SQL}, {windows}, {grid_sql('cohort', 'hour')},
      {hourly_sql('hour', source='s')}, {features_sql('icustay_id', width, 24)} {timestamp_assembled_sql()}"""


def timestamp_finished(fr):
    """Stays kept and their static table, which is all that a matrix takes; events of other stays are cut before their exchanges."""
    stays = durable(timestamp_cohort(fr, kept_only=True), "cohort")
    cut = [t.join(stays.select("icustay_id"), "icustay_id", "left_semi") for t in (fr.icustays, fr.chartevents)]
    return stays, durable(timestamp_static(fr, stays, *cut), "static")


def timestamp_matrix(fr, stays, static, windows, width: int):
    """Source tables with timestamps to a design matrix; the site is the cohort's."""
    # all five event tables are read from these rows: written once, for the visits kept
    fr.timed = durable(fr.timed.join(stays.select("hadm_id"), "hadm_id", "left_semi"), "timed")
    events = fr.s_vital, fr.s_gcs, fr.s_uo, fr.s_bg, fr.s_lab
    hourly = timestamp_source.stay_hours(stays, *events, windows=windows, look_back=width + 24)
    matrix = matrices.design_matrix(stays, windows, hourly, static, "icustay_id", width)
    return rounded(matrix, "icustay_id", "hospitalid", "death", "ventdays")


@query("fixed_window_matrix_timestamp", timestamp_matrix_sql(DAY_WINDOWS_TIMESTAMP_SQL, 24), TIMESTAMP_MATRIX_FRAMES + TIMESTAMP_EVENTS)
def fixed_window_matrix_timestamp(fr):
    """Design matrix of the first day."""
    stays, static = timestamp_finished(fr)
    return timestamp_matrix(fr, stays, static, matrices.day_one_windows(stays, static, "icustay_id"), 24)


@query("random_window_matrix_timestamp", timestamp_matrix_sql(RANDOM_TIMESTAMP_SQL, 4), TIMESTAMP_MATRIX_FRAMES + TIMESTAMP_EVENTS)
def random_window_matrix_timestamp(fr):
    """Design matrix with random window ends, four-hour windows."""
    stays, static = timestamp_finished(fr)
    return timestamp_matrix(fr, stays, static, matrices.random_windows(stays, static, "icustay_id", 7), 4)


@query(
    "severity_matrix_timestamp",
    f"""with {COHORT_TIMESTAMP_SQL}, {STATIC_TIMESTAMP_SQL}, {DAY_WINDOWS_TIMESTAMP_SQL}, scored as (
          select w.icustay_id, a.apsiii from windows w left join s_score a using (icustay_id)) {timestamp_assembled_sql('scored')}""",
    TIMESTAMP_MATRIX_FRAMES + " s_score",
)
def severity_matrix_timestamp(fr):
    """Severity score with outcomes and static inputs."""
    stays, static = timestamp_finished(fr)
    windows = matrices.day_one_windows(stays, static, "icustay_id")
    matrix = matrices.severity_matrix(stays, windows, fr.s_score, static, "icustay_id")
    return rounded(matrix, "icustay_id", "hospitalid", "death", "ventdays")


@query(
    "severity_matrix",
    f"""with {COHORT_OFFSET_SQL}, {STATIC_OFFSET_SQL}, {DAY_WINDOWS_SQL}, scored as (
          select w.patientunitstayid, a.acutephysiologyscore as apsiii from windows w
          left join (select * from apache where apacheversion = 'IVa') a using (patientunitstayid)) {assembled_sql('scored')}""",
    STATIC_FRAMES,
)
def severity_matrix(fr):
    """Severity score with outcomes and static inputs."""
    stays, static = finished(fr)
    windows = matrices.day_one_windows(stays, static, "patientunitstayid")
    scores = offset_source.severity_rows(fr.apache).withColumnRenamed("acutephysiologyscore", "apsiii")
    return tidy_matrix(matrices.severity_matrix(stays, windows, scores, static, "patientunitstayid"))


@query(
    "assemble_matrix",
    "select f.id, f.site, f.y, round(s.price, 6) as price, f.x3, f.x4 from feat f join stay s using (id)",
    "feat stay",
)
def assemble_matrix(fr):
    """Features joined with outcomes on the stay."""
    outcomes = fr.stay.select("id", "site", "y", r6("price").alias("price"))
    return outcomes.join(fr.feat.select("id", "x3", "x4"), "id").select("id", "site", "y", "price", "x3", "x4")


