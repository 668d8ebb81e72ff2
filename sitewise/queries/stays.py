"""Joins, stay order, and the cohort, code-status, static and severity tables of both sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions.scalar import r6
from sitewise.operators.cohort import capped_days, first_limited
from sitewise.operators.joins import null_counts
from sitewise.operators.ranking import is_first, small_group_positions
from sitewise.operators.timeseries import anchors
from sitewise.plans import offset_source, timestamp_source
from sitewise.plans.vocabulary import OFFSET_CODE_WORDS, TIMESTAMP_CODE_WORDS, TIMESTAMP_ETHNICITY
from sitewise.queries.registry import query


def words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# --- joins


@query(
    "join_inner",
    "select o_orderkey as id, n_name, c_mktsegment from orders, customer, nation where o_custkey = c_custkey and c_nationkey = n_nationkey",
)
def join_inner(fr):
    return (
        fr.orders.join(fr.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(fr.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("o_orderkey").alias("id"), "n_name", "c_mktsegment")
    )


@query(
    "join_left",
    """select s.id, f.max_quantity from stay s left join (select l_orderkey, max(l_quantity) as max_quantity from lineitem
         where l_returnflag = 'R' group by 1) f on s.id = f.l_orderkey""",
    "stay",
)
def join_left(fr):
    returned = fr.lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_quantity").alias("max_quantity"))
    return fr.stay.select("id").join(returned, "id", "left")


@query(
    "join_left_filtered",
    """select s.id, l.l_linenumber::double as line from stay s left join lineitem l
         on s.id = l.l_orderkey and l.l_returnflag = 'A' and l.l_shipdate is not null""",
    "stay",
)
def join_left_filtered(fr):
    """The filter belongs to the join: stays without a matching row stay."""
    kept = fr.lineitem.filter((F.col("l_returnflag") == "A") & F.col("l_shipdate").isNotNull())
    lines = kept.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("double").alias("line"))
    return fr.stay.select("id").join(lines, "id", "left")


@query(
    "join_time_bound",
    """select i.icustay_id, count(s.curr_service) as early from icustays i left join services s
         on i.hadm_id = s.hadm_id and s.transfertime < i.intime + interval 1 day group by 1""",
    "icustays services",
)
def join_time_bound(fr):
    """Left join with a bound on the time of the other side: matches are counted as they are joined, stays without one add 0."""
    until = F.col("intime") + F.expr("INTERVAL 1 DAY")
    times = fr.services.filter("curr_service is not null").select("hadm_id", "transfertime")
    matched = fr.icustays.select("icustay_id", "hadm_id", until.alias("until")).join(times, "hadm_id").filter("transfertime < until")
    rows = matched.select("icustay_id", F.lit(1).alias("n")).unionByName(fr.icustays.select("icustay_id", F.lit(0).alias("n")))
    return rows.groupBy("icustay_id").agg(F.sum("n").alias("early"))


RANGE_SQL = """
  select c.icustay_id, date_trunc('hour', min(charttime) + interval 59 minute) as first_hour,
    date_trunc('hour', max(charttime) + interval 59 minute) as last_hour
  from chartevents c join icustays i on c.icustay_id = i.icustay_id
    and c.charttime > i.intime - interval 12 hour and c.charttime < i.outtime + interval 12 hour
  where itemid in (211, 220045) group by 1"""


@query(
    "join_range",
    f"select icustay_id, epoch_us(first_hour) as first_us, epoch_us(last_hour) as last_us from ({RANGE_SQL})",
    "icustays chartevents",
)
def join_range(fr):
    """Events inside an open interval around each stay, reduced to first and last hour."""
    times = timestamp_source.signal_times(fr.chartevents, fr.icustays)
    us = {f"{n}_us": F.unix_micros(F.col(f"{n}_hour").cast("timestamp")) for n in ("first", "last")}
    return times.select("icustay_id", *[c.alias(n) for n, c in us.items()])


@query(
    "join_left_nullcount",
    """select s.site, count(*) as n_rows, count(*) filter (a.apachescore is null) as null_score from stay s
         left join (select * from apache where apacheversion = 'IVa') a on s.id = a.patientunitstayid group by 1""",
    "stay apache",
)
def join_left_nullcount(fr):
    scores = offset_source.severity_rows(fr.apache).select(F.col("patientunitstayid").alias("id"), F.col("apachescore").alias("score"))
    return null_counts(fr.stay.select("id", "site").join(scores, "id", "left"), ["site"], ["score"])


# --- stay order


@query("first_stay_rank", "select id, person, row_number() over (partition by person order by admit, id) as rank from stay", "stay")
def first_stay_rank(fr):
    """Number of each stay of a person."""
    return small_group_positions(fr.stay.select("id", "person", "admit"), ["person"], [F.col("admit").asc_nulls_last(), F.col("id")], "rank").drop("admit")


@query(
    "stay_rank_in_visit",
    """select patientunitstayid, row_number() over (partition by patienthealthsystemstayid
         order by hospitaladmitoffset, patientunitstayid) as rank from patient""",
    "patient",
)
def stay_rank_in_visit(fr):
    rows = fr.patient.select("patientunitstayid", "patienthealthsystemstayid", "hospitaladmitoffset")
    order = [F.col("hospitaladmitoffset").asc_nulls_last(), F.col("patientunitstayid")]
    return small_group_positions(rows, ["patienthealthsystemstayid"], order, "rank").select("patientunitstayid", "rank")


@query(
    "secondary_stay_flag",
    """select icustay_id, case when row_number() over (partition by subject_id order by intime nulls last, icustay_id) > 1
         then 1 else 0 end as secondary from icustays""",
    "icustays",
)
def secondary_stay_flag(fr):
    """Every stay of a person but the first; a minimum per person, no window."""
    return is_first(fr.icustays, ["subject_id"], ["intime"], "icustay_id").select("icustay_id", (1 - F.col("is_first")).alias("secondary"))


# --- aggregates per stay


@query(
    "stay_anchor",
    "select id, epoch_us(min(t)) as start_us, epoch_us(max(t)) as end_us from ev where measure = 'click' and v is not null group by id",
    "ev",
)
def stay_anchor(fr):
    seen = anchors(fr.ev, "id", "t", (F.col("measure") == "click") & F.col("v").isNotNull())
    return seen.select("id", *[F.unix_micros(F.col(c).cast("timestamp")).alias(f"{c}_us") for c in ("start", "end")])


def _offset_codes_sql() -> str:
    flags = ", ".join(
        f"bool_or(cplitemvalue in ({words(v)}))::int::double as {n}" for n, v in OFFSET_CODE_WORDS.items()
    )
    return f"""select c.patientunitstayid, i.chartoffset, i.* exclude (patientunitstayid, chartoffset) from cohort c left join (
        select patientunitstayid, cplitemoffset::double as chartoffset, {flags} from careplangeneral
        where cplgroup = 'Care Limitation' and cplitemvalue is not null group by 1, 2) i using (patientunitstayid)"""


COHORT_OFFSET_SQL = """
  cohort as (
    with icu as (
      select *, try_cast(nullif(replace(age, '>', ''), '') as int) as years from patient where contains(lower(unittype), 'icu')),
    ranked as (
      select *, row_number() over (partition by uniquepid order by hospitaladmityear nulls last, hospitaldischargeyear nulls last,
        years nulls last, patienthealthsystemstayid nulls last, hospitaladmitoffset nulls last, patientunitstayid) as stay_no from icu),
    beats as (
      select patientunitstayid, min(chartoffset) as t0, max(chartoffset) as t1 from pivoted_vital where heartrate is not null group by 1),
    risk as (select patientunitstayid, predictedhospitalmortality as pm from apache where apacheversion = 'IVa'),
    rowset as (
      select r.patientunitstayid, r.hospitalid, b.t0 as admitoffset, b.t1 as dischoffset,
        case when 'Expired' in (r.hospitaldischargestatus, r.unitdischargestatus) then 1 else 0 end as hospital_expire_flag,
        (b.t1 - b.t0) / 1440.0::double as icu_los, (r.hospitaldischargeoffset - b.t0) / 1440.0::double as hosp_los,
        case when r.unitdischargestatus = 'Expired' then (b.t1 - b.t0) / 60.0::double
          when r.hospitaldischargestatus = 'Expired' then (r.hospitaldischargeoffset - b.t0) / 60.0::double end as deathtime_hours,
        case when r.years < 16 then 1 else 0 end as exclusion_non_adult,
        case when b.t0 is null or (r.hospitaldischargestatus is null and r.unitdischargestatus is null) then 1 else 0 end as exclusion_bad_data,
        0 as exclusion_organ_donor,
        case when r.stay_no > 1 then 1 when k.pm = '' then null when try_cast(k.pm as double) > 0 then 0 else 1 end as exclusion_by_apache
      from ranked r left join beats b using (patientunitstayid) left join risk k using (patientunitstayid))
    select *, greatest(exclusion_non_adult, exclusion_bad_data, exclusion_organ_donor, exclusion_by_apache) as excluded from rowset)"""
OFFSET_FRAMES = "patient pivoted_vital apache"

STATIC_OFFSET_SQL = f"""codes as ({_offset_codes_sql()}),
  static as (
    select c.patientunitstayid, c.hospitalid, ceil((c.dischoffset - c.admitoffset) / 60.0::double) as dischtime_hours,
      c.deathtime_hours, c.hospital_expire_flag as death, coalesce(try_cast(a.actualventdays as int), 0) as ventdays,
      ceil((l.t - c.admitoffset) / 60.0::double) as censortime_hours,
      case when p.gender = 'Female' then 1 else 0 end as is_female,
      case p.age when '> 89' then 90.0::double when '' then null else p.age::double end as age,
      coalesce((p.ethnicity = 'African American')::int, 0) as race_black, coalesce((p.ethnicity = 'Hispanic')::int, 0) as race_hispanic,
      coalesce((p.ethnicity = 'Asian')::int, 0) as race_asian,
      coalesce((p.ethnicity not in ('African American', 'Hispanic', 'Asian'))::int, 0) as race_other,
      coalesce(v.electivesurgery, 0) as electivesurgery
    from cohort c join patient p using (patientunitstayid)
    left join (select patientunitstayid, min(chartoffset) as t from codes where dnr > 0 or cmo > 0 group by 1) l using (patientunitstayid)
    left join (select * from apache where apacheversion = 'IVa') a using (patientunitstayid)
    left join apachepredvar v using (patientunitstayid))"""
STATIC_FRAMES = OFFSET_FRAMES + " careplangeneral apachepredvar"


def offset_cohort(fr):
    return offset_source.cohort(fr.patient, fr.pivoted_vital, fr.apache)


def offset_static(fr, stays):
    codes = offset_source.code_status(stays, fr.careplangeneral)
    return offset_source.static_features(stays, fr.patient, codes, fr.apache, fr.apachepredvar)


def doubles(df, *columns, digits=6):
    """Nullable numbers as rounded doubles."""
    names = set(columns)
    return df.selectExpr(*[f"round(cast(`{c}` as double), {digits}) as `{c}`" if c in names else f"`{c}`" for c in df.columns])


def sql_doubles(*columns, digits=6) -> str:
    return ", ".join(f"round({c}::double, {digits}) as {c}" for c in columns)


NULLABLE_COHORT = ("admitoffset", "dischoffset", "icu_los", "hosp_los", "deathtime_hours", "exclusion_by_apache")


@query(
    "cohort_offset",
    f"with {COHORT_OFFSET_SQL} select * replace ({sql_doubles(*NULLABLE_COHORT)}) from cohort",
    OFFSET_FRAMES,
)
def cohort_offset(fr):
    """Cohort of the offset-time source."""
    return doubles(offset_cohort(fr), *NULLABLE_COHORT)


COHORT_TIMESTAMP_SQL = f"""
  cohort as (
    with beats as ({RANGE_SQL}),
    joined as (
      select i.*, a.* exclude (hadm_id), p.* exclude (subject_id), b.first_hour as h0, b.last_hour as h1,
        row_number() over (partition by i.subject_id order by i.intime nulls last, i.icustay_id) as stay_no,
        round(date_diff('day', p.dob, a.admittime::date) / 365.242::double, 4) as years
      from icustays i join admissions a using (hadm_id) join patients p using (subject_id) left join beats b using (icustay_id)),
    flagged as (
      select subject_id, hadm_id, icustay_id, (dbsource = 'metavision')::int as hospitalid, h0 as intime, h1 as outtime, years as age, gender, ethnicity,
        hospital_expire_flag, los as icu_los, epoch(dischtime - admittime) / 86400.0::double as hosp_los,
        ceil(epoch(deathtime - h0) / 3600.0::double) as deathtime_hours,
        (years <= 16)::int as exclusion_non_adult,
        (has_chartevents_data = 0 or intime is null or outtime is null or h0 is null or h1 is null)::int as exclusion_bad_data,
        (deathtime is not null and (lower(diagnosis) like '%organ donor%' or lower(diagnosis) like '%donor account%'))::int as exclusion_organ_donor,
        coalesce((stay_no > 1 or h1 - h0 <= interval 4 hour)::int, 0) as exclusion_by_apache
      from joined)
    select *, greatest(exclusion_non_adult, exclusion_bad_data, exclusion_organ_donor, exclusion_by_apache) as excluded from flagged)"""
TIMESTAMP_FRAMES = "icustays admissions patients chartevents"
TIMES = ("intime", "outtime")


def timestamp_cohort(fr, kept_only: bool = False):
    return timestamp_source.cohort(fr.icustays, fr.admissions, fr.patients, fr.chartevents, kept_only)


@query(
    "cohort_timestamp",
    f"""with {COHORT_TIMESTAMP_SQL} select * replace ({sql_doubles('icu_los', 'hosp_los', 'deathtime_hours')},
          epoch(intime) as intime, epoch(outtime) as outtime) from cohort""",
    TIMESTAMP_FRAMES,
)
def cohort_timestamp(fr):
    """Cohort of the timestamp source."""
    stays = doubles(timestamp_cohort(fr), "icu_los", "hosp_los", "deathtime_hours")
    return stays.withColumns({c: (F.unix_micros(F.col(c).cast("timestamp")) / 1e6) for c in TIMES})


CODE_FLAGS = ("chartoffset", *OFFSET_CODE_WORDS)


@query("code_status_flags", f"with {COHORT_OFFSET_SQL} {_offset_codes_sql()}", OFFSET_FRAMES + " careplangeneral")
def code_status_flags(fr):
    """Flags per (stay, time); stays without items keep an empty row."""
    return doubles(offset_source.code_status(offset_cohort(fr), fr.careplangeneral), *CODE_FLAGS)


def _timestamp_codes_sql() -> str:
    flags = ", ".join(f"max((value in ({words(v)}))::int) as {n}" for n, v in TIMESTAMP_CODE_WORDS.items())
    return f"""select i.icustay_id, c.* exclude (icustay_id) from icustays i left join (
        select icustay_id, charttime, {flags} from chartevents where itemid in (128, 223758) and value <> 'Other/Remarks'
          and error is distinct from 1 group by 1, 2) c using (icustay_id)"""


@query(
    "code_status_flags_timestamp",
    f"""with codes as ({_timestamp_codes_sql()}) select icustay_id, epoch(charttime) as charttime,
          {sql_doubles(*TIMESTAMP_CODE_WORDS)} from codes""",
    "icustays chartevents",
)
def code_status_flags_timestamp(fr):
    codes = doubles(timestamp_source.code_status(fr.icustays, fr.chartevents), *TIMESTAMP_CODE_WORDS)
    return codes.withColumn("charttime", F.unix_micros(F.col("charttime").cast("timestamp")) / 1e6)


@query(
    "censor_time",
    f"with {COHORT_OFFSET_SQL}, codes as ({_offset_codes_sql()}) select patientunitstayid, min(chartoffset)::bigint as censoroffset from codes where dnr > 0 or cmo > 0 group by 1",
    OFFSET_FRAMES + " careplangeneral",
)
def censor_time(fr):
    codes = offset_source.code_status(offset_cohort(fr), fr.careplangeneral)
    return first_limited(codes, "patientunitstayid", "chartoffset", ("cmo", "dnr"), "censoroffset").withColumn(
        "censoroffset", F.col("censoroffset").cast("bigint")
    )


SURGERY_SQL = """select i.icustay_id, coalesce(max((lower(s.curr_service) like '%surg%' or s.curr_service = 'ORTHO')::int), 0) as surgical
  from icustays i left join services s on i.hadm_id = s.hadm_id and s.transfertime < i.intime + interval 1 day group by 1"""


@query("surgery_flag", SURGERY_SQL, "icustays services")
def surgery_flag(fr):
    return timestamp_source.surgical(fr.icustays, fr.services)


VENT_SQL = "select icustay_id, least(ceil(sum(duration_hours) / 24)::int, 30) as ventdays from ventdurations group by 1"


@query("capped_duration", VENT_SQL, "ventdurations")
def capped_duration(fr):
    """Days of a summed duration, at most 30; unknown sums count as 30."""
    return capped_days(fr.ventdurations, "icustay_id", "duration_hours", 30, "ventdays")


STATIC_DOUBLES = ("dischtime_hours", "deathtime_hours", "censortime_hours", "age")


@query(
    "static_features",
    f"with {COHORT_OFFSET_SQL}, {STATIC_OFFSET_SQL} select * replace ({sql_doubles(*STATIC_DOUBLES)}) from static",
    STATIC_FRAMES,
)
def static_features(fr):
    """Static table of the offset-time source."""
    return doubles(offset_static(fr, offset_cohort(fr)), *STATIC_DOUBLES)


def _races_sql() -> str:
    return ", ".join(f"(a.ethnicity in ({words(v)}))::int as {n}" for n, v in TIMESTAMP_ETHNICITY.items())


STATIC_TIMESTAMP_SQL = f"""codes as ({_timestamp_codes_sql()}), surgery as ({SURGERY_SQL}), vent as ({VENT_SQL}),
  censored as (select icustay_id, min(charttime) as t from codes where greatest(cmo, dnr, dni, dncpr) > 0 group by 1),
  static as (
    select c.icustay_id, 0 as hospitalid, ceil(epoch(c.outtime - c.intime) / 3600.0::double) as dischtime_hours,
      ceil(epoch(a.deathtime - c.intime) / 3600.0::double) as deathtime_hours, (a.deathtime is not null)::int as death,
      coalesce(v.ventdays, 0) as ventdays, ceil(epoch(l.t - c.intime) / 3600.0::double) as censortime_hours,
      (p.gender = 'F')::int as is_female, least(round(date_diff('day', p.dob, c.intime::date) / 365.242::double, 4), 90) as age,
      {_races_sql()}, (a.admission_type = 'ELECTIVE' and s.surgical = 1)::int as electivesurgery
    from cohort c join icustays i using (icustay_id) join admissions a on a.hadm_id = c.hadm_id join patients p on p.subject_id = c.subject_id
    left join censored l using (icustay_id) left join surgery s using (icustay_id) left join vent v using (icustay_id))"""


def timestamp_static(fr, stays, icustays=None, chartevents=None):
    """Static table of ``stays``; the tables of stays and events may be given cut to their keys."""
    icustays = fr.icustays if icustays is None else icustays
    codes = timestamp_source.code_status(icustays, fr.chartevents if chartevents is None else chartevents)
    return timestamp_source.static_features(stays, icustays, fr.admissions, fr.patients, codes, fr.services, fr.ventdurations)


@query(
    "static_features_timestamp",
    f"with {COHORT_TIMESTAMP_SQL}, {STATIC_TIMESTAMP_SQL} select * replace ({sql_doubles(*STATIC_DOUBLES)}) from static",
    TIMESTAMP_FRAMES + " services ventdurations",
)
def static_features_timestamp(fr):
    """Static table of the timestamp source."""
    return doubles(timestamp_static(fr, timestamp_cohort(fr)), *STATIC_DOUBLES)


@query(
    "severity_table",
    f"""with {COHORT_OFFSET_SQL} select p.patientunitstayid, p.hospitalid, a.apachescore::double as apachescore, a.predictedhospitalmortality
        from cohort c join patient p using (patientunitstayid) left join (select * from apache where apacheversion = 'IVa') a using (patientunitstayid)
        where c.excluded = 0""",
    OFFSET_FRAMES,
)
def severity_table(fr):
    return doubles(offset_source.severity_table(offset_cohort(fr), fr.patient, fr.apache), "apachescore")


SITE_MEANS = ("frac_mortality", "age", "race_black", "race_hispanic", "race_asian", "electivesurgery", "is_female", "apachescore")


@query(
    "site_summary",
    f"""with {COHORT_OFFSET_SQL}, {STATIC_OFFSET_SQL} select h.hospitalid, h.numbedscategory, h.teachingstatus, h.region, count(*) as num_pat,
          round(avg(c.hospital_expire_flag), 6) as frac_mortality, {", ".join(f"round(avg({m}), 6) as {m}" for m in SITE_MEANS[1:])}
        from cohort c join hospital h on h.hospitalid = c.hospitalid join static s using (patientunitstayid)
        left join (select patientunitstayid, apachescore from apache where apacheversion = 'IVa') a using (patientunitstayid)
        where c.excluded = 0 group by 1, 2, 3, 4""",
    STATIC_FRAMES + " hospital",
)
def site_summary(fr):
    """Size, mortality and patient mix per hospital."""
    stays = offset_cohort(fr)
    table = offset_source.site_table(fr.hospital, stays, offset_static(fr, stays), fr.apache)
    return table.withColumns({m: r6(m) for m in SITE_MEANS})


