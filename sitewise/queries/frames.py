"""Role frames: the given tables read as stays, events, predictions and source tables.

A frame is one SELECT.  Spark and the reference SQL use the same text; only the few
functions in ``Dialect`` are spelled differently.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sitewise.session import prepare
from sitewise.sources.tables import read_table

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels",
)


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def json_int(self, column: str, field: str) -> str:
        get = "get_json_object" if self.spark else "json_extract_string"
        return f"cast({get}({column}, '$.{field}') as int)"

    def add(self, unit: str, n: str, ts: str) -> str:
        if self.spark:
            return f"timestampadd({unit}, cast({n} as int), {ts})"
        return f"({ts} + to_{unit.lower()}s(cast({n} as int)))"

    def add_days(self, n: str, date: str) -> str:
        return f"date_add({date}, cast({n} as int))" if self.spark else f"({date} + cast({n} as int))"


def _measured(columns: str, start: int = 0) -> str:
    """Test values for a list of measurement columns, some of them missing."""
    return ", ".join(
        f"case when (k + {i}) % 4 = 0 then null else v + {i} end as {c}"
        for i, c in enumerate(columns.split(), start)
    )


VITAL_COLUMNS = "heartrate sysbp diasbp meanbp resprate tempc spo2 glucose"
GAS_COLUMNS = "po2 pco2 pao2fio2ratio ph baseexcess totalco2 glucose bicarbonate calcium hematocrit hemoglobin lactate potassium sodium"
LAB_COLUMNS = "glucose albumin bands bicarbonate bilirubin bun creatinine hematocrit hemoglobin inr lactate platelet potassium sodium wbc"
OFFSET_VITALS = "heartrate ibp_systolic nibp_systolic ibp_diastolic nibp_diastolic map ibp_mean nibp_mean respiratoryrate temperature o2saturation gcs"
OFFSET_GAS = "pao2 paco2 fio2 ph baseexcess"
OFFSET_LABS = "glucose albumin bands hco3 bilirubin bun calcium creatinine hematocrit hemoglobin inr lactate platelets potassium sodium wbc"


def _frames(d: Dialect) -> dict[str, str]:
    k = d.json_int("props", "k")
    return {
        # --- stays: orders of customers, sites are nations
        "stay": """
            select o_orderkey as id, o_custkey as person, c_nationkey as site, o_orderdate as admit,
              o_orderstatus as status, o_orderpriority as kind, c_mktsegment as grp,
              o_totalprice as price, c_acctbal as balance,
              case when o_orderstatus = 'F' then 1 else 0 end as y,
              cast(ceil(o_totalprice / 2500) as bigint) as disch_h,
              case when o_orderstatus = 'F' then cast(ceil(o_totalprice / 2500) as bigint) end as death_h,
              case when o_orderpriority = '1-URGENT'
                then cast(floor(ceil(o_totalprice / 2500) * 0.6) as bigint) end as censor_h,
              case when o_orderkey % 50 = 0 then '' when o_orderkey % 20 = 0 then '> 89'
                else cast(10 + o_orderkey % 80 as string) end as age_txt
            from {orders} join {customer} on o_custkey = c_custkey""",
        "flagged": """
            select id, site, person, y, kind, status,
              case when id % 80 < 6 then 1 else 0 end as exclusion_age,
              case when status = 'P' and kind = '5-LOW' then 1 else 0 end as exclusion_status,
              case when id % 37 = 0 then null when price > 300000 then 1 else 0 end as exclusion_price,
              case when disch_h >= 24 then 24 end as windowtime_hours
            from {stay}""",
        # --- events of users
        "ev": f"""
            select event_id, user_id as id, user_id - user_id % 2 as visit, ts as t, event_type as measure,
              value as v, {k} as k, case when {k} % 3 = 0 then null else {k} end as x
            from {{events}}""",
        # --- scored rows
        "pred": """
            select s_nationkey as site, case when l_returnflag = 'R' then 1 else 0 end as y,
              l_quantity / 51 as p, (l_quantity + 200 * l_discount) / 72 as p2
            from {lineitem} join {supplier} on l_suppkey = s_suppkey""",
        # --- model inputs
        "feat": """
            select id, site, y, admit, kind, price as x1, balance as x2,
              cast(nullif(id % 7, 0) as double) + 1.5 * y as x3,
              case when site % 5 = 0 then null else cast(id % 11 as double) end as x4
            from {stay}""",
        "nationmodel": """
            select n_nationkey as model_id, cast(-0.5 + 0.02 * n_nationkey as double) as b,
              cast(0.1 * ((n_nationkey * 3) % 7 - 3) + 0.0171 as double) as w1,
              cast(0.1 * ((n_nationkey * 4) % 7 - 3) as double) as w2,
              cast(0.1 * ((n_nationkey * 5) % 7 - 3) as double) as w3,
              cast(0.1 * ((n_nationkey * 6) % 7 - 3) as double) as w4
            from {nation}""",
        # --- timestamp source, events as measurements
        "t_stay": """
            select id as icustay_id, visit as hadm_id, id as subject_id,
              date_trunc('hour', min(t) + interval '59' minute) as intime,
              date_trunc('hour', max(t) + interval '59' minute) as outtime,
              case when id % 10 = 3 then 1 else 0 end as excluded
            from {ev} where measure = 'click' group by id, visit""",
        "t_stay_day": """
            select id as icustay_id, visit as hadm_id, id as subject_id,
              date_trunc('day', min(t) + interval '1439' minute) as intime,
              date_trunc('day', max(t) + interval '1439' minute) as outtime,
              case when id % 10 = 3 then 1 else 0 end as excluded
            from {ev} where measure = 'click' group by id, visit""",
        "t_vital": f"select id as icustay_id, t as charttime, {_measured(VITAL_COLUMNS)} from {{ev}} where measure = 'click'",
        "t_gcs": "select id as icustay_id, t as charttime, cast(k % 13 + 3 as double) as gcs from {ev} where measure = 'view'",
        "t_uo": "select id as icustay_id, t as charttime, case when k % 6 = 0 then null else v end as urineoutput from {ev} where measure = 'purchase'",
        "t_bg": f"select visit as hadm_id, t as charttime, {_measured(GAS_COLUMNS, 1)} from {{ev}} where measure = 'signup'",
        "t_lab": f"select visit as hadm_id, t as charttime, {_measured(LAB_COLUMNS, 2)} from {{ev}} where measure = 'error'",
        # --- timestamp source, orders as stays
        "icustays": f"""
            select o_custkey as subject_id, o_orderkey as hadm_id, o_orderkey + 200000000 as icustay_id,
              case when o_orderkey % 101 = 0 then null else o_orderdate end as intime,
              {d.add('HOUR', 'ceil(o_totalprice / 2500)', 'o_orderdate')} as outtime,
              o_totalprice / 50000 as los,
              case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'metavision' else 'carevue' end as dbsource
            from {{orders}}""",
        "admissions": f"""
            select o_orderkey as hadm_id, {d.add('HOUR', '-5', 'o_orderdate')} as admittime,
              {d.add('HOUR', 'ceil(o_totalprice / 1500)', 'o_orderdate')} as dischtime,
              case when o_orderstatus = 'F' then {d.add('MINUTE', 'ceil(o_totalprice / 50)', 'o_orderdate')} end as deathtime,
              case c_mktsegment when 'AUTOMOBILE' then 'BLACK/HAITIAN' when 'BUILDING' then 'WHITE'
                when 'MACHINERY' then 'HISPANIC/LATINO - CUBAN' when 'HOUSEHOLD' then 'ASIAN - THAI' else 'PORTUGUESE' end as ethnicity,
              case when o_orderkey % 17 = 0 then 'Organ Donor / transplant' when o_orderkey % 19 = 0 then 'DONOR ACCOUNT' else 'SEPSIS' end as diagnosis,
              case when o_orderpriority = '3-MEDIUM' then 'ELECTIVE' else 'EMERGENCY' end as admission_type,
              case when o_orderstatus = 'F' then 1 else 0 end as hospital_expire_flag,
              case when o_orderkey % 53 = 0 then 0 else 1 end as has_chartevents_data
            from {{orders}} join {{customer}} on o_custkey = c_custkey""",
        "patients": f"""
            select c_custkey as subject_id, case when c_custkey % 2 = 0 then 'F' else 'M' end as gender,
              {d.add_days('c_custkey % 30000', "date '1915-03-01'")} as dob
            from {{customer}}""",
        "chartevents": f"""
            select l_orderkey + 200000000 as icustay_id,
              {d.add('MINUTE', '(l_partkey * 7 + l_suppkey * 13) % 9000 - 1500', 'o_orderdate')} as charttime,
              case l_returnflag when 'R' then 211 when 'A' then 220045 else 128 end as itemid,
              case l_linenumber when 1 then 'Full Code' when 2 then 'Comfort measures only' when 3 then 'DNR / DNI'
                when 4 then 'CPR Not Indicate' when 5 then 'Other/Remarks' when 6 then null else 'Do Not Intubate' end as value,
              case when l_partkey % 9 = 0 then 1 when l_partkey % 9 = 1 then 0 end as error
            from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey""",
        "services": f"""
            select l_orderkey as hadm_id, {d.add('HOUR', 'l_partkey % 60 - 10', 'o_orderdate')} as transfertime,
              case l_linenumber when 1 then 'MED' when 2 then 'NSURG' when 3 then 'ORTHO' when 4 then 'TSURG' else 'CMED' end as curr_service
            from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey""",
        "ventdurations": """
            select l_orderkey + 200000000 as icustay_id,
              case when l_linestatus = 'F' and l_linenumber > 3 then null else l_quantity * 4 end as duration_hours
            from {lineitem} where l_returnflag = 'A'""",
        "timed": f"""
            select l_orderkey + 200000000 as icustay_id, l_orderkey as hadm_id,
              {d.add('MINUTE', '(l_partkey * 7 + l_suppkey * 13) % 9000 - 1500', 'o_orderdate')} as charttime,
              l_quantity as v, l_partkey % 100 as k, l_returnflag, l_linenumber
            from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey""",
        "s_vital": f"select icustay_id, charttime, {_measured(VITAL_COLUMNS)} from {{timed}}",
        "s_gcs": "select icustay_id, charttime, cast(k % 13 + 3 as double) as gcs from {timed} where l_linenumber > 3",
        "s_uo": "select icustay_id, charttime, case when k % 6 = 0 then null else v end as urineoutput from {timed} where l_returnflag = 'A'",
        "s_bg": f"select hadm_id, charttime, {_measured(GAS_COLUMNS, 1)} from {{timed}} where l_returnflag = 'R'",
        "s_lab": f"select hadm_id, charttime, {_measured(LAB_COLUMNS, 2)} from {{timed}} where l_returnflag = 'N'",
        "s_score": "select o_orderkey + 200000000 as icustay_id, cast(floor(o_totalprice / 6000) as int) as apsiii from {orders} where o_orderkey % 7 <> 2",
        # --- offset source: orders as stays, line items as measurements
        "patient": """
            select o_orderkey as patientunitstayid, o_custkey * 10 + o_orderkey % 2 as patienthealthsystemstayid,
              cast(o_custkey as string) as uniquepid, c_nationkey as hospitalid,
              cast(-(o_orderkey % 3000) as int) as hospitaladmitoffset,
              cast(floor(o_totalprice / 20) as int) as hospitaldischargeoffset,
              case o_orderstatus when 'F' then 'Expired' when 'O' then 'Alive' end as hospitaldischargestatus,
              case when o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH') then 'Expired'
                when o_orderpriority = '5-LOW' then null else 'Alive' end as unitdischargestatus,
              cast(extract(year from o_orderdate) as int) as hospitaladmityear,
              cast(extract(year from o_orderdate) + o_orderkey % 2 as int) as hospitaldischargeyear,
              case when o_orderkey % 50 = 0 then '' when o_orderkey % 20 = 0 then '> 89'
                else cast(10 + o_orderkey % 80 as string) end as age,
              case when o_custkey % 2 = 0 then 'Female' else 'Male' end as gender,
              case c_mktsegment when 'AUTOMOBILE' then 'African American' when 'BUILDING' then 'Caucasian'
                when 'MACHINERY' then 'Hispanic' when 'HOUSEHOLD' then 'Asian' end as ethnicity,
              case o_orderpriority when '3-MEDIUM' then 'Step-Down Unit' when '4-NOT SPECIFIED' then 'Med-Surg ICU' else 'CCU-CTICU' end as unittype
            from {orders} join {customer} on o_custkey = c_custkey""",
        "item": """
            select l_orderkey as patientunitstayid, cast((l_partkey * 7 + l_suppkey * 13) % 4000 - 200 as int) as chartoffset,
              l_quantity as v, l_partkey % 100 as k, l_returnflag, l_linestatus, l_linenumber
            from {lineitem}""",
        "pivoted_vital": f"select patientunitstayid, chartoffset, {_measured(OFFSET_VITALS)} from {{item}}",
        "pivoted_uo": "select patientunitstayid, chartoffset, case when k % 6 = 0 then null else v end as urineoutput from {item} where l_returnflag = 'A'",
        "pivoted_bg": f"select patientunitstayid, chartoffset, {_measured(OFFSET_GAS, 1)} from {{item}} where l_returnflag = 'R'",
        "pivoted_lab": f"select patientunitstayid, chartoffset, {_measured(OFFSET_LABS, 2)} from {{item}} where l_returnflag = 'N'",
        "careplangeneral": """
            select patientunitstayid, chartoffset as cplitemoffset,
              case when l_linestatus = 'O' then 'Care Limitation' else 'Nutrition' end as cplgroup,
              case l_linenumber when 1 then 'Do not resuscitate' when 2 then 'Comfort measures only' when 3 then 'Full therapy'
                when 4 then 'No CPR' when 5 then null else 'No blood draws' end as cplitemvalue
            from {item}""",
        "apache": """
            select o_orderkey as patientunitstayid, case when o_orderkey % 6 = 0 then 'IV' else 'IVa' end as apacheversion,
              cast(floor(o_totalprice / 5000) as int) as apachescore,
              cast(floor(o_totalprice / 6000) as int) as acutephysiologyscore,
              case when o_orderkey % 11 = 0 then '' when o_orderkey % 13 = 0 then '-1'
                else '0.' || cast(10 + o_orderkey % 90 as string) end as predictedhospitalmortality,
              cast(o_orderkey % 31 as string) as actualventdays
            from {orders}""",
        "apachepredvar": """
            select o_orderkey as patientunitstayid, case when o_orderkey % 5 = 0 then 1 else 0 end as electivesurgery
            from {orders} where o_orderstatus <> 'P'""",
        "hospital": """
            select n_nationkey as hospitalid,
              case n_nationkey % 4 when 1 then '<100' when 2 then '100 - 249' when 3 then '>= 500' end as numbedscategory,
              case when n_nationkey % 3 = 0 then 't' else 'f' end as teachingstatus, r_name as region
            from {nation} join {region} on n_regionkey = r_regionkey""",
        "siteinfo": """
            select h.hospitalid as site, h.numbedscategory, h.teachingstatus, h.region, s.n, s.rate, s.mean_price, s.mean_balance
            from {hospital} h join (select site, count(*) as n, avg(cast(y as double)) as rate, avg(price) as mean_price,
              avg(balance) as mean_balance from {stay} group by site) s on h.hospitalid = s.site""",
    }


SPARK_FRAMES = _frames(Dialect(spark=True))
SQL_FRAMES = _frames(Dialect(spark=False))


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


class Frames:
    """Tables and role frames of one folder as attributes."""

    def __init__(self, spark: SparkSession, root: str):
        prepare(spark)
        self.spark = spark
        self.root = root

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            found = read_table(self.spark, self.root, name)
        elif name in SPARK_FRAMES:
            text = SPARK_FRAMES[name]
            found = self.spark.sql(text, **{n: getattr(self, n) for n in _needs(text)})
        else:
            raise AttributeError(name)
        setattr(self, name, found)
        return found


def with_frames(names: list[str], sql: str) -> str:
    """``sql`` with the named frames and the frames they need as common table expressions."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        for need in _needs(SQL_FRAMES[name]):
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in ordered:
        text = SQL_FRAMES[name]
        parts.append(f"{name} as ({text.format(**{n: n for n in _needs(text)})})")
    body = sql.strip()
    if not parts:
        return body
    if body[:15].lower() == "with recursive ":
        return "with recursive " + ",\n".join(parts) + ",\n" + body[15:]
    if body[:5].lower() == "with ":
        return "with " + ",\n".join(parts) + ",\n" + body[5:]
    return "with " + ",\n".join(parts) + "\n" + body
