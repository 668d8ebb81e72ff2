"""Filters, flags, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions.scalar import (
    age_years,
    flag,
    hash_uniform,
    hour_ceil_59,
    hours_between,
    last_match,
    metric_bucket,
    neglog_complement,
    parse_number,
    r6,
    safe_ratio,
)
from sitewise.operators.cohort import attrition_report, drop_excluded, excluded
from sitewise.operators.features import front_columns, select_features
from sitewise.operators.metrics import evaluate
from sitewise.operators.prep import known_counts
from sitewise.operators.summary import drop_reference_dummies, large_sites, rows_of_large_sites
from sitewise.operators.joins import other_rows
from sitewise.operators.timeseries import limit_hours
from sitewise.queries.registry import query
from sitewise.queries.sqltext import AUC
from sitewise.sources.tables import query_tables


@query("scan_filter_sql", "select o_orderkey as id, o_totalprice as price from orders where o_orderstatus = 'F' and o_totalprice > 100000")
def scan_filter_sql(fr):
    """Table read by SQL text."""
    text = "select o_orderkey as id, o_totalprice as price from {orders} where o_orderstatus = 'F' and o_totalprice > 100000"
    return query_tables(fr.spark, fr.root, text, ["orders"])


@query("filter_like_ci", "select id, grp from stay where lower(grp) like '%machin%'", "stay")
def filter_like_ci(fr):
    return fr.stay.filter(F.lower("grp").contains("machin")).select("id", "grp")


@query("filter_eq_notnull", "select id, censor_h from stay where status = 'F' and censor_h is not null", "stay")
def filter_eq_notnull(fr):
    return fr.stay.filter((F.col("status") == "F") & F.col("censor_h").isNotNull()).select("id", "censor_h")


@query("null_safe_filter", "select event_id, cast(x as double) as x from ev where x is distinct from 1", "ev")
def null_safe_filter(fr):
    return fr.ev.filter(~F.col("x").eqNullSafe(F.lit(1))).select("event_id", F.col("x").cast("double").alias("x"))


@query(
    "in_list_flags",
    """select id, case when kind in ('1-URGENT', '2-HIGH') then 1 else 0 end as is_fast,
         case when nullif(kind, '5-LOW') not in ('1-URGENT', '2-HIGH') then 1 else 0 end as is_slow
       from stay""",
    "stay",
)
def in_list_flags(fr):
    fast = ("1-URGENT", "2-HIGH")
    known = F.nullif(F.col("kind"), F.lit("5-LOW"))
    return fr.stay.select("id", flag(F.col("kind").isin(*fast)).alias("is_fast"), flag(~known.isin(*fast)).alias("is_slow"))


@query(
    "compound_predicate",
    """select id from stay where (lower(grp) like '%auto%' and death_h is not null)
         or (lower(grp) like '%house%' and death_h is not null)""",
    "stay",
)
def compound_predicate(fr):
    grp, died = F.lower("grp"), F.col("death_h").isNotNull()
    return fr.stay.filter((grp.contains("auto") & died) | (grp.contains("house") & died)).select("id")


@query(
    "case_flags",
    """select id, case when status = 'F' then 1.0::double when status = 'P' then null else 0 end as closed,
         case when grp = 'BUILDING' then 1 else 0 end as building, case when price < 50000 then 1 else 0 end as small
       from stay""",
    "stay",
)
def case_flags(fr):
    closed = F.when(F.col("status") == "F", 1).when(F.col("status") == "P", None).otherwise(0)
    return fr.stay.select(
        "id", closed.cast("double").alias("closed"), flag(F.col("grp") == "BUILDING").alias("building"), flag(F.col("price") < 50000).alias("small")
    )


@query("exclusion_greatest", "select id, greatest(exclusion_age, exclusion_status, exclusion_price) as excluded from flagged", "flagged")
def exclusion_greatest(fr):
    """Highest flag, unknown flags skipped."""
    return fr.flagged.select("id", excluded(["exclusion_age", "exclusion_status", "exclusion_price"]).alias("excluded"))


@query(
    "drop_excluded",
    """select id, site, y from flagged where coalesce(exclusion_age, 0) <> 1 and coalesce(exclusion_status, 0) <> 1
         and coalesce(exclusion_price, 0) <> 1 and windowtime_hours is not null""",
    "flagged",
)
def drop_excluded_query(fr):
    return drop_excluded(fr.flagged).select("id", "site", "y")


@query(
    "attrition_report",
    """with f as (select coalesce(exclusion_age = 1, false) as a, coalesce(exclusion_status = 1, false) as b,
           coalesce(exclusion_price = 1, false) as c, windowtime_hours is null as w from flagged),
         t as (select count(*) as total from flagged),
         s as (select 0 as step, 'flagged exclusion_age' as label, (select count(*) from f where a) as n
           union all select 1, 'flagged exclusion_status', (select count(*) from f where b)
           union all select 2, 'flagged exclusion_price', (select count(*) from f where c)
           union all select 3, 'flagged at all', (select count(*) from f where a or b or c)
           union all select 4, 'without a window', (select count(*) from f where not (a or b or c) and w)
           union all select 5, 'kept', (select count(*) from f where not (a or b or c or w)))
       select step, label, n, round(100.0::double * n / total, 6) as pct from s, t""",
    "flagged",
)
def attrition_report_query(fr):
    return attrition_report(fr.flagged).withColumn("pct", r6("pct"))


@query(
    "fixed_window_eligibility",
    "select id, least(censor_h, death_h, disch_h) as limit_h from stay where least(censor_h, death_h, disch_h) >= 24",
    "stay",
)
def fixed_window_eligibility(fr):
    limit = limit_hours(["censor_h", "death_h", "disch_h"])
    return fr.stay.filter(limit >= 24).select("id", limit.alias("limit_h"))


@query("feature_select", "select id, round(x1, 6) as x1, round(x2, 6) as x2, x3, x4 from feat", "feat")
def feature_select(fr):
    """Inputs by exclusion of outcomes, names, prefixes and suffixes."""
    wide = fr.feat.withColumns({"race_a": F.lit(1), "x1_min": F.col("x1"), "x1_max": F.col("x1"), "electivesurgery": F.lit(0)})
    inputs = select_features(wide.columns, ["site", "y", "admit", "kind"], ["electivesurgery"], ["race_"], ["_min", "_max"])
    return wide.select(*inputs).withColumns({"x1": r6("x1"), "x2": r6("x2")})


@query("reorder_columns", "select site, y, id, x3, x4 from feat", "feat")
def reorder_columns(fr):
    return front_columns(fr.feat.select("id", "x3", "site", "x4", "y"), ["site", "y"])


@query("drop_rename", "select site, y, round(p2, 6) as p from pred", "pred")
def drop_rename(fr):
    """A second score takes the place of the first."""
    return fr.pred.drop("p").withColumnRenamed("p2", "p").withColumn("p", r6("p"))


@query(
    "union_tag_source",
    """select case when site <= 1 then 'A' else 'B' end as db, cast(site as bigint) as site, round(x1, 6) as x1, round(price, 6) as price from (
         select site, x1, null::double as price from feat union all by name select site, price, null::double as x1 from stay)""",
    "feat stay",
)
def union_tag_source(fr):
    """Tables with different columns under each other, tagged by source."""
    both = fr.feat.select("site", "x1").unionByName(fr.stay.select("site", "price"), allowMissingColumns=True)
    tag = F.when(F.col("site") <= 1, "A").otherwise("B")
    return both.select(tag.alias("db"), F.col("site").cast("bigint").alias("site"), r6("x1").alias("x1"), r6("price").alias("price"))


@query(
    "label_precedence",
    """select id, case when id % 5 = 0 then 'five' when id % 3 = 0 then 'three' when id % 2 = 0 then 'two' else 'none' end as label from stay""",
    "stay",
)
def label_precedence(fr):
    """The last matching rule names the row."""
    rules = [(F.col("id") % 2 == 0, "two"), (F.col("id") % 3 == 0, "three"), (F.col("id") % 5 == 0, "five")]
    return fr.stay.select("id", last_match("none", rules).alias("label"))


@query(
    "metric_bucket",
    f"""with {AUC('pred', 'site', 'y', 'p2')}
        select site, case when auc >= 0.5 and auc < 0.51 then 'medium' when auc >= 0.51 and auc < 1.0 then 'high' else 'low' end as bucket from auc""",
    "pred",
)
def metric_bucket_query(fr):
    """Named ranges; a value on the outer edge keeps the default."""
    ranges = [("low", 0.0, 0.5), ("medium", 0.5, 0.51), ("high", 0.51, 1.0)]
    return evaluate(fr.pred, ["site"], "y", "p2").select("site", metric_bucket("auc", ranges, "low").alias("bucket"))


@query(
    "dummy_drop_reference",
    """select hospitalid, case when teachingstatus = 't' then 1 else 0 end as teachingstatus,
         cast(region is not distinct from 'AMERICA' as int) as "region_AMERICA", cast(region is not distinct from 'ASIA' as int) as "region_ASIA",
         cast(region is not distinct from 'EUROPE' as int) as "region_EUROPE", cast(region is not distinct from 'MIDDLE EAST' as int) as "region_MIDDLE EAST",
         cast(numbedscategory = '<100' and numbedscategory is not null as int) as "numbedscategory_<100",
         cast(numbedscategory = '100 - 249' and numbedscategory is not null as int) as "numbedscategory_100 - 249",
         cast(numbedscategory = '>= 500' and numbedscategory is not null as int) as "numbedscategory_>= 500"
       from hospital where (select mode(coalesce(numbedscategory, 'null')) from hospital) = 'null'
         and (select level from (select coalesce(region, 'null') as level, count(*) as n from hospital group by 1 order by 2 desc, 1 limit 1)) = 'AFRICA'""",
    "hospital",
)
def dummy_drop_reference(fr):
    """0/1 columns per level of two columns, the most frequent level of each left out."""
    bool_status = fr.hospital.withColumn("teachingstatus", flag(F.col("teachingstatus") == "t"))
    return drop_reference_dummies(bool_status, "numbedscategory", "region")


@query("semi_min_group", "select id, site from stay where site in (select site from stay group by site having count(*) >= 600)", "stay")
def semi_min_group(fr):
    """Rows of sites that reach a size."""
    return rows_of_large_sites(fr.stay, "site", 600).select("id", "site")


@query("anti_groups", "select id, site from stay where site not in (select site from stay group by site having count(*) >= 600)", "stay")
def anti_groups(fr):
    return other_rows(fr.stay, large_sites(fr.stay, "site", 600), ["site"]).select("id", "site")


# --- scalar functions


@query(
    "parse_age",
    """select id, try_cast(nullif(trim(replace(age_txt, '>', '')), '') as int)::double as age,
         case when age_txt = '> 89' then 90.0::double when age_txt = '' then null else cast(age_txt as double) end as age90
       from stay""",
    "stay",
)
def parse_age(fr):
    age90 = F.when(F.col("age_txt") == "> 89", 90.0).otherwise(parse_number("age_txt", "double"))
    return fr.stay.select("id", parse_number("age_txt").cast("double").alias("age"), age90.alias("age90"))


@query(
    "cast_columns",
    """select id, cast(y as smallint) as y_small, cast(floor(price) as bigint) as price_whole, strftime(admit, '%Y-%m-%d') as admit_day,
         cast(id as varchar) as id_text from stay""",
    "stay",
)
def cast_columns(fr):
    return fr.stay.select(
        "id",
        F.col("y").cast("smallint").alias("y_small"),
        F.floor("price").cast("bigint").alias("price_whole"),
        F.col("admit").cast("date").cast("string").alias("admit_day"),
        F.col("id").cast("string").alias("id_text"),
    )


@query("coalesce_sources", "select event_id, coalesce(x, nullif(k, 3), -1) as first_known, coalesce(x, k) as x_or_k from ev", "ev")
def coalesce_sources(fr):
    return fr.ev.select(
        "event_id",
        F.coalesce("x", F.nullif(F.col("k"), F.lit(3)), F.lit(-1)).alias("first_known"),
        F.coalesce("x", "k").alias("x_or_k"),
    )


@query("clip_const", "select id, least(censor_h, 30) as capped, greatest(disch_h, 4) as at_least from stay", "stay")
def clip_const(fr):
    """A missing value takes the limit."""
    return fr.stay.select("id", F.least("censor_h", F.lit(30)).alias("capped"), F.greatest("disch_h", F.lit(4)).alias("at_least"))


@query(
    "ceil_hours",
    """select event_id, cast(ceil(v / 3) as bigint) as up, cast(floor(v / 3) as bigint) as down, round(v / 7, 4) as four from ev""",
    "ev",
)
def ceil_hours(fr):
    return fr.ev.select("event_id", F.ceil(F.col("v") / 3).alias("up"), F.floor(F.col("v") / 3).alias("down"), F.round(F.col("v") / 7, 4).alias("four"))


@query("hour_ceil_59", "select event_id, epoch_us(date_trunc('hour', t + interval 59 minute)) as hour_us from ev", "ev")
def hour_ceil_59_query(fr):
    """Hour that contains the time 59 minutes later."""
    return fr.ev.select("event_id", F.unix_micros(hour_ceil_59("t").cast("timestamp")).alias("hour_us"))


@query(
    "interval_filter",
    "select event_id from ev where t > timestamp '2024-01-10 00:00:00' - interval 12 hour and t < timestamp '2024-01-20 00:00:00' + interval 12 hour",
    "ev",
)
def interval_filter(fr):
    lo, hi = (F.expr(f"timestamp_ntz '{day} 00:00:00' {sign} INTERVAL 12 HOURS") for day, sign in (("2024-01-10", "-"), ("2024-01-20", "+")))
    return fr.ev.filter((F.col("t") > lo) & (F.col("t") < hi)).select("event_id")


@query(
    "epoch_diff_hours",
    """select icustay_id, round(epoch_us(outtime) / 3600e6 - epoch_us(intime) / 3600e6, 6) as hours,
         cast(ceil((epoch_us(outtime) - epoch_us(intime)) / 86400e6) as bigint) as days from t_stay""",
    "t_stay",
)
def epoch_diff_hours(fr):
    h = hours_between("outtime", "intime")
    return fr.t_stay.select("icustay_id", r6(h).alias("hours"), F.ceil(h / 24).alias("days"))


@query(
    "age_years",
    """select a.hadm_id, round(date_diff('day', p.dob, cast(a.admittime as date)) / 365.242::double, 4) as age
       from icustays i join admissions a using (hadm_id) join patients p using (subject_id)""",
    "icustays admissions patients",
)
def age_years_query(fr):
    joined = fr.icustays.join(fr.admissions, "hadm_id").join(fr.patients, "subject_id")
    return joined.select("hadm_id", age_years(F.col("admittime").cast("date"), "dob").alias("age"))


@query(
    "offset_to_days",
    """select patientunitstayid, round(hospitaldischargeoffset / 60.0::double / 24.0::double, 6) as days,
         round((hospitaldischargeoffset - hospitaladmitoffset) / 60.0::double, 6) as hours from patient""",
    "patient",
)
def offset_to_days(fr):
    return fr.patient.select(
        "patientunitstayid",
        r6(F.col("hospitaldischargeoffset") / 60.0 / 24.0).alias("days"),
        r6((F.col("hospitaldischargeoffset") - F.col("hospitaladmitoffset")) / 60.0).alias("hours"),
    )


@query("safe_ratio", "select event_id, case when k <> 0 then round(v / k, 9) end as ratio, round(v / nullif(x, 0), 9) as ratio_x from ev", "ev")
def safe_ratio_query(fr):
    return fr.ev.select("event_id", F.round(safe_ratio("v", "k"), 9).alias("ratio"), F.round(safe_ratio("v", "x"), 9).alias("ratio_x"))


@query("hash_uniform", "select id, round(('0x' || substr(md5(id || '|11'), 1, 8))::bigint / 4294967296.0::double, 9) as u from stay", "stay")
def hash_uniform_query(fr):
    """Seeded uniform number per key."""
    return fr.stay.select("id", F.round(hash_uniform("id", 11), 9).alias("u"))


@query("neglog_complement", "select site, y, round(ln(1 / (1 - p)), 6) as x from pred", "pred")
def neglog_complement_query(fr):
    return fr.pred.select("site", "y", r6(neglog_complement("p")).alias("x"))


@query(
    "nonmissing_count",
    "select site, count(x1) as x1, count(x2) as x2, count(x3) as x3, count(x4) as x4 from feat group by site",
    "feat",
)
def nonmissing_count(fr):
    return known_counts(fr.feat, ["site"], ["x1", "x2", "x3", "x4"])


@query("ordered_scan", "select id, site, admit from stay order by site, admit, id", "stay")
def ordered_scan(fr):
    return fr.stay.select("id", "site", "admit").orderBy("site", "admit", "id")
