"""Reproducible folds, samples, splits and experiment specifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.operators import resample
from sitewise.operators.ranking import hash_positions
from sitewise.queries.registry import query
from sitewise.queries.sqltext import UNIFORM


def place_sql(source: str, by: str, key: str, seed, name: str = "position") -> str:
    """Rows with their 1-based place in hash order, by group."""
    part = f"partition by {by} " if by else ""
    return f"select *, row_number() over ({part}order by {UNIFORM(key, seed)}, id) as {name} from {source}"


@query("hash_shuffle", f"select id, site, position from ({place_sql('stay', 'site', 'id', 5)})", "stay")
def hash_shuffle(fr):
    """Random order of the stays of each site."""
    return hash_positions(fr.stay.select("id", "site"), ["site"], ["id"], 5)


@query("kfold_assign", f"select id, ((position - 1) % 5)::int as fold from ({place_sql('stay', '', 'id', 71017)})", "stay")
def kfold_assign(fr):
    """Five folds over all stays; positions over the whole table without a single-task sort."""
    return resample.folds(fr.stay.select("id"), ["id"], 71017)


@query("stratified_fold", f"select id, y, ((position - 1) % 5)::int as fold from ({place_sql('stay', 'y', 'id', 3)})", "stay")
def stratified_fold(fr):
    return resample.folds(fr.stay.select("id", "y"), ["id"], 3, by=["y"])


@query("sample_n_per_site", f"select id, site, position from ({place_sql('stay', 'site', 'id', 18201)}) where position <= 500", "stay")
def sample_n_per_site(fr):
    """500 random stays of each site."""
    return resample.sample_per_group(fr.stay.select("id", "site"), ["site"], ["id"], 500, 18201)


@query(
    "site_split",
    f"""with sites as (select distinct site as id from stay), placed as ({place_sql('sites', '', 'id', 3231)})
        select id as site, position, (position <= floor((select count(*) from sites) / 2))::int as development from placed""",
    "stay",
)
def site_split(fr):
    """Half of the sites for development."""
    return resample.split_sites(fr.stay, "site", 3231)


@query(
    "site_addition_spec",
    f"""with sites as (select distinct site as id, b from stay, range(1, 11) r(b) where site <> 7)
        select b::int as b, row_number() over (partition by b order by {UNIFORM("id || '|' || b", 18201)}, id) as n, id as site from sites""",
    "stay",
)
def site_addition_spec(fr):
    """Ten random orders in which sites join the training set."""
    return resample.site_order(fr.stay, "site", 7, 10, 18201)


@query(
    "prefix_spec",
    f"""with rows as (select id, site, b from stay, range(1, 4) r(b))
        select id, b::int as b, position, ceil(position / 500.0)::int as first_step from (
          select *, row_number() over (partition by b order by {UNIFORM("id || '|' || b", 9)}, id) as position from rows)""",
    "stay",
)
def prefix_spec(fr):
    """Place of each stay in three random orders and the first block of 500 that holds it."""
    placed = resample.prefix_order(fr.stay.select("id"), "id", 3, 9)
    return placed.select("id", "b", "position", resample.first_step("position", 500).alias("first_step"))


@query(
    "spread_order",
    f"""with ranked as ({place_sql('stay', 'site, y', 'id', 1292, 'r')}),
        sizes as (select site, count(*) as n, sum(y) as p from stay group by 1),
        taken as (select id, site, case when p = 1 then 0 when r = p then n - 1 else floor((r - 1) * ((n - 1.0::double) / (p - 1))) end::bigint as place
          from ranked join sizes using (site) where y = 1),
        free as (select site, place, row_number() over (partition by site order by place) as r from (
          select site, unnest(range(0, n)) as place from sizes) anti join taken using (site, place))
        select id, site, 1 as y, place from taken
        union all select k.id, k.site, 0, f.place from ranked k join free f using (site, r) where k.y = 0""",
    "stay",
)
def spread_order(fr):
    """Outcomes spread evenly over the order of each site."""
    placed = resample.spread_order(fr.stay.select("id", "site", "y"), ["site"], ["id"], "y", 1292)
    return placed.select("id", "site", "y", "place")
