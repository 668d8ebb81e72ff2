"""Irregular measurements to a regular series of one row per (stay, hour).

Stays start on a whole hour, so every stay's hours are clock hours and an hour is an equal
key.  A stay's hours are one narrow row; the measurements of all tables are cut to them first,
then reduced per (stay, clock hour) in one grouping, and meet the hour grid on equal keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pyspark.sql import Column, DataFrame, functions as F

from sitewise.functions.scalar import ceil_div, hash_uniform
from sitewise.session import durable, shuffle_partitions


@dataclass(frozen=True)
class Measure:
    """One output column.

    ``sources`` are (table, column) in order of precedence: an hour takes the first non-null
    value per combination of rows, as a join of the tables on the hour would pair them.
    ``how`` is ``avg``, ``ceil_avg`` or ``sum``.
    """

    name: str
    sources: tuple[tuple[str, str], ...]
    how: str = "avg"


def anchors(events: DataFrame, key: str, time: str, signal: Column, start: str = "start", end: str = "end") -> DataFrame:
    """First and last time a signal was seen per stay."""
    return events.filter(signal).groupBy(key).agg(F.min(time).alias(start), F.max(time).alias(end))


def hour_spans(
    stays: DataFrame,
    key: str,
    start: str,
    end: str,
    unit: int,
    lead: int = 24,
    keep: Sequence[str] = (),
    window: str | None = None,
    look_back: int = 0,
) -> DataFrame:
    """Hours of each stay as one narrow row (key, keep, _slot0, _first, _last).

    ``start`` and ``end`` are integer times in the same measure as ``unit``; the hours are
    -lead .. ceil((end - start) / unit), and hour ``hr`` is the clock interval ``_slot0 + hr``.
    With ``window``, the column of a window end, only the hours [window - look_back, window]
    count.  Stays without a start or without hours have no row.
    """
    first = F.lit(-lead).cast("bigint")
    last = ceil_div(F.col(end) - F.col(start), unit)
    if window:
        first = F.greatest(first, F.col(window) - look_back).cast("bigint")
        last = F.least(last, F.col(window).cast("bigint"))
    return (
        stays.filter(F.col(start).isNotNull())
        .select(key, *keep, ceil_div(start, unit).alias("_slot0"), first.alias("_first"), last.alias("_last"))
        .filter("_first <= _last")
    )


def hours_of(spans: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows (key, keep, hr, slot) of the spans; ``slot`` is the number of the clock interval that ends the hour."""
    return (
        # one narrow row becomes hundreds: spread the stays before they grow
        spans.repartition(shuffle_partitions(spans.sparkSession), key)
        .select(key, *keep, "_slot0", F.explode(F.sequence("_first", "_last")).alias("hr"))
        .withColumn("slot", F.col("_slot0") + F.col("hr"))
        .drop("_slot0")
    )


def hour_grid(stays: DataFrame, key: str, start: str, end: str, unit: int, keep: Sequence[str] = (), **limits) -> DataFrame:
    """Rows hr = -lead .. ceil((end - start) / unit) per stay, see ``hour_spans``."""
    return hours_of(hour_spans(stays, key, start, end, unit, keep=keep, **limits), key, keep)


def slot_of(time: Column | str, unit: int) -> Column:
    """Number of the half-open interval (end - unit, end] that holds an integer time."""
    return ceil_div(time, unit)


def hourly_features(
    grid: DataFrame,
    tables: Mapping[str, DataFrame],
    measures: Sequence[Measure],
    key: str,
    visit: str | None = None,
    visit_tables: Sequence[str] = (),
    sum_mode: str = "faithful",
    spans: DataFrame | None = None,
) -> DataFrame:
    """One row per grid hour with all measures.

    ``tables`` hold (key, slot, columns); those in ``visit_tables`` are kept per visit and
    serve the hours of every stay of the visit.  ``spans`` are the written spans of the grid
    (``hour_spans``; without them they are taken from the grid): measurements outside the
    hours of their stay are dropped by a join with these narrow rows, before anything is
    exchanged where the planner can broadcast them.  What is left of all tables is one tagged
    union with one grouping, which meets the grid once.

    Joining k tables on the hour repeats each row once for every combination of rows of the
    others.  Averages of one table do not change by that; sums and averages over a choice
    between tables do, and are computed in closed form from the per-table counts and sums.
    ``sum_mode="corrected"`` adds each value once.
    """
    kept = [key, visit] if visit else [key]
    if spans is None:
        slots = [F.min("slot").alias("_from"), F.max("slot").alias("_to")]
        reach = durable(grid.groupBy(*kept).agg(*slots), "spans")
    else:
        reach = spans.select(*kept, (F.col("_slot0") + F.col("_first")).alias("_from"), (F.col("_slot0") + F.col("_last")).alias("_to"))
    columns = _columns_by_table(measures)
    parts = [
        _inside(tables[name], name, reach, visit if name in visit_tables else key, key, columns.get(name, ()))
        for name in tables
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    reduced = _reduced(union, columns, list(tables), key)
    filled = grid.select(key, "slot", "hr").join(reduced, [key, "slot"], "left")
    return filled.selectExpr(key, "hr", *[_measure(m, list(tables), sum_mode) for m in measures])


def spread_over_stays(measured: DataFrame, spans: DataFrame, visit: str) -> DataFrame:
    """Values kept per (visit, slot), given to the hours ``hr`` of every stay of the visit.

    A stay's hours stay one narrow row (``hour_spans``): the planner takes a grid for as small as the
    spans it grows from and would broadcast it.
    """
    hr = F.col("slot") - F.col("_slot0")
    return measured.join(spans, visit).withColumn("hr", hr).filter(F.col("hr").between(F.col("_first"), F.col("_last"))).drop("_slot0", "_first", "_last")


def _inside(table: DataFrame, name: str, reach: DataFrame, on: str, key: str, columns: Sequence[str]) -> DataFrame:
    """Measurements (key, slot, _table, columns) in the hours of a stay; rows of a visit once for each stay they fall into."""
    values = [F.col(c).cast("double").alias(f"{name}__{c}") for c in columns]
    events = table.select(F.col(on).alias("_entity"), "slot", F.lit(name).alias("_table"), *values)
    same = (F.col("_entity") == F.col("_of")) & F.col("slot").between(F.col("_from"), F.col("_to"))
    joined = events.join(reach.select(F.col(on).alias("_of"), F.col(key).alias("_stay"), "_from", "_to"), same)
    return joined.select(F.col("_stay").alias(key), *events.columns[1:])


def _reduced(union: DataFrame, columns: Mapping[str, Sequence[str]], tables: Sequence[str], key: str) -> DataFrame:
    """Rows, sums and counts of every table per (stay, slot); NULL for a table without rows there."""
    parts = []
    for name in tables:
        parts.append(f"nullif(cast(count(case when _table = '{name}' then 1 end) as double), 0.0D) as {name}__row")
        for c in columns.get(name, ()):
            parts.append(f"sum({name}__{c}) as {name}__{c}__sum")
            parts.append(f"cast(count({name}__{c}) as double) as {name}__{c}__n")
    text = f"select {key}, slot, {', '.join(parts)} from {{t}} group by {key}, slot"
    return union.sparkSession.sql(text, t=union)


def _columns_by_table(measures: Sequence[Measure]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for m in measures:
        for table, column in m.sources:
            if column not in found.setdefault(table, []):
                found[table].append(column)
    return found


def _repeat(table: str) -> str:
    """Rows a table contributes to the combinations of an hour: its own, or one empty row."""
    return f"coalesce({table}__row, 1.0D)"


def _measure(m: Measure, tables: list[str], sum_mode: str) -> str:
    total, count = _chosen(m.sources)
    if m.how == "sum":
        own = {t for t, _ in m.sources}
        others = [_repeat(t) for t in tables if t not in own] if sum_mode == "faithful" else []
        value = " * ".join([total, *others])
    else:
        value = f"({total}) / ({count})"
        if m.how == "ceil_avg":
            value = f"cast(ceil({value}) as double)"
    return f"case when {count} > 0 then {value} end as {m.name}"


def _chosen(sources: Sequence[tuple[str, str]]) -> tuple[str, str]:
    """Sum and count of the first non-null source over all combinations of rows."""
    (table, column), rest = sources[0], sources[1:]
    total = f"coalesce({table}__{column}__sum, 0.0D)"
    count = f"coalesce({table}__{column}__n, 0.0D)"
    if not rest:
        return total, count
    later = " * ".join(_repeat(t) for t, _ in rest)
    missing = f"({_repeat(table)} - {count})"
    rest_total, rest_count = _chosen(rest)
    return f"({total} * {later} + {missing} * {rest_total})", f"({count} * {later} + {missing} * {rest_count})"


def limit_hours(columns: Sequence[str]) -> Column:
    """Earliest of several limits; missing limits do not limit."""
    return F.least(*[F.col(c) for c in columns])


def fixed_window(stays: DataFrame, limits: Sequence[str], hours: int = 24, out: str = "windowtime_hours") -> DataFrame:
    """Same window end for all stays that last at least that long."""
    return stays.filter(limit_hours(limits) >= hours).withColumn(out, F.lit(hours))


def random_window(
    stays: DataFrame,
    key: str,
    limits: Sequence[str],
    seed: int | str,
    shortest: int = 4,
    margin: int = 2,
    out: str = "windowtime_hours",
) -> DataFrame:
    """Reproducible random window end, at least ``shortest`` hours; stays it does not fit are left out."""
    limit = limit_hours(limits)
    drawn = F.floor(F.col("random_fraction") * (limit - margin))
    return (
        stays.withColumn("random_fraction", hash_uniform(key, seed))
        .withColumn(out, F.greatest(drawn, F.lit(shortest)).cast("int"))
        .filter(F.col(out) <= limit)
    )


def up_to_window(hourly: DataFrame, windows: DataFrame, key: str, hr: str = "hr", end: str = "windowtime_hours") -> DataFrame:
    """Hours of each stay up to its window end; they are never broadcast, whatever the planner takes their size for."""
    return hourly.hint("merge").join(windows.select(key, end), key).filter(F.col(hr) <= F.col(end))


