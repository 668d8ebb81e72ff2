"""Window features: one row per stay from the hours before its window end."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

# Variable names of the hourly table, by the summary taken of them.
VITALS = ("heartrate", "sysbp", "diasbp", "meanbp", "resprate", "tempc", "spo2")
LABS = (
    "bg_pao2", "bg_paco2", "bg_pao2fio2ratio", "bg_ph", "bg_baseexcess",
    "albumin", "bands", "bicarbonate", "bilirubin", "bun", "calcium", "creatinine",
    "glucose", "hematocrit", "hemoglobin", "inr", "lactate", "platelet", "potassium", "sodium", "wbc",
)


@dataclass(frozen=True)
class FeaturePlan:
    """Variables per summary; those in ``extended`` look back further and are named ``_early``."""

    first: tuple[str, ...] = VITALS + LABS + ("gcs",)
    last: tuple[str, ...] = VITALS + LABS + ("gcs",)
    low: tuple[str, ...] = VITALS + ("gcs",)
    high: tuple[str, ...] = VITALS + ("gcs",)
    total: tuple[str, ...] = ("urineoutput",)
    extended: tuple[str, ...] = LABS

    def variables(self) -> list[str]:
        seen: list[str] = []
        for group in (self.first, self.last, self.low, self.high, self.total):
            seen += [v for v in group if v not in seen]
        return seen


def in_window_rows(
    hourly: DataFrame,
    windows: DataFrame,
    key: str,
    width: int,
    extra: int,
    hr: str = "hr",
    end: str = "windowtime_hours",
) -> DataFrame:
    """Hours [end - width - extra, end] of each stay; ``early`` marks those before end - width.

    A stay has one row per hour, so no key can grow beyond its hours.
    """
    ends = windows.select(key, F.col(end).alias("_end"))
    joined = hourly.join(ends, key)
    back = F.col("_end") - F.col(hr)
    return joined.filter((back >= 0) & (back <= width + extra)).withColumn("early", back > width).drop("_end")


def window_features(
    hourly: DataFrame,
    windows: DataFrame,
    key: str,
    width: int = 8,
    extra: int = 24,
    plan: FeaturePlan = FeaturePlan(),
    hr: str = "hr",
    end: str = "windowtime_hours",
) -> DataFrame:
    """All summaries of all variables in one grouping.

    Every summary is a partial aggregate (``min_by``/``max_by`` over the hour of non-null
    values, conditional min, max and sum) and uses the partitioning of the join before it.
    """
    rows = in_window_rows(hourly.select(key, hr, *plan.variables()), windows, key, width, extra, hr, end)
    parts: list[str] = []
    for names, suffix, how in ((plan.first, "first", "min_by"), (plan.last, "last", "max_by")):
        for v in names:
            counts, label = _scope(v, suffix, v in plan.extended)
            parts.append(f"{how}({v}, case when {counts} then {hr} end) as {label}")
    for names, suffix, how in ((plan.low, "min", "min"), (plan.high, "max", "max")):
        for v in names:
            counts, label = _scope(v, suffix, v in plan.extended)
            parts.append(f"{how}(case when {counts} then {v} end) as {label}")
    parts += [f"{window_sum(v)} as {v}_sum" for v in plan.total]
    return rows.sparkSession.sql(f"select {key}, {', '.join(parts)} from {{rows}} group by {key}", rows=rows)


def window_sum(variable: str) -> str:
    """Sum in the window: 0 if all values are missing, NULL if the window holds no row."""
    value = f"case when not early then {variable} end"
    return f"case when count(case when not early then 1 end) > 0 then coalesce(sum({value}), 0.0D) end"


def _scope(variable: str, suffix: str, wide: bool) -> tuple[str, str]:
    """Rows that count for a summary and the name of its column."""
    if wide:
        return f"{variable} is not null", f"{variable}_{suffix}_early"
    return f"{variable} is not null and not early", f"{variable}_{suffix}"


def select_features(columns: Sequence[str], outcomes: Sequence[str], names: Sequence[str] = (), prefixes: Sequence[str] = (), suffixes: Sequence[str] = ()) -> list[str]:
    """Model inputs: all columns but the outcomes, given names, prefixes and suffixes."""
    drop = set(outcomes) | set(names)
    return [c for c in columns if c not in drop and not c.startswith(tuple(prefixes)) and not c.endswith(tuple(suffixes))]


def front_columns(df: DataFrame, front: Sequence[str]) -> DataFrame:
    """Named columns first, the others in their order."""
    return df.select(*front, *[c for c in df.columns if c not in front])
