"""Exclusion flags, attrition and stay order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitewise.functions.scalar import any_of


def excluded(flags: Sequence[str]) -> Column:
    """Highest flag; NULL flags are skipped, so an unknown flag does not exclude."""
    return F.greatest(*[F.col(f) for f in flags])


def exclusion_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "exclusion_" in c]


def drop_excluded(df: DataFrame, window: str = "windowtime_hours") -> DataFrame:
    """Rows with no exclusion flag equal to 1 and, where the column exists, a window."""
    return df.filter(~_removed(df, window))


def attrition_report(df: DataFrame, window: str = "windowtime_hours") -> DataFrame:
    """Rows removed by each flag, by all flags, by a missing window, and the rows kept.

    One aggregate over the table; each step is one output row with count and percentage.
    """
    flags = exclusion_columns(df)
    by_flag = any_of([F.col(c) == 1 for c in flags])
    steps: list[tuple[str, Column]] = [(f"flagged {c}", F.coalesce(F.col(c) == 1, F.lit(False))) for c in flags]
    steps.append(("flagged at all", by_flag))
    if window in df.columns:
        steps.append(("without a window", ~by_flag & F.col(window).isNull()))
    steps.append(("kept", ~_removed(df, window)))
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.sum(cond.cast("bigint")).alias(f"s{i}") for i, (_, cond) in enumerate(steps)],
    )
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(label).alias("label"), F.col(f"s{i}").alias("n")) for i, (label, _) in enumerate(steps)])
    return counts.select("total", F.inline(rows)).select(
        "step", "label", "n", (F.lit(100.0) * F.col("n") / F.col("total")).alias("pct")
    )


def _removed(df: DataFrame, window: str) -> Column:
    conditions = [F.col(c) == 1 for c in exclusion_columns(df)]
    if window in df.columns:
        conditions.append(F.col(window).isNull())
    return any_of(conditions)


def code_flags(
    items: DataFrame,
    keys: Sequence[str],
    value: str,
    vocabulary: dict[str, Sequence[str]],
    unknown_is_null: bool,
) -> DataFrame:
    """One 0/1 flag per vocabulary entry: does any item of the key carry one of its words.

    ``unknown_is_null`` gives NULL instead of 0 to keys whose items have no value at all.
    """
    known = F.col(value).isNotNull()
    aggregates = []
    for name, words in vocabulary.items():
        hit = F.when(F.col(value).isin(*words), 1)
        other = F.when(known, 0) if unknown_is_null else F.lit(0)
        aggregates.append(F.max(F.coalesce(hit, other)).alias(name))
    return items.groupBy(*keys).agg(*aggregates)


def first_limited(codes: DataFrame, key: str, time: str, flags: Sequence[str], out: str) -> DataFrame:
    """First time any limiting flag is set."""
    return codes.filter(F.greatest(*[F.col(f) for f in flags]) > 0).groupBy(key).agg(F.min(time).alias(out))


def capped_days(hours: DataFrame, key: str, column: str, cap: int, out: str) -> DataFrame:
    """Whole days of a summed duration, at most ``cap``; an unknown total counts as the cap."""
    days = F.ceil(F.sum(column) / 24.0).cast("int")
    return hours.groupBy(key).agg(F.least(days, F.lit(cap)).alias(out))
