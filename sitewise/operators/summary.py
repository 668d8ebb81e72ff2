"""Group summaries, descriptive tables and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitewise.functions.scalar import col, safe_ratio
from sitewise.operators.joins import group_join, member_rows
from sitewise.operators.ranking import exact_quantiles
from sitewise.session import durable


def site_sizes(df: DataFrame, site: str) -> DataFrame:
    return df.groupBy(site).agg(F.count(F.lit(1)).alias("n"))


def size_overview(df: DataFrame, site: str, thresholds: Sequence[int]) -> DataFrame:
    """Number of sites, extreme sizes and how many sites reach each threshold."""
    reach = [F.sum((F.col("n") >= t).cast("bigint")).alias(f"sites_ge_{t}") for t in thresholds]
    return site_sizes(df, site).agg(
        F.count(F.lit(1)).alias("sites"), F.min("n").alias("smallest"), F.max("n").alias("largest"), *reach
    )


def large_sites(df: DataFrame, site: str, at_least: int) -> DataFrame:
    return site_sizes(df, site).filter(F.col("n") >= at_least).select(site)


def rows_of_large_sites(df: DataFrame, site: str, at_least: int) -> DataFrame:
    return member_rows(df, large_sites(df, site, at_least), [site])


def largest_site(df: DataFrame, site: str) -> DataFrame:
    """The site with most rows, the smallest key among equals."""
    return site_sizes(df, site).orderBy(F.col("n").desc(), F.col(site)).limit(1)


def outcome_rate(df: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"))


def group_means(df: DataFrame, by: Sequence[str], event: str, means: Sequence[str], size: str = "n", rate: str = "rate") -> DataFrame:
    """Rows, event rate and plain means per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias(size),
        safe_ratio(F.sum(event).cast("double"), F.count(F.lit(1))).alias(rate),
        *[F.avg(m).alias(m) for m in means],
    )


def continuous_table(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long table (group, variable, n, missing, mean, sd); one aggregate for all variables."""
    aggregates = []
    for c in columns:
        aggregates += [
            F.count(c).alias(f"{c}__n"),
            F.sum(F.col(c).isNull().cast("bigint")).alias(f"{c}__missing"),
            F.avg(c).alias(f"{c}__mean"),
            F.stddev_samp(c).alias(f"{c}__sd"),
        ]
    rows = [
        F.struct(F.lit(c).alias("variable"), *[F.col(f"{c}__{s}").alias(s) for s in ("n", "missing", "mean", "sd")])
        for c in columns
    ]
    return df.groupBy(*by).agg(*aggregates).select(*by, F.inline(F.array(*rows)))


def categorical_table(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long table (group, variable, level, n, pct of the group).

    Levels of all variables are counted in one pass; a level is a text, missing is 'None'.
    """
    pairs = F.array(*[
        F.struct(F.lit(c).alias("variable"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("level"))
        for c in columns
    ])
    counts = df.select(*by, F.inline(pairs)).groupBy(*by, "variable", "level").agg(F.count(F.lit(1)).alias("n"))
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
    if not by:
        counts = counts.withColumn("_total", totals.scalar())
    else:
        # levels of a group are few next to its rows; a missing group is one too
        totals = durable(totals, "totals")
        counts = group_join(counts, totals, by, spread=["variable", "level"])
    return counts.select(*by, "variable", "level", "n", (F.lit(100.0) * F.col("n") / F.col("_total")).alias("pct"))


def quartile_table(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long table (group, variable, q1, median, q3), linear interpolation."""
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("_value")) for c in columns])
    long = df.select(*by, F.inline(pairs))
    return exact_quantiles(long, [*by, "variable"], "_value", (0.25, 0.5, 0.75), ("q1", "median", "q3"))


def curve(df: DataFrame, x: Sequence[str], value: str) -> DataFrame:
    """Mean and 95% interval of replicates at each step."""
    half = F.lit(1.96) * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return (
        df.groupBy(*x)
        .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
        .select(*x, "n", "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"))
    )


def histogram(df: DataFrame, value: Column | str, edges: Sequence[float]) -> DataFrame:
    """Counts and density per bin; bins are half-open, the last one closed, values outside do not count.

    Empty bins are kept: the bin list is part of the one-row aggregate.
    """
    v = col(value).cast("double")
    bins = list(zip(edges[:-1], edges[1:]))
    inside = [(v >= lo) & ((v <= hi) if i == len(bins) - 1 else (v < hi)) for i, (lo, hi) in enumerate(bins)]
    counts = df.agg(*[F.count(F.when(c, 1)).alias(f"b{i}") for i, c in enumerate(inside)])
    rows = F.array(*[
        F.struct(F.lit(i).alias("bin"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.col(f"b{i}").alias("n"))
        for i, (lo, hi) in enumerate(bins)
    ])
    total = sum((F.col(f"b{i}") for i in range(1, len(bins))), F.col("b0"))
    long = counts.select(total.alias("_total"), F.inline(rows))
    return long.select("bin", "lo", "hi", "n", safe_ratio(F.col("n").cast("double"), F.col("_total") * (F.col("hi") - F.col("lo"))).alias("density"))


def dummy_columns(df: DataFrame, column: str, levels: Sequence[str], reference: str, null_level: str = "null") -> DataFrame:
    """0/1 column per level but the reference, missing values as their own level."""
    value = F.coalesce(F.col(column), F.lit(null_level))
    return df.select(
        *[c for c in df.columns if c != column],
        *[(value == level).cast("int").alias(f"{column}_{level}") for level in levels if level != reference],
    )


def levels_by_frequency(df: DataFrame, column: str, null_level: str = "null", at_most: int = 1000) -> list[str]:
    """Levels of a categorical column, most frequent first (ties by name).

    They become column names, so the list is checked against ``at_most`` and never cut.
    """
    counts = df.groupBy(F.coalesce(F.col(column), F.lit(null_level)).alias("level")).count()
    found = counts.orderBy(F.col("count").desc(), "level").limit(at_most + 1).collect()
    if len(found) > at_most:
        raise ValueError(f"{column} has more than {at_most} levels")
    return [r["level"] for r in found]


def drop_reference_dummies(df: DataFrame, *columns: str, null_level: str = "null") -> DataFrame:
    """One-hot of each column with its most frequent level left out as the reference."""
    for column in columns:
        levels = levels_by_frequency(df, column, null_level)
        df = dummy_columns(df, column, sorted(levels), levels[0], null_level)
    return df


def improvement(deltas: DataFrame, delta: str) -> DataFrame:
    """Mean change and how many sites improved."""
    better = (F.col(delta) > 0).cast("int")
    return deltas.agg(F.avg(delta).alias("mean_delta"), F.sum(better).cast("bigint").alias("improved"), F.avg(better).alias("share_improved"))
