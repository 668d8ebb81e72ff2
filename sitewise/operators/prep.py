"""Imputation and scaling as expressions against a small table of statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitewise.operators.joins import group_join
from sitewise.session import durable


def moments(df: DataFrame, by: Sequence[str], features: Sequence[str], *more: Column) -> DataFrame:
    """Per group: rows, ``more`` aggregates, and per feature the mean and the population SD after mean imputation.

    Imputed rows add nothing to the squared deviations, so both come from one pass over the
    raw values: sd^2 = var_pop(known) * known / rows.  A feature without any value gets mean 0;
    a constant one gets scale 1.
    """
    means, scales = [], []
    for f in features:
        x = F.col(f).cast("double")
        means.append(F.coalesce(F.avg(x), F.lit(0.0)))
        sd = F.sqrt(F.var_pop(x) * F.count(x) / F.count(F.lit(1)))
        scales.append(F.when(sd > 0, sd).otherwise(1.0))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.array(*means).alias("mean"), F.array(*scales).alias("scale"), *more
    )


def imputed(feature: str, i: int, mean: str = "mean") -> Column:
    return F.coalesce(F.col(feature).cast("double"), F.get(mean, F.lit(i)))


def standardized(feature: str, i: int, mean: str = "mean", scale: str = "scale") -> Column:
    centre = F.get(mean, F.lit(i))
    return (F.coalesce(F.col(feature).cast("double"), centre) - centre) / F.get(scale, F.lit(i))


def with_moments(df: DataFrame, stats: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Statistics next to each row, also for rows whose group is missing; one overall row of statistics becomes a scalar subquery."""
    if not by:
        packed = stats.select(F.struct("mean", "scale").alias("_s")).scalar()
        return df.withColumn("_s", packed).withColumn("mean", F.col("_s.mean")).withColumn("scale", F.col("_s.scale")).drop("_s")
    # written first, so that the size that decides on a broadcast is the size on disk
    written = durable(stats.select(*by, "mean", "scale"), "moments")
    return group_join(df, written, by, spread=features)


def impute_mean(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing values replaced by the (group) mean, 0 where a group has no value at all."""
    joined = with_moments(df, moments(df, by, features), by, features)
    return joined.withColumns({f: imputed(f, i) for i, f in enumerate(features)}).drop("mean", "scale")


def standardize(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean imputation, then centre and scale by the population SD."""
    joined = with_moments(df, moments(df, by, features), by, features)
    return joined.withColumns({f: standardized(f, i) for i, f in enumerate(features)}).drop("mean", "scale")


def fill_missing(df: DataFrame, train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing values replaced by the means of another table."""
    joined = with_moments(df, moments(train, (), features), (), features)
    return joined.withColumns({f: imputed(f, i) for i, f in enumerate(features)}).drop("mean", "scale")


def known_counts(df: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Non-missing values per group and feature; 0 marks a feature a group never measured."""
    return df.groupBy(*by).agg(*[F.count(f).alias(f) for f in features])
