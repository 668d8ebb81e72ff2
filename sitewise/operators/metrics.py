"""Evaluation of scored rows per group: all metrics from one pass over (group, score) counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sitewise.functions.scalar import safe_ratio
from sitewise.operators.ranking import add_cells
from sitewise.session import durable

LOG_CLIP = 1e-15


def score_counts(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    """Rows, outcomes and non-outcomes per (group, score); equal scores collapse before the shuffle."""
    return df.groupBy(*by, F.col(p).cast("double").alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(y).alias("_known"),
        F.sum(F.col(y).cast("double")).alias("_n1"),
    )


def evaluate(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """count, outcome, smr, mse, mae, logloss and auc per group.

    ``auc`` is tie-aware and NULL where a group has one class; it is the share of
    (outcome, non-outcome) pairs in the right order, ties counted half.  The rows are read
    once; their counts are written, since the cell edges and the ranking both need them.
    """
    scored = F.col("_p").isNotNull()
    counts = add_cells(durable(score_counts(df, by, y, p), "counts"), "_p")
    split = (
        counts.withColumn("_n1", F.coalesce("_n1", F.lit(0.0)))
        .withColumn("_n0", F.col("_known") - F.col("_n1"))
        .withColumn("_s1", F.when(scored, F.col("_n1")).otherwise(0.0))
        .withColumn("_s0", F.when(scored, F.col("_n0")).otherwise(0.0))
    )
    below = W.partitionBy(*by, "_cell").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    ranked = split.withColumn("_below", F.coalesce(F.sum("_s0").over(below), F.lit(0.0)))
    pc = F.greatest(F.least(F.col("_p"), F.lit(1 - LOG_CLIP)), F.lit(LOG_CLIP))
    s1, s0, prob = F.col("_s1"), F.col("_s0"), F.col("_p")
    per_cell = ranked.groupBy(*by, "_cell").agg(
        F.sum("_known").alias("_known"),
        F.sum("_n1").alias("_n1"),
        F.sum("_s1").alias("_s1"),
        F.sum("_s0").alias("_s0"),
        F.sum(F.col("_n") * prob).alias("_sum_p"),
        F.sum(s1 * (1 - prob) * (1 - prob) + s0 * prob * prob).alias("_sq"),
        F.sum(s1 * F.abs(1 - prob) + s0 * F.abs(prob)).alias("_abs"),
        F.sum(-(s1 * F.log(pc) + s0 * F.log(1 - pc))).alias("_log"),
        F.sum(s1 * (F.col("_below") + s0 / 2)).alias("_pairs"),
    )
    return add_up_cells(per_cell, by)


def add_up_cells(per_cell: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metrics of each group from the sums of its cells, which follow the order of the scores."""
    earlier = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_s0").over(earlier), F.lit(0.0))
    joined_up = per_cell.withColumn("_pairs", F.col("_pairs") + F.col("_s1") * offset)
    n_scored = F.sum("_s1") + F.sum("_s0")
    return joined_up.groupBy(*by).agg(
        F.sum("_known").cast("bigint").alias("count"),
        F.sum("_n1").cast("bigint").alias("outcome"),
        safe_ratio(F.sum("_n1"), F.sum("_sum_p")).alias("smr"),
        safe_ratio(F.sum("_sq"), n_scored).alias("mse"),
        safe_ratio(F.sum("_abs"), n_scored).alias("mae"),
        safe_ratio(F.sum("_log"), n_scored).alias("logloss"),
        safe_ratio(F.sum("_pairs"), F.sum("_s1") * F.sum("_s0")).alias("auc"),
    )


def smr(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    """Observed over expected outcomes; one partial aggregate, no ordering."""
    return df.groupBy(*by).agg(safe_ratio(F.sum(F.col(y).cast("double")), F.sum(p)).alias("smr"))


def errors(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    gap = F.col(y) - F.col(p)
    return df.groupBy(*by).agg(F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"))


def log_loss(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    pc = F.greatest(F.least(F.col(p), F.lit(1 - LOG_CLIP)), F.lit(LOG_CLIP))
    return df.groupBy(*by).agg(F.avg(-(F.col(y) * F.log(pc) + (1 - F.col(y)) * F.log(1 - pc))).alias("logloss"))


def r2(df: DataFrame, by: Sequence[str], y: Column, f: Column) -> DataFrame:
    """1 - residual / total sum of squares, in one pass."""
    residual = F.sum((y - f) * (y - f))
    total = F.var_pop(y) * F.count(y)
    return df.groupBy(*by).agg((1 - safe_ratio(residual, total)).alias("r2"))


def funnel_limits(spark: SparkSession, first: int = 10, last: int = 3000, step: int = 10) -> DataFrame:
    """95% limits around 1 for a ratio of counts, for sizes from ``first`` to below ``last``; the sizes are dealt to all tasks."""
    size = F.col("n").cast("double")
    half = F.lit(1.96) * F.sqrt(size) / size
    return spark.range(first, max(last, first), step).select(F.col("id").alias("n")).select("n", (1 + half).alias("upper"), (1 - half).alias("lower"))


def funnel_outliers(metrics: DataFrame, min_outcome: int = 10) -> DataFrame:
    """Sites with enough outcomes, marked where the ratio leaves the limits for their size."""
    n = F.col("count").cast("double")
    half = F.lit(1.96) * F.sqrt(n) / n
    return (
        metrics.filter(F.col("outcome") >= min_outcome)
        .withColumn("upper", 1 + half)
        .withColumn("lower", 1 - half)
        .withColumn("outside", F.when((F.col("smr") > F.col("upper")) | (F.col("smr") < F.col("lower")), 1).otherwise(0))
    )


def site_distance(matrix: DataFrame, train: str = "train_site", test: str = "test_site", auc: str = "auc") -> DataFrame:
    """1 - min(auc of i on j, auc of j on i) for each unordered pair of the given matrix, i < j.

    Both directions of a pair are two rows of the matrix: one grouping, no self-join.
    """
    i, j = F.least(train, test), F.greatest(train, test)
    return (
        matrix.filter(F.col(train) != F.col(test))
        .groupBy(i.alias("site_i"), j.alias("site_j"))
        .agg((1 - F.min(auc)).alias("distance"))
    )


def off_diagonal_variance(matrix: DataFrame, by: str, other: str, auc: str = "auc") -> DataFrame:
    """Population variance of the scores of one row (or column) of the matrix without its diagonal."""
    return matrix.filter(F.col(by) != F.col(other)).groupBy(by).agg(F.var_pop(auc).alias("variance"))
