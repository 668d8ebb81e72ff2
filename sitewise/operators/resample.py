"""Reproducible folds, samples, splits and nested training sets.

Randomness is a hash of (key, seed): the same rows land in the same place in any run, on
any cluster and after any lost executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sitewise.operators.joins import group_join, member_rows, other_rows
from sitewise.operators.ranking import hash_positions
from sitewise.session import durable


def folds(df: DataFrame, key: Sequence[str], seed: int, k: int = 5, by: Sequence[str] = (), out: str = "fold") -> DataFrame:
    """Fold numbers 0..k-1 of equal size (within each group of ``by``, e.g. the label)."""
    placed = hash_positions(df, by, key, seed, "_pos")
    return placed.withColumn(out, ((F.col("_pos") - 1) % k).cast("int")).drop("_pos")


def sample_per_group(df: DataFrame, by: Sequence[str], key: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` random rows of each group (all rows of smaller groups)."""
    return hash_positions(df, by, key, seed, "position").filter(F.col("position") <= n)


def split_sites(df: DataFrame, site: str, seed: int) -> DataFrame:
    """Sites with ``development`` = 1 for a random half of them (rounded down)."""
    sites = hash_positions(df.select(site).distinct(), (), [site], seed, "position")
    total = df.agg(F.countDistinct(site).alias("n")).scalar()
    return sites.withColumn("development", F.when(F.col("position") <= F.floor(total / 2), 1).otherwise(0))


def development_rows(df: DataFrame, split: DataFrame, site: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the development sites and of the others."""
    chosen = split.filter("development = 1")
    return member_rows(df, chosen, [site]), other_rows(df, chosen, [site])


def replicate(df: DataFrame, b: int) -> DataFrame:
    """Each row once per replicate number 1..b."""
    return df.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(b))))


def site_order(df: DataFrame, site: str, held_out: int, b: int, seed: int) -> DataFrame:
    """(b, n, site): a random order of all sites but the held-out one, for each replicate."""
    sites = df.select(site).distinct().filter(~F.col(site).eqNullSafe(held_out))
    ordered = hash_positions(replicate(sites, b), ["b"], [site, "b"], seed, "n")
    return ordered.select("b", "n", site)


def prefix_order(df: DataFrame, key: str, b: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """(.., b, position): each row's place in a random order per replicate."""
    return hash_positions(replicate(df, b), [*by, "b"], [key, "b"], seed, "position")


def first_step(position: str, step: int):
    """Number of the first prefix 1*step, 2*step, .. that holds the position."""
    return F.ceil(F.col(position) / step).cast("int")


def spread_order(df: DataFrame, by: Sequence[str], key: Sequence[str], y: str, seed: int, out: str = "place") -> DataFrame:
    """0-based places that spread the outcomes evenly over the order of each group.

    Of N rows with P outcomes the k-th outcome goes to floor(k (N-1) / (P-1)), the last to
    N-1; the other rows fill the free places in random order.  The j-th free place is
    j + (number of outcomes before it); that number has a closed form, so no list of places
    is built.
    """
    ranked = hash_positions(df, [*by, y], key, seed, "_rank").withColumn("_k", F.col("_rank") - 1)
    sizes = df.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum(F.col(y).cast("double")).alias("_p")
    )
    if by:
        sized = group_join(ranked, durable(sizes, "sizes"), by, spread=[*key])
    else:
        sized = ranked.withColumn("_s", sizes.select(F.struct("_n", "_p")).scalar())
        sized = sized.withColumns({"_n": F.col("_s._n"), "_p": F.col("_s._p")}).drop("_s")
    gap = F.when(F.col("_p") > 1, (F.col("_n") - 1) / (F.col("_p") - 1))
    sized = sized.withColumn("_gap", gap)

    def taken(k):
        """Place of outcome number k (0-based)."""
        spaced = F.when(k >= F.col("_p") - 1, F.col("_n") - 1).otherwise(F.floor(k * F.col("_gap")))
        return F.when(F.col("_p") <= 1, F.lit(0)).otherwise(spaced).cast("bigint")

    j = F.col("_k")
    # outcomes k with place(k) - k <= j lie before free place j; one step either way of the estimate settles rounding
    estimate = F.coalesce(F.ceil(F.try_divide(j + 1, F.col("_gap") - 1)), F.lit(0))
    guess = F.when(F.col("_p") <= 1, F.lit(0)).otherwise(F.least(F.greatest(estimate - 2, F.lit(0)), F.col("_p")))
    counted = sized.withColumn("_m", guess.cast("bigint"))
    for _ in range(4):
        m = F.col("_m")
        more = (m < F.col("_p")) & (taken(m) - m <= j)
        counted = counted.withColumn("_m", F.when(more, m + 1).otherwise(m))
    place = F.when(F.col(y) == 1, taken(j)).otherwise(j + F.col("_m"))
    return counted.withColumn(out, place.cast("bigint")).drop("_rank", "_k", "_n", "_p", "_gap", "_m")
