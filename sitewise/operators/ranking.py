"""Positions, running totals and exact quantiles inside groups of any size.

A window over a whole group would put that group into one task.  Here every group is cut
into cells that follow the order, the cells are summed first (few rows), and windows only
run inside a cell; the sum of the earlier cells is added.  Results are exact for any cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sitewise.functions.scalar import col, hash_uniform
from sitewise.session import durable, shuffle_partitions


def cell_count(spark: SparkSession) -> int:
    """Power of two, about four cells per shuffle partition."""
    wanted = min(max(4 * shuffle_partitions(spark), 16), 4096)
    return 1 << (wanted - 1).bit_length()


def group_key(by: Sequence[str]) -> Column:
    """Group columns packed into one key that equals itself when parts are NULL."""
    return F.struct(*by) if by else F.lit(0)


def hash_positions(
    df: DataFrame,
    by: Sequence[str],
    key: Sequence[str],
    seed: int | str | Column,
    out: str = "position",
) -> DataFrame:
    """1-based place of each row in a reproducible random order of its group.

    The order is that of ``hash_uniform(key, seed)``; its leading digits cut the group into
    equal cells, so no task sees more than a cell.
    """
    cells = cell_count(df.sparkSession)
    tagged = (
        df.withColumn("_u", hash_uniform(key, seed))
        .withColumn("_cell", F.floor(F.col("_u") * cells).cast("int"))
        .withColumn("_g", group_key(by))
    )
    sizes = tagged.groupBy("_g", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("_g").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_g", "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_g", "_cell").orderBy("_u", *key)
    ranked = tagged.withColumn("_inside", F.row_number().over(inside))
    return (
        ranked.join(offsets, ["_g", "_cell"])
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_g", "_cell", "_u", "_inside", "_before")
    )


def ordered_positions(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str = "position") -> DataFrame:
    """``row_number()`` over any order, with groups that may span many tasks.

    Rows are range-partitioned by group and order and written with their part number, so a
    group lies in consecutive parts.  A part can only continue one group of the part before
    it: the table of offsets has at most one row per part and is safe to broadcast.
    """
    parts = shuffle_partitions(df.sparkSession)
    keyed = df.withColumn("_g", group_key(by))
    placed = durable(
        keyed.repartitionByRange(parts, F.col("_g"), *order).withColumn("_part", F.spark_partition_id()),
        "ordered",
    )
    pieces = placed.groupBy("_part", "_g").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("_g").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        pieces.withColumn("_before", F.sum("_n").over(earlier)).filter("_before > 0").select("_part", "_g", "_before")
    )
    inside = W.partitionBy("_part", "_g").orderBy(*order)
    return (
        placed.withColumn("_inside", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["_part", "_g"], "left")
        .withColumn(out, (F.coalesce("_before", F.lit(0)) + F.col("_inside")).cast("bigint"))
        .drop("_part", "_g", "_inside", "_before")
    )


def small_group_positions(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str = "position") -> DataFrame:
    """``row_number()`` in groups that are small by nature, such as the stays of a person: one window, nothing written."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("bigint"))


def is_first(df: DataFrame, by: Sequence[str], order: Sequence[str], unique: str, out: str = "is_first") -> DataFrame:
    """1 for the first row of its group, NULLs last; a minimum per group, no window.

    ``unique`` breaks ties, so exactly one row per group is marked.
    """
    first_key = F.min(F.struct(*_nulls_last(order), F.col(unique))).getField(unique)
    firsts = df.groupBy(*by).agg(first_key.alias(unique)).select(unique, F.lit(1).alias(out))
    return df.join(firsts, unique, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def _nulls_last(order: Sequence[str]) -> list[Column]:
    parts = []
    for c in order:
        parts += [F.col(c).isNull().alias(f"_null_{c}"), F.col(c)]
    return parts


def add_cells(df: DataFrame, value: str, out: str = "_cell") -> DataFrame:
    """Cut the value range at approximate quantiles of all rows.

    Each cell holds about rows / cells rows, so a group, however large, is spread over
    cells.  The edges are one row (a scalar subquery); the search is a fixed number of
    comparisons per row.  ``df`` is read twice, the first time only its value column: pass a
    written table.
    """
    cells = cell_count(df.sparkSession)
    shares = ", ".join(str(i / cells) for i in range(1, cells))
    edges = df.select(F.expr(f"percentile_approx(cast({value} as double), array({shares}), {10 * cells})"))
    cut = df.withColumn("_edges", edges.scalar()).withColumn(out, F.lit(0))
    step = cells // 2
    while step:
        cut = cut.withColumn(out, F.expr(f"{out} + if(get(_edges, {out} + {step - 1}) <= {value}, {step}, 0)"))
        step //= 2
    return cut.drop("_edges")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: Column | str, shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Linear-interpolated quantiles per group; missing values are left out."""
    totals = (
        df.select(group_key(by).alias("_g"), col(value).cast("double").alias("_v"))
        .filter("_v is not null")
        .groupBy("_g", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    celled = add_cells(durable(totals, "totals"), "_v")
    sizes = celled.groupBy("_g", "_cell").agg(F.sum("_n").alias("_cell_n"))
    earlier = W.partitionBy("_g").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_g",
        "_cell",
        F.coalesce(F.sum("_cell_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_cell_n").over(W.partitionBy("_g")).alias("_total"),
    )
    inside = W.partitionBy("_g", "_cell").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        celled.withColumn("_local", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(offsets, ["_g", "_cell"])
        .withColumn("_start", F.col("_before") + F.col("_local"))
    )
    picks = []
    for i, share in enumerate(shares):
        rank = F.lit(share) * (F.col("_total") - 1)
        for side, place in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            holds = (F.col("_start") <= place) & (place < F.col("_start") + F.col("_n"))
            picks.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{side}{i}"))
        picks.append(F.max(rank - F.floor(rank)).alias(f"_w{i}"))
    found = placed.groupBy("_g").agg(*picks)
    interpolated = [
        (F.col(f"_lo{i}") + F.col(f"_w{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(name)
        for i, name in enumerate(names)
    ]
    return found.select(*[F.col("_g").getField(b).alias(b) for b in by], *interpolated)
