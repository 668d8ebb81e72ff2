"""Joins that hold when one key owns a large part of the rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitewise.functions.scalar import col, micros
from sitewise.session import durable, shuffle_partitions


def broadcast_sized(df: DataFrame) -> bool:
    """Does the planner's size of ``df`` lie below the session's broadcast limit."""
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    found = re.fullmatch(r"(-?\d+)\s*([kmg]?)b?", limit.lower())
    threshold = int(found[1]) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[found[2]] if found else 0
    return int(str(size)) <= threshold


def group_join(facts: DataFrame, groups: DataFrame, by: Sequence[str], spread: Sequence[Column | str], how: str = "inner") -> DataFrame:
    """Rows with the columns of their group's row in a written table; missing keys are a group like any other."""
    packed = F.struct(*[F.col(c) for c in by])
    keyed = groups.withColumn("_group", packed).drop(*by)
    return salted_join(facts.withColumn("_group", packed), keyed, ["_group"], spread, how).drop("_group")


def salted_join(facts: DataFrame, dims: DataFrame, on: Sequence[str], spread: Sequence[Column | str], how: str = "inner") -> DataFrame:
    """Equi-join of a large side with a smaller one, for keys of any size.

    A side below the broadcast limit needs no shuffle of the facts, so a key's size does not
    matter.  Above it the facts are counted per key; a key with more rows than a task's even
    share is spread by a hash of ``spread`` (values of the row, so a repeated task sends it to
    the same place) over as many tasks as it has shares, and its rows of the other side are
    repeated that often.  There are fewer such keys than tasks and the repeats are at most two
    per task, so both stay small whatever the data.  Rows with a missing key match nothing and
    are spread over all tasks.
    """
    if broadcast_sized(dims):
        return facts.join(F.broadcast(dims), list(on), how)
    heavy = _shares(facts, on)
    hashed = F.xxhash64(*[col(c) for c in spread])
    tasks = F.lit(shuffle_partitions(facts.sparkSession))
    missing = F.lit(False)
    for c in on:
        missing = missing | F.col(c).isNull()
    salts = F.when(missing, tasks).otherwise(F.coalesce("_shares", F.lit(1)))
    left = facts.join(F.broadcast(heavy), list(on), "left").withColumn("_salt", F.pmod(hashed, salts).cast("int")).drop("_shares")
    right = (
        dims.join(F.broadcast(heavy), list(on), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)))
        .drop("_shares")
    )
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def _shares(facts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys with more rows than an even share of a task, with the number of shares they fill."""
    tasks = shuffle_partitions(facts.sparkSession)
    counts = durable(facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), "weights")
    share = counts.select(F.sum("_n") / F.lit(float(tasks))).scalar()
    return counts.filter(F.col("_n") > share).select(*on, F.ceil(F.col("_n") / share).cast("int").alias("_shares"))


def interval_join(
    events: DataFrame,
    spans: DataFrame,
    on: Sequence[str],
    time: str,
    start: str,
    end: str,
    chunk: int = 86_400_000_000,
) -> DataFrame:
    """Events strictly inside the span of their key (start < time < end, timestamps).

    Both sides meet on (key, chunk of time): a span is repeated only for the chunks it
    touches, and the events of a key are spread over their chunks.  The exact bounds are
    checked on the joined rows.
    """
    number = lambda c: F.floor(micros(c) / F.lit(chunk))
    touched = spans.filter(F.col(start) < F.col(end)).withColumn("_chunk", F.explode(F.sequence(number(start), number(end))))
    joined = events.withColumn("_chunk", number(time)).join(touched, [*on, "_chunk"])
    return joined.filter((F.col(time) > F.col(start)) & (F.col(time) < F.col(end))).drop("_chunk")


def member_rows(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``keys``."""
    return _by_membership(df, keys, on, "left_semi")


def other_rows(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``keys``."""
    return _by_membership(df, keys, on, "left_anti")


def _by_membership(df: DataFrame, keys: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Key lists usually come from a grouping, whose size the planner cannot know: written first."""
    listed = durable(keys.select(*on), "keys")
    rest = [c for c in df.columns if c not in on] or list(on)
    return salted_join(df, listed, on, spread=rest, how=how)


def null_counts(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows and missing values per group, as reported after a left join."""
    missing = [F.sum(F.col(c).isNull().cast("bigint")).alias(f"null_{c}") for c in columns]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *missing)


def paired_delta(before: DataFrame, after: DataFrame, on: str, metrics: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """Two metric tables side by side with ``<metric>_diff`` = after - before."""
    renamed = after.select(on, *[F.col(m).alias(m + suffix) for m in metrics])
    both = before.select(on, *metrics).join(renamed, on, "inner")
    return both.select("*", *[(F.col(m + suffix) - F.col(m)).alias(m + "_diff") for m in metrics])
